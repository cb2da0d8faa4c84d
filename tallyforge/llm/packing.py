"""Best-fit-decreasing packing of token pieces with a segment tree.

Equal lengths are interchangeable, so best-fit decreasing over all pieces depends on
nothing but how many there are of each length: at most ``capacity`` numbers, whatever
the input. The driver packs these counts, runs of equal bins at a time; the tree over
remaining capacities finds the tightest open bins in logarithmic time. The result is a
table of runs (length, first ordinal, first sequence, offset), and each piece finds its
place by its ordinal among the pieces of its length, counted in two distributed steps.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _bytes as B
from tallyforge.llm._session import staged

CAPACITY = 4096
END = 1
#: Pieces of one length and bucket that are numbered in one task, about.
PER_BUCKET = 100_000
#: Words whose ids a worker remembers; then it forgets them all.
REMEMBERED = 1_500_000
RECENT = 150_000
#: Punctuation that closes words.
CLOSING = b".,;:!?|#*$%&"
_tokenizers: dict[str, WordIds] = {}
B.cached_by("packing", _tokenizers.clear)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class CapacityTree:
    """Counts of open bins by remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open bin has."""
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first ordinal, pieces, first sequence, offset) of best-fit decreasing."""
    tree, bins, opened, runs = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], 0, []
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            # a bin that still holds another piece of this length is now the tightest one
            each = (capacity if room is None else room) // length
            n = max(1, left // each)
            if room is None:
                first, room = opened, capacity
                opened += n
            else:
                first, many = bins[room].popleft()
                n = min(n, many)
                if many > n:
                    bins[room].appendleft((first + n, many - n))
                tree.add(room, -n)
            each = min(each, left)
            for k in range(each):
                runs.append((length, done, n, first, capacity - room + k * length))
                done += n
            left -= n * each
            if rest := room - each * length:
                bins[rest].append((first, n))
                tree.add(rest, n)
    return runs


class WordIds:
    """Ids of the words met so far, in one flat array, by the words' 64-bit hashes."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.forget()

    def forget(self) -> None:
        # sorted hashes and their slots, the many and the recent: a few bytes a word
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.known = 0
        self.flat = np.zeros(1 << 16, f"<u{array(self.code).itemsize}")
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.held = 0

    def of(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number of ids, and all ids in order."""
        unique, first, inverse = np.unique(B.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        at = np.full(len(unique), -1, np.int64)
        for keys, slots in self.levels:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
                at = np.where(keys[place] == unique, slots[place], at)
        new = np.flatnonzero(at < 0)
        if self.known + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(unique))
        if len(new):
            at[new] = self.known + np.arange(len(new))
            data = low.tobytes()
            self._learn(unique[new], [data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        return self.lengths[at][inverse], _gathered(self.flat, self.starts[at], self.lengths[at], inverse).astype("<u4")

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        cores = [_core(w) for w in words]
        tails = [w[len(c) :] for w, c in zip(words, cores)]
        parts = list({*cores, *tails})
        place = {w: i for i, w in enumerate(parts)}
        found: list[list[int]] = []
        for i in range(0, len(parts), 4096):
            found += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in parts[i : i + 4096]], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.flat.dtype, int(size.sum()))
        both = np.empty(2 * len(words), np.int64)  # a word is its core's ids and its tail's
        both[::2] = [place[w] for w in cores]
        both[1::2] = [place[w] for w in tails]
        ids = _gathered(flat, np.cumsum(size) - size, size, both)
        lengths = size[both].reshape(-1, 2).sum(1)
        base = self.known
        while len(self.flat) < self.held + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < base + len(words):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.held : self.held + len(ids)] = ids
        self.starts[base : base + len(words)] = self.held + np.cumsum(lengths) - lengths
        self.lengths[base : base + len(words)] = lengths
        self.held += len(ids)
        self.known += len(words)
        many, recent = self.levels
        recent = _joined(recent, (hashes, np.arange(base, base + len(words), dtype=np.int32)))
        if len(recent[0]) > RECENT:
            many, recent = _joined(many, recent), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.levels = [many, recent]


def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` one after another, in the given order."""
    n = lengths[order]
    total = np.cumsum(n)
    where = np.repeat((starts[order] - (total - n)).astype(np.int32), n) if len(n) else np.zeros(0, np.int32)
    where += np.arange(len(where), dtype=np.int32)
    return flat[where]


def _words_of(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def _core(word: bytes) -> bytes:
    """The word without closing punctuation, where the tokenizer parts the two anyway.

    Its pattern ends a run of letters or digits at punctuation, and nothing composes
    across that place. The last character counts as the tokenizer sees it, in lower case:
    some letters become a letter and a combining mark there, which joins punctuation.
    """
    core = word.rstrip(CLOSING)
    if core == word or not core or not core.decode()[-1].lower()[-1].isalnum():
        return word
    return core


def encode(buf: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
    """Ids of each text, word by word.

    The tokenizer lowers case, drops white space and never joins across it, so a text's
    ids are its words' ids; words repeat, and each is encoded once for as long as it's
    remembered. (A text with a mark of special tokens keeps its case, which they need.)
    """
    low = B.LOWER[buf]
    mark = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
    for i in np.unique(np.searchsorted(offsets, mark, "right") - 1):
        low[offsets[i] : offsets[i + 1]] = buf[offsets[i] : offsets[i + 1]]
    starts, ends, first = B.words(low, offsets)
    n, ids = _words_of(path).of(low, starts, ends)
    bounds = np.concatenate(([0], np.cumsum(n)))[first]
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids, cut at the capacity."""
    end = np.array([END], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", owner="packing"):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, found in enumerate(encode(buf, offsets, tokenizer)):
                    found = np.append(found, end)
                    for k, a in enumerate(range(0, len(found), capacity)):
                        part = found[a : a + capacity]
                        row.append(lo + i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        ids.append(part if with_ids else None)
                columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece its place: id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Null and empty texts are one piece of the end id alone. Rows that repeat an id give
    pieces of their own, as do rows with a null id. An empty table gives an empty
    table. Other columns are not read.
    """
    cut = staged(pieces(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = max(64, -(-max(counts.values(), default=0) // PER_BUCKET))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    by_bucket = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    numbered = dealt.withColumn("inner", F.row_number().over(inside) - 1).join(base, ["length", "bucket"]).withColumn("ordinal", F.col("base") + F.col("inner"))
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    lengths, at = np.unique(runs[:, 0], return_index=True)
    bounds = np.append(at, len(runs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ordinal = (batch.column(c).to_numpy() for c in ("length", "ordinal"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                k = np.searchsorted(lengths, x)
                own, mine = runs[bounds[k] : bounds[k + 1]], np.flatnonzero(length == x)
                r = own[np.searchsorted(own[:, 1], ordinal[mine], "right") - 1]
                sequence[mine] = r[:, 3] + ordinal[mine] - r[:, 1]
                offset[mine] = r[:, 4]
            names = batch.schema.names[:-1]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return numbered.select(*names, "ordinal").mapInArrow(place, schema).withColumnRenamed("id", id_col)
