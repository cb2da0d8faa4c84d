"""Interpolated modified Kneser-Ney language model (bigrams), counted in Spark.

Tokens are words with A-Z lower-cased, then one end; a text's first token follows a
start that is never predicted. Counting sends compact sorted blocks, not rows: a task
counts its words (or pairs), and emits a sorted array of keys and one of counts for
each part of the hash space; a part's blocks merge in one task of bounded size, as the
number of parts follows the input's bytes. Parts are stored as sorted hash arrays in
the shared folder. Word ids are ranks in the sorted word hashes; pairs are two ids in
64 bits, or in 128 where there are more words than ``NARROW``, dealt over parts by a hash
of the pair, so that no frequent word has a part of its own, and their statistics by
context and by word are summed in a second exchange. Nothing caps words, pairs or parts;
the parts' bounds are an array in the shared folder like the rest.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + gamma(v) p1(w)
    p1(w)    = (max(n(w) - D1(n(w)), 0) + lambda / (V + 1)) / n

with n(w) the contexts of w and the last 1 of V + 1 standing for all unknown words.
Workers map the arrays, a file a part, and look words and pairs up by binary search: those
of many texts at once, sorted by part, so that each part is opened once for all of them,
and once for a worker as long as ``OPEN`` files hold them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _bytes as B
from tallyforge.llm import _store
from tallyforge.llm._session import new_path, staged

U = np.uint64
START, END, WORDS = 0, 1, 2
#: Bytes of text for each part, and for each one beyond ``SMALL_PARTS`` of them (as a
#: power of two): the driver hears of each part once.
PART_BYTES, LARGE_PART_BYTES, SMALL_PARTS = 32 << 20, 256 << 20, 13
FLUSH = 1 << 20
#: Tokens that are looked up at a time, and files that a worker keeps open.
TOGETHER, OPEN = 3 << 19, 16384
#: Ids below this are packed two to a 64-bit key.
NARROW = 1 << 32
#: Bytes that a worker keeps of arrays that it couldn't map in place.
FETCHED = 1 << 30
_cache: dict[str, dict[str, np.ndarray]] = {}
_fetched = 0
B.cached_by("model", _cache.clear)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 10, is 0; a null id counts as empty text, so it is."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _arrays(path: str) -> dict[str, np.ndarray]:
    global _fetched
    if path not in _cache:
        if len(_cache) >= OPEN or _fetched > FETCHED:
            _cache.clear()
            _fetched = 0
        _cache[path] = _store.mapped_all(path)
        _fetched += 0 if _store.in_place(path) else sum(a.nbytes for a in _cache[path].values())
    return _cache[path]


def part_bits(size: int) -> int:
    """Bits of the hash that name a part, for so many bytes of text."""
    return max(3, min(SMALL_PARTS, (size // PART_BYTES).bit_length()), (size // LARGE_PART_BYTES).bit_length())


WIDE = "S16"


def packed(v: np.ndarray, w: np.ndarray, wide: bool) -> np.ndarray:
    """Keys of pairs of ids, that sort by v and then w."""
    if not wide:
        return v.astype(U) << U(32) | w.astype(U)
    both = np.empty((len(v), 2), ">u8")
    both[:, 0], both[:, 1] = v, w
    return both.reshape(-1).view(WIDE)


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if keys.dtype == U:
        return keys >> U(32), keys & U(0xFFFFFFFF)
    both = np.ascontiguousarray(keys).view(">u8").reshape(-1, 2).astype(U)
    return both[:, 0], both[:, 1]


def dealt(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of each key."""
    if keys.dtype == U:
        return (B.mix(keys) >> U(64 - bits)).astype(np.int64)
    v, w = unpacked(keys)
    return (B.mix(B.mix(v) ^ (w + U(1))) >> U(64 - bits)).astype(np.int64)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return k[at], np.add.reduceat(c.astype(np.int64), at) if len(at) else c


class _Blocks:
    """Counts of a task, and their blocks by part."""

    def __init__(self, bits: int, spread: bool) -> None:
        self.bits, self.spread, self.keys, self.counts, self.held = bits, spread, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        return self.held > FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        k, c = merge(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        part = dealt(k, self.bits) if self.spread else (k >> U(64 - self.bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        k, c, part = k[order], c[order], part[order]
        lead = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, b in zip(lead, np.append(lead[1:], len(part))):
            own = c[a:b]
            small = own.astype(np.uint8) if own.max() < 256 else own.astype(np.int64)
            yield pa.record_batch([pa.array([int(part[a])], pa.int64()), pa.array([k[a:b].tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary())], ["part", "keys", "counts"])


def _read_block(keys: bytes, counts: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, WIDE if wide else U)
    return k, np.frombuffer(counts, np.uint8 if len(counts) == len(k) else np.int64)


def _merged(table: pa.Table, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    got = [_read_block(k.as_py(), c.as_py(), wide) for k, c in zip(table.column("keys"), table.column("counts"))]
    return merge([k for k, _ in got], [c for _, c in got])


def _by_part(blocks: DataFrame, parts: int, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over all rows of each part (the first column, from 0): a partition a part,
    so that no two parts meet in a task by the chance of a hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from run(pa.Table.from_batches(held)).to_batches()

    name = blocks.columns[0]
    return blocks.repartitionById(parts, F.col(name).cast("int")).mapInArrow(each, schema)


BLOCK = "part long, keys binary, counts binary"


def _word_blocks(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(bits, spread=False)
        for batch in batches:
            for _, _, buf, offsets in B.text_chunks(batch, "text", owner="model"):
                low = B.LOWER[buf]
                starts, ends, _ = B.words(low, offsets)
                if len(starts) and blocks.add(*np.unique(B.word_hashes(low, starts, ends), return_counts=True)):
                    yield from blocks.flush()
        yield from blocks.flush()

    return texts.mapInArrow(run, BLOCK)


class Vocabulary:
    """Word hashes to ids, over parts by the leading bits of the hash."""

    def __init__(self, path: str, bits: int, wide: bool) -> None:
        self.path, self.bits, self.wide = path, bits, wide

    @property
    def bases(self) -> np.ndarray:
        """The first id of each part, and the number of all ids."""
        return _arrays(f"{self.path}/bases")["bases"]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes; -1 for words that aren't in the vocabulary."""
        out = np.full(len(hashes), -1, np.int64)
        part = (hashes >> U(64 - self.bits)).astype(np.int64)
        bases = self.bases
        for p in np.unique(part):
            if bases[p + 1] == bases[p]:
                continue
            a, b = np.searchsorted(part, p), np.searchsorted(part, p, "right")
            known = _arrays(f"{self.path}/words-{p}")["words"]
            at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
            out[a:b] = np.where(known[at] == hashes[a:b], at + bases[p], -1)
        return out

    def look_up(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often known words (their ids, rising) were seen, their contexts, and gamma."""
        seen, contexts, gamma = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids))
        bases = self.bases
        part = np.searchsorted(bases, ids, "right") - 1
        lead = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(ids) else []
        for a, b in zip(lead, np.append(lead[1:], len(ids)) if len(ids) else []):
            held, at = _arrays(f"{self.path}/stats-{part[a]}"), ids[a:b] - bases[part[a]]
            seen[a:b], contexts[a:b], gamma[a:b] = held["seen"][at], held["contexts"][at], held["gamma"][at]
        return seen, contexts, gamma


class Stream:
    """The words of many rows: hashes, and each row's first word."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, buf: np.ndarray, offsets: np.ndarray) -> Stream:
        low = B.LOWER[buf]
        starts, ends, first = B.words(low, offsets)
        self.hashes.append(B.word_hashes(low, starts, ends))
        self.sizes.append(np.diff(first))
        self.tokens += len(starts) + len(offsets) - 1
        return self

    def of(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unique words' ids; each token's index into them (-1: end), its context's (-1: start); rows' bounds."""
        size = np.concatenate(self.sizes)
        rows = len(size)
        unique, index = np.unique(np.concatenate(self.hashes), return_inverse=True)
        bounds = np.concatenate(([0], np.cumsum(size))) + np.arange(rows + 1)
        token = np.full(bounds[-1], -1, np.int64)
        ahead = np.full(bounds[-1], -1, np.int64)
        place = np.arange(len(index)) + np.repeat(np.arange(rows), size)
        token[place] = index
        ahead[place + 1] = index
        return vocabulary.ids(unique), token, ahead, bounds


def _pair_blocks(texts: DataFrame, vocabulary: Vocabulary, bits: int) -> DataFrame:
    def counted(stream: Stream) -> tuple[np.ndarray, np.ndarray]:
        ids, token, ahead, _ = stream.of(vocabulary)
        w = np.where(token < 0, END, np.append(ids, 0)[token])
        v = np.where(ahead < 0, START, np.append(ids, 0)[ahead])
        return np.unique(packed(v, w, vocabulary.wide), return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, stream = _Blocks(bits, spread=True), Stream()
        for batch in batches:
            for _, _, buf, offsets in B.text_chunks(batch, "text", owner="model"):
                if stream.add(buf, offsets).tokens >= TOGETHER:
                    full = blocks.add(*counted(stream))
                    stream = Stream()
                    if full:
                        yield from blocks.flush()
        if stream.tokens:
            blocks.add(*counted(stream))
        yield from blocks.flush()

    return texts.mapInArrow(run, BLOCK)


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of types seen 1, 2, 3 and 4 times."""
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


class Model:
    """Where a trained model's arrays are, and its few numbers."""

    def __init__(self, path: str, vocabulary: Vocabulary, pair_bits: int, n: dict) -> None:
        self.path, self.vocabulary, self.pair_bits, self.n = path, vocabulary, pair_bits, n

    def lower(self, contexts: np.ndarray) -> np.ndarray:
        """p1 of words with so many contexts."""
        n, d = self.n, np.array([0.0, *self.n["d1"]])
        spare = sum(x * m for x, m in zip(n["d1"], n["m"]))
        return (contexts - d[np.minimum(contexts, 3)] + spare / (n["V"] + 1)) / n["pairs"]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        unique, back = np.unique(keys, return_inverse=True)
        part = dealt(unique, self.pair_bits)
        order = np.argsort(part, kind="stable")
        found, part, k = np.zeros(len(unique), np.int64), part[order], unique[order]
        there = _arrays(f"{self.path}/pair-parts")["there"]
        lead = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(k) else []
        for a, b in zip(lead, np.append(lead[1:], len(k)) if len(k) else []):
            if not there[part[a]]:
                continue
            held = _arrays(f"{self.path}/pairs-{part[a]}")
            known = held["pairs"]
            at = np.minimum(np.searchsorted(known, k[a:b]), len(known) - 1)
            found[order[a:b]] = np.where(known[at] == k[a:b], held["counts"][at], 0)
        return found[back]

    def score(self, stream: Stream) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, base score, score."""
        n = self.n
        ids, token, ahead, bounds = stream.of(self.vocabulary)
        known = np.flatnonzero(ids >= 0)
        count, contexts, gamma = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64), np.ones(len(ids) + 1)
        count[known], contexts[known], gamma[known] = self.vocabulary.look_up(ids[known])
        follow = count.copy()  # every word is followed by one token each time
        count[-1], contexts[-1] = n["texts"], n["end_contexts"]
        p = self.lower(contexts)[token]
        follow[-1], gamma[-1] = n["texts"], n["start_gamma"]
        some = np.append(ids, 0)
        v, w = np.where(ahead < 0, START, some[ahead]), np.where(token < 0, END, some[token])
        both = np.flatnonzero((v >= 0) & (w >= 0))
        c = np.zeros(len(p), np.int64)
        c[both] = self.pair_counts(packed(v[both], w[both], self.vocabulary.wide))
        d = np.array([0.0, *n["d2"]])
        p = gamma[ahead] * p + (c - d[np.minimum(c, 3)]) / np.maximum(follow[ahead], 1)
        base = np.log10((count + 0.1) / (n["N"] + 0.1 * (n["V"] + 1)))[token]
        at = bounds[:-1]
        return np.diff(bounds), np.add.reduceat((count > 0)[token].astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


def _save_from_driver(spark: SparkSession, path: str, name: str, array: np.ndarray) -> None:
    """Store an array by a task, as only executors are sure to reach the folder by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("data"):
                _store.save_all(path, {name: np.frombuffer(block.as_buffer(), array.dtype)})
            yield pa.record_batch([pa.array([1], pa.int64())], ["done"])

    spark.createDataFrame([(bytearray(array.tobytes()),)], "data binary").mapInArrow(run, "done long").collect()


def train(texts: DataFrame) -> Model:
    """Count the column ``text`` (null: empty) of every row and store the model."""
    spark = texts.sparkSession
    path = new_path(spark, "language-model")
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = part_bits(size)

    def store_words(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        k, c = _merged(table)
        _store.save_all(f"{path}/words-{part}", {"words": k, "seen": c.astype(np.uint32 if c.max() < 2**32 else np.int64)})
        return pa.table({"part": [part], "n": [len(k)], "total": [int(c.sum())]})

    stored = staged(_by_part(_word_blocks(texts, bits), 1 << bits, store_words, "part long, n long, total long"), "word-parts")
    sizes = {r["part"]: r for r in stored.collect()}  # a row a part
    bases = np.zeros((1 << bits) + 1, np.int64)
    bases[0] = WORDS
    for p, r in sizes.items():
        bases[p + 1] = r["n"]
    bases = np.cumsum(bases)
    _save_from_driver(spark, f"{path}/bases", "bases", bases)
    wide = bool(bases[-1] >= NARROW)
    vocabulary = Vocabulary(path, bits, wide)

    def store_pairs(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        k, c = _merged(table, wide)
        starts = np.append(0, vocabulary.bases)  # ids 0 and 1 are a part of their own, before all words
        _store.save_all(f"{path}/pairs-{part}", {"pairs": k, "counts": c.astype(np.uint16 if c.max() < 2**16 else np.uint32 if c.max() < 2**32 else np.int64)})
        out = [(-1, part, np.array(_of_counts(c), np.int64).tobytes(), b"")]
        # sums by context: types seen once, twice, more often; by word: contexts
        classes = np.minimum(c, 3)
        v, w = unpacked(k)
        kept = np.uint64 if wide else np.uint32
        for kind, (ids, n) in enumerate([*(np.unique(v[classes == x], return_counts=True) for x in (1, 2, 3)), np.unique(w, return_counts=True)]):
            to = np.searchsorted(starts, ids.astype(np.int64), "right") - 1
            lead = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(ids) else []
            for a, b in zip(lead, np.append(lead[1:], len(ids)) if len(ids) else []):
                out.append((int(to[a]), kind, ids[a:b].astype(kept).tobytes(), n[a:b].astype(np.uint32).tobytes()))
        cols = list(zip(*out))
        return pa.table({"to": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int64()), "ids": pa.array(cols[2], pa.binary()), "n": pa.array(cols[3], pa.binary())})

    pairs = _pair_blocks(texts, vocabulary, bits)
    sums = staged(_by_part(pairs, 1 << bits, store_pairs, "to long, kind long, ids binary, n binary"), "pair-sums")
    told = sums.where("to = -1").collect()  # a row a part
    there = np.zeros(1 << bits, bool)
    there[[r["kind"] for r in told]] = True
    _save_from_driver(spark, f"{path}/pair-parts", "there", there)
    n2 = np.sum([np.frombuffer(r["ids"], np.int64) for r in told], axis=0).tolist() if told else [0] * 4
    d2 = discounts(n2)
    special = {"rows": rows, "d2": d2}

    def store_sums(table: pa.Table) -> pa.Table:
        to = table.column("to")[0].as_py()
        starts = np.append(0, vocabulary.bases)
        base, size = int(starts[to]), int(starts[to + 1] - starts[to])
        n = np.zeros((4, size), np.int64)
        for kind, ids, many in zip(table.column("kind").to_pylist(), table.column("ids"), table.column("n")):
            n[kind, np.frombuffer(ids.as_py(), np.uint64 if wide else np.uint32).astype(np.int64) - base] += np.frombuffer(many.as_py(), np.uint32)
        left = special["d2"][0] * n[0] + special["d2"][1] * n[1] + special["d2"][2] * n[2]
        end, gamma = 0, 0.0
        if to == 0:
            end, gamma = int(n[3][END]), float(left[START] / max(special["rows"], 1))
            contexts = n[3][[END]]
        else:
            contexts = n[3]
            seen = _store.mapped_all(f"{path}/words-{to - 1}")["seen"]
            _store.save_all(f"{path}/stats-{to - 1}", {"seen": np.array(seen), "contexts": contexts.astype(np.uint32), "gamma": (left / seen).astype(np.float32)})
        return pa.table({"c": [_of_counts(contexts)], "more": [int((contexts > 2).sum())], "pairs": [int(contexts.sum())], "end": [end], "gamma": [gamma]})

    last = staged(_by_part(sums.where("to >= 0"), (1 << bits) + 1, store_sums, "c array<long>, more long, pairs long, end long, gamma double"), "word-sums").collect()
    c = np.sum([r["c"] for r in last], axis=0).tolist() if last else [0] * 4
    more = sum(r["more"] for r in last)
    n = {
        "texts": rows,
        "N": rows + sum(r["total"] for r in sizes.values()),
        "V": int(bases[-1]) - WORDS + (rows > 0),
        "d1": discounts(c),
        "d2": d2,
        "m": [c[0], c[1], more],
        "pairs": max(1, sum(r["pairs"] for r in last)),
        "end_contexts": sum(r["end"] for r in last),
        "start_gamma": max((r["gamma"] for r in last), default=0.0) or 1.0,
    }
    if not rows:
        n |= {"m": [1, 0, 0], "d1": [1.0, 1.0, 1.0]}  # all mass is the uniform share
    return Model(path, vocabulary, bits, n)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows that aren't held out. Null texts are empty, which is
    one token, the end. Repeated rows count as often as they stand. With no row to learn
    from, every token has the one probability that is left. An empty table gives an
    empty table. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(id_col).alias("held_out"))
    model = train(rows.where(~F.col("held_out")).select("text"))
    kind = dict(rows.dtypes)["id"]

    def told(stream: Stream, held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
        tokens, known, base, own = model.score(stream)
        out = [pa.concat_arrays([h[k] for h in held]) for k in (0, 1)]
        out += [pa.array(x) for x in (tokens, known, np.full(len(tokens), model.n["N"], np.int64), base, own)]
        return pa.record_batch(out, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held = Stream(), []
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", owner="model"):
                held.append((batch.column("id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo)))
                if stream.add(buf, offsets).tokens >= TOGETHER:
                    yield told(stream, held)
                    stream, held = Stream(), []
        if held:
            yield told(stream, held)

    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
