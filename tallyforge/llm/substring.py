"""Substring dedup by relative Lempel-Ziv parsing over indexed reference blocks.

Every document is cut into content-defined reference blocks: each window of ``window``
words selects its smallest gram hash (leftmost of equals; a gram has ``GRAM`` words, or
the whole window if that is shorter), and neighbouring windows that select the same
position are one block. Equal windows select equal anchors wherever they stand, so a
repeat is met again under its anchor.

* Index: (anchor hash, block hash) with its number of occurrences, the first and the last.
* Seeds: a block whose anchor has more than one occurrence may lie in a factor. If the
  block itself occurs again, a factor goes through it. If not, the factor, if there is
  one, starts or ends inside it, and there the block's windows are checked one by one
  against all windows under the same anchor.
* Factors: each document is then parsed greedily from left to right (``greedy``): a
  factor starts at the first window that is met again, and goes on as long as the next
  window stands next in the same reference too, in that of the references at hand that
  does so longest; where that stops, the next factor starts. References of a block are its
  first and its last occurrence, never its own place (a row that repeats another wholly
  has that one); so a passage of two places has its true longest factors, and one of more
  the longest among these two. A factor is at least one window long, and the factors'
  words are what is duplicate; nothing else decides what goes.

Index, seeds and boundaries meet by hash joins with partial aggregation; nothing is
gathered but one document's spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import _bytes as B
from tallyforge.llm._session import forget, free_names, staged

GRAM = 10
#: A block's first window and its number of windows share one long.
PACK = 1 << 12
WIDEST = PACK - 1
#: Bytes of text taken at a time where windows or words become rows.
CHUNK = 1 << 20
#: What tells rows apart, where equal rows share it.
KEY = ("rk", "rh")


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest of values[i:i + width], for each i that has them."""
    at = np.arange(len(values))
    best, span = values, 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        best = np.where(take, right, left)
        span += step
    return at


def _blocks(buf: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """row, first window, windows, anchor hash, block hash of each block."""
    none = np.zeros(0, np.int64)
    starts, ends, first = B.words(buf, offsets)
    begin, at = B.gram_rows(first, window)
    if not len(begin):
        return none, none, none, none, none
    hashes = B.word_hashes(buf, starts, ends)
    gram = min(GRAM, window)
    grams = np.arange(len(hashes) - gram + 1)
    anchor = B.spans_hash(hashes, grams, grams + gram, "a")
    chosen = _leftmost_minimum(anchor, window - gram + 1)[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (begin[1:] != begin[:-1] + 1)
    new[at[:-1][np.diff(at) > 0]] = True
    lead = np.flatnonzero(new)
    many = np.diff(np.append(lead, len(begin)))
    row = np.searchsorted(at, lead, "right") - 1
    s = begin[lead]
    block = B.spans_hash(B.mix(hashes + np.uint64(1)), s, s + many - 1 + window, "b")
    return row, s - first[row], many, anchor[chosen[lead]].view(np.int64), block.view(np.int64)


def _index(keyed: DataFrame, window: int) -> DataFrame:
    """(rk, rh, sn, h, b): every block of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(k).to_numpy(zero_copy_only=False) for k in KEY]
            for lo, hi, buf, offsets in B.text_chunks(batch, "text"):
                row, s, n, h, b = _blocks(buf, offsets, window)
                if len(row):
                    yield pa.record_batch([pa.array(x) for x in (*(k[lo:hi][row] for k in key), s * PACK + n, h, b)], [*KEY, "sn", "h", "b"])

    return keyed.select(*KEY, "text").mapInArrow(run, "rk long, rh int, sn long, h long, b long")


def _boundary_windows(joined: DataFrame, window: int) -> DataFrame:
    """The windows of the wanted blocks of each row: (h, fp, rk, rh, s, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(k).to_numpy(zero_copy_only=False) for k in KEY]
            wanted = batch.column("wanted")
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", CHUNK):
                own = wanted.slice(lo, hi - lo)
                count = own.value_lengths().to_numpy(zero_copy_only=False)
                sn, h, w = (x.to_numpy(zero_copy_only=False) for x in own.flatten().flatten())
                row = np.repeat(np.arange(hi - lo), count)
                starts, ends, first = B.words(buf, offsets)
                hashes = B.mix(B.word_hashes(buf, starts, ends) + np.uint64(1))
                n = sn % PACK
                each = np.repeat(np.arange(len(sn)), n)
                s = (sn // PACK)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = first[row][each] + s
                fp = B.spans_hash(hashes, at, at + window, "b").view(np.int64)
                yield pa.record_batch([pa.array(x) for x in (h[each], fp, *(k[lo:hi][row][each] for k in key), s, w[each])], ["h", "fp", *KEY, "s", "w"])

    return joined.mapInArrow(run, "h long, fp long, rk long, rh int, s long, w long")


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _key(id_: Column, text: Column) -> list[Column]:
    """The id and a hash of the text; two hashes of the text where there is no id."""
    return [F.coalesce(id_.cast("long"), F.xxhash64(text)).alias("rk"), F.hash(text).alias("rh")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows under a key that equal rows share: (rk, rh, id, text)."""
    text = _text(F.col(text_col))
    return docs.select(*_key(F.col(id_col), text), F.col(id_col).cast("long").alias("id"), text.alias("text"))


def _checked(window: int) -> int:
    if not 1 <= window <= WIDEST:
        raise ValueError(f"a window has 1 to {WIDEST} words, not {window}")
    return window


def _others(place: str, s: str, n: str, ref_s: str) -> Column:
    """Spans of a block or window with the first and the last occurrence that isn't itself."""
    own = f"struct({', '.join(KEY)}, {place})"
    return F.expr(f"transform(IF(rep = last, array(rep), filter(array(rep, last), x -> x <> {own})), x -> named_struct('s', {s}, 'n', {n}, 'ref', x.rk, 'ref_s', {ref_s}))")


def repeated_spans(keyed: DataFrame, window: int) -> DataFrame:
    """(rk, rh, spans): first window, windows and reference of each block or window that
    is met again."""
    blocks = _index(keyed, window)  # made where it is read: as a table it would take over half the input's bytes
    anchors = blocks.groupBy("h").agg(F.count("*").alias("total"), F.min("b").alias("lo"), F.max("b").alias("hi")).where("total > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed"))
    anchors = staged(anchors, "anchors")  # a table, so that the join can split a hot anchor's blocks
    # blocks under an anchor that is met again; each meets its one anchor or none, and the
    # join stays an outer one, as no test that the optimiser can fold comes after it
    met = blocks.join(anchors, "h", "left").where(F.col("mixed").isNotNull() | (F.rand() < 0))
    met = staged(met.select(*KEY, "sn", "h", "b", "mixed"), "met-blocks")
    place = F.struct(*KEY, "sn")
    index = staged(met.groupBy("h", "b").agg(F.count("*").alias("n"), F.min(place).alias("rep"), F.max(place).alias("last"), F.bool_or("mixed").alias("mixed")), "reference-blocks")
    known = index.where("n > 1").select("h", "b", F.col("n").alias("seen"), "rep", "last")
    refs = _others("sn", f"sn div {PACK}", f"sn % {PACK}", f"x.sn div {PACK}")
    whole = met.join(known, ["h", "b"], "left").groupBy(*KEY).agg(F.flatten(F.collect_set(F.when(F.col("seen") > 1, refs))).alias("spans"))  # of rows that repeat another wholly, once
    seed = F.struct(F.col("rep.sn").alias("sn"), "h", F.col("n").alias("w"))
    wanted = index.where("mixed").select(*(F.col(f"rep.{k}") for k in KEY), seed.alias("x")).groupBy(*KEY).agg(F.collect_list("x").alias("wanted"))
    windows = _boundary_windows(keyed.select(*KEY, "text").join(wanted, list(KEY)), window)
    place = F.struct(*KEY, "s")
    again = windows.groupBy("h", "fp").agg(F.sum("w").alias("t"), F.min(place).alias("rep"), F.max(place).alias("last")).where("t > 1").select("h", "fp", "rep", "last")
    edges = windows.where("w = 1").join(again, ["h", "fp"]).groupBy(*KEY).agg(F.flatten(F.collect_set(_others("s", "s", "1L", "x.s"))).alias("spans"))
    every = whole.where(F.size("spans") > 0).unionByName(edges)
    spans = staged(every.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    for done in (anchors, met, index):
        forget(done)
    return spans


def parse(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, n_factors, kept (words joined by one space), text,
    factors.

    ``text`` keeps the original spacing inside what is left (a line break where
    something went; the whole text where nothing did). ``factors`` lists start word,
    words, and the reference's id (a hash where it has none) and start word. Null texts
    have no words. Rows that repeat another row wholly repeat all its windows, so they
    lose all of them. Rows with a null id are parsed like any other. An empty table gives
    an empty table. Other columns are not read. Windows of 1 to ``WIDEST`` words are
    parsed; others are refused.
    """
    _checked(window)
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", CHUNK):
                yield _cut(batch.column("id").slice(lo, hi - lo), batch.column("spans").slice(lo, hi - lo), buf, offsets, window)

    schema = f"`{id_col}` long, n_words long, n_removed long, n_factors long, kept string, text string, factors array<struct<start:long,words:long,ref:long,ref_start:long>>"
    return keyed.join(spans, list(KEY), "left").select("id", "text", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated stretches cut out of the texts, all columns kept.

    Rows that lose nothing keep their text as it is, a null one too; rows that lose
    every word go. The number of characters, where there is such a column, follows the
    text. Rows that repeat another wholly lose all their windows, and so do both. Null
    ids, extra columns of any name and type, and empty tables are taken as they are.
    """
    _checked(window)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias(free_names(docs.columns, "none")[0]))  # never without a field
    text = _text(F.col(text_col))
    whole = docs.select(*_key(F.col(id_col), text), F.col(id_col).cast("long").alias("id"), text.alias("text"), rest.alias("rest"), F.col(text_col).isNull().alias("blank"))
    spans = repeated_spans(whole, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", CHUNK):
                cut = _cut(batch.column("id").slice(lo, hi - lo), batch.column("spans").slice(lo, hi - lo), buf, offsets, window)
                n, lost = cut.column(1), cut.column(2)
                stay = pa.compute.or_(pa.compute.equal(lost, 0), pa.compute.less(lost, n))
                yield pa.record_batch([batch.column("rest").slice(lo, hi - lo), cut.column(5), lost, batch.column("blank").slice(lo, hi - lo)], ["rest", "text", "lost", "blank"]).filter(stay)

    kind = whole.schema["rest"].dataType
    schema = T.StructType([T.StructField("rest", kind), T.StructField("text", T.StringType()), T.StructField("lost", T.LongType()), T.StructField("blank", T.BooleanType())])
    out = whole.join(spans, list(KEY), "left").select("id", "text", "spans", "rest", "blank").mapInArrow(run, schema)
    named = {c: F.col("rest")[c] for c in docs.columns if c != text_col} | {text_col: F.when(~F.col("blank"), F.col("text"))}
    if chars_col in docs.columns:
        was = docs.schema[chars_col].dataType
        named[chars_col] = F.when(F.col("lost") > 0, F.length("text").cast(was)).otherwise(named[chars_col])
    return out.select(*[named[c].alias(c) for c in docs.columns])


def greedy(row: np.ndarray, s: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The greedy parse of rows into factors: row, first window, windows, reference and its
    window, by row and start.

    Spans say that ``n`` windows from ``s`` on stand in ``ref`` from ``ref_s`` on. Spans of
    one reference at one distance that touch are one stretch; from each first window that
    no factor holds yet, the stretch that reaches farthest is the next factor.
    """
    if not len(row):
        return (row,) * 5
    order = np.lexsort((s, ref_s - s, ref, row))
    row, s, n, ref, ref_s = (x[order] for x in (row, s, n, ref, ref_s))
    new = np.ones(len(row), bool)
    same = (row[1:] == row[:-1]) & (ref[1:] == ref[:-1]) & (ref_s[1:] - s[1:] == ref_s[:-1] - s[:-1])
    new[1:] = ~(same & (s[1:] <= s[:-1] + n[:-1]))
    lead = np.flatnonzero(new)
    end = np.maximum.reduceat(s + n, lead)
    row, s, ref, ref_s = row[lead], s[lead], ref[lead], ref_s[lead]
    order = np.lexsort((-end, s, row))
    row, s, end, ref, ref_s = (x[order] for x in (row, s, end, ref, ref_s))
    bounds = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)).tolist()
    starts, ends = s.tolist(), end.tolist()
    out: list[tuple[int, int, int]] = []  # stretch, start, end
    for lo, hi in zip(bounds, bounds[1:]):
        at, i, best, reach = starts[lo], lo, lo, -1
        while True:
            while i < hi and starts[i] <= at:
                if ends[i] > reach:
                    best, reach = i, ends[i]
                i += 1
            if reach > at:
                out.append((best, at, reach))
                at = reach
            elif i < hi:
                at = starts[i]
            else:
                break
    chosen, at, reach = (np.array(c, np.int64) for c in zip(*out))
    return row[chosen], at, reach - at, ref[chosen], ref_s[chosen] + at - s[chosen]


def _cut(ids: pa.Array, spans: pa.Array, buf: np.ndarray, offsets: np.ndarray, window: int) -> pa.RecordBatch:
    rows = len(ids)
    starts, ends, first = B.words(buf, offsets)
    count = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    s, n, ref, ref_s = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
    row = np.repeat(np.arange(rows), count)
    row, begin, windows, ref, ref_s = greedy(row, s, n, ref, ref_s)
    size = windows - 1 + window  # words of each factor
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first[row] + begin, 1)
    np.add.at(change, first[row] + begin + size, -1)
    gone = np.cumsum(change)[:-1] > 0
    factors = np.bincount(row, minlength=rows)
    data = buf.tobytes()
    kept, text, removed = [], [], []
    for i in range(rows):
        a, b = int(first[i]), int(first[i + 1])
        own = data[offsets[i] : offsets[i + 1]]
        lost = int(gone[a:b].sum())
        removed.append(lost)
        if not lost:
            kept.append(b" ".join(own.split()))
            text.append(own)
            continue
        stay = ~gone[a:b]
        kept.append(b" ".join(compress(own.split(), stay.tolist())))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], stay.view(np.int8), [0]))))
        text.append(b"\n".join(data[starts[a + x] : ends[a + y - 1]] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())))
    listed = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(factors))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (begin, size, ref, ref_s)], ["start", "words", "ref", "ref_start"]),
    )
    return pa.record_batch(
        [ids, pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(factors.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(text, pa.binary()).cast(pa.string()), listed],
        [f"c{i}" for i in range(7)],
    )


def sha256_of(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def brute_force(texts: dict[int, str | None], window: int = 35) -> dict[int, tuple[int, int, str]]:
    """Every window against every other, for tests: id -> n_words, n_removed, kept_sha256."""
    seen: dict[tuple, int] = {}
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    for w in split.values():
        for j in range(len(w) - window + 1):
            seen[tuple(w[j : j + window])] = seen.get(tuple(w[j : j + window]), 0) + 1
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out
