"""Quality by co-training two classifiers: one sees a page's text, one its metadata.

Both start from a bounded sample of labelled rows, those with the smallest hashes of their
ids. In each round both score every unlabelled document, and each labels for the other
those that it is surest of: the ``PER_ROUND`` surest of each class among all, if sure
enough. The other learns from them in the next round. Both are calibrated on labelled
rows that none of them learns from, and a logistic combination of the calibrated views
scores every document. What is fitted is bounded by ``LABELLED + 4 * PER_ROUND * ROUNDS``
rows, in one task; its result, a few thousand weights, goes to all workers.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import _bytes as B
from tallyforge.llm._session import forget, free_names, staged

LABELLED = 6000
ROUNDS = 3
SURE = 0.97
PER_ROUND = 400
KEEP = 0.5
BITS = 11
#: Bytes of text viewed at a time; a view holds some forty bytes for each.
CHUNK = 1 << 19
META = 64 + 192 + 24
STEPS = 120
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[39, 44, 45, 46]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _PLAIN | B.SPACE)
STATISTICS = 11


def text_view(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each hashed word feature, and dense statistics per row."""
    rows = len(offsets) - 1
    starts, ends, first = B.words(buf, offsets)
    hashes = B.word_hashes(B.LOWER[buf], starts, ends)
    row = np.repeat(np.arange(rows), np.diff(first))
    n = np.maximum(np.diff(first), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[offsets[1:]] - total[offsets[:-1]]

    size = np.maximum(np.diff(offsets), 1)
    letters = share(_LETTER[buf])
    order = np.lexsort((hashes, row))
    same = np.zeros(len(order), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    marked = ~_LETTER[buf[ends - 1]] if len(ends) else np.zeros(0, bool)
    long = (ends - starts) > 24
    key, count = np.unique(row.astype(np.int64) << BITS | (hashes >> B.U(64 - BITS)).astype(np.int64), return_counts=True)
    at = key >> BITS
    top = np.zeros(rows)
    np.maximum.at(top, at, count)
    per = lambda flags: np.bincount(row, weights=flags, minlength=rows) / n
    dense = np.stack(
        [
            share(_UPPER[buf]) / np.maximum(letters, 1),
            share(_SYMBOL[buf]) / size,
            share(_DIGIT[buf]) / size,
            letters / size,
            per(again.astype(float)),
            np.bincount(row[order], weights=same, minlength=rows) / n,
            top / n,
            per(marked.astype(float)),
            per(long.astype(float)),
            np.log1p(np.diff(first)),
            np.bincount(row, weights=ends - starts, minlength=rows) / n / 10,
        ],
        axis=1,
    )
    value = np.sqrt(count / n[at])
    return at, key & ((1 << BITS) - 1), value, dense


def meta_view(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    """Three features of each row: language, source and length class."""

    def hashed(a: pa.Array, buckets: int, base: int) -> np.ndarray:
        d = pc.fill_null(a.cast(pa.string()), "\0").dictionary_encode()
        codes = np.array([zlib.crc32(x.encode()) % buckets for x in d.dictionary.to_pylist()], np.int64)
        return base + codes[d.indices.to_numpy()] if len(d) else np.zeros(0, np.int64)

    n = np.maximum(pc.fill_null(chars.cast(pa.float64()), 0.0).to_numpy(), 0)
    return np.stack([hashed(lang, 64, 0), hashed(source, 192, 64), 256 + np.minimum(np.log2(n + 1).astype(np.int64), 23)], axis=1)


class Logistic:
    """L2-regularised logistic regression by full-batch Adam."""

    def __init__(self, width: int) -> None:
        self.w, self.b = np.zeros(width), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, l2: float, steps: int = STEPS, rate: float = 0.1, weight: np.ndarray | None = None) -> Logistic:
        """Rows of weight 0 don't count; so subsets need no copies of ``x``."""
        share = np.full(len(y), 1 / len(y)) if weight is None else weight / weight.sum()
        m = np.zeros(len(self.w) + 1)
        v = np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            # in the features' own precision: a mixed product would copy them at each step
            miss = (sigmoid(x @ self.w.astype(x.dtype) + self.b) - y) * share
            g = np.append(miss.astype(x.dtype) @ x + l2 * self.w, miss.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - step[-1]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w.astype(x.dtype) + self.b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


VIEWS = ("text", "meta")


def train(x_text: np.ndarray, meta: np.ndarray, label: np.ndarray, fold: np.ndarray, told: dict[str, np.ndarray]) -> dict | None:
    """Both views, calibrated and combined.

    ``x_text`` has the hashed features and then the statistics, which are scaled in
    place. ``label`` is -1 where there is none; labelled rows of ``fold`` 0 calibrate, all
    others teach. ``told`` has for each view the labels that the other one gave, -1 for
    none. None without both classes to learn and to calibrate from.
    """
    rows = len(label)
    learn, check = (label >= 0) & (fold > 0), np.flatnonzero((label >= 0) & (fold == 0))
    if len(set(label[learn])) < 2 or len(set(label[check])) < 2:
        return None
    numbers = x_text[:, 1 << BITS :].astype(np.float64)
    centre, spread = numbers.mean(0), numbers.std(0) + 1e-6
    x_text[:, 1 << BITS :] = np.clip((numbers - centre) / spread, -8, 8)
    x_meta = np.zeros((rows, META), np.float32)
    x_meta[np.arange(rows)[:, None], meta] = 1
    out: dict = {"norm": (centre, spread)}
    z: list[np.ndarray] = []
    for v, x, l2 in (("text", x_text, 1e-5), ("meta", x_meta, 1e-3)):
        given = told[v] >= 0
        own = Logistic(x.shape[1]).fit(x, np.where(given, told[v], np.maximum(label, 0)).astype(float), l2, weight=(learn | given).astype(float))
        scale = platt(own.logit(x)[check], label[check])
        z.append(scale.logit(own.logit(x)[check][:, None]))
        out[v] = (own.w.astype(np.float32), float(own.b), float(scale.w[0]), float(scale.b))
    both = Logistic(2).fit(np.stack(z, axis=1), label[check].astype(float), 1e-3, 400)
    out["both"] = (both.w, both.b)
    return out


def platt(z: np.ndarray, y: np.ndarray) -> Logistic:
    # the usual targets, which keep a separable fold from infinite slopes
    good, bad = y.sum(), len(y) - y.sum()
    return Logistic(1).fit(z[:, None], np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2)), 0.0, 400)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, id_col: str = "doc_id", label_col: str = "quality") -> dict | None:
    """The co-trained model, from at most ``labelled`` labelled rows and all others.

    Several labels of one id count as their smallest; null labels and ids don't count.
    Rows that repeat an id count once, by the text with the smallest digest. None where
    either class is missing among the rows to learn or to calibrate from. ``told`` in the
    model says how many labels each view had from the other after each round.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.min(label_col).cast("int").alias("y"))
    rows = _columns(docs, id_col).where("id IS NOT NULL")
    one = rows.select(F.col("id").alias("k")).distinct()
    sample = one.join(known, "k").withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(labelled)
    given = [(r["k"], r["y"]) for r in sample.select("k", "y").collect()]  # at most `labelled` rows of two numbers
    told: list[tuple[int, str, int]] = []  # at most 4 * PER_ROUND a round
    heard = []
    seen = staged(views(rows), "views")
    for turn in range(rounds + 1):
        model = _fit_once(seen, given, told)
        if model is None or turn == rounds:
            break
        new = _surest(seen, known, model, told)
        if not new:
            break
        told += new
        heard.append({v: sum(t[1] == v for t in told) for v in VIEWS})
    forget(seen)
    return model and model | {"told": heard}


def views(rows: DataFrame) -> DataFrame:
    """(k, digest, bucket, value, dense, meta): the features of each row of ``_columns`` as
    arrays of numbers, whatever the length of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", CHUNK):
                at, bucket, value, dense = text_view(buf, offsets)
                own = batch.slice(lo, hi - lo)
                meta = meta_view(*(own.column(c) for c in ("lang", "source", "n_chars"))).astype(np.int16)
                bounds = np.searchsorted(at, np.arange(hi - lo + 1))
                bucket, value = bucket.astype(np.uint16), value.astype(np.float32)
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
                each = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.record_batch([own.column("id"), own.column("digest"), cut(bucket), cut(value), each(dense), each(meta)], ["k", "digest", "bucket", "value", "dense", "meta"])

    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return rows.withColumn("digest", digest).mapInArrow(run, "k long, digest binary, bucket binary, value binary, dense binary, meta binary")


def _features(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, bucket and value of each feature, dense statistics and metadata of a table of views."""
    whole = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    bucket = whole("bucket", np.uint16).astype(np.int64)
    size = np.array([len(x) // 2 for x in table.column("bucket").to_pylist()], np.int64)
    row = np.repeat(np.arange(table.num_rows), size)
    return row, bucket, whole("value", np.float32), whole("dense", np.float64).reshape(-1, STATISTICS), whole("meta", np.int16).reshape(-1, 3).astype(np.int64)


def _fit_once(seen: DataFrame, given: list[tuple[int, int]], told: list[tuple[int, str, int]]) -> dict | None:
    labels = {k: [y, -1, -1] for k, y in given}
    for k, v, y in told:
        labels.setdefault(k, [-1, -1, -1])[1 + VIEWS.index(v)] = y
    if not labels:
        return None
    chosen = seen.sparkSession.createDataFrame([(k, *x) for k, x in labels.items()], "k long, y int, y_text int, y_meta int")
    row = F.struct("bucket", "value", "dense", "meta", "y", "y_text", "y_meta")
    wanted = seen.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min_by(row, F.struct("digest", "meta")).alias("row"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("k", "ascending")])
        at, bucket, value, dense, meta = _features(table)
        x = np.zeros((table.num_rows, (1 << BITS) + STATISTICS), np.float32)
        x[at, bucket] = value
        x[:, 1 << BITS :] = dense
        label, y_text, y_meta, h = (table.column(c).to_numpy() for c in ("y", "y_text", "y_meta", "h"))
        del table, at, bucket, value
        return pa.table({"model": pa.array([pickle.dumps(train(x, meta, label, h % 5, {"text": y_text, "meta": y_meta}))], pa.binary())})

    flat = wanted.select("k", F.xxhash64("k").alias("h"), "row.*")
    got = flat.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def _surest(seen: DataFrame, known: DataFrame, model: dict, told: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(id, view that is told, label) of the unlabelled documents that the other view is
    surest of, among all; documents that a view was told of before aren't told again."""
    spark = seen.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p_text, p_meta = (np.round(sigmoid(z.astype(np.float64)), 7) for z in view_logits(model, *_features(batch)))
                yield pa.record_batch([batch.column("k"), pa.array(p_text), pa.array(p_meta)], ["k", "p_text", "p_meta"])

    sure = seen.mapInArrow(run, "k long, p_text double, p_meta double").where(f"greatest(p_text, 1 - p_text, p_meta, 1 - p_meta) >= {SURE}")
    before = spark.createDataFrame([(k, v) for k, v, _ in told], "k long, v string")
    each = staged(sure.join(known, "k", "left_anti").groupBy("k").agg(F.min("p_text").alias("p_text"), F.min("p_meta").alias("p_meta")), "surest")
    lists = []
    for v, other in (("text", "meta"), ("meta", "text")):
        had = F.broadcast(before.where(F.col("v") == other).select("k"))  # at most 2 * PER_ROUND a round
        left = each.join(had, "k", "left_anti").withColumn("h", F.xxhash64("k"))
        for y, p in ((1, F.col(f"p_{v}")), (0, 1 - F.col(f"p_{v}"))):
            lists.append(left.where(p >= SURE).orderBy(p.desc(), "h", "k").limit(PER_ROUND).select("k", F.lit(other).alias("v"), F.lit(y).alias("y")))
    new = [tuple(r) for r in reduce(DataFrame.union, lists).collect()]  # four lists of at most PER_ROUND
    forget(each)
    return new


def view_logits(model: dict, at: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The calibrated logits of both views of rows."""
    w, b, scale, shift = model["text"]
    centre, spread = model["norm"]
    z = np.bincount(at, weights=value * w[bucket], minlength=len(dense)) + np.clip((dense - centre) / spread, -8, 8) @ w[1 << BITS :] + b
    zt = z * scale + shift
    w, b, scale, shift = model["meta"]
    return zt, (w[meta].sum(1) + b) * scale + shift


def _columns(docs: DataFrame, id_col: str) -> DataFrame:
    def or_null(name: str, kind: str) -> Column:
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(F.col(id_col).cast("long").alias("id"), or_null("text", "string"), or_null("lang", "string"), or_null("source", "string"), or_null("n_chars", "double"))


def kept(docs: DataFrame, model: dict | None, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns as they are.

    Columns of any name may be there: scores get names that no column has.
    """
    names = free_names(docs.columns, "text_score", "meta_score", "score")
    return scored(docs, model, names).where(F.col(f"`{names[2]}`") >= least).select(*(f"`{c}`" for c in docs.columns))


def scored(docs: DataFrame, model: dict | None, added: Sequence[str] = ("text_score", "meta_score", "score")) -> DataFrame:
    """``docs`` with text_score, meta_score and score (probability of good quality).

    Null texts are empty; null or absent metadata are values of their own. Without a
    model every score is 1. Every row gets its scores, repeated ones the same. No rows
    give no rows. ``added`` names the scores; a column of ``docs`` by one of these names
    is an error.
    """
    columns = docs.columns
    if {c.lower() for c in columns} & {c.lower() for c in added}:
        raise ValueError(f"columns named like the scores {tuple(added)} are there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            blank = pa.nulls(n, pa.string())
            for lo, hi, buf, offsets in B.text_chunks(batch, text, CHUNK):
                parts = batch.slice(lo, hi - lo)
                if model is None:
                    p = [np.ones(hi - lo)] * 3
                else:
                    meta = meta_view(*(parts.column(columns.index(c)) if c in columns else blank.slice(lo, hi - lo) for c in ("lang", "source", "n_chars")))
                    zt, zm = view_logits(model, *text_view(buf, offsets), meta)
                    w, b = model["both"]
                    p = [sigmoid(zt), sigmoid(zm), sigmoid(zt * w[0] + zm * w[1] + b)]
                yield pa.record_batch([*parts.columns, *(pa.array(x, pa.float64()) for x in p)], schema.names)

    # numbered names on the way, as columns may have dots or other signs in theirs
    numbered = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    text = f"c{columns.index('text')}"
    schema = T.StructType([*numbered.schema.fields, *(T.StructField(f"p{k}", T.DoubleType()) for k in range(3))])
    return numbered.mapInArrow(run, schema).toDF(*columns, *added)
