import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import _bytes as B
from tallyforge.llm import quality


def _accuracy(spark, sf_dir, labelled):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, labelled=labelled)
    learned = {r.doc_id for r in labels.join(docs.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()}
    rows = quality.scored(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.doc_id not in learned]
    return model, held


def test_held_out_accuracy(spark):
    model, held = _accuracy(spark, "/root/testdata/sf0.1", 1000)
    good = [r for r in held if r.quality == 1]
    bad = [r for r in held if r.quality == 0]
    assert len(good) > 500 and len(bad) > 100
    assert sum(r.score >= quality.KEEP for r in good) / len(good) > 0.98
    assert sum(r.score < quality.KEEP for r in bad) / len(bad) > 0.95
    assert any(sum(t.values()) for t in model["told"])  # the views taught each other
    assert model["told"][-1] == {v: n for v, n in model["told"][-1].items() if n <= 2 * quality.PER_ROUND * quality.ROUNDS}


def test_edges_of_the_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one_class = labels.withColumn("quality", F.lit(1))
    assert quality.fit(docs, one_class) is None and quality.fit(docs.limit(0), labels) is None and quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.scored(docs, None).select("score").collect()} == {1.0}
    model = quality.fit(docs, labels.unionByName(labels).unionByName(labels.select(F.lit(None).cast("long").alias("doc_id"), "quality", "toxic")))
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "", "en", "s", 3, "y"), (2, "word " * 40_000, "en", "src0", 7, "z"), (2, "word " * 40_000, "en", "src0", 7, "z")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    names = ["a", "b", "c"]
    got = quality.scored(odd, model, names)
    assert got.columns == [*odd.columns, *names]
    assert all(0 <= r["c"] <= 1 for r in got.collect())
    assert quality.scored(odd.limit(0), model, names).count() == 0
    with pytest.raises(ValueError, match="score"):
        quality.scored(odd, model)
    clash = odd.withColumns({n: F.lit(n) for n in ("__score", "Text_Score", "_score", "a.b", "id", "k", "y", "h")})
    stay = quality.kept(clash, model, 0.0)
    assert stay.columns == clash.columns and stay.count() == 4
    assert quality.fit(docs.withColumns({n: F.lit(1) for n in ("id", "k", "y", "h")}), labels) is not None
    few = quality.scored(docs.select("doc_id", "text"), model)
    assert few.count() == docs.count()


def plain_view(text, model):
    """The text view's logit over dictionaries, one word at a time."""
    data = (text or "").encode()
    words = data.split()
    low = [w.lower() for w in words]  # of bytes: A-Z only
    n = max(1, len(words))
    of = lambda w: int(B.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    hashes = {w: of(w) for w in set(low)}
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    letters = sum(map(letter, data))
    symbols = sum(not letter(b) and not 48 <= b <= 57 and b not in b"'-.,\t\n\v\f\r " for b in data)
    size = max(1, len(data))
    buckets = collections.Counter(hashes[w] >> (64 - quality.BITS) for w in low)
    dense = [
        sum(65 <= b <= 90 for b in data) / max(1, letters),
        symbols / size,
        sum(48 <= b <= 57 for b in data) / size,
        letters / size,
        sum(a == b for a, b in zip(low, low[1:])) / n,
        (len(low) - len(set(low))) / n,
        max(buckets.values(), default=0) / n,
        sum(not letter(w[-1]) for w in words) / n,
        sum(len(w) > 24 for w in words) / n,
        math.log1p(len(words)),
        sum(map(len, words)) / n / 10,
    ]
    w, b, scale, shift = model["text"]
    centre, spread = model["norm"]
    z = b + sum(math.sqrt(c / n) * float(w[k]) for k, c in buckets.items())
    z += sum(min(8, max(-8, (x - centre[i]) / spread[i])) * float(w[(1 << quality.BITS) + i]) for i, x in enumerate(dense))
    return z * scale + shift


def plain_meta(row, model):
    w, b, scale, shift = model["meta"]
    lang, source = (zlib.crc32(("\0" if x is None else x).encode()) for x in (row.lang, row.source))
    chars = min(23, int(math.log2(max(0, row.n_chars or 0) + 1)))
    return (float(w[lang % 64]) + float(w[64 + source % 192]) + float(w[256 + chars]) + b) * scale + shift


def test_scores_are_those_of_the_plain_model(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "Ab ab AB\n\x0b42 ... é É x\u00a0y " * 30, "en", None, 5)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    p = lambda z: 1 / (1 + math.exp(-min(35, max(-35, z))))
    for r in quality.scored(every, model).collect():
        t, m = plain_view(r.text, model), plain_meta(r, model)
        w, b = model["both"]
        assert r.text_score == pytest.approx(p(t), rel=1e-4, abs=1e-9) and r.meta_score == pytest.approx(p(m), rel=1e-4, abs=1e-9)
        assert r.score == pytest.approx(p(t * w[0] + m * w[1] + b), rel=1e-4, abs=1e-9)


def test_fit_finds_the_minimum():
    rng = np.random.default_rng(1)
    x, true = rng.standard_normal((400, 3)), np.array([2.0, -1.0, 0.0])
    y = (rng.random(400) < quality.sigmoid(x @ true)).astype(float)
    got = quality.Logistic(3).fit(x, y, 1e-3, steps=2000)
    miss = quality.sigmoid(x @ got.w + got.b) - y
    assert np.abs(miss @ x / 400 + 1e-3 * got.w).max() < 1e-3 and abs(miss.mean()) < 1e-3  # no slope is left
    half = np.r_[np.ones(200), np.zeros(200)]
    one, two = quality.Logistic(3).fit(x, y, 1e-3, weight=half), quality.Logistic(3).fit(x[:200], y[:200], 1e-3)
    assert np.allclose(one.w, two.w)


def test_views_teach_each_other_only_what_they_are_sure_of(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_ROUND", 20)
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(["river", "stone", "cloud", "field"], 40))
    bad = lambda: " ".join(rng.choice(["BUY", "now!!!", "$$$", "win"], 40))
    y = rng.integers(0, 2, 1200)
    rows = [(i, good() if y[i] else bad(), str(rng.choice(["en", "de"])), f"s{rng.integers(0, 5)}", int(rng.integers(100, 300))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(600)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    # the text tells the class outright, the metadata nothing: only the text view teaches,
    # the surest of each class, every round others
    assert [t["meta"] for t in model["told"]] == [40, 80, 120] and all(t["text"] == 0 for t in model["told"])
    got = quality.scored(docs, model).collect()
    assert sum((r.score >= 0.5) == y[r.doc_id] for r in got) >= 1190
    held = {}
    monkeypatch.setattr(quality, "_fit_once", lambda rows, given, told, plain=quality._fit_once: held.update(told={k: t for k, _, t in told}) or plain(rows, given, told))
    quality.fit(docs.orderBy(F.col("doc_id").desc()), labels)
    assert min(held["told"]) >= 600 and all(y[k] == t for k, t in held["told"].items())  # from all unlabelled rows, and right
    assert len(held["told"]) == 120 and max(held["told"]) > 1100


def test_no_class_no_model():
    x, meta = np.zeros((10, (1 << quality.BITS) + quality.STATISTICS), np.float32), np.tile([0, 64, 256], (10, 1))
    none = {v: np.full(10, -1) for v in quality.VIEWS}
    assert quality.train(x, meta, np.ones(10, int), np.arange(10) % 5, none) is None


def test_same_model_twice(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(5), labels.repartition(3))
    assert (a["text"][0] == b["text"][0]).all() and (a["both"][0] == b["both"][0]).all()
