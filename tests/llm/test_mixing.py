import math

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing


def waterfill(sizes, weights, most=mixing.MOST):
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > most * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: most * sizes[i] for i in over}


@pytest.fixture(scope="module")
def docs(spark):
    sources = ["a", "b", "b", "c", None, None, "d", *["e"] * 12] * 9
    return spark.createDataFrame([(i, "w " * (i % 7 + 1) if s != "a" else "x", s) for i, s in enumerate(sources)], "doc_id long, text string, source string")


def test_targets_and_takings(docs):
    rows = mixing.mix(docs).collect()
    by = {r.source: r for r in rows}
    order = ["a", "b", "c", "d", "e", None]
    want = waterfill([by[s].source_size for s in order], [5, 2, 1, 5, 2, 1])
    for s, target in zip(order, want):
        assert by[s].target == pytest.approx(target)
        taken = sum(r.taken for r in rows if r.source == s)
        assert abs(taken - target) <= 7
    assert all(r.copies <= 3 for r in rows)
    assert rows == mixing.mix(docs.repartition(7)).orderBy("id").collect() or {(r.id, r.taken) for r in rows} == {(r.id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}


def test_curriculum_follows_the_schedules(docs):
    laid = mixing.curriculum(docs).collect()
    copies = {r.id: r.copies for r in mixing.mix(docs).collect()}
    assert len(laid) == sum(copies.values())
    assert all(sum(r.doc_id == i for r in laid) == n for i, n in copies.items())
    assert len(laid[0]) == 3


def test_rows_that_repeat_an_id_or_have_none_keep_their_texts(spark):
    rows = [(1, "alpha beta gamma", "s"), (1, "delta epsilon", "s"), (None, "zeta eta", "s"), (None, "theta iota kappa", "t"), (2, "lambda", "t"), (2, "lambda", "t"), (3, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs.withColumn("n", F.monotonically_increasing_id()), row_col="n").collect()
    laid = [tuple(r) for r in mixing.curriculum(docs).collect()]
    assert len(laid) == sum(r.copies for r in mixed) and set(laid) <= set(rows)
    words = lambda t: len((t or "").split())
    for i, _, source in rows:
        assert sum(words(t) for j, t, s in laid if (j, s) == (i, source)) == sum(r.taken for r in mixed if (r.id, r.source) == (i, source))
    one_id = spark.createDataFrame([(1, f"w{k} " * (k % 5 + 1), "s") for k in range(60)], "doc_id long, text string, source string")
    assert len({r.text for r in mixing.curriculum(one_id).collect()}) == 60  # one source alone is taken once


def test_columns_of_any_name(spark, docs):
    names = ["__at", "__id", "row", "whole", "copies", "first", "Target"]
    odd = docs.withColumns({n: F.lit(n) for n in names})
    got = mixing.curriculum(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in mixing.curriculum(docs).collect())


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_inverse_of_the_integral(spark, knots):
    rows = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", F.expr(mixing.inverse_sql("u", knots)).alias("t")).collect()
    for r in rows:
        passed = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(r.t - t0, 0), t1 - t0)
            passed += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        assert passed / mixing.integral(knots) == pytest.approx(r.u, abs=1e-9)
    assert [mixing.integral(k) for k in mixing.SCHEDULES] == [5, 2, 1]


def test_edges_of_the_input(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.curriculum(docs.limit(0)).count() == 0
    rows = [(1, None, None), (None, "a b", None), (2, "", "s"), (2, "c d e", "s"), (2, "c d e", "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1)).withColumn("rank", F.lit("x"))
    got = mixing.mix(odd)
    assert got.count() == 5
    assert not any(math.isnan(r.target) for r in got.collect())
    assert mixing.curriculum(odd).columns == odd.columns
    empty = spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(empty).collect()] == [(0, 0.0)]


def test_the_query_reads_its_takings_off_the_curriculum(docs, monkeypatch):
    by = lambda rows: sorted((r.id, r.copies, r.taken) for r in rows.collect())
    assert by(mixing.told(docs)) == by(mixing.mix(docs))
    laid = mixing._laid
    monkeypatch.setattr(mixing, "_laid", lambda *a: laid(*a).where("row < 0"))  # an empty layout takes nothing
    assert {(c, t) for _, c, t in by(mixing.told(docs))} == {(0, 0)}


def test_the_mix_is_made_once_for_the_curriculum_and_its_figures(spark, monkeypatch):
    made = []
    monkeypatch.setattr(mixing, "mix", lambda *a, _mix=mixing.mix, **k: made.append(1) or _mix(*a, **k))
    docs = spark.createDataFrame([(i, "word " * (i + 1), "ab"[i % 2]) for i in range(20)], "doc_id int, text string, source string")
    told = mixing.told(docs).collect()
    assert len(made) == 1 and len(told) == 20 and all(r.taken == r.copies * r.size for r in told)
