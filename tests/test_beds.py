import datetime as dt

from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import cadence, evals, merchants, reports, terms, timeline
from tallyforge.sources import beds


def test_every_generated_series_is_found_exactly(spark):
    rows = merchants.with_stem(beds.statements(spark.range(3))).withColumn("merchant", F.col("stem"))
    got = sorted((r.account, r.merchant, r.period, r.rise_to is not None) for r in cadence.series(rows).collect())
    assert got == sorted((str(a), s.replace("_", " ").upper(), *one) for a in range(3) for s, told in beds.TRUTH.items() for one in told)
    assert len(beds.RUNS) == 18 and set(beds.TRUTH) <= set(beds.RUNS)


def test_every_generated_deadline_is_resolved(spark):
    segments, obligations = beds.letters(spark.range(5))
    got = timeline.dated(obligations, segments).select("shape", "written", "due.date", "due.kind").collect()
    assert len(got) == 5 * len(beds.LETTERS)
    for r in got:
        later = r.written + dt.timedelta(days=21)
        month_end = (r.written.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        want = {"dated": (later, "read"), "counted": (r.written + dt.timedelta(days=14), "worked_out"), "anchored": (later + dt.timedelta(days=30), "worked_out"), "month_end": (month_end, "worked_out"), "undated": (None, None), "pointed": (later, "read")}
        want |= {"counted_from_a_date": (later + dt.timedelta(days=10), "worked_out"), "one_day": (r.written + dt.timedelta(days=1), "worked_out"), "working_days": (None, None), "relative_words": (None, None), "pointed_below": (later, "read"), "dated_despite_anchor": (later, "read")}
        later_end = (later.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        want |= {"month_end_of_anchor": (later_end, "worked_out")}
        assert (r.date, r.kind) == want[r.shape]


def test_small_statistics(spark):
    v = spark.createDataFrame([("a", "PASS"), ("a", "FAIL"), ("b", "MARGINAL")], "grp string, verdict string")
    assert {r.grp: r.verdict for r in evals.worst_verdict(v, "grp").collect()} == {"a": "FAIL", "b": "MARGINAL"}
    assert evals.worst_verdict(v.limit(0)).first().verdict == "FAIL"
    calls = spark.createDataFrame([(100, 1000), (300, 1000)], "tokens long, ms long")
    assert evals.throughput(calls).first().tokens_per_second == 200
    names = spark.createDataFrame([("a",), ("b",)], "dimension string")
    assert {r.dimension: r.measured for r in evals.coverage(names, names.limit(1)).collect()} in ({"a": True, "b": False}, {"a": False, "b": True})
    table = spark.createDataFrame([([["item", "cost"], ["tea", "£1,200.50"], ["12", "3%"]],)], "rows array<array<string>>")
    assert table.select(reports.numeric_columns(F.col("rows"))).first()[0] == [False, True]


def test_every_generated_renewal_is_told(spark):
    rows, truth = beds.renewals(spark.range(4))
    families = rows.select("term", "family").distinct()
    shape = F.regexp_extract("term", "^([a-z_]+?)_[0-9]+:", 1)
    told = {}
    for twin in (rows, beds.swapped_roles(rows)):
        diff, refused = terms.compare(twin, 0, 1, families)
        got = diff.select(shape.alias("shape"), F.col("change").alias("verdict")).unionByName(refused.select(shape.alias("shape"), F.col("why").alias("verdict")))
        told[len(told)] = {(r.shape, r.verdict) for r in got.collect()}
    assert told[0] == {(r.shape, r.verdict) for r in truth.collect()}
    turned = {"added": "removed", "removed": "added"}
    assert told[1] == {(s, turned.get(v, v)) for s, v in told[0]}


def test_twins_of_statements(spark):
    bed = beds.statements(spark.range(2))
    found = lambda df: {(r.account, r.merchant, r.period) for r in cadence.series(merchants.with_stem(df).withColumn("merchant", F.col("stem"))).collect()}
    whole = found(bed)
    assert found(beds.reordered(bed)) == whole
    assert found(beds.one_removed(bed, "weekly_level")) == {x for x in whole if x[1] != "WEEKLY LEVEL"}
    assert found(beds.disguised(bed)) == whole
    assert found(beds.with_strangers(bed)) == whole
    rises = lambda df: {(r.account, r.merchant): r.rise_to for r in cadence.series(merchants.with_stem(df).withColumn("merchant", F.col("stem"))).collect()}
    was, now = rises(bed), rises(beds.dearer(bed, "monthly_level"))
    assert {k for k in now if now[k] != was.get(k)} == {("0", "MONTHLY LEVEL"), ("1", "MONTHLY LEVEL")} and set(was) == set(now)


def test_series_read_the_payments_once_and_accounts_are_dealt_out(spark):
    rows = beds.with_strangers(beds.dearer(beds.reordered(beds.statements(spark.range(3, numPartitions=1))), "monthly_level"))
    made = beds.statements(spark.range(3, numPartitions=1))
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(cadence.series(made.withColumn("merchant", F.col("raw_merchant")))).count("Generate explode") == 1
    assert "Join LeftOuter" not in plan(rows)


def test_codes_by_their_digits(spark):
    words = ["A1", "ab1", "abc1", "12", "é9é", "é9éé", "T12x3", "#1", "x", "1𝄞2𝄞", "𝄞1𝄞𝄞", "PAY", "a1b2c3"]
    digits = lambda w: sum(c in "0123456789" for c in w)
    assert {r.w for r in spark.createDataFrame([(w,) for w in words], "w string").where(X.is_code(F.col("w"))).collect()} == {w for w in words if digits(w) and len(w) - digits(w) <= 2}


def test_twins_are_dealt_out_once_and_their_payments_once_more(spark):
    from tallyforge.plans import catalog

    plan = catalog.queries()["statement_twins"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Union" not in plan
    assert plan.count("Generate explode(sequence") == 1 and "ObjectHashAggregate" not in plan


def test_what_lacks_a_name_or_amount_is_no_series_and_holds_none_up(spark):
    from decimal import Decimal

    rows = [(i, a, m, dt.date(2024, 1, 3) + dt.timedelta(days=30 * i), p, "debit") for a, m, p in (("a", "x", Decimal(3)), (None, "x", Decimal(3)), ("a", None, Decimal(3)), ("a", "x", None), ("b", "y", Decimal(4))) for i in range(5)]
    rows.append((9, "b", "y", None, Decimal(4), "debit"))
    payments = spark.createDataFrame(rows, "seq long, account string, merchant string, date date, amount decimal(18,2), direction string")
    assert [(r.account, r.merchant, r.period, r.payments) for r in cadence.series(payments, parts=1).collect()] == [("a", "x", "monthly", 5)]
