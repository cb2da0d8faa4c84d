import datetime as dt
import random
from decimal import Decimal

import pytest

from tallyforge.operators import audit, cadence

DAY = dt.timedelta(days=1)
SCHEMA = "seq long, account string, merchant string, date date, amount decimal(18,2), direction string"


def every(start, step, n, amount, merchant="m", direction="debit"):
    start = dt.date.fromisoformat(start)
    return [(merchant, start + i * step * DAY, Decimal(amount), direction) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, "a", m, d, a, k) for i, (m, d, a, k) in enumerate(rows)], SCHEMA)


def plain_net(rows, direction):
    """Straight from the definition: one reversal, one payment at a time."""
    paid = sorted((r for r in rows if r[3] == direction), key=lambda r: r[1])
    gone = [False] * len(paid)
    for back in sorted((r for r in rows if r[3] != direction), key=lambda r: r[1]):
        for i in reversed(range(len(paid))):
            p = paid[i]
            if not gone[i] and p[0] == back[0] and p[2] == back[2] and p[1] <= back[1] and (back[1] - p[1]).days <= 45:
                gone[i] = True
                break
    return sorted((p[0], p[2], p[1]) for p, g in zip(paid, gone) if not g)


@pytest.mark.parametrize("seed", range(4))
def test_netting_matches_its_definition(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), dt.date(2024, 1, 1) + rng.randrange(120) * DAY, Decimal(rng.choice([5, 10])), rng.choice(["debit", "debit", "credit"])) for _ in range(120)]
    got = [(r.merchant, r.amount, r.date) for r in cadence.net_of_reversals(frame(spark, rows), "debit", "merchant").collect() for _ in range(r.n)]
    assert sorted(got) == plain_net(rows, "debit")


def test_netting_of_many_a_day_without_python(spark):
    rng = random.Random(9)
    rows = [("m", dt.date(2024, 1, 1) + rng.randrange(0, 200, 3) * DAY, Decimal(5), rng.choice(["debit", "credit"])) for _ in range(900)]
    left = cadence.net_of_reversals(frame(spark, rows), "debit", "merchant")
    assert sorted((r.merchant, r.amount, r.date) for r in left.collect() for _ in range(r.n)) == plain_net(rows, "debit")
    assert "Arrow" not in left._jdf.queryExecution().toString() and "Python" not in left._jdf.queryExecution().toString()


@pytest.mark.parametrize("grouped", [False, True])
def test_places_over_skewed_numbers(spark, grouped):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(i, 10**18 if i == 7 else None if i % 50 == 0 else rng.choice([3, 3, 3, rng.randrange(1000)]), f"t{rng.randrange(400)}", i % 2) for i in range(20000)]
    data = spark.createDataFrame(rows, "id long, v long, tie string, g int")
    got = audit.numbered(data, "place", F.col("v"), "tie", group="g" if grouped else None, ranges=16)
    assert got.columns == ["id", "v", "tie", "g", "place"]
    own = sorted(got.collect(), key=lambda r: r.place)
    assert [r.place for r in own] == list(range(1, len(rows) + 1))
    key = [(r.g if grouped else 0, r.v is not None, r.v or 0, r.tie) for r in own]
    assert key == sorted(key)


def test_ranges_are_even_whatever_values_repeat(spark, monkeypatch):
    from pyspark.sql import functions as F

    held = {}
    monkeypatch.setattr(audit, "staged", lambda df, name: held.setdefault("df", df.cache()))
    data = spark.range(60000).select(F.when(F.col("id") == 0, 10.0**300).when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7).alias("v"), F.lit("same").alias("tie"))
    got = audit.numbered(data, "place", F.col("v"), "tie", ranges=20)
    assert got.agg(F.countDistinct("place")).first()[0] == 60000
    sizes = sorted(r["count"] for r in held["df"].groupBy("_range_place").count().collect())
    assert len(sizes) == 20 and sizes[-1] <= 2 * sizes[10]


CASES = {
    "twelve months": (every("2024-01-05", 30, 12, "9.99"), [("monthly", "9.99", None)]),
    "two months are none": (every("2024-01-05", 30, 2, "9.99"), []),
    "two years": (every("2023-02-01", 365, 2, "80"), [("yearly", "80.00", None)]),
    "a rise": (every("2024-01-01", 30, 4, "10") + every("2024-04-30", 30, 4, "12"), [("monthly", "12.00", "10.00")]),
    "a drop is no rise": (every("2024-01-01", 30, 4, "12") + every("2024-04-30", 30, 4, "10"), [("monthly", "10.00", None)]),
    "a rise stays after a drop": (every("2024-01-01", 30, 3, "10") + every("2024-03-31", 30, 3, "12") + every("2024-06-29", 30, 3, "11"), [("monthly", "11.00", "10.00")]),
    "two at once": (every("2024-01-01", 30, 6, "5") + every("2024-01-11", 30, 6, "8"), [("monthly", "5.00", None), ("monthly", "8.00", None)]),
    "irregular": ([("m", dt.date(2024, 1, 1) + d * DAY, Decimal(3), "debit") for d in (0, 3, 17, 18, 60)], []),
    "refunded and bought again": (every("2024-01-01", 30, 6, "7") + [("m", dt.date(2024, 2, 2), Decimal(7), "credit"), ("m", dt.date(2024, 2, 3), Decimal(7), "debit")], [("monthly", "7.00", None)]),
    "a long pause ends it": (every("2023-01-01", 30, 4, "6") + every("2023-12-01", 30, 4, "6.5"), [("monthly", "6.00", None), ("monthly", "6.50", None)]),
    "weekly": (every("2024-03-01", 7, 9, "2.50"), [("weekly", "2.50", None)]),
    "quarterly": (every("2024-01-01", 91, 4, "30"), [("quarterly", "30.00", None)]),
}


def plain_fold(clusters):
    """Every earlier series is tried, whatever its age."""
    series = []
    for amount, days in clusters:
        first, own = days[0][0], cadence.day_gaps(days)
        for s in reversed(series):
            wait = (first - s["last"]).days
            gaps = [*s["gaps"], *own.elements(), wait]
            period = cadence.period_of_gaps(dict((g, gaps.count(g)) for g in set(gaps))) if wait > 0 else None
            if period and wait <= cadence._NOMINAL[period] * 8 // 5:
                s |= {"amount": amount, "gaps": gaps, "last": days[-1][0]}
                break
        else:
            series.append({"amount": amount, "gaps": list(own.elements()), "last": days[-1][0]})
    told = ((s["amount"], cadence.period_of_gaps({g: s["gaps"].count(g) for g in set(s["gaps"])}), len(s["gaps"])) for s in series)
    return sorted((a, p, n) for a, p, n in told if p)


@pytest.mark.parametrize("seed", range(6))
def test_laying_old_series_aside_changes_nothing(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        start, step = dt.date(2010, 1, 1) + rng.randrange(5000) * DAY, rng.choice([7, 30, 91, 365, 365, 1])
        rows += [("m", start + i * step * DAY, Decimal(100 + k), "debit") for i in range(rng.choice([1, 1, 1, 2, 3]))]
    clusters = sorted(((min(r[1] for r in rows if r[2] == a), i, a) for i, a in enumerate(dict.fromkeys(r[2] for r in rows))))
    days = lambda a: sorted((d, sum(r[1] == d for r in rows if r[2] == a)) for d in {r[1] for r in rows if r[2] == a})
    want = plain_fold([(a, days(a)) for _, _, a in clusters])
    folded = cadence.fold_series([(a, days(a)) for _, _, a in clusters])
    assert sorted((s["amount"], s["period"], sum(s["gaps"].values())) for s in folded) == want
    got = cadence.series(frame(spark, rows)).collect()
    assert sorted((r.amount, r.period, r.payments - 1) for r in got) == want


@pytest.mark.parametrize("name", CASES)
def test_series(spark, name):
    rows, want = CASES[name]
    random.Random(1).shuffle(rows)
    got = cadence.series(frame(spark, rows)).collect()
    assert sorted((r.period, str(r.amount), r.rise_from and str(r.rise_from)) for r in got) == sorted(want, key=str)


def test_income_is_the_same_over_credits(spark):
    rows = every("2024-01-25", 30, 6, "2000", "pay", "credit") + every("2024-01-03", 30, 6, "4")
    assert [(r.merchant, r.period) for r in cadence.series(frame(spark, rows), "credit").collect()] == [("pay", "monthly")]


def test_row_order_changes_nothing(spark):
    rows = [r for name, (x, _) in CASES.items() for r in [(name, *y[1:]) for y in x]]
    one = sorted(map(str, cadence.series(frame(spark, rows)).collect()))
    shuffled = frame(spark, rows).repartition(5).orderBy("amount")
    assert sorted(map(str, cadence.series(shuffled).collect())) == one


def test_many_payments_of_a_day_are_counted_once_each(spark):
    rows = every("2024-01-01", 7, 5, "1") + [("m", dt.date(2024, 1, 1), Decimal(1), "debit")] * 3
    got = cadence.cadence(frame(spark, rows), "merchant").first()
    assert (got.payments, got.zeros, got.gap_median, got.agreeing, got.period) == (8, 3, 7, 4, "weekly")
    assert cadence.looks_periodic(frame(spark, rows), "merchant").first().periodic


def test_actions_in_order(spark):
    rows = [("gym", "monthly", "30", "360", "20", "30"), ("tv", "monthly", "15", "180", None, None), ("club", "yearly", "90", "90", None, None)]
    found = spark.createDataFrame([(m, p, Decimal(a), Decimal(y), f and Decimal(f), t and Decimal(t), "subscription", "high", "unknown", dt.date(2024, 2, 29)) for m, p, a, y, f, t in rows], "merchant string, period string, amount decimal(18,2), annualised decimal(28,2), rise_from decimal(18,2), rise_to decimal(18,2), kind string, confidence string, category string, last_date date")
    from pyspark.sql import functions as F

    got = audit.propose_actions(found, F.lit(dt.date(2024, 6, 10))).orderBy("action_id").collect()
    assert [(r.action_id, r.action, r.merchant) for r in got] == [("act-01", "price_rise", "gym"), ("act-02", "subscription", "gym"), ("act-03", "renewal", "club")]
    assert got[2].due == dt.date(2025, 2, 28)
