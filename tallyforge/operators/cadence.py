"""Cadence, amount clusters, reversal netting and payment series.

Payments are counted by merchant and day before anything is gathered, so what a merchant
gathers is bounded by the days of the calendar (times its different amounts, for series
and netting), however many payments it has.
"""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Iterator, Mapping
from decimal import Decimal
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.sources.runs import spread

REVERSAL_DAYS = 45


def day_counts(payments: DataFrame, *keys: str) -> DataFrame:
    return payments.groupBy(*keys, "date").agg(F.count("*").alias("n"))


def gap_stats(days: DataFrame, *keys: str) -> DataFrame:
    """Per key: payments, first and last date, and sorted gaps between distinct days.

    Gaps of zero days, between payments of one day, are only counted (``zeros``).
    """
    rows = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "n"))).alias("d"))
    gaps = F.transform(F.sequence(F.lit(2), F.size("d")), lambda i: F.datediff(F.element_at("d", i)["date"], F.element_at("d", i - 1)["date"]))
    none = F.array().cast("array<int>")
    return rows.select(
        *keys,
        F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("payments"),
        F.col("d")[0]["date"].alias("first_date"),
        F.element_at("d", -1)["date"].alias("last_date"),
        F.array_sort(F.when(F.size("d") > 1, gaps).otherwise(none)).alias("gaps"),
        F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + x["n"] - 1).alias("zeros"),
    )


def with_period(stats: DataFrame) -> DataFrame:
    """Adds gap_median (upper), agreeing, and period.

    The period is the band of the upper median gap if most gaps share it; fewer than
    three payments count only at a yearly pace.
    """
    total = F.col("zeros") + F.size("gaps")
    at = F.floor(total / 2) - F.col("zeros")
    median = F.when(total == 0, F.lit(None)).when(at < 0, 0).otherwise(F.try_element_at("gaps", (at + 1).cast("int")))
    rows = stats.withColumn("gap_median", median.cast("int")).withColumn("band", D.band_of(F.col("gap_median")))
    rows = rows.withColumn("agreeing", F.size(F.filter("gaps", lambda g: D.band_of(g) == F.col("band"))).cast("long"))
    good = (2 * F.col("agreeing") > total) & ((F.col("payments") >= 3) | (F.col("band") == "yearly"))
    return rows.withColumn("period", F.when(good, F.col("band"))).drop("band")


def cadence(payments: DataFrame, *keys: str) -> DataFrame:
    return with_period(gap_stats(day_counts(payments, *keys), *keys))


def looks_periodic(payments: DataFrame, *keys: str) -> DataFrame:
    """(keys, periodic) over the distinct days of debits."""
    days = payments.where("direction = 'debit'").select(*keys, "date").distinct().withColumn("n", F.lit(1).cast("long"))
    return with_period(gap_stats(days, *keys)).select(*keys, F.col("period").isNotNull().alias("periodic"))


def amount_clusters(payments: DataFrame, *keys: str) -> DataFrame:
    return payments.groupBy(*keys, "amount").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def net_of_reversals(payments: DataFrame, direction: str, *keys: str) -> DataFrame:
    """(keys, amount, date, n) of the payments in a direction that no reversal cancels.

    Each reversal, oldest first, cancels the latest payment up to 45 days before it that
    none has. Open payments are a stack, and what is too old for one reversal is so for
    all later ones: so the stack's depth after each day, which prefix sums give, tells all.
    A day's payments lie between the depth before them and that with them; those above the
    least depth of the next 45 days are cancelled in that time, and the rest stay.
    """
    return _left(_day_sums(payments, direction, *keys), *keys).select(*keys, "amount", "date", "n")


def _day_sums(payments: DataFrame, direction: str, *keys: str, **more: Column) -> DataFrame:
    paid = F.when(F.col("direction") == direction, 1).otherwise(-1).cast("long")
    return payments.groupBy(*keys, "amount", "date").agg(F.sum(F.greatest(paid, F.lit(0))).alias("paid"), F.sum(paid).alias("more"), *(c.alias(n) for n, c in more.items()))


def _left(days: DataFrame, *keys: str) -> DataFrame:
    """The days that keep payments, with their number n."""
    # a column, so that all windows have one order and rows are sorted once
    by_day = Window.partitionBy(*keys, "amount").orderBy("day")
    days = days.withColumn("day", F.unix_date("date")).withColumn("sum", F.sum("more").over(by_day))
    days = days.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(by_day)))  # a reversal of nothing pops nothing
    days = days.withColumn("below", F.coalesce(F.lag("depth").over(by_day), F.lit(0)))
    left = F.least("paid", F.min("depth").over(by_day.rangeBetween(0, REVERSAL_DAYS)) - F.col("below"))
    return days.withColumn("n", left).where("n > 0")


_BANDS = {name: (lo, hi) for name, lo, hi, *_ in D.PERIODS}
_NOMINAL = {name: days for name, _, _, days, *_ in D.PERIODS}


@lru_cache(maxsize=4096)
def _band(days: int) -> str | None:
    return next((name for name, (lo, hi) in _BANDS.items() if lo <= days <= hi), None)


def period_of_gaps(gaps: Mapping[int, int]) -> str | None:
    """The period that counted gaps between payments show: the band of the upper median,
    if most of them share it."""
    total = sum(gaps.values())
    if not total:
        return None
    at = 0
    for gap in sorted(gaps):
        at += gaps[gap]
        if at > total // 2:
            break
    found = _band(gap)
    if found is None or (total < 2 and found != "yearly"):
        return None
    return found if 2 * sum(n for g, n in gaps.items() if _band(g) == found) > total else None


def day_gaps(days: list[tuple[datetime.date, int]]) -> Counter:
    """Counted gaps of (date, payments) in order; payments of one day are no days apart."""
    return _gaps([(d.toordinal(), n) for d, n in days])


def _gaps(days: list[tuple[int, int]]) -> Counter:
    gaps = Counter([b - a for (a, _), (b, _) in zip(days, days[1:])])
    if same := sum([n for _, n in days]) - len(days):
        gaps[0] += same
    return gaps


def period_of(days: list[datetime.date]) -> str | None:
    return period_of_gaps(Counter((b - a).days for a, b in zip(days, days[1:])))


#: No series waits longer than this for its next payment.
LONGEST_WAIT = max(_NOMINAL.values()) * 8 // 5


def fold_series(clusters: list[tuple[Decimal, list[tuple[datetime.date, int]]]]) -> list[dict]:
    """``folded`` of clusters whose days are dates."""
    date = lambda d: None if d is None else datetime.date.fromordinal(d)
    found = folded([(amount, [(d.toordinal(), n) for d, n in days]) for amount, days in clusters])
    return [s | {"last": date(s["last"]), "rise_when": date(s["rise_when"])} for s in found]


def folded(clusters: list[tuple[Decimal, list[tuple[int, int]]]]) -> list[dict]:
    """Series of clusters (amount, days by number with counts) in first-seen order: each joins the
    latest series that it continues, as its new price, else begins one; a rise stays
    known after a drop. A series holds its last day and its counted gaps, not payments.
    Those that have waited too long for any cluster still to come are laid aside, and two
    single payments are compared by their distance alone."""
    done: list[dict] = []
    series: list[dict] = []
    yearly = _BANDS["yearly"]
    for amount, days in clusters:
        first, own, n = days[0][0], _gaps(days), sum([k for _, k in days])
        if any(first - s["last"] > LONGEST_WAIT for s in series):
            done += [s for s in series if first - s["last"] > LONGEST_WAIT]
            series = [s for s in series if first - s["last"] <= LONGEST_WAIT]
        for s in reversed(series):
            wait = first - s["last"]
            if wait <= 0 or (not own and not s["gaps"] and not yearly[0] <= wait <= yearly[1]):
                continue
            gaps = s["gaps"] + own + Counter([wait])
            period = period_of_gaps(gaps)
            if period and wait <= _NOMINAL[period] * 8 // 5:
                if amount > s["amount"]:
                    s |= {"rise_from": s["amount"], "rise_to": amount, "rise_when": first}
                s |= {"amount": amount, "gaps": gaps, "last": days[-1][0], "payments": s["payments"] + n}
                break
        else:
            series.append({"amount": amount, "gaps": own, "last": days[-1][0], "payments": n, "rise_from": None, "rise_to": None, "rise_when": None})
    return [s | {"period": p} for s in done + series if (p := period_of_gaps(s["gaps"]))]


def series(payments: DataFrame, direction: str = "debit", account: str = "account", merchant: str = "merchant", parts: int | None = None) -> DataFrame:
    """(account, merchant, period, amount, rise_from, rise_to, rise_when, payments) of each series.

    Each cluster's place depends on the ones before, so a merchant is folded by one task.
    Its days arrive sorted and as numbers; what is held of it grows with its different
    amounts and days and not with payments. ``parts`` are as many as rows are dealt over.
    """
    # payments are read once: sums of days carry the first number too
    days = _day_sums(payments, direction, account, merchant, seq=F.min(F.when(F.col("direction") == direction, F.col("seq"))))
    dealt = days.repartition(parts, account, merchant) if parts else spread(days, account, merchant, source=payments)
    net = _left(dealt, account, merchant).sortWithinPartitions(account, merchant, "amount", "day").select(account, merchant, "amount", "day", "n", "seq")
    kinds = dict(net.dtypes)
    money = kinds["amount"]
    fields = ("rise_from", "rise_to", "rise_when")
    d = pa.decimal128(*map(int, money[8:-1].split(",")))

    def begins(column: pa.Array) -> np.ndarray:
        """Whether a row has another value than the one before."""
        return np.concatenate([[True], pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)])

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The series of whole merchants."""
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        fresh = begins(rows.column(account)) | begins(rows.column(merchant))
        at = np.flatnonzero(fresh | begins(rows.column("amount")))  # a cluster's first row
        whose = np.cumsum(fresh)[at] - 1
        n = rows.column("n").to_numpy()
        paid = np.add.reduceat(n, at)
        dated = rows.column("day").is_valid().to_numpy(zero_copy_only=False)[at]  # nulls come first
        # one payment is no series
        kept = np.flatnonzero(dated & (np.bincount(whose, paid * dated)[whose] > 1))
        first = rows.take(pa.array(at[kept]))
        order = pc.sort_indices(pa.table({"whose": whose[kept], "day": first.column("day"), "seq": first.column("seq")}), sort_keys=[("whose", "ascending"), ("day", "ascending"), ("seq", "ascending")], null_placement="at_start").to_numpy()
        number = list(zip(rows.column("day").fill_null(0).to_numpy().tolist(), n.tolist()))
        ends = np.append(at[1:], len(n))
        of = kept[order]
        clusters = [(amount, number[a:b]) for amount, a, b in zip(first.column("amount").take(pa.array(order)).to_pylist(), at[of].tolist(), ends[of].tolist())]
        cuts = np.flatnonzero(np.diff(whose[of], prepend=-1, append=-1)).tolist() if len(of) else []
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:]):
            out += [(a, s["period"], s["amount"], *(s[f] for f in fields), s["payments"]) for s in folded(clusters[a:b])]
        place = pa.array([at[of[r[0]]] for r in out], pa.int64())
        types = (pa.string(), d, d, d, pa.int32(), pa.int64())
        columns = [pa.array([r[k + 1] for r in out], t) for k, t in enumerate(types)]
        columns[4] = columns[4].cast(pa.date32())
        return pa.record_batch([rows.column(account).take(place), rows.column(merchant).take(place), *columns], [account, merchant, "period", "amount", *fields, "payments"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows since the last merchant began
        for batch in batches:
            # here, as Spark would make every merchant's name once more to filter by it
            batch = batch.filter(reduce(pc.and_, [batch.column(c).is_valid() for c in (account, merchant, "amount")]))
            if not batch.num_rows:
                continue
            cut = int(np.flatnonzero(begins(batch.column(account)) | begins(batch.column(merchant)))[-1])
            if cut:
                yield told([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield told(held)

    return net.mapInArrow(run, f"{account} {kinds[account]}, {merchant} {kinds[merchant]}, period string, amount {money}, rise_from {money}, rise_to {money}, rise_when date, payments long")
