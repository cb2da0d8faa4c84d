"""From series and payments to findings, spend, totals, a checklist and proposed actions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import numbers as N
from tallyforge.functions import text as X
from tallyforge.sources.runs import staged

#: Annualised subscriptions above this are worth a look.
WORTH_A_LOOK = 100
# Names of days and, below, the sentences of reasons.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def recurring_kind(category: Column, kinds: Mapping[str, str]) -> Column:
    """The category's kind, else what ``unknown`` has, else subscription."""
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(known, category), F.try_element_at(known, F.lit("unknown")), F.lit("subscription"))


def spend_kind(debit_days: Column) -> Column:
    return F.when(debit_days >= 3, "regular_spend").otherwise("one_off")


def regular_spend(payments: DataFrame, *keys: str) -> DataFrame:
    """Per key: visits, total, typical visit (decimal median) and kind, over all payments.

    The median is read from counts by amount: the amounts at the two middle ranks.
    """
    amounts = payments.groupBy(*keys, "amount").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("amount")
    placed = amounts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("amount")))

    typical = placed.groupBy(*keys).agg(F.sum("n").alias("visits"), F.sum(F.col("amount") * F.col("n")).cast("decimal(28,2)").alias("total"), F.round((at(low) + at(high)) / 2, 2).cast("decimal(28,2)").alias("typical_visit"))
    days = payments.groupBy(*keys).agg(F.countDistinct(F.when(F.col("direction") == "debit", F.col("date"))).alias("debit_days"))
    return typical.join(days, list(keys)).withColumn("kind", spend_kind(F.col("debit_days")))


def findings(series: DataFrame) -> DataFrame:
    """Series with annualised cost and what a rise adds in a year."""
    rows = series.withColumn("annualised", N.annualise(F.col("amount"), F.col("period")))
    return rows.withColumn("extra_per_year", N.annualise(F.col("rise_to") - F.col("rise_from"), F.col("period")))


def ordered_findings(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("annualised"), "merchant")


def summary(found: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("annualised"), F.lit(0)).cast("decimal(28,2)")
    return found.agg(F.count("*").alias("recurring"), total.alias("annualised_total"), F.round(total / 12, 2).cast("decimal(28,2)").alias("monthly_equivalent"), F.count_if(F.col("rise_to").isNotNull()).alias("price_rises"))


def span(payments: DataFrame) -> DataFrame:
    return payments.agg(F.count("*").alias("payments"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def numbered(rows: DataFrame, name: str, lead: Column, *ties: str, group: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds a place from 1 in the order of group (a column of few values, if any), a value
    and then columns, without one task for all rows; nulls come first.

    Spark's range partitioner cuts the rows at sampled quantiles of the whole order, so
    ranges are of about equal size however values lie or repeat (rows that are alike in
    every column are spread by chance). There are ``ranges``, else the session's shuffle
    partitions, of which it joins small ones. Rows are written once with their range; places
    count on from the rows of the ranges before, which are a count a range and group.
    """
    lead_, part, whole, chance, at, inside, before = (f"_{x}_{name}" for x in ("lead", "part", "whole", "chance", "range", "inside", "before"))
    order = [part, lead_, *ties, whole, chance]
    keyed = rows.withColumns({lead_: lead, part: F.col(group) if group else F.lit(0), whole: F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t] or [F.lit(0)]), chance: F.rand(29)})
    held = staged(keyed.repartitionByRange(*([ranges] if ranges else []), *order).withColumn(at, F.spark_partition_id()), "ranges")
    ahead = Window.orderBy(part, at).rowsBetween(Window.unboundedPreceding, -1)  # over the counts alone
    counts = held.groupBy(part, at).agg(F.count("*").alias("n")).select(part, at, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(part, at).orderBy(*order[1:]))
    same = F.broadcast(counts)  # a row a range and group
    placed = held.withColumn(inside, own).join(same.withColumnsRenamed({part: f"{part}_", at: f"{at}_"}), F.col(part).eqNullSafe(F.col(f"{part}_")) & (F.col(at) == F.col(f"{at}_")))
    return placed.select(*rows.columns, (F.col(before) + F.col(inside)).alias(name))


def top_subscription(found: DataFrame) -> DataFrame:
    """The dearest subscription that isn't yearly and costs more than is worth a look."""
    worth = (F.col("kind") == "subscription") & (F.col("period") != "yearly") & (F.col("annualised") > WORTH_A_LOOK)
    return found.where(worth).orderBy(F.desc("annualised"), "merchant").limit(1)


def checklist(found: DataFrame) -> DataFrame:
    """(merchant, rule): every yearly finding, every other uncertain one, and of the rest
    the first subscription that is worth a look."""
    rule = F.when(F.col("period") == "yearly", "yearly").when(F.col("confidence") != "high", "uncertain").when((F.col("kind") == "subscription") & (F.col("annualised") > WORTH_A_LOOK), "expensive")
    ruled = found.withColumn("rule", rule).where("rule IS NOT NULL")
    dearest = ruled.where("rule = 'expensive'").orderBy(F.desc("annualised"), "merchant").limit(1)
    return ruled.where("rule <> 'expensive'").unionByName(dearest)


def interval_stats(payments: DataFrame, *keys: str) -> DataFrame:
    """Median gap (mean of the middles, towards zero), spread, median weekday and day of month."""
    from tallyforge.operators.cadence import day_counts, gap_stats

    days = day_counts(payments, *keys)
    stats = gap_stats(days, *keys)
    # gaps of zero days are counted, not held: the two middle ranks fall before or among the rest
    total = F.col("zeros") + F.size("gaps")

    def at(rank: Column) -> Column:
        return F.when(rank <= F.col("zeros"), F.lit(0)).otherwise(F.try_element_at("gaps", (rank - F.col("zeros")).cast("int")))

    median = F.floor((at(F.floor((total + 1) / 2)) + at(F.floor(total / 2) + 1)) / 2)
    most = F.when(F.size("gaps") > 0, F.element_at("gaps", -1)).otherwise(0)
    least = F.when(F.col("zeros") > 0, 0).otherwise(F.try_element_at("gaps", F.lit(1)))
    return stats.where(total > 0).select(*keys, "payments", median.cast("long").alias("median_gap"), (most - least).cast("long").alias("spread"))


def evidence_reason(period: Column, payments: Column, median_day: Column, median_weekday: Column) -> Column:
    n = payments.cast("string")
    weekday = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), median_weekday + 1)
    return (
        F.when(period == "monthly", F.concat(n, F.lit(" payments, about the "), X.ordinal(median_day), F.lit(" of each month")))
        .when(period == "weekly", F.concat(n, F.lit(" payments, on most weeks about "), weekday))
        .when(period == "quarterly", F.concat(n, F.lit(" payments about three months apart")))
        .otherwise(F.concat(n, F.lit(" payments about a year apart")))
    )


def propose_actions(found: DataFrame, today: Column) -> DataFrame:
    """(action_id, kind, merchant, due): rises, one subscription, renewals, utilities, in that order."""
    soon, later = D.first_of_next_month(today), D.next_occurrence(F.col("last_date"), F.col("period"), today)
    act = lambda no, name, due: F.struct(F.lit(no).alias("ord"), F.lit(name).alias("action"), due.alias("due"))
    given = F.array(F.when(F.col("rise_to").isNotNull(), act(1, "price_rise", soon)), F.when(F.col("period") == "yearly", act(3, "renewal", later)), F.when(F.col("category") == "utilities", act(4, "reminder", later)))
    each = found.select("merchant", "annualised", F.explode(F.filter(given, lambda a: a.isNotNull())).alias("a")).select("a.ord", "a.action", "merchant", "annualised", "a.due")
    dear = top_subscription(found).select(F.lit(2).alias("ord"), F.lit("subscription").alias("action"), "merchant", "annualised", soon.alias("due"))
    placed = numbered(each.unionByName(dear), "place", -F.col("annualised"), "merchant", group="ord")
    place = F.col("place").cast("string")
    return placed.select(F.concat(F.lit("act-"), F.lpad(place, F.greatest(F.length(place), F.lit(2)), F.lit("0"))).alias("action_id"), "action", "merchant", "annualised", "due")


def calendar_entry(title: Column, day: Column) -> Column:
    """One event of an iCalendar export."""
    return F.concat(F.lit("BEGIN:VEVENT\r\nDTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"), F.lit("\r\nSUMMARY:"), F.regexp_replace(title, r"([\\,;])", r"\\$1"), F.lit("\r\nEND:VEVENT\r\n"))
