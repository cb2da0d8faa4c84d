"""Money, medians and proportion statistics as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.dates import per_year

Z = 1.959963984540054


def money(c: Column) -> Column:
    """Pounds with thousands and pence, half-even; a real minus sign."""
    even = F.bround(c, 2)
    shown = F.concat(F.lit("£"), F.format_number(F.abs(even), 2))
    return F.when(even < 0, F.concat(F.lit("−"), shown)).otherwise(shown)


def annualise(amount: Column, period: Column) -> Column:
    return amount * per_year(period)


def sorted_median(sorted_: Column) -> Column:
    """Mean of the two middles of a sorted decimal array, half away from zero to pence."""
    n = F.size(sorted_)
    low, high = F.element_at(sorted_, ((n + 1) / 2).cast("int")), F.element_at(sorted_, (n / 2).cast("int") + 1)
    return F.when(n > 0, F.round((low + high) / 2, 2))


def integer_median(sorted_: Column) -> Column:
    n = F.size(sorted_)
    low, high = F.element_at(sorted_, ((n + 1) / 2).cast("int")), F.element_at(sorted_, (n / 2).cast("int") + 1)
    return F.when(n > 0, F.floor(F.abs((low + high) / 2)) * F.signum(low + high)).cast("long")


def upper_median(sorted_: Column) -> Column:
    return F.when(F.size(sorted_) > 0, F.element_at(sorted_, (F.size(sorted_) / 2).cast("int") + 1))


def wilson(successes: Column, n: Column) -> Column:
    """struct(low, high): the 95 % interval in [0, 1]; null for no trials."""
    p, z2 = successes / n, Z * Z
    middle, spread = p + z2 / (2 * n), F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * Z
    low = F.greatest((middle - spread) / (1 + z2 / n), F.lit(0.0))
    high = F.least((middle + spread) / (1 + z2 / n), F.lit(1.0))
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high")))


def exact_mcnemar(worse: Column, better: Column) -> Column:
    """Two-sided exact p of two discordant counts; 1 for none.

    Terms C(n, k) / 2^n by a recurrence in logarithms, so no count overflows.
    """
    n, k = (worse + better).cast("int"), F.least(worse, better).cast("int")
    start = F.struct((n * F.lit(-0.6931471805599453)).alias("term"), F.exp(n * F.lit(-0.6931471805599453)).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * F.aggregate(steps, start, add)["total"], F.lit(1.0)))


def decisions_needed(ceiling: Column) -> Column:
    return F.ceil(3.84 / ceiling - 3.84)


def gate(high: Column, n: Column, ceiling: float) -> Column:
    """unproven: fewer decisions than the ceiling needs; else pass if the interval is under it."""
    return F.when(n < decisions_needed(F.lit(ceiling)), "unproven").when(high <= ceiling, "pass").otherwise("fail")
