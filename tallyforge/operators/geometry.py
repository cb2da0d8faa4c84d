"""Positioned text: rows, columns, paragraphs, statement tables and second readings.

Fragments (doc, page, frag_no, text, x, right, y) arrive as tables; y grows upward. One
page is one group, which is what a page's fragments bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_TOLERANCE = 3.0
CHANNEL_SHARE = 0.05
PARAGRAPH = 1.4
SAME_LINE = 0.01
LINE_GAP = 0.05
FAR_LEFT = 0.05


def row_heights(heights: Sequence[float | None]) -> list[tuple[int, float | None]]:
    """(row, its height) of each fragment: it joins the first row within the tolerance, else
    begins one. Rows are looked up by steps of over a tolerance, so a page of many rows
    costs no more a fragment; what has no height is a row of its own."""
    step = ROW_TOLERANCE + 1
    begun: dict[int, list[int]] = {}
    tops: list[float | None] = []
    out = []
    for y in heights:
        near = None
        if y is not None and math.isfinite(y):
            at = math.floor(y / step)
            near = min((r for k in (at - 1, at, at + 1) for r in begun.get(k, ()) if abs(y - tops[r]) <= ROW_TOLERANCE), default=None)
            if near is None:
                begun.setdefault(at, []).append(len(tops))
        if near is None:
            near = len(tops)
            tops.append(None if y is not None and math.isnan(y) else y)
        out.append((near, tops[near]))
    return out


def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
    """One page with row_y: each fragment, in order, joins the first row within the tolerance."""
    pdf = pdf.sort_values("frag_no", kind="stable")
    return pdf.assign(row_y=[y for _, y in row_heights(pdf["y"].tolist())])


def placed(fragments: DataFrame) -> DataFrame:
    columns = [c for c in ("doc", "page", "frag_no", "text", "x", "right", "y") if c in fragments.columns]
    return fragments.where(F.trim("text") != "").select(*columns)


def row_clusters(fragments: DataFrame) -> DataFrame:
    """Adds row_y, page by page."""
    shown = placed(fragments)
    schema = ", ".join(f"{c} {t}" for c, t in shown.dtypes) + ", row_y double"
    return shown.groupBy("doc", "page").applyInPandas(clustered, schema)


def lines(rows: DataFrame) -> DataFrame:
    """(doc, page, row_y, line): fragments of a row by x, one space between."""
    parts = F.array_sort(F.collect_list(F.struct("x", F.trim("text").alias("text"))))
    return rows.groupBy("doc", "page", "row_y").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("line"))


def by_page(found: DataFrame) -> DataFrame:
    """What is joined to the fragments of its pages: it has as many rows as there are pages,
    so it is never broadcast, however small Spark takes what was exploded to be."""
    return found.hint("merge")


def channels(fragments: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, width): gaps between fragments, swept left to right over the farthest
    right edge so far, wider than a share of the page."""
    order = Window.partitionBy(*keys).orderBy("x", "right")
    reach = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*keys)
    swept = fragments.withColumn("reach", reach).withColumn("width_all", F.max("right").over(whole) - F.min("x").over(whole))
    gap = F.col("x") - F.col("reach")
    return swept.where((F.col("width_all") > 0) & (gap > F.col("width_all") * CHANNEL_SHARE)).select(*keys, F.col("reach").alias("at"), gap.alias("width"))


def column_cut(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, page, at): the widest channel with two rows on either side that is not a gap
    inside a table, where both sides span every row. One cut, never more."""
    cand = rows.join(by_page(found), ["doc", "page"])
    left = F.col("right") <= F.col("at")
    sides = cand.groupBy("doc", "page", "at", "width").agg(F.countDistinct(F.when(left, F.col("row_y"))).alias("l"), F.countDistinct(F.when(~left, F.col("row_y"))).alias("r"), F.countDistinct("row_y").alias("n"))
    good = sides.where("l >= 2 AND r >= 2 AND NOT (l = n AND r = n)")
    return good.groupBy("doc", "page").agg(F.max_by("at", F.struct("width", (-F.col("at")).alias("m"))).alias("at"))


def cells(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, page, row_y, cells): a row's text by the channels' bands, empty ones kept."""
    edges = found.groupBy("doc", "page").agg(F.array_sort(F.collect_set("at")).alias("edges"))
    banded = rows.join(by_page(edges), ["doc", "page"], "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    banded = banded.withColumn("band", F.size(F.filter("edges", lambda e: F.col("x") >= e)))
    grouped = banded.groupBy("doc", "page", "row_y").agg(F.first("edges").alias("edges"), F.array_sort(F.collect_list(F.struct("band", "x", F.trim("text").alias("text")))).alias("f"))
    cell = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.array_join(F.transform(F.filter("f", lambda p: p["band"] == b), lambda p: p["text"]), " "))
    return grouped.select("doc", "page", "row_y", cell.alias("cells"))


def is_tabular(rows_of_cells: Column) -> Column:
    return F.size(F.filter(rows_of_cells, lambda r: F.size(F.filter(r, lambda c: c != "")) > 1)) >= 2


def paragraph_breaks(page_lines: DataFrame) -> DataFrame:
    """Adds paragraph: a gap of over 1.4 times the upper median gap begins the next one."""
    order = Window.partitionBy("doc", "page").orderBy(F.desc("row_y"))
    gap = F.lag("row_y").over(order) - F.col("row_y")
    gapped = page_lines.withColumn("gap", gap)
    page = Window.partitionBy("doc", "page")
    ranked = gapped.withColumn("k", F.row_number().over(page.orderBy(F.asc_nulls_last("gap")))).withColumn("n", F.count("gap").over(page))
    joined = ranked.withColumn("usual", F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("gap"))).over(page))
    starts = F.when(F.col("gap") > PARAGRAPH * F.col("usual"), 1).otherwise(0)
    return joined.withColumn("paragraph", F.sum(starts).over(order)).drop("gap", "usual", "k", "n")


def money_column(right: Column, paid_out: Column, paid_in: Column, balance: Column) -> Column:
    """The column whose right edge is nearest, within a third of the narrowest gap."""
    near = F.array_min(F.array(*[F.struct(F.abs(right - edge).alias("d"), F.lit(i).alias("i")) for i, edge in enumerate((paid_out, paid_in, balance))]))
    narrow = F.least(F.abs(paid_in - paid_out), F.abs(balance - paid_in))
    names = F.array(F.lit("paid_out"), F.lit("paid_in"), F.lit("balance"))
    return F.when(near["d"] <= narrow / 3, F.element_at(names, near["i"] + 1))


def sign_convention(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, convention) from running balances (order ``seq``): what every voting pair of
    rows agrees on, with two votes at least; else null."""
    delta = F.col("balance") - F.lag("balance").over(Window.partitionBy(*keys).orderBy("seq"))
    votes = rows.withColumn("vote", sign_vote(delta, F.col("amount"))).groupBy(*keys).agg(F.count_if(F.col("vote") == "adds").alias("adds"), F.count_if(F.col("vote") == "subtracts").alias("subtracts"))
    return votes.withColumn("convention", convention_of(F.col("adds"), F.col("subtracts")))


def sign_vote(step: Column, amount: Column) -> Column:
    """What a step of the balance says of the sign of its amount."""
    return F.when((step == amount) & (step == -amount), F.lit(None)).when(step == amount, "adds").when(step == -amount, "subtracts")


def convention_of(adds: Column, subtracts: Column) -> Column:
    return F.when((adds >= 2) & (subtracts == 0), "adds").when((subtracts >= 2) & (adds == 0), "subtracts")


def direction_of(convention: Column, amount: Column) -> Column:
    out = (convention == "adds") == (amount < 0)
    return F.when(convention.isNull(), F.lit(None)).when(out, "debit").otherwise("credit")


def reading_lines(placed: DataFrame, *keys: str) -> DataFrame:
    """Lines of placed words: words of one height with small gaps, the least confidence."""
    order = Window.partitionBy(*keys).orderBy(F.desc("top"), "left")
    new = (F.abs(F.lag("top").over(order) - F.col("top")) > SAME_LINE) | (F.col("left") - F.lag("right").over(order) > LINE_GAP)
    marked = placed.withColumn("new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("line_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_sort(F.collect_list(F.struct("left", F.trim("text").alias("text"))))
    return numbered.groupBy(*keys, "line_no").agg(F.max("top").alias("top"), F.min("left").alias("left"), F.max("right").alias("right"), F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.min("confidence").alias("confidence"))


def disagreements(one: DataFrame, other: DataFrame) -> DataFrame:
    """Lines of one reading that the nearest line of the other, at their height, doesn't repeat."""
    from tallyforge.functions.text import letters

    b = other.select("doc", F.col("top").alias("b_top"), F.col("left").alias("b_left"), F.col("text").alias("b_text"))
    a = one.select("doc", "line_no", "top", "left", "text")
    # heights of one hundredth are buckets; neighbours of a bucket may be as near
    cell = lambda c: F.floor(c / SAME_LINE)
    near = a.withColumn("cell", F.explode(F.array(*[cell(F.col("top")) + d for d in (-1, 0, 1)]))).join(b.withColumn("cell", cell(F.col("b_top"))), ["doc", "cell"])
    near = near.where(F.abs(F.col("b_top") - F.col("top")) <= SAME_LINE + 1e-12)
    best = near.groupBy("doc", "line_no").agg(F.min(F.struct(F.abs(F.col("b_left") - F.col("left")).alias("gap"), "b_text")).alias("best"))
    joined = a.join(best, ["doc", "line_no"], "left").withColumn("also", F.when(F.col("best.gap") <= FAR_LEFT, F.col("best.b_text")))
    return joined.where(F.col("also").isNull() | (letters(F.col("text")) != letters(F.col("also")))).select("doc", "line_no", "top", "text", "also")


def readable(reading: DataFrame, *keys: str) -> DataFrame:
    """Refused where over a quarter of the lines are less than half certain."""
    told = reading.groupBy(*keys).agg(F.count("*").alias("lines"), F.count_if(F.col("confidence") < 0.5).alias("doubtful"))
    return told.withColumn("refused", F.col("doubtful") > 0.25 * F.col("lines"))
