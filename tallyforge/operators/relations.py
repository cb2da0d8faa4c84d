"""Metamorphic relations between two views (fixture, grp, entry) of assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def view(items: DataFrame) -> DataFrame:
    return items.groupBy("fixture", "grp").agg(F.array_sort(F.collect_set("entry")).alias("entries"))


def paired(views: DataFrame, relations: DataFrame) -> DataFrame:
    """(relation, grp, l, r) of declared relations (relation, left, right fixtures)."""
    none = F.array().cast("array<string>")
    a = relations.join(views.withColumnRenamed("fixture", "left"), "left").select("relation", "grp", F.col("entries").alias("l"))
    b = relations.join(views.withColumnRenamed("fixture", "right"), "right").select("relation", "grp", F.col("entries").alias("r"))
    return a.join(b, ["relation", "grp"], "full_outer").select("relation", "grp", F.coalesce("l", none).alias("l"), F.coalesce("r", none).alias("r"))


def one_sided(pairs: DataFrame) -> DataFrame:
    return pairs.select("relation", "grp", F.array_except("l", "r").alias("only_left"), F.array_except("r", "l").alias("only_right"))


def smallest_difference(pairs: DataFrame) -> DataFrame:
    """Per relation with a difference the first entry, by group, that only one side has; left before right."""
    diff = one_sided(pairs).select("relation", "grp", F.array_min("only_left").alias("a"), F.array_min("only_right").alias("b"))
    one = diff.select("relation", F.when(F.col("a").isNotNull(), F.struct("grp", F.lit("left").alias("side"), F.col("a").alias("entry"))).when(F.col("b").isNotNull(), F.struct("grp", F.lit("right").alias("side"), F.col("b").alias("entry"))).alias("d"))
    return one.where("d IS NOT NULL").groupBy("relation").agg(F.min("d").alias("difference"))


def invariant(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("relation").agg(F.bool_and(F.col("l") == F.col("r")).alias("holds"))


def swapped(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Roles trade places: left's a is right's b, and the other way round."""
    sides = pairs.where(F.col("grp").isin(a, b)).groupBy("relation").agg(*[F.max(F.when(F.col("grp") == g, F.col(s))).alias(f"{s}_{i}") for i, g in enumerate((a, b)) for s in ("l", "r")])
    return sides.select("relation", (F.col("l_0").eqNullSafe(F.col("r_1")) & F.col("l_1").eqNullSafe(F.col("r_0"))).alias("holds"))


def one_removed(pairs: DataFrame) -> DataFrame:
    """Right lacks exactly one group of left's, and the others are equal."""
    gone = (F.size("l") > 0) & (F.size("r") == 0)
    told = pairs.groupBy("relation").agg(F.count_if(gone).alias("gone"), F.bool_and(gone | (F.col("l") == F.col("r"))).alias("rest"))
    return told.select("relation", ((F.col("gone") == 1) & F.col("rest")).alias("holds"))


def controlled(pairs: DataFrame, declared: DataFrame) -> DataFrame:
    """Only the declared (relation, grp, side, entry) changes appear, and all of them."""
    moved = one_sided(pairs)
    every = moved.select("relation", "grp", F.lit("left").alias("side"), F.explode("only_left").alias("entry")).unionByName(moved.select("relation", "grp", F.lit("right").alias("side"), F.explode("only_right").alias("entry")))
    both = declared.select("relation", "grp", "side", "entry", F.lit(1).alias("want")).join(every.withColumn("seen", F.lit(1)), ["relation", "grp", "side", "entry"], "full_outer")
    return both.groupBy("relation").agg(F.count_if(F.col("seen").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("extra")).withColumn("holds", (F.col("missing") == 0) & (F.col("extra") == 0))


def unjudgeable(items: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations with an item, on either side, that went to review."""
    routed = items.where("asserted = 'review'").select("fixture").distinct()
    sides = relations.select("relation", F.explode(F.array("left", "right")).alias("fixture"))
    return sides.join(routed, "fixture").select("relation").distinct()
