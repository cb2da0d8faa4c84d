"""A similarity join of names: all pairs of comparison keys at a threshold or above.

Keys that are alike are one first, with the number of rows that have them. Of each key the
grams of two letters are set in one order, rare ones first. With a similarity of t, two
keys are at most e edits apart, where e follows from the longer one's possible length; an
edit (letters that trade places count as one) touches at most three grams for each unit of
its cost, so keys within e edits share a gram among the first 3e + 1 of both. These
prefixes meet in an equi-join, lengths prune, a banded edit distance of Spark's own settles
most candidates, and only what lies between goes to exact distances.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import similarity as S
from tallyforge.functions.text import comparison_key

_EASE = 1e-9


def edits(length: int, threshold: float) -> int:
    """Edits between a key of some length and the longest one that can be so similar to it."""
    return floor((1 - threshold) * floor(length / threshold + _EASE) + _EASE)


def gram_width(threshold: float, longest: int = 4096) -> tuple[int, int]:
    """(letters of a gram, grams that an edit touches): two letters where every key has more
    grams than its edits touch, else single letters."""
    if not 0.5 < threshold <= 1:
        raise ValueError("a similarity join needs a threshold above a half")
    enough = all(3 * e < n - 1 for n in range(1, longest) if (e := edits(n, threshold)))
    return (2, 3) if enough else (1, 1)


def similar_pairs(names: DataFrame, name: str, threshold: float) -> DataFrame:
    """(a, b, similarity, rows_a, rows_b): pairs of different comparison keys a < b of a
    column that are at the threshold or above, with the rows that have each.

    Null names and names without a letter or digit take no part; rows of one key are alike
    (similarity 1) and aren't listed as pairs. An empty table gives an empty one.
    """
    width, touched = gram_width(threshold)
    keys = names.select(comparison_key(F.col(name)).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("rows"))
    keys = keys.withColumn("n", F.length("key"))
    most = F.floor((1 - threshold) * F.floor(F.col("n") / threshold + _EASE) + _EASE).cast("int")
    # the grams of a key, repeated ones told apart by their number
    at = F.sequence(F.lit(1), F.col("n") - (width - 1))
    grams = keys.withColumn("e", most).where(f"e > 0 AND n >= {width}").select("key", "n", "e", F.posexplode(F.transform(at, lambda i: F.substring("key", i, F.lit(width)))).alias("at", "gram"))
    grams = grams.groupBy("key", "n", "e", "gram").agg(F.count("*").alias("times")).select("key", "n", "e", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "times"), lambda k: F.concat("gram", k.cast("string")))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("held"))
    ordered = grams.join(common, "gram").groupBy("key", "n", "e").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("g"))
    prefix = ordered.select("key", "n", F.explode(F.slice("g", F.lit(1), touched * F.col("e") + 1)).alias("g")).select("key", "n", F.col("g.gram").alias("gram"))
    a = prefix.select(F.col("key").alias("a"), F.col("n").alias("m"), "gram")
    b = prefix.select(F.col("key").alias("b"), F.col("n").alias("n"), "gram")
    longer, shorter = F.greatest("m", "n"), F.least("m", "n")
    near = a.join(b, "gram").where((F.col("a") < F.col("b")) & (longer - shorter <= F.floor((1 - threshold) * longer + _EASE)))
    pairs = near.select("a", "b").distinct()
    within = S.keys_similarity(F.col("a"), F.col("b"), threshold)
    found = pairs.withColumn("similarity", within).where(F.col("similarity") >= threshold - _EASE)
    count = lambda side: keys.select(F.col("key").alias(side), F.col("rows").alias(f"rows_{side}"))
    return found.join(count("a"), "a").join(count("b"), "b").select("a", "b", "similarity", "rows_a", "rows_b")
