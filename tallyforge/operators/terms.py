"""Named values of two documents: guards, refusals and a keyed full outer difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.passages import quote_in

OTHER = "other"
BASIS_LABELS = {"per_year": "per year", "per_month": "per month", "per_claim": "per claim", "one_off": "one-off"}


def guarded(terms: DataFrame, kinds: DataFrame) -> DataFrame:
    """Adds guard: the first check that a term fails, in order, else null.

    other, quote not in its passage, quote without the value, value of a wrong kind.
    ``kinds`` (term, allowed kinds array) is a declared list of terms.
    """
    rows = terms.join(F.broadcast(kinds), "term", "left")  # terms stay where they are: names are few, so by name most would be one task's
    shape = X.value_kind(F.col("value"))
    fits = F.col("kinds").isNull() | F.coalesce(F.array_contains("kinds", shape), F.lit(False)) | (F.array_contains("kinds", "text") & (F.trim("value") != ""))
    guard = (
        F.when(F.col("term") == OTHER, "other")
        .when(~quote_in(F.col("quote"), F.col("segment")), "quote_not_on_page")
        .when(~quote_in(F.col("value"), F.col("quote")), "quote_without_value")
        .when(~fits, "wrong_shape")
    )
    return rows.withColumn("guard", guard).drop("kinds")


def compare(terms: DataFrame, before: int, after: int, families: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(differences, refusals) of two documents' terms by (term, basis).

    Refused are keys stated more than once on a side, and before that terms of a family
    whose labels are disjoint between the sides. ``families`` (term, family) is a
    declared list. Values are compared as written; a delta is given where both are
    amounts.
    """
    sides = terms.where((F.col("term") != OTHER) & F.col("document").isin(before, after))
    was = F.col("document") == before
    keys = sides.groupBy("term", "basis").agg(
        F.count_if(was).alias("n_before"),
        F.count_if(~was).alias("n_after"),
        F.min(F.when(was, F.col("value"))).alias("v_before"),
        F.min(F.when(~was, F.col("value"))).alias("v_after"),
    )
    if families is not None:
        known = keys.join(families, "term", "left")
        # of each label whether either side has it, and of a family the same of any one label:
        # labels lie together since the join, and no set of them is gathered
        labels = known.where("family IS NOT NULL").groupBy("term", "family").agg(F.bool_or(F.col("n_before") > 0).alias("a"), F.bool_or(F.col("n_after") > 0).alias("b"))
        sides = labels.groupBy("family").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"), F.bool_or(F.col("a") & F.col("b")).alias("both"))
        split = sides.where("a AND b AND NOT both").select("family", F.lit(True).alias("split"))
        keys = known.join(split, "family", "left").withColumn("split", F.coalesce("split", F.lit(False))).drop("family")
    else:
        keys = keys.withColumn("split", F.lit(False))
    why = F.when(F.col("split"), "labelled_differently").when(F.greatest("n_before", "n_after") > 1, "stated_more_than_once")
    keys = keys.withColumn("why", why)
    refused = keys.where("why IS NOT NULL").select("term", "basis", F.greatest("n_before", "n_after").alias("readings"), "why")
    change = F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed").when(F.col("v_before") == F.col("v_after"), "unchanged").otherwise("changed")
    delta = F.when(F.col("change") == "changed", X.amount(F.col("v_after")) - X.amount(F.col("v_before")))
    rows = keys.where("why IS NULL").withColumn("change", change).withColumn("delta", delta)
    kind = F.when(F.col("delta").isNotNull(), "worked_out").otherwise("read")
    return rows.select("term", "basis", "change", "v_before", "v_after", "delta", kind.alias("kind")), refused


def _rank() -> Column:
    return F.when(F.col("change") == "changed", 0).when(F.col("change") == "added", 1).when(F.col("change") == "removed", 2).otherwise(3)


def ordered(differences: DataFrame) -> DataFrame:
    return differences.orderBy(_rank(), "term", "basis")


def placed(differences: DataFrame, name: str) -> DataFrame:
    """Adds each difference's place from 1 in that order."""
    from tallyforge.operators import audit

    return audit.numbered(differences, name, _rank(), "term", "basis")


def basis_label(c: Column) -> Column:
    out = F.replace(c, F.lit("_"), F.lit(" "))
    for name, label in BASIS_LABELS.items():
        out = F.when(c == name, label).otherwise(out)
    return out
