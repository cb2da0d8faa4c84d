"""Claims in public wording, held against measured reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = ("pack", "model", "eval_set")


def matching_reports(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports in each claim's scope, where a null field of the scope fits any."""
    fits = [F.col(f"scope_{f}").isNull() | (F.col(f"scope_{f}") == F.col(f)) for f in SCOPE]
    condition = fits[0]
    for more in fits[1:]:
        condition = condition & more
    return claims.join(reports, condition)


def effective_status(claims: DataFrame, reports: DataFrame, today: Column, scoring_version: int) -> DataFrame:
    """proven only with evidence in scope that is current, of this version and not expired."""
    found = matching_reports(claims, reports).groupBy("claim_id").agg(F.count("*").alias("reports"), F.bool_and(F.col("version") == scoring_version).alias("current"), F.bool_and(F.col("verdict") == "PASS").alias("passed"))
    rows = claims.join(found, "claim_id", "left")
    why = F.when(F.col("expires") <= today, "expired").when(F.col("reports").isNull(), "no_evidence").when(~F.col("current"), "other_version").when(~F.col("passed"), "not_passed")
    rows = rows.withColumn("why", F.when(F.col("status") == "proven", why))
    return rows.withColumn("effective", F.when(F.col("why").isNull(), F.col("status")).otherwise("unproven"))


def contradictions(assessed: DataFrame) -> DataFrame:
    """Pairs that contradict each other while both are effectively proven."""
    proven = assessed.where("effective = 'proven'")
    a = proven.select("claim_id", F.explode("contradicts").alias("other"))
    return a.join(proven.select(F.col("claim_id").alias("other")), "other").select(F.least("claim_id", "other").alias("a"), F.greatest("claim_id", "other").alias("b")).distinct()


def stale(measured: Column, now: Column, days: int = 30) -> Column:
    return F.datediff(now, measured) >= days


def inside(path: Column, published: list[str]) -> Column:
    out = F.lit(False)
    for p in published:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def projected(tree: DataFrame, published: list[str], withheld: list[str] = ()) -> DataFrame:
    """The files (path, content) of a tree that may be shown: inside a published place and
    inside none that is withheld. Paths that leave the tree are never shown."""
    from tallyforge.sources.packs import contained

    path = F.col("path")
    return tree.where(contained(path) & inside(path, list(published)) & ~inside(path, list(withheld)))
