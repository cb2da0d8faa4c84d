"""What guards prevent: policies of growing guard sets over traces with known verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REVIEW = "review_routing"


def ladder(traces: DataFrame) -> DataFrame:
    """(rung, policy, model, active): no model, no guards, then one observed guard more each."""
    seen = traces.select(F.explode("checks.guardrail").alias("g")).distinct()  # the closed list of guards
    active = F.array_sort(F.collect_list("g").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)))
    rungs = seen.select(active.alias("active")).select((F.size("active") + 1).alias("rung"), F.array_join("active", "+").alias("policy"), F.lit(True).alias("model"), "active")
    base = traces.sparkSession.sql("SELECT * FROM VALUES (0, 'floor', false, CAST(array() AS array<string>)), (1, 'unguarded', true, CAST(array() AS array<string>)) AS t(rung, policy, model, active)")
    return base.unionByName(rungs)


def verdicts(judged: DataFrame) -> DataFrame:
    """One verdict a trace; traces judged in several ways are unknown."""
    return judged.groupBy("trace").agg(F.min("verdict").alias("a"), F.max("verdict").alias("b")).select("trace", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("unknown").alias("verdict"))


def scorecard(traces: DataFrame, told: DataFrame, policies: DataFrame) -> DataFrame:
    """Per policy: answered, prevented, escaped, delivered, unknown. Policies are a short
    declared list that every trace is held against."""
    rows = traces.join(told, "trace").crossJoin(F.broadcast(policies))
    stopped = F.exists("checks", lambda c: F.array_contains("active", c["guardrail"]) & (c["outcome"] == "failed"))
    stopped = stopped | (F.array_contains("active", REVIEW) & (F.col("terminal") == "needs_review"))
    v, live = F.col("verdict"), F.col("model")
    return rows.withColumn("stopped", stopped).groupBy("rung", "policy").agg(
        F.count_if(live & ~F.col("stopped")).alias("answered"),
        F.count_if(live & F.col("stopped") & (v == "wrong")).alias("prevented"),
        F.count_if(live & ~F.col("stopped") & (v == "wrong")).alias("escaped"),
        F.count_if(live & ~F.col("stopped") & (v == "correct")).alias("delivered"),
        F.count_if(live & F.col("stopped") & (v == "unknown")).alias("unknown"),
    )
