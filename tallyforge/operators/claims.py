"""What becomes of each claim in a model's answer: accepted, referred, or changed on the way.

A ledger row is (claim_id, parent_id, step, batch, item, candidate_index, kind, source,
candidate as JSON, checks array<struct<guardrail, outcome, detail>>, terminal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.passages import grants_without_requiring

#: What a person reads about a passage that offers and doesn't ask.
OFFERED = "Nothing is demanded here. Whoever reads it may take it up or leave it."
#: What a person reads about an item by the reason of its review.
REASONS = {"missing": "No answer came for this one.", "duplicate_id": "Two answers came for this one.", "bad_echo": "The answer was about something else.", "bad_shape": "The answer wasn't in the form asked for.", "truncated": "The answer was cut off.", "low_confidence": "The answer was unsure."}


def claim_id(*parts: Column) -> Column:
    """The same claim of the same answer has the same id in every run."""
    return F.concat(F.lit("claim-"), F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(16)))


def _check(guardrail: str, outcome: Column, detail: Column | None = None) -> Column:
    return F.struct(F.lit(guardrail).alias("guardrail"), outcome.alias("outcome"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def ledger(answers: DataFrame) -> DataFrame:
    """A row for each claim of answers (parent_id, step, batch, item, text, confidence,
    claims array<struct>), in the answer's order.

    An answer paired with its passage has passed schema and pairing. Claims read out of a
    passage that only permits fail review routing and go to a person, others are accepted.
    """
    rows = answers.withColumn("offered", grants_without_requiring(F.col("text"))).select("*", F.posexplode("claims").alias("at", "claim"))
    passed = F.lit("passed")
    checks = F.array(_check("schema", passed), _check("pairing", passed), _check("review_routing", F.when(F.col("offered"), "failed").otherwise("passed")))
    index = F.col("at") + 1
    return rows.select(
        claim_id(F.col("step"), F.col("batch"), F.col("item"), index).alias("claim_id"),
        "parent_id",
        "step",
        "batch",
        "item",
        index.alias("candidate_index"),
        F.lit("obligation").alias("kind"),
        F.col("text").alias("source"),
        F.to_json("claim").alias("candidate"),
        checks.alias("checks"),
        F.when(F.col("offered"), "needs_review").otherwise("accepted").alias("terminal"),
    )


def obligations(answers: DataFrame) -> DataFrame:
    """The accepted claims as rows with their passage's confidence and place."""
    asked = answers.where(~grants_without_requiring(F.col("text")))
    keep = [c for c in answers.columns if c not in ("claims", "confidence")]
    return asked.select(*keep, "confidence", F.inline("claims"))


def offered(answers: DataFrame) -> DataFrame:
    """(parent_id, subject, reason): one entry for each passage that claims were read out
    of though it only permits."""
    held = answers.where(grants_without_requiring(F.col("text")) & (F.size("claims") > 0))
    return held.select("parent_id", F.col("text").alias("subject"), F.lit(OFFERED).alias("reason"))


def route_review(groups: DataFrame) -> DataFrame:
    """Adds routed (kept or review) and why to groups (role, reason, answer).

    A classification that is merely unsure stays one, since its low confidence is shown
    with it; everything else with a reason is for a person.
    """
    unsure = (F.col("role") == "classify") & (F.col("reason") == "low_confidence") & F.col("answer").isNotNull()
    words = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    kept = F.col("reason").isNull() | unsure
    return groups.withColumns({"routed": F.when(kept, "kept").otherwise("review"), "why": F.when(~kept, F.coalesce(F.try_element_at(words, F.col("reason")), F.col("reason")))})


def declined(spend: DataFrame, periodic: DataFrame, *keys: str) -> DataFrame:
    """Adds kind_from to spend that no series was found in: payments that look periodic
    all the same make its confidence low."""
    rows = spend.join(periodic.select(*keys, "periodic"), list(keys), "left").withColumn("periodic", F.coalesce("periodic", F.lit(False)))
    return rows.withColumns({"confidence": F.when(F.col("periodic"), "low").otherwise(F.col("confidence")), "kind_from": F.when(F.col("periodic"), "cadence_despite_periodic").otherwise("cadence")}).drop("periodic")


def derivation_checked(rows: DataFrame, stage: str, faithful: Column, derived: Column) -> DataFrame:
    """Adds the check of a derivation to ledger rows.

    A claim that was accepted and then derived otherwise than faithfully is an error of
    the pipeline; what was contained before stays contained.
    """
    same = faithful.eqNullSafe(derived)
    told = F.when(same, F.lit(stage)).otherwise(F.concat(F.lit(f"{stage}: should be "), F.coalesce(faithful, F.lit("none")), F.lit(", was "), F.coalesce(derived, F.lit("none"))))
    added = _check("deterministic_derivation", F.when(same, "passed").otherwise("changed_value"), told)
    terminal = F.when(~same & (F.col("terminal") == "accepted"), "pipeline_introduced_error").otherwise(F.col("terminal"))
    return rows.withColumns({"checks": F.array_append("checks", added), "terminal": terminal})
