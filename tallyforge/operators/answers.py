"""Answers of a model, recorded or absent, joined back to what was asked.

Sources of answers are a recording (``replayed``) and the floor (``floor``), which
answers nothing and sends everything to review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.sources.runs import request_key


def batched(items: DataFrame, size: int, group: str, order: str) -> DataFrame:
    """Adds batch and place in it, ``size`` items at a time inside each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return items.withColumn("n", place).withColumn("batch", F.floor(F.col("n") / size).cast("long")).withColumn("place", (F.col("n") % size).cast("int")).drop("n")


def rejoined(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Each item (batch, id, text) with its answer or why it goes to review.

    ``answers`` (batch, id, echo, body): an id twice, an id missing, or an echo that is
    neither the item's text nor a beginning of it that fits no other item of its batch,
    leave the item without an answer. Beginnings are told apart by counting, per batch,
    the items that share them.
    """
    counted = answers.groupBy("batch", "id").agg(F.count("*").alias("given"), F.min("echo").alias("echo"), F.min("body").alias("body"))
    rows = items.join(counted, ["batch", "id"], "left")
    begins = (F.col("echo") != "") & F.startswith(F.col("text"), F.col("echo"))
    others = items.select("batch", F.col("text").alias("other")).distinct()
    asked = rows.where(begins & (F.col("text") != F.col("echo"))).select("batch", "id", "text", "echo")
    shared = asked.join(others, "batch").where(F.startswith(F.col("other"), F.col("echo")) & (F.col("other") != F.col("text"))).select("batch", "id").distinct().withColumn("shared", F.lit(True))
    rows = rows.join(shared, ["batch", "id"], "left")
    why = F.when(F.col("given").isNull(), "missing").when(F.col("given") > 1, "duplicate_id").when(F.col("text") == F.col("echo"), F.lit(None)).when(begins & F.col("shared").isNull(), F.lit(None)).otherwise("bad_echo")
    return rows.withColumn("review", why).withColumn("body", F.when(F.col("review").isNull(), F.col("body"))).drop("given", "shared")


def unknown_ids(items: DataFrame, answers: DataFrame) -> DataFrame:
    return answers.join(items, ["batch", "id"], "left_anti")


def replayed(prompts: DataFrame, recording: DataFrame) -> DataFrame:
    """Each prompt's (policy, prompt) recorded answer, by the digest of both: an answer
    given under another policy is no answer.

    A digest with two different answers, or a prompt without one, is an error.
    """
    one = recording.groupBy("key").agg(F.min("answer").alias("answer"), F.max("answer").alias("last"))
    checked = one.select("key", F.when(F.col("answer") == F.col("last"), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("two answers for "), F.col("key")))).alias("answer"))
    rows = prompts.withColumn("key", request_key(F.col("policy"), F.col("prompt"))).join(checked, "key", "left")
    return rows.select(*prompts.columns, F.when(F.col("answer").isNotNull(), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("no answer for "), F.col("key")))).alias("answer"))


def floor(groups: DataFrame) -> DataFrame:
    """Without a model: the cleaned name, category unknown, low confidence."""
    return groups.withColumns({"name": F.col("cleaned"), "category": F.lit("unknown"), "confidence": F.lit("low"), "review": F.lit("no_model")})


def apply_answer(groups: DataFrame) -> DataFrame:
    """An unknown category is never confident."""
    return groups.withColumn("confidence", F.when(F.col("category") == "unknown", "low").otherwise(X.confidence_level(F.col("confidence"))))
