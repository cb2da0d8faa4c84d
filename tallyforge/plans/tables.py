"""The engine's relations over the given tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payments: a merchant is a user and an event type; errors are credits."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.lit("all").alias("account"),
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("merchant"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("event_type") == "error", "credit").otherwise("debit").alias("direction"),
    )


PAYMENTS = """(SELECT event_id AS seq, user_id::VARCHAR || '-' || event_type AS merchant, ts::DATE AS date,
  value::DECIMAL(18,2) AS amount, CASE WHEN event_type = 'error' THEN 'credit' ELSE 'debit' END AS direction FROM events)"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments: a merchant is a customer and a priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.lit("all").alias("account"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority").alias("merchant"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "credit").otherwise("debit").alias("direction"),
    )


PURCHASES = """(SELECT o_orderkey AS seq, o_custkey::VARCHAR || '-' || o_orderpriority AS merchant, o_orderdate::DATE AS date,
  o_totalprice::DECIMAL(18,2) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS direction FROM orders)"""


def stated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as terms of two documents, by line status."""
    li = table(spark, sf_dir, "lineitem")
    value = F.concat(F.lit("£"), F.col("l_quantity").cast("decimal(18,2)").cast("string"))
    return li.select(
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("document"),
        F.concat_ws("_", F.col("l_orderkey").cast("string"), "l_returnflag").alias("term"),
        F.concat(F.lit("line_"), (F.col("l_linenumber") % 3).cast("string")).alias("basis"),
        value.alias("value"),
        F.concat(F.lit("The amount is "), value).alias("quote"),
        "l_returnflag",
        "l_orderkey",
    )


TERMS = """(SELECT CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS document, l_orderkey::VARCHAR || '_' || l_returnflag AS term,
  'line_' || (l_linenumber % 3)::VARCHAR AS basis, '£' || l_quantity::DECIMAL(18,2)::VARCHAR AS value, l_returnflag, l_orderkey FROM lineitem)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a rule over documents, as scored decisions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    said = F.when(F.col("n_chars") < 300, "review").when((F.col("n_chars") < 4000) & (F.col("lang") != "de"), "class").otherwise("other")
    return rows.select("doc_id", (F.col("quality") == 1).alias("expected"), said.alias("asserted"), F.array("lang", "source").alias("strata"), "source", "n_chars", "toxic")


SCORED = """(SELECT doc_id, quality = 1 AS expected, CASE WHEN n_chars < 300 THEN 'review' WHEN n_chars < 4000 AND lang <> 'de' THEN 'class' ELSE 'other' END AS asserted,
  lang, source, n_chars, toxic FROM labels JOIN documents USING (doc_id))"""
