"""Grouping payments by merchant words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X


def with_stem(payments: DataFrame) -> DataFrame:
    # the stem's every use of the cleaned name is of one value, not of the cleaning again
    named = F.transform(F.array(X.clean_merchant(F.col("raw_merchant"))), lambda c: F.struct(c.alias("cleaned"), X.merchant_stem(c).alias("stem")))
    return payments.withColumn("named", F.element_at(named, 1)).withColumns({"cleaned": F.col("named.cleaned"), "stem": F.col("named.stem")}).drop("named")


def _spellings(payments: DataFrame) -> DataFrame:
    """(raw_merchant, seq, n, cleaned, stem): a row a spelling, with its first row's ``seq``.
    Names are far fewer than payments, so they are cleaned and sorted as such."""
    return with_stem(payments.groupBy("raw_merchant").agg(F.min("seq").alias("seq"), F.count("*").alias("n")))


def merchant_groups(payments: DataFrame) -> DataFrame:
    """(stem, cleaned, raw_first, n): one row a group, named after its first row by ``seq``."""
    return _spellings(payments).groupBy("stem").agg(F.min_by("cleaned", "seq").alias("cleaned"), F.min_by("raw_merchant", "seq").alias("raw_first"), F.sum("n").alias("n"))


def grouped(payments: DataFrame) -> DataFrame:
    """The payments with their group's ``merchant`` (its cleaned first name)."""
    held = _spellings(payments)
    names = held.groupBy("stem").agg(F.min_by("cleaned", "seq").alias("merchant"))
    return payments.join(held.join(names, "stem").select("raw_merchant", "cleaned", "stem", "merchant"), "raw_merchant")
