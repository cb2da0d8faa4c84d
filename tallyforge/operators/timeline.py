"""Obligations to a dated, merged and ordered timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.operators.passages import opening_date, opening_rows

# How a due-date row begins.
LABELS = ("due date", "date due", "payment due")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def label_date(text: Column) -> Column:
    """The date of a due-date row, else null."""
    low = F.lower(text)
    rest = F.lit(None).cast("string")
    for label in LABELS:
        rest = F.when(low.startswith(label), F.substring(text, F.lit(len(label) + 1), F.length(text))).otherwise(rest)
    return D.first_full_date(rest)


def document_dates(segments: DataFrame) -> DataFrame:
    """(document, letter_date, pointed): the date that opens each document, and that of its
    first due-date row that has one, in one pass."""
    rows = opening_rows(segments, pointed=label_date(F.col("text")))
    first = F.min_by("pointed", F.when(F.col("pointed").isNotNull(), F.col("ordinal")))
    return rows.groupBy("document").agg(opening_date(), first.alias("pointed"))


def dated(obligations: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds due (date, kind) to obligations (seq, document, kind, party, deadline, anchor, …).

    Each counts from its own document's date; one that points at a date elsewhere takes
    the document's due-date row, which is read and not computed.
    """
    rows = obligations.join(document_dates(segments), "document", "left")
    rows = rows.withColumn("due", D.resolve_deadline(F.col("deadline"), F.col("anchor"), F.col("letter_date")))
    pointed = F.col("due.date").isNull() & D.points_at_a_date(F.col("deadline")) & F.col("pointed").isNotNull()
    rows = rows.withColumn("dated_by_row", F.coalesce(pointed, F.lit(False)))
    due = F.when(F.col("dated_by_row"), F.struct(F.col("pointed").alias("date"), F.lit("read").alias("kind"))).otherwise(F.col("due"))
    return rows.withColumn("due", due).drop("pointed")


def merged(obligations: DataFrame) -> DataFrame:
    """One row per kind, party, deadline and anchor (the last three in any ASCII case):
    the first one's words and due date, all evidence in order, low confidence if any is."""
    keys = [F.col("kind"), *(ascii_lower(F.col(c)).alias(f"k_{c}") for c in ("party", "deadline", "anchor"))]
    first = F.struct("party", "deadline", "anchor", "due", "confidence")
    out = obligations.groupBy(*keys).agg(
        F.min_by(first, "seq").alias("first"),
        F.array_sort(F.collect_set(F.struct("document", "ordinal"))).alias("evidence"),
        F.bool_or(F.col("confidence") == "low").alias("low"),
    )
    return out.select("kind", "first.party", "first.deadline", "first.anchor", "first.due", F.when(F.col("low"), "low").otherwise(F.col("first.confidence")).alias("confidence"), "evidence")


def ordered(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy(F.asc_nulls_last("due.date"), "kind", "party")


def confirm(obligations: DataFrame, document: int, given: Column) -> DataFrame:
    """Counts one document's deadlines from a date that a person gave."""
    due = D.resolve_deadline(F.col("deadline"), F.col("anchor"), given, "yours")
    return obligations.withColumn("due", F.when(F.col("document") == document, due).otherwise(F.col("due")))
