"""Positioned pages and monospaced blocks to passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import geometry
from tallyforge.sources.runs import spread


def passages(rows: DataFrame) -> DataFrame:
    """(document, page, ordinal, text) of fragments with row_y, as ``row_clusters`` gives.

    Pages are cut into paragraphs each by itself, since heights start anew on every page;
    ordinals count on through a document.
    """
    cut = geometry.paragraph_breaks(geometry.lines(rows))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("row_y")).alias("y"), "line")))
    held = cut.groupBy("doc", "page", "paragraph").agg(parts.alias("parts"))
    told = held.select("doc", "page", "paragraph", X.join_lines(F.transform("parts", lambda p: p["line"])).alias("text"))
    order = Window.partitionBy("doc").orderBy("page", "paragraph")
    return told.select(F.col("doc").alias("document"), "page", (F.row_number().over(order) - 1).alias("ordinal"), "text")


def placed_words(blocks: DataFrame) -> DataFrame:
    """Fragments (doc, page, frag_no, text, x, right, y, row_y) of monospaced blocks (doc,
    page, text): each word at its characters' offset, each line a row clear of the next."""
    lines = blocks.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.split("line", " ")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,x:int>>").alias("found"))

    def add(acc: Column, w: Column) -> Column:
        found = F.when(F.trim(w) == "", acc["found"]).otherwise(F.array_append(acc["found"], F.struct(w.alias("text"), acc["at"].alias("x"))))
        return F.struct((acc["at"] + F.length(w) + 1).alias("at"), found.alias("found"))

    each = lines.select("doc", "page", "line_no", F.posexplode(F.aggregate(words, start, add)["found"]).alias("k", "w"))
    y = (-F.col("line_no") * (geometry.ROW_TOLERANCE + 1)).cast("double")
    return each.select("doc", "page", (F.col("line_no") * 100_000 + F.col("k")).cast("long").alias("frag_no"), "w.text", F.col("w.x").cast("double").alias("x"), (F.col("w.x") + F.length("w.text")).cast("double").alias("right"), y.alias("y"), y.alias("row_y"))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc, page, reading, part, rows): how a monospaced block reads, and its cells.

    ``columns`` where a corridor that no line crosses parts it, left before right;
    ``table`` where one block has rows of several cells; else ``prose``.
    """
    words = spread(placed_words(blocks), "doc", "page")  # once, for all that a page is asked
    cut = geometry.column_cut(words, geometry.channels(words, "doc", "page"))
    parted = words.join(geometry.by_page(cut), ["doc", "page"], "left")
    part = F.when(F.col("at").isNull() | (F.col("right") <= F.col("at")), 0).otherwise(1)
    keyed = parted.select(F.struct("doc", F.col("page").alias("block"), part.alias("part"), F.col("at").isNotNull().alias("cut")).alias("doc"), "page", "frag_no", "text", "x", "right", "row_y")
    cells = geometry.cells(keyed, geometry.channels(keyed, "doc", "page"))
    rows = cells.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("row_y")).alias("y"), "cells"))).alias("r")).select("doc", F.transform("r", lambda x: x["cells"]).alias("rows"))
    reading = F.when(F.col("doc.cut"), "columns").when(geometry.is_tabular(F.col("rows")), "table").otherwise("prose")
    return rows.select("doc.doc", F.col("doc.block").alias("page"), reading.alias("reading"), "doc.part", "rows")
