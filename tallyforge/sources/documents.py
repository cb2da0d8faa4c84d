"""Text files as documents, with the place of each in its run's inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and what they hold.
MEDIA = {"txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "heic": "image/heic"}


def media_type(path: str) -> str | None:
    return MEDIA.get(path.rsplit(".", 1)[-1].lower())


def media_types(path: Column) -> Column:
    """The media type of a path by its lower-cased extension, null for others."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.try_element_at(known, F.lower(F.substring_index(path, ".", -1)))


def qualified(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths as a scan tells them."""
    conf, kind = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = [kind(p) for p in paths]
    return [p.getFileSystem(conf).makeQualified(p).toUri().toString() for p in found]


def placed(spark: SparkSession, rows: DataFrame, paths: Sequence[str], place: str) -> DataFrame:
    """``rows`` (with src_file) with each file's place in the list of paths; a file that is
    given twice is there twice. The list is the call's own, and so short."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  scans and paths spell local ones differently
    listed = spark.createDataFrame(list(enumerate(qualified(spark, paths))), f"{place} int, given string")
    return rows.join(F.broadcast(listed), plain("src_file") == plain("given")).drop("given")


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(document, path, text) of text and Markdown files, numbered in the order given."""
    for path in paths:
        if media_type(path) not in ("text/plain", "text/markdown"):
            raise ValueError(f"{path}: give positioned text of other kinds as a table")
    raw = spark.read.text(sorted(set(paths)), wholetext=True).select("value", F.col("_metadata.file_path").alias("src_file"))
    return placed(spark, raw, paths, "document").select("document", F.element_at(F.array(*map(F.lit, paths)), F.col("document") + 1).alias("path"), F.col("value").alias("text"))
