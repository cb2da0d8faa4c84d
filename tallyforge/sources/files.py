"""A sink of whole files: each row becomes a file of its own, all of them or none.

The data source ``whole_files`` takes rows (name, content). Tasks write below a staging
folder, each attempt into a folder of its own; when all have succeeded, the driver
publishes each task's folder by one rename, and where any failed it deletes the staging
folder. So readers see the files of whole writes only, and a file's path is
``root/part-N/name``; rows that a user has brought together (``repartition`` by a column)
lie under the same part.
"""

from __future__ import annotations

import os
import posixpath
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

STAGING = "_staging"


class _Place:
    """The few file operations that a sink needs, in a local or shared folder or a store."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root or root.startswith("file:")
        if self.local:
            self.root = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
        else:
            from pyarrow import fs

            self.store, self.root = fs.FileSystem.from_uri(root)
            self.scheme = root.split("://", 1)[0]

    def write(self, name: str, content: bytes) -> None:
        path = posixpath.join(self.root, name)
        if self.local:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "xb") as out:
                out.write(content)
            return
        self.store.create_dir(posixpath.dirname(path), recursive=True)
        with self.store.open_output_stream(path) as out:
            out.write(content)

    def entries(self, path: str) -> list[tuple[str, str, bool]]:
        """(name, path, whether it is a folder) of what a folder holds."""
        if self.local:
            with os.scandir(path) as found:
                return [(e.name, e.path, e.is_dir()) for e in found]
        from pyarrow import fs

        return [(f.base_name, f.path, f.type == fs.FileType.Directory) for f in self.store.get_file_info(fs.FileSelector(path))]

    def read(self, path: str) -> bytes:
        if self.local:
            with open(path, "rb") as held:
                return held.read()
        with self.store.open_input_stream(path) as held:
            return held.read()

    def uri(self, path: str) -> str:
        return f"file://{path}" if self.local else f"{self.scheme}://{path}"

    def rename(self, name: str, to: str) -> None:
        a, b = (posixpath.join(self.root, x) for x in (name, to))
        os.rename(a, b) if self.local else self.store.move(a, b)

    def delete(self, name: str) -> None:
        path = posixpath.join(self.root, name)
        if self.local:
            shutil.rmtree(path, ignore_errors=True)
            return
        from pyarrow import fs

        if self.store.get_file_info(path).type != fs.FileType.NotFound:
            self.store.delete_dir(path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int
    part: int


class _FilesWriter(DataSourceWriter):
    def __init__(self, root: str, check: str) -> None:
        self.root, self.check, self.run = root, check, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        folder, place, n = f"{STAGING}-{self.run}/{part}-{uuid.uuid4().hex}", _Place(self.root), 0
        for name, content in rows:
            if not safe_name(name):
                raise ValueError(f"no name of a file below the root: {name!r}")
            if self.check == "self_contained":
                from tallyforge.operators.reports import assert_self_contained

                assert_self_contained(content or "")
            place.write(f"{folder}/{name}", (content or "").encode())
            n += 1
        return _Written(folder, n, part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        place = _Place(self.root)
        for m in messages:
            if m is not None and m.files:
                place.rename(m.folder, f"part-{m.part:05d}-{self.run}")
        place.delete(f"{STAGING}-{self.run}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _Place(self.root).delete(f"{STAGING}-{self.run}")


class WholeFiles(DataSource):
    """``df.write.format("whole_files").option("path", root)``, appending only."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite or schema.names != ["name", "content"]:
            raise ValueError("whole files are rows (name, content), and are never overwritten")
        return _FilesWriter(self.options["path"], self.options.get("check", ""))


def safe_name(name: str | None) -> bool:
    """Whether a name stays below its folder, and is none of the sink's own."""
    parts = (name or "").split("/")
    return all(p not in ("", ".", "..") for p in parts) and not parts[0].startswith("_") and "\\" not in name and "\0" not in name


def tasks(spark: SparkSession) -> int:
    """So many tasks write and read files, which are small in bytes: by those alone few would."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_files(rows: DataFrame, root: str, check: str = "") -> None:
    """Write (name, content) rows as files below ``root``, wholly or not at all.

    A null content is an empty file; a name that leaves the folder, or stands twice in one
    part, fails the whole write. With ``check="self_contained"`` each content must be a
    page that loads nothing.
    """
    spark = rows.sparkSession
    spark.dataSource.register(WholeFiles)
    rows.select("name", "content").write.format("whole_files").mode("append").options(path=root, check=check).save()


def whole_texts(spark: SparkSession, root: str) -> DataFrame:
    """(value, path) of all files below ``root`` that aren't empty or hidden.

    Tasks list the folders and read the files, many a task: the driver holds no names, and
    small files cost no split each. What lies below each entry of ``root`` is listed by one
    task; the files are then dealt out by their paths.
    """
    n = tasks(spark)

    def listed(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = _Place(root)
            for batch in batches:
                for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = _below(place, path, deep) if folder else iter([(path, False)])
                    while some := list(islice(found, 10_000)):
                        paths, folders = zip(*some)
                        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])

        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Place(root)
        for batch in batches:
            held: list[tuple[str, bytes]] = []
            size = 0
            for path in batch.column(0).to_pylist():
                if content := place.read(path):
                    held.append((path, content))
                    size += len(content)
                if size > READ_BYTES:
                    yield _contents(place, held)
                    held, size = [], 0
            if held:
                yield _contents(place, held)

    top = spark.range(1).select(F.lit(_Place(root).root).alias("path"), F.lit(True).alias("folder"))
    for deep in (False, True):
        top = top.mapInArrow(listed(deep), "path string, folder boolean").repartition(n, "path")
    return top.select("path").mapInArrow(read, "value binary, path string").select(F.col("value").cast("string").alias("value"), "path")


#: Bytes of files that a task holds at once, the last file's own apart.
READ_BYTES = 8 << 20


def _contents(place: _Place, held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([c for _, c in held], pa.binary()), pa.array([place.uri(p) for p, _ in held], pa.string())], ["value", "path"])


def _below(place: _Place, path: str, deep: bool) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of a folder's entries; or of all files below it."""
    open_folders = [path]
    while open_folders:
        for name, at, folder in place.entries(open_folders.pop()):
            if name.startswith((".", "_")):  # of writes that aren't finished, and the like
                continue
            if folder and deep:
                open_folders.append(at)
            else:
                yield at, folder


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(name, content, path) of the files of finished writes below ``root``."""
    return whole_texts(spark, root).selectExpr("regexp_extract(path, '/part-[0-9]+-[0-9a-f]{32}/(.*)$', 1) AS name", "value AS content", "path")
