"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a session names none (a local test) is a temporary folder made and
    set, as driver and executors are one machine there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_folders: set[str] = set()


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Workers get batches of a bounded size, however long the rows; a smaller bound that
    the session has stays."""
    with contextlib.suppress(ValueError, PySparkException):  # a bound with a unit is the user's own
        if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
            spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It goes when the driver's Python
    ends, or by ``clear``; until then results that read from it can be read."""
    bounded(spark)
    found = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if found not in _folders:
        _folders.add(found)
        atexit.register(_delete_quietly, spark, found)
    return found


def clear(spark: SparkSession) -> None:
    """Delete all tables, models and archives of this application. Lazy results that
    still read them are void."""
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that no column has, in any case."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


#: On a plain shared folder an intermediate table has no checksum files beside its own:
#: they would double its files, and each costs a process that sets its permissions.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: Whether the files of an execution's shuffles go as it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, was)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks it ran, not the tables before. As
    nothing reads the write's shuffles after it, their files go with it; else they would
    lie beside the table until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_go(spark):
        df.write.options(**PLAIN, **{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``staged`` wrote and that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)
