"""Run folders: create-once outputs, numbered exchanges, recordings and cached results."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.files import whole_texts


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of a name of its own where all executors can write: in the one that
    ``spark.checkpoint.dir`` names, or a temporary one if driver and executors are one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(Path(tempfile.mkdtemp(prefix="run-")).as_uri())
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table where all executors can, and read it back: what follows plans
    its input once, and a lost executor costs no more than its own tasks. The table goes
    when the driver's Python ends; results that read it must be read before."""
    path = new_folder(df.sparkSession, name)
    atexit.register(_delete, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input files for each part that rows are spread over.
PART_BYTES = 8 << 20


def spread(df: DataFrame, *keys: str, source: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out by keys, over as many parts as the session's shuffle partitions, or
    more where the files behind it (or behind ``source``) are large: what a task sorts and
    holds stays as large however much the input grows."""
    spark = df.sparkSession
    size = 0
    for path in (source or df).inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), *keys)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Paths of a folder's files with an ending, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(p for p in (f.getPath().toString() for f in found) if p.endswith(ending))


def write_once(df: DataFrame, path: str, kind: str = "json") -> None:
    """Refuses a folder that is there already. Decimals become strings in JSON."""
    if kind == "json":
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes])
    df.write.mode("errorifexists").format(kind).save(path)


def exchanges(asked: DataFrame) -> DataFrame:
    """Numbers requests and responses of a run by step, batch and attempt."""
    return asked.withColumn("exchange_id", F.sha2(F.concat_ws("\x1f", "step", F.col("batch").cast("string"), F.col("attempt").cast("string")), 256))


#: What a run was asked under where no file tells it.
CURRENT = "{}"
_DEEPEST = 40


def policy_text(policy: Column) -> Column:
    """A policy (a flat JSON object) as the text that its keys hold: names in order."""
    held = F.from_json(policy, "map<string,string>")
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(held)))), F.lit(CURRENT))


def request_key(policy: Column, prompt: Column) -> Column:
    """The digest of a prompt under its policy; lengths keep the two apart."""
    one = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(one(policy_text(policy)), one(F.coalesce(prompt, F.lit("")))), 256)


def recorded_exchanges(spark: SparkSession, root: str, current: str = CURRENT) -> DataFrame:
    """(folder, exchange, policy, prompt, answer) of all exchanges below a folder of runs.

    A request is ``X.request.txt`` or, in older runs, ``X.request.json``; its answer is
    ``X.response.json`` beside it, and a request without one is left out. The policy is
    that of the nearest folder above whose ``run.json`` has a ``request``, else ``current``.
    Runs of more than one model (``model.file`` in ``run.json``) are refused.
    """
    raw = staged(whole_texts(spark, root), "texts")  # each file is opened once
    files = raw.select("value", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("name"))
    manifests = files.where("name = 'run.json'").select("folder", F.get_json_object("value", "$.request").alias("policy"), F.get_json_object("value", "$.model.file").alias("model"))
    models = [r[0] for r in manifests.where("model IS NOT NULL").select("model").distinct().limit(2).collect()]
    if len(models) > 1:
        raise ValueError(f"the recording holds answers of more than one model: {', '.join(sorted(models))}")
    ending = r"\.request\.(txt|json)$"
    asked = files.where(F.col("name").rlike(ending)).select("folder", F.regexp_replace("name", ending, "").alias("exchange"), F.col("value").alias("prompt"))
    told = files.where("name LIKE '%.response.json'").select("folder", F.regexp_replace("name", r"\.response\.json$", "").alias("exchange"), F.col("value").alias("answer"))
    both = asked.join(told, ["folder", "exchange"])
    # each folder with all that are above it, and the nearest of those that have a policy
    steps = F.split("folder", "/")
    above = both.select("folder").distinct().select("folder", F.explode(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(_DEEPEST)))).alias("depth"), steps.alias("steps"))
    above = above.select("folder", "depth", F.array_join(F.slice("steps", 1, F.col("depth")), "/").alias("up"))
    policies = manifests.where("policy IS NOT NULL").select(F.col("folder").alias("up"), "policy")
    nearest = above.join(policies, "up").groupBy("folder").agg(F.max_by("policy", "depth").alias("policy"))
    return both.join(nearest, "folder", "left").select("folder", "exchange", F.coalesce("policy", F.lit(current)).alias("policy"), "prompt", "answer")


def recording(spark: SparkSession, root: str, current: str = CURRENT) -> DataFrame:
    """(key, answer) of all exchanges below a folder of runs, by policy and prompt; a
    folder without any is an error."""
    rows = recorded_exchanges(spark, root, current)
    found = staged(rows.select(request_key(F.col("policy"), F.col("prompt")).alias("key"), "answer").distinct(), "recording")
    if not found.take(1):
        raise ValueError(f"no recorded answers below {root}")
    return found


class FinishedLog:
    """What an interrupted run has finished: rows appended beside it, then published by a
    rename, so that a later run reads whole appends only.

    ``identity`` names everything that must be alike for a result to count again (pack,
    versions, model, scoring); it is part of the log's place, so results under another
    identity are never met.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: Sequence[str], schema: str) -> None:
        self.spark, self.schema = spark, schema
        self.folder = f"{folder.rstrip('/')}/{content_key([x.encode() for x in identity])}"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def append(self, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        beside, final = f"{self.folder}/_unfinished-{name}", f"{self.folder}/done-{name}"
        rows.write.parquet(beside)
        fs, a = self._fs(beside)
        if not fs.rename(a, self._fs(final)[1]):
            raise OSError(f"{beside} could not be published")

    def finished(self) -> DataFrame:
        fs, where = self._fs(self.folder)
        found = fs.listStatus(where) if fs.exists(where) else []
        paths = [p for p in (f.getPath().toString() for f in found) if p.rsplit("/", 1)[-1].startswith("done-")]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def run(self, items: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], batches: int = 16) -> DataFrame:
        """The results of all items, of which those finished before are not worked on again.

        Items are taken in ``batches`` by a hash of their keys; each batch's results (with
        the keys, in the log's columns) are appended before the next one begins. An item
        that ``work`` gives no row for is asked again by a later run.
        """
        done = self.finished()
        for k in range(batches):
            own = items.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == k).join(done, list(keys), "left_anti")
            if own.take(1):
                self.append(work(own).select(*self.spark.createDataFrame([], self.schema).columns))
        return self.finished().join(items.select(*keys).distinct(), list(keys), "left_semi")


def content_key(parts: Sequence[bytes]) -> str:
    """A digest of parts that no other split of the same bytes shares."""
    h = hashlib.sha256()
    for part in parts:
        h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def cache_key(pack: str, version: str, model: str, input_hashes: Sequence[str]) -> str:
    return content_key([x.encode() for x in (pack, version, model, *sorted(input_hashes))])


def within(root: str | Path, path: str | Path) -> Path | None:
    """The path, if it is inside the root."""
    root, path = Path(root).resolve(), Path(path).resolve()
    return path if path.is_relative_to(root) else None


def merged_tiers(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New measurements replace those of the same keys, others stay."""
    return old.join(new, list(keys), "left_anti").unionByName(new)
