import time

from pyspark.sql import functions as F

from tallyforge.llm import _session


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}


def test_a_staged_table_leaves_no_shuffle_behind(spark):
    was = spark.conf.get(_session.SHUFFLES_GO)
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    held = _session.staged(rows, "rows")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(_session.SHUFFLES_GO) == was
    assert sum(r["n"] for r in held.collect()) == 1000 == sum(r["n"] for r in rows.collect())
