import datetime as dt

from tallyforge.streaming.incremental import running_cadence


def test_running_cadence(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * i), "gym") for i in range(5)] + [(3, dt.datetime(2024, 1, 22), "gym")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, merchant string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, merchant string").parquet(str(tmp_path / "in"))
    query = running_cadence(stream).writeStream.format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("running").collect()
    assert [(r.merchant, r.payments, r.period) for r in got] == [("gym", 5, "weekly")]
