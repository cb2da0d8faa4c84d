import gzip
import hashlib
import io

from pyspark.sql import functions as F

from tallyforge.llm import warc


def test_matches_the_contract(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "url", "html"))
    texts = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.page_id]
        again = len(data) >= 100 and first[data] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[data]) if again else ("response", None))


def test_edges_of_the_input(spark):
    rows = [(1, "u", "x" * 200), (2, None, "x" * 200), (None, "u", "x" * 200), (3, "http://a b\n", "y"), (5, "v", None), (4, "v", "WARC/1.1\r\n\r\n" * 20), (1, "u", "x" * 200), (6, "v", "é\r\n\r\n" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    for r in got:
        want = [(h or "").encode() for i, _, h in rows if i == r.page_id][0]
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
    assert {str(r.page_id) for r in got if r.record_type == "revisit"} == {"2", "None"}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_read_in_many_tasks(spark, monkeypatch):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "concat(repeat(sha2(cast(id as string), 256), 40), id) AS html").repartition(3)
    whole = {tuple(r) for r in warc.round_trip(pages).collect()}
    monkeypatch.setattr(warc, "STRETCH", 20_000)
    _, files = warc.write(pages)
    stretches = files.orderBy("file", "start").collect()
    assert len(stretches) >= 12 and all(a.start + a.bytes == b.start for a, b in zip(stretches, stretches[1:]) if a.file == b.file)
    read = warc.read(files)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= len(stretches) / 2
    assert read.count() == 1200 == sum(r.records for r in stretches)
    assert {tuple(r) for r in warc.round_trip(pages).collect()} == whole
    by_file = files.select("file").distinct()  # foreign archives have no stretches
    assert warc.read(by_file).count() == 1200
    monkeypatch.setattr(warc, "TASKS", 2)
    assert warc.read(files).count() == 1200


def test_archives_are_gzip_members_of_records(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://h/", "<p>hello</p>")], "page_id long, url string, html string")
    _, files = warc.write(pages)
    path = files.first().file.removeprefix("file:")
    data = gzip.open("/" + path.lstrip("/")).read()
    kinds = [h["warc-type"] for h, _ in warc.parse(io.BytesIO(data))]
    assert kinds == ["request", "response", "metadata"] and data.endswith(b"\r\n\r\n")
    hurt = b"noise\r\n" + data[: data.index(b"WARC/1.1", 10)] + b"broken line\r\n" + data[data.index(b"WARC/1.1", 10) :]
    assert [h["warc-type"] for h, _ in warc.parse(io.BytesIO(hurt))] == kinds


def test_assembly_follows_either_direction_and_a_hop(spark):
    names = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, payload_bytes long, fields map<string,string>, sound boolean"
    row = lambda i, kind, to, fields=None: (i, kind, to, None, f"uri-{i}", "d", "x", 1, fields or {}, True)
    records = spark.createDataFrame(
        [row("r1", "response", "q1"), row("q1", "request", None), row("m1", "metadata", "q1", {"page-id": "1"}), row("r2", "response", None), row("q2", "request", "r2"), row("m2", "metadata", "r2", {"page-id": "2"}), row("m3", "metadata", "r2", {"page-id": "3"}), row("r3", "revisit", None), row("lost", "metadata", "nowhere")],
        names,
    )
    got = {r.capture.record_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.fields == {"page-id": "1"}
    assert (got["r2"].requests, got["r2"].metadatas, got["r2"].metadata.fields) == (1, 2, {"page-id": "2"})
    assert got["r3"].request is None and got["r3"].metadata is None
