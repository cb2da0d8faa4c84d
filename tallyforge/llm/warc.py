"""WARC archives: writing captures, reading records, assembling transactions.

A page is a transaction of three records, each a gzip member of its own: a request and
a metadata record, which name the capture in WARC-Concurrent-To, and the capture, a
response or, for a payload that an earlier page has, a revisit. Reading goes through the
archives alone: records are parsed by their Content-Length in a stream, and transactions
are put together by joins over the concurrent-to identifiers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _store
from tallyforge.llm._session import new_path, staged

#: Smaller payloads are always stored.
LEAST_REVISITED = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit")
#: Bytes of an archive, cut at whole transactions, that are read at a time; and how many
#: such stretches have a task each, before tasks take ``TASK_BYTES`` of them.
STRETCH = 16 << 20
TASKS, TASK_BYTES = 10_000, 256 << 20


def record_id(kind: str, page: object, digest: str, turn: int) -> str:
    h = hashlib.md5(f"{kind}|{page}|{digest}|{turn}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, own: str, uri: str, content_type: str, block: bytes, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    small = len(data) < 4096
    c = zlib.compressobj(1, zlib.DEFLATED, 31, 4 if small else 8)
    return c.compress(data) + c.flush()


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, html, digest, first): whom each page revisits (null or itself: none)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    full = pages.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    full = full.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = full.where(F.octet_length("html") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page").alias("first"))
    joined = full.join(first, "digest", "left")
    return joined.select("page", "url", "html", "digest", "first")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """The archives' folder, and a table (file, start, bytes, records) of their stretches,
    which begin and end with whole gzip members.

    Null html is empty, a null url an empty one. Of equal payloads of at least
    ``LEAST_REVISITED`` bytes the smallest page is the response; pages with a null id
    are responses where no other page has their payload. Rows that repeat a page and its
    payload are captures of their own under one identifier.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, "", 0, 0
        stretches = [(0, 0)]  # bytes and records at their ends
        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(c) for c in ("page", "url", "html", "digest", "first"))):
                page, url, digest, first = page.as_py(), url.as_py(), digest.as_py(), first.as_py()
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"  # an attempt has a file of its own
                    out = _store.Writer(path)
                url = " ".join(url.split())
                again = first is not None and page != first
                kind = "revisit" if again else "response"
                turn = 0 if page is not None else (TaskContext.get().partitionId() << 32) + records + 1
                own = record_id("capture", page, digest, turn)
                ask = f"GET {url} HTTP/1.1\r\n\r\n".encode()
                data = b"" if again else html.as_buffer().to_pybytes()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + data
                more = (("WARC-Payload-Digest", f"sha256:{digest}"),)
                if again:
                    more += (("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("capture", first, digest, 0)))
                notes = ("" if page is None else f"page-id: {page}\r\n").encode()
                for data in (
                    record("request", record_id("request", page, own, 0), url, "application/http; msgtype=request", ask, (("WARC-Concurrent-To", own),)),
                    record(kind, own, url, "application/http; msgtype=response", block, more),
                    record("metadata", record_id("metadata", page, own, 0), url, "application/warc-fields", notes, (("WARC-Concurrent-To", own),)),
                ):
                    packed = member(data)
                    out.write(packed)
                    records, size = records + 1, size + len(packed)
                if size - stretches[-1][0] >= STRETCH:
                    stretches.append((size, records))
        if out is not None:
            out.close()
            if size > stretches[-1][0]:
                stretches.append((size, records))
            for (a, m), (b, n) in zip(stretches, stretches[1:]):
                yield pa.record_batch([pa.array([path]), *(pa.array([x], pa.int64()) for x in (a, b - a, n - m))], ["file", "start", "bytes", "records"])

    return folder, staged(roles(pages, id_col, url_col, html_col).mapInArrow(run, "file string, start long, bytes long, records long"), "warc-files")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; damage is skipped to the next record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = head.get("content-length", "")
        if length.isdigit():
            yield head, stream.read(int(length))


RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, payload_bytes long, fields map<string,string>, sound boolean"


def read(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (column ``file``); digests are of the bytes that were read.

    Columns ``start`` and ``bytes``, if there, name a stretch of whole gzip members;
    without them a file is read whole. Rows with a null file are left out, damage is
    skipped to the next record, headers that are missing are null, and rows that repeat
    a file give its records again. Tasks follow the number of stretches and their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "bytes"))):
                rows: list[tuple] = []
                held = 0
                with _stretch(file, start, size) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse(stream):
                        kind = head.get("warc-type", "")
                        stated = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        digest, size, fields, payload = stated, None, [], None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                        elif kind == "metadata":
                            fields = [tuple(y.strip() for y in x.split(":", 1)) for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x]
                            fields = list(dict(fields).items())
                        row = (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, size, fields, stated is None or stated == digest)
                        rows.append(row + (payload,) * with_payload)
                        held += len(block) if with_payload else 0
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    known = [F.col(c).cast("long").alias(c) if c in files.columns else F.lit(None).cast("long").alias(c) for c in ("start", "bytes")]
    wanted = files.select("file", *known).where("file IS NOT NULL")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # a number of its own: else a table of a few paths would be one task
    dealt = wanted.repartition(max(1, min(n, max(TASKS, size // TASK_BYTES))), "file", "start")
    return dealt.mapInArrow(run, RECORD + ", payload binary" * with_payload)


def _stretch(file: str, start: int | None, size: int | None):
    raw = _store.reader(file)
    if start is None or size is None:
        return raw
    with raw:
        raw.seek(start)
        return io.BytesIO(raw.read(size))


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.bool_()] + [pa.binary()] * with_payload
    names = [x.split(" ")[0] for x in RECORD.replace("map<string,string>", "map").split(", ")] + ["payload"] * with_payload
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def assemble(records: DataFrame, hops: int = 1) -> DataFrame:
    """One nested row per capture: (capture, request, metadata, requests, metadatas).

    A record belongs to the capture that it names, or that names it, or that the record
    it names belongs to (so many ``hops``). Of several requests or metadata records the
    one with the smallest identifier is shown, and their number is told; records that
    lead to no capture are left out, and captures without such records have nulls there.
    So are captures without an identifier. Repeated identifiers give a row each, with the
    same request and metadata. No records give no rows; other columns stay in the capture.
    """
    slim = records.select("record_id", "type", "concurrent_to", "uri", "fields")
    is_capture = F.col("type").isin(*CAPTURES)
    captures = records.where(is_capture & F.col("record_id").isNotNull())
    others = slim.where(~is_capture)
    named = captures.where("concurrent_to IS NOT NULL").groupBy("concurrent_to").agg(F.min("record_id").alias("by"))
    others = others.join(named.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left").withColumn("to", F.coalesce("by", "concurrent_to"))
    for _ in range(hops):
        step = others.select(F.col("record_id").alias("via"), F.col("to").alias("next")).where("via IS NOT NULL AND next IS NOT NULL").groupBy("via").agg(F.min("next").alias("next"))
        others = others.join(step, F.col("to") == F.col("via"), "left").withColumn("to", F.coalesce("next", "to")).drop("via", "next")
    shown = F.struct("record_id", "uri", F.map_entries("fields").alias("entries"))
    linked = (
        others.where("to IS NOT NULL")
        .groupBy("to")
        .agg(
            F.min(F.when(F.col("type") == "request", shown)).alias("request"),
            F.min(F.when(F.col("type") == "metadata", shown)).alias("metadata"),
            F.count_if(F.col("type") == "request").alias("requests"),
            F.count_if(F.col("type") == "metadata").alias("metadatas"),
        )
    )
    out = captures.select(F.col("record_id").alias("own"), F.struct(*[c for c in captures.columns if c not in ("concurrent_to", "fields")]).alias("capture"))
    joined = out.join(linked, F.col("own") == F.col("to"), "left")
    fields = F.map_from_entries("metadata.entries")
    metadata = F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.record_id").alias("record_id"), fields.alias("fields")))
    request = F.when(F.col("request").isNotNull(), F.struct("request.record_id", "request.uri"))
    return joined.select("capture", request.alias("request"), metadata.alias("metadata"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("metadatas", F.lit(0)).alias("metadatas"))


def resolve(assembled: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's size is its response's, whose digest must be the same; one that refers
    to no response in the archives has null sizes and targets.
    """
    flat = assembled.select(
        F.try_element_at("metadata.fields", F.lit("page-id")).cast("long").alias("page_id"),
        F.col("capture.record_id").alias("own"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.digest").alias("payload_digest"),
        F.col("capture.payload_bytes").alias("bytes"),
        F.col("capture.refers_to").alias("target"),
    )
    flat = staged(flat, "captures")
    stored = flat.where("record_type = 'response'").select(F.col("own").alias("target"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")).dropDuplicates(["target"])
    revisits = flat.where("record_type = 'revisit'").join(stored, "target", "left")
    same = F.col("full_digest") == F.col("payload_digest")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = revisits.select("page_id", F.when(same, F.col("full_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.when(same, F.col("refers_to")).alias("refers_to"))
    responses = flat.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits).select(*columns)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read them back, and resolve every capture."""
    _, files = write(pages)
    return resolve(assemble(staged(read(files), "records")))


def oracle_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id <> first THEN first END AS refers_to
FROM f
"""
