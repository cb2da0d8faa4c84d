"""Secret scans: plain patterns, and credentials whose parts only together are one.

A worker finds spans of six kinds in each whole text. Three are secrets by their form
(``assign``, ``access``, ``hex``) and always reported. Three are weak: an e-mail address or
user name (``login``), a long bare token of mixed characters (``opaque``) and an address
of a service (``endpoint``) mean nothing alone. A credential has an identifier (access,
login), a secret (assign, hex, opaque) and often an endpoint. A weak span is reported
only where complementary parts stand within ``REACH`` code points of it in the same
scope (texts are divided into scopes by blank lines):

* login: a strong secret, or an opaque token and an endpoint;
* opaque: a strong identifier, or a login and an endpoint;
* endpoint: an identifier and a secret, weak or strong.

Parts meet in an interval join over bins of ``REACH`` code points. What stands in a bin is
first reduced to its first and last place by part, and a weak span asks its own bin and
the two beside it: in its own every part is near enough, and beside it the nearest one
decides. So work is linear in the spans, however many stand close together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _bytes as B
from tallyforge.llm._session import staged

KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
ASSIGN, ACCESS, HEX, LOGIN, OPAQUE, ENDPOINT = range(6)
STRONG = 3
REACH = 256

LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_OPAQUE = 6, 20, 24, 24
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN_RE = rf"({NAMES})[\x22']?\x20*[:=]\x20*[\x22']?({VALUE})"
ACCESS_RE = "AKIA[A-Z0-9]+"
LOGIN_RE = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]"
ENDPOINT_RE = r"[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?@%&=+-]+"

#: Characters of a bare token; a token is as many as stand together.
_OPAQUE = np.zeros(256, np.uint8)
_HEX = np.zeros(256, np.uint8)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _OPAQUE[_c] = 1
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _OPAQUE[_c] = 2
for _c in b"0123456789":
    _OPAQUE[_c] = 4
for _c in b"+/_=-":
    _OPAQUE[_c] = 8
for _c in b"0123456789abcdef":
    _HEX[_c] = 1

_assign, _access, _login, _endpoint = (re.compile(x.encode()) for x in (ASSIGN_RE, ACCESS_RE, LOGIN_RE, ENDPOINT_RE))
_blank = re.compile(rb"\n[\x20\t\r]*\n")


def _stretches(of: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of stretches of marked bytes that are long enough; rows end them."""
    inside = of > 0
    cut = np.zeros(len(of) + 1, bool)
    cut[offsets] = True
    lead = inside & (cut[:-1] | np.append(True, ~inside[:-1]))
    last = inside & (cut[1:] | np.append(~inside[1:], True))
    start, end = np.flatnonzero(lead), np.flatnonzero(last) + 1
    long = end - start >= least
    start, end = start[long], end[long]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def spans_of(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(row, scope, start, kind, end) of all spans of texts, by row, start and kind; places in code points."""
    found: list[tuple[int, int, int, int]] = []  # row, start, kind, end in bytes of the chunk
    ends: list[int] = []  # of scopes
    data = buf.tobytes()
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = data[lo:hi]
        if b"=" in text or b":" in text:
            found += [(row, lo + m.start(), ASSIGN, lo + m.end()) for m in _assign.finditer(text) if len(m[2]) >= LEAST_VALUE]
        if b"\n" in text:
            ends += [lo + m.start() for m in _blank.finditer(text)]
        if b"AKIA" in text:
            found += [(row, lo + m.start(), ACCESS, lo + m.end()) for m in _access.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        if b"@" in text:
            found += [(row, lo + m.start(), LOGIN, lo + m.end()) for m in _login.finditer(text)]
        if b"://" in text:
            found += [(row, lo + m.start(), ENDPOINT, lo + m.end()) for m in _endpoint.finditer(text)]
    some = []
    if len(buf):
        row, start, end = _stretches(_HEX[buf], offsets, LEAST_HEX)
        some.append(np.stack([row, start, np.full(len(row), HEX), end], 1))
    base = np.concatenate([np.array([x for x in found if x[2] < STRONG], np.int64).reshape(-1, 4), *some])
    weak = [np.array([x for x in found if x[2] >= STRONG], np.int64).reshape(-1, 4)]
    if len(buf):
        mark = _OPAQUE[buf]
        row, start, end = _stretches(mark, offsets, LEAST_OPAQUE)
        mixed = [int(np.bitwise_or.reduce(mark[a:b])) & 7 == 7 for a, b in zip(start.tolist(), end.tolist())]
        weak.append(np.stack([row, start, np.full(len(row), OPAQUE), end], 1)[np.array(mixed, bool)])
    weak = np.concatenate(weak)
    if len(weak) and len(base):  # what a strong span covers in part is no part of its own
        over = np.zeros(len(buf) + 1, np.int64)
        np.add.at(over, base[:, 1], 1)
        np.add.at(over, base[:, 3], -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(over)[:-1] > 0)))
        weak = weak[covered[weak[:, 3]] == covered[weak[:, 1]]]
    every = np.concatenate([base, weak])
    if not len(every):
        return np.zeros((0, 5), np.int64)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    blanks = np.array(ends, np.int64)
    row = every[:, 0]
    scope = np.searchsorted(blanks, every[:, 1]) - np.searchsorted(blanks, offsets[row])
    at = points[offsets[row]]
    out = np.stack([row, scope, points[every[:, 1]] - at, every[:, 2], points[every[:, 3]] - at], 1)
    return out[np.lexsort((out[:, 3], out[:, 2], row))]


_SPAN = "struct<start:long,kind:int,`end`:long,scope:long>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rk, rt, id, spans): all spans of each text, weak ones not yet judged. (rk, rt) is the
    same for rows of the same id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", owner="secrets"):
                found = spans_of(buf, offsets)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(found[:, 0], np.arange(hi - lo + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(found[:, 2]), pa.array(found[:, 3].astype(np.int32)), pa.array(found[:, 4]), pa.array(found[:, 1])], ["start", "kind", "end", "scope"]),
                )
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in ("rk", "rt", "id")), listed], ["rk", "rt", "id", "spans"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.xxhash64(text, F.lit(1)).alias("rk"), F.xxhash64(id_, text).alias("rt"), id_.alias("id"), text.alias("text"))
    return rows.mapInArrow(run, f"rk long, rt long, id long, spans array<{_SPAN}>")


def linked(scanned: DataFrame) -> DataFrame:
    """(rk, rt, weak): the weak spans of each text that complementary parts confirm."""
    key = ["rk", "rt"]
    some = scanned.where(F.exists("spans", lambda s: s.kind >= STRONG) & (F.size("spans") > 1))
    parts = some.select(*key, F.explode("spans").alias("s")).select(*key, "s.*").distinct().withColumn("bin", F.expr(f"start div {REACH}"))
    roles = {"strong_id": [ACCESS], "weak_id": [LOGIN], "strong_secret": [ASSIGN, HEX], "weak_secret": [OPAQUE], "address": [ENDPOINT]}
    place = {role: F.when(F.col("kind").isin(kinds), F.col("start")) for role, kinds in roles.items()}
    bins = parts.groupBy(*key, "scope", "bin").agg(*[f(p).alias(f"{role}_{name}") for role, p in place.items() for name, f in (("first", F.min), ("last", F.max))])
    asks = parts.where(F.col("kind") >= STRONG).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))

    def near(role: str) -> Column:
        return F.coalesce(F.max((F.abs(F.col("start") - F.col(f"{role}_first")) <= REACH) | (F.abs(F.col("start") - F.col(f"{role}_last")) <= REACH)), F.lit(False)).alias(role)

    met = asks.join(bins, [*key, "scope", "bin"]).groupBy(*key, "start", "kind", "end").agg(*[near(r) for r in roles])
    id_, secret = F.col("strong_id") | F.col("weak_id"), F.col("strong_secret") | F.col("weak_secret")
    sure = (
        F.when(F.col("kind") == LOGIN, F.col("strong_secret") | (F.col("weak_secret") & F.col("address")))
        .when(F.col("kind") == OPAQUE, F.col("strong_id") | (F.col("weak_id") & F.col("address")))
        .otherwise(id_ & secret)
    )
    return met.where(sure).groupBy(*key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and spans, lists of (start, kind, end) by start, then kind.

    ``base`` holds the strong kinds, ``spans`` the confirmed weak ones too; a kind is a
    place in ``KINDS``, places are code points and an end is exclusive. Null texts are
    empty and have no spans. Rows that repeat an id or have none are judged by themselves;
    rows that repeat id and text have the same spans. An empty table gives an empty one.
    Other columns are not read.
    """
    scanned = staged(scan(docs, id_col, text_col), "secret-spans")
    rows = scanned.join(linked(scanned), ["rk", "rt"], "left")
    base = F.transform(F.filter("spans", lambda s: s.kind < STRONG), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s["end"].alias("end")))
    rows = rows.select(F.col("id").alias(id_col), base.alias("base"), "weak")
    every = F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "weak")))
    return rows.select(id_col, "base", every.alias("spans"))


def told(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s.kind], s.start, s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    count = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{KINDS[k]}") for k in range(STRONG)]
    linked_ = (F.size("spans") - F.size("base")).cast("long").alias("n_linked")
    return found.select("doc_id", *count, F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"), linked_)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by a mark, other columns as they are.

    Overlapping spans go under one mark. Null texts stay null.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{id_col}`").cast("long")
    key = [F.xxhash64(text, F.lit(1)).alias("rk"), F.xxhash64(id_, text).alias("rt")]
    scanned = staged(scan(docs, id_col, text_col).where(F.size("spans") > 0).distinct(), "secret-spans")
    rows = scanned.join(linked(scanned), ["rk", "rt"], "left")
    strong = F.transform(F.filter("spans", lambda s: s.kind < STRONG), lambda s: F.struct(s.start.alias("start"), s["end"].alias("end")))
    weak = F.transform(F.coalesce("weak", F.expr("array()").cast("array<struct<start:long,kind:int,end:long>>")), lambda s: F.struct(s.start.alias("start"), s["end"].alias("end")))
    cuts = rows.select("rk", "rt", F.array_sort(F.concat(strong, weak)).alias("cuts")).where(F.size("cuts") > 0)
    held = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(cuts, ["rk", "rt"], "left")
    own = F.col("row")[text_col].cast("string")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def step(made: Column, cut: Column) -> Column:
        fresh = F.when(cut.start >= made["at"], F.concat(made["text"], F.substring(own, made["at"].cast("int") + 1, (cut.start - made["at"]).cast("int")), F.lit(mark))).otherwise(made["text"])
        return F.struct(fresh.alias("text"), F.greatest(made["at"], cut["end"]).alias("at"))

    clean = F.aggregate("cuts", start, step, lambda made: F.concat(made["text"], F.substring(own, made["at"].cast("int") + 1, F.length(own))))
    text = F.when(F.col("cuts").isNull() | own.isNull(), own).otherwise(clean)
    return held.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """The same with positions from the pieces between matches, and every pair of near parts."""

    def matches(kind: int, pattern: str, test: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
  SELECT r, {kind} AS kind, upto - len(m) AS start, upto AS "end", m FROM (
    SELECT r, i, m, sum(len(piece) + len(m)) OVER (PARTITION BY r ORDER BY i) AS upto
    FROM (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(pieces[1:len(ms)]) AS piece
          FROM (SELECT r, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS pieces FROM d))) WHERE {test}"""

    value = ASSIGN_RE.replace("'", "''")
    base = " UNION ALL ".join(
        [
            matches(ASSIGN, ASSIGN_RE, f"len(regexp_extract(m, '{value}', 2)) >= {LEAST_VALUE}"),
            matches(ACCESS, ACCESS_RE, f"len(m) >= {LEAST_ACCESS}"),
            matches(HEX, "[0-9a-f]+", f"len(m) >= {LEAST_HEX}"),
        ]
    )
    weak = " UNION ALL ".join(
        [
            matches(LOGIN, LOGIN_RE, "true"),
            matches(OPAQUE, "[A-Za-z0-9+/_=-]+", f"len(m) >= {LEAST_OPAQUE} AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
            matches(ENDPOINT, ENDPOINT_RE, "true"),
        ]
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    near = lambda kinds: f"bool_or(b.kind IN ({', '.join(map(str, kinds))}))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
weak AS (
  SELECT * FROM ({weak}) AS x
  WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.r = x.r AND b.start < x."end" AND x.start < b."end")),
parts AS (
  SELECT r, kind, start, "end", len(regexp_extract_all(t[1:start], '\n[\x20\t\r]*\n')) AS scope
  FROM (SELECT r, kind, start, "end" FROM base UNION ALL SELECT r, kind, start, "end" FROM weak) JOIN d USING (r)),
met AS (
  SELECT a.r, a.kind, a.start, a."end",
         {near([ACCESS])} AS strong_id, {near([LOGIN])} AS weak_id, {near([ASSIGN, HEX])} AS strong_secret,
         {near([OPAQUE])} AS weak_secret, {near([ENDPOINT])} AS address
  FROM parts AS a JOIN parts AS b ON a.r = b.r AND a.scope = b.scope AND abs(a.start - b.start) <= {REACH}
  WHERE a.kind >= {STRONG} GROUP BY ALL),
sure AS (
  SELECT r, kind, start, "end" FROM met
  WHERE CASE kind WHEN {LOGIN} THEN strong_secret OR (weak_secret AND address)
             WHEN {OPAQUE} THEN strong_id OR (weak_id AND address)
             ELSE (strong_id OR weak_id) AND (strong_secret OR weak_secret) END),
every AS (SELECT r, kind, start, "end", true AS strong FROM base UNION ALL SELECT r, kind, start, "end", false FROM sure),
told AS (
  SELECT r, count(*) FILTER (kind = {ASSIGN}) AS a, count(*) FILTER (kind = {ACCESS}) AS b, count(*) FILTER (kind = {HEX}) AS c, count(*) FILTER (NOT strong) AS l,
         string_agg({names}[kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (strong) AS base,
         string_agg({names}[kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0)::BIGINT AS n_linked
FROM d LEFT JOIN told USING (r)"""
