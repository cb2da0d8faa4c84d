"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is the integral of its schedule over training time 0..1. Targets
share all words by weight, capped at ``MOST`` times a source's size. Each source lays
its documents, in an order fixed by a hash, on its own axis of cumulative words; the
inverse of its integrated schedule turns a place on that axis into a training position,
and documents are range-sorted by position. Running totals come in two steps (per
hash bucket, then inside one), so that no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm._session import forget, staged

Knots = Sequence[tuple[float, float]]
MOST = 3
SALTS = 64
#: Piecewise linear (time, weight); their integrals are 5, 2 and 1.
SCHEDULES: tuple[Knots, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 0.5), (0.5, 1.25), (1.0, 1.0)))


def integral(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def inverse_sql(u: str, knots: Knots) -> str:
    """SQL for the time by which the share ``u`` of a schedule's integral has passed."""
    done, cases, last = 0.0, [], ""
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        y, slope = f"({u} * {integral(knots)!r} - {done!r})", (w1 - w0) / (t1 - t0)
        done += (t1 - t0) * (w0 + w1) / 2
        last = f"{t0!r} + 2 * {y} / ({w0!r} + sqrt({w0 * w0!r} + {2 * slope!r} * {y}))"
        cases.append(f"WHEN {u} * {integral(knots)!r} <= {done!r} THEN {last}")
    return f"CASE {' '.join(cases)} ELSE 1.0 END"


def position_sql(u: str, rank: str, schedules: Sequence[Knots]) -> str:
    cases = " ".join(f"WHEN {i} THEN {inverse_sql(u, k)}" for i, k in enumerate(schedules))
    return f"CASE CAST({rank} % {len(schedules)} AS INT) {cases} END"


#: From (source, source_size, rank from 0, weight) to targets, in SQL that both engines run.
#: ``here`` is the words per weight if all sources of a smaller ratio are capped and no
#: other; it rises as long as that is so and falls after, so the level is its maximum.
TARGET_SQL = """
SELECT source, source_size, rank, least({most} * source_size, weight * level) AS target FROM (
  SELECT *, max(here) OVER () AS level FROM (
    SELECT *, CAST(total - before AS DOUBLE) / rest AS here FROM (
      SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum({most} * source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM (SELECT *, {most} * source_size / weight AS ratio FROM {sources}) r) c) l) t
"""


def mix(docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, first, rank, key[, row]) per row.

    Every document is taken floor(target / source size) times. What then remains of the
    target goes to the documents that end inside it, and what those leave to the one other
    document whose size comes nearest, so that a source misses its target by little even
    if it has few documents. Null texts have size 0; a null source is a source of its own, after all others; rows with a null id
    are mixed too. Repeated rows are rows of their own. A source's order is by a digest
    of id and text, so neither null ids nor one id's many texts stand in one place.
    Documents without words are taken as often as the place where they stand says, which
    is no words. An empty table gives an empty table. ``row_col`` names a column that
    tells rows apart, if it is to be carried along.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    carried = [F.col(row_col).alias("row")] if row_col else []
    own = ["row"] * len(carried)
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"), *carried), "sizes")
    weights = F.array(*[F.lit(integral(k)) for k in schedules])
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select("*", rank.cast("long").alias("rank"))
    sources = sources.select("*", weights[(F.col("rank") % len(schedules)).cast("int")].alias("weight"))
    targets = docs.sparkSession.sql(TARGET_SQL.format(most=MOST, sources="{sources}"), sources=sources)
    bucket = F.substring("key", 1, 3)
    by_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("own"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select("source", "bucket", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("bucket", bucket).withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    head = before.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base", "source_size", "target", "rank")
    joined = placed.join(head, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    joined = joined.select(*own, "id", "source", "size", "key", "source_size", "target", "rank", (F.col("base") + F.col("inner")).alias("first"), passes.cast("long").alias("passes"))
    rest = F.when(F.col("passes") < MOST, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0.0))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    joined = staged(joined.select("*", rest.alias("rest"), (F.col("first") + F.col("size")).alias("end"), salt.alias("salt")), "placed")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # a source's one row meets its documents in many tasks
    full = joined.groupBy("rank").agg(F.max(F.when(F.col("end") <= F.col("rest"), F.col("end"))).alias("full")).select("rank", F.coalesce("full", F.lit(0)).alias("full"), salts)
    over = joined.join(full, ["rank", "salt"]).where("end > rest AND size > 0 AND abs(rest - full - size) < rest - full")
    extra = over.groupBy("rank").agg(F.min(F.struct(F.expr("abs(rest - full - size)").alias("miss"), "first")).alias("best")).select("rank", F.col("best.first").alias("extra"), salts)
    chosen = joined.join(extra, ["rank", "salt"], "left")
    once_more = ((F.col("end") <= F.col("rest")) & (F.col("rest") > 0)) | ((F.col("first") == F.col("extra")) & (F.col("size") > 0))
    copies = F.col("passes") + F.when(once_more, 1).otherwise(0)
    return chosen.select("id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), "first", "rank", "key", *own)


def place_sql(copy: str = "0") -> str:
    """Training position of a document's copy: middle of its words on the source's axis."""
    u = f"(CASE WHEN target > 0 THEN least(({copy} * source_size + first + size / 2.0) / target, 1.0) ELSE 1.0 END)"
    return position_sql(u, "rank", SCHEDULES)


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, range-sorted by training position.

    Every row is taken as often, and placed where, the mix says for that very row: rows
    that repeat an id, rows that repeat others wholly, and rows with a null id too. Null
    texts and texts without words take no words; they are there as often as their place
    says. Rows are numbered and carried whole, so columns may have any names. An empty
    table gives an empty table.
    """
    numbered = _numbered(docs)
    return _laid(numbered, _mixed(numbered, id_col, text_col, source_col), id_col).select(*(F.col("whole")[c].alias(c) for c in docs.columns))


def _numbered(docs: DataFrame) -> DataFrame:
    return staged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.monotonically_increasing_id().alias("row")), "numbered")


def _mixed(numbered: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return mix(numbered.select("row", *(F.col("whole")[c].alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source")))), SCHEDULES, "id", "text", "source", "row")


def _laid(numbered: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    copies = rows.where("copies > 0").select("row", "first", "size", "source_size", "target", "rank", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    laid = numbered.join(copies.select("row", F.expr(place_sql("copy")).alias("at")), "row")
    return laid.orderBy("at", F.col("whole")[id_col], "row")


def told(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``mix`` of ``docs`` with ``copies`` and ``taken`` read off the curriculum itself: the
    range-sorted texts are laid out, and each row's copies and their words counted there."""
    numbered = _numbered(docs.select(id_col, text_col, source_col))
    words = F.regexp_count(F.coalesce(F.col("whole")[text_col].cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    mixed = staged(_mixed(numbered, id_col, text_col, source_col), "mixed")
    order = staged(_laid(numbered, mixed, id_col).select("row", words.alias("words")), "curriculum")
    forget(numbered)
    found = order.groupBy("row").agg(F.count("*").alias("laid"), F.sum("words").alias("used"))
    return mixed.join(found, "row", "left").withColumns({"copies": F.coalesce("laid", F.lit(0).cast("long")), "taken": F.coalesce("used", F.lit(0).cast("long"))}).drop("laid", "used")


#: The same by other formulas: the level is read off the total that each source's
#: saturation would take, and a position is the quadratic's other root form.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
sources AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
edges AS (
  SELECT a.ratio, sum(least(3.0::DOUBLE * b.source_size, b.weight * a.ratio)) AS taken, sum(CASE WHEN b.ratio > a.ratio THEN b.weight ELSE 0 END) AS rising
  FROM (SELECT 0.0::DOUBLE AS ratio UNION SELECT 3.0::DOUBLE * source_size / weight FROM sources) a, (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM sources) b GROUP BY a.ratio),
total AS (SELECT sum(source_size)::DOUBLE AS words FROM sources),
level AS (SELECT max_by(ratio + (words - taken) / rising, ratio) AS level FROM edges, total WHERE taken <= words AND rising > 0),
targets AS (SELECT source, source_size, rank, least(3.0::DOUBLE * source_size, weight * level) AS target FROM sources, level),
placed AS (
  SELECT s.*, t.source_size, t.target, t.rank,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes, first + size AS ending FROM placed),
resting AS (SELECT *, CASE WHEN passes < 3 THEN target - passes * source_size ELSE 0.0::DOUBLE END AS rest FROM counted),
filled AS (SELECT *, coalesce(max(CASE WHEN ending <= rest THEN ending END) OVER (PARTITION BY rank), 0) AS filled FROM resting),
best AS (SELECT rank AS r2, min({{'miss': abs(rest - filled - size), 'first': first}}) AS best FROM filled WHERE ending > rest AND size > 0 AND abs(rest - filled - size) < rest - filled GROUP BY rank),
mixed AS (SELECT *, passes + CASE WHEN (ending <= rest AND rest > 0) OR (first = best.first AND size > 0) THEN 1 ELSE 0 END AS copies FROM filled LEFT JOIN best ON rank = r2)
SELECT doc_id, size, source_size, coalesce(target, 0.0::DOUBLE) AS target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies,
  round(CASE
    WHEN share >= 1 THEN 1.0::DOUBLE
    WHEN rank % 3 = 0 THEN (6 - sqrt(36 - 4 * (5 * share))) / 2
    WHEN rank % 3 = 1 THEN (-1 + sqrt(1 + 4 * (2 * share))) / 2
    WHEN share <= 0.4375 THEN (-0.5 + sqrt(0.25 + 3 * share)) / 1.5
    ELSE 0.5 + (1.25 - sqrt(1.5625 - (share - 0.4375))) / 0.5 END, 6) AS position
FROM (SELECT *, CASE WHEN target > 0 THEN least((first + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS share FROM mixed) m
"""


def oracle_sql() -> str:
    return ORACLE.replace('COLLATE "C" ', "").replace("{{", "{").replace("}}", "}")
