"""Queries over expectations, evidence, reports and printed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import fixtures, reports, statement_tables
from tallyforge.plans.catalog import register
from tallyforge.plans.queries import KEYS, _compared
from tallyforge.plans.tables import table


def _turns(spark: SparkSession, sf_dir: str, said: str = "role IS NOT NULL") -> tuple[DataFrame, DataFrame]:
    """Users' texts as authored passages, and turns (all, or of one role) as answers."""
    c = table(spark, sf_dir, "conversations")
    expected = c.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("passage"))
    actual = c.where(said).select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("text").alias("passage"), F.col("role").alias("said"))
    return expected, actual


PASSAGE = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


@register("passage_join", f"WITH e AS (SELECT conv_id * 100 + turn AS item_id, {PASSAGE.format(c='text')} AS k FROM conversations WHERE role = 'user'), a AS (SELECT {PASSAGE.format(c='text')} AS k, arg_min(role, conv_id * 100 + turn) AS said FROM conversations GROUP BY 1) SELECT item_id, said FROM e LEFT JOIN a USING (k)")
def passage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.first_by_passage(*_turns(spark, sf_dir)).select("item_id", "said")


@register("unauthored", f"SELECT conv_id * 100 + turn AS seq, stratum FROM conversations a, (VALUES ('letters'), ('renewals')) s(stratum) WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations e WHERE e.role = 'user' AND {PASSAGE.format(c='e.text')} = {PASSAGE.format(c='a.text')})")
def unauthored(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual = _turns(spark, sf_dir, "role = 'assistant'")
    gates = spark.sql("SELECT * FROM VALUES ('letters'), ('renewals') AS t(stratum)")
    return fixtures.unauthored(actual, expected, gates).select("seq", "stratum")


OTHER_READING = "SELECT DISTINCT doc_id, line, CASE WHEN length(line) % 2 = 0 THEN line ELSE line || '~' END AS read FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
KEY = "lower(regexp_replace({c}, '\\s', '', 'g'))"


@register("disputed_passages", f"SELECT d.doc_id, count(DISTINCT q.read) AS disputes FROM documents d JOIN ({OTHER_READING}) q ON q.doc_id = d.doc_id AND {KEY.format(c='q.read')} <> '' AND contains({KEY.format(c='d.text')}, {KEY.format(c='q.read')}) GROUP BY d.doc_id")
def disputed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as another reading's, half of them misread."""
    docs = table(spark, sf_dir, "documents")
    obligations = docs.select(F.col("doc_id").alias("obligation_id"), F.col("doc_id").alias("document"), F.col("text").alias("passage"), F.array().cast("array<string>").alias("disputed"))
    lines = docs.select(F.col("doc_id").alias("document"), F.explode(F.split("text", "\n")).alias("line"))
    read = lines.select("document", F.when(F.length("line") % 2 == 0, F.col("line")).otherwise(F.concat("line", F.lit("~"))).alias("read")).distinct()
    rows = fixtures.mark_disputed(obligations, read).where(F.size("disputed") > 0)
    return rows.select(F.col("document").alias("doc_id"), F.size("disputed").cast("long").alias("disputes"))


@register("review_rate", "SELECT source, count(DISTINCT lang) AS n, count(DISTINCT CASE WHEN n_chars < 200 OR toxic = 1 THEN lang END) AS unsure FROM labels JOIN documents USING (doc_id) GROUP BY source")
def review_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    items = rows.select("source", "lang", F.when(F.col("n_chars") < 200, "low").otherwise("high").alias("confidence"), (F.col("toxic") == 1).alias("reviewed"))
    return fixtures.review_rate(items, "lang", "source").select("source", "n", "unsure")


@register("tiers", "SELECT source, arg_min(lang, (n_chars, lang)) AS worst_step, min(n_chars)::DOUBLE AS worst_score, max(doc_id) AS wall_ms FROM documents GROUP BY source")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("step"), F.col("n_chars").cast("double").alias("score"), F.lit(0.1).alias("review_rate"), F.lit(1.0).alias("end_to_end"), F.col("doc_id").alias("wall_ms"))
    return fixtures.tiers(steps, "source").select("source", "worst_step", "worst_score", "wall_ms")


@register("enough_decisions", "SELECT decisions AS median, 10 AS needed, decisions >= 10 AS fits FROM (SELECT count(*) AS decisions, row_number() OVER (ORDER BY count(*)) AS k, count(*) OVER () AS n FROM documents GROUP BY source) WHERE k = n // 2 + 1")
def enough_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.enough_decisions(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("decisions")), 0.9)


@register("safe_outcomes", "SELECT doc_id, CASE WHEN n_chars < 300 THEN true WHEN toxic = 1 THEN false WHEN n_chars % 2 = 0 THEN quality = 1 AND lang = 'en' ELSE quality = 0 END AS safe FROM labels JOIN documents USING (doc_id)")
def safe_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    outcome = F.when(F.col("n_chars") < 300, "review").when(F.col("n_chars") % 2 == 0, "found").otherwise("absent")
    expected = F.when(F.col("quality") == 1, "en")
    return rows.select("doc_id", fixtures.is_safe(F.col("toxic") == 1, expected, F.col("lang"), outcome).alias("safe"))


@register("comparison_report", KEYS + " SELECT count(*) FILTER (WHERE why IS NULL AND nb > 0 AND na > 0 AND vb <> va) AS changed, count(*) FILTER (WHERE why IS NULL AND nb = 0) AS added, count(*) FILTER (WHERE why IS NULL AND na = 0) AS removed, count(*) FILTER (WHERE why IS NULL AND nb > 0 AND na > 0 AND vb = va) AS unchanged, count(*) FILTER (WHERE why IS NOT NULL) AS not_compared FROM r")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.comparison_report(*_compared(spark, sf_dir))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as pages of a table, a customer's on one page."""
    o = table(spark, sf_dir, "orders")
    y = -10.0 * (F.col("o_orderkey") - F.min("o_orderkey").over(_page_window()) + 1)
    money = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    right = F.when(F.col("o_orderstatus") == "F", 400.0).otherwise(300.0)
    cell = lambda k, text, x, r: F.struct(F.lit(k).alias("k"), text.alias("text"), x.alias("x"), r.alias("right"))
    cells = F.array(
        cell(0, F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(0.0), F.lit(50.0)),
        cell(1, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.lit(100.0), F.lit(180.0)),
        cell(2, money, right - 40, right),
    )
    rows = o.select(F.col("o_custkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.explode(cells).alias("c"), y.alias("y"))
    heads = [("Date", 0.0, 30.0), ("Description", 100.0, 170.0), ("Paid Out", 250.0, 300.0), ("Paid In", 350.0, 400.0), ("Balance", 450.0, 500.0)]
    head = F.array(*[cell(k, F.lit(t), F.lit(x), F.lit(r)) for k, (t, x, r) in enumerate(heads)])
    top = o.select(F.col("o_custkey").cast("string").alias("doc")).distinct().select("doc", F.lit(1).alias("page"), F.explode(head).alias("c"), F.lit(0.0).alias("y"))
    every = rows.unionByName(top)
    return every.select("doc", "page", (F.col("y") * -1000 + F.col("c.k")).cast("long").alias("frag_no"), "c.text", "c.x", "c.right", "y")


def _page_window():
    from pyspark.sql import Window

    return Window.partitionBy("o_custkey")


@register("printed_statement", "SELECT o_custkey::VARCHAR AS doc, o_orderdate::DATE AS date, 'Order ' || o_orderkey::VARCHAR AS raw_merchant, o_totalprice::DECIMAL(18,2) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS direction FROM orders")
def printed_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statement_tables.reconstructed(_printed(spark, sf_dir))
    return rows.where("reason IS NULL").select("doc", "date", "raw_merchant", "amount", "direction")


FIXTURES = """SELECT o_custkey AS fixture, CASE o_custkey % 3 WHEN 0 THEN 'audit' WHEN 1 THEN 'letter' ELSE 'comparison' END AS payload, o_orderkey // 10 AS key, 'paid to shop ' || o_orderpriority AS value, o_orderkey AS seq FROM orders"""


@register("fixture_scores", f"""WITH e AS (SELECT fixture, payload, key, arg_min(value, seq) AS want FROM ({FIXTURES}) WHERE fixture % 11 > 0 GROUP BY ALL),
a AS (SELECT fixture, payload, key, arg_min(said, seq) AS said FROM (SELECT *, CASE seq % 4 WHEN 0 THEN value || '!' WHEN 1 THEN replace(value, 'paid', 'piad') WHEN 2 THEN 'nothing' ELSE value END AS said FROM ({FIXTURES}) WHERE seq % 7 > 0) GROUP BY ALL),
j AS (SELECT fixture, payload, want, said, regexp_replace(lower(want), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS x, regexp_replace(lower(said), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS y FROM e FULL JOIN a USING (fixture, payload, key)),
s AS (SELECT fixture, payload, count(want) AS expected, count(said) AS said, count(*) FILTER (WHERE want = said OR (payload = 'audit' AND 1 - damerau_levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) >= 0.85)) AS correct FROM j GROUP BY ALL)
SELECT fixture, payload, CASE WHEN expected > 0 THEN CASE payload WHEN 'audit' THEN 'normalise' WHEN 'letter' THEN 'obligations' ELSE 'policy-terms' END END AS step, CASE WHEN expected > 0 THEN correct END AS correct, expected, round(2 * correct / (expected + said), 9) AS end_to_end FROM s""")
def fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fixtures of three payloads: answers left out, misspelt, adorned or wrong."""
    o = table(spark, sf_dir, "orders")
    payload = F.when(F.col("o_custkey") % 3 == 0, "audit").when(F.col("o_custkey") % 3 == 1, "letter").otherwise("comparison")
    rows = o.select(F.col("o_custkey").alias("fixture"), payload.alias("payload"), F.expr("o_orderkey div 10").alias("key"), F.concat(F.lit("paid to shop "), "o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    k = F.col("seq") % 4
    said = F.when(k == 0, F.concat("value", F.lit("!"))).when(k == 1, F.replace("value", F.lit("paid"), F.lit("piad"))).when(k == 2, "nothing").otherwise(F.col("value"))
    told = fixtures.score_fixtures(rows.where("fixture % 11 > 0"), rows.where("seq % 7 > 0").withColumn("value", said))
    return told.withColumn("end_to_end", F.round("end_to_end", 9))
