"""Queries over letters, printed pages, readings and stated terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import numbers as N
from tallyforge.operators import geometry, passages, reports, statement_tables, terms, timeline
from tallyforge.plans.catalog import register
from tallyforge.plans.queries import KEYS, SQUASHED, _compared
from tallyforge.plans.tables import table
from tallyforge.sources.runs import spread

WORDS = "strftime({d}, '%-d %B %Y')"
KINDS = ("pay", "reply", "attend")


def _pick(k, *parts: str):
    return F.element_at(F.array(*map(F.lit, parts)), (k % len(parts) + 1).cast("int"))


def _posted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segments, obligations): a letter an order, some with a due-date row."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    row = F.concat(_pick(key, "Due date: ", "DATE DUE ", "The due date is ", "Payment due "), D.in_words(F.date_add(day, 20)))
    parts = F.array(F.concat(F.lit("Written on "), D.in_words(day)), F.lit("Dear reader"), row, F.concat(F.lit("Due date "), D.in_words(F.date_add(day, 40))))
    segments = o.select(key.alias("document"), F.posexplode(parts).alias("ordinal", "text"))
    obligations = o.select(
        key.alias("seq"),
        key.alias("document"),
        F.lit(1).alias("ordinal"),
        _pick(key, *KINDS).alias("kind"),
        F.concat(F.lit("Party "), (F.col("o_custkey") % 50).cast("string")).alias("party"),
        _pick(key, "by the date shown beside it", "by the date", "within 10 days", "by the date below", "soon").alias("deadline"),
        F.lit("").alias("anchor"),
        F.when(key % 4 == 0, "low").otherwise("high").alias("confidence"),
    )
    return segments, obligations


POSTED = """(SELECT o_orderkey AS seq, o_orderkey % 3 AS kind_no, CASE o_orderkey % 3 WHEN 0 THEN 'pay' WHEN 1 THEN 'reply' ELSE 'attend' END AS kind, 'Party ' || (o_custkey % 50)::VARCHAR AS party, o_orderkey % 4 = 0 AS low,
  CASE o_orderkey % 5 WHEN 0 THEN 'by the date shown beside it' WHEN 1 THEN 'by the date' WHEN 2 THEN 'within 10 days' WHEN 3 THEN 'by the date below' ELSE 'soon' END AS deadline,
  CASE o_orderkey % 5 WHEN 2 THEN o_orderdate::DATE + 10 WHEN 0 THEN pointed WHEN 3 THEN pointed END AS due, CASE o_orderkey % 5 WHEN 2 THEN 'worked_out' WHEN 0 THEN 'read' WHEN 3 THEN 'read' END AS due_kind
  FROM (SELECT *, o_orderdate::DATE + CASE WHEN o_orderkey % 4 = 2 THEN 40 ELSE 20 END AS pointed FROM orders))"""


@register("pointed_deadlines", f"SELECT seq, due, due_kind, deadline IN ('by the date shown beside it', 'by the date below') AS dated_by_row FROM {POSTED}")
def pointed_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, obligations = _posted(spark, sf_dir)
    done = timeline.dated(obligations, segments)
    return done.select("seq", F.col("due.date").alias("due"), F.col("due.kind").alias("due_kind"), "dated_by_row")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, obligations = _posted(spark, sf_dir)
    return timeline.dated(obligations, segments).withColumn("evidence", F.array(F.struct("document", "ordinal")))


@register("timeline_order", f"SELECT due, kind, party, count(*) AS n, min(place) AS first_place, max(place) AS last_place FROM (SELECT *, row_number() OVER (ORDER BY due NULLS LAST, kind, party) AS place FROM {POSTED}) GROUP BY ALL")
def timeline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of cards: by date, undated last, then kind and party."""
    cards = reports.letter_actions(_timeline(spark, sf_dir))
    place = F.substring("action_id", 5, 20).cast("long")
    kind = F.lower(F.substring_index("title", " for ", 1))
    shown = cards.select("due", kind.alias("kind"), F.substring_index("title", " for ", -1).alias("party"), place.alias("place"))
    return shown.groupBy("due", "kind", "party").agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


@register("letter_cards", f"""SELECT title, shown, evidence, count(*) AS n FROM (SELECT upper(left(kind, 1)) || substr(kind, 2) || ' for ' || party AS title, CASE WHEN due IS NULL THEN 'no date: ' || deadline ELSE {WORDS.format(d='due')} END AS shown, CASE WHEN low THEN 'low' ELSE 'high' END || '/1' AS evidence FROM {POSTED}) GROUP BY ALL""")
def letter_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = reports.letter_actions(_timeline(spark, sf_dir))
    said = F.concat(F.col("evidence")["confidence"], F.lit("/"), F.col("evidence")["passages"])
    return cards.groupBy("title", F.col("when").alias("shown"), said.alias("evidence")).agg(F.count("*").alias("n"))


@register("letter_report", f"SELECT count(*) AS obligations, count(due) AS dated, count(*) FILTER (WHERE due_kind = 'worked_out') AS worked_out, count(*) FILTER (WHERE low) AS uncertain FROM {POSTED}")
def letter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.letter_report(_timeline(spark, sf_dir))


@register("confirmed_deadlines", f"SELECT seq, CASE WHEN seq = 7 AND seq % 5 = 2 THEN DATE '2001-02-13' WHEN seq = 7 THEN NULL ELSE due END AS due, CASE WHEN seq = 7 AND seq % 5 = 2 THEN 'yours' WHEN seq = 7 THEN NULL ELSE due_kind END AS due_kind FROM {POSTED}")
def confirmed_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person dates one letter; only its deadlines are counted anew."""
    done = timeline.confirm(_timeline(spark, sf_dir), 7, F.lit("2001-02-03").cast("date"))
    return done.select("seq", F.col("due.date").alias("due"), F.col("due.kind").alias("due_kind"))


@register("date_disputes", "SELECT o_orderkey AS document, o_orderdate::DATE AS letter_date, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + 1 END AS also_read FROM orders WHERE o_orderkey % 3 > 0")
def date_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a letter that open with different dates, or one without."""
    o, key, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    said = lambda c: F.concat(F.lit("Dated the "), c)
    one = o.select(key.alias("document"), F.lit(0).alias("ordinal"), said(D.in_words(day)).alias("text"))
    other = F.when(key % 3 == 0, D.in_words(day)).when(key % 3 == 1, D.in_words(F.date_add(day, 1))).otherwise("day")
    return passages.date_disputes(one, o.select(key.alias("document"), F.lit(0).alias("ordinal"), said(other).alias("text")))


@register("run_together_days", f"SELECT o_orderkey, o_orderdate::DATE AS found, strftime(o_orderdate, '%B %Y') || CASE WHEN month(o_orderdate) = month(o_orderdate::DATE + 20) THEN '' ELSE ' to ' || strftime(o_orderdate::DATE + 20, '%B %Y') END AS span FROM orders")
def run_together_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day and its month written as one word, as some prints have them."""
    day = F.col("o_orderdate").cast("date")
    end = F.when(F.dayofmonth(day).isin(1, 21, 31), "st").when(F.dayofmonth(day).isin(2, 22), "nd").when(F.dayofmonth(day).isin(3, 23), "rd").otherwise("th")
    text = F.concat(F.lit("from "), F.dayofmonth(day).cast("string"), end, F.date_format(day, "MMMM yyyy"), F.lit(" on"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.first_full_date(text).alias("found"), D.span_in_words(day, F.date_add(day, 20)).alias("span"))


# the pages of an order: its lines down the page, further apart where a flag changes
LINED = "(SELECT l_orderkey AS doc, 1 AS page, -sum(CASE WHEN l_quantity > 40 THEN 30 ELSE 10 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS row_y FROM lineitem)"


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    y = -F.sum(F.when(F.col("l_quantity") > 40, 30).otherwise(10)).over(order)
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), y.alias("row_y"))


@register("paragraph_breaks", f"""WITH g AS (SELECT *, lag(row_y) OVER (PARTITION BY doc ORDER BY row_y DESC) - row_y AS gap FROM {LINED}),
r AS (SELECT doc, gap, row_number() OVER (PARTITION BY doc ORDER BY gap) AS k, count(*) OVER (PARTITION BY doc) AS n FROM g WHERE gap IS NOT NULL),
u AS (SELECT doc, gap AS usual FROM r WHERE k = n // 2 + 1)
SELECT doc, row_y, sum(CASE WHEN gap > 1.4 * usual THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY row_y DESC)::BIGINT AS paragraph FROM g LEFT JOIN u USING (doc)""")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.paragraph_breaks(_lined(spark, sf_dir)).select("doc", "row_y", "paragraph")


# words of a reading: an order's lines in rows of three, with a hole after each second word
READING = """(SELECT l_orderkey AS doc, k // 3 AS row_no, k % 3 AS place, 0.9::DOUBLE - 0.05::DOUBLE * (k // 3) AS top, 0.2::DOUBLE * (k % 3) AS "left", 0.2::DOUBLE * (k % 3) + CASE WHEN k % 3 = 1 THEN 0.1::DOUBLE ELSE 0.18::DOUBLE END AS "right", 'w' || l_partkey::VARCHAR AS text, CASE WHEN l_quantity < 10 THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k FROM lineitem))"""


def _reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    rows = table(spark, sf_dir, "lineitem").withColumn("k", k)
    row, place = F.floor(F.col("k") / 3), F.col("k") % 3
    left = F.lit(0.2) * place
    return rows.select(F.col("l_orderkey").alias("doc"), row.alias("row_no"), place.alias("place"), (F.lit(0.9) - F.lit(0.05) * row).alias("top"), left.alias("left"), (left + F.when(place == 1, 0.1).otherwise(0.18)).alias("right"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), F.when(F.col("l_quantity") < 10, 0.4).otherwise(0.9).alias("confidence"))


@register("reading_lines", f"SELECT doc, string_agg(text, ' ' ORDER BY place) AS line, min(confidence) AS confidence, count(*) AS n FROM {READING} GROUP BY doc, row_no, place = 2".replace("count(*) AS n", "round(min(\"left\"), 6) AS \"left\", round(max(\"right\"), 6) AS \"right\""))
def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one height and small gaps are a line; a hole begins the next."""
    found = geometry.reading_lines(_reading(spark, sf_dir), "doc")
    return found.select("doc", F.col("text").alias("line"), "confidence", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@register("readable", f"SELECT doc, count(*) AS lines, count(*) FILTER (WHERE c < 0.5) AS doubtful, count(*) FILTER (WHERE c < 0.5) > 0.25 * count(*) AS refused FROM (SELECT doc, min(confidence) AS c FROM {READING} GROUP BY doc, row_no, place = 2) GROUP BY doc")
def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.readable(geometry.reading_lines(_reading(spark, sf_dir), "doc"), "doc")


@register("reading_disagreements", "SELECT l_orderkey AS doc, k AS line_no, 'W ' || l_partkey::VARCHAR AS text, CASE l_partkey % 4 WHEN 1 THEN 'w' || (l_partkey + 1)::VARCHAR END AS also FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE l_partkey % 4 > 0")
def reading_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading agrees but for case and spaces, says something else, lies aside, or has no such line."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), k.alias("line_no"), "l_partkey")
    kind, at = F.col("l_partkey") % 4, F.lit(0.95) - F.lit(0.03) * F.col("line_no")
    one = rows.select("doc", "line_no", at.alias("top"), F.lit(0.1).alias("left"), F.concat(F.lit("W "), F.col("l_partkey").cast("string")).alias("text"))
    said = F.concat(F.lit("w"), (F.col("l_partkey") + F.when(kind == 1, 1).otherwise(0)).cast("string"))
    other = rows.where(kind != 3).select("doc", (at + F.lit(0.002)).alias("top"), F.when(kind == 2, 0.3).otherwise(0.11).alias("left"), said.alias("text"))
    return geometry.disagreements(one, other).select("doc", "line_no", "text", "also")


# tables of an order: a row a line, in three cells of two words
CELLS = "(SELECT l_orderkey AS doc, l_partkey AS a, l_suppkey AS b, l_linenumber AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_extendedprice::DECIMAL(18,2) AS price FROM lineitem)"


def _celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("k", k)
    word = lambda x, text: F.struct(F.lit(float(x)).alias("x"), F.lit(float(x + 20)).alias("right"), text.alias("text"))
    price = F.when(F.col("k") == 1, "price").otherwise(F.concat(F.lit("£"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)))
    words = F.array(word(0, F.lit("part")), word(25, F.col("l_partkey").cast("string")), word(100, price), word(200, F.when(F.col("l_linenumber") % 2 == 0, "even")))
    placed = rows.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.posexplode(words).alias("i", "w"), (-12.0 * F.col("k")).alias("row_y"))
    return placed.where("w.text IS NOT NULL").select("doc", "page", (-F.col("row_y") * 100 + F.col("i")).cast("long").alias("frag_no"), "w.text", "w.x", "w.right", F.col("row_y").alias("y"), "row_y")


@register("page_lines", f"SELECT doc, (-12.0::DOUBLE * k) AS row_y, 'part ' || a::VARCHAR || ' ' || CASE WHEN k = 1 THEN 'price' ELSE '£' || format('{{:,.2f}}', price::DOUBLE) END || CASE WHEN c % 2 = 0 THEN ' even' ELSE '' END AS line FROM {CELLS}")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.lines(_celled(spark, sf_dir)).select("doc", "row_y", "line")


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "page").distinct().select("doc", "page", F.explode(F.array(F.lit(50.0), F.lit(150.0))).alias("at"))


@register("page_cells", f"SELECT doc, (-12.0::DOUBLE * k) AS row_y, 'part ' || a::VARCHAR || '|' || CASE WHEN k = 1 THEN 'price' ELSE '£' || format('{{:,.2f}}', price::DOUBLE) END || '|' || CASE WHEN c % 2 = 0 THEN 'even' ELSE '' END AS cells FROM {CELLS}")
def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _celled(spark, sf_dir)
    return geometry.cells(rows, _edges(rows)).select("doc", "row_y", F.array_join("cells", "|").alias("cells"))


@register("quoted_tables", f"SELECT doc, count(*) >= 2 AS tabular, 'false,' || (count(*) > 1)::VARCHAR || ',false' AS numeric FROM {CELLS} GROUP BY doc")
def quoted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are tables, and which of their columns hold figures below the head."""
    rows = _celled(spark, sf_dir)
    tables = geometry.cells(rows, _edges(rows)).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("row_y")).alias("y"), "cells"))).alias("t")).select("doc", F.transform("t", lambda r: r["cells"]).alias("rows"))
    numeric = F.transform(reports.numeric_columns(F.col("rows")), lambda x: x.cast("string"))
    return tables.select("doc", geometry.is_tabular(F.col("rows")).alias("tabular"), F.array_join(numeric, ",").alias("numeric"))


@register("column_cuts", "SELECT o_custkey AS doc, 300.0::DOUBLE AS at FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderkey % 2 = 0) >= 2 AND count(*) FILTER (WHERE o_orderkey % 2 = 1) >= 2")
def column_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose in two columns: the widest gap that no row spans on both sides is the cut."""
    odd = F.col("o_orderkey") % 2 == 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.lit(1).alias("page"), F.when(odd, 400.0).otherwise(0.0).alias("x"), F.when(odd, 700.0).otherwise(300.0).alias("right"), (-10.0 * F.col("o_orderkey")).alias("row_y"))
    return geometry.column_cut(rows, geometry.channels(rows, "doc", "page")).select("doc", "at")


def _signed(spark: SparkSession, sf_dir: str, balanced: bool) -> DataFrame:
    """Orders printed under one amount column, with a running balance or without."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)") * F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    rows = o.select(F.col("o_custkey").cast("string").alias("doc"), "o_orderdate", "o_orderkey", amount.alias("amount"), F.sum(amount).over(order).cast("decimal(28,2)").alias("balance"), F.row_number().over(order).alias("k"))
    cell = lambda i, text, x, r: F.struct(F.lit(i).alias("i"), text.alias("text"), F.lit(float(x)).alias("x"), F.lit(float(r)).alias("right"))
    body = [cell(0, F.date_format("o_orderdate", "dd/MM/yyyy"), 0, 50), cell(1, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), 100, 180), cell(2, F.format_number("amount", 2), 260, 300)]
    head = [cell(0, F.lit("Date"), 0, 30), cell(1, F.lit("Description"), 100, 170), cell(2, F.lit("Amount"), 250, 300)]
    if balanced:
        body.append(cell(3, F.format_number("balance", 2), 360, 400))
        head.append(cell(3, F.lit("Balance"), 350, 400))
    lines = rows.select("doc", F.explode(F.array(*body)).alias("c"), (-10.0 * F.col("k")).alias("y"))
    top = rows.select("doc").distinct().select("doc", F.explode(F.array(*head)).alias("c"), F.lit(0.0).alias("y"))
    return lines.unionByName(top).select("doc", F.lit(1).alias("page"), (F.col("y") * -1000 + F.col("c.i")).cast("long").alias("frag_no"), "c.text", "c.x", "c.right", "y")


@register("signed_statement", """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey::VARCHAR AS doc, 'Order ' || o_orderkey::VARCHAR AS raw_merchant, o_totalprice::DECIMAL(18,2) AS amount, CASE WHEN n > 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END END AS direction, CASE WHEN n <= 2 THEN 'undetermined' END AS reason FROM orders JOIN n USING (o_custkey)""")
def signed_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balances settle what a sign means where there are two steps of them."""
    rows = statement_tables.reconstructed(_signed(spark, sf_dir, balanced=True))
    return rows.select("doc", "raw_merchant", "amount", "direction", "reason")


@register("unbalanced_statement", "SELECT o_custkey::VARCHAR AS doc, 'undetermined' AS reason, count(*) // count(*) AS pages FROM orders GROUP BY o_custkey")
def unbalanced_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed column without balances is known, and refused for that reason."""
    return statement_tables.reconstructed(_signed(spark, sf_dir, balanced=False)).groupBy("doc", "reason").agg(F.count("*").alias("pages"))


PAIRS = "SELECT DISTINCT x[i] || ' ' || x[i + 1] AS quote FROM (SELECT string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS x FROM benchmark), unnest(range(1, len(x))) AS u(i) WHERE x[i] <> '' AND x[i + 1] <> ''"


@register("ambiguous_quotes", f"""WITH s AS MATERIALIZED (SELECT document, {SQUASHED.format(c='text')} AS text FROM (SELECT doc_id AS document, unnest(string_split(text, chr(10))) AS text FROM documents)), q AS MATERIALIZED ({PAIRS})
SELECT quote, document, count(*) AS passages FROM q JOIN s ON contains(s.text, quote) GROUP BY ALL HAVING count(*) > 1""")
def ambiguous_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words of whole benchmark texts that stand in several lines of a document."""
    words = table(spark, sf_dir, "benchmark").select(F.split(F.regexp_replace("text", r"\s+", " "), " ").alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p"))
    quotes = pairs.where("p.a <> '' AND p.b <> ''").select(F.concat_ws(" ", "p.a", "p.b").alias("quote")).distinct().withColumn("quote_id", F.col("quote"))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return passages.ambiguous_quotes(passages.quote_places(quotes, lines, repeated=True)).withColumnRenamed("quote_id", "quote")


@register("short_quotes", "SELECT p_partkey AS quote_id, n_nationkey AS document FROM part, nation WHERE contains('the nation ' || n_name || ' of region ' || n_regionkey::VARCHAR, CASE p_partkey % 4 WHEN 0 THEN 'TION_' || (p_size % 25)::VARCHAR WHEN 1 THEN 'nation NATION_' || (p_size % 25)::VARCHAR WHEN 2 THEN 'gion ' || (p_size % 5)::VARCHAR ELSE 'n of' END)")
def short_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of one and two words, which may begin and end inside words."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit("TION_"), (size % 25).cast("string"))).when(k == 1, F.concat(F.lit("nation NATION_"), (size % 25).cast("string"))).when(k == 2, F.concat(F.lit("gion "), (size % 5).cast("string"))).otherwise("n of")
    quotes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("quote_id"), text.alias("quote"))
    said = F.concat(F.lit("the nation  "), "n_name", F.lit("\nof region "), F.col("n_regionkey").cast("string"))
    segments = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document"), F.lit(0).alias("ordinal"), said.alias("text"))
    return passages.quote_places(quotes, segments).select("quote_id", "document")


@register("guarded_terms", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN 'other' WHEN 1 THEN 'quote_not_on_page' WHEN 2 THEN 'quote_without_value' WHEN 3 THEN 'wrong_shape' END AS guard FROM lineitem""")
def guarded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms fail the first of four checks in order; a term may take several kinds."""
    k = F.col("l_partkey") % 6
    amount = F.concat(F.lit("£"), F.col("l_quantity").cast("int").cast("string"))
    value = F.when(k == 5, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" days"))).otherwise(amount)
    quote = F.when(k == 2, "The sum is due").otherwise(F.concat(F.lit("The sum is "), value, F.lit(" in all")))
    page = F.when(k == 1, "Nothing of the kind").otherwise(F.concat(F.lit("Please note.  The sum\n"), F.substring(quote, 9, 200), F.lit(", as agreed")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _pick(k, "other", "fee", "fee", "notice", "fee", "either").alias("term"), value.alias("value"), quote.alias("quote"), page.alias("segment"))
    kinds = spark.createDataFrame([("fee", ["money"]), ("notice", ["duration"]), ("either", ["money", "duration"])], "term string, kinds array<string>")
    return terms.guarded(rows, kinds).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "guard")


@register("comparison_order", KEYS + """, d AS (SELECT term, basis, CASE WHEN nb = 0 THEN 'added' WHEN na = 0 THEN 'removed' WHEN vb = va THEN 'unchanged' ELSE 'changed' END AS change FROM r WHERE why IS NULL)
SELECT *, (row_number() OVER (ORDER BY CASE change WHEN 'changed' THEN 0 WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, term, basis) - 1)::BIGINT // 10 AS decade, 'line ' || right(basis, 1) AS label FROM d""")
def comparison_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed first, then added, removed and unchanged ones, each by name."""
    rows = terms.placed(_compared(spark, sf_dir)[0].select("term", "basis", "change"), "place")
    return rows.select("term", "basis", "change", F.floor((F.col("place") - 1) / 10).alias("decade"), terms.basis_label(F.col("basis")).alias("label"))


@register("audit_summaries", """SELECT o_custkey, CASE WHEN n = 0 THEN 'No repeating payments were found.' ELSE n::VARCHAR || CASE WHEN n = 1 THEN ' repeating payment' ELSE ' repeating payments' END || ' cost £' || format('{:,.2f}', total::DOUBLE) || ' a year, £' || format('{:,.2f}', monthly::DOUBLE) || ' a month.' END
  || CASE WHEN rises > 0 THEN ' ' || rises::VARCHAR || CASE WHEN rises = 1 THEN ' price' ELSE ' prices' END || ' went up.' ELSE '' END || CASE WHEN review > 0 THEN ' ' || review::VARCHAR || CASE WHEN review = 1 THEN ' item needs' ELSE ' items need' END || ' a look, and isn''t counted.' ELSE '' END AS summary
FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS rises, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS review, sum(o_totalprice::DECIMAL(18,2)) AS total, sum(o_totalprice::DECIMAL(18,0))::DECIMAL(28,2) AS monthly FROM orders GROUP BY o_custkey)""")
def audit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, price = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    report = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("recurring"), F.count_if(F.col("o_orderkey") % 5 == 0).alias("price_rises"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("needs_review"), F.sum(price.cast("decimal(18,2)")).alias("annualised_total"), F.sum(price.cast("decimal(18,0)")).cast("decimal(28,2)").alias("monthly_equivalent"))
    return reports.audit_summary(report).select("o_custkey", "summary")


@register("payments_lines", """SELECT o_custkey, CASE WHEN count(*) BETWEEN 2 AND 24 THEN string_agg(CASE WHEN d = last THEN '▲ ' ELSE '' END || '£' || format('{:,.2f}', amount::DOUBLE), ' · ' ORDER BY d, amount) END AS line FROM (SELECT o_custkey, o_orderdate::DATE AS d, o_totalprice::DECIMAL(18,2) AS amount, max(o_orderdate::DATE) OVER (PARTITION BY o_custkey) AS last FROM orders) GROUP BY o_custkey""")
def payments_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(day.alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))).alias("evidence"), F.max(day).alias("rise"))
    return held.select("o_custkey", reports.payments_line(F.col("evidence"), F.col("rise")).alias("line"))


@register("calendar_entries", "SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:Order\\, ' || o_orderkey::VARCHAR || '\\; ' || o_orderpriority || chr(13) || chr(10) || 'END:VEVENT' || chr(13) || chr(10) AS entry FROM orders")
def calendar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.operators import audit

    title = F.concat(F.lit("Order, "), F.col("o_orderkey").cast("string"), F.lit("; "), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", audit.calendar_entry(title, F.col("o_orderdate").cast("date")).alias("entry"))


@register("middle_values", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, max(CASE WHEN k = n // 2 + 1 THEN o_orderkey END) AS upper, ((max(CASE WHEN k = (n + 1) // 2 THEN o_orderkey END) + max(CASE WHEN k = n // 2 + 1 THEN o_orderkey END)) // 2)::BIGINT AS mean_of_middles FROM r GROUP BY o_custkey""")
def middle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    return held.select("o_custkey", N.upper_median(F.col("a")).alias("upper"), N.integer_median(F.col("a")).alias("mean_of_middles"))
