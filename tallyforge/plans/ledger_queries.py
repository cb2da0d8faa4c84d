"""Queries over claims of answers, pages to passages, and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.operators import cadence, claims, evals, fixtures, merchants, pages, passages, terms, timeline
from tallyforge.plans.catalog import register
from tallyforge.plans.eval_queries import PASSAGE
from tallyforge.plans.letter_queries import CELLS, _celled
from tallyforge.plans.tables import SCORED, scored, table
from tallyforge.sources import beds


def _pick(k, *parts: str):
    return F.element_at(F.array(*map(F.lit, parts)), (k % len(parts) + 1).cast("int"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about orders: one or two claims each, on passages that ask or offer."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    claim = lambda kind: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("Party "), (F.col("o_custkey") % 9).cast("string")).alias("party"), D.in_words(day).alias("deadline"))
    none = F.array().cast("array<struct<kind:string,party:string,deadline:string>>")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("passage-"), key.cast("string")).alias("parent_id"),
        F.lit("obligations").alias("step"),
        F.floor(key / 8).alias("batch"),
        (key % 8).cast("int").alias("item"),
        F.concat(_pick(key, "You may reply about order ", "You must pay order ", "You can pay, and must reply about "), key.cast("string")).alias("text"),
        F.when(key % 5 == 0, "low").otherwise("high").alias("confidence"),
        F.when(key % 4 == 3, none).when(key % 2 == 0, F.array(claim("payment"), claim("reply"))).otherwise(F.array(claim("reply"))).alias("claims"),
    )


GIVEN = "(SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS offered, CASE WHEN o_orderkey % 4 = 3 THEN 0 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, 'Party ' || (o_custkey % 9)::VARCHAR AS party, strftime(o_orderdate, '%-d %B %Y') AS deadline FROM orders)"


@register("claim_ledger", f"SELECT 'claim-' || left(sha256('obligations' || chr(31) || (k // 8)::VARCHAR || chr(31) || (k % 8)::VARCHAR || chr(31) || i::VARCHAR), 16) AS claim_id, 'passage-' || k::VARCHAR AS parent_id, i::INT AS candidate_index, CASE WHEN n = 2 AND i = 1 THEN 'payment' ELSE 'reply' END AS said, 'passed,passed,' || CASE WHEN offered THEN 'failed' ELSE 'passed' END AS outcomes, CASE WHEN offered THEN 'needs_review' ELSE 'accepted' END AS terminal FROM {GIVEN}, range(1, 3) t(i) WHERE i <= n")
def claim_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.ledger(_answers(spark, sf_dir))
    outcomes = F.array_join(F.transform("checks", lambda c: c["outcome"]), ",")
    return rows.select("claim_id", "parent_id", "candidate_index", F.get_json_object("candidate", "$.kind").alias("said"), outcomes.alias("outcomes"), "terminal")


@register("answered_obligations", f"SELECT k, CASE WHEN n = 2 AND i = 1 THEN 'payment' ELSE 'reply' END AS kind, party, deadline, confidence FROM {GIVEN}, range(1, 3) t(i) WHERE i <= n AND NOT offered")
def answered_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.obligations(_answers(spark, sf_dir))
    return rows.select(F.substring("parent_id", 9, 20).cast("long").alias("k"), "kind", "party", "deadline", "confidence")


@register("offered_passages", f"SELECT 'passage-' || k::VARCHAR AS parent_id, 'You may reply about order ' || k::VARCHAR AS subject FROM {GIVEN} WHERE offered AND n > 0")
def offered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.offered(_answers(spark, sf_dir)).select("parent_id", "subject")


@register("review_routes", "SELECT event_id, CASE WHEN event_id % 4 = 3 OR (event_id % 4 = 0 AND event_id % 2 = 0 AND event_type <> 'error') THEN 'kept' ELSE 'review' END AS routed, event_id % 4 = 3 OR (event_id % 4 = 0 AND event_type <> 'error') AS unspoken FROM events")
def review_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unsure classification stays; what has no answer, or another fault, goes to a person."""
    k = F.col("event_id") % 4
    reason = F.when(k == 0, "low_confidence").when(k == 1, "missing").when(k == 2, "bad_echo")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "classify").otherwise("normalise").alias("role"), reason.alias("reason"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("answer"))
    return claims.route_review(rows).select("event_id", "routed", F.col("why").isNull().alias("unspoken"))


@register("declined_spend", "SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN o_custkey % 3 = 0 THEN 'cadence_despite_periodic' ELSE 'cadence' END AS kind_from FROM orders GROUP BY o_custkey")
def declined_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    looks = held.where("o_custkey % 3 < 2").select("o_custkey", (F.col("o_custkey") % 3 == 0).alias("periodic"))
    return claims.declined(held.withColumn("confidence", F.lit("high")), looks, "o_custkey")


@register("derivation_checks", f"SELECT 'passage-' || k::VARCHAR AS parent_id, i::INT AS candidate_index, CASE WHEN k % 7 = 0 THEN 'changed_value' ELSE 'passed' END AS outcome, CASE WHEN offered THEN 'needs_review' WHEN k % 7 = 0 THEN 'pipeline_introduced_error' ELSE 'accepted' END AS terminal FROM {GIVEN}, range(1, 3) t(i) WHERE i <= n")
def derivation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date that a stage got wrong is the pipeline's error if the claim was accepted."""
    rows = claims.ledger(_answers(spark, sf_dir))
    said = F.get_json_object("candidate", "$.deadline")
    wrong = F.substring("parent_id", 9, 20).cast("long") % 7 == 0
    done = claims.derivation_checked(rows, "due date", said, F.when(wrong, F.lit("1 May 1900")).otherwise(said))
    return done.select("parent_id", "candidate_index", F.element_at("checks", -1)["outcome"].alias("outcome"), "terminal")


PRINTED = "'part ' || a::VARCHAR || ' ' || CASE WHEN k = 1 THEN 'price' ELSE '£' || format('{:,.2f}', price::DOUBLE) END || CASE WHEN c % 2 = 0 THEN ' even' ELSE '' END"


@register("page_passages", f"SELECT document, page, (row_number() OVER (PARTITION BY document ORDER BY page, apart) - 1)::INT AS ordinal, text FROM (SELECT doc AS document, (k - 1) // 4 + 1 AS page, (k - 1) % 4 = 3 AS apart, string_agg({PRINTED}, ' ' ORDER BY k) AS text FROM {CELLS} GROUP BY ALL)")
def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines a page, the last one far below: two passages, and ordinals that count on."""
    rows = _celled(spark, sf_dir)
    k = -F.col("row_y") / 12
    page = (F.floor((k - 1) / 4) + 1).cast("int")
    # gaps of 2, 6 and 18: the last is over 1.4 times the middle one
    at = (k - 1) % 4
    spread = rows.withColumn("page", page).withColumn("row_y", -F.pow(F.lit(3.0), at))
    return pages.passages(spread).select("document", "page", "ordinal", "text")


BLOCKS = (
    ("columns", "left one      right one\nleft two      right two\nleft three\n              right four", "left|one/left|two/left|three#right|one/right|two/right|four"),
    ("table", "item      price\nfee       10.00\ntax       2.50", "item|price/fee|10.00/tax|2.50"),
    ("prose", "a line of plain words\nand one more. Then  two\nspaces after a stop", "a line of plain words/and one more. Then two/spaces after a stop"),
)


@register("monospaced_blocks", " UNION ALL ".join(f"SELECT p_partkey, '{r}' AS reading, '{t}' AS told FROM part WHERE p_partkey % 3 = {i}" for i, (r, _, t) in enumerate(BLOCKS)))
def monospaced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks set with spaces: columns, tables, or prose."""
    text = F.element_at(F.array(*[F.lit(b) for _, b, _ in BLOCKS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    blocks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), text.alias("text"))
    read = pages.read_blocks(blocks).select("doc", "reading", "part", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("told"))
    whole = read.groupBy("doc", "reading").agg(F.array_sort(F.collect_list(F.struct("part", "told"))).alias("parts"))
    return whole.select(F.col("doc").alias("p_partkey"), "reading", F.array_join(F.transform("parts", lambda p: p["told"]), "#").alias("told"))


SERIES = "(SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)"


@register("audit_scores", f"SELECT source, round(CASE WHEN w + g = 0 THEN 1.0 ELSE 2.0 * b / (w + g) END, 9)::DOUBLE AS end_to_end FROM (SELECT source, count(*) FILTER (WHERE n % 3 > 0) AS w, count(*) FILTER (WHERE n % 2 > 0) AS g, count(*) FILTER (WHERE n % 3 > 0 AND n % 2 > 0) AS b FROM {SERIES} GROUP BY source) WHERE w + g > 0")
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want, got = _series(spark, sf_dir)
    return evals.audit_end_to_end(want, got, "source").withColumn("end_to_end", F.round(F.col("end_to_end").cast("double"), 9))


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    rows = held.select("source", F.col("lang").alias("merchant"), F.lit("monthly").alias("period"), "n")
    return rows.where("n % 3 > 0"), rows.where("n % 2 > 0").withColumn("merchant", F.upper("merchant"))


OUTCOMES = f"(SELECT source, lang, CASE WHEN asserted = 'review' THEN 'routed' WHEN expected = (asserted = 'class') THEN 'right' ELSE 'wrong' END AS outcome FROM {SCORED})"


@register("evaluation", f"""WITH s AS (SELECT source, lang, count(*) FILTER (WHERE outcome = 'right')::DOUBLE / count(*) AS score FROM {OUTCOMES} GROUP BY ALL),
e AS (SELECT source, CASE WHEN w + g = 0 THEN 1.0 ELSE 2.0 * b / (w + g) END AS e2e FROM (SELECT source, count(*) FILTER (WHERE n % 3 > 0) AS w, count(*) FILTER (WHERE n % 2 > 0) AS g, count(*) FILTER (WHERE n % 3 > 0 AND n % 2 > 0) AS b FROM {SERIES} GROUP BY source) WHERE w + g > 0),
o AS (SELECT source, count(*) AS decisions, count(*) FILTER (WHERE outcome = 'right') AS "right", count(*) FILTER (WHERE outcome = 'routed') AS reviewed FROM {OUTCOMES} GROUP BY source)
SELECT source, decisions, "right", reviewed, CASE WHEN e2e >= 0.95 AND (SELECT bool_and(score >= CASE lang WHEN 'en' THEN 0.3 ELSE 0.1 END) FROM s WHERE s.source = o.source) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM o LEFT JOIN e USING (source)""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fixture's decisions, end-to-end score and verdict in one job."""
    right = F.col("expected") == (F.col("asserted") == "class")
    items = scored(spark, sf_dir).select("source", F.col("strata")[0].alias("step"), F.when(F.col("asserted") == "review", "routed").when(right, "right").otherwise("wrong").alias("outcome"))
    bars = table(spark, sf_dir, "documents").select(F.col("lang").alias("step"), F.when(F.col("lang") == "en", 0.3).otherwise(0.1).alias("bar")).distinct()
    return evals.evaluation(items, *_series(spark, sf_dir), bars, "source").select("source", "decisions", "right", "reviewed", "verdict")


@register("record_digests", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey::VARCHAR || ',\"n_regionkey\":' || n_regionkey::VARCHAR || '}') AS digest FROM nation")
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long it took is no part of a record's digest."""
    rows = table(spark, sf_dir, "nation").withColumn("wall_ms", F.col("n_nationkey") * 7)
    return rows.select("n_nationkey", evals.record_digest(rows, ["wall_ms"]).alias("digest"))


@register("respliced_reports", "SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey = 2 THEN 'mutated' ELSE 'baseline' END AS run FROM nation WHERE n_regionkey <> 2 OR n_nationkey % 2 = 0")
def respliced_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutated fixture's items take the place of its own in the report."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    replayed = n.where("n_regionkey = 2 AND n_nationkey % 2 = 0").withColumn("run", F.lit("mutated"))
    return evals.respliced(n.withColumn("run", F.lit("baseline")), replayed, "n_regionkey")


@register("baseline_standing", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'refused' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-15') >= 30 THEN 'stale' ELSE 'current' END AS standing FROM orders")
def baseline_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 1, 13).otherwise(14)
    return table(spark, sf_dir, "orders").select("o_orderkey", evals.baseline_standing(version, F.col("o_orderdate").cast("date"), F.lit("1998-08-15").cast("date"), 14).alias("standing"))


@register("projections", "SELECT s_suppkey, '{' || CASE WHEN s_suppkey % 2 = 0 THEN '\"name\":\"' || s_name || '\",' ELSE '' END || '\"s_nationkey\":' || s_nationkey::VARCHAR || ',\"s_suppkey\":' || s_suppkey::VARCHAR || '}' AS json FROM supplier")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return evals.projected(rows, "s_suppkey")


@register("first_hosts", "SELECT n_regionkey::VARCHAR AS shape, min('generated-' || n_regionkey::VARCHAR || '-' || n_name) AS host FROM nation GROUP BY n_regionkey")
def first_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("generated-"), F.col("n_regionkey").cast("string"), F.lit("-"), "n_name")
    shapes = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("shape"), F.concat(F.lit("generated-"), F.col("r_regionkey").cast("string")).alias("prefix"))
    return fixtures.first_hosts(table(spark, sf_dir, "nation").select(name.alias("name")), shapes)


@register("fixture_files", "SELECT 'beds/f' || n_nationkey::VARCHAR AS stem, role, 'beds/f' || n_nationkey::VARCHAR || CASE WHEN role IS NULL THEN '.csv' ELSE '.' || role || '.txt' END AS input, CASE WHEN n_nationkey % 4 > 0 THEN 'beds/f' || n_nationkey::VARCHAR || '.expected.json' END AS expected FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE unnest(['before', 'after']) END AS role FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 0)")
def fixture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of one or two roles beside what is expected of them."""
    n, stem = F.col("n_nationkey"), F.concat(F.lit("beds/f"), F.col("n_nationkey").cast("string"))
    inputs = F.when(n % 2 == 0, F.array(F.concat(stem, F.lit(".csv")))).otherwise(F.array(F.concat(stem, F.lit(".before.txt")), F.concat(stem, F.lit(".after.txt"))))
    more = F.when(n % 4 > 0, F.array(F.concat(stem, F.lit(".expected.json")))).otherwise(F.array().cast("array<string>"))
    return fixtures.paired_files(table(spark, sf_dir, "nation").select(F.explode(F.concat(inputs, more)).alias("path")))


@register("truthful_answers", f"SELECT conv_id * 100 + turn AS id, CASE WHEN EXISTS (SELECT 1 FROM conversations e WHERE e.role = 'user' AND {PASSAGE.format(c='e.text')} = {PASSAGE.format(c='a.text')}) THEN 1 ELSE 0 END AS claims FROM conversations a")
def truthful_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every passage: what its author wrote down, else nothing."""
    c, seq = table(spark, sf_dir, "conversations"), F.col("conv_id") * 100 + F.col("turn")
    items = c.select(seq.alias("id"), F.concat(F.col("text"), F.lit(" ")).alias("passage"))
    expected = c.where("role = 'user'").select(seq.alias("seq"), F.col("text").alias("passage"), F.array(F.lit("claim")).alias("claims"))
    return fixtures.truthful_answers(items, expected).select("id", F.size("claims").alias("claims"))


@register("month_days", "SELECT o_orderkey, (date_trunc('month', o_orderdate) + to_months((o_custkey % 18)::INT))::DATE + (o_custkey % 28)::INT AS date FROM orders")
def month_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = D.month_day(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 18).cast("int"), (F.col("o_custkey") % 28 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("date"))


LINES = "(SELECT doc_id AS document, generate_subscripts(x, 1) - 1 AS ordinal, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@register("opening_lines", f"SELECT count(*) AS lines, count(DISTINCT document) AS documents, count(*) FILTER (WHERE before < 600) AS in_opening FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {LINES})")
def opening_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of all texts the search for a letter's date covers."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    told = passages.with_reach(lines)
    return told.agg(F.count("*").alias("lines"), F.countDistinct("document").alias("documents"), F.count_if(F.col("read") < passages.OPENING).alias("in_opening"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in rows)


@register("statement_bed", f"SELECT c_custkey::VARCHAR AS account, upper(replace(shape, '_', ' ')) AS merchant, period, rose FROM customer, (VALUES {_values([(s, *t) for s, ts in beds.TRUTH.items() for t in ts])}) AS t(shape, period, rose)")
def statement_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated statements: every series is found, none that isn't there."""
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    rows = merchants.with_stem(beds.disguised(beds.statements(accounts)))
    found = cadence.series(rows.withColumn("merchant", F.col("stem")), parts=beds.parts(accounts))
    return found.select("account", "merchant", "period", F.col("rise_to").isNotNull().alias("rose"))


#: Each account's series of the bed, and what the twin with one dearer payment changes.
TWIN = f"SELECT c_custkey::VARCHAR AS account, upper(replace(shape, '_', ' ')) AS merchant, period, rose OR shape = 'monthly_level' AS rose FROM customer, (VALUES {_values([(s, *t) for s, ts in beds.TRUTH.items() for t in ts])}) AS t(shape, period, rose) WHERE shape <> 'weekly_level'"


@register("statement_twins", TWIN)
def statement_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bed's twin in another order, without one merchant, with look-alikes, and with one
    payment dearer: nothing else moves."""
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    bed = beds.statements(accounts)
    twin = beds.reordered(beds.with_strangers(beds.dearer(beds.one_removed(bed, "weekly_level"), "monthly_level")))
    found = cadence.series(merchants.with_stem(twin).withColumn("merchant", F.col("stem")), parts=beds.parts(accounts))
    return found.select("account", "merchant", "period", F.col("rise_to").isNotNull().alias("rose"))


DUE = {"dated": ("later", "read"), "counted": ("written + 14", "worked_out"), "anchored": ("later + 30", "worked_out"), "month_end": ("last_day(written)", "worked_out"), "pointed": ("later", "read"), "counted_from_a_date": ("later + 10", "worked_out"), "one_day": ("written + 1", "worked_out"), "month_end_of_anchor": ("last_day(later)", "worked_out"), "pointed_below": ("later", "read"), "dated_despite_anchor": ("later", "read")}
DUE_SQL = " ".join(f"WHEN '{s}' THEN {d}" for s, (d, _) in DUE.items())
DUE_KIND = " ".join(f"WHEN '{s}' THEN '{k}'" for s, (_, k) in DUE.items())


@register("letter_bed", f"SELECT shape, (CASE shape {DUE_SQL} END)::DATE AS due, CASE shape {DUE_KIND} END AS kind, count(*) AS n FROM (SELECT shape, written, (written + 21)::DATE AS later FROM (SELECT DATE '2024-03-04' + (s_suppkey % 300)::INT AS written FROM supplier), (VALUES {_values([(s,) for s in beds.LETTERS])}) AS t(shape)) GROUP BY ALL")
def letter_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated letters: every deadline is resolved, and those that can't be aren't."""
    segments, obligations = beds.letters(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    done = timeline.dated(obligations, segments)
    return done.groupBy("shape", F.col("due.date").alias("due"), F.col("due.kind").alias("kind")).agg(F.count("*").alias("n"))


HARD = _values([(s, c[1], str(c[4]) if c[4] is not None else None, c[5]) for s, (_, cs) in beds.HARD_LETTERS.items() for c in cs])


@register("hard_letters", f"SELECT s_suppkey AS sender, shape, kind, (DATE '2024-03-04' + (s_suppkey % 300)::INT + days::INT)::DATE AS due, how FROM supplier, (VALUES {HARD}) AS t(shape, kind, days, how)")
def hard_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misleading letters: what only permits becomes no action, everything else its own day."""
    segments, asked = beds.hard_letters(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    answers = asked.join(segments, ["document", "ordinal"]).withColumns({"parent_id": F.col("seq"), "claims": F.array(F.col("kind"))})
    offers = claims.offered(answers).select(F.col("parent_id").alias("seq"), F.lit("offered").alias("offer"))
    done = timeline.dated(asked, segments).join(offers, "seq", "left")
    sender = F.expr(f"document div {len(beds.HARD_LETTERS)}").alias("sender")
    return done.select(sender, "shape", "kind", F.when(F.col("offer").isNull(), F.col("due.date")).alias("due"), F.coalesce("offer", "due.kind").alias("how"))


@register("renewal_bed", f"SELECT shape, verdict, count(*) AS n FROM supplier, (VALUES {_values([(s, v) for s, (_, _, vs) in beds.RENEWALS.items() for v in vs.split()])}) AS t(shape, verdict) GROUP BY ALL")
def renewal_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated renewals: every change is told, and what can't be compared is refused."""
    rows, _ = beds.renewals(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    diff, refused = terms.compare(rows, 0, 1, rows.select("term", "family").distinct())
    shape = F.regexp_extract("term", "^([a-z_]+?)_[0-9]+:", 1).alias("shape")
    told = diff.select("term", F.col("change").alias("verdict")).unionByName(refused.select("term", F.col("why").alias("verdict")))
    by = F.regexp_extract("term", "^([^:]+):", 1)
    return told.select(shape, "verdict", by.alias("one")).distinct().groupBy("shape", "verdict").agg(F.count("*").alias("n"))
