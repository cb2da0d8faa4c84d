"""Queries over expectations, evidence, relations, claims and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import numbers as N
from tallyforge.operators import audit, evals, fixtures, mutation, passages, registry, relations
from tallyforge.plans import pipelines
from tallyforge.plans.catalog import register
from tallyforge.plans.eval_queries import PASSAGE, _turns
from tallyforge.plans.queries import BRANDS, PER_YEAR, _views, wilson_sql
from tallyforge.plans.tables import PURCHASES, SCORED, purchases, scored, table


def _pick(k, *parts: str):
    return F.element_at(F.array(*map(F.lit, parts)), (k % len(parts) + 1).cast("int"))


NAMED = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END"


@register("merchant_join", f"WITH n AS (SELECT lower(p_name) AS k, any_value('shop ' || lower(p_name)) AS canonical FROM part WHERE p_name LIKE '%ring%' GROUP BY 1), a AS (SELECT n_nationkey, (SELECT min(p_name) FROM part WHERE p_partkey % 25 = n_nationkey) AS raw FROM nation) SELECT p_partkey, lower(coalesce(n.canonical, p_name)) AS merchant, count(a.raw) AS matches FROM part LEFT JOIN n ON n.k = lower(p_name) LEFT JOIN a ON coalesce('shop ' || (SELECT m.k FROM n m WHERE m.k = lower(a.raw)), lower(a.raw)) = lower(coalesce(n.canonical, p_name)) GROUP BY ALL")
def merchant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations find outcomes by a fixture's own names, ASCII case apart."""
    part = table(spark, sf_dir, "part")
    names = part.where(F.col("p_name").contains("ring")).select(F.lower("p_name").alias("raw"), F.concat(F.lit("Shop "), F.lower("p_name")).alias("canonical")).distinct()
    expected = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("raw"))
    outcome = part.groupBy((F.col("p_partkey") % 25).alias("n_nationkey")).agg(F.min("p_name").alias("raw"))
    return fixtures.by_merchant(expected, outcome, names).groupBy("p_partkey", "merchant").agg(F.count("raw_actual").alias("matches"))


@register("answered_nothing", f"SELECT {PASSAGE.format(c='text')} AS passage FROM conversations a WHERE role = 'assistant' AND turn % 3 > 0 AND NOT EXISTS (SELECT 1 FROM conversations e WHERE e.role = 'user' AND {PASSAGE.format(c='e.text')} = {PASSAGE.format(c='a.text')}) GROUP BY 1")
def answered_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted answers without a claim on passages nobody authored, once each."""
    expected, actual = _turns(spark, sf_dir, "role = 'assistant'")
    none = F.array().cast("array<string>")
    decisions = actual.select("passage", F.lit(True).alias("accepted"), F.when(F.col("seq") % 100 % 3 > 0, none).otherwise(F.array(F.lit("claim"))).alias("claims"))
    from tallyforge.functions.text import passage_key

    return fixtures.answered_nothing(decisions, expected).select(passage_key(F.col("passage")).alias("passage"))


@register("trace_links", f"SELECT e.conv_id * 100 + e.turn AS item_id, t.conv_id * 100 + t.turn AS trace FROM conversations e JOIN conversations t ON e.role = 'user' AND {PASSAGE.format(c='e.text')} = {PASSAGE.format(c='t.text')}")
def trace_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual = _turns(spark, sf_dir)
    return fixtures.trace_links(expected, actual.select(F.col("seq").alias("trace"), F.concat(F.lit("\t"), "passage", F.lit(" \n")).alias("passage")))


@register("output_links", f"SELECT DISTINCT t.conv_id * 100 + t.turn AS trace, 'act-' || a.conv_id::VARCHAR AS action_id FROM conversations t JOIN conversations a ON {PASSAGE.format(c='t.text')} = {PASSAGE.format(c='a.text')}")
def output_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which traces an action shows as evidence."""
    c = table(spark, sf_dir, "conversations")
    traces = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("trace"), F.col("text").alias("passage"))
    actions = c.groupBy("conv_id").agg(F.collect_list(F.concat(F.lit(" "), "text")).alias("passages"))
    return fixtures.output_links(traces, actions.select(F.concat(F.lit("act-"), F.col("conv_id").cast("string")).alias("action_id"), "passages"))


SETS = "CASE p_size % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'exam' ELSE 'audition' END"


@register("eval_sets", f"SELECT p_partkey, 'exam' AS selected FROM part WHERE {SETS} = 'exam' UNION ALL SELECT p_partkey, 'audition' FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE {SETS} <> 'exam' ORDER BY p_partkey LIMIT 2)")
def eval_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exam as it is declared, and an audition of two named fixtures."""
    held = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f-"), F.col("p_partkey").cast("string")).alias("name"), _pick(F.col("p_size"), "development", "exam", "audition").alias("eval_set"))
    named = [r["name"] for r in held.where("eval_set <> 'exam'").orderBy("p_partkey").limit(2).collect()]
    exam = fixtures.select_set(held, "exam").select("p_partkey", F.lit("exam").alias("selected"))
    return exam.unionByName(fixtures.select_set(held, "audition", named).select("p_partkey", F.lit("audition").alias("selected")))


@register("wrong_decisions", "SELECT doc_id, CASE WHEN n_chars < 300 THEN false WHEN doc_id % 2 = 0 THEN lang <> 'en' WHEN n_chars % 2 = 0 THEN quality = 0 OR lang <> 'en' ELSE quality = 1 END AS wrong FROM labels JOIN documents USING (doc_id)")
def wrong_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    kind = F.when(F.col("doc_id") % 2 == 0, "classification").otherwise("extraction")
    outcome = F.when(F.col("n_chars") < 300, "review").when(F.col("n_chars") % 2 == 0, "found").otherwise("absent")
    expected = F.when((F.col("quality") == 1) | (F.col("doc_id") % 2 == 0), "en")
    return rows.select("doc_id", fixtures.is_wrong(kind, expected, F.col("lang"), outcome, expected == F.col("lang")).alias("wrong"))


# claims about sources and languages, and reports that measured them
CLAIMS = "(SELECT p_partkey AS claim_id, CASE WHEN p_size % 2 = 0 THEN 'src' || (p_size % 10)::VARCHAR END AS scope_pack, CASE WHEN p_size % 5 < 4 THEN 'en' ELSE 'de' END AS scope_model, CASE WHEN p_size % 7 = 0 THEN 'asserted' ELSE 'proven' END AS status, DATE '2024-01-01' + (p_size * 3) AS expires FROM part)"
REPORTS = "(SELECT source AS pack, lang AS model, max(CASE WHEN n_chars % 11 = 0 THEN 1 ELSE 2 END) AS version, CASE WHEN avg(n_chars) > 500 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM documents GROUP BY ALL)"


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    size = F.col("p_size")
    claims = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("claim_id"),
        F.when(size % 2 == 0, F.concat(F.lit("src"), (size % 10).cast("string"))).alias("scope_pack"),
        F.when(size % 5 < 4, "en").otherwise("de").alias("scope_model"),
        F.lit(None).cast("string").alias("scope_eval_set"),
        F.when(size % 7 == 0, "asserted").otherwise("proven").alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), size * 3).alias("expires"),
        F.array(F.col("p_partkey") + 1, F.col("p_partkey") - 2).alias("contradicts"),
    )
    reports = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("pack"), F.col("lang").alias("model")).agg(F.max(F.when(F.col("n_chars") % 11 == 0, 1).otherwise(2)).alias("version"), F.when(F.avg("n_chars") > 500, "PASS").otherwise("FAIL").alias("verdict"))
    return claims, reports.withColumn("eval_set", F.lit("exam"))


@register("claim_reports", f"SELECT claim_id, pack, model FROM {CLAIMS} c JOIN {REPORTS} r ON (scope_pack IS NULL OR scope_pack = pack) AND scope_model = model")
def claim_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.matching_reports(*_claims(spark, sf_dir)).select("claim_id", "pack", "model")


STATUS = f"""(SELECT claim_id, status, why, CASE WHEN why IS NULL THEN status ELSE 'unproven' END AS effective FROM (SELECT claim_id, any_value(status) AS status, CASE WHEN any_value(status) = 'proven' THEN CASE WHEN any_value(expires) <= DATE '2024-02-01' THEN 'expired' WHEN count(pack) = 0 THEN 'no_evidence' WHEN min(version) < 2 OR max(version) > 2 THEN 'other_version' WHEN bool_or(verdict <> 'PASS') THEN 'not_passed' END END AS why
  FROM {CLAIMS} c LEFT JOIN {REPORTS} r ON (scope_pack IS NULL OR scope_pack = pack) AND scope_model = model GROUP BY claim_id))"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.effective_status(*_claims(spark, sf_dir), F.lit("2024-02-01").cast("date"), 2)


@register("claim_status", f"SELECT * FROM {STATUS}")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("claim_id", "status", "why", "effective")


@register("contradictions", f"SELECT DISTINCT least(a.claim_id, b.claim_id) AS a, greatest(a.claim_id, b.claim_id) AS b FROM {STATUS} a JOIN {STATUS} b ON a.effective = 'proven' AND b.effective = 'proven' AND b.claim_id IN (a.claim_id + 1, a.claim_id - 2)")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.contradictions(_assessed(spark, sf_dir))


EXTRACTED = f"(SELECT *, n_chars % 7 = 0 AS authored_nothing FROM {SCORED})"


@register("extraction_slices", f"SELECT stratum, {wilson_sql('missed', 'wanted', 'miss')}, {wilson_sql('invented', 'unwanted', 'invention')} FROM (SELECT stratum, count(*) FILTER (WHERE expected) AS wanted, count(*) FILTER (WHERE expected AND asserted = 'other') AS missed, count(*) FILTER (WHERE NOT expected AND NOT authored_nothing) AS unwanted, count(*) FILTER (WHERE NOT expected AND asserted = 'class' AND NOT authored_nothing) AS invented FROM (SELECT *, 'overall' AS stratum FROM {EXTRACTED} UNION ALL SELECT *, lang FROM {EXTRACTED} UNION ALL SELECT *, source FROM {EXTRACTED}) GROUP BY stratum)")
def extraction_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was missed and what invented, by stratum; rows that nobody authored gate nothing."""
    told = evals.extraction_slices(scored(spark, sf_dir).withColumn("unauthored", ~F.col("expected") & (F.col("n_chars") % 7 == 0)))
    return told.select("stratum", *[F.round(f"{x}_{e}", 9).alias(f"{x}_{e}") for x in ("miss", "invention") for e in ("low", "high")])


@register("wrong_by_path", f"SELECT CASE WHEN n_chars % 3 = 0 THEN 'rule' ELSE 'model' END AS kind_from, count(*) AS decisions, count(*) FILTER (WHERE asserted <> 'review' AND expected <> (asserted = 'class')) AS wrong FROM {SCORED} GROUP BY 1")
def wrong_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("kind_from", F.when(F.col("n_chars") % 3 == 0, "rule").otherwise("model"))
    return evals.wrong_by_path(rows)


STEPS = "SELECT source AS grp, lang AS step, count(*) FILTER (WHERE quality = 1) AS k, count(*) AS n, avg(quality) AS e2e FROM labels JOIN documents USING (doc_id) GROUP BY ALL"


LOW = wilson_sql("k", "n", "p").split(", round")[0].replace(" AS p_low", "")
HIGH = "round" + wilson_sql("wrong", "decisions", "p").split(", round")[1].replace(" AS p_high", "")
POOLED = f"SELECT grp, CASE WHEN bool_and(low >= 0.4) AND avg(e2e) >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS verdict, min(k) AS least_correct FROM (SELECT *, {LOW} AS low FROM ({STEPS})) GROUP BY grp"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy(F.col("source").alias("grp"), F.col("lang").alias("step")).agg(F.count_if(F.col("quality") == 1).alias("correct"), F.count("*").alias("expected"), F.avg("quality").alias("end_to_end"))


@register("pooled_verdict", POOLED)
def pooled_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.pooled_verdict(_steps(spark, sf_dir), 0.4, 0.7)


CEILINGS = (("en", "missed", 0.6), ("de", "missed", 0.97), ("fr", "missed", 0.7))
HARMS = f"SELECT source AS grp, lang AS stratum, 'missed' AS class, count(*) FILTER (WHERE asserted = 'other') AS wrong, count(*) AS decisions FROM {SCORED} WHERE expected GROUP BY ALL"


@register("overall_verdict", f"""WITH q AS (SELECT grp, CASE WHEN avg(e2e) >= 0.6 THEN 'PASS' ELSE 'MARGINAL' END AS verdict FROM ({STEPS}) GROUP BY grp),
o AS (SELECT q.grp, count(*) FILTER (WHERE NOT coalesce({HIGH} <= ceiling, false)) AS over FROM q CROSS JOIN (VALUES {', '.join(map(str, CEILINGS))}) AS c(stratum, class, ceiling) LEFT JOIN ({HARMS}) AS h ON h.grp = q.grp AND h.stratum = c.stratum AND h.class = c.class GROUP BY q.grp),
r AS (SELECT source AS grp, count(*) FILTER (WHERE toxic = 1 AND n_chars < 300) AS failed FROM {SCORED} GROUP BY source)
SELECT grp, CASE WHEN over > 0 OR failed > 0 THEN 'FAIL' ELSE verdict END AS verdict, over, failed AS failed_relations FROM q JOIN o USING (grp) JOIN r USING (grp)""")
def overall_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' verdicts under ceilings by language, short toxic documents as failed relations."""
    quality = _steps(spark, sf_dir).groupBy("grp").agg(F.when(F.avg("end_to_end") >= 0.6, "PASS").otherwise("MARGINAL").alias("verdict"))
    rows = scored(spark, sf_dir).withColumn("lang", F.col("strata")[0])
    harms = rows.where("expected").groupBy(F.col("source").alias("grp"), F.col("lang").alias("stratum"), F.lit("missed").alias("class")).agg(F.count_if(F.col("asserted") == "other").alias("wrong"), F.count("*").alias("decisions"))
    failed = rows.select(F.col("source").alias("grp"), F.when((F.col("toxic") == 1) & (F.col("n_chars") < 300), "failed").when(F.col("n_chars") < 300, "unjudgeable").otherwise("held").alias("outcome"))
    return evals.overall_verdict(quality, harms, spark.createDataFrame(list(CEILINGS), "stratum string, class string, ceiling double"), failed)


@register("worst_verdict", "SELECT n_regionkey, CASE WHEN bool_or(n_nationkey % 7 = 0) THEN 'FAIL' WHEN bool_or(n_nationkey % 3 = 0) THEN 'MARGINAL' ELSE 'PASS' END AS verdict FROM nation GROUP BY n_regionkey")
def worst_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("n_nationkey") % 7 == 0, "FAIL").when(F.col("n_nationkey") % 3 == 0, "MARGINAL").otherwise("PASS")
    return evals.worst_verdict(table(spark, sf_dir, "nation").select("n_regionkey", verdict.alias("verdict")), "n_regionkey")


@register("throughput", "SELECT source, sum(n_chars)::BIGINT AS tokens, sum(length(lang) + doc_id % 50)::BIGINT AS ms, count(*) AS calls, round(sum(n_chars)::DOUBLE * 1000 / sum(length(lang) + doc_id % 50), 6) AS tokens_per_second FROM documents GROUP BY source")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("tokens"), (F.length("lang") + F.col("doc_id") % 50).alias("ms"))
    return evals.throughput(calls, "source").withColumn("tokens_per_second", F.round(F.col("tokens_per_second").cast("double"), 6))


@register("coverage", "SELECT DISTINCT p_brand AS dimension, p_brand IN (SELECT p_brand FROM part WHERE p_size > 45) AS measured FROM part")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dimension"), "p_size")
    return evals.coverage(part.select("dimension").distinct(), part.where("p_size > 45"))


ONE_SIDED = f"(SELECT p_type AS grp, 'left' AS side, unnest(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS entry FROM ({BRANDS}) UNION ALL SELECT p_type, 'right', unnest(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) FROM ({BRANDS}))"


@register("declared_changes", f"WITH e AS (SELECT * FROM {ONE_SIDED}), d AS (SELECT grp, side, entry FROM e WHERE entry <> 'Brand#3' UNION ALL SELECT 'none', 'left', 'declared') SELECT 'compared' AS relation, (SELECT count(*) FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.grp = d.grp AND e.side = d.side AND e.entry = d.entry)) AS missing, (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM d WHERE e.grp = d.grp AND e.side = d.side AND e.entry = d.entry)) AS extra, false AS holds")
def declared_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes but one brand's are declared, and one is that never came."""
    pairs = _views(spark, sf_dir)
    moved = relations.one_sided(pairs)
    every = moved.select("relation", "grp", F.lit("left").alias("side"), F.explode("only_left").alias("entry")).unionByName(moved.select("relation", "grp", F.lit("right").alias("side"), F.explode("only_right").alias("entry")))
    declared = every.where("entry <> 'Brand#3'").unionByName(spark.sql("SELECT 'compared' AS relation, 'none' AS grp, 'left' AS side, 'declared' AS entry"))
    return relations.controlled(pairs, declared)


@register("smallest_difference", f"SELECT 'compared' AS relation, grp, side, entry FROM {ONE_SIDED} ORDER BY grp, side, entry LIMIT 1")
def smallest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.smallest_difference(_views(spark, sf_dir)).select("relation", "difference.*")


@register("relation_laws", f"SELECT 'compared' AS relation, 'invariant' AS law, count(*) = 0 AS holds FROM {ONE_SIDED} UNION ALL SELECT 'compared', 'one_removed', (SELECT count(*) FILTER (WHERE len(coalesce(a, [])) > 0 AND len(coalesce(b, [])) = 0) = 1 AND bool_and((len(coalesce(a, [])) > 0 AND len(coalesce(b, [])) = 0) OR coalesce(a, []) = coalesce(b, [])) FROM ({BRANDS}))")
def relation_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _views(spark, sf_dir)
    return relations.invariant(pairs).select("relation", F.lit("invariant").alias("law"), "holds").unionByName(relations.one_removed(pairs).select("relation", F.lit("one_removed").alias("law"), "holds"))


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders by status, beside a twin with statuses swapped, one group gone, or as they are."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    entry = F.col("o_orderkey").cast("string")
    left = o.select(F.concat(F.lit("l"), F.col("o_custkey").cast("string")).alias("fixture"), F.col("o_orderstatus").alias("grp"), entry.alias("entry"))
    swapped = F.when(F.col("o_orderstatus") == "F", "O").when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus"))
    right = o.where((k != 1) | (F.col("o_orderstatus") != "P")).select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("fixture"), F.when(k == 0, swapped).otherwise(F.col("o_orderstatus")).alias("grp"), entry.alias("entry"))
    key = F.col("o_custkey").cast("string")
    declared = o.select(key.alias("relation"), F.concat(F.lit("l"), key).alias("left"), F.concat(F.lit("r"), key).alias("right")).distinct()
    return relations.paired(relations.view(left.unionByName(right)), declared)


TWINS = "(SELECT o_custkey, o_custkey % 3 AS k, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey)"


@register("role_swaps", f"SELECT o_custkey::VARCHAR AS relation, CASE WHEN k = 0 THEN true ELSE NOT f AND NOT o END AS holds FROM {TWINS} WHERE f OR o")
def role_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stood under one role stands under the other, and the other way round."""
    return relations.swapped(_twins(spark, sf_dir), "F", "O")


@register("removal_law", f"SELECT o_custkey::VARCHAR AS relation, CASE k WHEN 0 THEN (f <> o)::INT = 1 AND false ELSE k = 1 AND p END AS holds FROM {TWINS}")
def removal_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one group is gone, and the others are as they were."""
    return relations.one_removed(_twins(spark, sf_dir))


@register("unjudgeable", "SELECT n_nationkey::VARCHAR AS relation FROM nation WHERE n_nationkey % 4 = 0 OR (n_nationkey + 1) % 4 = 0")
def unjudgeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation with an item in review on either side can't be judged."""
    n, name = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    items = n.select(name.cast("string").alias("fixture"), F.when(name % 4 == 0, "review").otherwise("class").alias("asserted"))
    last = spark.range(1).select(F.lit("25").alias("fixture"), F.lit("class").alias("asserted"))
    return relations.unjudgeable(items.unionByName(last), n.select(name.cast("string").alias("relation"), name.cast("string").alias("left"), (name + 1).cast("string").alias("right")))


@register("assertion_keys", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'pay|party ' || l_suppkey::VARCHAR || '|' || CASE WHEN l_partkey % 3 = 0 THEN 'undated:soon' ELSE l_shipdate::DATE::VARCHAR END AS obligation, CASE WHEN l_partkey % 2 = 0 THEN '-' ELSE (l_partkey % 2)::VARCHAR END || '|fee|per_year|£' || l_quantity::INT::VARCHAR AS term FROM lineitem")
def assertion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.when(F.col("l_partkey") % 3 > 0, F.col("l_shipdate").cast("date"))
    party = F.concat(F.lit("PARTY "), F.col("l_suppkey").cast("string"))
    obligation = fixtures.obligation_key(F.lit("pay"), party, F.lit("soon"), due)
    document = F.when(F.col("l_partkey") % 2 == 1, 1)
    term = fixtures.term_key(document, F.lit("fee"), F.lit("per_year"), F.concat(F.lit("£"), F.col("l_quantity").cast("int").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", obligation.alias("obligation"), term.alias("term"))


@register("same_assertions", "SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS same_obligation, o_orderkey % 4 <> 3 AS same_term FROM orders")
def same_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors agree by the date that they name; a term's quote may be longer than authored."""
    from tallyforge.functions.dates import in_words

    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    made = lambda kind, anchor, due: F.struct(kind.alias("kind"), F.lit("Party").alias("party"), F.lit("within 9 days").alias("deadline"), anchor.alias("anchor"), due.alias("due"))
    a = made(F.lit("pay"), F.concat(F.lit("the letter of "), in_words(day)), day)
    b = made(F.when(key % 5 == 2, "reply").otherwise("pay"), F.concat(F.lit("our note, "), in_words(F.when(key % 5 == 3, F.date_add(day, 1)).otherwise(day))), F.when(key % 5 == 4, F.lit(None).cast("date")).otherwise(day))
    term = lambda value, quote: F.struct(F.lit("fee").alias("term"), F.lit("per_year").alias("basis"), F.lit(value).alias("value") if isinstance(value, str) else value.alias("value"), quote.alias("quote"))
    x = term("£5", F.lit("A fee of  £5"))
    y = term("£5", F.when(key % 4 == 0, "a year: A fee of £5 is due").when(key % 4 == 1, "fee of £5").when(key % 4 == 2, "A fee of £5").otherwise("£5 in all"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fixtures.same_obligation(a, b).alias("same_obligation"), fixtures.same_term(x, y).alias("same_term"))


@register("evidence_dimensions", "SELECT o_orderkey, CASE WHEN k = 0 THEN 'fail' ELSE 'pass' END AS existence, CASE WHEN k IN (0, 1) THEN 'fail' ELSE 'pass' END AS attribution, CASE WHEN k = 2 THEN 'fail' ELSE 'pass' END AS support, CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN 'fail' ELSE 'pass' END AS derivation, k <> 5 AS complete FROM (SELECT *, o_orderkey % 6 AS k FROM orders)")
def evidence_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the quote there, is it the authored one, does the claim agree, and the date follow."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    k, n = key % 6, key.cast("string")
    authored = F.concat(F.lit("Pay order "), n, F.lit(" within ten days"))
    op = F.when(k == 4, F.lit(None)).when(key % 3 == 0, "end_of_month").when(key % 3 == 1, "add_days").otherwise("identity")
    due = F.when(op == "end_of_month", F.last_day(day)).when(op == "add_days", F.date_add(day, 10)).otherwise(day)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Dear reader.\n"), authored, F.lit(". Order "), n, F.lit(" again.")).alias("source"),
        F.when(k == 0, "never written").when(k == 1, F.concat(F.lit("Order "), n, F.lit(" again"))).otherwise(F.regexp_replace(authored, " ", "  ")).alias("quote"),
        authored.alias("authored_passage"),
        F.when(k == 2, "reply").otherwise("pay").alias("claim"),
        F.lit("pay").alias("expected"),
        F.when(k == 3, F.date_add(due, 1)).otherwise(due).alias("due"),
        op.alias("op"),
        day.alias("op_from"),
        F.lit(10).alias("op_days"),
        F.array(F.lit("within ten days"), F.when(k == 5, "each year").otherwise("Pay")).alias("qualifiers"),
    )
    found = fixtures.evidence(rows)
    return found.select("o_orderkey", "existence", "attribution", "support", "derivation", fixtures.complete(F.col("authored_passage"), F.col("qualifiers")).alias("complete"))


@register("document_review", "SELECT source, count(DISTINCT doc_id) AS n, count(DISTINCT CASE WHEN n_chars < 200 OR doc_id % 5 = 0 THEN doc_id END) AS unsure, round(count(DISTINCT CASE WHEN n_chars < 200 OR doc_id % 5 = 0 THEN doc_id END)::DOUBLE / count(DISTINCT doc_id), 9) AS rate FROM documents GROUP BY source")
def document_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("n_chars") < 200, "low").otherwise("high").alias("confidence"), (F.col("doc_id") % 5 == 0).alias("reviewed"))
    return fixtures.review_rate(items, "doc_id", "source").withColumn("rate", F.round(F.col("rate").cast("double"), 9))


@register("untraceable", f"SELECT (SELECT count(*) FROM {SCORED} WHERE n_chars % 4 = 3) + (SELECT count(*) FROM (SELECT n_chars % 97 AS k FROM {SCORED} WHERE n_chars % 4 < 3 GROUP BY 1 HAVING count(DISTINCT n_chars % 4) > 1)) AS untraceable")
def untraceable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.plans.queries import _levels

    return evals.untraceable(_levels(spark, sf_dir))


@register("closing_errors", "WITH RECURSIVE t AS (SELECT n_nationkey AS errors, 0 AS x FROM nation UNION ALL SELECT errors, x + 1 FROM t WHERE errors + x < 60), w AS (SELECT errors, x, " + wilson_sql("(errors + x)", "60", "p").split(", round", 1)[1].join(("round", "")).replace(" AS p_high", " AS high") + " FROM t) SELECT errors, coalesce(min(CASE WHEN x > 0 AND high >= 0.5 THEN x END), 60 - errors) AS closing FROM w GROUP BY errors")
def closing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many further errors would let two intervals meet."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("errors"), evals.closing_errors(n, F.lit(60), F.lit(0.5)).alias("closing"))


@register("category_kinds", "SELECT event_id, CASE event_type WHEN 'click' THEN 'bill' WHEN 'view' THEN 'subscription' ELSE 'transfer' END AS kind, CASE event_type WHEN 'click' THEN 'bill' ELSE 'subscription' END AS bare FROM events")
def category_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's kind, else that of unknown ones, else subscription."""
    c = F.col("event_type")
    full = audit.recurring_kind(c, {"click": "bill", "view": "subscription", "unknown": "transfer"})
    return table(spark, sf_dir, "events").select("event_id", full.alias("kind"), audit.recurring_kind(c, {"click": "bill"}).alias("bare"))


@register("eligible_spend", f"SELECT merchant, count(*) AS visits, sum(amount)::DECIMAL(28,2) AS total FROM {PURCHASES} p WHERE merchant NOT LIKE '%URGENT' GROUP BY merchant HAVING bool_or(direction = 'debit')")
def eligible_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants that have a debit and no series, account by account."""
    rows = purchases(spark, sf_dir)
    found = rows.where(F.col("merchant").endswith("URGENT")).select("account", "merchant")
    other = found.select(F.lit("another").alias("account"), F.regexp_replace("merchant", "1-URGENT", "3-MEDIUM").alias("merchant"))
    return pipelines.spend(rows, found.unionByName(other)).select("merchant", "visits", "total")


@register("yearly_costs", f"SELECT merchant, (amount * {PER_YEAR})::DECIMAL(28,2) AS annualised, (rise * {PER_YEAR})::DECIMAL(28,2) AS extra_per_year FROM (SELECT o_orderkey::VARCHAR AS merchant, o_totalprice::DECIMAL(18,2) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice::DECIMAL(18,2) - 1.50 END AS rise, CASE o_custkey % 4 WHEN 0 THEN 'yearly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'weekly' ELSE 'quarterly' END AS period FROM orders)")
def yearly_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, risen = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey") % 3 == 0
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("merchant"), amount.alias("amount"), _pick(F.col("o_custkey"), "yearly", "monthly", "weekly", "quarterly").alias("period"), F.when(risen, amount).alias("rise_to"), F.when(risen, F.lit("1.50").cast("decimal(18,2)")).alias("rise_from"))
    return audit.findings(rows).select("merchant", F.col("annualised").cast("decimal(28,2)").alias("annualised"), F.col("extra_per_year").cast("decimal(28,2)").alias("extra_per_year"))


DAYS = "('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday')"


@register("evidence_reasons", f"SELECT o_orderkey, n || CASE k WHEN 0 THEN ' payments, about the ' || d::VARCHAR || CASE WHEN d IN (11, 12, 13) THEN 'th' WHEN d % 10 = 1 THEN 'st' WHEN d % 10 = 2 THEN 'nd' WHEN d % 10 = 3 THEN 'rd' ELSE 'th' END || ' of each month' WHEN 1 THEN ' payments, on most weeks about ' || dayname(o_orderdate) WHEN 2 THEN ' payments about three months apart' ELSE ' payments about a year apart' END AS reason FROM (SELECT *, o_orderkey % 4 AS k, (o_custkey % 30 + 2)::VARCHAR AS n, day(o_orderdate) AS d FROM orders)")
def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = _pick(F.col("o_orderkey"), "monthly", "weekly", "quarterly", "yearly")
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", audit.evidence_reason(period, F.col("o_custkey") % 30 + 2, F.dayofmonth(day), F.weekday(day)).alias("reason"))


@register("ranking_signal", "WITH b AS (SELECT level, rank, errors, asserted, " + wilson_sql("errors", "asserted", "p") + f""" FROM (SELECT level, CASE level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank, count(*) FILTER (WHERE wrong) AS errors, count(*) - count(*) FILTER (WHERE routed) AS asserted
  FROM (SELECT n_chars % 97 AS k, min(level) AS level, max(level) AS last, bool_or(wrong) AS wrong, bool_and(routed) AS routed FROM (SELECT *, CASE n_chars % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS level, asserted = 'review' AS routed, asserted <> 'review' AND expected <> (asserted = 'class') AS wrong FROM {SCORED}) WHERE level IS NOT NULL GROUP BY 1) WHERE level = last GROUP BY level))
SELECT (SELECT count(*) FROM b) AS levels, CASE WHEN (SELECT count(*) FROM b) = 0 THEN 'no_evidence' WHEN (SELECT count(*) FROM b) = 1 THEN 'no_variation' WHEN EXISTS (SELECT 1 FROM b x, b y WHERE x.rank < y.rank AND y.p_high < x.p_low) THEN 'inverted' WHEN EXISTS (SELECT 1 FROM b x, b y WHERE x.rank < y.rank AND x.p_high < y.p_low) THEN 'ranks' ELSE 'unproven' END AS signal""")
def ranking_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.plans.queries import _levels

    return evals.ranking_signal(evals.calibration(_levels(spark, sf_dir)))


ENDING = "CASE WHEN ({n}) % 5 = 0 THEN ' you may ask' WHEN ({n}) % 7 = 0 THEN ' you may ask and must pay' WHEN ({n}) % 11 = 0 THEN ' you must pay' ELSE '' END"


@register("permitted_passages", f"SELECT doc_id, count(*) AS permitted FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line || {ENDING.format(n='doc_id + length(line)')}), '" + "|".join(passages.PERMITS) + f"') AND NOT regexp_matches(lower(line || {ENDING.format(n='doc_id + length(line)')}), '" + "|".join(passages.REQUIRES) + "') GROUP BY doc_id")
def permitted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that permit and don't require: the texts as they are, some with a sentence more."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    said = lines.select("doc_id", F.concat("line", F.expr(ENDING.format(n="doc_id + length(line)"))).alias("line"))
    return said.where(passages.grants_without_requiring(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("permitted"))


@register("decisions_needed", "SELECT p_partkey, ceil(3.84::DOUBLE / (p_size / 100.0::DOUBLE) - 3.84::DOUBLE)::BIGINT AS needed FROM part WHERE p_size > 0")
def decisions_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", N.decisions_needed(F.col("p_size") / F.lit(100.0)).alias("needed"))


KINDS, SHAPES = ("payment", "reply"), {"fee": "money"}


def _recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch a customer, an item an order: some dated, some undated, some ask nothing;
    every second one states a fee beside another figure; every fifth is uncertain."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    fee = F.concat(F.lit("£"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    quote = F.concat(F.lit("a fee of "), fee, F.lit(" and not £1.5"))
    deadline = F.when(key % 3 == 0, F.concat(F.lit("by "), F.date_format(day, "d MMMM yyyy"))).when(key % 3 == 1, "as soon as you can")
    text = F.concat(F.lit("Order "), key.cast("string"), F.lit(": "), F.coalesce(deadline, F.lit("nothing to do")), F.lit("; "), quote)
    claim, term = "array<struct<kind:string,deadline:string>>", "array<struct<term:string,basis:string,value:string,quote:string>>"
    claims = F.when(deadline.isNotNull(), F.array(F.struct(F.when(key % 2 == 0, "payment").otherwise("reply").alias("kind"), deadline.alias("deadline")))).otherwise(F.array().cast(claim))
    terms = F.when(key % 2 == 0, F.array(F.struct(F.lit("fee").alias("term"), F.lit("per_year").alias("basis"), fee.alias("value"), quote.alias("quote")))).otherwise(F.array().cast(term))
    result = F.struct(key.alias("id"), text.alias("echo"), F.when(key % 5 == 0, "low").otherwise("high").alias("confidence"), claims.alias("claims"), terms.alias("terms"))
    item = F.struct(key.alias("id"), text.alias("text"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_list(result)).alias("results"))


RECORDED = """WITH o AS (SELECT o_custkey AS b, o_orderkey AS k, o_orderkey % 3 AS d, o_orderkey % 2 = 0 AS fee, o_orderkey % 5 = 0 AS low, o_totalprice::DECIMAL(18,2) AS value FROM orders),
n AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE fee) AS fees FROM o GROUP BY b),
s AS (SELECT 'drop_claim' AS operator, (SELECT count(*) FROM o WHERE d < 2) AS mutants UNION ALL SELECT 'invent_claim', (SELECT count(*) FROM o WHERE d = 2)
  UNION ALL SELECT 'deadline_digit', (SELECT count(*) FROM o WHERE d = 0) UNION ALL SELECT 'invent_date', (SELECT count(*) FROM o WHERE d = 1)
  UNION ALL SELECT unnest(['omit_item', 'duplicate_item']), (SELECT count(*) FROM o) UNION ALL SELECT 'mispair', (SELECT sum(n - 1)::BIGINT FROM n) UNION ALL SELECT 'reorder', (SELECT count(*) FROM n WHERE n > 1)
  UNION ALL SELECT 'foreign_quote', (SELECT count(*) FROM o x WHERE fee AND EXISTS (SELECT 1 FROM o y WHERE y.b = x.b AND y.fee AND y.value <> x.value)) UNION ALL SELECT 'swap_roles', (SELECT count(*) FROM o x JOIN o y ON x.b = y.b AND x.k < y.k AND x.fee AND y.fee AND x.value <> y.value)
  UNION ALL SELECT unnest(['wrong_value', 'unmodelled_term', 'shape_break']), (SELECT count(*) FROM o WHERE fee) UNION ALL SELECT 'schema_break', (SELECT count(*) FROM o WHERE d < 2 OR fee)
  UNION ALL SELECT 'force_low', (SELECT count(*) FROM o WHERE (d < 2 OR fee) AND NOT low) UNION ALL SELECT 'force_high', (SELECT count(*) FROM o WHERE low))"""


@register("mutation_sites", RECORDED + " SELECT operator, mutants FROM s")
def mutation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.mutants(_recording(spark, sf_dir)).groupBy("operator").agg(F.count("*").alias("mutants"))


@register("mutations", RECORDED + """ SELECT operator, mutants, CASE operator WHEN 'reorder' THEN 0 ELSE mutants END AS affected, CASE WHEN operator IN ('omit_item', 'duplicate_item', 'mispair', 'foreign_quote', 'swap_roles', 'schema_break', 'unmodelled_term', 'shape_break') THEN mutants ELSE 0 END AS contained, CASE operator WHEN 'force_high' THEN 0 ELSE mutants END AS killed FROM s""")
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mutant replayed through the guards: all are caught but false confidence, which
    harms wrong answers only, and reordering moves nothing."""
    return mutation.report(_recording(spark, sf_dir), KINDS, SHAPES).drop("contained_by")


@register("mutation_triage", "SELECT 'confidence' AS family, 100 AS allowed, count(*) AS found, greatest(count(*) - 100, 0) AS over FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'pairing', 0, 0, 0")
def mutation_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors counted for the first family that they fall in, against what is allowed."""
    families = spark.createDataFrame([("confidence", 1, "force_high", None, 100), ("pairing", 2, "omit_item", None, 0)], "family string, rank int, operator string, item_prefix string, allowed int")
    return mutation.triage(mutation.survivors(_recording(spark, sf_dir), KINDS, SHAPES), families)
