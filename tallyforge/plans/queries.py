"""Queries over the engine's operators, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import numbers as N
from tallyforge.functions import similarity as S
from tallyforge.functions import text as X
from tallyforge.operators import ablation, answers, audit, cadence, evals, geometry, merchants, passages, registry, relations, similar, terms, timeline
from tallyforge.plans.catalog import register
from tallyforge.plans.tables import PAYMENTS, PURCHASES, SCORED, TERMS, payments, purchases, scored, stated_terms, table

BANDS = "CASE WHEN {g} BETWEEN 6 AND 8 THEN 'weekly' WHEN {g} BETWEEN 27 AND 34 THEN 'monthly' WHEN {g} BETWEEN 84 AND 98 THEN 'quarterly' WHEN {g} BETWEEN 350 AND 380 THEN 'yearly' END"
PER_YEAR = "CASE period WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 WHEN 'yearly' THEN 1 END"


def cadence_sql(source: str) -> str:
    return f"""
WITH o AS (SELECT merchant, date, lag(date) OVER (PARTITION BY merchant ORDER BY date) AS prev FROM {source}),
g AS (SELECT merchant, date_diff('day', prev, date) AS gap FROM o WHERE prev IS NOT NULL),
r AS (SELECT merchant, gap, row_number() OVER (PARTITION BY merchant ORDER BY gap) AS k, count(*) OVER (PARTITION BY merchant) AS n FROM g),
m AS (SELECT merchant, gap::INT AS gap_median, {BANDS.format(g="gap")} AS band, n FROM r WHERE k = n // 2 + 1),
a AS (SELECT merchant, sum(CASE WHEN {BANDS.format(g="gap")} = band THEN 1 ELSE 0 END) AS agreeing FROM g JOIN m USING (merchant) GROUP BY merchant),
c AS (SELECT merchant, count(*) AS payments, min(date) AS first_date, max(date) AS last_date FROM {source} GROUP BY merchant)
SELECT c.merchant, c.payments, c.first_date, c.last_date, gap_median, coalesce(agreeing, 0)::BIGINT AS agreeing,
  CASE WHEN 2 * agreeing > n AND (c.payments >= 3 OR band = 'yearly') THEN band END AS period
FROM c LEFT JOIN m USING (merchant) LEFT JOIN a USING (merchant)"""


def _cadence(rows: DataFrame) -> DataFrame:
    return cadence.cadence(rows, "merchant").select("merchant", "payments", "first_date", "last_date", "gap_median", "agreeing", "period")


@register("cadence_events", cadence_sql(PAYMENTS))
def cadence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cadence(payments(spark, sf_dir))


@register("cadence_orders", cadence_sql(PURCHASES))
def cadence_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cadence(purchases(spark, sf_dir))


DISTINCT_DEBITS = f"(SELECT DISTINCT merchant, date FROM {PURCHASES} WHERE direction = 'debit')"


@register("looks_periodic", f"SELECT merchant, period IS NOT NULL AS periodic FROM ({cadence_sql(DISTINCT_DEBITS)})")
def looks_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.looks_periodic(purchases(spark, sf_dir), "merchant")


@register("amount_clusters", f"SELECT merchant, amount, count(*) AS n, count(DISTINCT date) AS days, min(date) AS first_date, max(date) AS last_date FROM {PAYMENTS} GROUP BY ALL")
def amount_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.amount_clusters(payments(spark, sf_dir), "merchant")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = purchases(spark, sf_dir)
    held = cadence.cadence(rows, "merchant").where("period IS NOT NULL")
    last = rows.groupBy("merchant").agg(F.max_by("amount", F.struct("date", "seq")).alias("amount"))
    kind = F.when(F.col("merchant").endswith("URGENT"), "bill").otherwise("subscription")
    found = held.join(last, "merchant").select("merchant", "period", "amount", "payments", "last_date", kind.alias("kind"), F.when(F.col("payments") > 2, "high").otherwise("low").alias("confidence"))
    return found.withColumn("annualised", N.annualise(F.col("amount"), F.col("period")).cast("decimal(28,2)"))


FINDINGS = f"""(WITH c AS ({cadence_sql(PURCHASES)}), l AS (SELECT merchant, arg_max(amount, (date, seq)) AS amount FROM {PURCHASES} GROUP BY merchant)
SELECT merchant, period, amount, payments, last_date, CASE WHEN merchant LIKE '%URGENT' THEN 'bill' ELSE 'subscription' END AS kind,
  CASE WHEN payments > 2 THEN 'high' ELSE 'low' END AS confidence, (amount * {PER_YEAR})::DECIMAL(28,2) AS annualised
FROM c JOIN l USING (merchant) WHERE period IS NOT NULL)"""


@register("findings", f"SELECT merchant, period, amount, annualised, kind, confidence, row_number() OVER (ORDER BY annualised DESC, merchant) AS place FROM {FINDINGS}")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = audit.numbered(_findings(spark, sf_dir), "place", -F.col("annualised"), "merchant")
    return placed.select("merchant", "period", "amount", "annualised", "kind", "confidence", "place")


@register("annualise_spend", f"SELECT count(*) AS recurring, coalesce(sum(annualised), 0)::DECIMAL(28,2) AS annualised_total, round(coalesce(sum(annualised), 0)::DECIMAL(28,6) / 12, 2)::DECIMAL(28,2) AS monthly_equivalent FROM {FINDINGS}")
def annualise_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir).withColumn("rise_to", F.lit(None))
    return audit.summary(rows).drop("price_rises")


@register("checklist", f"""WITH r AS (SELECT *, CASE WHEN period = 'yearly' THEN 'yearly' WHEN confidence <> 'high' THEN 'uncertain' WHEN kind = 'subscription' AND annualised > 100 THEN 'expensive' END AS rule FROM {FINDINGS})
SELECT merchant, rule FROM r WHERE rule <> 'expensive' UNION ALL SELECT * FROM (SELECT merchant, rule FROM r WHERE rule = 'expensive' ORDER BY annualised DESC, merchant LIMIT 1)""")
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.checklist(_findings(spark, sf_dir)).select("merchant", "rule")


MONTHS_PAID = "SELECT o_custkey::VARCHAR AS merchant, o_totalprice::DECIMAL(18,2) AS amount, CASE o_custkey % 4 WHEN 0 THEN 'yearly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'weekly' ELSE 'quarterly' END AS period, CASE WHEN o_custkey % 3 = 0 THEN 'bill' ELSE 'subscription' END AS kind FROM orders"


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as if it repeated, at a pace by customer."""
    period = F.element_at(F.array(F.lit("yearly"), F.lit("monthly"), F.lit("weekly"), F.lit("quarterly")), (F.col("o_custkey") % 4 + 1).cast("int"))
    kind = F.when(F.col("o_custkey") % 3 == 0, "bill").otherwise("subscription")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("merchant"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), period.alias("period"), kind.alias("kind"))
    return rows.withColumn("annualised", N.annualise(F.col("amount"), F.col("period")).cast("decimal(28,2)"))


@register("top_subscription", f"SELECT merchant, annualised FROM (SELECT merchant, period, kind, (amount * {PER_YEAR})::DECIMAL(28,2) AS annualised FROM ({MONTHS_PAID})) WHERE kind = 'subscription' AND period <> 'yearly' AND annualised > 100 ORDER BY annualised DESC, merchant LIMIT 1")
def top_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_subscription(_paid(spark, sf_dir)).select("merchant", "annualised")


MEDIAN = """WITH p AS ({source}), r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY amount) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM p),
m AS (SELECT {key}, round((sum(CASE WHEN k = (n + 1) // 2 THEN amount ELSE 0 END) + sum(CASE WHEN k = n // 2 + 1 THEN amount ELSE 0 END))::DECIMAL(28,3) * 0.5::DECIMAL(2,1), 2)::DECIMAL(28,2) AS typical_visit FROM r GROUP BY {key})"""


@register("regular_spend", MEDIAN.format(source=f"SELECT * FROM {PAYMENTS}", key="merchant") + """
SELECT merchant, count(*) AS visits, sum(amount)::DECIMAL(28,2) AS total, max(typical_visit) AS typical_visit, count(DISTINCT CASE WHEN direction = 'debit' THEN date END) AS debit_days,
  CASE WHEN count(DISTINCT CASE WHEN direction = 'debit' THEN date END) >= 3 THEN 'regular_spend' ELSE 'one_off' END AS kind FROM p JOIN m USING (merchant) GROUP BY merchant""")
def regular_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.regular_spend(payments(spark, sf_dir), "merchant")


@register("decimal_median", MEDIAN.format(source="SELECT o_custkey, o_totalprice::DECIMAL(18,2) AS amount FROM orders", key="o_custkey") + " SELECT o_custkey, typical_visit AS median FROM m")
def decimal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    held = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("amount")).alias("a"))
    return held.select("o_custkey", N.sorted_median(F.col("a")).cast("decimal(28,2)").alias("median"))


@register("interval_stats", f"""WITH o AS (SELECT merchant, date, lag(date) OVER (PARTITION BY merchant ORDER BY date) AS prev FROM {PURCHASES}),
g AS (SELECT merchant, date_diff('day', prev, date) AS gap FROM o WHERE prev IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY gap) AS k, count(*) OVER (PARTITION BY merchant) AS n FROM g)
SELECT merchant, (max(n) + 1)::BIGINT AS payments, ((sum(CASE WHEN k = (n + 1) // 2 THEN gap ELSE 0 END) + sum(CASE WHEN k = n // 2 + 1 THEN gap ELSE 0 END)) // 2)::BIGINT AS median_gap, (max(gap) - min(gap))::BIGINT AS spread FROM r GROUP BY merchant""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interval_stats(purchases(spark, sf_dir), "merchant")


@register("input_span", f"SELECT count(*) AS payments, min(date) AS first_date, max(date) AS last_date FROM {PAYMENTS}")
def input_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.span(payments(spark, sf_dir))


@register("direction_split", f"SELECT direction, count(*) AS n, sum(amount)::DECIMAL(28,2) AS total FROM {PURCHASES} GROUP BY direction")
def direction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(spark, sf_dir).groupBy("direction").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("total"))


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = (F.floor(F.col("amount") / 50) * 50).cast("decimal(18,2)")
    merchant = F.substring_index("merchant", "-", 1)
    return payments(spark, sf_dir).withColumn("amount", amount).withColumn("merchant", merchant)


def netted_sql(payments_sql: str, direction: str) -> str:
    """CTEs up to s: what each (merchant, amount) holds after its i-th payment or reversal."""
    return f"""p AS ({payments_sql}),
e AS (SELECT *, row_number() OVER (PARTITION BY merchant, amount ORDER BY date, direction <> '{direction}') AS i, count(*) OVER (PARTITION BY merchant, amount) AS n FROM p),
s AS (SELECT DISTINCT merchant, amount, 0::BIGINT AS i, n, []::DATE[] AS held FROM e
  UNION ALL SELECT s.merchant, s.amount, e.i, s.n, CASE WHEN e.direction = '{direction}' THEN list_append(held, e.date) WHEN len(held) > 0 AND date_diff('day', held[-1], e.date) <= 45 THEN held[1:len(held) - 1] ELSE held END
  FROM s JOIN e ON e.merchant = s.merchant AND e.amount = s.amount AND e.i = s.i + 1)"""


COARSE = f"SELECT seq, split_part(merchant, '-', 1) AS merchant, (floor(amount / 50) * 50)::DECIMAL(18,2) AS amount, date, direction FROM {PAYMENTS}"
LARGE = f"SELECT seq, merchant, (floor(amount / 100000) * 100000)::DECIMAL(18,2) AS amount, date, direction FROM {PURCHASES}"
#: How long a series of each period may wait for its next payment.
WAITS = " ".join(f"WHEN '{name}' THEN {days * 8 // 5}" for name, _, _, days, *_ in D.PERIODS)


def period_sql(gaps: str) -> str:
    """The period of a sorted list of gaps."""
    middle = BANDS.format(g=f"{gaps}[len({gaps}) // 2 + 1]")
    return f"CASE WHEN (len({gaps}) > 1 OR {middle} = 'yearly') AND 2 * len(list_filter({gaps}, lambda y: {BANDS.format(g='y')} = {middle})) > len({gaps}) THEN {middle} END"


def series_sql(payments_sql: str, direction: str) -> str:
    """The fold of a merchant's clusters, one cluster a step of the recursion."""
    joined = "list_sort(list_concat(list_concat(st[q].gaps, c.gaps), [date_diff('day', st[q].last, c.first)]))"
    fits = f"date_diff('day', st[q].last, c.first) > 0 AND list_transform([{joined}], lambda g: coalesce(date_diff('day', st[q].last, c.first) <= CASE {period_sql('g')} {WAITS} END, false))[1]"
    new = "{'amount': amount, 'gaps': gaps, 'last': d[-1], 'n': len(d), 'rise_from': NULL::DECIMAL(18,2), 'rise_to': NULL::DECIMAL(18,2), 'rise_when': NULL::DATE}"
    risen = "CASE WHEN amount > st[j].amount THEN {} ELSE st[j].{} END"
    longer = "{'amount': amount, 'gaps': list_concat(list_concat(st[j].gaps, gaps), [date_diff('day', st[j].last, first)]), 'last': d[-1], 'n': st[j].n + len(d), 'rise_from': " + risen.format("st[j].amount", "rise_from") + ", 'rise_to': " + risen.format("amount", "rise_to") + ", 'rise_when': " + risen.format("first", "rise_when") + "}"
    return f"""WITH RECURSIVE {netted_sql(payments_sql, direction)},
k AS (SELECT merchant, amount, list_sort(held) AS d FROM s WHERE i = n AND len(held) > 0),
f AS (SELECT k.*, d[1] AS first, (SELECT min(seq) FROM p WHERE p.merchant = k.merchant AND p.amount = k.amount AND p.direction = '{direction}' AND p.date = d[1]) AS seq, list_transform(range(2, len(d) + 1), lambda j: date_diff('day', d[j - 1], d[j])) AS gaps FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY first, seq, amount) AS i, count(*) OVER (PARTITION BY merchant) AS m FROM f),
t AS (SELECT DISTINCT merchant, 0::BIGINT AS i, m, []::STRUCT(amount DECIMAL(18,2), gaps BIGINT[], last DATE, n BIGINT, rise_from DECIMAL(18,2), rise_to DECIMAL(18,2), rise_when DATE)[] AS st FROM c
  UNION ALL SELECT merchant, i, m, CASE WHEN j IS NULL THEN list_append(st, {new}) ELSE list_concat(list_append(st[1:j - 1], {longer}), st[j + 1:len(st)]) END
  FROM (SELECT t.merchant, c.i, t.m, st, c.amount, c.gaps, c.d, c.first, list_filter(range(len(st), 0, -1), lambda q: {fits})[1] AS j FROM t JOIN c ON c.merchant = t.merchant AND c.i = t.i + 1))
SELECT 'all' AS account, merchant, period, x.amount AS amount, x.rise_from AS rise_from, x.rise_to AS rise_to, x.rise_when AS rise_when, x.n AS payments
FROM (SELECT merchant, x, list_transform([list_sort(x.gaps)], lambda g: {period_sql('g')})[1] AS period FROM (SELECT merchant, unnest(st) AS x FROM t WHERE i = m)) WHERE period IS NOT NULL"""


NETTED = f"WITH RECURSIVE {netted_sql(COARSE, 'debit')} SELECT merchant, amount, date, count(*) AS n FROM (SELECT merchant, amount, unnest(held) AS date FROM s WHERE i = n) GROUP BY ALL"


@register("reversal_netting", NETTED)
def reversal_netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.net_of_reversals(_coarse(spark, sf_dir), "debit", "merchant")


@register("reversal_candidates", f"""WITH p AS (SELECT split_part(merchant, '-', 1) AS merchant, (floor(amount / 50) * 50)::DECIMAL(18,2) AS amount, date, direction FROM {PAYMENTS})
SELECT r.merchant, r.amount, count(*) AS candidates FROM p AS r JOIN p ON p.merchant = r.merchant AND p.amount = r.amount AND r.direction = 'credit' AND p.direction = 'debit' AND p.date <= r.date AND date_diff('day', p.date, r.date) <= 45 GROUP BY ALL""")
def reversal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = cadence.day_counts(_coarse(spark, sf_dir), "merchant", "amount", "direction")
    back = days.where("direction = 'credit'").select("merchant", "amount", F.col("date").alias("back"), F.col("n").alias("m"))
    near = days.where("direction = 'debit'").join(back, ["merchant", "amount"]).where("date <= back AND datediff(back, date) <= 45")
    return near.groupBy("merchant", "amount").agg(F.sum(F.col("n") * F.col("m")).alias("candidates"))


@register("series_fold", series_sql(COARSE, "debit"))
def series_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.series(_coarse(spark, sf_dir), "debit")


@register("income_fold", series_sql(LARGE, "credit"))
def income_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.series(purchases(spark, sf_dir).withColumn("amount", (F.floor(F.col("amount") / 100000) * 100000).cast("decimal(18,2)")), "credit")


# part names stand for descriptors: a processor's prefix for some, a code behind others
RAW = "CASE p_size % 4 WHEN 0 THEN 'PAYPAL *' || p_brand || ' ' || p_size::VARCHAR WHEN 1 THEN 'sq_* ' || p_brand WHEN 2 THEN p_brand || ' T' || p_size::VARCHAR ELSE p_name END"
CLEAN = "CASE WHEN contains(trim(raw), '*') AND upper(regexp_replace(split_part(trim(raw), '*', 1), '^[\\s_]+|[\\s_]+$', '', 'g')) IN ('PAYPAL','SQ','ZETTLE','SUMUP','IZ','STRIPE','WPY') THEN trim(regexp_replace(trim(raw), '^[^*]*\\*', '')) ELSE trim(raw) END"
WORDS = "list_filter(string_split(trim(regexp_replace(cleaned, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT (length(regexp_replace(w, '[^0-9]', '', 'g')) > 0 AND length(w) - length(regexp_replace(w, '[^0-9]', '', 'g')) <= 2))"
STEMS = f"(SELECT *, CASE WHEN len({WORDS}) > 0 THEN upper(array_to_string({WORDS}, ' ')) ELSE upper(cleaned) END AS stem FROM (SELECT *, {CLEAN} AS cleaned FROM (SELECT p_partkey AS seq, {RAW} AS raw FROM part)))"


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 4
    raw = F.when(kind == 0, F.concat(F.lit("PAYPAL *"), "p_brand", F.lit(" "), size)).when(kind == 1, F.concat(F.lit("sq_* "), "p_brand")).when(kind == 2, F.concat("p_brand", F.lit(" T"), size)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), raw.alias("raw_merchant"))


@register("merchant_clean", f"SELECT seq, raw AS raw_merchant, cleaned, stem FROM {STEMS}")
def merchant_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchants.with_stem(_descriptors(spark, sf_dir)).select("seq", "raw_merchant", "cleaned", "stem")


@register("merchant_groups", f"SELECT stem, arg_min(cleaned, seq) AS cleaned, arg_min(raw, seq) AS raw_first, count(*) AS n FROM {STEMS} GROUP BY stem")
def merchant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchants.merchant_groups(_descriptors(spark, sf_dir))


@register("merchant_count", f"SELECT count(DISTINCT stem) AS merchants FROM {STEMS}")
def merchant_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchants.with_stem(_descriptors(spark, sf_dir)).agg(F.countDistinct("stem").alias("merchants"))


TODAY = "DATE '1998-08-15'"


@register("period_math", f"""SELECT o_orderkey, last_day(o_orderdate::DATE) AS month_end, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next_month,
  CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN o_orderdate::DATE ELSE (o_orderdate + INTERVAL 12 MONTH)::DATE END AS plus_year,
  (o_orderdate + INTERVAL 3 MONTH)::DATE AS quarter, strftime(o_orderdate, '%-d %B %Y') AS words, strftime(o_orderdate, '%Y-%m') AS month,
  date_diff('day', o_orderdate::DATE, {TODAY}) >= 30 AS stale FROM orders""")
def period_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.last_day(day).alias("month_end"), D.first_of_next_month(day).alias("next_month"), D.plus_year(day).alias("plus_year"), D.add_period(day, F.lit("quarterly")).alias("quarter"), D.in_words(day).alias("words"), D.iso_month(day).alias("month"), registry.stale(day, F.expr(TODAY)).alias("stale"))


@register("next_occurrence", f"""WITH RECURSIVE s AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders UNION ALL SELECT o_orderkey, (d + INTERVAL 3 MONTH)::DATE FROM s WHERE d <= {TODAY} OR d = (SELECT o_orderdate::DATE FROM orders o WHERE o.o_orderkey = s.o_orderkey))
SELECT o_orderkey, min(d) AS due FROM s JOIN orders USING (o_orderkey) WHERE d > {TODAY} AND d > o_orderdate::DATE GROUP BY o_orderkey""")
def next_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = D.next_occurrence(F.col("o_orderdate").cast("date"), F.lit("quarterly"), F.expr(TODAY))
    return table(spark, sf_dir, "orders").select("o_orderkey", due.alias("due"))


SPELLED = ("dd MMM yy", "dd/MM/yyyy", "yyyy-MM-dd")


@register("date_parse_multi", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN o_orderdate::DATE END AS date FROM orders")
def date_parse_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written in six ways, 05 Jan 98 and 5/1/2024 among them, and one word that is none."""
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 7
    short = F.substring(F.date_format(day, "yyyy"), 3, 2)
    written = (F.date_format(day, "dd/MM/yyyy"), F.concat(F.date_format(day, "dd MMM "), short), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "d/M/yyyy"), F.concat(F.date_format(day, "d MMMM "), short), F.date_format(day, "yyyy-M-d"), F.lit("soon"))
    text = F.element_at(F.array(*written), kind.cast("int") + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", D.parse_date(text, SPELLED).alias("date"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    words = D.in_words(day.cast("date"))
    deadline = F.when(key % 5 == 0, F.concat(F.lit("by "), words)).when(key % 5 == 1, "within 14 days").when(key % 5 == 2, F.concat(F.lit("within 30 days of "), words)).when(key % 5 == 3, "by the end of the month").otherwise("as soon as you can")
    anchor = F.when(key % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("the hearing on "), words))
    return table(spark, sf_dir, "orders").select("o_orderkey", deadline.alias("deadline"), anchor.alias("anchor"), F.when(key % 3 == 0, F.lit(None)).otherwise(F.date_add(day.cast("date"), -7)).cast("date").alias("letter_date"))


@register("resolve_deadline", """WITH b AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE - 7 END AS letter, o_orderkey % 2 = 1 AS anchored FROM orders),
c AS (SELECT *, CASE WHEN anchored OR k = 2 THEN d ELSE letter END AS base FROM b),
r AS (SELECT o_orderkey, k, CASE k WHEN 0 THEN d WHEN 1 THEN base + 14 WHEN 2 THEN base + 30 WHEN 3 THEN last_day(base) END AS due FROM c)
SELECT o_orderkey, due, CASE WHEN due IS NULL THEN NULL WHEN k = 0 THEN 'read' ELSE 'worked_out' END AS kind FROM r""")
def resolve_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = D.resolve_deadline(F.col("deadline"), F.col("anchor"), F.col("letter_date"))
    return _letters(spark, sf_dir).select("o_orderkey", due["date"].alias("due"), due["kind"].alias("kind"))


@register("first_full_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderdate::DATE END AS found FROM orders")
def first_full_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    ordinal = F.concat(X.ordinal(F.dayofmonth(day)), F.date_format(day, "MMMM, yyyy"))
    text = F.when(key % 3 == 0, F.concat(F.lit("Dated 31 February 2001; rather ("), D.in_words(day), F.lit(")."))).when(key % 3 == 1, F.lit("in May 2001, on 32 May 2001 or 1/2/2001")).otherwise(F.concat(F.lit("on the "), ordinal))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.first_full_date(text).alias("found"))


@register("timeline_merge", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, o_orderpriority AS kind FROM orders),
f AS (SELECT o_custkey % 100 AS party, kind, year(d) AS y, min(o_orderkey) AS first, count(*) AS passages, bool_or(o_orderkey % 7 = 0) AS low FROM o GROUP BY ALL),
m AS (SELECT f.*, d FROM f JOIN o ON o_orderkey = first)
SELECT kind, CASE WHEN first % 2 = 0 THEN 'PARTY ' ELSE 'party ' END || party::VARCHAR AS party, last_day(make_date(y::INT, 12, 1)) AS due, passages, CASE WHEN low THEN 'low' ELSE 'high' END AS confidence FROM m""")
def timeline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    word = F.when(F.col("o_orderkey") % 2 == 0, "PARTY ").otherwise("party ")
    rows = o.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").alias("document"),
        F.lit(0).alias("ordinal"),
        F.col("o_orderpriority").alias("kind"),
        F.concat(word, (F.col("o_custkey") % 100).cast("string")).alias("party"),
        F.concat(F.lit("by 31 December "), F.year("o_orderdate").cast("string")).alias("deadline"),
        F.lit("").alias("anchor"),
        F.when(F.col("o_orderkey") % 7 == 0, "low").otherwise("high").alias("confidence"),
    )
    segments = o.select(F.col("o_orderkey").alias("document"), F.lit(0).alias("ordinal"), F.lit("Dear reader").alias("text"))
    done = timeline.merged(timeline.dated(rows, segments))
    return done.select("kind", "party", F.col("due.date").alias("due"), F.size("evidence").cast("long").alias("passages"), "confidence")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a date line before or deep inside the text."""
    day = D.in_words(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")))
    blocks = F.array(F.lit("To the reader"), F.substring("text", 1, 400), F.concat(F.lit("Written on "), day), F.expr("substring(text, 401)"), F.concat(F.lit("Again "), day))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.posexplode(blocks).alias("ordinal", "text"))


@register("letter_date_window", "SELECT doc_id AS document, DATE '2001-01-01' + (doc_id % 700)::INT AS letter_date FROM documents")
def letter_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.opening_dates(_headed(spark, sf_dir))


LINES = "(SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) AS k FROM documents)"


@register("passages", f"""WITH l AS (SELECT doc_id, line, k, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS next, max(length(line)) OVER (PARTITION BY doc_id) AS measure FROM {LINES}),
b AS (SELECT *, CASE WHEN next IS NULL OR length(line) + 1 + length(split_part(next, ' ', 1)) <= measure THEN 1 ELSE 0 END AS ends FROM l),
p AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM b)
SELECT doc_id AS document, ordinal::INT AS ordinal, sha256(string_agg(line || CASE WHEN line LIKE '%-' OR ends = 1 THEN '' ELSE ' ' END, '' ORDER BY k)) AS text_sha FROM p GROUP BY doc_id, ordinal""")
def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passages.passages(docs, "doc_id").select("document", "ordinal", F.sha2("text", 256).alias("text_sha"))


PERMITS = " OR ".join(f"contains(lower(text), '{x}')" for x in passages.PERMITS)
REQUIRES = " OR ".join(f"contains(lower(text), '{x}')" for x in passages.REQUIRES)


@register("permission_guard", f"SELECT doc_id, ({PERMITS}) AND NOT ({REQUIRES}) AS permits FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' If you wish, write.' WHEN 1 THEN 'You may appeal. ' || text ELSE text || ' you can pay, please' END AS text FROM documents)")
def permission_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.concat("text", F.lit(" If you wish, write."))).when(kind == 1, F.concat(F.lit("You may appeal. "), "text")).otherwise(F.concat("text", F.lit(" you can pay, please")))
    return table(spark, sf_dir, "documents").select("doc_id", passages.grants_without_requiring(text).alias("permits"))


SQUASHED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@register("quote_guard", f"SELECT item_id AS quote_id, doc_id AS document FROM benchmark b JOIN documents d ON contains({SQUASHED.format(c='d.text')}, {SQUASHED.format(c='b.text')}) WHERE trim(b.text) <> ''")
def quote_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.lit(0).alias("ordinal"), "text")
    return passages.quote_places(quotes, docs).select("quote_id", "document")


WRITTEN = "CASE l_linenumber % 5 WHEN 0 THEN '£' || l_extendedprice::DECIMAL(18,2)::VARCHAR WHEN 1 THEN l_quantity::INT::VARCHAR || ' days' WHEN 2 THEN l_quantity::INT::VARCHAR || ' per cent' WHEN 3 THEN '1,234.50' ELSE l_returnflag || ' words' END"


@register("value_shape", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 0 THEN 'money' WHEN 1 THEN 'duration' WHEN 2 THEN 'percentage' WHEN 3 THEN 'money' ELSE 'text' END AS kind, CASE l_linenumber % 5 WHEN 0 THEN l_extendedprice::DECIMAL(18,2) WHEN 3 THEN 1234.50 END::DECIMAL(38,6) AS amount FROM lineitem")
def value_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, kind = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    text = F.when(kind == 0, F.concat(F.lit("£"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))).when(kind == 1, F.concat(q, F.lit(" days"))).when(kind == 2, F.concat(q, F.lit(" per cent"))).when(kind == 3, "1,234.50").otherwise(F.concat("l_returnflag", F.lit(" words")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.value_kind(text).alias("kind"), X.amount(text).alias("amount"))


KEYS = f"""WITH k AS (SELECT term, basis, any_value(l_returnflag) AS flag, any_value(l_orderkey) AS family, count(*) FILTER (WHERE document = 0) AS nb, count(*) FILTER (WHERE document = 1) AS na,
  min(value) FILTER (WHERE document = 0) AS vb, min(value) FILTER (WHERE document = 1) AS va FROM {TERMS} GROUP BY term, basis),
f AS (SELECT family, list(DISTINCT term) FILTER (WHERE nb > 0) AS a, list(DISTINCT term) FILTER (WHERE na > 0) AS b FROM k GROUP BY family),
r AS (SELECT k.*, CASE WHEN len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) THEN 'labelled_differently' WHEN greatest(nb, na) > 1 THEN 'stated_more_than_once' END AS why FROM k JOIN f USING (family))"""


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stated_terms(spark, sf_dir)
    families = rows.groupBy("term").agg(F.min("l_orderkey").alias("family"))  # a term names its order; dealt by term, as it is joined
    return terms.compare(rows, 0, 1, families)


@register("term_diff", KEYS + """ SELECT term, basis, CASE WHEN nb = 0 THEN 'added' WHEN na = 0 THEN 'removed' WHEN vb = va THEN 'unchanged' ELSE 'changed' END AS change, vb AS v_before, va AS v_after,
  CASE WHEN nb > 0 AND na > 0 AND vb <> va THEN substr(va, 2)::DECIMAL(38,6) - substr(vb, 2)::DECIMAL(38,6) END::DECIMAL(38,6) AS delta FROM r WHERE why IS NULL""")
def term_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)[0].drop("kind").withColumn("delta", F.col("delta").cast("decimal(38,6)"))


@register("term_refusals", KEYS + " SELECT term, basis, greatest(nb, na) AS readings, why FROM r WHERE why IS NOT NULL")
def term_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)[1]


BRANDS = "SELECT p_type, list_sort(list(DISTINCT p_brand) FILTER (WHERE p_size <= 25)) AS a, list_sort(list(DISTINCT p_brand) FILTER (WHERE p_size > 15)) AS b FROM part GROUP BY p_type"


@register("set_f1", f"SELECT p_type, round(CASE WHEN len(coalesce(a, [])) + len(coalesce(b, [])) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(coalesce(a, []), coalesce(b, []))) / (len(coalesce(a, [])) + len(coalesce(b, []))) END, 9)::DOUBLE AS f1 FROM ({BRANDS})")
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "part").groupBy("p_type").agg(F.collect_set(F.when(F.col("p_size") <= 25, F.col("p_brand"))).alias("a"), F.collect_set(F.when(F.col("p_size") > 15, F.col("p_brand"))).alias("b"))
    return sides.select("p_type", F.round(evals.set_f1(F.col("a"), F.col("b")), 9).cast("double").alias("f1"))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_size")
    left = part.where("p_size <= 25").select(F.lit("l").alias("fixture"), F.col("p_type").alias("grp"), F.col("p_brand").alias("entry"))
    right = part.where("p_size > 15").select(F.lit("r").alias("fixture"), F.col("p_type").alias("grp"), F.col("p_brand").alias("entry"))
    declared = spark.sql("SELECT 'compared' AS relation, 'l' AS left, 'r' AS right")
    return relations.paired(relations.view(left.unionByName(right)), declared)


@register("symmetric_diff", f"SELECT p_type AS grp, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS only_left, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS only_right FROM ({BRANDS}) WHERE len(coalesce(a, [])) + len(coalesce(b, [])) > 0")
def symmetric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.one_sided(_views(spark, sf_dir)).select("grp", F.array_join(F.array_sort("only_left"), ",").alias("only_left"), F.array_join(F.array_sort("only_right"), ",").alias("only_right"))


SLICED = f"(SELECT *, 'overall' AS stratum FROM {SCORED} UNION ALL SELECT *, lang FROM {SCORED} UNION ALL SELECT *, source FROM {SCORED})"
CELLS = f"""SELECT stratum, {", ".join(f"count(*) FILTER (WHERE {'expected' if w == 'class' else 'NOT expected'} AND asserted = '{a}') AS {w}_{a}" for w in ("class", "other") for a in ("class", "other", "review"))} FROM {SLICED} GROUP BY stratum"""


@register("six_cells", CELLS)
def six_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evals.six_cells(evals.sliced(scored(spark, sf_dir)), "stratum")
    return cells.select("stratum", *[f"{w}_{a}" for w in ("class", "other") for a in ("class", "other", "review")])


def wilson_sql(k: str, n: str, name: str) -> str:
    z, z2 = repr(N.Z), repr(N.Z * N.Z)
    p, spread = f"(({k})::DOUBLE / ({n}))", f"(sqrt((({k})::DOUBLE / ({n})) * (1 - (({k})::DOUBLE / ({n}))) / ({n}) + {z2}::DOUBLE / (4.0::DOUBLE * ({n}) * ({n}))) * {z}::DOUBLE)"
    middle = f"({p} + {z2}::DOUBLE / (2.0::DOUBLE * ({n})))"
    return f"round(CASE WHEN {n} > 0 THEN greatest(({middle} - {spread}) / (1 + {z2}::DOUBLE / ({n})), 0) END, 9) AS {name}_low, round(CASE WHEN {n} > 0 THEN least(({middle} + {spread}) / (1 + {z2}::DOUBLE / ({n})), 1) END, 9) AS {name}_high"


@register("precision_recall", f"SELECT stratum, {wilson_sql('class_class', '(class_class + other_class)', 'precision')}, {wilson_sql('(class_class + class_review)', '(class_class + class_review + class_other)', 'recall')}, {wilson_sql('class_other', '(class_class + class_review + class_other)', 'wrong')} FROM ({CELLS})")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evals.performance(evals.six_cells(evals.sliced(scored(spark, sf_dir)), "stratum"))
    return told.select("stratum", *[F.round(f"{x}_{e}", 9).alias(f"{x}_{e}") for x in ("precision", "recall", "wrong") for e in ("low", "high")])


@register("gates", f"SELECT stratum, CASE WHEN n < ceil(3.84 / 0.3 - 3.84) THEN 'unproven' WHEN wrong_high <= 0.3 THEN 'pass' ELSE 'fail' END AS gate FROM (SELECT stratum, class_class + class_review + class_other AS n, {wilson_sql('class_other', '(class_class + class_review + class_other)', 'wrong')} FROM ({CELLS}))")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evals.performance(evals.six_cells(evals.sliced(scored(spark, sf_dir)), "stratum"))
    return told.select("stratum", N.gate(F.col("wrong_high"), F.col("recall_n"), 0.3).alias("gate"))


@register("distinct_wrong", f"SELECT source, count(*) AS decisions, count(*) FILTER (WHERE wrong) AS wrong FROM (SELECT source, n_chars % 50 AS k, bool_or(asserted = 'other') AS wrong FROM {SCORED} WHERE expected GROUP BY ALL) GROUP BY source")
def distinct_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.distinct_wrong(scored(spark, sf_dir).withColumn("decision_key", F.col("n_chars") % 50), "source")


LEVEL = "CASE n_chars % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_chars") % 4
    level = F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "low")
    right = F.col("expected") == (F.col("asserted") == "class")
    outcome = F.when(F.col("asserted") == "review", "routed").when(right, "right").otherwise("wrong")
    return scored(spark, sf_dir).select((F.col("n_chars") % 97).alias("decision_key"), level.alias("level"), outcome.alias("outcome"))


BUCKETS = f"""WITH i AS (SELECT n_chars % 97 AS k, {LEVEL} AS level, CASE WHEN asserted = 'review' THEN 'routed' WHEN expected = (asserted = 'class') THEN 'right' ELSE 'wrong' END AS outcome FROM {SCORED}),
d AS (SELECT k, min(level) AS level, max(level) AS last, bool_or(outcome = 'wrong') AS wrong, bool_and(outcome = 'routed') AS routed FROM i WHERE level IS NOT NULL GROUP BY k),
b AS (SELECT level, count(*) AS decisions, count(*) FILTER (WHERE wrong) AS errors, count(*) FILTER (WHERE routed) AS routed FROM d WHERE level = last GROUP BY level)"""


@register("calibration", BUCKETS + f" SELECT level, decisions, errors, routed, {wilson_sql('errors', '(decisions - routed)', 'rate')} FROM b")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evals.calibration(_levels(spark, sf_dir))
    return b.select("level", "decisions", "errors", "routed", F.round("low", 9).alias("rate_low"), F.round("high", 9).alias("rate_high"))


RULES = f"(SELECT doc_id, expected = (n_chars < 4000) AS was, expected = (n_chars > 500) AS now FROM {SCORED})"


@register("mcnemar", f"SELECT count(*) AS pairs, count(*) FILTER (WHERE was AND NOT now) AS worse, count(*) FILTER (WHERE NOT was AND now) AS better FROM {RULES}")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("expected").alias("expectation"), "n_chars")
    before = rows.withColumn("right", F.col("expectation") == (F.col("n_chars") < 4000))
    after = rows.withColumn("right", F.col("expectation") == (F.col("n_chars") > 500))
    return evals.paired(before, after).select("pairs", "worse", "better")


@register("mcnemar_p", """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey),
s AS (SELECT *, list_sum(list_transform(range(0, least(a, b) + 1), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda i: (a + b - i + 1)::DOUBLE / i)), 1))) AS s FROM c)
SELECT o_custkey, round(least(2 * s / pow(2, a + b), 1) + 1e-12, 9) AS p FROM s""")
def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders of two states as decisions that got worse and better."""
    told = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return told.select("o_custkey", F.round(N.exact_mcnemar(F.col("a"), F.col("b")) + 1e-12, 9).alias("p"))


@register("comparison_key", "SELECT p_partkey, regexp_replace(replace(lower(p_name || ' & ' || p_brand), '&', 'and'), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM part")
def comparison_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.comparison_key(F.concat("p_name", F.lit(" & "), "p_brand")).alias("key"))


DL = "(1 - damerau_levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)))"


NAMED = "SELECT regexp_replace(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS a, count(*) AS n FROM part GROUP BY 1"


@register("similar_names", f"SELECT x.a AS a, y.a AS b, round(1 - damerau_levenshtein(x.a, y.a)::DOUBLE / greatest(length(x.a), length(y.a)), 9) AS similarity, x.n AS rows_a, y.n AS rows_b FROM ({NAMED}) AS x JOIN ({NAMED}) AS y ON x.a < y.a AND damerau_levenshtein(x.a, y.a) <= 0.15 * greatest(length(x.a), length(y.a)) + 1e-9")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts' names with their brands at 0.85 or more, through shared grams."""
    named = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return similar.similar_pairs(named, "name", 0.85).withColumn("similarity", F.round("similarity", 9))


@register("fuzzy_names", f"SELECT p_partkey, round({DL}, 9) AS similarity, {DL} >= 0.6 AS match FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS a, regexp_replace(lower(reverse(p_name)), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS b FROM part)")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    alike = S.similarity(F.col("p_name"), F.reverse("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(alike, 9).alias("similarity"), (alike >= 0.6).alias("match"))


@register("keyed_accuracy", "SELECT count(*) AS n, count(*) FILTER (WHERE s.n_name = n.n_name) AS right, round(count(*) FILTER (WHERE s.n_name = n.n_name)::DOUBLE / count(*), 9) AS accuracy FROM nation n LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2) s USING (n_nationkey)")
def keyed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    expected = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    actual = nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("seq"))
    told = evals.keyed_accuracy(expected, actual)
    return told.select("n", "right", F.round("accuracy", 9).alias("accuracy"))


@register("worst_run", "SELECT grp, run, verdict FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE verdict WHEN 'FAIL' THEN 3 WHEN 'MARGINAL' THEN 2 ELSE 1 END DESC, e2e, run) AS k FROM (SELECT source AS grp, lang AS run, CASE WHEN avg(quality) > 0.95 THEN 'PASS' WHEN avg(quality) > 0.8 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict, avg(quality) AS e2e FROM labels JOIN documents USING (doc_id) GROUP BY ALL)) WHERE k = 1")
def worst_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    e2e = F.avg("quality")
    runs = rows.groupBy(F.col("source").alias("grp"), F.col("lang").alias("run")).agg(e2e.alias("end_to_end"), F.when(e2e > 0.95, "PASS").when(e2e > 0.8, "MARGINAL").otherwise("FAIL").alias("verdict"), e2e.alias("lowest_step"))
    return evals.worst_runs(runs).select("grp", "run", "verdict")


@register("spread", "SELECT source, min(n_chars)::BIGINT AS least, max(n_chars)::BIGINT AS most, count(DISTINCT text) AS records FROM documents GROUP BY source")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("score"), F.sha2("text", 256).alias("digest"))
    return evals.spread(rows, "source")


@register("batch_items", "SELECT conv_id, turn, ((row_number() OVER w - 1) // 3)::BIGINT AS batch, ((row_number() OVER w - 1) % 3)::INT AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.batched(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 3, "conv_id", "turn")


ECHO = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN left(text, 12) WHEN 2 THEN 'nothing like it' END"


@register("rejoin", f"""WITH i AS (SELECT conv_id AS batch, turn AS id, text FROM conversations), a AS (SELECT conv_id AS batch, turn AS id, {ECHO} AS echo FROM conversations WHERE turn % 4 <> 3)
SELECT i.batch, i.id, CASE WHEN a.id IS NULL THEN 'missing' WHEN echo = text THEN NULL WHEN echo <> '' AND starts_with(text, echo) AND NOT EXISTS (SELECT 1 FROM i j WHERE j.batch = i.batch AND j.text <> i.text AND starts_with(j.text, echo)) THEN NULL ELSE 'bad_echo' END AS review FROM i LEFT JOIN a USING (batch, id)""")
def rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    echo = F.when(k == 0, F.col("text")).when(k == 1, F.left("text", F.lit(12))).when(k == 2, "nothing like it")
    items = turns.select(F.col("conv_id").alias("batch"), F.col("turn").alias("id"), "text")
    said = turns.where(k != 3).select(F.col("conv_id").alias("batch"), F.col("turn").alias("id"), echo.alias("echo"), F.lit("body").alias("body"))
    return answers.rejoined(items, said).select("batch", "id", "review")


GUARDS = ("pairing", "quote", "value_shape")


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    checks = F.array(*[F.struct(F.lit(g).alias("guardrail"), F.when(F.col("event_id") % (5 + i) == 0, "failed").otherwise("passed").alias("outcome")) for i, g in enumerate(GUARDS)])
    return e.select(F.col("event_id").alias("trace"), checks.alias("checks"), F.when(F.col("event_id") % 11 == 0, "needs_review").otherwise("accepted").alias("terminal"), F.when(F.col("event_id") % 3 == 0, "wrong").when(F.col("event_id") % 3 == 1, "correct").otherwise("unknown").alias("verdict"))


TRACES = "(SELECT event_id, event_id % 5 = 0 AS f0, event_id % 6 = 0 AS f1, event_id % 7 = 0 AS f2, event_id % 3 AS v FROM events)"


@register("guard_tally", " UNION ALL ".join(f"SELECT '{g}' AS guardrail, CASE WHEN f{i} THEN 'failed' ELSE 'passed' END AS outcome, count(*) AS n FROM {TRACES} GROUP BY ALL" for i, g in enumerate(GUARDS)))
def guard_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.containment(_traces(spark, sf_dir))


RUNGS = (("unguarded", "false"), ("pairing", "f0"), ("pairing+quote", "f0 OR f1"), ("pairing+quote+value_shape", "f0 OR f1 OR f2"))


@register("scorecard", "SELECT 'floor' AS policy, 0::BIGINT AS answered, 0::BIGINT AS prevented, 0::BIGINT AS escaped, 0::BIGINT AS delivered, 0::BIGINT AS unknown" + "".join(f" UNION ALL SELECT '{n}', count(*) FILTER (WHERE NOT ({s})), count(*) FILTER (WHERE ({s}) AND v = 0), count(*) FILTER (WHERE NOT ({s}) AND v = 0), count(*) FILTER (WHERE NOT ({s}) AND v = 1), count(*) FILTER (WHERE ({s}) AND v = 2) FROM {TRACES}" for n, s in RUNGS))
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = _traces(spark, sf_dir)
    told = ablation.verdicts(traces.select("trace", "verdict"))
    return ablation.scorecard(traces.drop("verdict"), told, ablation.ladder(traces)).drop("rung")


LOADS = "(?is)<(script|img|iframe|link|source|video|audio|embed|object)\\b[^>]*\\b(src|href|data)\\s*=\\s*[\"'']?\\s*(https?:)?//"


@register("selfcontained_html", f"SELECT page_id, NOT (regexp_matches(html, '{LOADS}') OR regexp_matches(html, '(?i)url\\(|@import')) AS self_contained FROM pages")
def selfcontained_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.self_contained(F.col("html")).alias("self_contained"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight components of each vector as words placed on a line."""
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.select((F.col("vec_id") / 50).cast("int").alias("doc"), F.lit(1).alias("page"), F.col("vec_id").alias("frag_no"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("text"), (F.round(F.col("embedding")[0].cast("double") * 400) + 200).alias("x"), (F.round(F.col("embedding")[1].cast("double") * 100) * 6).alias("y"))
    return one.withColumn("right", F.col("x") + 6)


FRAGMENTS = "(SELECT trunc(vec_id / 50)::INT AS doc, vec_id, round(embedding[1]::DOUBLE * 400) + 200 AS x, round(embedding[1]::DOUBLE * 400) + 206 AS \"right\", round(embedding[2]::DOUBLE * 100) * 6 AS y FROM embeddings)"


@register("channel_sweep", f"""WITH s AS (SELECT doc, x, "right", max("right") OVER (PARTITION BY doc ORDER BY x, "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, max("right") OVER (PARTITION BY doc) - min(x) OVER (PARTITION BY doc) AS w FROM {FRAGMENTS})
SELECT doc, reach AS at, x - reach AS width FROM s WHERE w > 0 AND x - reach > w * 0.05""")
def channel_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.channels(_fragments(spark, sf_dir), "doc")


@register("row_cluster", f"SELECT doc, y + 0.0 AS row_y, count(*) AS fragments FROM {FRAGMENTS} GROUP BY ALL")
def row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights are multiples of six, so rows further apart than the tolerance never meet."""
    return geometry.row_clusters(_fragments(spark, sf_dir)).groupBy("doc", (F.col("row_y") + F.lit(0.0)).alias("row_y")).agg(F.count("*").alias("fragments"))


@register("money_columns", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(r - 100) <= abs(r - 160) AND abs(r - 100) <= 20 THEN 'paid_out' WHEN abs(r - 160) < abs(r - 100) AND abs(r - 160) <= abs(r - 240) AND abs(r - 160) <= 20 THEN 'paid_in' WHEN abs(r - 240) < abs(r - 160) AND abs(r - 240) <= 20 THEN 'balance' END AS \"column\" FROM (SELECT *, 80 + l_quantity * 4 AS r FROM lineitem)")
def money_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.lit(80) + F.col("l_quantity") * 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geometry.money_column(right, F.lit(100), F.lit(160), F.lit(240)).alias("column"))


@register("sign_convention", """WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice::DECIMAL(18,2) AS amount, sum(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END * o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::DECIMAL(28,2) AS balance FROM orders),
n AS (SELECT o_custkey, count(*) AS n FROM p GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n >= 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 'adds' ELSE 'subtracts' END END AS convention FROM n""")
def sign_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    sign = F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1)
    balance = F.sum(sign * amount).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("decimal(28,2)")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), amount.alias("amount"), balance.alias("balance"))
    return geometry.sign_convention(rows, "o_custkey").select("o_custkey", "convention")


@register("resume_remaining", "SELECT event_id, sha256(length(event_id::VARCHAR)::VARCHAR || ':' || event_id::VARCHAR || length(event_type)::VARCHAR || ':' || event_type) AS key FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id = e.event_id AND d.event_type = 'purchase')")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "events").select("event_id", "event_type", evals.digest([F.col("event_id"), F.col("event_type")]).alias("key"))
    return evals.remaining(work, work.where("event_type = 'purchase'"), "key").select("event_id", "key")


BUNDLE = "SELECT source, substr(h, 1, 3) AS bundle, sha256(string_agg(h, ',' ORDER BY h)) AS inner_key FROM (SELECT source, sha256(text) || ':' || count(*)::VARCHAR AS h FROM documents GROUP BY source, text) GROUP BY ALL"


@register("content_key", f"SELECT source, sha256(string_agg(bundle || inner_key, ',' ORDER BY bundle)) AS key FROM ({BUNDLE}) GROUP BY source")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a source's texts, whatever their order: a text counts as often as it stands."""
    return evals.set_digest(table(spark, sf_dir, "documents"), "text", "source")


@register("rejects", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'bad_date' WHEN 1 THEN 'no_merchant' WHEN 2 THEN 'no_amount' WHEN 3 THEN 'bad_amount' WHEN 4 THEN 'zero_amount' END AS reason,
  CASE WHEN event_id % 8 > 4 THEN value::DECIMAL(18,2) END AS amount, CASE WHEN event_id % 8 > 4 THEN CASE WHEN event_id % 2 = 0 THEN 'debit' ELSE 'credit' END END AS direction FROM events""")
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.sources.statements import LAYOUTS, annotated

    k = F.col("event_id") % 8
    # what pence can't show is written out, as it isn't zero; the least double has 325 places
    value = F.when(F.abs("value") < 0.005, F.format_string("%.340f", "value")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(k == 0, "2024-02-31").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Date"),
        F.when(k == 1, "  ").otherwise(F.col("event_type")).alias("Description"),
        F.when(k == 2, "").when(k == 3, "1e3").when(k == 4, "0.00").otherwise(F.concat(F.when(F.col("event_id") % 2 == 0, "-").otherwise(""), value)).alias("Amount"),
    )
    found = annotated(rows, LAYOUTS[5], {c: c for c in ("Date", "Description", "Amount")})
    good = F.col("reason").isNull()
    return found.select("event_id", "reason", F.when(good, F.col("amount")).alias("amount"), F.when(good, F.col("direction")).alias("direction"))


@register("money_display", "SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN '−' ELSE '' END || '£' || format('{:,.2f}', abs(o_totalprice::DECIMAL(18,2))::DOUBLE) AS shown FROM orders")
def money_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.money(F.col("o_totalprice").cast("decimal(18,2)")).alias("shown"))


@register("labels_and_lists", "SELECT p_partkey, upper(left(x, 1)) || substr(x, 2) AS label, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, replace(replace(replace(p_name || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, p_brand || ', ' || p_type || ' and ' || p_name AS listed FROM (SELECT *, replace(p_type, '_', ' ') AS x FROM part)")
def labels_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.term_label(F.col("p_type")).alias("label"), X.slug(F.col("p_name")).alias("slug"), X.html_escape(F.concat("p_name", F.lit(" <&>"))).alias("html"), X.sentence_list(F.array("p_brand", "p_type", "p_name")).alias("listed"))


@register("baseline_compare", "SELECT o_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN b IS NULL THEN 'new' WHEN abs(n - b) <= 1e-6 THEN 'same' WHEN n > b THEN 'better' ELSE 'worse' END AS state FROM (SELECT o_custkey, avg(o_totalprice) AS b FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1) FULL JOIN (SELECT o_custkey, avg(o_totalprice) AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1) USING (o_custkey)")
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    score = lambda df: df.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("score"), F.lit(1).alias("version"))
    both = evals.compare_baseline(score(o.where("o_orderdate < DATE'1998-01-01'")), score(o.where("o_orderdate >= DATE'1997-01-01'")), "o_custkey")
    return both.select("o_custkey", "state")


@register("proposed_actions", f"""WITH f AS ({FINDINGS}),
a AS (SELECT 2 AS ord, 'subscription' AS action, merchant, annualised, DATE '1998-09-01' AS due FROM (SELECT * FROM f WHERE kind = 'subscription' AND period <> 'yearly' AND annualised > 100 ORDER BY annualised DESC, merchant LIMIT 1)
  UNION ALL SELECT 3, 'renewal', merchant, annualised, (SELECT min((last_date + to_years(k::INT))::DATE) FROM range(1, 12) t(k) WHERE (last_date + to_years(k::INT))::DATE > {TODAY}) FROM f WHERE period = 'yearly')
SELECT 'act-' || lpad((row_number() OVER (ORDER BY ord, annualised DESC, merchant))::VARCHAR, 2, '0') AS action_id, action, merchant, annualised, due FROM a""")
def proposed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir).withColumns({"rise_to": F.lit(None).cast("decimal(18,2)"), "category": F.lit("unknown")})
    return audit.propose_actions(found, F.expr(TODAY))
