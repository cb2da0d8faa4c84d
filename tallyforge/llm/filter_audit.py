"""How filters overlap: what a document audit of several filters removes, and whose work it is.

Every filter is a column that is true where a row fails. For each part (a source) one
aggregation sums the products of the flags over every set of filters: the joint-failure
counts ``f(S)``, of all rows and of the rows of each label. Rows pass through the shuffle
as these sums alone. From them everything follows by Moebius inversion:

* survivors of the filters in S: the alternating sum of ``f(T)`` over all T within S;
* rows that fail exactly S: the alternating sum of ``f(T)`` over all T that hold S;
* what a filter removes at its place in an order: survivors before less survivors after,
  and what it would remove but finds gone: ``f`` of itself less that;
* its Shapley value over all orders: the dividend of T in the game "rows removed by a
  coalition" is ``f(T)`` with a sign, and each member gets an equal part of it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._session import free_names

#: More filters than these would make more orders than a report is read for.
MOST = 6
WORD = r"[^\x20\x09-\x0D]+"


def members(s: int, k: int) -> list[int]:
    return [i for i in range(k) if s >> i & 1]


def joint_failures(flagged: DataFrame, part: str, filters: list[str], weights: dict[str, Column]) -> DataFrame:
    """(part, one array a weight): at place S the sum of the weight over rows that fail all filters of S."""
    k = len(filters)
    flag = [F.coalesce(F.col(f"`{f}`").cast("boolean"), F.lit(False)) for f in filters]
    sums = []
    for name, weight in weights.items():
        for s in range(1 << k):
            product = F.coalesce(weight.cast("long"), F.lit(0))
            for i in members(s, k):
                product = product * flag[i].cast("long")
            sums.append(F.sum(product).alias(f"{name}_{s}"))
    rows = flagged.groupBy(F.col(f"`{part}`").alias("part")).agg(*sums)
    return rows.select("part", *[F.array(*[F.col(f"{name}_{s}") for s in range(1 << k)]).alias(name) for name in weights])


def _alternating(f: Column, terms: list[tuple[int, int]]) -> Column:
    total = F.lit(0).cast("long")
    for s, sign in terms:
        total = total + f[s] if sign > 0 else total - f[s]
    return total


def survivors(f: Column, k: int) -> Column:
    """At place S the rows that no filter of S fails."""
    return F.array(*[_alternating(f, [(t, (-1) ** t.bit_count()) for t in range(1 << k) if t & s == t]) for s in range(1 << k)])


def exact_failures(f: Column, k: int) -> Column:
    """At place S the rows that fail the filters of S and no other."""
    return F.array(*[_alternating(f, [(t, (-1) ** (t ^ s).bit_count()) for t in range(1 << k) if t & s == s]) for s in range(1 << k)])


def shapley(f: Column, k: int) -> Column:
    """At place i what filter i removes, summed over all orders: its equal parts of all dividends."""
    orders = factorial(k)
    of = []
    for i in range(k):
        total = F.lit(0).cast("long")
        for t in range(1 << k):
            if t >> i & 1:
                total = total + f[t] * ((-1) ** (t.bit_count() + 1) * orders // t.bit_count())
        of.append(total)
    return F.array(*of)


def audit(flagged: DataFrame, part: str, filters: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """A row for each part, order of the filters and step in it.

    ``filters`` names boolean columns, true where a row fails; null is false. Their names
    are single characters, so that an order is a string. ``labels`` maps a result column
    to the boolean column whose true rows it counts where they are removed. Columns: part
    (null: the empty string), filter_order, step (from 1), kept, removed, redundant,
    unique_fails, one for each label, shapley. Every row counts for itself, repeated ones
    too; a table without rows gives none. Other columns are not read.
    """
    k = len(filters)
    if not 1 <= k <= MOST or any(len(f) != 1 for f in filters) or len(set(filters)) < k:
        raise ValueError(f"1 to {MOST} filters of different single characters, not {filters}")
    labels = labels or {}
    one = flagged.select(
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(filters)],
        *[F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)).alias(f"l{i}") for i, c in enumerate(labels.values())],
    )
    weights = {"rows": F.lit(1)} | {f"lost{i}": F.col(f"l{i}") for i in range(len(labels))}
    joint = joint_failures(one, "part", [f"f{i}" for i in range(k)], weights)
    solved = joint.select(
        "part",
        F.col("rows").alias("joint"),
        survivors(F.col("rows"), k).alias("left"),
        exact_failures(F.col("rows"), k).alias("exact"),
        shapley(F.col("rows"), k).alias("fair"),
        *[survivors(F.col(f"lost{i}"), k).alias(f"left{i}") for i in range(len(labels))],
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = solved.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    mask = [F.when(F.instr(F.substring("filter_order", F.lit(1), upto), f) > 0, 1 << i).otherwise(0) for upto in (F.col("step") - 1, F.col("step")) for i, f in enumerate(filters)]
    before, after = sum(mask[1:k], mask[0]), sum(mask[k + 1 :], mask[k])
    rows = rows.withColumn("before", before).withColumn("after", after).withColumn("own", F.col("after") - F.col("before"))
    removed = F.col("left")[F.col("before")] - F.col("left")[F.col("after")]
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.col("left")[F.col("after")].alias("kept"),
        removed.alias("removed"),
        (F.col("joint")[F.col("own")] - removed).alias("redundant"),
        F.col("exact")[F.col("own")].alias("unique_fails"),
        *[(F.col(f"left{i}")[F.col("before")] - F.col(f"left{i}")[F.col("after")]).alias(name) for i, name in enumerate(labels)],
        F.col("fair")[F.log2("own").cast("int")].alias("shapley"),
    )


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with columns A to E: what each of five text filters fails.

    A: under 200 words. B: less than half as many different words as words. C: more than
    2 in 100 characters are capitals A-Z. D: any of ``#$%&*|``. E: the same text under a
    smaller id, anywhere in the table. A null text is an empty one. Rows that share the
    smallest id of a text are all first ones; a null id is smaller than none and larger
    than none, so such rows fail E only if the text stands under an id too.
    """
    words, chars, digest, first, key = free_names(docs.columns, "words", "chars", "digest", "first", "key")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{id_col}`")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    found = docs.select(
        *rest,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias(words),
        F.length(text).alias(chars),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("C"),
        text.rlike("[#$%&*|]").alias("D"),
        F.sha2(text.cast("binary"), 256).alias(digest),
    )
    n = F.size(words)
    judged = found.select(*rest, (n < 200).alias("A"), (100 * F.size(F.array_distinct(words)) < 50 * n).alias("B"), (100 * F.col("C") > 2 * F.col(chars)).alias("C"), "D", digest)
    # the first holder of each text; ids spread evenly however often a text is repeated
    firsts = judged.groupBy(digest).agg(F.min(id_).alias(first)).select(F.col(first).alias(key), F.col(digest).alias(f"{digest}_"), F.lit(True).alias(first))
    same = id_.eqNullSafe(F.col(key)) & (F.col(digest) == F.col(f"{digest}_"))
    return judged.join(firsts, same, "left").select(*rest, "A", "B", "C", "D", F.col(first).isNull().alias("E"))


def labelled(docs: DataFrame, labels: DataFrame, names: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a boolean column for each label column that is 1 in any row of the id."""
    held = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("label_of")).agg(*[F.max(F.col(f"`{c}`") == 1).alias(name) for name, c in names.items()])
    return docs.join(held, F.col(f"`{id_col}`") == F.col("label_of"), "left").drop("label_of")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters by source, with good and toxic documents lost."""
    flagged = text_failures(docs.select("doc_id", "text", "source"))
    flagged = labelled(flagged, labels, {"good": "quality", "toxic": "toxic"})
    return audit(flagged, "source", list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})


def oracle_sql() -> str:
    """The same by following every document through every order, without inclusion and exclusion."""
    letters = "[" + ", ".join(f"'{x}'" for x in "ABCDE") + "]"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, unnest({letters}) AS u(x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, s AS step, o[s] AS f, o[1:s - 1] AS before FROM orders, generate_series(1, 5) AS g(s) WHERE length(o) = 5),
cells AS (
  SELECT c.*, filter_order, step, f, contains(fails, f) AS hit, regexp_matches(fails, '[' || before || '.]') AS gone
  FROM counted AS c, steps),
each AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept,
         coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM cells GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM each"""
