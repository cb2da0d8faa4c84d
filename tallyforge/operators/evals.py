"""Scored decisions to precision, recall, calibration, verdicts and paired tests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import numbers as N

LEVELS = ("high", "medium", "low")


def sliced(items: DataFrame) -> DataFrame:
    """A row per stratum that an item is in, and one for all of them together."""
    return items.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lit("overall")), F.coalesce("strata", F.array().cast("array<string>"))))).alias("stratum"))


def six_cells(items: DataFrame, *keys: str) -> DataFrame:
    """Counts by expected (is the class?) and asserted (class, other, review).

    Also precision, recall (a review finds what it would have missed) and the rate of
    confident errors, with their numbers of trials.
    """
    e, a = F.col("expected"), F.col("asserted")
    cells = items.groupBy(*keys).agg(*[F.count_if((e if want else ~e) & (a == said)).alias(f"{'class' if want else 'other'}_{said}") for want in (True, False) for said in ("class", "other", "review")])
    right, found = F.col("class_class"), F.col("class_class") + F.col("class_review")
    cells = cells.withColumn("precision_n", right + F.col("other_class")).withColumn("recall_n", found + F.col("class_other"))
    return cells.withColumns({"precision_k": right, "recall_k": found, "wrong_k": F.col("class_other")})


def performance(cells: DataFrame) -> DataFrame:
    """Wilson intervals of precision, recall and confident errors."""
    out = cells
    for name, k, n in (("precision", "precision_k", "precision_n"), ("recall", "recall_k", "recall_n"), ("wrong", "wrong_k", "recall_n")):
        ci = N.wilson(F.col(k), F.col(n))
        out = out.withColumns({name: F.when(F.col(n) > 0, F.col(k) / F.col(n)), f"{name}_low": ci["low"], f"{name}_high": ci["high"]})
    return out


def extraction_slices(items: DataFrame) -> DataFrame:
    """Per stratum Wilson intervals of what was missed and of what was invented.

    ``items`` has expected, asserted, strata and unauthored: negatives that nobody wrote
    down count against no gate.
    """
    a, gated = F.col("asserted"), ~F.col("expected") & ~F.coalesce("unauthored", F.lit(False))
    out = sliced(items).groupBy("stratum").agg(F.count_if("expected").alias("miss_n"), F.count_if(F.col("expected") & (a == "other")).alias("miss_k"), F.count_if(gated).alias("invention_n"), F.count_if(gated & (a == "class")).alias("invention_k"))
    for name in ("miss", "invention"):
        ci = N.wilson(F.col(f"{name}_k"), F.col(f"{name}_n"))
        out = out.withColumns({f"{name}_low": ci["low"], f"{name}_high": ci["high"]})
    return out


def wrong_by_path(items: DataFrame, path: str = "kind_from") -> DataFrame:
    """Decisions and confident errors by the path that a decision came by."""
    wrong = (F.col("asserted") != "review") & (F.col("expected") != (F.col("asserted") == "class"))
    return items.groupBy(path).agg(F.count("*").alias("decisions"), F.count_if(wrong).alias("wrong"))


def distinct_wrong(items: DataFrame, *keys: str) -> DataFrame:
    """Per slice: decisions of the class, and those with any confidently wrong row."""
    one = items.where("expected").groupBy(*keys, "decision_key").agg(F.bool_or(F.col("asserted") == "other").alias("wrong"))
    return one.groupBy(*keys).agg(F.count("*").alias("decisions"), F.count_if("wrong").alias("wrong"))


def calibration(items: DataFrame) -> DataFrame:
    """(level, decisions, errors, routed, asserted, low, high) of decisions with one level.

    ``items`` (decision_key, level, outcome right/wrong/routed). A decision errs if any
    row is wrong and is routed if all are; the rate is over those that assert.
    """
    one = items.where("level IS NOT NULL").groupBy("decision_key").agg(F.min("level").alias("level"), F.max("level").alias("last"), F.bool_or(F.col("outcome") == "wrong").alias("wrong"), F.bool_and(F.col("outcome") == "routed").alias("routed"))
    by = one.where("level = last").groupBy("level").agg(F.count("*").alias("decisions"), F.count_if("wrong").alias("errors"), F.count_if("routed").alias("routed"))
    by = by.withColumn("asserted", F.col("decisions") - F.col("routed"))
    ci = N.wilson(F.col("errors"), F.col("asserted"))
    return by.withColumns({"low": ci["low"], "high": ci["high"]})


def untraceable(items: DataFrame) -> DataFrame:
    """Rows without a level, and decisions with several."""
    rows = items.where("level IS NULL").agg(F.count("*").alias("a"))
    several = items.where("level IS NOT NULL").groupBy("decision_key").agg(F.countDistinct("level").alias("n")).where("n > 1").agg(F.count("*").alias("b"))
    return rows.crossJoin(several).select((F.col("a") + F.col("b")).alias("untraceable"))  # two single rows


def ranking_signal(buckets: DataFrame) -> DataFrame:
    """What levels say about errors: ranks, inverted, unproven, no_variation, no_evidence."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    kept = buckets.where("decisions > 0").withColumn("rank", rank)
    pairs = kept.alias("a").join(kept.alias("b"), F.expr("a.rank < b.rank AND a.rank > 0"))  # at most three levels
    told = pairs.agg(F.coalesce(F.bool_or(F.expr("b.high < a.low")), F.lit(False)).alias("inverted"), F.coalesce(F.bool_or(F.expr("a.high < b.low")), F.lit(False)).alias("ranks"))
    n = kept.agg(F.count("*").alias("levels"))
    signal = F.when(F.col("levels") == 0, "no_evidence").when(F.col("levels") == 1, "no_variation").when(F.col("inverted"), "inverted").when(F.col("ranks"), "ranks").otherwise("unproven")
    return n.crossJoin(told).select("levels", signal.alias("signal"))  # two single rows


def closing_errors(errors: Column, decisions: Column, neighbour_low: Column) -> Column:
    """The fewest further errors whose interval would reach the neighbour's."""
    room = F.greatest(decisions - errors, F.lit(0)).cast("int")
    tries = F.filter(F.sequence(F.lit(0), room), lambda x: (x > 0) & (N.wilson(errors + x, decisions)["high"] >= neighbour_low))
    return F.coalesce(F.array_min(tries), room)


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pairs, worse, better, p) of two runs' items with the same id and expectation."""
    both = before.select("id", "expectation", F.col("right").alias("was")).join(after.select("id", "expectation", F.col("right").alias("now")), ["id", "expectation"])
    told = both.agg(F.count("*").alias("pairs"), F.count_if(F.expr("was AND NOT now")).alias("worse"), F.count_if(F.expr("NOT was AND now")).alias("better"))
    return told.withColumn("p", N.exact_mcnemar(F.col("worse"), F.col("better")))


def keyed_accuracy(expected: DataFrame, actual: DataFrame, threshold: float | None = None) -> DataFrame:
    """Share of expected (key, value) that the first actual value of the key matches.

    Exact, or by similarity of comparison keys; a missing key is wrong, and nothing
    expected is wholly right.
    """
    from tallyforge.functions.similarity import similarity

    first = actual.groupBy("key").agg(F.min_by("value", "seq").alias("said"))
    rows = expected.join(first, "key", "left")
    match = F.col("value") == F.col("said") if threshold is None else similarity(F.col("value"), F.col("said")) >= threshold
    return rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(match, F.lit(False))).alias("right")).withColumn("accuracy", F.when(F.col("n") == 0, 1.0).otherwise(F.col("right") / F.col("n")))


def set_f1(expected: Column, actual: Column) -> Column:
    a, b = F.array_distinct(expected), F.array_distinct(actual)
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * common / (F.size(a) + F.size(b)))


def pooled_verdict(steps: DataFrame, bar: float | Mapping[str, float], end_to_end_bar: float = 0.95) -> DataFrame:
    """Per group PASS if every step's lower bound reaches its bar and the mean end-to-end
    its own, else FAIL; a step without a bar, or with nothing expected, shows nothing."""
    pooled = steps.groupBy("grp", "step").agg(F.sum("correct").alias("k"), F.sum("expected").alias("n"), F.avg("end_to_end").alias("e2e"))
    if isinstance(bar, Mapping):
        least = F.try_element_at(F.create_map(*[F.lit(x) for pair in bar.items() for x in pair]), F.col("step"))
    else:
        least = F.lit(bar)
    ok = F.when(F.col("n") > 0, N.wilson(F.col("k"), F.col("n"))["low"] >= least)
    judged = pooled.withColumn("ok", F.coalesce(ok, F.lit(False)))
    verdict = F.when(F.bool_and("ok") & (F.avg("e2e") >= end_to_end_bar), "PASS").otherwise("FAIL")
    return judged.groupBy("grp").agg(verdict.alias("verdict"), F.min("k").alias("least_correct"))


def overall_verdict(quality: DataFrame, harms: DataFrame, ceilings: DataFrame, relations: DataFrame) -> DataFrame:
    """(grp, verdict, over, failed_relations): quality's verdict, unless a declared ceiling
    isn't shown to hold or a relation failed.

    ``quality`` (grp, verdict); ``harms`` (grp, stratum, class, wrong, decisions);
    ``ceilings`` (stratum, class, ceiling), a declared list, of the upper bound of the share
    that is confidently wrong: where nothing was measured, it doesn't hold. ``relations``
    (grp, outcome): one that couldn't be judged doesn't fail.
    """
    asked = quality.select("grp").distinct().crossJoin(F.broadcast(ceilings))  # every declared ceiling for every group
    high = N.wilson(F.col("wrong"), F.col("decisions"))["high"]
    clear = F.coalesce(F.when(F.col("decisions") > 0, high <= F.col("ceiling")), F.lit(False))
    over = asked.join(harms, ["grp", "stratum", "class"], "left").groupBy("grp").agg(F.count_if(~clear).alias("over"))
    failed = relations.where("outcome = 'failed'").groupBy("grp").agg(F.count("*").alias("failed_relations"))
    rows = quality.join(over, "grp", "left").join(failed, "grp", "left").na.fill(0, ["over", "failed_relations"])
    verdict = F.when((F.col("over") > 0) | (F.col("failed_relations") > 0), "FAIL").otherwise(F.col("verdict"))
    return rows.select("grp", verdict.alias("verdict"), "over", "failed_relations")


def worst_runs(runs: DataFrame) -> DataFrame:
    """Per group the run with the worst verdict, then lowest end-to-end, then lowest step."""
    rank = F.array_position(F.array(F.lit("PASS"), F.lit("MARGINAL"), F.lit("FAIL")), F.col("verdict"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(rank), "end_to_end", "lowest_step", "run"))
    return runs.withColumn("place", place).where("place = 1").drop("place")


def spread(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.min("score").alias("least"), F.max("score").alias("most"), F.countDistinct("digest").alias("records"))


def containment(traces: DataFrame) -> DataFrame:
    """Counts by guard and outcome of exploded checks."""
    checks = traces.select("terminal", F.explode("checks").alias("c"))
    return checks.groupBy(F.col("c.guardrail").alias("guardrail"), F.col("c.outcome").alias("outcome")).agg(F.count("*").alias("n"))


def digest(columns: list[Column]) -> Column:
    """A digest that no two different lists of values share: parts carry their lengths."""
    parts = [F.concat(F.length(F.coalesce(c.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def set_digest(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, key): a digest of each group's values in any order, with their counts.

    Values are counted, bundled by the first three digits of their own digests, and the
    bundles' digests are digested: a group gathers 4096 of them, whatever its size.
    """
    each = rows.groupBy(*keys, value).agg(F.count("*").alias("n")).select(*keys, F.concat(F.sha2(value, 256), F.lit(":"), F.col("n").cast("string")).alias("h"))
    listed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    bundles = each.groupBy(*keys, F.substring("h", 1, 3).alias("bundle")).agg(listed("h").alias("inner"))
    return bundles.groupBy(*keys).agg(listed(F.concat("bundle", "inner")).alias("key"))


def remaining(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What an interrupted evaluation still has to do."""
    return work.join(done, list(keys), "left_anti")


def compare_baseline(baseline: DataFrame, now: DataFrame, *keys: str) -> DataFrame:
    """Per key: same, better, worse, missing (worse) or new; refused across versions."""
    both = baseline.withColumnsRenamed({"score": "was", "version": "was_version"}).join(now.withColumnsRenamed({"score": "is", "version": "is_version"}), list(keys), "full_outer")
    state = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was_version") != F.col("is_version"), "refused").when(F.abs(F.col("is") - F.col("was")) <= 1e-6, "same").when(F.col("is") > F.col("was"), "better").otherwise("worse")
    return both.withColumn("state", state)


def worst_verdict(verdicts: DataFrame, *keys: str) -> DataFrame:
    """The worst of each group's verdicts; a single FAIL over no rows at all."""
    rank = F.array_position(F.array(F.lit("PASS"), F.lit("MARGINAL"), F.lit("FAIL")), F.col("verdict"))
    worst = F.element_at(F.array(F.lit("PASS"), F.lit("MARGINAL"), F.lit("FAIL")), F.coalesce(F.max(rank), F.lit(3)).cast("int"))
    return verdicts.groupBy(*keys).agg(worst.alias("verdict"))


def throughput(calls: DataFrame, *keys: str) -> DataFrame:
    """Tokens a second over all generation time, so long calls weigh more."""
    told = calls.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"), F.count("*").alias("calls"))
    return told.withColumn("tokens_per_second", F.when(F.col("ms") > 0, F.col("tokens") * 1000 / F.col("ms")))


def coverage(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """Declared dimensions with whether anything measures them."""
    seen = measured.select("dimension").distinct().withColumn("seen", F.lit(True))
    return declared.join(seen, "dimension", "left").select("dimension", F.coalesce("seen", F.lit(False)).alias("measured"))


def score_kinds(asserted: Column, expected: Column) -> Column:
    """right, wrong or routed, for calibration."""
    return F.when(asserted == "review", "routed").when(asserted == expected, "right").otherwise("wrong")


#: End-to-end scores below this fail a fixture.
END_TO_END = 0.95


def audit_end_to_end(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Per fixture the set F1 of (merchant, period), merchants in any ASCII case."""
    from tallyforge.operators.timeline import ascii_lower

    pair = F.concat_ws("|", ascii_lower(F.col("merchant")), "period")
    sides = [df.groupBy(*keys).agg(F.collect_set(pair).alias(name)) for df, name in ((expected, "want"), (found, "got"))]
    none = F.array().cast("array<string>")
    both = sides[0].join(sides[1], list(keys), "full_outer")
    return both.select(*keys, set_f1(F.coalesce("want", none), F.coalesce("got", none)).alias("end_to_end"))


def fixture_verdicts(steps: DataFrame, end_to_end: DataFrame, bars: DataFrame, *keys: str) -> DataFrame:
    """(keys, verdict): PASS if every step reaches its own bar, inclusive, and the fixture
    the end-to-end one; a step without a bar fails. Reviews are a cost and no failure."""
    judged = steps.join(bars.select("step", "bar"), "step", "left").withColumn("ok", F.coalesce(F.col("score") >= F.col("bar"), F.lit(False)))
    told = judged.groupBy(*keys).agg(F.bool_and("ok").alias("ok"))
    verdict = F.when(F.coalesce("ok", F.lit(True)) & (F.col("end_to_end") >= END_TO_END), "PASS").otherwise("FAIL")
    return end_to_end.join(told, list(keys), "left").select(*keys, verdict.alias("verdict"))


def evaluation(items: DataFrame, expected: DataFrame, found: DataFrame, bars: DataFrame, *keys: str) -> DataFrame:
    """(keys, decisions, right, reviewed, end_to_end, verdict) of every fixture at once.

    ``items`` has keys, step, outcome (right, wrong or routed); ``expected`` and ``found``
    the series of the audit.
    """
    right = F.count_if(F.col("outcome") == "right")
    steps = items.groupBy(*keys, "step").agg((right / F.count("*")).alias("score"))
    e2e = audit_end_to_end(expected, found, *keys)
    counts = items.groupBy(*keys).agg(F.count("*").alias("decisions"), right.alias("right"), F.count_if(F.col("outcome") == "routed").alias("reviewed"))
    return counts.join(e2e, list(keys), "left").withColumn("end_to_end", F.coalesce("end_to_end", F.lit(1.0))).join(fixture_verdicts(steps, e2e, bars, *keys), list(keys), "left").withColumn("verdict", F.coalesce("verdict", F.lit("FAIL")))


def record_digest(records: DataFrame, perf: list[str]) -> Column:
    """A digest of a record without what only tells how fast it was made."""
    kept = [c for c in sorted(records.columns) if c not in perf]
    return F.sha2(F.to_json(F.struct(*kept)), 256)


def respliced(baseline: DataFrame, replayed: DataFrame, *keys: str) -> DataFrame:
    """A report's rows with the replayed fixtures in place of their own."""
    return baseline.join(replayed.select(*keys).distinct(), list(keys), "left_anti").unionByName(replayed)


def baseline_standing(version: Column, recorded: Column, now: Column, current: int, days: int = 30) -> Column:
    """refused for another scoring version or none, stale from 30 days on, else current."""
    return F.when(version.isNull() | (version != current), "refused").when(F.datediff(now, recorded) >= days, "stale").otherwise("current")


def projected(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, json): each row as a JSON document for a public page, nulls left out."""
    return rows.select(*keys, F.to_json(F.struct(*sorted(rows.columns))).alias("json"))
