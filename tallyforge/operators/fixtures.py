"""Authored expectations against actual answers, item by item."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import similarity as S
from tallyforge.functions import text as X
from tallyforge.operators.passages import quote_in
from tallyforge.operators.timeline import ascii_lower


def first_by_passage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expectation (item_id, passage, want) with the first actual (passage, seq, said)
    whose passage is the same, case and white space apart; null where there is none."""
    key = lambda df: df.withColumn("key", X.passage_key(F.col("passage")))
    first = key(actual).groupBy("key").agg(F.min_by("said", "seq").alias("said"))
    return key(expected).join(first, "key", "left").drop("key")


def by_merchant(expected: DataFrame, outcome: DataFrame, names: DataFrame) -> DataFrame:
    """Expectations joined by the canonical name of a raw descriptor, ASCII case apart.

    ``names`` (raw, canonical) is the fixture's authored table; a raw string that isn't
    in it is its own name.
    """

    def named(df: DataFrame, suffix: str) -> DataFrame:
        table = names.select(ascii_lower(F.col("raw")).alias("k"), F.col("canonical"))
        rows = df.withColumn("k", ascii_lower(F.col("raw"))).join(table, "k", "left")
        return rows.withColumn("merchant", ascii_lower(F.coalesce("canonical", "raw"))).drop("k", "canonical").withColumnRenamed("raw", f"raw_{suffix}")

    return named(expected, "expected").join(named(outcome, "actual"), "merchant", "left")


def unauthored(actual: DataFrame, expected: DataFrame, gates: DataFrame) -> DataFrame:
    """Assertions on passages nobody authored: one invention in each gated stratum.

    ``gates`` is the short declared list of strata.
    """
    lone = actual.withColumn("key", X.passage_key(F.col("passage"))).join(expected.select(X.passage_key(F.col("passage")).alias("key")).distinct(), "key", "left_anti")
    return lone.crossJoin(F.broadcast(gates.select("stratum"))).drop("key")


def answered_nothing(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """Passages whose accepted decision lists nothing and that nobody authored, once each."""
    empty = decisions.where(F.col("accepted") & (F.size("claims") == 0)).withColumn("key", X.passage_key(F.col("passage")))
    return empty.join(expected.select(X.passage_key(F.col("passage")).alias("key")).distinct(), "key", "left_anti").dropDuplicates(["key"]).drop("key")


def trace_links(items: DataFrame, traces: DataFrame) -> DataFrame:
    """(item_id, trace): traces of a passage belong to its items."""
    a = items.select("item_id", X.passage_key(F.col("passage")).alias("key"))
    return a.join(traces.select("trace", X.passage_key(F.col("passage")).alias("key")), "key").select("item_id", "trace")


def output_links(traces: DataFrame, actions: DataFrame) -> DataFrame:
    """(trace, action_id) where one of an action's evidence passages is the trace's."""
    shown = actions.select("action_id", F.explode("passages").alias("p")).select("action_id", X.passage_key(F.col("p")).alias("key"))
    return traces.select("trace", X.passage_key(F.col("passage")).alias("key")).join(shown, "key").select("trace", "action_id").distinct()


def mark_disputed(obligations: DataFrame, disagreements: DataFrame) -> DataFrame:
    """Adds to each obligation the disagreements (document, read) that lie in its passage.

    A document's readings are one automaton that runs over its passages once, so the work
    follows their letters and what is found, not their product. Readings without letters
    lie nowhere; a document's passages and readings meet in one task.
    """
    d = disagreements.select("document", "read", X.letters(F.col("read")).alias("l")).where("l <> ''").distinct()
    passages = obligations.select("obligation_id", "document", X.letters(F.col("passage")).alias("p"))
    kind = dict(obligations.dtypes)["obligation_id"]

    def run(own: pa.Table, read: pa.Table) -> pa.Table:
        ids, reads = [], []
        if own.num_rows and read.num_rows:
            machine = ahocorasick.Automaton()
            by: dict[str, list[str]] = {}
            for line, letters in zip(read.column("read").to_pylist(), read.column("l").to_pylist()):
                by.setdefault(letters, []).append(line)
            for letters in by:
                machine.add_word(letters, letters)
            machine.make_automaton()
            for i, p in enumerate(own.column("p").to_pylist()):
                for letters in {found for _, found in machine.iter(p or "")}:
                    ids += [i] * len(by[letters])
                    reads += by[letters]
        return pa.table({"obligation_id": own.column("obligation_id").take(pa.array(ids, pa.int64())), "dispute": pa.array(reads, pa.string())})

    inside = passages.groupBy("document").cogroup(d.groupBy("document")).applyInArrow(run, f"obligation_id {kind}, dispute string")
    told = inside.groupBy("obligation_id").agg(F.array_sort(F.collect_set("dispute")).alias("disputes"))
    none = F.array().cast("array<string>")
    return obligations.join(told, "obligation_id", "left").withColumn("disputed", F.array_distinct(F.concat(F.coalesce("disputed", none), F.coalesce("disputes", none)))).drop("disputes")


#: The step that each payload is scored on, and how like its values must be.
SCORED_STEPS = {"audit": ("normalise", 0.85), "letter": ("obligations", 1.0), "comparison": ("policy-terms", 1.0)}


def score_fixtures(expected: DataFrame, actual: DataFrame, steps: Mapping[str, tuple[str, float]] = SCORED_STEPS) -> DataFrame:
    """(fixture, payload, step, correct, expected, end_to_end) of each fixture, in the
    vocabulary of its payload.

    ``expected`` and ``actual`` (fixture, payload, key, value, seq) are what was authored and
    answered: merchants' names for an audit, obligations for a letter, terms for a
    comparison. Of a key that is answered twice the first answer counts. ``correct`` are
    the expected keys whose answer is like it (exactly, or by similarity, as the payload
    says); a fixture that says nothing of its step has no step score (null), since nothing
    was measured. ``end_to_end`` is the F1 of correct answers over all keys on both sides, 1
    where both are empty. Null keys count on neither side.
    """
    kinds = [F.col("payload") == p for p in steps]
    of = lambda i: reduce(lambda c, x: F.when(x[0], x[1][i]).otherwise(c), zip(kinds, steps.values()), F.lit(None))
    first = actual.where("key IS NOT NULL").groupBy("fixture", "payload", "key").agg(F.min_by(F.struct("value"), "seq").alias("said"))
    wanted = expected.where("key IS NOT NULL").groupBy("fixture", "payload", "key").agg(F.min_by(F.struct("value"), "seq").alias("want"))
    both = wanted.join(first, ["fixture", "payload", "key"], "full_outer").withColumn("least", of(1))
    same = F.col("want.value").eqNullSafe(F.col("said.value"))
    near = F.when(F.col("least") < 1, S.similarity(F.col("want.value"), F.col("said.value")) >= F.col("least"))
    right = F.col("want").isNotNull() & F.col("said").isNotNull() & (same | F.coalesce(near, F.lit(False)))
    told = both.groupBy("fixture", "payload").agg(F.count_if(right).alias("correct"), F.count_if(F.col("want").isNotNull()).alias("expected"), F.count_if(F.col("said").isNotNull()).alias("said"))
    every = expected.select("fixture", "payload").unionByName(actual.select("fixture", "payload")).distinct()
    rows = every.join(told, ["fixture", "payload"], "left").na.fill(0, ["correct", "expected", "said"])
    measured = F.col("expected") > 0
    f1 = F.when(F.col("expected") + F.col("said") == 0, 1.0).otherwise(2 * F.col("correct") / (F.col("expected") + F.col("said")))
    return rows.select("fixture", "payload", F.when(measured, of(0)).alias("step"), F.when(measured, F.col("correct")).alias("correct"), "expected", f1.alias("end_to_end"))


def is_wrong(kind: Column, expected: Column, actual: Column, outcome: Column, same: Column) -> Column:
    """An assertion that says something else: a wrong class, a found nothing, a missed something."""
    asserted = F.when(kind == "classification", expected != actual).when(outcome == "found", expected.isNull() | ~F.coalesce(same, F.lit(False))).otherwise(expected.isNotNull())
    return F.when(outcome == "review", F.lit(False)).otherwise(F.coalesce(asserted, F.lit(True)))


def is_safe(expected_review: Column, expected: Column, actual: Column, outcome: Column) -> Column:
    """Right, or surfaced to a person; an expected referral that was asserted is neither."""
    right = F.when(outcome == "found", F.coalesce(expected == actual, F.lit(False))).otherwise(expected.isNull())
    return F.when(outcome == "review", True).when(expected_review, False).otherwise(right)


def same_obligation(a: Column, b: Column) -> Column:
    """Anchors agree by the date that they name, all else exactly."""
    exact = (a["kind"] == b["kind"]) & (a["party"] == b["party"]) & (a["deadline"] == b["deadline"]) & a["due"].eqNullSafe(b["due"])
    return exact & D.first_full_date(a["anchor"]).eqNullSafe(D.first_full_date(b["anchor"]))


def same_term(a: Column, b: Column) -> Column:
    return (a["term"] == b["term"]) & (a["basis"] == b["basis"]) & (a["value"] == b["value"]) & (quote_in(a["quote"], b["quote"]) | quote_in(b["quote"], a["quote"]))


def obligation_key(kind: Column, party: Column, deadline: Column, due: Column) -> Column:
    return F.concat_ws("|", kind, F.lower(party), F.coalesce(due.cast("string"), F.concat(F.lit("undated:"), deadline)))


def term_key(document: Column, term: Column, basis: Column, value: Column) -> Column:
    return F.concat_ws("|", F.coalesce(document.cast("string"), F.lit("-")), term, basis, value)


def derived(op: Column, start: Column, days: Column) -> Column:
    return F.when(op == "add_days", F.date_add(start, days)).when(op == "end_of_month", F.last_day(start)).when(op == "identity", start)


def evidence(found: DataFrame) -> DataFrame:
    """Pass or fail of four dimensions per claim.

    ``found`` has source, quote, authored_passage, claim and expected (the fields that
    must agree), due, op, op_from, op_days. Existence: the quote is in the source.
    Attribution: it is the authored passage. Support: the claim is the authored one.
    Derivation: the due date is what the authored operation gives.
    """
    told = lambda c: F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail")
    return found.withColumns(
        {
            "existence": told(quote_in(F.col("quote"), F.col("source"))),
            "attribution": told(X.squash(F.col("quote")) == X.squash(F.col("authored_passage"))),
            "support": told(F.col("claim") == F.col("expected")),
            "derivation": F.when(F.col("op").isNotNull(), told(F.col("due") == derived(F.col("op"), F.col("op_from"), F.col("op_days")))),
        }
    )


def complete(quote: Column, qualifiers: Column) -> Column:
    return F.forall(qualifiers, lambda q: quote_in(q, quote))


def review_rate(items: DataFrame, key: str, *groups: str) -> DataFrame:
    """Distinct keys that are unsure or went to review, of all distinct keys."""
    unsure = (F.col("confidence") == "low") | F.col("reviewed")
    told = items.groupBy(*groups).agg(F.countDistinct(key).alias("n"), F.countDistinct(F.when(unsure, F.col(key))).alias("unsure"))
    return told.withColumn("rate", F.when(F.col("n") > 0, F.col("unsure") / F.col("n")).otherwise(0.0))


def tiers(fixture_steps: DataFrame, *keys: str) -> DataFrame:
    """The worst of all fixtures: lowest step and end-to-end, most reviews, longest time."""
    return fixture_steps.groupBy(*keys).agg(F.min_by("step", F.struct("score", "step")).alias("worst_step"), F.min("score").alias("worst_score"), (1 - F.max("review_rate")).alias("automatic"), F.min("end_to_end").alias("end_to_end"), F.max("wall_ms").alias("wall_ms"))


def enough_decisions(fixtures: DataFrame, bar: float) -> DataFrame:
    """Whether the upper median of decisions per fixture reaches ceil(1 / (1 - bar))."""
    import math

    ranked = fixtures.withColumn("k", F.row_number().over(Window.orderBy("decisions"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    needed = math.ceil(round(1 / (1 - bar), 9))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select(F.col("decisions").alias("median"), F.lit(needed).alias("needed"), (F.col("decisions") >= needed).alias("fits"))


def select_set(fixtures: DataFrame, eval_set: str, audition: list[str] | None = None) -> DataFrame:
    """Fixtures of a set; an audition takes declared names, none missing and none of the exam."""
    if eval_set != "audition":
        return fixtures.where(F.col("eval_set") == eval_set)
    named = fixtures.where(F.col("name").isin(audition or []))
    found = {r["name"]: r["eval_set"] for r in named.select("name", "eval_set").collect()}  # as many as were declared
    if missing := set(audition or []) - set(found):
        raise ValueError(f"no fixture is called {sorted(missing)}")
    if exam := [n for n, s in found.items() if s == "exam"]:
        raise ValueError(f"{exam} are of the exam")
    return named


def first_hosts(named: DataFrame, shapes: DataFrame) -> DataFrame:
    """(shape, host): for each shape the first fixture by name that is of it."""
    return named.join(shapes, F.startswith(F.col("name"), F.concat("prefix", F.lit("-")))).groupBy("shape").agg(F.min("name").alias("host"))


def paired_files(paths: DataFrame) -> DataFrame:
    """(stem, role, input, expected) of a folder's files (path).

    ``<stem>.expected.json`` belongs to ``<stem>.<extension>``, or to
    ``<stem>.<role>.<extension>`` for each of several roles. Inputs without an expectation
    have null there, and the other way round.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.select("path", name.alias("name"), F.concat(F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)))"), F.substring_index(name, ".", 1)).alias("stem"))
    wanted = rows.where(F.endswith("name", F.lit(".expected.json"))).select("stem", F.col("path").alias("expected"))
    middle = F.split("name", r"\.")
    given = rows.where(~F.endswith("name", F.lit(".expected.json"))).select("stem", F.when(F.size(middle) > 2, middle[1]).alias("role"), F.col("path").alias("input"))
    return given.join(wanted, "stem", "full_outer").select("stem", "role", "input", "expected")


def truthful_answers(items: DataFrame, expected: DataFrame) -> DataFrame:
    """What a model that is always right would answer: each item (id, passage) with the
    authored truth of its passage, and nothing where nobody authored any."""
    none = F.array().cast(dict(expected.dtypes)["claims"])
    key = lambda df: df.withColumn("key", X.passage_key(F.col("passage")))
    truth = key(expected).groupBy("key").agg(F.min_by("claims", "seq").alias("claims"))
    told = key(items).join(truth, "key", "left")
    return told.select("id", F.col("passage").alias("echo"), F.coalesce("claims", none).alias("claims"), F.lit("high").alias("confidence"))
