"""Running a pack: its steps in order, each from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import answers, audit, cadence, merchants, passages, terms, timeline
from tallyforge.sources.packs import Pack, PackError

Tables = dict[str, DataFrame]
Step = Callable[[Tables, dict], Tables]


def _cleanup(t: Tables, step: dict) -> Tables:
    return {"payments": merchants.grouped(t["payments"]), "groups": merchants.merchant_groups(t["payments"])}


def _segment(t: Tables, step: dict) -> Tables:
    return {"segments": passages.passages(t["documents"])}


def _model(t: Tables, step: dict) -> Tables:
    """Recorded answers are tables given under the step's name; without any, the floor."""
    if step["name"] in t:
        return {}
    if step["name"] in ("normalise", "classify"):
        return {step["name"]: answers.floor(t["groups"])}
    return {"review": t["segments"].withColumn("review", F.lit("no_model"))}


def _recurrence(t: Tables, step: dict) -> Tables:
    rows = t["payments"]
    if "account" not in rows.columns:
        rows = rows.withColumn("account", F.lit("all"))
    found = audit.findings(cadence.series(rows, "debit"))
    return {"findings": found, "income": cadence.series(rows, "credit"), "spend": spend(rows, found)}


def spend(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Regular spend of an account's merchants that have a debit and no series."""
    keys = ["account", "merchant"]
    paid = rows.where("direction = 'debit'").select(*keys).distinct()
    eligible = paid.join(found.select(*keys).distinct(), keys, "left_anti")
    return audit.regular_spend(rows.join(eligible, keys, "left_semi"), *keys)


def _timeline(t: Tables, step: dict) -> Tables:
    if "obligations" not in t:
        return {}
    return {"timeline": timeline.ordered(timeline.merged(timeline.dated(t["obligations"], t["segments"])))}


def _diff(t: Tables, step: dict) -> Tables:
    if "policy-terms" not in t:
        return {}
    rows, refused = terms.compare(t["policy-terms"], step.get("before", 0), step.get("after", 1), t.get("families"))
    return {"differences": rows, "not_compared": refused}


STEPS: dict[tuple[str, str | None], Step] = {
    ("preprocess", "merchant-cleanup"): _cleanup,
    ("preprocess", "segment"): _segment,
    ("aggregate", "recurrence-detect"): _recurrence,
    ("aggregate", "timeline-sort"): _timeline,
    ("aggregate", "term-diff"): _diff,
}


def run(pack: Pack, inputs: Tables) -> Tables:
    """All tables of a run, inputs included. Nothing is computed until one is read."""
    tables = dict(inputs)
    for step in pack.steps:
        if step["kind"] == "render":
            continue
        if step["kind"] == "model":
            tables |= _model(tables, step)
            continue
        known = STEPS.get((step["kind"], step.get("name")))
        if known is None:
            raise PackError(f"no step {step}")
        tables |= known(tables, step)
    return tables


def plan(pack: Pack, items: int, cached: bool, size: int = 8) -> list[str]:
    """What a run would do, a line a step."""
    if cached:
        return ["the result is cached"]
    lines = []
    for step in pack.steps:
        name = f"{step['kind']} {step.get('name', '')}".strip()
        lines.append(f"{name}: {-(-items // step.get('batch', size))} batches of {items} items" if step["kind"] == "model" else name)
    return lines
