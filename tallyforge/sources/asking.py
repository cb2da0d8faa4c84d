"""Asking a source of answers in batches: retries, halving, pairing, checks.

The source is any callable from a prompt and a schema to text; nothing here opens a
connection. It runs inside a partition (``asked``), so a slow source is slow per task.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.answers import batched

Source = Callable[[str, dict], str]


class Truncated(ValueError):
    """The answer was cut off."""


@dataclass
class Outcome:
    answers: dict[int, dict] = field(default_factory=dict)
    review: dict[int, str] = field(default_factory=dict)
    calls: int = 0


def render(template: str, items: dict[int, str], examples: str = "") -> str:
    if "{items}" not in template:
        raise ValueError("the template has no {items}")
    listed = "\n".join(json.dumps({"id": i, "text": t}, ensure_ascii=False) for i, t in items.items())
    return template.replace("{examples}", examples).replace("{items}", listed)


def valid(schema: dict, value: Any) -> bool:
    """Against the five words that answers' schemas use."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    if "type" in schema and (not isinstance(value, kinds[schema["type"]]) or (schema["type"] in ("number", "integer") and isinstance(value, bool))):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        return all(k in value for k in schema.get("required", [])) and all(valid(s, value[k]) for k, s in schema.get("properties", {}).items() if k in value)
    if isinstance(value, list) and "items" in schema:
        return all(valid(schema["items"], v) for v in value)
    return True


def pairs(echo: str, text: str, others: list[str]) -> bool:
    return echo == text or (echo != "" and text.startswith(echo) and not any(o != text and o.startswith(echo) for o in others))


def ask(source: Source, template: str, schema: dict, items: dict[int, str], echo: str = "text") -> Outcome:
    """Answers of a batch: one retry of a wrong shape, halves of a cut answer, one more
    question about the items that the first answer didn't settle; the rest to review."""
    out = _once(source, template, schema, items, echo)
    again = {i: items[i] for i, why in out.review.items() if why in ("missing", "bad_echo", "duplicate_id")}
    if again and len(again) < len(items):
        second = _once(source, template, schema, again, echo)
        out.calls += second.calls
        out.answers |= second.answers
        out.review = {i: w for i, w in out.review.items() if i not in again} | second.review
    return out


def _once(source: Source, template: str, schema: dict, items: dict[int, str], echo: str) -> Outcome:
    out, parsed = Outcome(), None
    for _ in range(2):
        out.calls += 1
        try:
            parsed = json.loads(source(render(template, items), schema))
        except Truncated:
            if len(items) == 1:
                out.review = dict.fromkeys(items, "truncated")
                return out
            keys = list(items)
            for half in (keys[: len(keys) // 2], keys[len(keys) // 2 :]):
                part = _once(source, template, schema, {i: items[i] for i in half}, echo)
                out.calls += part.calls
                out.answers |= part.answers
                out.review |= part.review
            return out
        except ValueError:
            parsed = None
        if parsed is not None and valid(schema, parsed):
            break
        parsed = None
    if parsed is None:
        out.review = dict.fromkeys(items, "bad_shape")
        return out
    found: dict[int, list[dict]] = {}
    for answer in parsed.get("results", []):
        found.setdefault(answer.get("id"), []).append(answer)
    for i, text in items.items():
        given = found.get(i, [])
        if len(given) != 1:
            out.review[i] = "missing" if not given else "duplicate_id"
        elif not pairs(str(given[0].get(echo, "")), text, list(items.values())):
            out.review[i] = "bad_echo"
        else:
            out.answers[i] = given[0]
    return out


def asked(items: DataFrame, source: Source, template: str, schema: dict, size: int = 8) -> DataFrame:
    """(id, text, answer as JSON, review) of items (id, text), ``size`` at a time.

    Which items are asked together follows from their ids alone, so a rerun, or another
    partitioning, asks the same batches: ids are dealt to buckets by a hash, and a bucket
    is cut into batches in the order of ids.
    """
    n = items.count()
    bucket = F.pmod(F.xxhash64("id"), F.lit(max(1, n // (64 * size)))).cast("int")
    # answers come back by id, so rows that share one are never asked together
    again = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    dealt = items.select("id", "text").withColumn("bucket", F.struct(bucket.alias("at"), again.alias("again")))
    rows = batched(dealt, size, "bucket", "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values("id", kind="stable")
        got = ask(source, template, schema, dict(zip(part["id"].tolist(), part["text"])))
        done = part.assign(answer=[json.dumps(got.answers[i]) if i in got.answers else None for i in part["id"]], review=[got.review.get(i) for i in part["id"]])
        return done[["id", "text", "answer", "review"]]

    return rows.groupBy("bucket", "batch").applyInPandas(run, "id long, text string, answer string, review string")
