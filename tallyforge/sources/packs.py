"""Declared pipelines: loading, checking, and binding files to their roles."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.files import whole_texts
from tallyforge.sources.runs import staged

# The names that a pack's steps and schemas may use.
PREPROCESS = ("merchant-cleanup", "segment")
AGGREGATE = ("recurrence-detect", "timeline-sort", "term-diff")
ROLES = ("normalise", "classify", "obligations", "policy-terms")
STEPS = ("preprocess", "model", "aggregate", "render")
SCHEMA_WORDS = {"type", "properties", "required", "items", "enum"}


class PackError(ValueError):
    """A pack that can't be run, and why."""


@dataclass(frozen=True)
class InputRole:
    name: str
    least: int = 1
    most: int | None = 1
    kinds: tuple[str, ...] = ("csv",)

    def permits(self, given: int) -> bool:
        return given >= self.least and (self.most is None or given <= self.most)


@dataclass(frozen=True)
class Pack:
    id: str
    version: str
    inputs: tuple[InputRole, ...]
    steps: tuple[dict, ...]
    kinds: Mapping[str, str] = field(default_factory=dict)


def is_contained(relative: str) -> bool:
    """A relative path that never leaves its folder."""
    path = PurePosixPath(relative)
    return not path.is_absolute() and ".." not in path.parts and relative != "" and "\\" not in relative


def grammar_safe(schema: Any, at: str = "schema") -> None:
    """Only the five words that a constrained decoder takes, at every depth."""
    if not isinstance(schema, Mapping):
        raise PackError(f"{at} isn't an object")
    if extra := set(schema) - SCHEMA_WORDS:
        raise PackError(f"{at} uses {sorted(extra)}")
    for name, inner in schema.get("properties", {}).items():
        grammar_safe(inner, f"{at}.{name}")
    if "items" in schema:
        grammar_safe(schema["items"], f"{at}[]")


def authored_id(value: str) -> bool:
    return re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+){2,}", value) is not None


def authored(value: Column) -> Column:
    """``authored_id`` as an expression."""
    return value.rlike(r"^[a-z0-9]+(-[a-z0-9]+){2,}$")


def contained(relative: Column) -> Column:
    """``is_contained`` as an expression."""
    return (relative != "") & ~relative.startswith("/") & ~F.contains(relative, F.lit("\\")) & ~F.array_contains(F.split(relative, "/"), "..")


def checked_step(step: Mapping[str, Any]) -> None:
    """Refuses a step of a kind or name that there isn't."""
    kind = step.get("kind")
    if kind == "wasm":
        raise PackError("sandboxed steps are always refused")
    if kind not in STEPS:
        raise PackError(f"no step is of kind {kind!r}")
    allowed = {"preprocess": PREPROCESS, "aggregate": AGGREGATE, "model": ROLES}.get(kind)
    if allowed and step.get("name") not in allowed:
        raise PackError(f"{kind} has no {step.get('name')!r}")


def parsed(text: str, has_file: Callable[[str], bool]) -> Pack:
    """The pack that a ``pack.json`` describes, or PackError for anything undeclared, missing
    or uncontained; ``has_file`` tells whether the pack's folder holds a file."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise PackError(f"pack.json can't be read: {e}") from e
    if not isinstance(raw, Mapping) or "id" not in raw or "version" not in raw:
        raise PackError("a pack needs an id and a version")
    if extra := set(raw) - {"id", "version", "inputs", "steps", "kinds"}:
        raise PackError(f"unknown fields {sorted(extra)}")
    inputs = tuple(InputRole(r["name"], r.get("least", 1), r.get("most", 1), tuple(r.get("kinds", ["csv"]))) for r in raw.get("inputs", []))
    if not inputs or len({r.name for r in inputs}) < len(inputs):
        raise PackError("inputs need different names, one at least")
    for step in raw.get("steps", []):
        checked_step(step)
        for file in step.get("files", {}).values():
            if not is_contained(file) or not has_file(file):
                raise PackError(f"{file!r} isn't a file of the pack")
        if "schema" in step:
            grammar_safe(step["schema"])
    if any(s.get("name") == "term-diff" for s in raw.get("steps", [])) and (len(inputs) < 2 or any((r.least, r.most) != (1, 1) for r in inputs[:2])):
        raise PackError("a comparison needs two roles of exactly one file")
    return Pack(raw["id"], raw["version"], inputs, tuple(raw.get("steps", [])), raw.get("kinds", {}))


def load(folder: str | Path) -> Pack:
    """The pack in a folder."""
    folder = Path(folder)
    try:
        text = (folder / "pack.json").read_text()
    except OSError as e:
        raise PackError(f"pack.json can't be read: {e}") from e
    return parsed(text, lambda file: (folder / file).is_file())


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(folder, id, version, roles, steps, error) of every folder with a ``pack.json`` below
    ``root``; a pack that is refused has its error alone. Files of a pack are those below
    its folder; the manifests are read where they lie, a task for many."""
    raw = staged(whole_texts(spark, root), "pack-files")  # each file is opened once
    manifests = raw.where("path LIKE '%/pack.json'").select(F.regexp_replace("path", "/pack[.]json$", "").alias("folder"), F.col("value").alias("text"))
    # each file below any folder above it, so that packs meet their own files in an equi-join
    files = raw.select("path", F.split("path", "/").alias("parts"))
    files = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("folder"))
    held = manifests.join(files, "folder").groupBy("folder", "text").agg(F.collect_set(F.expr("substring(path, length(folder) + 2)")).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, names in zip(batch.column("text").to_pylist(), batch.column("files").to_pylist()):
                try:
                    pack = parsed(text, set(names).__contains__)
                    rows.append((pack.id, pack.version, len(pack.inputs), len(pack.steps), None))
                except PackError as e:
                    rows.append((None, None, None, None, str(e)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([batch.column("folder"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["folder", "id", "version", "roles", "steps", "error"])

    return held.mapInArrow(run, "folder string, id string, version string, roles int, steps int, error string")


def bind(pack: Pack, given: Mapping[str, list[str]]) -> list[tuple[str, str]]:
    """(role, path) in declared order; refuses unknown, too few, too many, wrong kinds."""
    declared = {r.name: r for r in pack.inputs}
    if unknown := set(given) - set(declared):
        raise PackError(f"no role is called {sorted(unknown)}")
    out = []
    for role in pack.inputs:
        paths = given.get(role.name, [])
        if not role.permits(len(paths)):
            raise PackError(f"{role.name} was given {len(paths)} files")
        for path in paths:
            if path.rsplit(".", 1)[-1].lower() not in role.kinds:
                raise PackError(f"{role.name} doesn't take {path}")
            out.append((role.name, path))
    return out


def bind_sole(pack: Pack, paths: list[str]) -> list[tuple[str, str]]:
    if len(pack.inputs) != 1:
        raise PackError("a list of files needs a pack with one role")
    return bind(pack, {pack.inputs[0].name: paths})
