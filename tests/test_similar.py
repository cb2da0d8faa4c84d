"""Distances of many pairs, the similarity join, and readings found in passages."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import similarity as S
from tallyforge.operators import fixtures, similar


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcé漢𝄞", max_size=12), st.text("abcé漢𝄞", max_size=12)), max_size=12))
def test_many_distances_as_one_by_one(pairs):
    assert S.distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [S.distance(a, b) for a, b in pairs]


def test_distances_in_blocks(monkeypatch):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ab", k=rng.randrange(60))), "".join(rng.choices("ab", k=rng.randrange(60)))) for _ in range(120)]
    monkeypatch.setattr(S, "CELLS", 3000)
    assert S.distances(*zip(*pairs)).tolist() == [S.distance(a, b) for a, b in pairs]


def edited(rng: random.Random, text: str) -> str:
    t = list(text)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(t))
        kind = rng.randrange(4)
        if kind == 0:
            t[i] = rng.choice("abcdefgh")
        elif kind == 1:
            t.insert(i, rng.choice("abcdefgh"))
        elif kind == 2 and len(t) > 2:
            del t[i]
        elif i + 1 < len(t):
            t[i], t[i + 1] = t[i + 1], t[i]
    return "".join(t)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 0.95, 1.0])
def test_join_as_every_pair(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 30))) for _ in range(25)]
    names = [edited(rng, rng.choice(base)) for _ in range(160)] + ["A-b & c", "a.b AND C", "", "?!", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa"]
    frame = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    key = {n: r[0] for n, r in zip(names, spark.createDataFrame([(n,) for n in names], "n string").select(S.comparison_key(F.col("n"))).collect())}
    count: dict[str, int] = {}
    for n in names:
        count[key[n]] = count.get(key[n], 0) + 1
    keys = sorted(k for k in count if k)
    want = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            most, d = max(len(a), len(b)), S.distance(a, b)
            if d <= (1 - threshold) * most + 1e-9:
                want[a, b] = (round(1 - d / most, 9), count[a], count[b])
    pairs = similar.similar_pairs(frame, "name", threshold)
    assert {(r.a, r.b): (round(r.similarity, 9), r.rows_a, r.rows_b) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert similar.similar_pairs(frame.limit(0), "name", threshold).count() == 0


def test_join_needs_a_threshold_that_grams_can_hold(spark):
    with pytest.raises(ValueError):
        similar.similar_pairs(spark.createDataFrame([("a",)], "name string"), "name", 0.5)


def test_readings_of_a_long_document_in_one_pass(spark):
    rng = random.Random(7)
    lines = [" ".join(rng.choices(["tea", "rent", "gas", "fee", "due"], k=6)) + f" {i}" for i in range(100_000)]
    passages = spark.createDataFrame([("o1", 1, "\n".join(lines), ["kept"]), ("o2", 2, "other text", []), ("o3", 1, "Tea Rent", [])], "obligation_id string, document long, passage string, disputed array<string>")
    asked = [(1, x) for x in lines] + [(1, "never there"), (1, " "), (2, "THER te"), (2, "tea"), (1, "TEARENT"), (1, "tea rent")]
    got = {r.obligation_id: r.disputed for r in fixtures.mark_disputed(passages, spark.createDataFrame(asked, "document long, read string")).collect()}
    assert got["o2"] == ["THER te"] and got["o3"] == ["TEARENT", "tea rent"]
    assert got["o1"][0] == "kept" and set(lines) < set(got["o1"]) and "never there" not in got["o1"]
