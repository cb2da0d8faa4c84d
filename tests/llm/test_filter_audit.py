"""The audit against every order followed row by row, and against SQL."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import filter_audit
from tallyforge.llm import queries as llm

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def followed(rows: list[tuple], filters: str) -> dict[tuple, tuple]:
    """part, fails, good, toxic of each row through all orders."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys(filters, 0)
        for order in map("".join, itertools.permutations(filters)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in own)
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), cells in out.items():
            if p == part:
                cells.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("filters", ["A", "XYZ", "ABCDE"])
def test_as_rows_followed(spark, filters):
    rng = random.Random(len(filters))
    rows = [(rng.choice(["p", "q", ""]), "".join(f for f in filters if rng.random() < 0.4), rng.random() < 0.3, rng.random() < 0.2) for _ in range(200)]
    frame = spark.createDataFrame([(p or None, *[f in x for f in filters], g, t) for p, x, g, t in rows], ["source", *filters, "good", "toxic"])
    got = filter_audit.audit(frame, "source", list(filters), {"good_lost": "good", "toxic_lost": "toxic"}).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == followed(rows, filters)


def test_null_flags_pass_and_empty_tables_give_nothing(spark):
    frame = spark.createDataFrame([("s", None, True, 1), ("s", True, None, 2)], "kept string, A boolean, B boolean, step int")
    got = {(r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(frame, "kept", ["A", "B"]).collect()}
    assert got == {("AB", 1): (1, 1, 0, 1, 2), ("AB", 2): (0, 1, 0, 1, 2), ("BA", 1): (1, 1, 0, 1, 2), ("BA", 2): (0, 1, 0, 1, 2)}
    assert filter_audit.audit(frame.limit(0), "kept", ["A", "B"]).count() == 0
    for wrong in ([], ["A", "A"], ["AB"], list("ABCDEFG")):
        with pytest.raises(ValueError):
            filter_audit.audit(frame, "kept", wrong)


def test_text_filters_on_texts_of_all_kinds(spark):
    many = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, many, "s", 0), (2, many, None, 0), (2, many, "t", 0), (3, many + " x", "s", 0),  # one word less by other spaces
        (4, None, "s", 0), (5, "", "s", 0), (6, "a a a a a", "s", 0), (7, "ABC", "s", 0), (8, "x | y", "s", 0), (None, many, "s", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words int")
    got = filter_audit.text_failures(docs)
    assert got.columns == ["doc_id", "source", "words", "A", "B", "C", "D", "E"]
    fails = sorted(((r.doc_id, "".join(f for f in "ABCDE" if r[f])) for r in got.collect()), key=repr)
    assert fails == sorted([(1, ""), (2, "E"), (2, "E"), (3, ""), (4, "A"), (5, "AE"), (6, "AB"), (7, "AC"), (8, "AD"), (None, "E")], key=repr)


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(1, "s"), (1, "s"), (None, "s"), (2, "s")], "doc_id long, source string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.labelled(docs, labels, {"good": "quality", "toxic": "toxic"})
    assert sorted(map(tuple, got.select("doc_id", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))).collect()), key=repr) == sorted([(1, True, False), (1, True, False), (None, False, False), (2, False, True)], key=repr)


def test_query_as_sql(spark, sf_dir):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in llm.op13_filter_audit(spark, sf_dir).collect())
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({filter_audit.oracle_sql()})").fetchall())
