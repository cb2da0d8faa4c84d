"""Periodic runs against a plain search of all periods, the query against SQL's islands."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import periodic
from tallyforge.llm import queries as llm

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def runs_of(words: list[str], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    data = " ".join(words).encode()
    buf = np.frombuffer(data, np.uint8)
    return [tuple(x) for x in periodic.text_runs(buf, np.array([0, len(data)]), least, times)[4].tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=8), st.integers(3, 24), st.integers(3, 4))
def test_as_brute_force(parts, least, times):
    words = [w for root, again in parts for w in root * again]
    assert runs_of(words, least, times) == periodic.brute_force(words, least, times)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_long_texts_of_few_words(letters):
    rng = random.Random(letters)
    words = []
    while len(words) < 4000:
        root = [rng.choice("abc"[:letters]) for _ in range(rng.randint(1, 60))]
        words += root * rng.randint(1, 12)
    assert runs_of(words) == periodic.brute_force(words)


def test_words_on_which_sums_modulo_a_power_of_two_fail():
    word = [bin(i).count("1") % 2 for i in range(1 << 12)]  # has no cube
    words = ["ab"[x] for x in word]
    assert runs_of(words) == periodic.brute_force(words) == []
    tripled = words[:512] * 3
    assert runs_of(tripled) == periodic.brute_force(tripled) == [(0, 1536, 512)]


def test_lyndon_words_are_the_longest():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 3, 200)
    for reverse in (False, True):
        got = periodic.Stretch(ids).lyndon(reverse)
        key = [(-x if reverse else x) for x in ids.tolist()]
        for i in range(len(key)):
            longest = max(k for k in range(1, len(key) - i + 1) if all(key[i : i + k] < key[i + d : i + k] for d in range(1, k)))
            assert got[i] == longest


def test_runs_touch_no_other_row():
    data = b"".join([b"x y " * 12, b"x y " * 4, b"", b"x y " * 30])
    offsets = np.array([0, 48, 64, 64, 184])
    assert [(int(r), *map(int, x)) for r, x in zip(*periodic.text_runs(np.frombuffer(data, np.uint8), offsets)[3:])] == [(0, 0, 24, 2), (3, 0, 60, 2)]


def test_texts_of_all_kinds(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, " \t\n", "k"), (4, "one", "k"), (5, "a b " * 20, "k"), (5, "a b " * 20, "k"), (None, "c " * 30, None), (6, "a b c " * 12, "k")]
    found = periodic.find(spark.createDataFrame(rows, "doc_id long, text string, runs string"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in found.collect()), key=repr)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "one"), (5, 40, [(0, 40, 2)], "a b"), (5, 40, [(0, 40, 2)], "a b"), (None, 30, [(0, 30, 1)], "c"), (6, 24, [(0, 24, 2)], "a b c")]
    assert got == sorted(want, key=repr)
    empty = periodic.digest(periodic.find(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.columns == COLUMNS and empty.count() == 0
    with pytest.raises(ValueError):
        periodic.find(found, times=2)


def plain_row(doc_id: int, text: str | None) -> tuple:
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = periodic.brute_force(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_as_plain_python_and_sql(spark, sf_dir):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in llm.op11_periodic(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    short = con.execute("SELECT doc_id, text FROM documents WHERE n_chars < 4000").fetchall()
    assert len(short) > 100
    by_id = {r[0]: r for r in got}
    assert all(by_id[i] == plain_row(i, t) for i, t in short)
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({periodic.oracle_sql()})").fetchall())
    assert sum(r[1] > 0 for r in got) > 10
