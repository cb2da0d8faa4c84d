"""Secrets: base patterns against plain ones, links against every pair of parts, SQL."""

import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import queries as llm
from tallyforge.llm import secrets

KEY = "AKIA" + "Q7" * 8
OPAQUE = "Zx81pQ+wE/rT55yUiOpAsDfG"
COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"]


def plain_base(text: str) -> list[tuple[int, int, int]]:
    name = r"(?:(?i:password|passwd|secret|token|api_?key))"
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""{name}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


PIECES = ["token", "Password", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "abc", "AKIA", "A1" * 8, "0123456789abcdef", "é", "\n", "\n\n", "x.y@mail.example.com", "https://h.example.com/p", OPAQUE, "-", "ſecret=abcdefg", "漢"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=4))
def test_base_spans_as_plain_patterns(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    got = secrets.spans_of(np.frombuffer(b"".join(data), np.uint8), offsets)
    for row, text in enumerate(texts):
        own = [tuple(x) for x in got[(got[:, 0] == row) & (got[:, 3] < secrets.STRONG)][:, 2:].tolist()]
        assert own == plain_base(text)


def linked(spark, texts: list[str | None]) -> list[str]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.spans for r in secrets.digest(secrets.find(docs)).orderBy("doc_id").collect()]


def test_weak_parts_only_beside_complementary_ones(spark):
    gap, mail, at = " " * 300, "ann@mail.example.com", "https://s3.example.com/x"
    got = linked(
        spark,
        [
            mail,  # 0: nothing to log in with
            f"{mail} token=abcdef",  # 1
            f"{mail}{gap}token=abcdef",  # 2: too far
            f"{mail}\n \ntoken=abcdef",  # 3: another scope
            f"{OPAQUE} {KEY}",  # 4
            f"{OPAQUE} {mail}",  # 5: both weak
            f"{OPAQUE} {mail} {at}",  # 6: all three
            at,  # 7
            f"{at} {KEY}",  # 8: no secret
            f"{at} {KEY} password: hunter22",  # 9
            f"{at} {KEY} {OPAQUE}",  # 10
            None,  # 11
        ],
    )
    assert got == [
        "",
        "login:0:20,assign:21:33",
        "assign:320:332",
        "assign:23:35",
        f"opaque:0:24,access:25:{25 + len(KEY)}",
        "",
        "opaque:0:24,login:25:45,endpoint:46:70",
        "",
        f"access:25:{25 + len(KEY)}",
        f"endpoint:0:24,access:25:{25 + len(KEY)},assign:{26 + len(KEY)}:{44 + len(KEY)}",
        f"endpoint:0:24,access:25:{25 + len(KEY)},opaque:{26 + len(KEY)}:{50 + len(KEY)}",
        "",
    ]


def test_bins_as_every_pair(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        parts = rng.choice([f"{KEY}", OPAQUE, "bo@mail.example.com", "https://h.example.com", "secret=abcdef", "\n\n"], rng.integers(2, 14))
        texts.append("".join(f"{p}{' ' * int(rng.integers(1, 200))}" for p in parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in secrets.digest(secrets.find(docs)).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({secrets.oracle_sql()})").fetchall()}
    assert got == want
    assert sum(r[4] for r in got.values()) > 50


def test_many_parts_of_one_text_stay_linear(spark):
    text = f"bo@mail.example.com {OPAQUE} " * 5000 + KEY
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secrets.find(docs).first()
    assert len(found.base) == 1
    near = len(text) - len(KEY) - secrets.REACH
    assert [s["start"] for s in found.spans[:-1]] == [i for i in range(20, len(text) - len(KEY), 45) if i >= near]


def test_rows_of_all_kinds(spark):
    rows = [(1, "token=abcdef", 1), (1, "token=abcdef", 2), (1, "a@b.example.com token=abcdef", 3), (None, "token=abcdef", 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r.doc_id, r.n_assign, r.spans) for r in secrets.digest(secrets.find(docs)).collect()), key=repr)
    assert got == sorted([(1, 1, "assign:0:12"), (1, 1, "assign:0:12"), (1, 1, "login:0:15,assign:16:28"), (None, 1, "assign:0:12"), (None, 0, "")], key=repr)
    empty = secrets.digest(secrets.find(docs.limit(0)))
    assert sorted(empty.columns) == sorted(COLUMNS) and empty.count() == 0
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns
    assert {r.spans: r.text for r in clean.collect()} == {1: "[secret]", 2: "[secret]", 3: "[secret] [secret]", 4: "[secret]", 5: None}


def test_overlapping_spans_go_under_one_mark(spark):
    text = 'é token = "' + "0a" * 12 + '" é'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redacted(docs).first().text == 'é [secret]" é'


def test_query_as_sql(spark, sf_dir):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in llm.op12_secrets(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({secrets.oracle_sql()})").fetchall())
