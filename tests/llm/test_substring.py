import random

import numpy as np
import pytest

from tallyforge.llm import substring


def _check(spark, texts, window=35):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = substring.brute_force(texts, window)
    got = substring.parse(docs, window).select("doc_id", "n_words", "n_removed", substring.sha256_of("kept").alias("k")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, r.k) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("seed", range(3))
def test_made_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.choice([33, 34, 35, 36, 50, 90]))] for _ in range(6)]
    texts = {}
    for d in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [word() for _ in range(rng.randrange(0, 60))]
            p = rng.choice(passages)
            a = rng.randrange(0, 10) if rng.random() < 0.4 else 0
            parts += p[a : len(p) - (rng.randrange(0, 10) if rng.random() < 0.4 else 0)]
        texts[d] = rng.choice([" ", "\n", "\t "]).join(parts)
    texts[100], texts[101] = None, ""
    texts[102] = "again and " * 80
    texts[103] = "one " * 36
    texts[104] = texts[0]
    _check(spark, texts)


def test_shipped_documents(spark, sf_dir):
    _check(spark, {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})


@pytest.mark.parametrize("window", [1, 2, 5, 9, 10, 12])
def test_other_windows(spark, window):
    base = " ".join(f"v{i}" for i in range(120))
    _check(spark, {1: base, 2: "x y z " + base[: len(base) // 2], 3: "nothing alike", 4: "x y x y x", 5: None}, window=window)


def test_windows_out_of_bounds_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for window in (0, substring.WIDEST + 1):
        with pytest.raises(ValueError, match="words"):
            substring.parse(docs, window)
    assert substring.parse(docs, substring.WIDEST).first().n_removed == 0


def test_what_goes_are_the_factors_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in substring.parse(docs).collect():
        covered = {w for f in r.factors for w in range(f.start, f.start + f.words)}
        assert len(covered) == r.n_removed and len(r.factors) == r.n_factors
        assert all(f.words >= 35 for f in r.factors)


def test_greedy_factors():
    a = lambda *x: np.array(x)
    # row 0: two blocks that go on in reference 7, then a window of reference 8; row 1: a gap
    got = substring.greedy(a(0, 0, 0, 1, 1), a(2, 5, 8, 0, 9), a(3, 3, 1, 2, 1), a(7, 7, 8, 7, 7), a(12, 15, 40, 10, 19))
    assert [x.tolist() for x in got] == [[0, 0, 1, 1], [2, 8, 0, 9], [6, 1, 2, 1], [7, 8, 7, 7], [12, 40, 10, 19]]
    # of two references the one that goes on longer; what the first factor holds isn't begun again
    got = substring.greedy(a(0, 0, 0, 0), a(0, 0, 3, 4), a(3, 4, 3, 5), a(1, 2, 1, 3), a(9, 5, 12, 70))
    assert [x.tolist() for x in got] == [[0, 0], [0, 6], [6, 3], [1, 3], [9, 72]]


def plain_factors(texts: dict[int, str], window: int) -> dict[int, list[tuple[int, int]]]:
    """Start and words of the greedy parse, by comparing with every other place of every text."""
    words = {i: t.split() for i, t in texts.items()}
    places = {}
    for i, w in words.items():
        for j in range(len(w) - window + 1):
            places.setdefault(tuple(w[j : j + window]), []).append((i, j))
    out = {}
    for i, w in words.items():
        out[i], at = [], 0
        while at + window <= len(w):
            longest = 0
            for k, j in places[tuple(w[at : at + window])]:
                if (k, j) != (i, at):
                    n = window
                    while at + n < len(w) and j + n < len(words[k]) and words[k][j + n] == w[at + n]:
                        n += 1
                    longest = max(longest, n)
            if longest:
                out[i].append((at, longest))
            at += max(longest - window, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_factors_as_a_plain_parse_of_passages_at_two_places(spark, seed):
    rng = random.Random(seed)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    docs = {i: [] for i in range(24)}
    for _ in range(40):  # each passage, or cuts of it, stands at two places
        passage = new(rng.choice([9, 12, 14, 20, 40]))
        for i in rng.sample(sorted(docs), 2):
            a = rng.choice([0, 0, 1, 3])
            docs[i] += [*new(rng.choice([0, 0, 1, 5])), *passage[a : len(passage) - rng.choice([0, 0, 2])]]
    texts = {i: " ".join(w) for i, w in docs.items()}
    got = substring.parse(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 12).collect()
    want = plain_factors(texts, 12)
    assert {r.doc_id: [(f.start, f.words) for f in r.factors] for r in got} == want
    assert sum(map(len, want.values())) > 30


def test_factors_stand_elsewhere_word_by_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    seen = 0
    for r in substring.parse(docs).collect():
        for f in r.factors:
            own, other = words[r.doc_id][f.start : f.start + f.words], words[f.ref][f.ref_start : f.ref_start + f.words]
            assert own == other and (r.doc_id, f.start) != (f.ref, f.ref_start)
            seen += 1
    assert seen > 50


def test_rows_that_repeat_an_id_and_columns_of_any_name(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    names = ["__text", "__id", "rk", "rh", "rest", "lost", "none", "blank", "spans"]
    rows = [(1, "a b " + shared, *names), (1, shared + " c", *names), (1, "other words", *names), (None, None, *names), (None, "x " + shared, *names), (None, "y", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("1", "a b"), ("1", "c"), ("1", "other words"), ("None", "None"), ("None", "x"), ("None", "y")])


def test_factors_name_their_reference(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "a b " + shared), (2, shared + " c d e")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.parse(docs).collect()}
    assert {r.n_removed for r in got.values()} == {60}
    assert sorted((f.start, f.start + f.words) for f in got[1].factors)[0][0] == 2
    assert max(f.start + f.words for f in got[1].factors) == 62
    assert got[1].text == "a b" and got[2].text == "c d e"


def test_edges_of_the_input(spark):
    long = "r " * 60
    rows = [(1, long, "x", 120), (None, "q w e", None, 5), (None, None, None, None), (2, "fine  text\nhere", "y", 15), (2, "fine  text\nhere", "y", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long").withColumnRenamed("spans", "rk")
    assert sorted(r.n_words for r in substring.parse(docs).collect()) == [0, 3, 3, 3, 60]
    cut = substring.without_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted(((str(r.doc_id), r.text, r.n_chars) for r in cut.collect()), key=str) == sorted([("None", "q w e", 5), ("None", None, None), ("2", "fine  text\nhere", 15), ("2", "fine  text\nhere", 15)], key=str)
    assert substring.parse(docs.limit(0)).count() == 0 and substring.without_repeats(docs.limit(0)).count() == 0


def test_leftmost_minimum():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 7, 26):
        got = substring._leftmost_minimum(values, width)
        assert got.tolist() == [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]
