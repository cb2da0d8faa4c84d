import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import simhash
from tallyforge.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def classes(prints, distance):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    want = classes(prints, 2)
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == format(prints[r.doc_id], "016x")
        assert r.component_id == want[r.doc_id]


def test_links_of_made_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    prints = {}
    for group in range(6):
        base = int(rng.integers(0, 2**63))
        for k in range(30):
            value = base
            for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                value ^= 1 << int(bit)
            prints[group * 100 + k] = value
    nodes = sorted({v: k for k, v in reversed(prints.items())}.items(), key=lambda x: x[1])
    keys = simhash._ring_keys(np.array([v for v, _ in nodes], np.uint64), simhash.RING).view(np.int64)
    rows = [(n, [int(np.uint64(v).view(np.int64))], k.tolist()) for (v, n), k in zip(nodes, keys)]
    frame = spark.createDataFrame(rows, "node long, lanes array<long>, keys array<long>")  # keys of every class, as classes have them
    want = classes({n: v for v, n in nodes}, 2)
    for bucket in (simhash.BUCKET, 2):  # pairs of small buckets, and middle points of large ones
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {r.node: r.component for r in components(simhash.links(frame, simhash.RING)).collect()}
        assert all(got.get(n, n) == want[n] for n in want)


def test_wide_setting_finds_similar_texts_and_leaves_others(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows, near = [], []
    for d in range(40):
        text = [words[i] for i in rng.integers(0, 5000, 300)]
        rows.append((2 * d, " ".join(text)))
        for at in rng.choice(300, 4, replace=False):  # 20 of about 300 shingles: similarity 0.87
            text[at] = "changed"
        rows.append((2 * d + 1, " ".join(text)))
        near.append((2 * d, 2 * d + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.WIDE).collect()}
    assert sum(got[b] == a for a, b in near) >= 38
    assert all(got[a] == a for a, _ in near)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rows = [(i, " ".join(["same"] * 5 + [f"x{j}" for j in range(200)] + [f"own{i}"])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs, simhash.WIDE).collect()} == {0}


def shingle_set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_wide_setting_links_at_the_similarity_and_not_below(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    texts = []
    for changed in (22, 24, 26, 28, 30, 40):  # a family is one text with its end rewritten
        for _ in range(8):
            base = word(204)
            texts += [base, *(base[: 204 - changed] + word(changed) for _ in range(3))]
    for n in (7, 8, 8, 8, 8, 8, 8, 9):  # short texts: 3 of 4 shingles, 4 of 5, 5 of 6
        base = word(n)
        texts += [base, base[:-1]]
    loop, more = word(5), word(40)  # repeats count once
    texts += [loop * 30 + more, loop * 2 + more]
    texts = [" ".join(t) for t in texts]
    sets = [shingle_set(t) for t in texts]
    least = {i: i for i in range(len(texts))}
    for _ in texts:
        was = dict(least)
        for i, x in enumerate(sets):
            for j in range(max(0, i - 3), i):
                if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
        if was == least:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.WIDE).collect()} == least
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(least.values()))


def test_edges_of_the_input(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (None, "Alpha beta", "b"), (7, "alpha BETA", "b"), (7, "alpha beta", "b"), (8, "x " * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lanes string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (None, 7), (7, 7), (7, 7), (8, 8)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "8"]


def test_rows_that_repeat_an_id_with_unlike_texts_stay_apart(spark):
    one, two, three = ("p q r s t u v w " * 3, "a b c d e f g h " * 3, "k l m n o i j z " * 3)
    rows = [(1, one), (1, two), (2, one), (3, three), (None, three), (None, "lone words that stand nowhere else at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert got == sorted([("1", one), ("1", two), ("3", three), ("None", rows[-1][1])])
    ring = {(str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert ring == {("1", 1), ("2", 1), ("3", 3), ("None", 3), ("None", None)}


def test_columns_of_any_name(spark):
    names = ["own", "key", "kept_id", "kept_key", "__kept", "node", "component", "lanes"]
    docs = spark.createDataFrame([(1, "a b c d e f", *names), (2, "a b c d e f", *names)], ["doc_id", "text", *names])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [1]


def test_a_large_bucket_of_two_groups_and_strays(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    base = [f"x{j}" for j in range(100)]
    chain = lambda k: base[: 100 - 6 * k] + [f"y{k}-{j}" for j in range(6 * k)]
    rows = [" ".join(chain(k) + [f"own{k}-{i}"]) for k in range(9) for i in range(4)]
    texts = dict(enumerate(rows))
    sets = {i: shingle_set(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, simhash.WIDE).collect()} == least


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
def test_components(spark, edges):
    frame = spark.createDataFrame(edges or [(0, 0)], "a long, b long")
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


def test_majority_counts_long_rows():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    bounds = np.array([0, 0, 1, 700, 3000])
    got = simhash.majority(h, bounds)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        bits = [(h[a:b] >> np.uint64(k) & np.uint64(1)).sum() for k in range(64)]
        assert int(got[i]) == sum(1 << k for k in range(64) if 2 * bits[k] > b - a)
