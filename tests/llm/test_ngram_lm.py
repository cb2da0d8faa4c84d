import collections
import math
import zlib

import numpy as np
import pytest

from tallyforge.llm import _store
from tallyforge.llm import ngram_lm as lm


class Plain:
    """The same model over dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = collections.Counter(), collections.Counter()
        for t in texts:
            words = [*(t or "").encode().lower().split(), 0]
            self.uni.update(words)
            self.bi.update(zip([1, *words[:-1]], words))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.follow = collections.Counter(self.uni)
        self.follow.pop(0, None)
        self.follow[1] = len(texts)
        self.contexts = collections.Counter(w for _, w in self.bi)
        of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d1, self.d2 = [0, *lm.discounts(of(self.contexts))], [0, *lm.discounts(of(self.bi))]
        self.left = collections.Counter()
        for (v, _), c in self.bi.items():
            self.left[v] += self.d2[min(c, 3)]
        self.spare = sum(self.d1[min(c, 3)] for c in self.contexts.values())

    def lower(self, w):
        c = self.contexts.get(w, 0)
        return (c - self.d1[min(c, 3)] + self.spare / (self.v + 1)) / len(self.bi)

    def p(self, v, w):
        if v not in self.follow:
            return self.lower(w)
        c = self.bi.get((v, w), 0)
        return (c - self.d2[min(c, 3)] + self.left[v] * self.lower(w)) / self.follow[v]

    def score(self, text):
        words = [*(text or "").encode().lower().split(), 0]
        own = sum(math.log10(self.p(v, w)) for v, w in zip([1, *words[:-1]], words))
        base = sum(math.log10((self.uni.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in words)
        return len(words), sum(w in self.uni for w in words), base, own


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_matches_the_plain_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = Plain([t for i, t in texts.items() if not is_held_out(i)])
    for w in list(plain.uni)[:3]:  # distributions add up to one
        assert abs(sum(plain.p(w, x) for x in [*plain.uni, "unknown"]) - 1) < 1e-9
    better = []
    for r in lm.score(docs).collect():
        tokens, known, base, own = plain.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, plain.n, is_held_out(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-6)
        if r.held_out:
            better.append(r.score - r.base_score)
    assert sum(better) > 0


@pytest.mark.parametrize("limits", [{"PART_BYTES": 4096, "FLUSH": 500}, {"NARROW": 100}, {"PART_BYTES": 4096, "SMALL_PARTS": 4, "LARGE_PART_BYTES": 8192, "NARROW": 100, "FLUSH": 500}])
def test_limits_change_nothing(spark, sf_dir, monkeypatch, limits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6)
    one = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for name, value in limits.items():
        monkeypatch.setattr(lm, name, value)
    two = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert all(math.isclose(one[i], two[i], rel_tol=1e-9) for i in one)


def test_parts_follow_the_bytes_without_end():
    sizes = [1, 100 << 20, 30 << 30, 1 << 40, 100 << 40]
    bits = [lm.part_bits(s) for s in sizes]
    assert bits == sorted(bits) and bits[0] == 3
    assert all(s >> b <= lm.LARGE_PART_BYTES for s, b in zip(sizes, bits))


def test_wide_keys_sort_as_narrow_ones_and_hold_more():
    rng = np.random.default_rng(4)
    v, w = rng.integers(0, 300, 2000), rng.integers(0, 300, 2000)
    narrow, wide = lm.packed(v, w, False), lm.packed(v, w, True)
    assert (np.argsort(narrow, kind="stable") == np.argsort(wide, kind="stable")).all()
    assert (np.unique(narrow, return_counts=True)[1] == np.unique(wide, return_counts=True)[1]).all()
    big = rng.integers(0, 1 << 62, 50), rng.integers(0, 1 << 62, 50)
    assert all((a == b).all() for a, b in zip(lm.unpacked(lm.packed(*big, True)), big))
    assert all((a == b).all() for a, b in zip(lm.unpacked(narrow), (v, w)))
    assert lm.dealt(wide, 5).min() >= 0 and lm.dealt(wide, 5).max() < 32


def test_fetched_arrays_are_forgotten_beyond_a_bound(tmp_path, monkeypatch):
    for k in range(6):
        _store.save_all(f"{tmp_path}/{k}", {"a": np.arange(1000), "b": np.array([k], np.uint8)})
    monkeypatch.setattr(_store, "in_place", lambda path: False)
    monkeypatch.setattr(lm, "FETCHED", 20_000)
    lm._cache.clear()
    for k in range(6):
        assert lm._arrays(f"{tmp_path}/{k}")["a"][7] == 7 and lm._arrays(f"{tmp_path}/{k}")["b"].tolist() == [k]
        assert len(lm._cache) <= 4
    lm._cache.clear()


def test_a_part_is_opened_once_for_many_texts(spark, sf_dir, monkeypatch):
    """With room for ten files only, openings follow the looks at all parts, not the chunks."""
    monkeypatch.setattr(lm, "PART_BYTES", 1 << 14)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    model = lm.train(docs.select("text"))
    opened = []
    real = _store.mapped_all
    monkeypatch.setattr(_store, "mapped_all", lambda path: opened.append(path) or real(path))
    monkeypatch.setattr(lm, "OPEN", 10)
    parts = 1 << model.vocabulary.bits
    assert parts >= 32

    def openings(together: int) -> int:
        opened.clear()
        lm._cache.clear()
        for lo in range(0, len(texts), together):
            data = [t.encode() for t in texts[lo : lo + together]]
            stream = lm.Stream()
            for d in data:
                stream.add(np.frombuffer(d, np.uint8), np.array([0, len(d)]))
            model.score(stream)
        return len(opened)

    assert openings(60) <= 3 * parts + 20  # words, their numbers, pairs, and the bounds again
    assert openings(60) * 5 < openings(1)


def test_texts_looked_up_together_or_alone_score_alike(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    one = {r.doc_id: r.score for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "TOGETHER", 100)
    assert all(math.isclose(one[r.doc_id], r.score, rel_tol=1e-12) for r in lm.score(docs).collect())


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b a"), (3, "a b a"), (9, "z " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(docs).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    plain = Plain([t for i, t in rows if i is not None and not is_held_out(i)])
    for r in got:
        text = dict(rows)[r.doc_id]
        assert math.isclose(r.score, plain.score(text)[3], rel_tol=1e-6)
    assert lm.score(docs.limit(0)).count() == 0
    alone = lm.score(docs.where("doc_id IS NULL")).first()
    assert (alone.train_tokens, alone.n_known, alone.score) == (0, 0, 0.0)


def test_store(tmp_path):
    path = f"file://{tmp_path}/deep/a.npy"
    _store.save(path, np.arange(5))
    got = _store.mapped(path)
    assert isinstance(got, np.memmap) and got.tolist() == [0, 1, 2, 3, 4]
    w = _store.Writer(f"{tmp_path}/x/y.bin")
    w.write(b"abc")
    assert not (tmp_path / "x/y.bin").exists()
    w.close()
    assert _store.reader(f"file:{tmp_path}/x/y.bin").read() == b"abc"
