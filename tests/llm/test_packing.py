import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import packing


def best_fit(lengths, capacity):
    """Offsets by piece of plain best-fit decreasing, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits, key=lambda b: b[0])[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins), sorted(b[0] for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, 40)
    used: dict[int, list] = {}
    for length, first, n, sequence, offset in runs:
        for i in range(n):
            used.setdefault(sequence + i, []).append((offset, length))
    assert sum(len(x) for x in used.values()) == len(lengths)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    bins, rooms = best_fit(lengths, 40)
    assert (len(used), sorted(40 - sum(n for _, n in parts) for parts in used.values())) == (bins, rooms)
    for n in counts:  # ordinals of a length are dealt out without gaps
        firsts = sorted((f, m) for length, f, m, _, _ in runs if length == n)
        assert [f for f, _ in firsts] == [sum(m for _, m in firsts[:i]) for i in range(len(firsts))]


def test_tree():
    tree = packing.CapacityTree(10)
    assert tree.tightest(1) is None
    tree.add(7, 2)
    tree.add(3, 1)
    assert (tree.tightest(1), tree.tightest(4), tree.tightest(8)) == (3, 7, None)
    tree.add(7, -2)
    assert tree.tightest(4) is None


def test_ids_of_odd_words_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(12)
    signs = list("abİıẞßǅΣςé１²½ⅷ日́̈'`.,;:!?|#*$%&()-\"<>") + ["İ$", "İ.", "'s", "<|", "\u0130\u0307", "\u1e9e"]
    texts = [" ".join("".join(rng.choice(signs, int(rng.integers(1, 6)))) for _ in range(8)) for _ in range(4000)]
    data = [t.encode() for t in texts]
    packing._tokenizers.clear()
    got = packing.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))), path)
    assert [(t, g.tolist()) for t, g in zip(texts, got)] == [(t, plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_of_shipped_documents_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, k): zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()) for r in docs.collect() for ids in [plain.encode(r.text or "", add_special_tokens=False).ids + [1]] for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack(docs).collect()} == want


def test_many_pieces_of_a_length_go_to_more_buckets(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id AS doc_id", "'same words' AS text")
    few = sorted((r.sequence_id, r.offset) for r in packing.pack(docs, capacity=10).collect())
    monkeypatch.setattr(packing, "PER_BUCKET", 4)
    assert sorted((r.sequence_id, r.offset) for r in packing.pack(docs, capacity=10).collect()) == few


ODD = ["a\x1cb  x<|endoftext|>y İ é ́z Σας \x85 q", "", "   ", "don't 'S <|ENDOFTEXT|> x.) y,, !!! ...", "１２ ½ é.  n", "日本語 text,mix", "word. word, WORD; (word)."]


def test_ids_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (100, "many words here " * 5000), (None, "hi"), (0, ODD[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, with_ids=True).collect()
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(k, a, ids[a : a + 4096]) for k, a in enumerate(range(0, len(ids), 4096))]
        own = sorted((r.piece, r.start, r.ids) for r in got if r.doc_id == i)
        assert own == sorted(want * sum(j == i for j, _ in rows))
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096
    assert packing.pack(docs.limit(0)).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    path = packing.default_tokenizer()
    texts = [" ".join(f"word{i % 90}" for i in range(j, j + 60)).encode() for j in range(6)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words = packing.WordIds(path)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    packing._tokenizers[path] = words
    for _ in range(2):
        for got, t in zip(packing.encode(buf, offsets, path), texts):
            assert got.tolist() == plain.encode(t.decode(), add_special_tokens=False).ids
    packing._tokenizers.clear()


@pytest.mark.parametrize("name", ["pieces"])
def test_few_sequences(spark, sf_dir, name):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len({r.sequence_id for r in rows}) <= np.ceil(sum(r.length for r in rows) / 4096) + 1
