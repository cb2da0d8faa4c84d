import numpy as np
import pytest

from tallyforge.llm import ann


def exact(ids, x, q, k):
    i = int(np.flatnonzero(ids == q)[0])
    score = np.sqrt(((x - x[i]) ** 2).sum(1))
    order = np.lexsort((ids, score))
    return [(int(ids[j]), score[j]) for j in order if ids[j] != q][:k]


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1000)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.standard_normal((3000, 32))).astype(np.float32)
    ids = np.arange(3000)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = ann.nearest(rows, rows.where("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 3000, 100):
        want = dict(exact(ids, x.astype(np.float64), q, 10))
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += sum(v in want for _, v, _ in own)
        for _, v, s in own:
            assert s == pytest.approx(np.linalg.norm(x[v].astype(np.float64) - x[q].astype(np.float64)), rel=1e-12)
    assert hits >= 0.95 * 300


def test_one_vector_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 200)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.standard_normal(3).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame.where("vec_id = 100 OR vec_id = 300")).collect()
    same = sorted(r.vec_id for r in got if r.query_id == 100)
    assert same == [i for i in range(1, 20) if i % 3][:10]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 300), key=lambda r: r.rank)] == [i for i, _ in exact(ids, x, 300, 10)]


def test_repeated_ids_leave_k_different_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(100)]
    twice = rows * 2
    same = [(1000, [9.0, 9.0, 9.0])] * 15 + [(i, [9.0, 9.0, 9.0]) for i in range(1001, 1015)]  # a query that stands 15 times
    spread = [(2000, (np.array([-9.0, -9.0, -9.0]) + 0.01 * rng.standard_normal(3)).tolist()) for _ in range(200)]  # one id at 200 places
    every = twice + same + spread
    frame = spark.createDataFrame(every, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, rows[0][1]), (7, rows[7][1]), (1000, [9.0, 9.0, 9.0]), (2000, [-9.0, -9.0, -9.0]), (3000, [-9.0, -9.0, -9.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, asked).collect()
    for q, at in asked.collect():
        least = {}
        for i, x in every:
            if i != q:
                least[i] = min(least.get(i, np.inf), float(np.linalg.norm(np.array(x) - at)))
        want = [i for i, _ in sorted(least.items(), key=lambda x: (x[1], x[0]))][:10]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_edges_of_the_input(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [float("inf"), 1.0]), (100, [5.0, 5.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(frame, frame.where("vec_id % 100 = 0")).collect()}
    assert got[0, 1] == (1, 0.0) and got[0, 2] == (5, 1.0) and got[0, 3][0] == 100 and (0, 4) not in got
    assert [got[100, k][0] for k in (1, 2, 3)] == [5, 0, 1]
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0
    assert ann.nearest(frame, frame.limit(0)).count() == 0


def test_recall_on_the_embeddings_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 500)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = [(r.id, r.v) for r in ann.valid(rows).collect()]
    ids, x = np.array([i for i, _ in held]), np.array([v for _, v in held])
    assert ann.shard_count(len(ids)) > 3
    got: dict[int, set] = {}
    for r in ann.nearest(rows, rows.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [int(i) for i in ids if i % 100 == 0]
    assert sorted(got) == asked  # every query
    hits = sum(len(got[q] & {i for i, _ in exact(ids, x, q, 10)}) for q in asked)
    assert hits >= 0.95 * 10 * len(asked)


def test_a_query_that_repeats_its_nearest_row(spark):
    rng = np.random.default_rng(9)
    rows = [(1, [1.0, 1.0, 1.0])] * 15 + [(i, (1.5 + rng.random(3)).tolist()) for i in range(2, 40)] + [(0, [1.0, 1.0, 1.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame.where("vec_id = 0").unionAll(frame.where("vec_id = 0"))).collect()
    ids, x = np.array([i for i, _ in dict(rows).items()]), np.array(list(dict(rows).values()))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for i, _ in exact(ids, x, 0, 10)]


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e30])
def test_finite_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(5)
    plain = {i: rng.standard_normal(4) for i in range(30)}
    frame = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in plain.items()], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame.where("vec_id % 100 = 0")).collect()
    want = exact(np.array(list(plain)), np.array(list(plain.values())), 0, 10)
    own = sorted((r.rank, r.vec_id, r.score) for r in got)
    assert [i for _, i, _ in own] == [i for i, _ in want]
    assert [s / scale for _, _, s in own] == pytest.approx([s for _, s in want])


def test_shards_grow_with_the_rows():
    assert [ann.shard_count(n) for n in (1, ann.SHARD, ann.SHARD + 1)] == [1, 1, 2]
    assert ann.shard_count(100_000_000) <= ann.SHARDS + 1
    assert ann.shard_count(10**9) == -(-(10**9) // ann.LARGEST)


def test_pruning_keeps_the_nearest_and_drops_the_covered():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 3]], np.float32)
    norms = (x * x).sum(1)
    got = ann.robust_prune(x, norms, np.array([0]), np.array([[1, 2, 3, 1, -1, 0]]), 3, 1.2)
    assert got.tolist() == [[1, 3, -1]]


def graph_recall(x: np.ndarray, asked: np.ndarray, k: int = 10) -> float:
    """Recall of one shard's graph, whose nodes all have to be reached."""
    space = ann.Space(x)
    v = space.of(x)
    graph, entry = ann.build(v)
    assert ann.reached(graph, entry).all()
    found, _ = ann.beam_search(v, (v * v).sum(1), graph, entry, v[asked], ann.SEARCH_BEAM)
    hits = 0
    for q, mine in zip(asked, found):
        gap = ((x - x[q]) ** 2).sum(1)
        gap[q] = np.inf
        mine = mine[(mine >= 0) & (mine != q)]
        hits += len(set(np.argsort(gap)[:k]) & set(mine[np.argsort(gap[mine])][:k]))
    return hits / (k * len(asked))


@pytest.mark.parametrize("clusters", [8, 40, 200])
@pytest.mark.parametrize("apart", [2.0, 10.0, 1000.0])
def test_recall_on_clusters_near_and_far(clusters, apart):
    rng = np.random.default_rng(clusters)
    x = apart * rng.standard_normal((clusters, 64))[rng.integers(0, clusters, 2400)] + rng.standard_normal((2400, 64))
    assert graph_recall(x, np.arange(0, 2400, 30)) >= 0.95


def test_recall_on_clusters_of_very_unlike_size_and_width():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((1800, 32)), 50 + 0.01 * rng.standard_normal((500, 32)), -200 + 5 * rng.standard_normal((90, 32)), 1000 + rng.standard_normal((10, 32))])
    assert graph_recall(x, np.arange(0, 2400, 10), 9) >= 0.95


def test_recall_on_a_large_shard():
    rng = np.random.default_rng(12)
    x = (10 * rng.standard_normal((200, 24))[rng.integers(0, 200, 20000)] + rng.standard_normal((20000, 24))).astype(np.float32)
    assert graph_recall(x.astype(np.float64), np.arange(0, 20000, 200)) >= 0.95


def test_query_far_beyond_all_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(1, 300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1e80, -1e80, 3e80])], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in sorted(ann.nearest(frame, asked).collect(), key=lambda r: r.rank)]
    assert len(got) == 10  # all as far in double precision
