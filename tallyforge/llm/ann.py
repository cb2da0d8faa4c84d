"""Approximate nearest neighbours over a robust-pruned directed graph per shard.

Rows are dealt to shards by a hash of their id, so equal vectors spread out too; a
shard's graph is over its different vectors. A shard has ``SHARD`` rows where there are
few, and then as many as keep the number of shards at ``SHARDS``, up to ``LARGEST``: so
searches grow with the queries alone, and beyond with the shards. Points are inserted in
growing batches: a greedy beam search over the graph so far proposes neighbours, relaxed
distance pruning (factor ``ALPHA``) keeps at most ``DEGREE`` diverse ones, and edges back
are pruned likewise. Pruning cuts edges between clusters that lie far apart, so searches
start from many entries, farthest first, and begin at those nearest to the query; nodes
that no entry reaches get an edge or become entries too. Every query runs a beam search over every shard, in blocks of
queries; exact distances in double precision rank what the beams found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm._session import staged

SHARD, SHARDS, LARGEST = 8192, 512, 1 << 18
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
EXPAND = 4
BATCH = 256
#: Entries a search begins at, and rows among which entries are looked for.
START, SAMPLE = 16, 1 << 14
#: Squared distances to nearest rows that single precision can't tell, by the largest norm.
COARSE = 1e-4
#: Queries that a shard is held against in one task; a shard goes out once for each block.
QUERY_BLOCK = 1 << 17


def _gaps(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances (rows, k) of each row's query to its ids, up to the query's norm."""
    return norms[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


def shard_count(rows: int) -> int:
    return -(-rows // min(LARGEST, max(SHARD, rows // SHARDS)))


class Space:
    """What graph distances are computed in: vectors less their mean, in single precision
    where that tells near rows apart, else in double precision over the largest component."""

    def __init__(self, v: np.ndarray) -> None:
        most = float(np.abs(v).max(initial=0.0))
        self.scale = 1.0 if 1e-9 < most < 1e15 else most or 1.0
        self.middle = (v / self.scale).mean(0) if len(v) else np.zeros(v.shape[1])
        x = v / self.scale - self.middle
        self.kind = np.float32 if self.scale == 1.0 and not self._close(x) else np.float64

    @staticmethod
    def _close(x: np.ndarray) -> bool:
        """Whether nearest rows lie so close that their distances drown in the norms."""
        some = x[np.random.Generator(np.random.PCG64(5)).permutation(len(x))[:4096]]
        if len(some) < 2:
            return False
        norms = (some * some).sum(1)
        gap = norms + norms[:256, None] - 2 * some[:256] @ some.T
        gap[np.arange(len(gap)), np.arange(len(gap))] = np.inf
        return bool(np.median(np.maximum(gap.min(1), 0)) < COARSE * norms.max())

    def of(self, v: np.ndarray) -> np.ndarray:
        """Vectors in this space; queries beyond all bounds keep their direction, which is
        what ranks rows then."""
        x = v / self.scale - self.middle
        most = np.abs(x).max(1, initial=1e12)
        return (x * (1e12 / most)[:, None]).astype(self.kind)


def distances(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a point, without overflow or underflow of squares."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = v - at
        square = (gap * gap).sum(1)
        out = np.sqrt(square)
        odd = np.flatnonzero(~np.isfinite(square) | (square < 1e-280))
        if len(odd):
            half = v[odd] / 2 - at / 2
            most = np.abs(half).max(1)
            safe = np.where(most > 0, most, 1.0)
            out[odd] = 2 * (most * np.sqrt(((half / safe[:, None]) ** 2).sum(1)))
    return out


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distance less the query's norm) of the ``beam`` nearest met, nearest first; -1 pads."""
    rows = len(q)
    ids = np.full((rows, beam), -1, np.int64)
    far = np.full((rows, beam), np.inf, x.dtype)
    done = np.zeros((rows, beam), bool)
    seen = np.zeros((rows, len(x)), bool)
    k = min(len(start), START, beam)
    gap = norms[start] - 2 * q @ x[start].T
    near = np.argpartition(gap, k - 1, axis=1)[:, :k] if k < len(start) else np.broadcast_to(np.arange(k), (rows, k))
    gap = np.take_along_axis(gap, near, 1)
    order = np.argsort(gap, axis=1)
    ids[:, :k], far[:, :k] = start[np.take_along_axis(near, order, 1)], np.take_along_axis(gap, order, 1)
    np.put_along_axis(seen, ids[:, :k], True, 1)
    active = np.arange(rows)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), np.inf, far[active])
        pick = np.argpartition(open_, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.argsort(open_, axis=1)
        live = np.isfinite(np.take_along_axis(open_, pick, 1))
        some = live.any(1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        at = active[:, None]
        done[np.broadcast_to(at, pick.shape)[live], pick[live]] = True
        next_ = np.where(live[:, :, None], graph[np.where(live, ids[at, pick], 0)], -1).reshape(len(active), -1)
        fresh = (next_ >= 0) & ~seen[at, np.maximum(next_, 0)]
        # a neighbour of two expanded nodes counts once
        order = np.argsort(next_, axis=1, kind="stable")
        ranked = np.take_along_axis(next_, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh &= ~twice
        seen[np.broadcast_to(at, next_.shape)[fresh], next_[fresh]] = True
        gap = np.where(fresh, _gaps(x, norms, q[active], np.maximum(next_, 0)), np.inf).astype(x.dtype)
        all_ids = np.concatenate([ids[active], np.where(fresh, next_, -1)], axis=1)
        all_far = np.concatenate([far[active], gap], axis=1)
        all_done = np.concatenate([done[active], np.zeros_like(fresh)], axis=1)
        order = np.argsort(all_far, axis=1)[:, :beam]
        ids[active], far[active], done[active] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_far, all_done))
    return ids, far


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (-1 pads): the nearest left is
    kept, and all that are ``alpha`` times nearer to it than to the point go."""
    ids = np.where(candidates == points[:, None], -1, candidates)
    ids_ = np.maximum(ids, 0)
    own = np.where(ids >= 0, norms[ids_] + norms[points][:, None] - 2 * np.matmul(x[ids_], x[points][:, :, None])[:, :, 0], np.inf)
    order = np.argsort(own, axis=1, kind="stable")
    ids, own = np.take_along_axis(ids, order, 1), np.take_along_axis(own, order, 1)
    alive = np.isfinite(own)
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    among = x[np.maximum(ids, 0)]
    square = norms[np.maximum(ids, 0)]
    out = np.full((len(points), degree), -1, np.int64)
    row = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[row, first]
        if not some.any():
            break
        out[some, k] = ids[row, first][some]
        gap = square + square[row, first][:, None] - 2 * np.matmul(among, among[row, first][:, :, None])[:, :, 0]
        alive &= alpha * alpha * gap > own
        alive[row, first] = False
    return out


def entry_points(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The row nearest to the mean, then each time the one farthest from all before."""
    n = len(x)
    some = np.sort(np.random.Generator(np.random.PCG64(11)).permutation(n)[:SAMPLE])
    at, square = x[some], norms[some]
    chosen = [int(np.argmin(square - 2 * at @ x.mean(0)))]
    far = np.full(len(some), np.inf)
    for _ in range(min(len(some), 64 + 2 * int(n**0.5)) - 1):
        last = chosen[-1]
        far = np.minimum(far, square + square[last] - 2 * at @ at[last])
        far[last] = -np.inf
        chosen.append(int(far.argmax()))
    return some[chosen]


def reached(graph: np.ndarray, start: np.ndarray, met: np.ndarray | None = None) -> np.ndarray:
    """Which nodes can be reached from those of ``start`` (besides those of ``met``)."""
    met = np.zeros(len(graph), bool) if met is None else met.copy()
    front = start[~met[start]]
    while len(front):
        met[front] = True
        next_ = np.unique(graph[front])
        next_ = next_[next_ >= 0]
        front = next_[~met[next_]]
    return met


def _join_unreached(graph: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Give nodes that no entry reaches an edge from a neighbour with room; the rest of them
    become entries. The entries."""
    met = reached(graph, entry)
    while not met.all():
        lost = np.flatnonzero(~met)
        near = graph[lost]
        room = (near >= 0) & met[near] & (graph[near] < 0).any(2)
        some = room.any(1)
        lost, by = lost[some], near[some, room[some].argmax(1)]
        by, one = np.unique(by, return_index=True)  # an edge a node and round
        if not len(by):
            break
        graph[by, (graph[by] < 0).argmax(1)] = lost[one]
        met = reached(graph, lost[one], met)
    while not met.all():
        first = np.flatnonzero(~met)[:1]
        entry, met = np.append(entry, first), reached(graph, first, met)
    return entry


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours (n, degree) with -1 pads, entry points) over different vectors; every
    node can be reached from an entry."""
    n = len(x)
    norms = (x * x).sum(1)
    graph = np.full((n, degree), -1, np.int64)
    if not n:
        return graph, np.zeros(0, np.int64)
    entry = entry_points(x, norms)
    for lo in range(0, len(entry), BATCH):  # entries know each other
        some = entry[lo : lo + BATCH]
        gap = norms[entry] - 2 * x[some] @ x[entry].T
        near = entry[np.argsort(gap, axis=1)[:, : beam + 1]]
        graph[some] = robust_prune(x, norms, some, near, degree, alpha)
    order = np.random.Generator(np.random.PCG64(7)).permutation(n)
    order = np.concatenate((entry, order[~np.isin(order, entry)]))
    for at in (len(entry), 0):  # the rest, then all of them again
        while at < n:
            batch = order[at : at + BATCH]
            found, _ = beam_search(x, norms, graph, entry, x[batch], beam)
            near = robust_prune(x, norms, batch, np.concatenate([found, graph[batch]], axis=1), degree, alpha)
            graph[batch] = near
            _edges_back(x, norms, graph, batch, near, alpha)
            at += len(batch)
    return graph, _join_unreached(graph, entry)


def _edges_back(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, points: np.ndarray, near: np.ndarray, alpha: float) -> None:
    degree = graph.shape[1]
    to, by = near.ravel(), np.repeat(points, near.shape[1])
    ok = to >= 0
    order = np.argsort(to[ok], kind="stable")
    to, by = to[ok][order], by[ok][order]
    nodes, first, many = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, many)
    have = (graph[nodes] >= 0).sum(1)
    fits = have + many <= degree
    each = np.repeat(fits, many)
    graph[to[each], (np.repeat(have, many) + place)[each]] = by[each]
    over = np.flatnonzero(~fits)
    for lo in range(0, len(over), BATCH):
        some = over[lo : lo + BATCH]
        wide = np.full((len(some), degree + int(many[some].max())), -1, np.int64)
        wide[:, :degree] = graph[nodes[some]]
        for i, k in enumerate(some):
            wide[i, degree : degree + many[k]] = by[first[k] : first[k] + many[k]]
        graph[nodes[some]] = robust_prune(x, norms, nodes[some], wide, degree, alpha)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound).withColumn("dim", F.size("v"))


def index(vectors: DataFrame, shards: dict[int, int]) -> DataFrame:
    """(dim, shard, id, v, node, neighbours, entry): equal vectors of a shard share a node.

    ``vectors`` has (id, v, dim) as ``valid`` gives them, ``shards`` the number of shards
    for each dim. Rows that repeat an id, or both id and vector, are rows of their own on
    one node or several. No rows give no rows.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        v = _matrix(table.column("v"))
        different, node = np.unique(v, axis=0, return_inverse=True)
        graph, entry = build(Space(different).of(different))
        flat = pa.array(graph[node.ravel()].ravel().astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, graph.shape[1]), pa.int32()), flat)
        return pa.table({"dim": table.column("dim"), "shard": table.column("shard"), "id": table.column("id"), "v": table.column("v"), "node": pa.array(node.ravel().astype(np.int32)), "neighbours": lists, "entry": pa.array(np.isin(node.ravel(), entry))})

    many = F.create_map(*[F.lit(x) for d, s in shards.items() for x in (d, s)]) if shards else F.create_map(F.lit(0), F.lit(1))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), many[F.col("dim")]).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, id long, v array<double>, node int, neighbours array<int>, entry boolean")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest found of all other rows.

    Both tables have (id, vector). Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows with a null id. Vectors are compared
    with those of their own length only. A row is not its query's neighbour, nor are
    other rows of its id; equal distances rank by id. Rows that repeat an id count once,
    by their nearest; those that repeat a vector too are one row from the start, and so
    are repeated queries. Other columns are not read. An empty table gives an empty table.
    """
    rows = valid(vectors, id_col, vector_col).distinct()
    asked = valid(queries, id_col, vector_col).distinct()
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    blocks = -(-asked.count() // QUERY_BLOCK)
    shards = {d: shard_count(n) for d, n in counts.items()}
    graph = staged(index(rows, shards), "graph")
    several = F.create_map(*[F.lit(x) for d, s in shards.items() for x in (d, s)]) if shards else F.create_map(F.lit(0), F.lit(1))
    sent = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, blocks))).cast("int")).where(several[F.col("dim")].isNotNull())
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), several[F.col("dim")] - 1)))
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))))

    def run(own: pa.Table, ask: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not own.num_rows or not ask.num_rows:
            return empty
        own = own.sort_by([("node", "ascending"), ("id", "ascending")])
        ids, node, v = own.column("id").to_numpy(), own.column("node").to_numpy(), _matrix(own.column("v"))
        fresh = np.append(True, (node[1:] != node[:-1]) | (ids[1:] != ids[:-1]))  # a node holds an id once
        ids, node, v = ids[fresh], node[fresh], v[fresh]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        bounds = np.append(first, len(node))
        q_ids, q = ask.column("id").to_numpy(), _matrix(ask.column("v"))
        space = Space(v[first])
        x = space.of(v[first])
        norms = (x * x).sum(1)
        links = _matrix(own.column("neighbours"))[fresh][first].astype(np.int64)
        entry = np.flatnonzero(own.column("entry").to_numpy()[fresh][first])
        out = ([], [], [])

        def different(nodes: np.ndarray, own_id: int, at: np.ndarray) -> dict[int, float]:
            """The nodes' nearest k ids and those as far as the last, other than the query's."""
            score = distances(v[first[nodes]], at)
            got, last = {}, np.inf
            for j in np.argsort(score, kind="stable"):
                if score[j] > last:
                    break
                # equal vectors in one go; more than k smallest new ids of a node are never needed
                a, b = bounds[nodes[j]], bounds[nodes[j] + 1]
                new = [x for x in ids[a : min(b, a + k + 1 + len(got))].tolist() if x != own_id and x not in got]
                got.update(dict.fromkeys(new[:k], score[j]))
                if len(got) >= k:
                    last = score[j]
            return got

        for lo in range(0, len(q), BATCH):
            found, _ = beam_search(x, norms, links, entry, space.of(q[lo : lo + BATCH]), SEARCH_BEAM)
            for i, mine in enumerate(found):
                got = different(mine[mine >= 0], q_ids[lo + i], q[lo + i])
                if len(got) < k and (mine >= 0).sum() < len(first):  # few ids have all the nodes met
                    got = different(np.arange(len(first)), q_ids[lo + i], q[lo + i])
                out[0].extend([q_ids[lo + i]] * len(got))
                out[1].extend(got)
                out[2].extend(got.values())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = held.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInArrow(run, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
