"""SimHash near-duplicates with pigeonring filtering.

Two settings of one operator:

* ``RING``: one 64-bit lane. 16 segments of 4 bits on a ring; two fingerprints within
  2 bits have a start from which every chain of l segments differs in at most
  ``l * 2 / 16`` bits, so its first 7 segments (28 bits) are equal. Those 28 bits are
  the index key, longer chains prune, and the full Hamming check decides. Exact.
* ``WIDE``: eight lanes (512 bits) for shingle similarity of 0.8, where 64-bit
  fingerprints differ in about 10 bits and no ring chain is selective. Candidates share
  one of 12 min-wise views (3 sampled shingles each), the ring of 8 lanes prunes, and the
  Jaccard similarity of the two sets of shingles decides.

Equal fingerprints (of equal sets, in ``WIDE``) are one class before any candidate is
made. Every pair of a bucket is settled, whatever the bucket's size; sizes only choose how:

* up to ``BUCKET`` classes pair by pair;
* larger ones in ``RING`` by shared middle points (one bit or none from both), which is
  linear and exact for two bits;
* larger ones in ``WIDE`` against ``REPS`` representatives of the bucket first, which is
  linear; members that link to none of them are then compared with all members, block by
  block. Pairs whose members both link to the representatives are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _bytes as B
from tallyforge.llm._session import free_names, staged
from tallyforge.llm.components import components

BUCKET = 48
BLOCK = 256
REPS = 4
SALTS = 16


@dataclass(frozen=True)
class Setting:
    shingle: int
    lanes: int
    distance: int
    segments: int
    views: int = 0
    rows: int = 0
    similar: tuple[int, int] | None = None  # least similarity of the sets, as a fraction


RING = Setting(shingle=3, lanes=1, distance=2, segments=16)
#: Sets of shingles at a Jaccard similarity of 0.8 differ in 77 of 512 bits on average,
#: in 96 for the worst sizes (4 of 5 shingles), with a standard deviation of 8 to 9; 160
#: bits are seven of those away. Unlike texts differ in 256.
WIDE = Setting(shingle=5, lanes=8, distance=160, segments=8, views=12, rows=3, similar=(4, 5))


def _exact_hashes(data: bytes, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each row's k-word shingles; rows' bounds in the result."""
    out: list[int] = []
    bounds = np.zeros(len(offsets), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(offsets) - 1):
        found = data[offsets[i] : offsets[i + 1]].split()
        n = len(found)
        if n:
            joined = b" ".join(found)
            if n <= k:
                out.append(digest(joined, 42))
            else:
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
                starts = np.zeros(n, np.int64)
                starts[1:] = ends[:-1] + 1
                out += [digest(joined[a:b], 42) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())]
        bounds[i + 1] = len(out)
    return np.array(out, np.uint64), bounds


def _rolling_hashes(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = B.words(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes = B.word_hashes(buf, starts, ends)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=bounds[1:])
    begin = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    return B.spans_hash(hashes, begin, np.minimum(begin + k, np.repeat(first[1:], count)), "a"), bounds


def _sets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different hashes in order; rows' bounds in the result."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = h[np.lexsort((h, row))]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], np.append(0, np.cumsum(np.bincount(row[first], minlength=len(bounds) - 1)))


def _shingles(buf: np.ndarray, offsets: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[buf]
    if s.lanes == 1:
        return _exact_hashes(low.tobytes(), offsets, s.shingle)
    return _sets(*_rolling_hashes(low, offsets, s.shingle))


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row a 64-bit word whose bit is 1 if set in over half the row's hashes."""
    rows = len(bounds) - 1
    out = np.zeros(rows, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    lo, n = bounds[:-1][some], np.diff(bounds)[some]
    parts = (n + 254) // 255
    at = np.zeros(len(some) + 1, np.int64)
    np.cumsum(parts, out=at[1:])
    chunk = np.repeat(lo, parts) + 255 * (np.arange(at[-1]) - np.repeat(at[:-1], parts))
    every = np.uint64(0x0101010101010101)
    found = np.zeros(len(some), np.uint64)
    for bit in range(8):
        packed = np.add.reduceat((h >> np.uint64(bit)) & every, chunk)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), at[:-1], axis=0)
        for byte in range(8):
            found |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[some] = found
    return out


def _ring_keys(fp: np.ndarray, s: Setting) -> np.ndarray:
    width = 64 // s.segments
    run = -(-s.segments // s.distance) - 1  # longest chain with a budget below one bit
    mask = np.uint64((1 << width * run) - 1)
    keys = np.zeros((len(fp), s.segments), np.uint64)
    for i in range(s.segments):
        turned = (fp >> np.uint64(width * i)) | (fp << np.uint64((64 - width * i) % 64)) if i else fp
        keys[:, i] = (turned & mask) | np.uint64(i << 48)
    return keys


def _view_keys(h: np.ndarray, bounds: np.ndarray, s: Setting) -> np.ndarray:
    rows = len(bounds) - 1
    keys = np.zeros((rows, s.views), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for v in range(s.views):
            key = np.full(len(some), v + 1, np.uint64)
            for r in range(s.rows):
                odd = np.uint64((0x9E3779B97F4A7C15 * (2 * (v * s.rows + r) + 3)) & (2**64 - 1) | 1)
                key = B.mix(key ^ np.minimum.reduceat(B.mix(h * odd), bounds[:-1][some]))
            keys[some, v] = key
    return keys


def fingerprints(docs: DataFrame, setting: Setting, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lanes, keys, whole, text_key) of each row; texts are lower-cased in A-Z, null is empty.

    Fewer words than a shingle: the whole sequence is the one shingle. No words: zero.
    Where the sets of shingles decide, a repeated shingle counts once, and ``whole``
    tells sets apart and ``text_key`` is the text's digest; else they are 0 and null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in B.text_chunks(batch, "text"):
                h, bounds = _shingles(buf, offsets, setting)
                lanes = np.stack(
                    [majority(h if setting.lanes == 1 else B.mix(h + np.uint64(0xA0761D6478BD642F * (k + 1) & (2**64 - 1))), bounds) for k in range(setting.lanes)],
                    axis=1,
                )
                keys = _view_keys(h, bounds, setting) if setting.views else _ring_keys(lanes[:, 0], setting)
                whole = np.zeros(hi - lo, np.uint64)
                some = np.flatnonzero(np.diff(bounds))
                if setting.similar and len(some):
                    whole[some] = np.add.reduceat(B.mix(h), bounds[:-1][some])
                text_keys = batch.column(2).slice(lo, hi - lo)
                yield pa.record_batch([ids.slice(lo, hi - lo), _lists(lanes), _lists(keys), pa.array(whole.view(np.int64)), text_keys], ["id", "lanes", "keys", "whole", "text_key"])

    rows = _rows(docs, id_col, text_col)
    if setting.similar:
        rows = rows.select("id", "text", F.md5(F.col("text").cast("binary")).alias("text_key"))
    else:
        rows = rows.select("id", "text", F.lit(None).cast("string").alias("text_key"))
    return rows.mapInArrow(run, "id long, lanes array<long>, keys array<long>, whole long, text_key string")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _text(text_col).alias("text"))


def _shingle_sets(docs: DataFrame, s: Setting) -> DataFrame:
    """(id, shingles) of each row of (id, text): the hashes of its different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in B.text_chunks(batch, "text"):
                h, bounds = _shingles(buf, offsets, s)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.record_batch([ids.slice(lo, hi - lo), lists], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _lists(a: np.ndarray) -> pa.ListArray:
    n, k = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(np.ascontiguousarray(a).view(np.int64).ravel()))


def _pair_test(s: Setting) -> str:
    """SQL over x and y (structs with lanes) and key: chain budgets, then the distance."""
    if s.lanes == 1:
        width = 64 // s.segments
        xor = "(x.lanes[0] ^ y.lanes[0])"
        turn = f"cast(shiftrightunsigned(key, 48) as int) * {width}"
        turned = f"(shiftrightunsigned({xor}, {turn}) | shiftleft({xor}, (64 - {turn}) % 64))"
        tests = []
        for budget in range(1, s.distance):
            longest = max(n for n in range(1, s.segments) if n * s.distance // s.segments == budget)
            tests.append(f"bit_count({turned} & {(1 << width * longest) - 1}L) <= {budget}")
        return " AND ".join([*tests, f"bit_count({xor}) <= {s.distance}"])
    gaps = "zip_with(x.lanes, y.lanes, (p, q) -> cast(bit_count(p ^ q) as int))"
    chain = " AND ".join(f"d[i] + {' + '.join(f'd[(i + {j}) % {s.segments}]' for j in range(1, n))} <= {n * s.distance / s.segments}" for n in range(2, s.segments + 1))
    return f"exists(transform(array({gaps}), d -> exists(sequence(0, {s.segments - 1}), i -> d[i] <= {s.distance / s.segments} AND {chain})), ok -> ok)"


def _shown(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text): each class's node and the text of the row that stands for it."""
    wanted = classes.select("node", F.col("shown.id").alias("shown_id"), F.col("shown.text_key").alias("shown_key"))
    given = docs.select("id", "text", F.md5(F.col("text").cast("binary")).alias("text_key"))
    met = given.join(wanted, F.col("id").eqNullSafe(F.col("shown_id")) & (F.col("text_key") == F.col("shown_key")))
    return met.dropDuplicates(["node"]).select(F.col("node").alias("id"), "text")


def links(classes: DataFrame, s: Setting, docs: DataFrame | None = None) -> DataFrame:
    """(a, b) between classes (node, lanes, keys) that are within the distance and, if
    the setting has a least similarity, that similar by the texts of ``docs`` (id, text)
    that the classes show.

    Small buckets give every such pair; large ones enough pairs to connect all that
    such pairs connect. Candidates all pass the ring's chain budgets before the full
    Hamming check, but for those by middle points, which are within two bits as they come.
    """
    keyed = classes.select("node", "lanes", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keyed.join(sizes, "key"), "buckets")
    pairs = (
        shared.where(F.col("n") <= BUCKET)
        .groupBy("key")
        .agg(F.collect_list(F.struct("node", "lanes")).alias("m"))
        .select(F.expr(f"inline(flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {_pair_test(s)}), y -> struct(x.node AS a, y.node AS b)))))"))
    )
    large = shared.where(F.col("n") > BUCKET)
    if s.lanes == 1 and s.distance == 2:
        return pairs.unionAll(_by_middle(large))
    stars = _stars(large, s)
    pairs = staged(pairs.unionAll(stars.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    used = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).unionAll(large.select(F.col("node").alias("id"))).distinct()
    sets = staged(_shingle_sets(_shown(classes.join(used, classes["node"] == used["id"], "left_semi"), docs), s), "shingles")
    sure = staged(_similar(pairs, sets, s), "similar")
    return sure.unionAll(_by_blocks(_unlinked(large, stars, sure), sets, s))


def _representatives(large: DataFrame) -> DataFrame:
    """(key, reps): in each bucket the nodes that come first by one of several hashes, the
    same in every bucket that holds them."""
    least = [F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "lanes")).alias(f"r{r}") for r in range(REPS)]
    return large.groupBy("key").agg(*least).select("key", F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"r{r}.node").alias("node"), F.col(f"r{r}.lanes").alias("lanes")) for r in range(REPS)]).alias("reps"))


def _stars(large: DataFrame, s: Setting) -> DataFrame:
    """(key, r, a, b): each member b of a large bucket with a representative a, if the ring lets both pass."""
    reps = _representatives(large).select("key", F.inline("reps")).select("key", "r", F.struct("node", "lanes").alias("x"))
    both = _with_own(large.select("key", "node", F.struct("node", "lanes").alias("y")), reps)
    return staged(both.where(F.expr(_pair_test(s))).select("key", "r", F.col("x.node").alias("a"), F.col("y.node").alias("b")), "stars-of-buckets")


def _with_own(members: DataFrame, few: DataFrame) -> DataFrame:
    """Members of buckets (key, node) with their bucket's few rows, which meet them in
    ``SALTS`` tasks: one bucket may hold a third of all."""
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return members.select("*", salt).join(few.select("*", copies), ["key", "salt"]).drop("salt")


def _unlinked(large: DataFrame, stars: DataFrame, sure: DataFrame) -> DataFrame:
    """The large buckets' rows, with ``open`` where a member isn't known to be connected
    with the bucket's first representative, and n, open_n: how many there are in the bucket."""
    edge = stars.where("a <> b").select("key", "r", "a", "b", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    linked = edge.join(sure.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"], "left_semi").select("key", "r", "a", "b")
    # representatives that link to the first one, and itself
    first = stars.where("r = 0 AND a = b").select("key", F.col("a").alias("node")).distinct()
    main = first.unionByName(linked.where("r = 0").select("key", F.col("b").alias("node"))).distinct()
    near = linked.join(main.select("key", F.col("node").alias("a")), ["key", "a"], "left_semi").select("key", F.col("b").alias("node"))
    known = main.unionByName(near).distinct().withColumn("known", F.lit(True))
    marked = staged(large.select("key", "node", "lanes", "n").join(known, ["key", "node"], "left").select("key", "node", "lanes", "n", F.col("known").isNull().alias("open")), "marked")
    some = marked.where("open").groupBy("key").agg(F.count("*").alias("open_n"))
    return _with_own(marked, some)


def _similar(pairs: DataFrame, sets: DataFrame, s: Setting) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    least, whole = s.similar
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(common * (whole + least) >= (F.size("x").cast("long") + F.size("y")) * least).select("a", "b")


def _by_middle(large: DataFrame) -> DataFrame:
    """Fingerprints one bit or none from the same point are within two of each other."""
    one = large.select("node", F.col("lanes")[0].alias("fp")).distinct()
    around = one.select("node", F.explode(F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)")).alias("point"))
    least = around.groupBy("point").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    return around.join(least, "point").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _by_blocks(marked: DataFrame, sets: DataFrame, s: Setting) -> DataFrame:
    """Compare the open members of each bucket with all its members, block by block; emit
    a spanning forest of each comparison."""
    rows = f"cast(ceil(open_n / {BLOCK}) as int)"
    columns = f"cast(ceil(n / {BLOCK}) as int)"
    place = "cast(pmod(xxhash64(node, 'block'), {n}) as int)"
    asks = marked.where("open").select("key", "node", "lanes", F.expr(place.format(n=rows)).alias("p"), F.explode(F.expr(f"sequence(0, {columns} - 1)")).alias("q"), F.lit(True).alias("asks"))
    told = marked.select("key", "node", "lanes", F.explode(F.expr(f"sequence(0, {rows} - 1)")).alias("p"), F.expr(place.format(n=columns)).alias("q"), F.lit(False).alias("asks"))
    dealt = asks.unionByName(told).join(sets.withColumnRenamed("id", "node"), "node")
    distance, (least, whole) = s.distance, s.similar

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        asks = table.column("asks").to_numpy()
        lanes = np.array(table.column("lanes").to_pylist(), np.int64).view(np.uint64).reshape(len(node), -1)
        lists = table.column("shingles").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        values, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        start = np.cumsum(size) - size
        mine = np.zeros(len(values), bool)
        tree = np.unique(node, return_inverse=True)[1]  # the same number: connected already
        a, b = [], []
        for i in np.flatnonzero(asks):
            rest = np.flatnonzero(~asks & (tree != tree[i]))
            # the smaller set within the larger one is the most there can be in common
            rest = rest[np.minimum(size[rest], size[i]) * whole >= np.maximum(size[rest], size[i]) * least]
            gap = np.zeros(len(rest), np.int64)
            for k in range(lanes.shape[1]):
                gap += np.bitwise_count(lanes[rest, k] ^ lanes[i, k])
            rest = rest[(gap <= distance) & (size[rest] > 0)]
            mine[code[start[i] : start[i] + size[i]]] = True
            for j in rest.tolist():
                if tree[j] == tree[i]:
                    continue
                common = np.count_nonzero(mine[code[start[j] : start[j] + size[j]]])
                if common * (whole + least) >= (size[i] + size[j]) * least:
                    tree[tree == tree[j]] = tree[i]
                    a.append(node[i])
                    b.append(node[j])
            mine[code[start[i] : start[i] + size[i]]] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def _classified(docs: DataFrame, setting: Setting, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, lanes, component_id, component) of every row, staged where it is read twice.

    A class is all rows of equal fingerprints (and equal sets). Classes have numbers of
    their own, so rows that repeat an id with different texts stay apart.
    """
    prints = staged(fingerprints(docs, setting, id_col, text_col), "fingerprints")
    grouped = prints.groupBy("lanes", "whole").agg(F.min("id").alias("least"), F.any_value("keys").alias("keys"), F.min(F.struct("id", "text_key")).alias("shown"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = staged(links(classes, setting, _rows(docs, id_col, text_col)).distinct(), "links")
    linked = components(found)
    known = classes.select("lanes", "whole", "node", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = staged(known.select("lanes", "whole", "least", "component"), "classes-of-components")
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(named, "component").select("lanes", "whole", "component", "component_id")
    return prints.select("id", "text_key", "lanes", "whole").join(known, ["lanes", "whole"]).select("id", "text_key", "lanes", "component_id", "component")


def near_duplicates(docs: DataFrame, setting: Setting = RING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` is lowercase hex; ``component_id`` is the smallest id reachable
    through links, the row's own included. Null texts count as empty. Repeated rows
    and repeated ids give a row each; rows that share an id, but not a fingerprint, are
    classes of their own. Rows with a null id link others like any row; their component
    is null only if nothing they reach has an id. An empty table gives an empty table.
    Other columns are not read, so their names can't clash.
    """
    rows = _classified(docs, setting, id_col, text_col)
    hexed = F.expr("lower(array_join(transform(lanes, x -> lpad(hex(x), 16, '0')), ''))")
    return rows.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, setting: Setting = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate component, all columns: the one with the smallest id
    (nulls last), then with the smallest digest of its text.

    Rows that repeat an id with unlike texts are documents of their own. Rows that repeat
    both id and text count once. A null text is empty, and all empty texts are copies of
    each other. An empty table gives an empty table. Columns of any name may be there;
    the names that are needed on the way are not among them.
    """
    rows = _classified(docs, setting, id_col, text_col)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("best"))
    own, key, kept_id, kept_key = free_names(docs.columns, "own", "key", "kept_id", "kept_key")
    kept = best.select(F.col("best.id").alias(kept_id), F.col("best.text_key").alias(kept_key))
    keyed = docs.withColumns({own: F.col(id_col).cast("long"), key: F.md5(_text(text_col).cast("binary"))})
    one = keyed.join(kept, keyed[own].eqNullSafe(kept[kept_id]) & (keyed[key] == kept[kept_key]), "left_semi").dropDuplicates([own, key])
    return one.drop(own, key)
