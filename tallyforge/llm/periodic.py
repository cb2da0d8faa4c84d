"""Periodic runs of words: stretches that repeat with a period, maximal and whole.

A run is a stretch of consecutive words with smallest period q and a length of at least
``LEAST`` words and ``TIMES`` periods, which no neighbouring word extends. For each text:

1. Words become numbers, equal ones alike (exactly, by a dictionary). All words of a run
   stand in a gram of ``GRAM`` words that occurs again in the text, so only stretches
   covered by such grams are looked at further. No run is lost by that, nor cut.
2. A stack of starts is scanned from right to left, under the order of the numbers and
   under its reverse: it leaves the longest Lyndon word that starts at each place. Suffixes
   are compared at their first words, and where those are alike at their first difference,
   which a binary search over rolling hashes finds; the words there are held against
   each other directly.
3. Each run has a Lyndon root of its period under one of the orders. Where a Lyndon word
   is followed by its own hash, it is extended both ways by the same search, for all
   places at once. What comes of it is verified word by word.

There is no suffix array, and no task holds more than a chunk of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _bytes as B

LEAST, TIMES = 24, 3
#: Prime moduli of the rolling hashes; products of two numbers below fit in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
WORD = r"[^\x20\x09-\x0D]+"


def _numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words as equal numbers."""
    size = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    inside = buf[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(inside)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _gram_length(least: int, times: int) -> int:
    """Words that a run has in common with itself a period further, at the least."""
    return max(1, least - least // times)


def repetitive(ids: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches covered by grams that occur again in their row."""
    gram = _gram_length(least, times)
    begin, at = B.gram_rows(first, gram)
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none
    hashes = B.spans_hash(B.mix(ids.astype(np.uint64) + np.uint64(1)), begin, begin + gram, "a")
    row = np.repeat(np.arange(len(first) - 1), np.diff(at)).astype(np.uint64)
    hashes = B.mix(hashes ^ (row * np.uint64(0x9E3779B97F4A7C15)))  # of a row and its gram
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(begin), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, begin[again], 1)
    np.add.at(change, begin[again] + gram, -1)
    inside = np.cumsum(change)[:-1] > 0
    # rows end stretches too
    lead = inside.copy()
    lead[1:] &= ~inside[:-1]
    edge = first[:-1][first[:-1] < len(ids)]
    lead[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = first[1:][first[1:] > 0] - 1
    last[edge] |= inside[edge]
    return np.flatnonzero(lead), np.flatnonzero(last) + 1


class Stretch:
    """One stretch of word numbers with its rolling hashes."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.n = ids, len(ids)
        self.words = ids.tolist()
        self.powers, self.sums = [], []
        value = B.mix(ids.astype(np.uint64) + np.uint64(0x51ED2701))
        for prime, base in zip(PRIMES, BASES):
            p = np.uint64(prime)
            power = np.ones(self.n + 1, np.uint64)
            size = 1
            while size <= self.n:  # by doubling
                more = min(size, self.n + 1 - size)
                step = np.uint64(pow(base, size, prime))
                power[size : size + more] = power[:more] * step % p
                size += more
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(value % p * power[:-1] % p, out=total[1:])
            self.powers.append(power)
            self.sums.append(total % p)
        self._listed: list[list[int]] | None = None

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words from i and from j on (i <= j) are alike for ``size`` words, by hash."""
        out = np.ones(len(i), bool)
        for prime, power, total in zip(PRIMES, self.powers, self.sums):
            p = np.uint64(prime)
            a = (total[i + size] + p - total[i]) % p * power[j - i] % p
            out &= a == (total[j + size] + p - total[j]) % p
        return out

    def common(self, i: np.ndarray, j: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many words from i and j on (i < j) are alike, or up to and without them."""
        most = i if backward else self.n - j
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) // 2
            back = mid if backward else 0
            good = self.equal(i[open_] - back, j[open_] - back, mid)
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good] - 1
        return low

    def _first_difference(self, i: int, j: int) -> int:
        """The same for one pair: doubling, then halving."""
        if self._listed is None:
            self._listed = [x.tolist() for x in (*self.powers, *self.sums)]
        pa_, pb, sa, sb = self._listed
        p, q = PRIMES
        a, b = pa_[j - i], pb[j - i]
        sai, sbi, saj, sbj = sa[i], sb[i], sa[j], sb[j]
        most, low, step = self.n - j, 0, 4
        high = most
        while low < high:
            mid = min(low + step, high) if step else (low + high + 1) // 2
            if (sa[i + mid] - sai) * a % p == (sa[j + mid] - saj) % p and (sb[i + mid] - sbi) * b % q == (sb[j + mid] - sbj) % q:
                low = mid
                step *= 2
            else:
                high, step = mid - 1, 0
        return low

    def lyndon(self, reverse: bool) -> np.ndarray:
        """Length of the longest Lyndon word that starts at each place."""
        words, n = self.words, self.n
        sign = -1 if reverse else 1
        key = [sign * w for w in words]
        after = [n] * n  # the next smaller suffix
        difference = self._first_difference
        for i in range(n - 1, -1, -1):
            own, j = key[i], i + 1
            while j < n:  # the stack: the next start, and what is left below it
                other = key[j]
                if other == own:
                    size = difference(i, j)
                    if j + size == n:  # the shorter suffix is the smaller one
                        break
                    other, mine = key[j + size], key[i + size]
                    if other == mine:
                        raise ArithmeticError("rolling hashes misled the comparison of two suffixes")
                    if other < mine:
                        break
                elif other < own:
                    break
                j = after[j]
            after[i] = j
        return np.array(after, np.int64) - np.arange(n)

    def runs(self, least: int, times: int) -> np.ndarray:
        """(start, length, period) of all runs, by start and period."""
        found = []
        place = np.arange(self.n)
        for reverse in (False, True):
            period = self.lyndon(reverse)
            fits = np.flatnonzero(place + 2 * period <= self.n)
            fits = fits[self.equal(fits, fits + period[fits], period[fits])]
            q = period[fits]
            right = self.common(fits, fits + q)
            left = self.common(fits, fits + q, backward=True)
            found.append(np.stack([fits - left, left + q + right, q], 1))
        every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        every = every[every[:, 1] >= np.maximum(least, times * every[:, 2])]
        for start, size, q in every.tolist():
            end = start + size
            whole = np.array_equal(self.ids[start : end - q], self.ids[start + q : end])
            open_ = (start > 0 and self.words[start - 1] == self.words[start - 1 + q]) or (end < self.n and self.words[end] == self.words[end - q])
            if not whole or open_:
                raise ArithmeticError("rolling hashes misled the extension of a run")
        return every


def text_runs(buf: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words' starts, words' ends, rows' first words, each run's row, runs) of texts."""
    starts, ends, first = B.words(buf, offsets)
    rows, runs = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    if len(starts):
        ids = _numbers(buf, starts, ends)
        for lo, hi in zip(*(x.tolist() for x in repetitive(ids, first, least, times))):
            got = Stretch(ids[lo:hi]).runs(least, times)
            row = int(np.searchsorted(first, lo, "right")) - 1
            got[:, 0] += lo - first[row]
            rows.append(np.full(len(got), row))
            runs.append(got)
    return starts, ends, first, np.concatenate(rows), np.concatenate(runs)


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, runs (start word, length and period in words, by start, then
    period), kept: the words joined by one space, without those that a run holds after its
    first period.

    Null and empty texts have no words and no runs. Rows that repeat an id, or have none,
    are rows of their own. An empty table gives an empty one. Other columns are not read.
    A text of any length is taken whole.
    """
    if least < 1 or times < 3:
        raise ValueError("a run has three periods at the least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text", owner="periodic"):
                starts, ends, first, row, runs = text_runs(buf, offsets, least, times)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, first[row] + runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, first[row] + runs[:, 0] + runs[:, 1], -1)
                stay = np.cumsum(change)[:-1] == 0
                data, kept = buf.tobytes(), []
                for i in range(hi - lo):
                    own = data[offsets[i] : offsets[i + 1]].split()
                    a, b = int(first[i]), int(first[i + 1])
                    kept.append(b" ".join(compress(own, stay[a:b].tolist()) if not stay[a:b].all() else own))
                listed = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], ["start", "length", "period"]),
                )
                yield pa.record_batch([batch.column("id").slice(lo, hi - lo), pa.array(np.diff(first)), listed, pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "kept"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string").withColumnRenamed("id", id_col)


def strongest(runs: str = "runs") -> Column:
    """The run of the greatest length by period; of equals the first, then the one of the smaller period."""
    return F.expr(f"aggregate({runs}, {runs}[0], (best, x) -> IF(x.length * best.period > best.length * x.period, x, best))")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what ``find`` gives."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = found.withColumn("best", F.when(F.size("runs") > 0, strongest()))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def bent(docs: DataFrame) -> DataFrame:
    """The documents with a tenth of them made periodic: with h the id's CRC-32 and
    g = h div 10, where h ends in 0 each word from a = g mod n on stands for word
    a + (its distance from a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null id bends
    nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    some = "h % 10 = 0 AND n > 0"
    rows = rows.withColumn("a", F.expr(f"IF({some}, (h div 10) % n, NULL)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    again = "flatten(array_repeat(slice(words, CAST(a AS INT) + 1, CAST(p AS INT)), CAST((n - a + p - 1) div p AS INT)))"
    made = F.expr(f"array_join(slice(concat(slice(words, 1, CAST(a AS INT)), {again}), 1, n), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def brute_force(words: list[str], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Every period against every place, for tests: (start, length, period) of all runs."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)  # the smallest period comes first
    return sorted((s, size, q) for (s, size), q in found.items())


def oracle_sql() -> str:
    """The same by islands of words that equal the word a distance further, for every
    distance at which a gram of the text occurs again."""
    gram = _gram_length(LEAST, TIMES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, CAST(doc_id AS VARCHAR) AS s FROM documents),
bits AS (
  SELECT r, flatten(list_transform(range(1, length(s) + 1), lambda i: list_transform(range(8), lambda k: (ascii(s[i]) >> k) & 1))) AS b FROM d WHERE s IS NOT NULL),
hashed AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM bits),
placed AS (
  SELECT r, doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d LEFT JOIN hashed USING (r)),
periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
t AS (
  SELECT r, doc_id, n,
         CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % p END)]) END AS w
  FROM periods),
grams AS (SELECT r, i, array_to_string(w[i + 1:i + {gram}], ' ') AS g FROM t, unnest(range(greatest(n - {gram - 1}, 0))) AS u(i)),
far AS (SELECT DISTINCT x.r, y.i - x.i AS q FROM grams AS x JOIN grams AS y ON x.r = y.r AND x.g = y.g AND y.i > x.i),
alike AS (
  SELECT t.r, q, i, i - row_number() OVER (PARTITION BY t.r, q ORDER BY i) AS island
  FROM far JOIN t USING (r), unnest(range(n - q)) AS u(i) WHERE {TIMES} * q <= n AND w[i + 1] = w[i + q + 1]),
islands AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM alike GROUP BY r, q, island),
runs AS (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest({LEAST}, {TIMES} * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
lost AS (SELECT r, list(i) AS x FROM gone GROUP BY r),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         list({{'start': start, 'length': length, 'period': period}} ORDER BY length::DOUBLE / period DESC, start, period)[1] AS best
  FROM runs GROUP BY r),
kept AS (
  SELECT t.r, array_to_string(list_transform(list_filter(range(n), lambda i: NOT list_contains(coalesce(x, []), i)), lambda i: w[i + 1]), ' ') AS k
  FROM t LEFT JOIN lost USING (r))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(k) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) JOIN kept USING (r)"""
