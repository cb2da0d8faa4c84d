"""Damerau-Levenshtein similarity, which Spark has no expression for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import comparison_key


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein: edits may fall between transposed letters."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


#: Cells of distance tables that are filled at a time.
CELLS = 1 << 22


def _codes(texts: list[str], blank: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(size.max(initial=0))), blank, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """``distance`` of many pairs: one cell of all their tables at a time, in blocks of pairs
    of about the same length."""
    out = np.zeros(len(a), np.int64)
    cells = np.array([(len(x) + 2) * (len(y) + 2) for x, y in zip(a, b)], np.int64)
    order, lo = np.argsort(cells, kind="stable"), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * (max(len(a[i]) for i in order[[lo, hi]]) + 2) * (max(len(b[i]) for i in order[[lo, hi]]) + 2) <= CELLS and cells[order[hi]] <= 2 * cells[order[lo]] + 64:
            hi += 1
        own = order[lo:hi]
        out[own] = _tables([a[i] for i in own], [b[i] for i in own])
        lo = hi
    return out


def _tables(a: list[str], b: list[str]) -> np.ndarray:
    x, size_x = _codes(a, -1)
    y, size_y = _codes(b, -2)
    n, rows = len(a), np.arange(len(a))
    d = np.full((n, x.shape[1] + 2, y.shape[1] + 2), x.shape[1] + y.shape[1], np.int32)
    d[:, 1:, 1] = np.arange(x.shape[1] + 1)
    d[:, 1, 1:] = np.arange(y.shape[1] + 1)
    last = np.zeros(y.shape, np.int64)  # the last letter of a, up to here, that is like each of b
    for i in range(1, x.shape[1] + 1):
        same = x[:, i - 1 : i] == y
        match = np.zeros(n, np.int64)
        for j in range(1, y.shape[1] + 1):
            k = last[:, j - 1]
            moved = d[rows, k, match] + (i - k) + (j - match - 1)
            d[:, i + 1, j + 1] = np.minimum(np.minimum(d[:, i, j] + ~same[:, j - 1], np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1), moved)
            match[same[:, j - 1]] = j
        last[same] = i
    return d[rows, size_x + 1, size_y + 1]


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    held = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    pairs = pd.DataFrame({"x": a.to_numpy()[held], "y": b.to_numpy()[held]})
    known = pairs.drop_duplicates()
    x, y = known["x"].tolist(), known["y"].tolist()
    most = np.array([max(len(p), len(q)) for p, q in zip(x, y)], np.float64)
    value = np.where(most > 0, 1 - distances(x, y) / np.maximum(most, 1), 1.0)
    out[held] = pairs.merge(known.assign(value=value), on=["x", "y"], how="left")["value"].to_numpy()
    return pd.Series(out).where(~np.isnan(out), None).astype("float64")


def similarity(a: Column, b: Column) -> Column:
    """1 less the distance of the comparison keys over the longer one's length.

    Pairs of equal keys, or one plain edit apart, are settled by built-in expressions;
    only others go to Python.
    """
    x, y = comparison_key(a), comparison_key(b)
    return _settled(x, y, None)


def _settled(x: Column, y: Column, threshold: float | None) -> Column:
    most = F.greatest(F.length(x), F.length(y))
    edits = F.levenshtein(x, y)
    # a transposition is two edits at most, so the distance is from half of the edits up to them
    sure = edits <= 1
    value = F.when(most == 0, 1.0).otherwise(1 - edits / most)
    if threshold is not None:
        sure = sure | (value >= threshold) | (1 - F.ceil(edits / 2) / most < threshold)
    rest = F.when(~F.coalesce(sure, F.lit(False)), x)
    return F.when(sure, value).otherwise(F.pandas_udf(_similarities, "double")(rest, y))


def fuzzy_match(a: Column, b: Column, threshold: float) -> Column:
    """Whether the similarity is the threshold or more; most pairs need no exact distance."""
    x, y = comparison_key(a), comparison_key(b)
    return _settled(x, y, threshold) >= threshold


def keys_similarity(x: Column, y: Column, threshold: float) -> Column:
    """The exact similarity of two comparison keys where it may reach the threshold, else
    null: a banded distance shows first whether twice the edits could do."""
    most = F.greatest(F.length(x), F.length(y))
    edits = F.levenshtein(x, y)
    possible = 1 - F.ceil(edits / 2) / most >= threshold - 1e-9
    plain = edits <= 1  # no letters can have traded places
    rest = F.when(possible & ~plain, x)
    return F.when(plain, 1 - edits / most).otherwise(F.pandas_udf(_similarities, "double")(rest, y))


EXACT = 1.0


def tolerance(written: str) -> float:
    """The threshold that a tolerance names: ``exact``, or ``fuzzy:`` and a share in (0, 1]."""
    kind, _, share = written.partition(":")
    if written == "exact":
        return EXACT
    try:
        value = float(share)
    except ValueError:
        value = -1.0
    if kind != "fuzzy" or not 0 < value <= 1:
        raise ValueError(f"{written!r} is no tolerance")
    return value
