"""Statements printed as tables: positioned text to payments and rejects.

Geometry is read per page, in Python, many pages a batch: which row heads the table, and
which column each figure stands in. Everything that follows, dates, amounts, directions and the reasons
for rejects, are expressions over all pages at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions.text import DECIMAL
from tallyforge.operators.geometry import ROW_TOLERANCE, convention_of, direction_of, placed, row_heights, sign_vote

# What heads the two kinds of tables, left to right, and how dates are written.
SPLIT = ("date", "description", "paid out", "paid in", "balance")
SIGNED = ("date", "description", "amount", "balance")
UNBALANCED = ("date", "description", "amount")
DATES = ("dd MMM yy", "dd MMM yyyy", "dd/MM/yyyy")
ROWS = "doc string, page int, row_no int, layout string, date_text string, merchant string, paid_out array<string>, paid_in array<string>, amounts array<string>, balances array<string>"


def extent(row: list[tuple[str, float, float]], phrase: str) -> tuple[float, float] | None:
    """Left and right edge of the first run of whole fragments that spells the phrase."""
    words = [(w, i) for i, (text, _, _) in enumerate(row) for w in text.lower().split()]
    wanted = phrase.split()
    for at in range(len(words) - len(wanted) + 1):
        run = words[at : at + len(wanted)]
        first, last = run[0][1], run[-1][1]
        whole = (at == 0 or words[at - 1][1] != first) and (at + len(wanted) == len(words) or words[at + len(wanted)][1] != last)
        if whole and [w for w, _ in run] == wanted:
            return row[first][1], row[last][2]
    return None


def heading(row: list[tuple[str, float, float]], phrases: tuple[str, ...]) -> list[tuple[float, float]] | None:
    """Extents of all phrases, if they stand in order without overlap."""
    found = []
    for p in phrases:
        if (f := extent(row, p)) is None:
            return None
        found.append(f)
    edges = [x for f in found for x in f]
    return found if all(a < b for a, b in zip(edges, edges[1:])) else None


def column_of(right: float, edges: list[float]) -> int | None:
    """The nearest right edge, within a third of the narrowest gap between edges."""
    near = min(range(len(edges)), key=lambda i: abs(right - edges[i]))
    narrow = min(abs(b - a) for a, b in zip(edges, edges[1:]))
    return near if abs(right - edges[near]) <= narrow / 3 else None


#: Fragments that are taken out of Arrow at a time.
CHUNK = 50_000


def _rows(page: list[tuple]) -> list[list[tuple[str, float, float]]]:
    """A page's fragments (frag_no, text, x, right, y), in order, as rows from top to bottom."""
    heights = row_heights([f[4] for f in page])
    by_row: dict[int, list[tuple]] = {}
    for (row, _), f in zip(heights, page):
        by_row.setdefault(row, []).append(f)
    tops = {row: y for row, y in heights}
    order = sorted(by_row, key=lambda row: (tops[row] is None, -(tops[row] or 0.0)))
    nan = float("nan")
    number = lambda v: nan if v is None else v
    return [[(text.strip(), number(x), number(right)) for _, text, x, right, _ in sorted(by_row[row], key=lambda f: (f[2] is None or f[2] != f[2], f[2] or 0.0))] for row in order]


def _page(page: list[tuple]) -> list[tuple]:
    """(row_no, layout, date_text, merchant, paid_out, paid_in, amounts, balances) of a page's rows."""
    rows = _rows(page)
    for at, row in enumerate(rows):
        layout, cols = next(((n, h) for n, p in (("split", SPLIT), ("signed", SIGNED)) if (h := heading(row, p))), (None, None))
        if layout:
            break
    else:
        refused = any(heading(row, UNBALANCED) for row in rows)
        return [(None, "unbalanced" if refused else "none", None, None, [], [], [], [])]
    edges = [c[1] for c in cols[2:]]
    date_limit, left = (cols[0][1] + cols[1][0]) / 2, cols[1][0]
    default_limit = (cols[1][1] + edges[0]) / 2
    out = []
    for no, row in enumerate(rows[at + 1 :], at + 2):
        cells: list[list[str]] = [[] for _ in edges]
        money_left = None
        for text, x, right in row:
            c = column_of(right, edges)
            if c is not None:
                money_left = x if money_left is None else min(money_left, x)
                cells[c].append(text)
        limit = default_limit if money_left is None else money_left
        date = " ".join(t for t, x, _ in row if x < date_limit)
        merchant = " ".join(t for t, x, _ in row if left - ROW_TOLERANCE <= x < limit)
        split = cells if layout == "split" else [[], [], cells[1]]
        out.append((no, layout, date, merchant, split[0], split[1], cells[0] if layout == "signed" else [], split[2]))
    return out


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many pages (doc, page, fragments) at a time, a chunk of whole pages a batch."""
    names = [c.split(" ")[0] for c in ROWS.split(", ")]
    texts = pa.list_(pa.string())
    types = (pa.int32(), pa.string(), pa.string(), pa.string(), texts, texts, texts, texts)
    for batch in batches:
        ends = batch.column("fragments").offsets.to_pylist()
        whole, first = batch.column("fragments").values, 0
        while first < batch.num_rows:
            last = first + 1
            while last < batch.num_rows and ends[last + 1] - ends[first] <= CHUNK:
                last += 1
            held = whole.slice(ends[first], ends[last] - ends[first])
            columns = (held.field(c).to_pylist() for c in ("frag_no", "text", "x", "right", "y"))
            found, at, out = list(zip(*columns)), [], []
            for i in range(first, last):
                rows = _page(found[ends[i] - ends[first] : ends[i + 1] - ends[first]])
                at += [i] * len(rows)
                out += rows
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc", "page")]
            yield pa.record_batch([*keys, *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], names)
            first = last


def reconstructed(fragments: DataFrame) -> DataFrame:
    """(doc, page, row_no, date, raw_merchant, amount, direction, reason) of all dated rows.

    Reasons: no_amount, two_amounts, zero_amount, no_merchant; undetermined, for signed
    tables whose balances settle no sign (or that have none); no_layout, for pages that
    no table heads (row_no null). Good rows have none.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    shown = placed(fragments).select(F.col("doc").cast("string").alias("doc"), F.col("page").cast("int").alias("page"), F.struct("frag_no", "text", number("x"), number("right"), number("y")).alias("f"))
    pages = shown.groupBy("doc", "page").agg(F.array_sort(F.collect_list("f")).alias("fragments"))
    rows = pages.mapInArrow(_pages, ROWS)
    figure = lambda c: F.replace(F.regexp_replace(c, "^[£$€]", ""), F.lit(","), F.lit(""))
    figures = lambda c: F.filter(F.transform(c, figure), lambda x: x.rlike(DECIMAL))
    rows = rows.withColumns({"date": D.parse_date(F.col("date_text"), DATES), **{c: figures(F.col(c)) for c in ("paid_out", "paid_in", "amounts", "balances")}})
    rows = rows.where("date IS NOT NULL OR row_no IS NULL")
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1).try_cast("decimal(18,2)"))
    # by windows, so that pages are read once: a join would read them for each of its sides
    signed = (F.col("layout") == "signed") & (F.size("amounts") == 1)
    order = Window.partitionBy("doc", signed).orderBy("page", "row_no")
    step = one(F.col("balances")) - F.lag(one(F.col("balances"))).over(order)
    rows = rows.withColumn("vote", F.when(signed, sign_vote(step, one(F.col("amounts")))))
    whole = Window.partitionBy("doc")
    votes = lambda v: F.count_if(F.col("vote") == v).over(whole)
    rows = rows.withColumn("convention", convention_of(votes("adds"), votes("subtracts")))
    n = F.size("paid_out") + F.size("paid_in") + F.size("amounts")
    value = F.coalesce(one(F.col("paid_out")), one(F.col("paid_in")), one(F.col("amounts")))
    direction = F.when(F.size("paid_out") == 1, "debit").when(F.size("paid_in") == 1, "credit").otherwise(direction_of(F.col("convention"), value))
    reason = (
        F.when(F.col("layout") == "unbalanced", "undetermined")
        .when(F.col("layout") == "none", "no_layout")
        .when(n == 0, "no_amount")
        .when(n > 1, "two_amounts")
        .when(value == 0, "zero_amount")
        .when(F.trim("merchant") == "", "no_merchant")
        .when(direction.isNull(), "undetermined")
    )
    return rows.select("doc", "page", "row_no", "date", F.col("merchant").alias("raw_merchant"), F.abs(value).alias("amount"), direction.alias("direction"), reason.alias("reason"))
