"""Statement exports to payments and rejects.

Files of any layouts and column orders are one scan: every file's own header (or the
shape of its cells) picks its layout and the places of its columns, in a small table by
file that is joined back to the rows. ``reason`` tells good rows (null) from rejects;
nothing raises on a bad row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions.text import DECIMAL
from tallyforge.sources.documents import placed


@dataclass(frozen=True)
class Layout:
    """Headers of a kind of export. ``amount`` is signed, with the direction of positive
    values; or ``debit`` and ``credit`` are split. ``needs`` must all be there too."""

    name: str
    date: str
    formats: tuple[str, ...]
    merchant: str
    amount: str | None = None
    positive: str = "credit"
    debit: str | None = None
    credit: str | None = None
    needs: tuple[str, ...] = ()


# The headers and date forms of exports; the first that fits is taken.
LAYOUTS = (
    Layout("app with emoji", "Date", ("dd/MM/yyyy",), "Name", "Amount", needs=("Transaction ID", "Emoji", "Category")),
    Layout("app with counter party", "Date", ("dd/MM/yyyy",), "Counter Party", "Amount (GBP)"),
    Layout("paid out and in", "Date", ("dd MMM yy", "dd MMM yyyy", "dd/MM/yyyy"), "Description", debit="Paid Out", credit="Paid In"),
    Layout("inflow", "Date", ("dd MMM yy", "dd/MM/yyyy", "yyyy-MM-dd"), "Payee", "Inflow"),
    Layout("outflow", "Date", ("dd-MMM-yy", "dd-MMM-yyyy", "dd/MM/yyyy", "dd MMM yy"), "Payee", "Outflow", positive="debit"),
    Layout("signed", "Date", ("yyyy-MM-dd",), "Description", "Amount"),
    Layout("split", "Date", ("yyyy-MM-dd",), "Description", debit="Debit", credit="Credit"),
)
# Columns by position, for exports whose headers change.
OLD_EXPORT = (12, 1, ("yyyy-MM-dd HH:mm:ss Z",), 8, 2, "credit")
CARD_EXPORT = ((20, 21), 2, ("dd/MM/yyyy",), 3, 4, "debit")


_ROLES = ("date", "merchant", "amount", "debit", "credit")


class UnknownLayout(ValueError):
    """No layout fits the columns."""


def normalise_header(name: str) -> str:
    return name.strip().lstrip("\ufeff").strip().lower()


def named_layout(headers: Sequence[str]) -> tuple[Layout, dict[str, int]] | None:
    """The first layout whose headers are all there, with their places."""
    at = {normalise_header(h): i for i, h in reversed(list(enumerate(headers)))}
    for layout in LAYOUTS:
        wanted = [layout.date, layout.merchant, layout.amount, layout.debit, layout.credit, *layout.needs]
        if all(normalise_header(h) in at for h in wanted if h):
            return layout, {h: at[normalise_header(h)] for h in wanted if h}
    return None


def _currency(c: Column) -> Column:
    return F.trim(c).rlike("^[A-Z]{3}$")


def _decimal(c: Column) -> Column:
    return F.trim(c).rlike(DECIMAL)


def positional_layout(rows: DataFrame) -> Layout | None:
    """A layout by cell shapes, if any row has them."""
    n = len(rows.columns)
    c = [F.coalesce(F.col(x), F.lit("")) for x in rows.columns]
    if n == 12:
        fits = D.parse_date(F.trim(c[1]), OLD_EXPORT[2]).isNotNull() & _decimal(c[2]) & _currency(c[3]) & _decimal(c[4]) & _currency(c[5]) & (F.trim(c[8]) != "")
        if rows.where(fits).take(1):
            return Layout("twelve columns", rows.columns[1], OLD_EXPORT[2], rows.columns[8], rows.columns[2])
    if n in CARD_EXPORT[0]:
        fits = D.parse_date(F.trim(c[2]), CARD_EXPORT[2]).isNotNull() & (F.trim(c[3]) != "") & _decimal(c[4]) & _currency(c[5]) & _decimal(c[6]) & _currency(c[7]) & _decimal(c[8]) & D.parse_date(F.trim(c[9]), CARD_EXPORT[2]).isNotNull()
        if rows.where(fits).take(1):
            return Layout("card", rows.columns[2], CARD_EXPORT[2], rows.columns[3], rows.columns[4], positive="debit")
    return None


def _judged(date: Column, cell: dict[str, Column], split: Column, positive: Column) -> dict[str, Column]:
    """date, raw_merchant, amount (a magnitude), direction and reason of a row, from its
    trimmed cells by role; ``split`` tells debit and credit cells from a signed amount, whose
    direction above zero is ``positive``.

    Reasons in order: bad_date, no_merchant, two_amounts, no_amount, bad_amount,
    zero_amount. A signed amount below zero turns the direction; split columns keep theirs.
    Zero is judged as written: an amount that only rounds to 0.00 is a payment.
    """
    debit, credit = cell["debit"] != "", cell["credit"] != ""
    text = F.when(split, F.when(debit, cell["debit"]).otherwise(cell["credit"])).otherwise(cell["amount"])
    credited = F.when(split, ~debit).otherwise((positive == "credit") != text.startswith("-"))
    value = F.when(text.rlike(DECIMAL), text.try_cast("decimal(18,2)"))
    reason = F.when(date.isNull(), "bad_date").when(cell["merchant"] == "", "no_merchant").when(split & debit & credit, "two_amounts").when(text == "", "no_amount").when(value.isNull(), "bad_amount").when(~text.rlike("[1-9]"), "zero_amount")
    return {"date": date, "raw_merchant": cell["merchant"], "amount": F.abs(value), "direction": F.when(credited, "credit").otherwise("debit"), "reason": reason}


def annotated(rows: DataFrame, layout: Layout, columns: dict[str, str]) -> DataFrame:
    """``rows`` of one layout with date, raw_merchant, amount, direction and reason."""
    cell = {r: F.trim(F.coalesce(F.col(f"`{columns[h]}`"), F.lit(""))) if (h := getattr(layout, r)) else F.lit("") for r in _ROLES}
    return rows.withColumns(_judged(D.parse_date(cell["date"], layout.formats), cell, F.lit(layout.amount is None), F.lit(layout.positive)))


def read_rows(raw: DataFrame) -> DataFrame:
    """``raw`` (columns named as a file's header has them) as ``annotated`` rows, by the
    first named layout that fits the header, else by the cells' shapes."""
    named = named_layout(raw.columns)
    if named:
        layout, at = named
        return annotated(raw, layout, {h: raw.columns[i] for h, i in at.items()})
    layout = positional_layout(raw)
    if layout is None:
        raise UnknownLayout(f"no layout has the columns {raw.columns}")
    return annotated(raw, layout, {h: h for h in (layout.date, layout.merchant, layout.amount) if h})


#: Columns of a file that are read.
WIDTH = 64
_OLD = Layout("twelve columns", "1", OLD_EXPORT[2], str(OLD_EXPORT[3]), str(OLD_EXPORT[4]), positive=OLD_EXPORT[5])
_CARD = Layout("card", str(CARD_EXPORT[1]), CARD_EXPORT[2], str(CARD_EXPORT[3]), str(CARD_EXPORT[4]), positive=CARD_EXPORT[5])
_KINDS = (*LAYOUTS, _OLD, _CARD)


def _places(cells: Sequence[Column]) -> Column:
    """A header's number: the kind of the first named layout that it has whole, from 1, then
    the place of each role from 1, a byte each; zero where there is none.

    What can't be a header is told by looking for a date's name, which every layout has, so
    that all rows can be asked; and a number is a state that a hash aggregate can hold."""
    clean = F.transform(F.array(*cells), lambda h: F.lower(F.trim(F.regexp_replace(F.trim(h), "^\ufeff+", ""))))
    found = []
    for k, layout in enumerate(LAYOUTS):
        wanted = [getattr(layout, r) for r in _ROLES]
        at = [F.array_position(clean, normalise_header(h)) if h else F.lit(0).cast("long") for h in wanted]
        there = [F.array_position(clean, normalise_header(h)) > 0 for h in (*filter(None, wanted), *layout.needs)]
        found.append(F.when(reduce(and_, there), reduce(add, [F.shiftleft(a, 8 * i) for i, a in enumerate(at, 1)], F.lit(k + 1).cast("long"))))
    line = F.lower(F.concat_ws(",", *cells))
    may_be = reduce(or_, [line.contains(normalise_header(d)) for d in dict.fromkeys(x.date for x in LAYOUTS)])
    return F.coalesce(F.when(may_be, F.coalesce(*found)), F.lit(0).cast("long"))


def _placed(number: Column) -> Column:
    """(kind, place of each role) of such a number."""
    byte = lambda i: F.shiftright(number, 8 * i).bitwiseAND(255)
    at = [F.when(byte(i) > 0, byte(i)).alias(r) for i, r in enumerate(_ROLES, 1)]
    return F.when(byte(0) > 0, F.struct((byte(0) - 1).cast("int").alias("kind"), *at))


def _fixed(k: int) -> Column:
    """The same of an export that is told by position."""
    layout = _KINDS[k]
    at = [F.lit(int(h) + 1).cast("long") if (h := getattr(layout, r)) else F.lit(None).cast("long") for r in _ROLES]
    return F.struct(F.lit(k).alias("kind"), *[a.alias(r) for a, r in zip(at, _ROLES)])


def _fits(cells: Sequence[Column]) -> dict[int, Column]:
    """Whether a row has the shapes of an export that is told by position."""
    c = [F.trim(F.coalesce(cells[i], F.lit(""))) for i in range(10)]
    old = _currency(c[3]) & _currency(c[5]) & _decimal(c[2]) & _decimal(c[4]) & (c[8] != "") & D.parse_date(c[1], _OLD.formats).isNotNull()
    card = _currency(c[5]) & _currency(c[7]) & _decimal(c[4]) & _decimal(c[6]) & _decimal(c[8]) & (c[3] != "") & D.parse_date(c[2], _CARD.formats).isNotNull() & D.parse_date(c[9], _CARD.formats).isNotNull()
    return {len(LAYOUTS): old, len(LAYOUTS) + 1: card}


def scanned(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) of CSV files: their cells as text, with the file, the block of the
    file and a number that counts on inside the block; and for each block the rows before
    it in its file, its first number, and the file's layout and places (null: none fits)."""
    # a column more than is read: else Spark holds each row that has fewer for a bad one, and throws
    schema = ", ".join(f"c{i} string" for i in range(WIDTH + 1))
    read = spark.read.schema(schema).options(header="false", mode="PERMISSIVE", encoding="UTF-8", escape='"', nullValue="\x00")
    each = [F.col(f"c{i}") for i in range(WIDTH)]
    raw = read.csv(list(paths)).select(*each, F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("in_scan"))
    fits = _fits(each)
    widths = {len(LAYOUTS): (OLD_EXPORT[0],), len(LAYOUTS) + 1: CARD_EXPORT[0]}
    up_to = lambda w: each[w - 1].isNotNull() & F.coalesce(*each[w:]).isNull()  # noqa: E731  the last name's place
    wide = {k: reduce(or_, map(up_to, w)) for k, w in widths.items()}
    number = reduce(add, [F.shiftleft(w.cast("long"), 48 + i) for i, w in enumerate(wide.values())], _places(each))
    told = raw.groupBy("src_file", "block").agg(F.count("*").alias("n"), F.min("in_scan").alias("lead"), F.min_by(number, "in_scan").alias("head"), *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f"fits_{k}") for k, f in fits.items()])
    ahead = Window.partitionBy("src_file").orderBy("block")
    whole = Window.partitionBy("src_file")
    blocks = told.select("src_file", "block", "lead", F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.first("head").over(ahead).alias("head"), *[F.bool_or(f"fits_{k}").over(whole).alias(f"fits_{k}") for k in fits])
    at = F.coalesce(_placed(F.col("head")), *[F.when(F.col(f"fits_{k}") & (F.shiftright("head", 48 + i).bitwiseAND(1) == 1), _fixed(k)) for i, k in enumerate(wide)])
    rows = raw.select(F.array(*each).alias("cells"), "src_file", "block", "in_scan")
    return rows, blocks.select("src_file", "block", "lead", "before", at.alias("at"))


def read_all(spark: SparkSession, paths: Sequence[str], strict: bool = True) -> DataFrame:
    """Payments (reason null) and rejects of CSV exports of any layouts in one scan.

    Each file is read by its own header. Rows carry src_file, the layout's name and row_no
    (also as seq), which counts a file's records from 1, the header being the first,
    however the scan was split. A file that no layout fits is an error, or where that
    isn't asked for one reject (unknown_layout) at its header. Of a row's cells the first
    ``WIDTH`` are read. Files without a row give nothing.
    """
    rows, blocks = scanned(spark, paths)
    if strict:
        odd = blocks.where("at IS NULL").select("src_file").take(1)
        if odd:
            raise UnknownLayout(f"no layout has the columns of {odd[0][0]}")
    row_no = (F.col("before") + F.col("in_scan") - F.col("lead") + 1).cast("int")
    rows = rows.join(F.broadcast(blocks), ["src_file", "block"]).withColumn("row_no", row_no)
    rows = rows.where((F.col("row_no") > 1) == F.col("at").isNotNull()).where("at IS NOT NULL OR row_no = 1")
    kind = F.col("at.kind")
    of = lambda value: F.try_element_at(F.array(*[F.lit(value(x)) for x in _KINDS]), kind + 1)
    cell = {r: F.trim(F.coalesce(F.try_element_at("cells", F.col(f"at.{r}").cast("int")), F.lit(""))) for r in _ROLES}
    rows = rows.select("src_file", "row_no", of(lambda x: x.name).alias("layout"), of(lambda x: x.amount is None).alias("split"), of(lambda x: x.positive).alias("positive"), kind.alias("kind"), *[c.alias(r) for r, c in cell.items()])
    forms = dict.fromkeys(x.formats for x in _KINDS)
    date = F.coalesce(*[F.when(F.col("kind").isin([k for k, x in enumerate(_KINDS) if x.formats == f]), D.parse_date(F.col("date"), f)) for f in forms])
    found = _judged(date, {r: F.col(r) for r in _ROLES}, F.col("split"), F.col("positive"))
    found["reason"] = F.when(F.col("kind").isNull(), "unknown_layout").otherwise(found["reason"])
    return rows.select("src_file", "layout", "row_no", F.col("row_no").cast("long").alias("seq"), *[c.alias(n) for n, c in found.items()])


def read_files(spark: SparkSession, paths: Sequence[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(payments, rejects) of ``read_all``; what reads both scans the files twice."""
    read = read_all(spark, paths, strict)
    good = read.where("reason IS NULL").select("src_file", "layout", "row_no", "seq", "date", "raw_merchant", "amount", "direction")
    return good, read.where("reason IS NOT NULL").select("src_file", "layout", "row_no", "seq", "reason", "raw_merchant")


def read_statement(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payments, rejects) of a CSV export, or of a folder of them."""
    return read_files(spark, [path])


def read_input(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """By extension: csv is read; positioned text of other kinds arrives as tables."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_statement(spark, path)
    raise UnknownLayout(f"{kind} files aren't read here; give their fragments as a table")


def read_folder(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(payments, rejects) of many exports in one scan, with part: each file's place in the list."""
    good, bad = read_files(spark, sorted(set(paths)))
    return placed(spark, good, paths, "part"), placed(spark, bad, paths, "part")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Statements that were read apart one after another, order kept by (part, row_no)."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
