"""Reports and cards as nested rows and sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import numbers as N
from tallyforge.functions import text as X
from tallyforge.operators import audit


def letter_actions(timeline: DataFrame) -> DataFrame:
    """A card for each obligation, dated first, undated ones too."""
    # undated ones come after the last day that can be told
    lead = F.coalesce(F.unix_date("due.date"), F.lit(2**31 - 1))
    timeline = audit.numbered(timeline, "place", lead, "kind", "party")
    place = F.col("place").cast("string")
    when = F.when(F.col("due.date").isNull(), F.concat(F.lit("no date: "), F.col("deadline"))).otherwise(D.in_words(F.col("due.date")))
    return timeline.select(F.concat(F.lit("act-"), F.lpad(place, F.greatest(F.length(place), F.lit(2)), F.lit("0"))).alias("action_id"), F.concat(X.term_label(F.col("kind")), F.lit(" for "), "party").alias("title"), when.alias("when"), F.col("due.date").alias("due"), F.map_from_arrays(F.array(F.lit("confidence"), F.lit("passages")), F.array(F.col("confidence"), F.size("evidence").cast("string"))).alias("evidence"))


def letter_report(timeline: DataFrame) -> DataFrame:
    return timeline.agg(F.count("*").alias("obligations"), F.count_if(F.col("due.date").isNotNull()).alias("dated"), F.count_if(F.col("due.kind") == "worked_out").alias("worked_out"), F.count_if(F.col("confidence") == "low").alias("uncertain"))


def comparison_report(differences: DataFrame, refused: DataFrame) -> DataFrame:
    """Counts per change, and of refusals."""
    counts = differences.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("changed", "added", "removed", "unchanged")])
    return counts.crossJoin(refused.agg(F.count("*").alias("not_compared")))  # two single rows


def audit_summary(report: DataFrame) -> DataFrame:
    """Adds a sentence or two made of the counts."""
    n, rises, review = F.col("recurring"), F.col("price_rises"), F.col("needs_review")
    first = F.when(n == 0, "No repeating payments were found.").otherwise(F.concat(X.count_noun(n, "repeating payment", "repeating payments"), F.lit(" cost "), N.money(F.col("annualised_total")), F.lit(" a year, "), N.money(F.col("monthly_equivalent")), F.lit(" a month.")))
    second = F.when(rises > 0, F.concat(X.count_noun(rises, "price", "prices"), F.lit(" went up.")))
    third = F.when(review > 0, F.concat(X.count_noun(review, "item needs", "items need"), F.lit(" a look, and isn't counted.")))
    return report.withColumn("summary", F.concat_ws(" ", first, second, third))


def payments_line(evidence: Column, rise_when: Column) -> Column:
    """Amounts in order of date, where they are few, with a mark at the rise."""
    shown = F.transform(F.array_sort(evidence), lambda p: F.concat(F.when(p["date"] == rise_when, F.lit("▲ ")).otherwise(""), N.money(p["amount"])))
    return F.when(F.size(evidence).between(2, 24), F.array_join(shown, " · "))


def html_page(title: str, rows: list[dict]) -> str:
    """A small page that loads nothing from elsewhere."""
    import html

    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "".join(f"<th>{html.escape(k)}</th>" for k in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(map(cell, r.values())) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"


def escaped(c: Column) -> Column:
    """Text as a page shows it; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def pages(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], title: str) -> DataFrame:
    """(key, html): a small page a key that loads nothing, its rows in order as a table.

    Columns are shown as text, escaped; a page holds its key's rows, so a report is as
    large as what it reports on.
    """
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("line")))).alias("lines"))
    name = F.concat(F.lit(title), F.lit(" "), escaped(F.col(key)))
    head = "".join(f"<th>{c}</th>" for c in columns)
    html = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), name, F.lit(f"</title><table><tr>{head}</tr>"), F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("</table>"))
    return held.select(key, html.alias("html"))


def write_pages(made: DataFrame, key: str, root: str) -> None:
    """One file a page from the executors, each held to load nothing; all of them or none."""
    from tallyforge.sources.files import write_files

    write_files(made.select(F.concat(F.col(key).cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("content")), root, check="self_contained")


def assert_self_contained(page: str) -> None:
    """Raises if a page names anything to load: by a real parser, entities decoded."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        style = False

        def handle_starttag(self, tag: str, attrs: list) -> None:
            self.style = tag == "style"
            for name, value in attrs:
                value = (value or "").strip().lower()
                if name in ("src", "href", "data", "poster", "srcset", "action", "background", "xlink:href") and value and not value.startswith(("#", "data:")):
                    raise ValueError(f"{tag} loads {value}")
                if name == "style" and ("url(" in value or "@import" in value):
                    raise ValueError(f"{tag} has a style that loads")

        def handle_endtag(self, tag: str) -> None:
            self.style = False

        def handle_data(self, data: str) -> None:
            if self.style and ("url(" in data.lower() or "@import" in data.lower()):
                raise ValueError("a style loads")

    Reader(convert_charrefs=True).feed(page)


def numeric_columns(rows: Column) -> Column:
    """For each column of a table (array of rows of cells), whether all cells below its
    head, and one at least, are figures."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    body = F.slice(rows, F.lit(2), F.size(rows))

    def column(i: Column) -> Column:
        held = F.filter(F.transform(body, lambda r: F.try_element_at(r, i)), lambda c: c.isNotNull() & (F.trim(c) != ""))
        return (F.size(held) > 0) & F.forall(held, lambda c: X.figure_cell(c))

    return F.transform(F.sequence(F.lit(1), width), column)
