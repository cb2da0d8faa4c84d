"""Date expressions: reading dates, counting deadlines, moving by periods."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import MONTHS

_GAP = r"[\s,.;:()]"
FULL_DATE = rf"(?<![^\s,.;:()])(\d{{1,2}})(?:st|nd|rd|th)?{_GAP}*((?i:{'|'.join(MONTHS)})){_GAP}+(\d{{4}})(?![^\s,.;:()])"
# Bands of days between payments, and what follows from a period.
PERIODS = (("weekly", 6, 8, 7, 52, 0), ("monthly", 27, 34, 30, 12, 1), ("quarterly", 84, 98, 91, 4, 3), ("yearly", 350, 380, 365, 1, 12))


#: The first two-digit year that is of the last century.
PIVOT = 70


def _lenient(form: str) -> list[str]:
    """A day or month number may have one digit, a month's name may be whole."""
    short = re.sub("dd", "d", re.sub("(?<!M)MM(?!M)", "M", form))
    return [short, short.replace("MMM", "MMMM")] if "MMM" in short else [short]


def parse_date(c: Column, formats: Sequence[str]) -> Column:
    """The first format that reads the value; times and offsets are dropped.

    Numbers of days and months may have one digit. Years of two digits from ``PIVOT`` on
    are of the last century.
    """

    def read(form: str) -> Column:
        date = F.try_to_timestamp(c, F.lit(form)).cast("date")
        if "yyyy" in form:
            return date
        return F.when(F.year(date) >= 2000 + PIVOT, F.add_months(date, -1200)).otherwise(date)

    return F.coalesce(*[read(f) for form in formats for f in _lenient(form)])


def first_full_date(text: Column) -> Column:
    """The first day, month name and year in a text that make a date of 1900 to 2200."""
    found = F.regexp_extract_all(text, F.lit(FULL_DATE), F.lit(0))
    dates = F.transform(found, lambda x: F.try_to_timestamp(F.regexp_replace(x, FULL_DATE, "$1 $2 $3"), F.lit("d MMMM yyyy")).cast("date"))
    good = F.filter(dates, lambda d: d.isNotNull() & F.year(d).between(1900, 2200))
    return F.try_element_at(good, F.lit(1))


def within_days(phrase: Column) -> Column:
    """N of ``within N day(s)`` after the first ``within``; nothing else is read."""
    rest = F.regexp_extract(F.lower(phrase), r"(?s)^(?:(?!within).)*within\s+\+?(\d{1,9})\s+(?:days|day)(?:\s|$)", 1)
    return F.when(rest != "", rest).cast("int")


def resolve_deadline(deadline: Column, anchor: Column, letter_date: Column, from_letter: str = "worked_out") -> Column:
    """struct(date, kind): a date that is written, or one counted from a base.

    A relative phrase counts from the anchor's date, else from a date in the phrase,
    else from the letter's; a written date is read, not computed.
    """
    days, month_end = within_days(deadline), F.lower(deadline).contains("end of the month")
    written, dated = first_full_date(deadline), F.coalesce(first_full_date(anchor), first_full_date(deadline))
    base = F.coalesce(dated, letter_date)
    counted = F.when(days.isNotNull(), F.date_add(base, days)).when(month_end, F.last_day(base))
    relative = days.isNotNull() | F.coalesce(month_end, F.lit(False))
    date = F.when(relative, counted).otherwise(written)
    kind = F.when(date.isNull(), F.lit(None)).when(~relative, "read").when(dated.isNotNull(), "worked_out").otherwise(from_letter)
    return F.struct(date.alias("date"), kind.alias("kind"))


def points_at_a_date(deadline: Column) -> Column:
    low = F.lower(deadline)
    return low.contains("the date") & low.rlike("beside|against|opposite|alongside|below|above|next to")


def band_of(days: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi, *_ in PERIODS:
        out = F.when(days.between(lo, hi), name).otherwise(out)
    return out


def _by_period(period: Column, place: int) -> Column:
    out = F.lit(None).cast("int")
    for row in PERIODS:
        out = F.when(period == row[0], row[place]).otherwise(out)
    return out


def nominal_days(period: Column) -> Column:
    return _by_period(period, 3)


def per_year(period: Column) -> Column:
    return _by_period(period, 4)


def add_period(date: Column, period: Column) -> Column:
    return F.when(period == "weekly", F.date_add(date, 7)).otherwise(F.add_months(date, _by_period(period, 5)))


def next_occurrence(last: Column, period: Column, today: Column) -> Column:
    """Strictly after today, by adding one period at a time (so month ends drift)."""
    steps = F.greatest(F.ceil(F.datediff(today, last) / F.when(period == "weekly", 7).when(period == "monthly", 28).when(period == "quarterly", 89).otherwise(365)), F.lit(0)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(0), steps), last, lambda d, i: F.when((i > 0) & (d > today), d).otherwise(add_period(d, period)))


def first_of_next_month(date: Column) -> Column:
    return F.add_months(F.trunc(date, "MM"), 1)


def plus_year(date: Column) -> Column:
    """29 February stays where it is."""
    return F.when((F.month(date) == 2) & (F.dayofmonth(date) == 29), date).otherwise(F.add_months(date, 12))


def in_words(date: Column) -> Column:
    return F.date_format(date, "d MMMM yyyy")


def iso_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def span_in_words(first: Column, last: Column) -> Column:
    a, b = F.date_format(first, "MMMM yyyy"), F.date_format(last, "MMMM yyyy")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b))


def month_day(anchor: Column, months: Column, day: Column) -> Column:
    """A day of the month that comes so many months after the anchor's."""
    return F.date_add(F.add_months(F.trunc(anchor, "MM"), months), day - 1)
