"""String expressions: merchant names, comparison keys, labels and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Processor tokens before a star, and prefixes that stand for one merchant.
PROCESSORS = ("PAYPAL", "SQ", "ZETTLE", "SUMUP", "IZ", "STRIPE", "WPY")
ONE_NAME = (("AMZNMktplace", "Amazon Marketplace"),)
# Currency signs, months, units of a duration.
SIGNS = "£$€"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UNITS = ("day", "days", "week", "weeks", "month", "months", "year", "years")
#: A plain decimal: no exponent, no thousands separators.
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def squash(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def passage_key(c: Column) -> Column:
    return F.lower(squash(c))


def letters(c: Column) -> Column:
    """Lower case without white space, for comparing two readings of one line."""
    return F.lower(F.regexp_replace(c, r"\s", ""))


def clean_merchant(raw: Column) -> Column:
    """The merchant behind a payment processor's prefix, or a prefix's one name."""
    name = F.trim(raw)
    token = F.upper(F.regexp_replace(F.substring_index(name, "*", 1), r"^[\s_]+|[\s_]+$", ""))
    rest = F.trim(F.regexp_replace(name, r"(?s)^[^*]*\*", ""))
    out = F.when(name.contains("*") & token.isin(*PROCESSORS), rest).otherwise(name)
    for prefix, whole in ONE_NAME:
        out = F.when(name.startswith(prefix), F.lit(whole)).otherwise(out)
    return out


def is_code(token: Column) -> Column:
    """A machine code: it has a digit and at most two other characters."""
    others = F.length(F.translate(token, "0123456789", ""))
    return (F.length(token) > others) & (others <= 2)


def merchant_stem(name: Column) -> Column:
    """Upper-case merchant words without codes; a name of codes alone keeps them."""
    words = F.filter(F.split(squash(name), " "), lambda w: ~is_code(w) & (w != ""))
    stem = lambda w: F.when(F.size(w) > 0, F.upper(F.array_join(w, " "))).otherwise(F.upper(name))
    return F.element_at(F.transform(F.array(words), stem), 1)  # words are made once


def comparison_key(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), r"[^\p{L}\p{N}]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def term_label(c: Column) -> Column:
    spaced = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def sentence_list(parts: Column) -> Column:
    """``a, b and c`` of an array."""
    n = F.size(parts)
    most = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, most).otherwise(F.concat(most, F.lit(" and "), F.element_at(parts, -1)))


def shortened_hash(c: Column, keep: int = 6) -> Column:
    return F.when(F.length(c) <= 2 * keep, c).otherwise(F.concat(F.substring(c, 1, keep), F.lit("…"), F.right(c, F.lit(keep))))


def move_first_digit(c: Column) -> Column:
    """The first digit goes up by one, a nine down to eight."""
    at = F.regexp_instr(c, F.lit("[0-9]"))
    moved = F.translate(F.substring(c, at, F.lit(1)), "0123456789", "1234567898")
    return F.when(at == 0, c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), moved, F.substring(c, at + 1, F.length(c))))


def confidence_level(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("high", "medium"), low).otherwise(F.lit("low"))


def devowel(c: Column) -> Column:
    return F.translate(c, "AEIOUaeiou", "")


def count_noun(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def join_lines(lines: Column) -> Column:
    """Lines as prose: one space between, none after a closing hyphen."""
    return F.aggregate(lines, F.lit(""), lambda out, line: F.when(out == "", line).when(out.endswith("-"), F.concat(out, line)).otherwise(F.concat(out, F.lit(" "), line)))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def amount(c: Column) -> Column:
    """An amount as written, one currency sign and thousands commas allowed; else null."""
    plain = F.replace(F.regexp_replace(F.trim(c), f"^[{SIGNS}]", ""), F.lit(","), F.lit(""))
    return F.when(plain.rlike(DECIMAL), plain).try_cast("decimal(38,6)")


def is_percentage(c: Column) -> Column:
    number = F.trim(F.regexp_replace(F.trim(c), r"(%|per cent|percent)$", ""))
    return F.trim(c).rlike(r"(%|per cent|percent)$") & number.rlike(DECIMAL)


def is_duration(c: Column) -> Column:
    return squash(c).rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+) (" + "|".join(UNITS) + ")$")


def value_kind(c: Column) -> Column:
    """The first kind that a written value has: money, percentage, duration, text."""
    return F.when(amount(c).isNotNull(), "money").when(is_percentage(c), "percentage").when(is_duration(c), "duration").when(F.trim(c) != "", "text")


def figure_cell(c: Column) -> Column:
    return F.translate(c, SIGNS + ",% ", "").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def self_contained(html: Column) -> Column:
    """No external address in attributes that load, and none in styles."""
    tags = r"(?is)<(script|img|iframe|link|source|video|audio|embed|object)\b[^>]*\b(src|href|data)\s*=\s*[\"']?\s*(https?:)?//"
    return ~(html.rlike(tags) | html.rlike(r"(?i)url\(|@import"))


def param_size(file: Column) -> Column:
    """``7b`` in a model file's name."""
    return F.lower(F.regexp_extract(file, r"(?i)(?:^|[-_])(\d+(?:\.\d+)?b)(?:[-_.]|$)", 1))
