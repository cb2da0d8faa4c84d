"""Texts to passages, opening dates, and guards over passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import text as X
from tallyforge.sources.runs import spread

# Constructions that offer, and ones that require.
PERMITS = ("you may ", "you can ", "if you wish", "you are welcome to", "you are free to", "at your option", "optionally")
REQUIRES = ("must", "shall", "require", "need to", "should", "please", "is due", "are due", "no later than", "we ask", "to be returned", "failure to", "obliged to")
OPENING = 600


def measure(text: Column) -> Column:
    """Characters of the longest trimmed line."""
    return F.array_max(F.transform(F.split(text, "\n"), lambda line: F.length(F.trim(line))))


def passages(documents: DataFrame, id_col: str = "document", text_col: str = "text") -> DataFrame:
    """(document, ordinal, text): blocks at blank lines, broken where a line stopped short.

    A line stopped short if the next one's first word would have fitted the document's
    longest line. One document's lines are folded in its own row.
    """
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first_word = lambda x: F.substring_index(x, " ", 1)
    pairs = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.try_element_at("lines", i + 2).alias("next")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, p: Column) -> Column:
        now = F.when(acc["now"] == "", p["line"]).when(acc["now"].endswith("-"), F.concat(acc["now"], p["line"])).otherwise(F.concat(acc["now"], F.lit(" "), p["line"]))
        ends = p["next"].isNull() | (F.length(p["line"]) + 1 + F.length(first_word(p["next"])) <= F.col("measure"))
        return F.struct(F.when(ends, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(ends, F.lit("")).otherwise(now).alias("now"))

    rows = documents.select(F.col(id_col).alias("document"), measure(F.col(text_col)).alias("measure"), F.posexplode(F.split(text_col, "\n\n")).alias("at", "block"))
    rows = rows.select("document", "measure", "at", lines.alias("lines")).where(F.size("lines") > 0)
    folded = rows.select("document", "at", F.posexplode(F.aggregate(pairs, start, add)["done"]).alias("sub", "text"))
    order = Window.partitionBy("document").orderBy("at", "sub")
    return folded.select("document", (F.row_number().over(order) - 1).alias("ordinal"), "text")


def with_reach(segments: DataFrame) -> DataFrame:
    """Adds read: the characters of its document that come before a segment."""
    before = Window.partitionBy("document").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("read", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))


def opening_dates(segments: DataFrame) -> DataFrame:
    """(document, letter_date): the first full date in the opening of each document.

    A segment is searched while fewer than 600 characters came before it; the first
    always is.
    """
    return opening_rows(segments).groupBy("document").agg(opening_date())


def opening_rows(segments: DataFrame, **more: Column) -> DataFrame:
    """(document, ordinal, n, said, read): the characters of each segment, the date it has and
    the characters before it. Texts stay where they are; what is shuffled and sorted are
    numbers and dates, in parts of a bounded size."""
    rows = segments.select("document", "ordinal", F.length("text").alias("n"), D.first_full_date(F.col("text")).alias("said"), *(c.alias(k) for k, c in more.items()))
    before = Window.partitionBy("document").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return spread(rows, "document", source=segments).withColumn("read", F.coalesce(F.sum("n").over(before), F.lit(0)))


def opening_date() -> Column:
    found = F.col("said").isNotNull() & (F.col("read") < OPENING)
    return F.min_by("said", F.when(found, F.col("ordinal"))).alias("letter_date")


def date_disputes(one: DataFrame, other: DataFrame) -> DataFrame:
    """Documents whose two readings open with different dates."""
    a, b = opening_dates(one), opening_dates(other).withColumnRenamed("letter_date", "also_read")
    return a.join(b, "document").where(~F.col("letter_date").eqNullSafe(F.col("also_read")))


def grants_without_requiring(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike("|".join(PERMITS)) & ~low.rlike("|".join(REQUIRES))


def quote_in(quote: Column, source: Column) -> Column:
    """White space apart, the source contains the quote; an empty quote is in none."""
    return (F.trim(quote) != "") & F.contains(X.squash(source), X.squash(quote))


#: Quotes of two words are sent to every task while they have no more characters than this.
FEW = 2 << 20


def quote_places(quotes: DataFrame, segments: DataFrame, grams: int = 4, repeated: bool = False) -> DataFrame:
    """(quote_id, document, ordinal) where a quote stands, white space apart; once each,
    unless they may be ``repeated``.

    A quote's inner words stand whole in any text that contains it, so hashes of up to
    ``grams`` of them in a row are join keys: of each quote one, the least, of each text
    all, with nothing but its place. A quote of two words needs a word that ends like its
    first before one that begins like its second, and a quote of one word a part of a
    word; those ends and parts are keys too, of the lengths that quotes have. Containment
    decides. Quotes of two words that are ``FEW`` meet the texts where those are. Empty
    quotes stand nowhere.
    """
    # arrays are exploded out of an array of one, so that they are made once and not again
    # for each of their elements
    once = lambda value, name: F.explode(F.array(value)).alias(name)
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    asked = quotes.select("quote_id", X.squash(F.col("quote")).alias("quote")).where("quote <> ''").select("*", once(F.split("quote", " "), "w"))
    held = segments.select("document", "ordinal", X.squash(F.col("text")).alias("text"))
    words = held.select("document", "ordinal", once(F.split("text", " "), "w"))
    most = F.lit(grams + 2)
    told = asked.groupBy(F.least(F.size("w"), most).alias("size")).agg(F.sum(F.length("quote")).alias("chars"), *(F.max(F.length(F.get("w", F.lit(i)))).alias(c) for i, c in enumerate("ab")))
    sizes = {r["size"]: r for r in told.collect()}  # at most `grams` and two
    few = _few_pairs(asked, words, sizes[2]["a"], sizes[2]["b"]) if 2 in sizes and sizes[2]["chars"] <= FEW else None
    if few is not None and len(sizes) == 1:
        return few if repeated else few.distinct()
    width = F.least(F.size("w") - 2, F.lit(grams))
    long = asked.where(F.size("w") > 2).select("quote_id", width.alias("width"), once(hashed(F.slice("w", F.lit(2), F.size("w") - 2)), "h"))
    used = [n - 2 for n in sorted(sizes) if n > 2]
    least = F.lit(None).cast("long")
    for n in used:
        least = F.when(F.col("width") == n, F.array_min(_gram_hashes(F.col("h"), n))).otherwise(least)
    long = long.select("quote_id", least.alias("key"))
    every = [_gram_hashes(F.col("h"), n) for n in used] or [F.array().cast("array<long>")]
    keyed = words.select("document", "ordinal", once(hashed(F.col("w")), "h")).select("document", "ordinal", F.explode(F.array_distinct(F.concat(*every))).alias("key"))
    near = long.join(keyed, "key")
    places = near.select("quote_id", "document", "ordinal")
    if few is None:
        places = places.unionByName(_two_words(asked, words))
    places = places.unionByName(_one_word(asked, words))
    sure = places.distinct().join(asked.select("quote_id", "quote"), "quote_id").join(held, ["document", "ordinal"])
    sure = sure.where(F.contains(F.col("text"), F.col("quote"))).select("quote_id", "document", "ordinal")
    if few is None:
        return sure
    return sure.unionByName(few if repeated else few.distinct())


def _few_pairs(asked: DataFrame, words: DataFrame, longest_a: int, longest_b: int) -> DataFrame:
    """Places, perhaps repeated, of quotes of two words, which go to every task: no text, word
    or place is shuffled. A text has such a quote where a word ends like its first one and
    the next word begins like its second one, so nothing remains to be checked."""
    two = asked.where(F.size("w") == 2).select("quote_id", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    ends = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("x"), F.element_at("w", i + 1).alias("y")))
    each = words.where(F.size("w") > 1).select("document", "ordinal", F.inline(F.array_distinct(ends)))
    upto = lambda c, most: F.explode(F.sequence(F.lit(1), F.least(F.length(c), F.lit(most)))).alias("n")
    ended = each.select("document", "ordinal", "x", "y", upto("x", longest_a)).select("document", "ordinal", F.right("x", "n").alias("a"), "y")
    first = ended.join(F.broadcast(two.select("a").distinct()), "a", "left_semi")
    begun = first.select("document", "ordinal", "a", "y", upto("y", longest_b)).select("document", "ordinal", "a", F.left("y", "n").alias("b"))
    return begun.join(F.broadcast(two), ["a", "b"]).select("quote_id", "document", "ordinal")


def _gram_hashes(hashes: Column, width: int) -> Column:
    """A hash of every run of so many words, its number of words included, from the words'
    hashes (a column, as each run looks it up)."""
    last = F.size(hashes) - width
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(width), *(F.get(hashes, i + k) for k in range(width))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<long>"))


def _two_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Each different word of the texts is met once with the quotes' first words, which it
    may end like, and second ones, which it may begin like; neighbours look both up."""
    two = asked.where(F.size("w") == 2).select("quote_id", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    known = words.select(F.explode("w").alias("x")).distinct()

    def met(side: str, part: Callable[[Column, Column], Column]) -> DataFrame:
        parts = F.transform(F.sequence(F.lit(1), F.length("x")), lambda n: part(F.col("x"), n))
        cut = known.where("x <> ''").select("x", F.explode(parts).alias(side)).join(two.select(side).distinct(), side)
        return cut.groupBy("x").agg(F.collect_list(F.xxhash64(side)).alias(f"{side}s"))

    firsts, seconds = met("a", F.right), met("b", F.left).withColumnRenamed("x", "y")
    ends = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("x"), F.element_at("w", i + 1).alias("y")))
    next_to = words.where(F.size("w") > 1).select("document", "ordinal", F.inline(ends))
    keys = F.flatten(F.transform("as", lambda a: F.transform("bs", lambda b: F.xxhash64(a, b))))
    keyed = next_to.join(firsts, "x").join(seconds, "y").select("document", "ordinal", F.explode(keys).alias("key"))
    return two.select("quote_id", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("key")).join(keyed, "key").select("quote_id", "document", "ordinal")


def _one_word(asked: DataFrame, words: DataFrame) -> DataFrame:
    one = asked.where(F.size("w") == 1).select("quote_id", F.col("quote").alias("part"), F.length("quote").alias("m"))
    lengths = F.broadcast(one.select("m").distinct())  # lengths of words
    each = words.select("document", "ordinal", F.explode(F.array_distinct("w")).alias("x")).join(lengths, F.length("x") >= F.col("m"))
    parts = F.transform(F.sequence(F.lit(1), F.length("x") - F.col("m") + 1), lambda i: F.substring(F.col("x"), i, F.col("m")))
    return one.select("quote_id", "part").join(each.select("document", "ordinal", F.explode(parts).alias("part")), "part").select("quote_id", "document", "ordinal")


def ambiguous_quotes(places: DataFrame) -> DataFrame:
    """Quotes that stand in more than one passage of a document."""
    # distinct within the one shuffle: places may come repeated
    return places.groupBy("quote_id", "document").agg(F.countDistinct("ordinal").alias("passages")).where("passages > 1")
