import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import numbers as N
from tallyforge.functions import similarity
from tallyforge.functions import text as X
from tallyforge.operators import geometry, passages, relations, terms, timeline
from tallyforge.plans import queries

MAY = dt.date(2026, 5, 22)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("on 22 May 2026.", MAY), ("(22nd May, 2026)", MAY), ("22ndMay 2026", MAY), ("31 February 2026 then 22 MAY 2026", MAY), ("22/05/2026", None), ("May 2026", None), ("222 May 2026", None), ("22 May 1800", None), ("x22 May 2026", None), ("22 Mayor 2026", None)],
)
def test_first_full_date(spark, text, want):
    assert one(spark, D.first_full_date(F.lit(text))) == want


@pytest.mark.parametrize(
    "deadline, anchor, letter, want",
    [
        ("by 22 May 2026", "", None, (MAY, "read")),
        ("within 14 days", "", MAY, (dt.date(2026, 6, 5), "worked_out")),
        ("within 14 days", "the hearing on 1 June 2026", MAY, (dt.date(2026, 6, 15), "worked_out")),
        ("within 30 days of 22 May 2026", "", None, (dt.date(2026, 6, 21), "worked_out")),
        ("by the end of the month", "", MAY, (dt.date(2026, 5, 31), "worked_out")),
        ("within 14 days.", "", MAY, (None, None)),
        ("within 5 working days, or within 9 days", "", MAY, (None, None)),
        ("soon", "", MAY, (None, None)),
        ("within 14 days", "", None, (None, None)),
    ],
)
def test_deadlines(spark, deadline, anchor, letter, want):
    got = one(spark, D.resolve_deadline(F.lit(deadline), F.lit(anchor), F.lit(letter).cast("date")))
    assert (got.date, got.kind) == want


def test_month_ends_drift_when_added_one_by_one(spark):
    step = lambda last, period, today: one(spark, D.next_occurrence(F.lit(last), F.lit(period), F.lit(today)))
    assert step(dt.date(2024, 1, 31), "monthly", dt.date(2024, 3, 1)) == dt.date(2024, 3, 29)
    assert step(dt.date(2024, 1, 31), "weekly", dt.date(2024, 1, 31)) == dt.date(2024, 2, 7)
    assert step(dt.date(2024, 5, 1), "monthly", dt.date(2024, 1, 1)) == dt.date(2024, 6, 1)


def test_timeline(spark):
    segments = spark.createDataFrame([(0, 0, "1 March 2024"), (0, 1, "Due date 9 April 2024"), (1, 0, "no date here")], "document int, ordinal int, text string")
    rows = [
        (0, 0, 2, "pay", "Acme", "within 10 days", "", "high"),
        (1, 0, 1, "pay", "ACME", "WITHIN 10 days", "", "low"),
        (2, 0, 2, "pay", "Acme", "by the date shown beside it", "", "high"),
        (3, 1, 0, "reply", "Acme", "within 10 days", "", "high"),
        (4, 0, 2, "Pay", "Acme", "within 10 days", "", "high"),
    ]
    obligations = spark.createDataFrame(rows, "seq long, document int, ordinal int, kind string, party string, deadline string, anchor string, confidence string")
    got = timeline.ordered(timeline.merged(timeline.dated(obligations, segments))).collect()
    assert [(r.kind, r.due.date, r.confidence, len(r.evidence)) for r in got] == [("Pay", dt.date(2024, 3, 11), "high", 1), ("pay", dt.date(2024, 3, 11), "low", 2), ("pay", dt.date(2024, 4, 9), "high", 1), ("reply", None, "high", 1)]
    assert got[1].party == "Acme" and got[2].due.kind == "read"


def test_passages(spark):
    text = "A line that is the longest one here\nfollowed by a short\nLongerwordthatcouldnotfit begins\n\nSecond block that runs on to the hy-\nphenated"
    got = passages.passages(spark.createDataFrame([(1, text)], "document int, text string")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text) for r in got] == [(0, "A line that is the longest one here followed by a short Longerwordthatcouldnotfit begins"), (1, "Second block that runs on to the hy-phenated")]


def test_guards_of_terms(spark):
    rows = [("excess", "£100", "the excess is £100", "Note that the  excess is £100 a claim"), ("other", "1", "1", "1"), ("excess", "£100", "not there", "text"), ("excess", "£9", "the excess is £100", "the excess is £100"), ("excess", "lots", "it is lots", "it is lots")]
    frame = spark.createDataFrame(rows, "term string, value string, quote string, segment string")
    kinds = spark.createDataFrame([("excess", ["money"])], "term string, kinds array<string>")
    assert sorted(str(r.guard) for r in terms.guarded(frame, kinds).collect()) == sorted(["None", "other", "quote_not_on_page", "quote_without_value", "wrong_shape"])


def test_differences(spark):
    rows = [(0, "excess", "claim", "£500"), (1, "excess", "claim", "£500.00"), (0, "gone", "x", "1"), (1, "new", "x", "1"), (0, "twice", "x", "1"), (0, "twice", "x", "2"), (1, "twice", "x", "1"), (0, "fee_a", "x", "1"), (1, "fee_b", "x", "1"), (2, "third", "x", "1"), (0, "other", "x", "1")]
    frame = spark.createDataFrame([(*r, r[3]) for r in rows], "document int, term string, basis string, value string, quote string")
    families = spark.createDataFrame([("fee_a", "fee"), ("fee_b", "fee")], "term string, family string")
    diff, refused = terms.compare(frame, 0, 1, families)
    assert {(r.term, r.change, None if r.delta is None else float(r.delta), r.kind) for r in diff.collect()} == {("excess", "changed", 0.0, "worked_out"), ("gone", "removed", None, "read"), ("new", "added", None, "read")}
    assert {(r.term, r.why) for r in refused.collect()} == {("twice", "stated_more_than_once"), ("fee_a", "labelled_differently"), ("fee_b", "labelled_differently")}


def test_names_and_numbers(spark):
    clean = lambda s: one(spark, X.clean_merchant(F.lit(s)))
    assert [clean(s) for s in ("STRIPE* X", "SQ *Shop", "ZETTLE_*Y", "a*b", " AMZNMktplace 9", "Plain")] == ["X", "Shop", "Y", "a*b", "Amazon Marketplace", "Plain"]
    stem = lambda s: one(spark, X.merchant_stem(F.lit(s)))
    assert [stem(s) for s in ("Tesco Store 3412", "tesco  store T02", "O2", "12 34")] == ["TESCO STORE", "TESCO STORE", "O2", "12 34"]
    assert one(spark, N.money(F.lit("-1234.565").cast("decimal(18,3)"))) == "−£1,234.56"
    assert [one(spark, X.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert one(spark, X.move_first_digit(F.lit("by 29 May"))) == "by 39 May" and one(spark, X.move_first_digit(F.lit("in 9"))) == "in 8"
    assert [similarity.distance(a, b) for a, b in (("ca", "abc"), ("", "ab"), ("abcd", "acbd"), ("same", "same"))] == [2, 2, 1, 0]
    assert one(spark, N.wilson(F.lit(0), F.lit(0))) is None
    assert one(spark, X.is_percentage(F.lit("5 per cent"))) and not one(spark, X.is_duration(F.lit("5 long days")))
    assert one(spark, X.sentence_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"


def test_geometry(spark):
    frag = [(0, 1, i, t, float(x), float(x + 20), float(y)) for i, (t, x, y) in enumerate([("b", 30, 100), ("a", 0, 101), ("c", 0, 80), ("d", 200, 99), ("e", 200, 60)])]
    frame = spark.createDataFrame(frag, "doc int, page int, frag_no int, text string, x double, right double, y double")
    rows = geometry.row_clusters(frame)
    assert [r.line for r in geometry.lines(rows).orderBy(F.desc("row_y")).collect()] == ["a b d", "c", "e"]
    found = geometry.channels(frame, "doc", "page")
    assert {(r.at, r.width) for r in found.collect()} == {(50.0, 150.0)}
    assert geometry.column_cut(rows, found).first().at == 50.0
    placed = spark.createDataFrame([("p", 0.9, 0.1, 0.2, "Pay", 0.9), ("p", 0.9, 0.22, 0.3, "now", 0.4), ("p", 0.5, 0.1, 0.2, "Bye", 1.0)], "doc string, top double, left double, right double, text string, confidence double")
    one_, other = geometry.reading_lines(placed, "doc"), geometry.reading_lines(placed.withColumn("text", F.regexp_replace("text", "now", "cow")), "doc")
    assert sorted((r.text, round(r.confidence, 1)) for r in one_.collect()) == [("Bye", 1.0), ("Pay now", 0.4)]
    assert [(r.text, r.also) for r in geometry.disagreements(one_, other).collect()] == [("Pay now", "Pay cow")]
    assert geometry.readable(one_, "doc").first().refused


def test_views_that_agree_have_no_smallest_difference(spark):
    views = spark.createDataFrame([("l", "a", ["1"]), ("r", "a", ["1"])], "fixture string, grp string, entries array<string>")
    assert relations.smallest_difference(relations.paired(views, spark.createDataFrame([("same", "l", "r")], "relation string, left string, right string"))).count() == 0


def test_relations(spark):
    views = spark.createDataFrame([("l", "a", ["1"]), ("l", "b", ["2"]), ("r", "a", ["2"]), ("r", "b", ["1"]), ("s", "a", ["1"])], "fixture string, grp string, entries array<string>")
    declared = spark.createDataFrame([("swap", "l", "r"), ("less", "l", "s")], "relation string, left string, right string")
    pairs = relations.paired(views, declared)
    assert {r.relation: r.holds for r in relations.swapped(pairs, "a", "b").collect()} == {"swap": True, "less": False}
    assert {r.relation: r.holds for r in relations.one_removed(pairs).collect()} == {"swap": False, "less": True}
    assert relations.smallest_difference(pairs).where("relation = 'less'").first().difference.entry == "2"
    change = spark.createDataFrame([("less", "b", "left", "2")], "relation string, grp string, side string, entry string")
    assert relations.controlled(pairs.where("relation = 'less'"), change).first().holds


def test_letter_date_window_gives_whole_texts(spark, tmp_path):
    text = "".join(f"word{i} " for i in range(400))
    spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    blocks = {(r.document, r.ordinal): r.text for r in queries._headed(spark, str(tmp_path)).collect()}
    assert {d: blocks[d, 1] + blocks[d, 3] for d in (1, 2)} == {1: text, 2: "short"}


def test_terms_stay_where_they_are_for_their_kinds(spark):
    frame = spark.range(10).selectExpr("if(id % 2 = 0, 'fee', 'other') AS term", "'£5' AS value", "'a fee of £5' AS quote", "'a fee of £5' AS segment")
    kinds = spark.createDataFrame([("fee", ["money"])], "term string, kinds array<string>")
    plan = terms.guarded(frame, kinds)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan


def test_quotes_of_two_words_meet_by_equal_keys(spark):
    quotes = spark.createDataFrame([(1, "at b"), (2, "c d"), (3, "x  y")], "quote_id int, quote string")
    segments = spark.createDataFrame([(1, 0, "a cat\nbit c dog"), (1, 1, "at x y z"), (2, 0, "hat  be; bc d")], "document int, ordinal int, text string")
    found = passages.quote_places(quotes, segments)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 2, 0), (3, 1, 1)]
    two = passages._two_words(quotes.selectExpr("quote_id", "quote", "split(quote, ' +') AS w"), segments.selectExpr("document", "ordinal", "split(text, '[ \n]+') AS w"))
    assert "NestedLoop" not in two._jdf.queryExecution().executedPlan().toString()


def test_dates_and_paragraphs_are_told_in_parts_that_grow_with_the_input(spark, tmp_path, monkeypatch):
    from tallyforge.sources import runs

    rows = [(1, 0, "Dear"), (1, 1, "x" * 700), (1, 2, "5 May 2024"), (2, 0, "Due date 3 June 2024, not 4 June 2024"), (2, 1, "Due date 9 June 2024"), (3, 0, "soon")]
    spark.createDataFrame(rows, "document int, ordinal int, text string").write.parquet(str(tmp_path / "s"))
    held = spark.read.parquet(str(tmp_path / "s"))
    monkeypatch.setattr(runs, "PART_BYTES", 100)
    assert runs.spread(held, "document").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = timeline.document_dates(held)
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    june = dt.date(2024, 6, 3)
    assert {tuple(r) for r in told.collect()} == {(1, None, None), (2, june, june), (3, None, None)}
    lines = spark.createDataFrame([(1, 1, -float(y), "x") for y in (0, 10, 20, 50, 60)] + [(2, 1, 0.0, "y")], "doc int, page int, row_y double, line string")
    cut = geometry.paragraph_breaks(lines)
    assert sorted((r.doc, -r.row_y, r.paragraph) for r in cut.collect()) == [(1, 0, 0), (1, 10, 0), (1, 20, 0), (1, 50, 1), (1, 60, 1), (2, 0, 0)]
    assert "Join" not in cut._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_read_without_sending_pages_to_every_task(spark):
    from tallyforge.operators import pages

    text = F.when(F.col("id") % 2 == 0, "left one      right one\nleft two      right two\nleft three\n              right four").otherwise("item      price\nfee       10.00\ntax       2.50")
    read = pages.read_blocks(spark.range(40).select(F.col("id").alias("doc"), F.lit(1).alias("page"), text.alias("text")))
    assert "Broadcast" not in read._jdf.queryExecution().executedPlan().toString()
    assert {(r.reading, r.part, r.n) for r in read.groupBy("reading", "part").agg(F.count("*").alias("n")).collect()} == {("columns", 0, 20), ("columns", 1, 20), ("table", 0, 20)}


@pytest.mark.parametrize("more", [(), ("gamma",), ("one two three", "et")])
def test_few_pairs_of_words_stand_where_many_would(spark, monkeypatch, more):
    texts = ["the cat  sat\non the mat", "bathe catsup, lathe cat", "a b", "", " x ", "the  cat the cat one two three", "he ca\tthe cat", "gamma the catalogue"]
    segments = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "document int, ordinal int, text string")
    asked = ["the cat", "e c", "a  b", "on the", "cat the", "he ca", "no where", "x x", *more]
    quotes = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "quote_id int, quote string")
    squashed = lambda x: " ".join(x.split())
    want = sorted((i, j % 3, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if squashed(q) in squashed(t))
    places = passages.quote_places(quotes, segments)
    assert sorted(map(tuple, places.collect())) == want
    repeated = passages.quote_places(quotes, segments, repeated=True)
    assert sorted(set(map(tuple, repeated.collect()))) == want
    plan = repeated._jdf.queryExecution().executedPlan().toString()
    # neither texts nor words of them nor places are shuffled, only the quotes' own first words
    assert more or set(re.findall(r"Exchange hashpartitioning\((\w+)", plan)) == {"a"}
    counted = lambda p: sorted(map(tuple, passages.ambiguous_quotes(p).collect()))
    assert counted(repeated) == counted(places)
    monkeypatch.setattr(passages, "FEW", 0)
    assert sorted(map(tuple, passages.quote_places(quotes, segments).collect())) == want
