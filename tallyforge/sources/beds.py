"""Generated test beds: statements and letters whose truth is known, without randomness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A grid of series: each pace (days between, payments) under each form (what the second half
# of the payments costs, in hundredths of the first). Prices follow from the place in the grid.
PACES = {"weekly": (7, 24), "monthly": (30, 10), "quarterly": (91, 6), "yearly": (365, 4)}
FORMS = {"level": 100, "dearer": 118, "cheaper": 87}
# And what is no series, or one that is hard to see. Runs of payments: first day, days
# between, payments, pence of the first one, pence more for each next one; amounts below
# zero are credits.
HARD = {
    "once": ((44, 1, 1, 6187, 0),),
    "spreading": tuple((2**i, 1, 1, 2391, 0) for i in range(8)),
    "all_taken_back": ((6, 26, 3, 4403, 0), (10, 26, 3, -4403, 0)),
    "never_the_same": ((0, 17, 9, 2036, 58),),
    "till_mistake": ((0, 7, 20, 1879, 0), (70, 1, 1, 1879, 0), (72, 1, 1, -1879, 0)),
    "two_contracts": ((3, 30, 8, 1507, 0), (12, 30, 8, 2713, 0)),
}


def _runs() -> dict[str, tuple]:
    out = {}
    for pace, (step, n) in PACES.items():
        for form, share in FORMS.items():
            price, half = 1461 + 283 * len(out), n // 2
            out[f"{pace}_{form}"] = ((0, step, half, price, 0), (half * step, step, n - half, price * share // 100, 0))
    return out | HARD


RUNS = _runs()
#: What is to be found of each shape: the periods of its series, and whether a price rose.
TRUTH = {f"{pace}_{form}": ((pace, form == "dearer"),) for pace in PACES for form in FORMS}
TRUTH |= {"till_mistake": (("weekly", False),), "two_contracts": (("monthly", False), ("monthly", False))}


#: Accounts whose statements are one part: each becomes about two hundred payments.
PART_ACCOUNTS = 10_000


def parts(accounts: DataFrame) -> int:
    """Over how many parts the accounts' statements are dealt out."""
    return max(int(accounts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-accounts.count() // PART_ACCOUNTS))


def statements(accounts: DataFrame, anchor: str = "2023-01-03") -> DataFrame:
    """Payments of every shape for each account (``id``), with store numbers behind the names."""
    spark = accounts.sparkSession
    # dealt out before they become payments, by the name that those have: so an account's
    # payments stay in one place, which sums and twins of it can use
    accounts = accounts.select("id", F.col("id").cast("string").alias("account")).repartition(parts(accounts), "account")
    runs = spark.createDataFrame([(i, n, k, *run) for i, (n, rs) in enumerate(RUNS.items()) for k, run in enumerate(rs)], "no int, shape string, run int, start int, step int, n int, pence int, more int")
    rows = accounts.crossJoin(F.broadcast(runs))  # three dozen runs
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    day = F.col("start") + F.col("step") * F.col("i") + (F.col("id") % 20).cast("int")
    pence = F.col("pence") + F.col("more") * F.col("i")
    name = F.concat(F.upper(F.regexp_replace("shape", "_", " ")), F.lit(" "), (F.col("i") * 37 % 900 + 100).cast("string"))
    seq = F.col("id") * 100_000 + F.col("no") * 1_000 + F.col("run") * 100 + F.col("i")
    return rows.select(seq.alias("seq"), "account", name.alias("raw_merchant"), F.date_add(F.lit(anchor).cast("date"), day.cast("int")).alias("date"), (F.abs(pence) / 100).cast("decimal(18,2)").alias("amount"), F.when(pence < 0, "credit").otherwise("debit").alias("direction"), "shape")


# Letters: shape, deadline, anchor; {d} is a date in words.
LETTERS = {
    "dated": ("by {d}", ""),
    "counted": ("within 14 days", ""),
    "anchored": ("within 30 days", "the hearing on {d}"),
    "month_end": ("by the end of the month", ""),
    "undated": ("as soon as you can", ""),
    "pointed": ("by the date shown beside it", ""),
    "counted_from_a_date": ("within 10 days of {d}", ""),
    "one_day": ("within 1 day", ""),
    "month_end_of_anchor": ("before the end of the month", "our meeting of {d}"),
    "working_days": ("within 5 working days", ""),
    "relative_words": ("in a fortnight", ""),
    "pointed_below": ("by the date below", ""),
    "dated_despite_anchor": ("no later than {d}", "the hearing"),
}
#: Shapes whose letter has a row with the date that they point at.
POINTED = ("pointed", "pointed_below")


def letters(senders: DataFrame, anchor: str = "2024-03-04") -> tuple[DataFrame, DataFrame]:
    """(segments, obligations) of letters of every shape from each sender (``id``)."""
    spark = senders.sparkSession
    from tallyforge.functions.dates import in_words

    shapes = spark.createDataFrame([(i, n, d, a) for i, (n, (d, a)) in enumerate(LETTERS.items())], "k int, shape string, deadline string, anchor string")
    base = senders.select("id").crossJoin(F.broadcast(shapes)).withColumn("document", (F.col("id") * len(LETTERS) + F.col("k")).cast("long"))  # a shape a row
    day = F.date_add(F.lit(anchor).cast("date"), (F.col("id") % 300).cast("int"))
    words, later = in_words(day), in_words(F.date_add(day, 21))
    parts = F.array(F.concat(F.lit("Letter of "), words), F.concat(F.lit("You must reply "), F.replace("deadline", F.lit("{d}"), later)), F.concat(F.lit("Due date "), later))
    segments = base.select("document", F.posexplode(F.when(F.col("shape").isin(*POINTED), parts).otherwise(F.slice(parts, 1, 2))).alias("ordinal", "text"))
    obligations = base.select(F.col("document").alias("seq"), "document", F.lit(1).alias("ordinal"), F.lit("reply").alias("kind"), F.concat(F.lit("Sender "), F.col("document").cast("string")).alias("party"), F.replace("deadline", F.lit("{d}"), later).alias("deadline"), F.replace("anchor", F.lit("{d}"), later).alias("anchor"), F.lit("high").alias("confidence"), "shape", day.alias("written"))
    return segments, obligations


# Letters that mislead a quick reader. Passages: {w} is the day of writing, {b} 40 days
# before it, {l} and {m} 21 and 30 days after it, {pad} more than an opening holds. Claims: the
# passage read, kind, deadline and anchor; what becomes of each: a day counted from the
# writing (null: none can be told) and how, or that nothing was asked for.
HARD_LETTERS = {
    "another_day_named": (("{w}", "Since {b} we have waited. You must send the form within 12 days."), ((1, "send", "within 12 days", "", 12, "worked_out"),)),
    "two_duties": (("{w}", "You must reply by {l}, and you must pay within 30 days."), ((1, "reply", "by {l}", "", 21, "read"), (1, "pay", "within 30 days", "", 30, "worked_out"))),
    "written_too_late": (("{pad}", "{w}", "You must reply within 12 days."), ((2, "reply", "within 12 days", "", None, None),)),
    "only_an_offer": (("{w}", "You may ask for a plan by {l}."), ((1, "ask", "by {l}", "", None, "offered"),)),
    "offer_with_a_duty": (("{w}", "You may ask for a plan. You must do so by {l}."), ((1, "ask", "by {l}", "", 21, "read"),)),
    "news_alone": (("{w}", "Our office is closed from {l} to {m}."), ()),
    "two_rows": (("{w}", "Please pay by the date below.", "Due date {m}", "Due date {l}"), ((1, "pay", "by the date below", "", 30, "read"),)),
    "row_without_a_day": (("{w}", "Please pay by the date below.", "Due date as agreed", "Payment due {l}"), ((1, "pay", "by the date below", "", 21, "read"),)),
    "anchored_elsewhere": (("{w}", "You must reply within 9 days of the visit of {l}."), ((1, "reply", "within 9 days", "the visit of {l}", 30, "worked_out"),)),
}


def hard_letters(senders: DataFrame, anchor: str = "2024-03-04") -> tuple[DataFrame, DataFrame]:
    """(segments, claims) of one misleading letter of each shape from each sender (``id``);
    letters of ``news_alone`` have no claim."""
    from tallyforge.functions.dates import in_words

    spark = senders.sparkSession
    day = F.date_add(F.lit(anchor).cast("date"), (F.col("id") % 300).cast("int"))
    pad = " ".join(["We write to you as a customer of many years and hope to go on for many more."] * 9)

    def told(c: Column) -> Column:
        for mark, days in (("{w}", 0), ("{b}", -40), ("{l}", 21), ("{m}", 30)):
            c = F.replace(c, F.lit(mark), in_words(F.date_add(day, days)))
        return F.replace(c, F.lit("{pad}"), F.lit(pad))

    lines = spark.createDataFrame([(k, n, i, x) for k, (n, (xs, _)) in enumerate(HARD_LETTERS.items()) for i, x in enumerate(xs)], "k int, shape string, ordinal int, text string")
    asked = spark.createDataFrame([(k, n, *c[:4]) for k, (n, (_, cs)) in enumerate(HARD_LETTERS.items()) for c in cs], "k int, shape string, ordinal int, kind string, deadline string, anchor string")
    document = (F.col("id") * len(HARD_LETTERS) + F.col("k")).cast("long").alias("document")
    each = lambda rows: senders.select("id").crossJoin(F.broadcast(rows))  # noqa: E731  two dozen rows
    segments = each(lines).select(document, "ordinal", told(F.col("text")).alias("text"))
    claims = each(asked).select(document, "ordinal", "shape", "kind", F.concat(F.lit("Sender "), F.col("id").cast("string")).alias("party"), told(F.col("deadline")).alias("deadline"), told(F.col("anchor")).alias("anchor"), F.lit("high").alias("confidence"), day.alias("written"))
    return segments, claims.withColumn("seq", F.col("document") * 10 + F.when(F.col("kind") == "pay", 1).otherwise(0))


# Renewals: shape, terms of the earlier document, terms of the later one, and the verdicts.
# A term may name the section that it belongs to behind an @.
RENEWALS = {
    "unchanged": (["excess=£137"], ["excess=£137"], "unchanged"),
    "dearer": (["premium=£214.60"], ["premium=£229.15"], "changed"),
    "reworded": (["notice=14 days"], ["notice=21 days"], "changed"),
    "respelt": (["limit=£640"], ["limit=£640.00"], "changed"),
    "added": ([], ["fee=£7"], "added"),
    "removed": (["fee=£7"], [], "removed"),
    "stated_twice": (["excess=£137", "excess=£168"], ["excess=£137"], "stated_more_than_once"),
    "relabelled": (["fee_a=£7"], ["fee_b=£7"], "labelled_differently"),
    "cheaper": (["premium=£318.40"], ["premium=£271.90"], "changed"),
    "share": (["discount=10%"], ["discount=12 per cent"], "changed"),
    "twice_later": (["excess=£65"], ["excess=£65", "excess=£85"], "stated_more_than_once"),
    "written_out": (["cover=full"], ["cover=third party"], "changed"),
    "same_words": (["cover=third party"], ["cover=third party"], "unchanged"),
    "one_section_dearer": (["excess@buildings=£310", "excess@contents=£120"], ["excess@buildings=£310", "excess@contents=£145"], "unchanged changed"),
    "section_dropped": (["limit@contents=£9000", "limit@garden=£1100"], ["limit@contents=£9000"], "unchanged removed"),
    "sections_swapped": (["excess@home=£95", "excess@away=£155"], ["excess@home=£155", "excess@away=£95"], "changed"),
    "two_excesses": (["excess@theft=£205", "excess@theft=£255", "excess@fire=£405"], ["excess@theft=£205", "excess@fire=£405"], "stated_more_than_once unchanged"),
}


def renewals(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, truth) of pairs of documents, each policy's (``id``) and shape's under a name of its own."""
    spark = policies.sparkSession
    rows = [(n, side, t.split("=")[0].split("@")[0], f"{t.split('=')[0]}@per_claim".split("@")[1], t.split("=")[1]) for n, (a, b, _) in RENEWALS.items() for side, ts in ((0, a), (1, b)) for t in ts]
    shapes = spark.createDataFrame(rows, "shape string, document int, label string, section string, value string")
    base = policies.select("id").crossJoin(F.broadcast(shapes))  # two dozen terms
    basis = F.concat_ws("_", F.col("shape"), F.col("id").cast("string"))
    terms = base.select("document", "label", F.concat_ws(":", basis, "label").alias("term"), F.col("section").alias("basis"), "value", F.concat(F.lit("It is "), "value").alias("quote"), basis.alias("family"), "shape")
    truth = spark.createDataFrame([(n, v) for n, (_, _, vs) in RENEWALS.items() for v in vs.split()], "shape string, verdict string")
    return terms, truth


def swapped_roles(terms: DataFrame) -> DataFrame:
    """The twin in which the two documents trade places: what was added is removed."""
    return terms.withColumn("document", 1 - F.col("document"))


def reordered(payments: DataFrame) -> DataFrame:
    """The twin in which rows stand in another order, part by part, which no result may show."""
    return payments.sortWithinPartitions(F.xxhash64("seq", "raw_merchant"))


def one_removed(payments: DataFrame, shape: str) -> DataFrame:
    """The twin without one merchant of each account."""
    return payments.where(F.col("shape") != shape)


def disguised(payments: DataFrame) -> DataFrame:
    """The twin whose merchants come through payment processors, which no result may show."""
    prefix = F.element_at(F.array(F.lit("PAYPAL *"), F.lit("SQ *"), F.lit("")), (F.col("seq") % 3 + 1).cast("int"))
    return payments.withColumn("raw_merchant", F.concat(prefix, "raw_merchant"))


def with_strangers(payments: DataFrame) -> DataFrame:
    """The adversarial twin: every account also pays look-alikes of its merchants once."""
    order = Window.partitionBy("account", "shape").orderBy("date", "seq", "amount")
    others = [c for c in payments.columns if c != "account"]
    like = {"seq": F.col("seq") + 50_000, "raw_merchant": F.concat(F.upper(F.regexp_replace("shape", "_", "")), F.lit(" LOOKALIKE")), "date": F.date_add("date", 1), "direction": F.lit("debit"), "shape": F.concat("shape", F.lit(" stranger"))}
    own, stranger = F.struct(*others), F.struct(*[like.get(c, F.col(c)).alias(c) for c in others])
    both = F.when(F.row_number().over(order) == 1, F.array(own, stranger)).otherwise(F.array(own))
    return payments.select("account", both.alias("both")).select("account", F.explode("both").alias("p")).select(*[f"p.{c}" if c != "account" else c for c in payments.columns])


def dearer(payments: DataFrame, shape: str, by: str = "5.00") -> DataFrame:
    """The controlled twin: one merchant's last payment costs more, and nothing else moves."""
    last = F.max("date").over(Window.partitionBy("account", "shape"))
    risen = (F.col("amount") + F.lit(by).cast("decimal(18,2)")).cast("decimal(18,2)")
    return payments.withColumn("amount", F.when((F.col("shape") == shape) & (F.col("date") == last), risen).otherwise(F.col("amount")))
