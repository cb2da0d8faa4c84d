from tallyforge.operators import merchants, terms


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_spelling_is_cleaned_once_however_many_payments_have_it(spark):
    rows = [(3, "SHOP ONE"), (1, "sq_* Shop One"), (2, "SHOP ONE"), (4, "OTHER"), (5, None)]
    paid = spark.createDataFrame(rows, "seq long, raw_merchant string")
    whole = merchants.with_stem(paid).collect()
    first = {}
    for r in sorted(whole, key=lambda r: r.seq):
        first.setdefault(r.stem, r.cleaned)
    found = merchants.grouped(paid)
    assert sorted((r.seq, r.stem, r.cleaned, r.merchant) for r in found.collect()) == sorted((r.seq, r.stem, r.cleaned, first[r.stem]) for r in whole if r.stem is not None)
    assert {r.stem: r.n for r in merchants.merchant_groups(paid).collect()} == {s: sum(r.stem == s for r in whole) for s in first}
    assert "HashAggregate(keys=[raw_merchant" in planned(found)


def test_families_are_judged_without_sets_of_their_labels(spark):
    rows = [("a", 0), ("b", 1), ("c", 0), ("c", 1), ("d", 1), ("e", 0), ("f", 1)]
    stated = spark.createDataFrame([(d, t, "x", "1") for t, d in rows], "document int, term string, basis string, value string")
    families = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3)], "term string, family int")
    kept, refused = terms.compare(stated, 0, 1, families)
    assert {(r.term, r.why) for r in refused.collect()} == {("a", "labelled_differently"), ("b", "labelled_differently")}
    assert {(r.term, r.change) for r in kept.collect()} == {("c", "unchanged"), ("d", "added"), ("e", "removed"), ("f", "added")}
    assert "collect_set" not in planned(kept)
