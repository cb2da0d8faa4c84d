"""Mutants of recorded answers: every site of every operator as a row, replayed in one job.

A recording is a row a batch: (batch, items array<struct<id, text>>, results
array<struct<id, echo, confidence, claims array<struct<kind, deadline>>, terms
array<struct<term, basis, value, quote>>>>). It is what was found right, so its own
replay is the truth that mutants are held against. A batch is a few items, as they were
asked; a mutant copies its batch and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators.passages import quote_in

Sites = Callable[[Column], Column]
Apply = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Operator:
    """Where a harm can be planted, how, and what should contain it."""

    contained_by: str
    sites: Sites
    apply: Apply


INVENTED = ("payment", "within 9 days")
DATED = "by 1 May 2030"
OUTSIDE = "outside"
SHAPELESS = "some hundreds or so"


def _site(r: Column, i: Column | int = -1, s: Column | int = -1, j: Column | int = -1) -> Column:
    value = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(value(r).alias("r"), value(i).alias("i"), value(s).alias("s"), value(j).alias("j"))


def _results(where: Callable[[Column], Column]) -> Sites:
    """A site for each result that a test holds for."""
    return lambda results: F.filter(F.transform(results, lambda x, r: F.when(where(x), _site(r))), lambda x: x.isNotNull())


def _parts(name: str, where: Callable[[Column, Column, Column], Column]) -> Sites:
    """A site for each claim or term; the test sees it, all results and its result's place."""
    return lambda results: F.filter(F.flatten(F.transform(results, lambda x, r: F.transform(x[name], lambda p, i: F.when(where(p, results, r), _site(r, i))))), lambda x: x.isNotNull())


def _at(change: Callable[[Column, Column], Column]) -> Apply:
    """Changes the result at a site."""
    return lambda results, site: F.transform(results, lambda x, r: F.when(r == site["r"], change(x, site)).otherwise(x))


def _part(name: str, field: str, value: Callable[[Column, Column, Column], Column]) -> Apply:
    """Changes one field of the claim or term at a site."""

    def apply(results: Column, site: Column) -> Column:
        edit = lambda p, i: F.when(i == site["i"], p.withField(field, value(p, results, site["r"]))).otherwise(p)
        return F.transform(results, lambda x, r: F.when(r == site["r"], x.withField(name, F.transform(x[name], edit))).otherwise(x))

    return apply


def _any(*_: Column) -> Column:
    return F.lit(True)


def _has_claim(x: Column) -> Column:
    return (F.size(x["claims"]) > 0) | (F.size(x["terms"]) > 0)


def _digits(c: Column) -> Column:
    return c.rlike("[0-9]")


def _other_figure(term: Column) -> Column:
    """The first amount of the quote that isn't the value."""
    figures = F.transform(F.regexp_extract_all(term["quote"], F.lit("£[0-9.]*"), F.lit(0)), lambda x: F.rtrim(x, F.lit(".")))
    return F.try_element_at(F.filter(figures, lambda x: x != term["value"]), F.lit(1))


def _foreign_quote(term: Column, results: Column, r: Column) -> Column:
    """The first quote of another result that isn't the term's own."""
    quotes = F.flatten(F.transform(results, lambda x, k: F.when(k != r, F.transform(x["terms"], lambda t: t["quote"])).otherwise(F.array().cast("array<string>"))))
    return F.try_element_at(F.filter(quotes, lambda q: q != term["quote"]), F.lit(1))


def _role_pairs(results: Column) -> Column:
    """Pairs of terms of one name and basis with unlike values."""
    held = F.flatten(F.transform(results, lambda x, r: F.transform(x["terms"], lambda t, i: F.struct(r.alias("r"), i.alias("i"), F.struct(t["term"], t["basis"]).alias("key"), t["value"].alias("value")))))
    later = lambda a, k: F.filter(F.transform(held, lambda b, m: F.when((m > k) & (b["key"] == a["key"]) & (b["value"] != a["value"]), _site(a["r"], a["i"], b["r"], b["i"]))), lambda x: x.isNotNull())
    return F.flatten(F.transform(held, later))


def _swapped_roles(results: Column, site: Column) -> Column:
    value = lambda r, i: F.element_at(F.element_at(results, r + 1)["terms"], i + 1)["value"]
    first, second = value(site["r"], site["i"]), value(site["s"], site["j"])

    def edit(r: Column) -> Callable[[Column, Column], Column]:
        return lambda t, i: t.withField("value", F.when((r == site["r"]) & (i == site["i"]), second).when((r == site["s"]) & (i == site["j"]), first).otherwise(t["value"]))

    return F.transform(results, lambda x, r: x.withField("terms", F.transform(x["terms"], edit(r))))


def _mispaired(results: Column, site: Column) -> Column:
    own = lambda r: F.element_at(results, r + 1)["id"]
    return F.transform(results, lambda x, r: x.withField("id", F.when(r == site["r"], own(site["s"])).when(r == site["s"], own(site["r"])).otherwise(x["id"])))


def _broken(x: Column, site: Column) -> Column:
    first = lambda parts, field: F.transform(parts, lambda p, i: F.when(i == 0, p.withField(field, F.lit(OUTSIDE))).otherwise(p))
    return F.when(F.size(x["claims"]) > 0, x.withField("claims", first(x["claims"], "kind"))).otherwise(x.withField("terms", first(x["terms"], "term")))


OPERATORS: dict[str, Operator] = {
    "drop_claim": Operator("scoring", _parts("claims", _any), _at(lambda x, s: x.withField("claims", F.filter(x["claims"], lambda c, i: i != s["i"])))),
    "invent_claim": Operator("scoring", _results(lambda x: F.size(x["claims"]) == 0), _at(lambda x, s: x.withField("claims", F.array_append(x["claims"], F.struct(F.lit(INVENTED[0]).alias("kind"), F.lit(INVENTED[1]).alias("deadline")))))),
    "deadline_digit": Operator("scoring", _parts("claims", lambda c, _, r: _digits(c["deadline"])), _part("claims", "deadline", lambda c, _, r: X.move_first_digit(c["deadline"]))),
    "omit_item": Operator("pairing", _results(_any), lambda results, site: F.filter(results, lambda x, r: r != site["r"])),
    "foreign_quote": Operator("quote", _parts("terms", lambda t, results, r: _foreign_quote(t, results, r).isNotNull()), _part("terms", "quote", _foreign_quote)),
    "swap_roles": Operator("scoring", _role_pairs, _swapped_roles),
    "wrong_value": Operator("scoring", _parts("terms", lambda t, _, r: _other_figure(t).isNotNull()), _part("terms", "value", lambda t, _, r: _other_figure(t))),
    "duplicate_item": Operator("pairing", _results(_any), lambda results, site: F.flatten(F.transform(results, lambda x, r: F.when(r == site["r"], F.array(x, x)).otherwise(F.array(x))))),
    "mispair": Operator("pairing", lambda results: F.filter(F.transform(results, lambda x, r: F.when(r > 0, _site(r - 1, -1, r))), lambda x: x.isNotNull()), _mispaired),
    "reorder": Operator("none", lambda results: F.when(F.size(results) > 1, F.array(_site(F.lit(0)))).otherwise(F.filter(F.array(_site(F.lit(0))), lambda x: F.lit(False))), lambda results, site: F.reverse(results)),
    "invent_date": Operator("scoring", _parts("claims", lambda c, _, r: ~_digits(c["deadline"])), _part("claims", "deadline", lambda c, _, r: F.lit(DATED))),
    "schema_break": Operator("schema", _results(_has_claim), _at(_broken)),
    "unmodelled_term": Operator("coverage", _parts("terms", _any), _part("terms", "term", lambda t, _, r: F.lit("other"))),
    "shape_break": Operator("value_shape", _parts("terms", _any), _part("terms", "value", lambda t, _, r: F.lit(SHAPELESS))),
    "force_low": Operator("cost", _results(lambda x: _has_claim(x) & (x["confidence"] != "low")), _at(lambda x, s: x.withField("confidence", F.lit("low")))),
    "force_high": Operator("scoring", _results(lambda x: x["confidence"] == "low"), _at(lambda x, s: x.withField("confidence", F.lit("high")))),
}


def mutants(recording: DataFrame, operators: Sequence[str] = tuple(OPERATORS)) -> DataFrame:
    """(operator, contained_by, batch, site, items, truth, results) of every mutant, with
    the recording's further columns."""
    more = [c for c in recording.columns if c not in ("batch", "items", "results")]
    def named(name: str) -> Column:
        return F.transform(OPERATORS[name].sites(F.col("results")), lambda x: F.struct(F.lit(name).alias("operator"), x.alias("site")))

    rows = recording.select("batch", "items", F.col("results").alias("truth"), *more, F.inline(F.concat(*map(named, operators))))
    changed, by = F.lit(None), F.lit(None)
    for n in operators:
        mine = F.col("operator") == n
        changed = F.when(mine, OPERATORS[n].apply(F.col("truth"), F.col("site"))).otherwise(changed)
        by = F.when(mine, OPERATORS[n].contained_by).otherwise(by)
    return rows.select("operator", by.alias("contained_by"), "batch", "site", "items", "truth", changed.alias("results"), *more)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named in it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sound_result(kinds: Sequence[str], terms: dict[str, str]) -> Callable[[Column], Column]:
    """Whether an answer keeps to its schema: kinds of claims, and names of terms."""
    known, names = F.array(*map(F.lit, kinds)), F.array(*map(F.lit, terms))
    return lambda x: F.forall(x["claims"], lambda c: F.array_contains(known, c["kind"])) & F.forall(x["terms"], lambda t: (t["term"] == "other") | F.array_contains(names, t["term"]))


def _decided(item: Column, found: Column, terms: dict[str, str]) -> Column:
    """What becomes of an item of a batch within its schema, by the answers found for it."""
    shapes = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])

    def fault(t: Column) -> Column:
        fits = F.coalesce(X.value_kind(t["value"]) == F.try_element_at(shapes, t["term"]), F.lit(False))
        return F.when(t["term"] == "other", "coverage").when(~quote_in(t["quote"], item["text"]), "quote").when(~quote_in(t["value"], t["quote"]), "value").when(~fits, "value_shape")

    def of_one(n: Column, one: Column) -> Column:
        first = lambda ts: F.try_element_at(F.filter(F.transform(ts, fault), lambda f: f.isNotNull()), F.lit(1))
        why = F.when(n == 0, "missing").when(n > 1, "duplicate").when(one["echo"] != item["text"], "echo").otherwise(first(one["terms"]))
        said = F.to_json(F.struct(F.array_sort(one["claims"]).alias("claims"), F.array_sort(one["terms"]).alias("terms")))
        return _let(why, lambda w: F.struct(w.alias("review"), F.when(w.isNull(), one["confidence"]).alias("level"), F.when(w.isNull(), said).alias("said")))

    return _let(found, lambda f: _let(F.try_element_at(f, F.lit(1)), lambda one: of_one(F.size(f), one)))


def _outside_schema() -> Column:
    return F.struct(F.lit("schema").alias("review"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("said"))


def decisions(items: Column, results: Column, kinds: Sequence[str], terms: dict[str, str]) -> Column:
    """What a replay decides about each item: struct(review, level, said).

    The checks come in the pipeline's order: an answer outside its schema loses the whole
    batch; an item without exactly one answer that echoes it goes to review; so does one
    with a term that the pack doesn't model, whose quote isn't on the page or lacks the
    value, or whose value has a wrong shape (``terms`` names each term's). ``said`` is what
    is asserted, whatever its order.
    """
    decide = lambda item: _decided(item, F.filter(results, lambda x: x["id"] == item["id"]), terms)
    return _let(F.coalesce(F.forall(results, sound_result(kinds, terms)), F.lit(True)), lambda sound: F.transform(items, lambda item: F.when(sound, decide(item)).otherwise(_outside_schema())))


def _unsure(decided: Column) -> Column:
    return F.size(F.filter(decided, lambda d: d["review"].isNotNull() | (d["level"] == "low")))


def _flags(pairs: Column, cost: Column) -> Column:
    """(affected, contained, moved, cost) of decisions as they were and are now."""
    moved = lambda p: p["now"]["review"].isNull() & ~p["now"]["said"].eqNullSafe(p["was"]["said"])
    changed = F.filter(pairs, lambda p: ~p["was"].eqNullSafe(p["now"]))
    return _let(changed, lambda c: F.struct(F.size(c).alias("affected"), ((F.size(c) > 0) & F.forall(c, lambda p: p["now"]["review"].isNotNull())).alias("contained"), F.exists(c, moved).alias("moved"), cost.alias("cost")))


def _effect(results: Column, kinds: Sequence[str], terms: dict[str, str]) -> Column:
    """The flags of a mutant. A site names one or two results, and its operator changes these
    alone (or the order of all): so no item is decided anew but those of their ids, unless
    the batch falls out of its schema."""
    sound = sound_result(kinds, terms)
    own = lambda at: F.when(at >= 0, F.try_element_at(F.col("truth"), at + 1)["id"])
    near = lambda ids, x: F.array_contains(ids, x["id"])

    def of(ids: Column) -> Column:
        zipped = F.filter(F.arrays_zip("items", "was"), lambda z: near(ids, z["items"]))
        mine = lambda rs, item: F.filter(rs, lambda x: x["id"] == item["id"])

        def now(found: Column, z: Column) -> Column:
            return F.when(found == mine(F.col("truth"), z["items"]), z["was"]).otherwise(_decided(z["items"], found, terms))

        def inside(rs: Column) -> Column:
            again = F.transform(zipped, lambda z: _let(mine(rs, z["items"]), lambda found: F.struct(z["was"].alias("was"), now(found, z).alias("now"))))
            part = lambda pairs, side: F.transform(pairs, lambda p: p[side])
            return _let(again, lambda pairs: _flags(pairs, _unsure(part(pairs, "now")) > _unsure(part(pairs, "was"))))

        out = _flags(F.transform("was", lambda w: F.struct(w.alias("was"), _outside_schema().alias("now"))), F.size("was") > _unsure(F.col("was")))
        kept = ~F.col("unsound") | ~F.exists("truth", lambda x: ~near(ids, x) & ~sound(x))
        return _let(F.filter(results, lambda x: near(ids, x)), lambda rs: F.when(F.coalesce(kept & F.forall(rs, sound), F.lit(True)), inside(rs)).otherwise(out))

    return _let(F.array_compact(F.array(own(F.col("site")["r"]), own(F.col("site")["s"]))), of)


def replayed(recording: DataFrame, kinds: Sequence[str], terms: dict[str, str], operators: Sequence[str] = tuple(OPERATORS)) -> DataFrame:
    """(operator, contained_by, batch, site, affected, contained, moved, cost, killed) of
    every mutant.

    Affected items are decided otherwise than in the truth. They are contained if all go
    to review, the score moves if one of them asserts something else, and the cost shifts
    if more items are in review or uncertain than were.
    """
    # each step is exploded out of an array of one, so that what it gives is computed once
    # and not again in every test on it
    once = lambda value, name: F.explode(F.array(value)).alias(name)
    told = recording.select("batch", "items", "results", once(decisions(F.col("items"), F.col("results"), kinds, terms), "was"))
    told = told.withColumn("unsound", ~F.forall("results", sound_result(kinds, terms)))
    rows = mutants(told, operators).select("operator", "contained_by", "batch", "site", F.inline(F.array(_effect(F.col("results"), kinds, terms))))
    return rows.withColumn("killed", killed(F.col("contained_by"), F.col("affected"), F.col("contained"), F.col("moved"), F.col("cost")))


def killed(contained_by: Column, affected: Column, contained: Column, moved: Column, cost: Column) -> Column:
    """Without an effect expected, nothing may move; a cost is to be paid; else the score
    moves, or a person sees all of it."""
    return F.when(contained_by == "none", affected == 0).when(contained_by == "cost", cost | contained).otherwise(moved | contained)


def report(recording: DataFrame, kinds: Sequence[str], terms: dict[str, str], operators: Sequence[str] = tuple(OPERATORS)) -> DataFrame:
    """(operator, contained_by, mutants, affected, contained, killed) of a recording."""
    rows = replayed(recording, kinds, terms, operators)
    return rows.groupBy("operator", "contained_by").agg(F.count("*").alias("mutants"), F.count_if(F.col("affected") > 0).alias("affected"), F.count_if("contained").alias("contained"), F.count_if("killed").alias("killed"))


def survivors(recording: DataFrame, kinds: Sequence[str], terms: dict[str, str]) -> DataFrame:
    """(item, survivor_operator, site) of the mutants that nothing caught."""
    rows = replayed(recording, kinds, terms).where("NOT killed")
    return rows.select(F.col("batch").cast("string").alias("item"), F.col("operator").alias("survivor_operator"), F.to_json("site").alias("site"))


def triage(survivors: DataFrame, families: DataFrame) -> DataFrame:
    """(family, allowed, found, over): each survivor counts for its first matching family."""
    joined = survivors.join(families, F.expr("survivor_operator = operator AND (item_prefix IS NULL OR startswith(item, item_prefix))"), "left")
    first = joined.groupBy("item", "survivor_operator", "site").agg(F.min_by("family", "rank").alias("family"))
    found = first.where("family IS NOT NULL").groupBy("family").agg(F.count("*").alias("found"))
    return families.select("family", "allowed").distinct().join(found, "family", "left").select("family", "allowed", F.coalesce("found", F.lit(0)).alias("found")).withColumn("over", F.greatest(F.col("found") - F.col("allowed"), F.lit(0)))
