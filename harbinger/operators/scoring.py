"""Scoring rules. Each takes columns and gives a score and its reasons; rules are column algebra without Python code on rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbinger.functions.fields import field, flag, number
from harbinger.functions.textnorm import ascii_lower, bound

# Fixed values; their order is that of the reasons.
PERMIT_WORDS = (
    "restaurant", "cafe", "coffee", "bakery", "boba", "tea shop", "ice cream", "gelato", "taqueria", "pizzeria", "pizza", "ramen", "sushi", "izakaya", "poke", "deli", "bistro", "brewery", "taproom", "brewpub", "winery",
    "tasting room", "food hall", "juice", "grocery", "butcher", "retail", "storefront", "salon", "gym",
)
PLANNING_WORDS = ("food service", "takeout", "take-out", "outdoor dining", "nighttime entertainment", "formula retail")
TRADE_WORDS = ("restaurant", "food service", "cafe", "cafeteria", "bakery", "commercial kitchen", "espresso", "brewery", "taproom", "pizza oven", "walk-in cooler", "walk-in freezer", "type 1 hood")
PLUMBING_WORDS = (*TRADE_WORDS, "grease")
VENDING_WORDS = ("food", "coffee", "drink", "juice", "taco", "hot dog", "fruit", "snack", "dessert", "ice cream")
LICENSE_WORDS = ("RESTAURANT", "FOOD", "CAFE", "CATERING", "BAR")
#: "bar" after one of these is no place to drink.
BAR_COMPOUNDS = ("wet", "grab", "towel", "handle")
LICENSE_CLASSES = {41: ("restaurant", 3), 47: ("restaurant", 3), 75: ("restaurant", 3), 40: ("bar", 3), 42: ("bar", 3), 48: ("bar", 3), 61: ("bar", 3), 20: ("off-sale shop", 2), 21: ("off-sale shop", 2)}


def rule(*parts: tuple[Column, int, Column]) -> Column:
    """Parts are (whether it holds, points, reason): a struct of the summed score and the reasons that hold."""
    score = sum((F.when(F.coalesce(c, F.lit(False)), points).otherwise(0) for c, points, _ in parts), F.lit(0))
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), r) for c, _, r in parts]), lambda r: r.isNotNull())
    return F.struct(score.cast("int").alias("score"), reasons.alias("reasons"))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return bound(text, lambda t: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """The words found, in list order, and bar, if it stands alone."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.concat(found, F.when(has_bar(text), F.array(F.lit("bar"))).otherwise(F.array().cast("array<string>")))


def has_bar(text: Column) -> Column:
    split = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")

    def alone(words: Column) -> Column:
        return F.exists(F.transform(words, lambda w, i: (w == "bar") & ~F.coalesce(F.when(i > 0, F.get(words, i - 1).isin(*BAR_COMPOUNDS)), F.lit(False))), lambda x: x)

    return bound(split, alone)


def with_values(given: dict[str, Column], score: Callable[[Column], Column]) -> Column:
    """score of a struct of the given columns: each is computed once a row, however often conditions and reasons name it."""
    return bound(F.struct(*[c.alias(k) for k, c in given.items()]), score)


def with_hits(given: dict[str, Column], words: tuple[str, ...], score: Callable[[Column], Column]) -> Column:
    """with_values, and with them the words `found` in `desc`."""
    return with_values(given, lambda x: with_values({**{k: x[k] for k in given}, "found": hits(x["desc"], words)}, score))


def money(x: Column) -> Column:
    """Whole units, halves to even."""
    return F.format_string("%.0f", F.bround(x, 0))


def business(row: Column) -> Column:
    def score(x: Column) -> Column:
        lic, naics, dba, owner, food = (x[k] for k in ("lic", "naics", "dba", "owner", "food"))
        drink = ~food & naics.startswith("3121")
        retail = ~food & ~drink & (naics.startswith("44") | naics.startswith("45"))
        other = (dba != "") & (ascii_lower(dba) != ascii_lower(owner))
        return rule(
            (food, 2, F.concat(F.lit("food service (lic: "), lic, F.lit(", NAICS: "), naics, F.lit(")"))), (drink, 2, F.concat(F.lit("beverage producer (NAICS: "), naics, F.lit(")"))),
            (retail, 2, F.concat(F.lit("retail (NAICS: "), naics, F.lit(")"))), (other, 1, F.concat(F.lit('new DBA "'), dba, F.lit('" differs from owner "'), owner, F.lit('"'))),
        )

    given = {k: field(row, c) for k, c in (("lic", "lic_code_description"), ("naics", "self_reported_naics_code"), ("dba", "dba_name"), ("owner", "ownership_name"))}
    food = lambda x: x["naics"].startswith("722") | any_of(F.upper(x["lic"]), LICENSE_WORDS)
    return with_values(given, lambda x: with_values({**{k: x[k] for k in given}, "food": food(x)}, score))


def permit(row: Column) -> Column:
    def score(x: Column) -> Column:
        desc, use, cost, found = x["desc"], x["use"], x["cost"], x["found"]
        opens = (F.get(F.split(desc, r"(?U)\s+"), F.lit(0)) == "new") | F.contains(desc, F.lit("new business"))
        return rule(
            (F.size(found) > 0, 2, F.concat(F.lit("keyword: "), F.array_join(found, ", "))), (F.contains(desc, F.lit("change of use")), 1, F.lit("change of use")),
            (F.contains(desc, F.lit("tenant improvement")), 1, F.lit("tenant improvement")), (opens, 1, F.lit("new business")),
            (any_of(F.lower(use), ("restaurant", "retail", "store")), 1, F.concat(F.lit("proposed use: "), use)), (cost > 100000, 1, F.concat(F.lit("estimated cost $"), money(cost))),
        )

    return with_hits({"desc": F.lower(field(row, "description")), "use": field(row, "proposed_use"), "cost": number(row, "estimated_cost")}, PERMIT_WORDS, score)


def entertainment(row: Column) -> Column:
    def score(x: Column) -> Column:
        return rule((F.lit(True), 2, F.lit("new entertainment venue")), (x["kind"] != "", 1, F.concat(F.lit("license type: "), x["kind"])))

    return with_values({"kind": field(row, "license_type")}, score)


def planning(row: Column) -> Column:
    def score(x: Column) -> Column:
        desc, found = x["desc"], x["found"]
        return rule((F.size(found) > 0, 2, F.concat(F.lit("planning application keyword: "), F.array_join(found, ", "))), (F.contains(desc, F.lit("change of use")), 1, F.lit("change of use")))

    return with_hits({"desc": F.lower(field(row, "description"))}, PERMIT_WORDS + PLANNING_WORDS, score)


def fire(row: Column) -> Column:
    def score(x: Column) -> Column:
        has = lambda w: F.contains(x["kind"], F.lit(w))
        return rule((has("place of assembly") & ~has("temporary") & ~has("special") | has("commercial cooking") | has("hood"), 3, F.concat(F.lit("fire permit: "), x["kind"])))

    return with_values({"kind": F.lower(field(row, "permit_type_description"))}, score)


def vending(row: Column) -> Column:
    goods = F.lower(F.concat(field(row, "whatwillyoubeselling"), F.lit(" "), field(row, "describewhatyouwillsell")))
    return with_values({"food": any_of(goods, VENDING_WORDS)}, lambda x: rule((F.lit(True), 2, F.lit("street vending permit")), (x["food"], 1, F.lit("food vendor"))))


def tables_chairs(row: Column) -> Column:
    def score(x: Column) -> Column:
        tables, display = x["tables"], x["display"]
        return rule(
            (tables, 3, F.lit("sidewalk tables & chairs registration — outdoor seating")), (~tables & display, 2, F.lit("sidewalk merchandise display registration")),
            (~tables & ~display, 2, F.lit("Shared Spaces sidewalk registration")),
        )

    return with_values({"tables": flag(row, "tablesandchairs"), "display": flag(row, "displaymerchandise")}, score)


def mobile_food(row: Column) -> Column:
    return rule((F.lit(True), 2, F.lit("new mobile food permit")), (ascii_lower(field(row, "facilitytype")) == "truck", 1, F.lit("food truck")))


def trade(words: tuple[str, ...], cost_field: str):
    """The rule of a trade's permits: strong words, else a kitchen; a high valuation."""

    def score(x: Column) -> Column:
        desc, cost, found = x["desc"], x["cost"], x["found"]
        return rule(
            (F.size(found) > 0, 2, F.concat(F.lit("keyword: "), F.array_join(found, ", "))), ((F.size(found) == 0) & F.contains(desc, F.lit("kitchen")), 1, F.lit("keyword: kitchen")),
            (cost > 50000, 1, F.concat(F.lit("valuation $"), money(cost))),
        )

    return lambda row: with_hits({"desc": F.lower(field(row, "description")), "cost": number(row, cost_field)}, words, score)


electrical = trade(TRADE_WORDS, "permit_valuation")
plumbing = trade(PLUMBING_WORDS, "valuation")


def license_score(license_type: Column, action: Column, issued: bool = False) -> Column:
    """Of a liquor license by class and action; other classes score 0 without a reason."""
    label, base = (F.create_map(*[F.lit(x) for k, v in LICENSE_CLASSES.items() for x in (k, v[i])]) for i in (0, 1))
    kind = F.try_element_at(label, license_type)
    a = F.upper(F.trim(action))
    note = F.when(F.contains(a, F.lit("PRM")), ", premises transfer").when(a == "ORI", ", new license").when(a == "PER", ", ownership transfer at existing premises").otherwise("")
    score = F.greatest(F.try_element_at(base, license_type) + int(issued) - F.when(a == "PER", 1).otherwise(0), F.lit(0))
    reason = F.concat(F.lit(f"liquor license {'issued' if issued else 'application'}: type "), license_type.cast("string"), F.lit(" ("), kind, F.lit(")"), note)
    return F.struct(F.coalesce(score, F.lit(0)).cast("int").alias("score"), F.when(kind.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason)).alias("reasons"))


def first_inspection(first: Column) -> Column:
    return rule((first, 3, F.lit("first health inspection since 2024")))
