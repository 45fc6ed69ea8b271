"""Normal forms of addresses, names and dates, as columns. Lengths are in bytes, white space is Unicode's."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that matching depends on.
UNIT_TOKENS = ("APT", "UNIT", "STE", "SUITE", "RM", "FL", "#")
SUFFIXES = {
    "STREET": "ST", "AVENUE": "AVE", "AV": "AVE", "BOULEVARD": "BLVD", "BL": "BLVD", "DRIVE": "DR", "ROAD": "RD", "LANE": "LN", "PLACE": "PL", "COURT": "CT", "TERRACE": "TER", "TR": "TER",
    "HIGHWAY": "HWY", "HY": "HWY", "WY": "WAY", "CIRCLE": "CIR", "CI": "CIR", "PARKWAY": "PKWY", "PW": "PKWY", "ALLEY": "ALY", "AL": "ALY",
}
HOUSE_WORDS = {"ONE": "1", "TWO": "2", "THREE": "3", "FOUR": "4", "FIVE": "5", "SIX": "6", "SEVEN": "7", "EIGHT": "8", "NINE": "9", "TEN": "10"}
ORDINALS = {
    "FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH", "EIGHTH": "8TH", "NINTH": "9TH", "TENTH": "10TH",
    "ELEVENTH": "11TH", "TWELFTH": "12TH", "THIRTEENTH": "13TH", "FOURTEENTH": "14TH", "FIFTEENTH": "15TH", "SIXTEENTH": "16TH", "SEVENTEENTH": "17TH", "EIGHTEENTH": "18TH", "NINETEENTH": "19TH", "TWENTIETH": "20TH",
}
ENTITY_SUFFIXES = ("LLC", "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LP", "LLP", "LTD")
#: Shorter keys say too little to match on.
MIN_ADDRESS_BYTES, MIN_NAME_BYTES = 5, 4


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value, else the key itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key), key)


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread(key: Column, *own: str) -> Column:
    """The key for a join that empty keys never meet: they become keys of their own, so that they are no single task's."""
    return bound(key, lambda k: F.when(k == "", F.concat(F.lit("\0"), *own)).otherwise(k))


def text(x: Column) -> Column:
    """Never null: a missing text is empty."""
    return F.coalesce(x, F.lit(""))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often `use` reads it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def address_key(address: Column) -> Column:
    """One form per building: upper case, no unit, digits for ordinals and house number, short street suffix."""

    def without_unit(t: Column) -> Column:
        unit = F.array_min(F.filter(F.transform(t, lambda x, i: F.when(x.isin(*UNIT_TOKENS), i)), lambda i: i.isNotNull()))
        return bound(F.coalesce(unit, F.lit(0)), lambda u: F.when(u > 0, F.slice(t, F.lit(1), F.greatest(u, F.lit(0)))).otherwise(t))

    def house(x: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(x, r"^([0-9]+)-[0-9]+$", 1), F.lit("")), lookup(HOUSE_WORDS, x))

    def joined(t: Column) -> Column:
        first = lambda x, i: F.when(i == 0, house(lookup(ORDINALS, x))).otherwise(lookup(ORDINALS, x))
        return F.array_join(F.transform(F.transform(t, first), lambda x, i: F.when(i == F.size(t) - 1, lookup(SUFFIXES, x)).otherwise(x)), " ")

    return bound(bound(tokens(F.translate(F.upper(text(address)), ",.", "")), without_unit), joined)


def matchable_address(address: Column) -> Column:
    """The address key, or empty where it is too short."""
    return bound(address_key(address), lambda key: F.when(F.octet_length(key) >= MIN_ADDRESS_BYTES, key).otherwise(""))


def normal_name(name: Column) -> Column:
    """Upper case, apostrophes gone, other marks to spaces, without company suffixes at the end."""
    x = F.translate(F.upper(text(name)), "'’", "")
    x = collapse(F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}]", " "))
    ends = "|".join(ENTITY_SUFFIXES)
    return F.regexp_replace(x, rf"(^| )({ends})( ({ends}))*$", "")


def name_key(name: Column) -> Column:
    """The normal name with plurals folded, token by token."""
    fold = lambda t: F.when((F.octet_length(t) > 3) & F.endswith(t, F.lit("S")) & ~F.endswith(t, F.lit("SS")), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.array_join(F.transform(F.split(normal_name(name), " "), fold), " ")


def matchable_name(name: Column) -> Column:
    """The name key, or empty where it is too short."""
    return bound(name_key(name), lambda key: F.when(F.octet_length(key) >= MIN_NAME_BYTES, key).otherwise(""))


def normal_date(x: Column) -> Column:
    """yyyy-mm-dd as text from an ISO time stamp or eight digits; empty stays empty."""
    x = trim(text(x))
    dashed = F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
    return F.when(x.rlike("^[0-9]{8}$"), dashed).otherwise(F.substring(x, 1, 10))


def without_zip(address: Column) -> Column:
    """White space collapsed, a last token of five digits dropped."""
    t = tokens(text(address))
    last = F.try_element_at(t, F.lit(-1))
    return F.array_join(F.when(F.coalesce(last.rlike("^[0-9]{5}$"), F.lit(False)), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t), " ")


def truncated(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most - 3), r"(?U)\s+$", ""), F.lit("...")))
