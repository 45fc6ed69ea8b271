"""Fields of semi-structured rows: a raw JSON text becomes a VARIANT, and only values of the asked kind count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbinger.functions.textnorm import trim


def parsed(raw: Column) -> Column:
    """Null where the text is no JSON."""
    return F.try_parse_json(raw)


def kind(row: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(row, f"$.{key}", "variant"))


def field(row: Column, key: str) -> Column:
    """A string field, trimmed; empty where it is missing or no string."""
    value = F.when(kind(row, key) == "STRING", F.try_variant_get(row, f"$.{key}", "string"))
    return F.coalesce(trim(value), F.lit(""))


def number(row: Column, key: str) -> Column:
    """A number, or a string that reads as one; NaN and all else are null."""
    text = trim(F.try_variant_get(row, f"$.{key}", "string"))
    sound = F.when(kind(row, key).isin("BIGINT", "DOUBLE") | kind(row, key).startswith("DECIMAL"), F.try_variant_get(row, f"$.{key}", "double"))
    read = F.when((kind(row, key) == "STRING") & text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.coalesce(sound, read)


def flag(row: Column, key: str) -> Column:
    """True for the JSON value true only."""
    return F.coalesce((kind(row, key) == "BOOLEAN") & F.try_variant_get(row, f"$.{key}", "boolean"), F.lit(False))
