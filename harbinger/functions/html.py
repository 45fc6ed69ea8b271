"""Plain text and table cells from HTML, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbinger.functions.textnorm import collapse

#: Fixed values, replaced in this order.
ENTITIES = (("&amp;", "&"), ("&#038;", "&"), ("&#8217;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))


def unescape(x: Column) -> Column:
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def strip_tags(x: Column) -> Column:
    """Text outside tags; a tag that never ends takes the rest, and every > goes."""
    return collapse(unescape(F.translate(F.regexp_replace(x, r"<[^>]*(>|\z)", ""), ">", "")))


def raw_cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1)


def cells(row: Column) -> Column:
    return F.transform(raw_cells(row), strip_tags)
