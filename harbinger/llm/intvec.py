"""Vectors as whole numbers: which rows count, floors of scaled components, and joins whose frequent keys are no single task's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components are held within this, so that products and squared differences of vectors fit a long.
LIMIT = 1 << 27
#: A key is frequent from this share of all rows on, so there are at most as many frequent keys as its inverse.
FREQUENT = 1000


def sound(v: Column) -> Column:
    """Not null, and no component null or not finite. An empty vector is sound."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def floors(v: Column, scale: int) -> Column:
    """floor(scale * x) of every component, held within LIMIT."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """The same of an array of doubles, as doubles."""
    return np.floor(np.clip(x * scale, -LIMIT, LIMIT))


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column without nulls, shorter ones filled with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((sizes.size, width), kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def long_sum(x: Column) -> Column:
    """A sum that stops at the largest long where it would pass it."""
    return F.least(F.sum(x.cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def frequent_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, spread: Column) -> DataFrame:
    """left and, for each of its rows, the columns of right, which has one row a key and in `rows` how often left has it.

    Keys of more than total / FREQUENT rows, which cannot be more than FREQUENT for each time that left repeats a row of
    the table counted by total, are broadcast; rows of all others, and only these, meet in a shuffle. `spread` is any
    number that differs between rows of left: it deals the rows that have their values already."""
    more = [c for c in right.columns if c not in on and c != rows]
    often = F.broadcast(right.where(F.col(rows) * FREQUENT > total).select(*on, F.struct(*more).alias("_often")))
    seldom = right.where(F.col(rows) * FREQUENT <= total).select(*on, F.struct(*more).alias("_seldom"), F.lit(0).cast("long").alias("_deal"))
    out = left.join(often, on, "left").withColumn("_deal", F.when(F.col("_often").isNull(), 0).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long"))))
    out = out.join(seldom, [*on, "_deal"], "left").withColumn("_got", F.coalesce("_often", "_seldom"))
    return out.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in more])
