"""What the operators of this package share: inputs, tables in the shared scratch folder, queues in id order."""

from __future__ import annotations

import ctypes
import itertools
import re
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side that was counted may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that goes to a Python worker; a row that is larger is a batch of its own.
BATCH_BYTES = 4 << 20
_SERIAL = itertools.count()
_RUN = uuid.uuid4().hex[:12]
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where unset, one of our own."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        top = "file:///tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{top.rstrip('/')}/harbinger-{_RUN}"


def table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df once to the shared folder and returns what was written: cuts lineage and survives lost executors.

    The files go with `discard`, or when the application ends.
    """
    spark = df.sparkSession
    at = f"{scratch(spark)}/{next(_SERIAL)}-{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.option("compression", compression).parquet(at)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    _PLACES[out] = at
    return out


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(setting: str | None) -> float:
    """Of a size as Spark writes it; endless where there is none."""
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", (setting or "").strip().lower())
    return int(m[1]) << 10 * "kmgt".find(m[2]) + 10 if m and m[2] else int(m[1]) if m else float("inf")


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `table` wrote and nothing will read again."""
    for df in tables:
        at = _PLACES.pop(df, None) if df is not None else None
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with batches bounded in bytes, as rows may be long texts; a worker gives freed memory back when its
    task ends. The bound is set on the session unless that has a lower one, and stays: plans are made when they run."""
    if _bytes(df.sparkSession.conf.get(_BATCH, None)) > BATCH_BYTES:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns this process's freed memory to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that other columns cannot clash; null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in more], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sized_join(left: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Joins a side whose rows were counted: broadcast up to BROADCAST_ROWS, else left to a shuffle join."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def running(batches: Iterator[pa.RecordBatch], queue: str, size: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """For each batch of a partition, the sum of size over earlier rows of the same queue in this partition."""
    done: dict = {}
    for b in batches:
        keys = b.column(queue).to_pylist()
        sizes = b.column(size).to_pylist()
        before = np.empty(len(keys), np.int64)
        for k, (key, n) in enumerate(zip(keys, sizes, strict=True)):
            before[k] = have = done.get(key, 0)
            done[key] = have + n
        yield b, before


def with_offsets(rows: DataFrame) -> tuple[DataFrame, dict]:
    """rows: (part, queue, before, n, ...) as written in id order. Adds `base`, the sum of n over all earlier rows of
    the queue, and returns each queue's total. Only one sum per part and queue is shuffled; queues are bounded."""
    heads = rows.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = table(heads.withColumn("head", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "heads")
    totals = {r["queue"]: int(r["n"]) for r in heads.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    out = sized_join(rows, heads.select("part", "queue", "head"), ["part", "queue"], heads.count())
    return out.withColumn("base", F.col("before") + F.col("head")).drop("head"), totals


#: Queues by source; where there are more sources, several share a queue.
MOST_QUEUES = 4096


def queue_column(df: DataFrame, source_col: str, own: Iterable[str] = ()) -> Column:
    """A key per source that is never null: 's' and the source, or 'n' for null; past MOST_QUEUES sources hashed, except
    for the keys in own."""
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    few = df.select(key.alias("k")).distinct().limit(MOST_QUEUES + 1).count() <= MOST_QUEUES
    shared = F.concat(F.lit("h"), F.pmod(F.xxhash64(key), F.lit(MOST_QUEUES)).cast("string"))
    return key if few else F.when(key.isin(*own), key).otherwise(shared)
