"""Frames written once in the folder that driver and executors share, where many steps read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, the warehouse, or a new folder of a local session."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.startswith("local")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as files, which go when the application ends: computed once, and a short plan for what follows."""
    spark = df.sparkSession
    at = f"{scratch(spark)}/harbinger-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    df.write.parquet(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)
