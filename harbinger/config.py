"""Settings: a TOML file beside the store with one optional string, app_token."""

from __future__ import annotations

import sys
import tomllib
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    app_token: str | None = None


def path_for(store: str) -> str:
    """config.toml in the folder that the store's folder is in."""
    return f"{store.rstrip('/').rpartition('/')[0] or '.'}/config.toml"


def parse(text: str) -> Config:
    value = tomllib.loads(text).get("app_token")
    if value is not None and not isinstance(value, str):
        raise ValueError("app_token must be a string")
    return Config(value)


def read(path: str, spark: SparkSession) -> str | None:
    """By the store's own file system, whatever its scheme; None where there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def load(store: str, spark: SparkSession) -> Config:
    """Missing is fine; unreadable or invalid warns and counts as missing."""
    path = path_for(store)
    try:
        text = read(path, spark)
        return parse(text) if text is not None else Config()
    except (OSError, ValueError, PySparkException, Py4JError) as e:
        print(f"warning: {path}: {e}", file=sys.stderr)
        return Config()


def app_token(env: str | None, config: Config) -> str | None:
    """The environment's before the file's; blank is unset."""
    return next((t.strip() for t in (env, config.app_token) if t and t.strip()), None)
