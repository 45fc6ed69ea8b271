"""Corroboration by other sources' filings at an address or under a name, and inherited neighborhoods.

The history of a key is cut to its newest filings of each source before anything is gathered (a window limit that
Spark applies before the shuffle), so a tower with a million filings is a short array like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.functions.textnorm import matchable_address, matchable_name, spread, trim

#: Stored rows that count: a signal of their own, at an address.
MIN_SCORE = 2
ADDRESS_BONUS, NAME_BONUS = 2, 1
ADDRESS_HITS, NAME_HITS, HISTORY_HITS = 3, 2, 10
ENTRY = "struct<date:string,source:string,name:string>"


def corroborators(signals: DataFrame) -> DataFrame:
    """(source, name, address, date) of rows that may corroborate, delivered and future ones too."""
    return signals.where((F.col("address") != "") & (F.col("score") >= MIN_SCORE)).select("source", "name", "address", "date")


def newest_first(x: Column) -> Column:
    """Newest first, then by source and name."""
    less = lambda a, b: F.when(a["date"] > b["date"], -1).when(a["date"] < b["date"], 1).when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    return F.array_sort(x, less)


def index(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """(key, filings): the newest distinct filings of every key, at most `most` of each source."""
    order = Window.partitionBy("key", "source").orderBy(F.col("date").desc(), "name")
    # exploded, so that the filter is not moved below the key, which would then be made twice
    rows = rows.select(F.explode(F.array(key)).alias("key"), "source", "name", "date").where("key <> ''")
    rows = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return rows.groupBy("key").agg(newest_first(F.collect_list(F.struct("date", "source", "name"))).alias("filings"))


def address_index(history: DataFrame) -> DataFrame:
    return index(history, matchable_address(F.col("address")), HISTORY_HITS)


def name_index(history: DataFrame) -> DataFrame:
    return index(history, matchable_name(F.col("name")), NAME_HITS)


def listed_index(lists: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, filings) of the keys (key, distinct) from a store's lists (key, source, items): what `index` gives, without the history."""
    rows = lists.join(keys, "key", "left_semi").select("key", F.explode(F.transform("items", lambda i: F.struct(i["date"].alias("date"), F.col("source").alias("source"), i["name"].alias("name")))).alias("f"))
    return rows.groupBy("key").agg(newest_first(F.collect_list("f")).alias("filings"))


def listed_neighborhoods(lists: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, inherited) of the keys from a store's lists of neighborhoods."""
    first = F.col("items")[0]
    return lists.join(keys, "key", "left_semi").groupBy("key").agg(F.min_by(first["name"], F.struct(first["date"], F.col("source"), first["id"])).alias("inherited"))


def others(filings: Column, source: Column, most: int) -> Column:
    return F.slice(F.filter(F.coalesce(filings, F.array().cast(f"array<{ENTRY}>")), lambda x: x["source"] != source), 1, most)


def listed(found: Column) -> Column:
    """source: name (date), ..."""
    return F.array_join(F.transform(found, lambda x: F.concat(x["source"], F.lit(": "), x["name"], F.lit(" ("), x["date"], F.lit(")"))), ", ")


def corroborate(entries: DataFrame, addresses: DataFrame, names: DataFrame) -> DataFrame:
    """The entries with score and reasons raised by other sources at the same address (+2), then under the same name (+1),
    and with `filings`, the newest at their address."""
    keyed = entries.withColumns({"_a": spread(matchable_address(F.col("address")), "source", "id"), "_n": spread(matchable_name(F.col("name")), "source", "id")})
    a, n = addresses.select(F.col("key").alias("_a"), F.col("filings").alias("_at")), names.select(F.col("key").alias("_n"), F.col("filings").alias("_as"))
    rows = keyed.join(a, "_a", "left").join(n, "_n", "left")
    rows = rows.withColumn("filings", F.slice(F.coalesce("_at", F.array().cast(f"array<{ENTRY}>")), 1, HISTORY_HITS))
    rows = rows.withColumns({"_at": others(F.col("_at"), F.col("source"), ADDRESS_HITS), "_as": others(F.col("_as"), F.col("source"), NAME_HITS)})
    by = lambda c, points: F.when(F.size(c) > 0, points).otherwise(0)
    because = lambda c, words: F.when(F.size(c) > 0, F.array(F.concat(F.lit(words), listed(F.col(c))))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({
        "score": F.col("score") + by("_at", ADDRESS_BONUS) + by("_as", NAME_BONUS), "reasons": F.concat("reasons", because("_at", "corroborated by "), because("_as", "name also in ")),
    }).select(*entries.columns, "filings")


def neighborhoods(signals: DataFrame) -> DataFrame:
    """(key, inherited): for each address, the neighborhood of its first filing that has one."""
    rows = signals.where((F.col("address") != "") & (trim(F.col("neighborhood")) != ""))
    rows = rows.select(matchable_address(F.col("address")).alias("key"), "neighborhood", "first_seen", "source", "external_id").where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("neighborhood", F.struct("first_seen", "source", "external_id")).alias("inherited"))


def inherit(entries: DataFrame, hoods: DataFrame) -> DataFrame:
    """The entries, empty neighborhoods filled from their address."""
    rows = entries.withColumn("_k", spread(matchable_address(F.col("address")), "source", "id")).join(hoods.withColumnRenamed("key", "_k"), "_k", "left")
    filled = F.coalesce(F.nullif(F.col("neighborhood"), F.lit("")), F.col("inherited"), F.lit(""))
    return rows.withColumn("neighborhood", filled).select(*entries.columns)
