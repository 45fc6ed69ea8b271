"""Venues: entries at one building, or under one name where they have no usable address.

Entries of different addresses never merge, and an entry without one joins at most one name group, so each
component is a star with a closed form; no graph is iterated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.functions.textnorm import matchable_address, matchable_name, spread
from harbinger.operators.corroborate import ENTRY

#: Fixed order: whose name a venue shows.
NAME_PRIORITY = ("abc", "health", "business", "tables_chairs", "entertainment", "mobile_food", "vending", "planning", "fire", "permit", "electrical", "plumbing")
HISTORY_SHOWN = 5


def source_rank(source: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, NAME_PRIORITY)), source)
    return F.when(at == 0, len(NAME_PRIORITY)).otherwise(at - 1).cast("int")


def newest(date: Column) -> Column:
    """Sorts ascending as dates sort descending; empty comes last."""
    return F.when(date == "", "~").otherwise(F.translate(date, "0123456789", "9876543210"))


def place(prefix: str = "") -> Column:
    """The position of an entry in the digest's first order: newest first, then source and id."""
    return F.struct(newest(F.col(f"{prefix}date")).alias("d"), F.col(f"{prefix}source").alias("s"), F.col(f"{prefix}id").alias("i"))


def assign(entries: DataFrame) -> DataFrame:
    """The entries with venue_key: A: and the address, N: and the name, or I: and the entry itself."""
    rows = entries.withColumns({"_a": matchable_address(F.col("address")), "_n": matchable_name(F.col("name"))})
    # The anchor of a name is one row per name, so no window gathers a name's entries.
    anchors = rows.where("_a <> '' and _n <> ''").groupBy("_n").agg(F.min_by("_a", place()).alias("_anchor"))
    rows = rows.withColumn("_s", spread(F.col("_n"), "source", "id")).join(anchors.withColumnRenamed("_n", "_s"), "_s", "left").drop("_s")
    key = F.when(F.col("_a") != "", F.concat(F.lit("A:"), "_a")).when(F.col("_anchor").isNotNull(), F.concat(F.lit("A:"), "_anchor")).when(F.col("_n") != "", F.concat(F.lit("N:"), "_n"))
    return rows.withColumns({"venue_key": F.coalesce(key, F.concat(F.lit("I:"), "source", F.lit(":"), "id")), "addressed": F.col("_a") != ""}).drop("_a", "_n", "_anchor")


def _member() -> Column:
    """The order of a venue's entries: newest first, then the strongest, then source and id."""
    return F.struct(newest(F.col("date")).alias("d"), (-F.col("score")).alias("n"), F.col("source").alias("s"), F.col("id").alias("i"))


def summarize(assigned: DataFrame) -> DataFrame:
    """A row per venue: name, address, neighborhood, score, date, root, n_entries, first_id and history (at most
    HISTORY_SHOWN, of the `filings` that entries have with their address, if they have them). Its entries stay rows of
    their own (see `members`), so a venue with very many is a short row too."""
    none = F.array().cast(f"array<{ENTRY}>")
    rows = assigned.withColumns({"_m": _member(), "_p": place(), "_f": F.col("filings") if "filings" in assigned.columns else none})
    namer = F.struct(source_rank(F.col("source")).alias("r"), (-F.col("score")).alias("n"), F.col("_m").alias("m"))
    out = rows.groupBy("venue_key").agg(
        F.max("score").alias("score"), F.max("date").alias("date"),
        F.coalesce(F.min_by(F.struct("name", "address", "_f"), F.when(F.col("name") != "", namer)), F.min_by(F.struct("name", "address", "_f"), F.col("_m"))).alias("_best"),
        F.min_by(F.struct("address", "_f"), F.when(F.col("address") != "", F.col("_m"))).alias("_address"), F.min_by("neighborhood", F.when(F.col("neighborhood") != "", F.col("_m"))).alias("_hood"),
        F.coalesce(F.min(F.when(F.col("addressed"), F.col("_p"))), F.min("_p")).alias("root"), F.count(F.lit(1)).alias("n_entries"), F.min_by("id", "_m").alias("first_id"),
    )
    own = F.col("_best.address") != ""
    address, filed = F.when(own, F.col("_best.address")).otherwise(F.coalesce("_address.address", F.lit(""))), F.when(own, F.col("_best._f")).otherwise(F.coalesce("_address._f", none))
    name = F.coalesce(F.nullif(F.col("_best.name"), F.lit("")), F.nullif(address, F.lit("")), F.lit("(unnamed)"))
    out = out.select("venue_key", name.alias("name"), address.alias("address"), F.coalesce("_hood", F.lit("")).alias("neighborhood"), "score", "date", "root", "n_entries", "first_id", filed.alias("_f"))
    if "filings" not in assigned.columns:
        return out.withColumnRenamed("_f", "history")
    # of the newest filings at the venue's address those that are no entries of it: a few rows a venue are joined
    had = out.select("venue_key", F.posexplode("_f").alias("place", "h")).select("venue_key", "place", "h.*")
    left = had.join(assigned.select("venue_key", "source", "name", "date").distinct(), ["venue_key", "source", "name", "date"], "left_anti")
    earlier = left.groupBy("venue_key").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", F.struct("date", "source", "name").alias("h")))), 1, HISTORY_SHOWN).alias("x"))
    return out.drop("_f").join(earlier, "venue_key", "left").withColumn("history", F.coalesce(F.transform("x", lambda x: x["h"]), none)).drop("x")


def members(assigned: DataFrame) -> DataFrame:
    """The entries with venue_key and their position in the venue, from 1: a sort within the venue's key, which spills."""
    return assigned.withColumn("position", F.row_number().over(Window.partitionBy("venue_key").orderBy(_member()))).drop("addressed", "filings")


def bucket(score: Column) -> Column:
    return F.when(score >= 4, "strong").when(score >= 2, "watch").otherwise("low")


def display_order(venues: DataFrame, min_score: int) -> DataFrame:
    """Venues of at least min_score with the keys they are shown by: bucket, neighborhood by its best venue, and the venue's
    rank in its neighborhood."""
    rows = venues.where(F.col("score") >= min_score).withColumns({"bucket": bucket(F.col("score")), "hood": F.when(F.col("neighborhood") == "", "Unknown neighborhood").otherwise(F.col("neighborhood"))})
    best = Window.partitionBy("bucket", "hood")
    top = F.max(F.struct("score", "date")).over(best)
    rank = F.when(F.col("bucket") == "strong", 0).when(F.col("bucket") == "watch", 1).otherwise(2)
    place = F.row_number().over(best.orderBy(F.col("score").desc(), F.col("date").desc(), "root"))
    return rows.withColumns({"bucket_rank": rank, "hood_score": top["score"], "hood_date": top["date"], "venue_rank": place})


def filings(shown: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per filing of the shown venues, in display order: by bucket_rank, hood_score and hood_date descending, neighborhood_shown,
    venue_rank, position. entries: as `members` gives them."""
    venue = shown.select(
        "venue_key", "bucket", F.col("hood").alias("neighborhood_shown"), F.col("name").alias("venue_name"), F.col("address").alias("venue_address"), F.col("score").alias("venue_score"), F.col("date").alias("venue_date"),
        "bucket_rank", "hood_score", "hood_date", "venue_rank",
    )
    rows = venue.join(entries.select("venue_key", "position", "source", "id", "name", "date", "score"), "venue_key").drop("venue_key")
    return rows.orderBy("bucket_rank", F.col("hood_score").desc(), F.col("hood_date").desc(), "neighborhood_shown", "venue_rank", "position")
