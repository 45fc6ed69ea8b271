"""The feeds: what each raw row's id, name, address and neighborhood are, and its score."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.functions.fields import field, parsed
from harbinger.functions.textnorm import normal_date, without_zip
from harbinger.operators import scoring, store

Extract = Callable[[Column], Column]


@dataclass(frozen=True)
class Feed:
    """A JSON dataset. Without date_field it is a snapshot; score None is the first-event rule."""

    key: str
    dataset: str
    date_field: str | None
    external_id: Extract
    name: Extract
    address: Extract
    neighborhood: Extract
    score: Callable[[Column], Column] | None
    backfill_start: str | None = None
    quiet_backfill: bool = False
    min_store_score: int = 0


def get(key: str) -> Extract:
    return lambda row: field(row, key)


def either(a: str, b: str) -> Extract:
    return lambda row: F.coalesce(F.nullif(field(row, a), F.lit("")), field(row, b))


def nothing(row: Column) -> Column:
    return F.lit("")


def street(row: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(field(row, k), F.lit("")) for k in ("street_number", "street_name", "street_suffix")])


def street_with_unit(row: Column) -> Column:
    unit = field(row, "unit")
    return F.when(unit == "", street(row)).otherwise(F.concat(street(row), F.lit(", unit "), unit))


def permit_name(row: Column) -> Column:
    return F.concat(F.lit("Permit "), field(row, "permit_number"))


def corner(row: Column) -> Column:
    a, b = field(row, "vendinglocationstreet"), field(row, "vendinglocationcrossstreet")
    return F.when((a == "") | (b == ""), a).otherwise(F.concat(a, F.lit(" & "), b))


HOOD, HOODS = get("analysis_neighborhood"), get("neighborhoods_analysis_boundaries")
FEEDS = {f.key: f for f in (
    Feed("business", "g8m3-pdis", "dba_start_date", get("uniqueid"), either("dba_name", "ownership_name"), get("full_business_address"), HOODS, scoring.business),
    Feed("permit", "i98e-djp9", "filed_date", get("permit_number"), permit_name, street_with_unit, HOODS, scoring.permit),
    Feed("entertainment", "76g9-59eq", None, get("permit_number"), get("dba_name"), get("street_address"), HOOD, scoring.entertainment),
    Feed("health", "tvy3-wexg", "inspection_date", lambda r: F.concat(field(r, "permit_number"), F.lit("-"), field(r, "inspection_date")), get("dba"), get("street_address"), HOOD, None, "2024-01-01", True, 1),
    Feed("mobile_food", "rqzj-sfat", "received", get("objectid"), get("applicant"), get("address"), nothing, scoring.mobile_food),
    Feed("planning", "qvu5-m3a2", "open_date", get("record_id"), either("project_name", "record_id"), lambda r: without_zip(field(r, "project_address")), nothing, scoring.planning, min_store_score=2),
    Feed("fire", "893e-xam6", "permit_application_date", get("permit_number"), either("dba_name_associated_with_this_permit_holder", "permit_holder"), get("permit_address"), nothing, scoring.fire, min_store_score=2),
    Feed("vending", "34ws-kyf6", None, get("id"), get("dbaname"), corner, HOOD, scoring.vending),
    Feed("tables_chairs", "dpch-7nr4", "submission_created", get("id"), either("dbaname", "businessname"), get("streetaddress"), HOOD, scoring.tables_chairs),
    Feed("electrical", "ftty-kx6y", "filed_date", get("permit_number"), permit_name, street, HOODS, scoring.electrical, min_store_score=2),
    Feed("plumbing", "a6aw-rudh", "filed_date", get("permit_number"), permit_name, street, HOODS, scoring.plumbing, min_store_score=2),
)}


def signals(rows: DataFrame, feed: Feed, today: str, seen: Callable[[DataFrame], DataFrame] | None = None, quiet: bool = False) -> DataFrame:
    """Raw rows (seq long, raw string) to signals with seq. Rows without an id and those below the feed's least score go.

    seen: which of some beginnings of ids, (prefix), are stored already (Store.seen); None is an empty store."""
    return shared(rows, [feed], today, {feed.key: seen} if seen else {}, {feed.key} if quiet else ())


def shared(rows: DataFrame, of: Iterable[Feed], today: str, seen: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None, quiet: Iterable[str] = ()) -> DataFrame:
    """The signals of several feeds that read the same raw rows: a row is parsed and written as JSON once for all of them.

    seen: as for `signals`, by feed; quiet: feeds whose signals count as delivered."""
    of, seen, quiet = list(of), seen or {}, set(quiet)
    rows = rows.select("seq", "raw")
    for feed in of:
        if feed.score is None:  # what is first is told before rows become wide
            keyed = rows.withColumn("_r", F.explode(F.array(parsed(F.col("raw")))))
            r = F.col("_r")
            key = F.when(named(feed.external_id(r)), field(r, "permit_number"))  # rows without an id are no events
            keyed = keyed.withColumns({"_permit": key, "_stamp": stamp(r, feed)}).drop("_r")
            asked = keyed.select(store.beginning(F.col("_permit")).alias("prefix")).where("prefix is not null").distinct()
            had = seen[feed.key](asked) if feed.key in seen else asked.where(F.lit(False))
            rows = store.first_of(keyed, had, "_permit", "_stamp").withColumnRenamed("first", f"_first_{feed.key}").drop("_permit", "_stamp")
    rows = rows.withColumn("_r", F.explode(F.array(parsed(F.col("raw"))))).drop("raw")  # read once, where a projection would be read by every field
    if len(of) > 1:
        rows = rows.withColumn("raw", F.explode(F.array(F.to_json("_r"))))
    r = F.col("_r")

    def one(feed: Feed) -> Column:
        score = feed.score(r) if feed.score else scoring.first_inspection(F.col(f"_first_{feed.key}"))
        date = normal_date(stamp(r, feed)) if feed.date_field else F.lit(today)
        return F.struct(
            F.lit(feed.key).alias("source"), feed.external_id(r).alias("external_id"), feed.name(r).alias("name"), feed.address(r).alias("address"), date.alias("date"), feed.neighborhood(r).alias("neighborhood"),
            score.alias("score"), F.lit(feed.min_store_score).alias("least"), F.lit(feed.key in quiet).alias("seen"),
        )

    # exploded too: a filter would be moved below a projection and make ids and scores twice
    out = rows.select("seq", "_r" if len(of) == 1 else "raw", F.explode(F.array(*map(one, of))).alias("x")).where(named(F.col("x.external_id")) & (F.col("x.score.score") >= F.col("x.least")))
    return out.select(
        "seq", *[f"x.{c}" for c in ("source", "external_id", "name", "address", "date", "neighborhood")], (F.to_json("_r") if len(of) == 1 else F.col("raw")).alias("raw"), F.col("x.score.score").alias("score"), F.col("x.score.reasons").alias("reasons"), F.lit(today).alias("first_seen"), "x.seen",
    )


def stamp(row: Column, feed: Feed) -> Column:
    return field(row, feed.date_field) if feed.date_field else F.lit("")


def named(external_id: Column) -> Column:
    return F.regexp_replace(external_id, "^-+|-+$", "") != ""
