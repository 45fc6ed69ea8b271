"""Ingest: feeds into the store, in one run or as a stream."""

from __future__ import annotations

import datetime
import sys
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harbinger.functions.fields import field, parsed
from harbinger.functions.textnorm import normal_date
from harbinger.operators.store import Store, watermark
from harbinger.sources import feeds, report, rest

BACKFILL_DAYS = 90
BASE = "https://data.sfgov.org"


def start_of(feed: feeds.Feed, stored: str | None, since: str | None, full: bool, today: str) -> str | None:
    """Where a run starts: since, else the backfill on --full or a first run, else the watermark; None for a snapshot."""
    if feed.date_field is None:
        return None
    backfill = feed.backfill_start or (datetime.date.fromisoformat(today) - datetime.timedelta(days=BACKFILL_DAYS)).isoformat()
    return since or (backfill if full else stored or backfill)


def ingest(store: Store, feed: feeds.Feed, rows: DataFrame, today: str, since: str | None, quiet: bool, marks: Mapping[str, str] | None = None) -> int:
    """Raw rows (seq, raw) into the store; the watermark and marks move with the same commit. Returns the rows stored."""
    new = feeds.signals(rows, feed, today, lambda asked: store.seen(feed.key, asked), quiet).persist()
    try:
        meta = dict(marks or {})
        if feed.date_field:
            first = rows.sparkSession.range(1).select(normal_date(F.lit(since or "")).alias("d")).first()["d"]
            meta[f"watermark:{feed.key}"] = rows.agg(watermark(normal_date(field(parsed(F.col("raw")), feed.date_field)), first, today)).first()[0]
        counts: dict[str, int] = {}
        store.upsert(new, meta, counts)
        return counts["rows"]
    finally:
        new.unpersist()


def fetch(spark: SparkSession, store: Store, today: str, since: str | None = None, full: bool = False, token: str | None = None, only: Iterable[str] | None = None, base: str = BASE, report_options: Mapping[str, str] | None = None) -> tuple[dict[str, int], dict[str, str]]:
    """All feeds and the report, one after the other; one that fails is recorded and the rest go on."""
    spark.dataSource.register(rest.RestSource)
    spark.dataSource.register(report.ReportSource)
    stored, failed = {}, {}

    def json_feed(feed: feeds.Feed) -> int:
        mark = store.meta().get(f"watermark:{feed.key}")
        start = start_of(feed, mark, since, full, today)
        options = {"base": base, "dataset": feed.dataset} | ({"dateField": feed.date_field, "since": start} if feed.date_field else {}) | ({"appToken": token} if token else {})
        rows = spark.read.format("harbinger_rest").options(**options).load().persist()
        try:
            return ingest(store, feed, rows, today, start, feed.quiet_backfill and mark is None and since is None)
        finally:
            rows.unpersist()

    def reports() -> int:
        mark = None if full else store.meta().get("watermark:abc")
        days = report.days_to_fetch(mark, since, datetime.date.fromisoformat(today) - datetime.timedelta(days=1))
        if not days:
            return 0
        pages = spark.read.format("harbinger_report").options(days=",".join(map(str, days)), **(report_options or {})).load()
        order = F.struct("day", F.when(F.col("kind") == "NewApplications", 0).otherwise(1), F.col("license_number"))
        new = report.signals(report.parsed(pages).withColumn("seq", order), today).persist()
        try:
            counts: dict[str, int] = {}
            store.upsert(new, {"watermark:abc": days[-1].isoformat()}, counts)
            return counts["rows"]
        finally:
            new.unpersist()

    work: dict[str, Callable[[], int]] = {k: (lambda f=f: json_feed(f)) for k, f in feeds.FEEDS.items()} | {"abc": reports}
    for key, run in work.items():
        if only is None or key in only:
            try:
                stored[key] = run()
            except Exception as e:  # one feed's failure is not the others'
                failed[key] = str(e)
                print(f"{key}: {e}", file=sys.stderr)
    return stored, failed


def stream(rows: DataFrame, feed: feeds.Feed, store: Store, today: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Streaming raw rows (seq, raw) into the store; a batch that comes again after a failure changes nothing.

    The first run of a quiet feed may take many batches, and another start after a failure: its first commit leaves a mark in
    the store, and all batches are quiet until `ended` takes it away. `run` does both."""
    mark = f"backfill:{feed.key}"

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            meta = store.meta()
            since = meta.get(f"watermark:{feed.key}")
            quiet = feed.quiet_backfill and (since is None or mark in meta)
            df.persist()  # read for the keys that it asks for, for its rows and for the watermark
            try:
                ingest(store, feed, df, today, since or "", quiet, {mark: "open"} if quiet else {})
            finally:
                df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ended(store: Store, feed: feeds.Feed) -> None:
    """The first run of a feed is over: what comes from now on is news."""
    store.set_meta({f"backfill:{feed.key}": None})


def run(rows: DataFrame, feed: feeds.Feed, store: Store, today: str, checkpoint: str) -> None:
    """Takes all that there is now, in as many batches as it needs."""
    stream(rows, feed, store, today, checkpoint).awaitTermination()
    ended(store, feed)
