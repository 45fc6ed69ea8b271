"""python -m harbinger.cli init | fetch | digest"""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from pyspark.sql import SparkSession

from harbinger import config
from harbinger.operators.store import Store
from harbinger.plans import digest, render
from harbinger.streaming.ingest import fetch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="harbinger")
    p.add_argument("--db", default="harbinger-store", help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="create the store")
    f = sub.add_parser("fetch", help="ingest all feeds")
    f.add_argument("--since")
    f.add_argument("--full", action="store_true")
    d = sub.add_parser("digest", help="show new signals")
    d.add_argument("--days", type=int, default=7)
    d.add_argument("--min-score", type=int, default=2)
    d.add_argument("--neighborhood")
    form = d.add_mutually_exclusive_group()
    form.add_argument("--md", action="store_true")
    form.add_argument("--json", action="store_true")
    d.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, today: str | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("harbinger").getOrCreate()
    today = today or datetime.date.today().isoformat()
    store = Store(spark, args.db)
    if store.version() == 0:
        store.commit(store.signals(), {})
    if args.command == "fetch":
        stored, failed = fetch(spark, store, today, args.since, args.full, config.app_token(os.environ.get("HARBINGER_APP_TOKEN"), config.load(args.db, spark)))
        print("\n".join(f"{k}: {n} stored" for k, n in stored.items()))
        return 1 if failed else 0
    if args.command == "digest":
        made = digest.from_store(store, today, args.days, args.min_score, args.neighborhood)
        with made.kept():  # what is shown is what is delivered
            archived = 0
            if not args.dry_run:
                delivered = made.entries.join(made.shown, "venue_key", "left_semi").select("source", "id")
                archived = store.deliver(delivered, digest.cutoff_of(today, args.days), args.min_score)
            rows = render.json_rows(made, args.days, args.min_score, archived) if args.json else render.lines(made, args.days, args.md, archived)
            for line in render.printed(rows):
                print(line, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
