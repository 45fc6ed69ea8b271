"""Text, markdown and JSON of a digest: rows of text made by the executors, in the order in which they are read.

A row is a venue's head, a filing, or a venue's end; by their order, each with a line break, they are the document. So a
document may be written by many tasks (`write`), or be printed line by line. A document reads its digest's frames several
times: keep them (`Digest.kept`) around it.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.operators.venues import bucket, newest
from harbinger.plans.digest import Digest

TITLES = {"strong": "🔥 Strong signals", "watch": "👀 Worth watching", "low": "· Low signals"}
HEADER = "Early signals — last {days} days"
#: Reasons that restate filings which the venue already lists; JSON keeps them.
RESTATED = ("corroborated by ", "name also in ")
TOOL = "harbinger"
ORDER = ["section", "bucket_rank", "hood_down", "hood_new", "hood", "venue_rank", "part", "position"]


def placed(shown: DataFrame) -> DataFrame:
    """Venues with the keys of their order and whether they lead their bucket or are the last of all."""
    rows = shown.withColumns({"hood_down": -F.col("hood_score"), "hood_new": newest(F.col("hood_date"))})
    place = F.struct(*ORDER[1:6])
    at = lambda one, mark: one.select(*[F.col(f"p.{c}").alias(c) for c in ORDER[1:6]], F.lit(True).alias(mark))
    first = at(rows.groupBy("bucket_rank").agg(F.min(place).alias("p")).drop("bucket_rank"), "leads")  # three rows at most
    last = at(rows.agg(F.max(place).alias("p")).where("p is not null"), "ends")
    rows = rows.join(F.broadcast(first), ORDER[1:6], "left").join(F.broadcast(last), ORDER[1:6], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("leads", "ends")})


def _line(section: int, part: int, position: Column | int, text: Column) -> list[Column]:
    return [F.lit(section).alias("section"), *[F.col(c) for c in ORDER[1:6]], F.lit(part).alias("part"), F.lit(position).cast("int").alias("position"), text.alias("text")]


def _fixed(rows: DataFrame, section: int, text: str | Column) -> DataFrame:
    """A text before or after all venues, from a frame of one row."""
    return rows.select(F.lit(section).alias("section"), F.lit(0).alias("bucket_rank"), F.lit(0).alias("hood_down"), F.lit("").alias("hood_new"), F.lit("").alias("hood"), F.lit(0).alias("venue_rank"), F.lit(0).alias("part"), F.lit(0).alias("position"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))


def _filings(made: Digest, venues: DataFrame) -> DataFrame:
    """Entries of shown venues with the keys of their order and the venue's name."""
    own = venues.select("venue_key", *ORDER[1:6], "ends", "n_entries", F.col("name").alias("venue_name"))
    return made.entries.join(own, "venue_key")


def lines(made: Digest, days: int, markdown: bool = False, archived: int = 0) -> DataFrame:
    """The rows of the text or markdown digest."""
    one = made.shown.sparkSession.range(1)
    venues = placed(made.shown)
    titles = F.create_map(*[F.lit(x) for k, v in TITLES.items() for x in (k, v)])
    over = F.concat(
        F.when(F.col("leads"), F.concat(F.lit("\n## " if markdown else "\n"), titles[F.col("bucket")], F.lit("\n"))).otherwise(""),
        F.when(F.col("venue_rank") == 1, F.concat(F.lit("\n### " if markdown else "\n"), "hood", F.lit("\n\n" if markdown else "\n"))).otherwise(""),
    )
    address, count = F.when(F.col("address") == "", "no address").otherwise(F.col("address")), F.concat(F.col("n_entries").cast("string"), F.when(F.col("n_entries") == 1, " filing").otherwise(" filings"))
    score = F.col("score").cast("string")
    if markdown:
        head = F.concat(F.lit("- **"), "name", F.lit("** — "), address, F.lit(" — score "), score, F.lit(" — "), count)
    else:
        head = F.concat(F.lit("  "), "name", F.lit(" — "), address, F.lit(" · score "), score, F.lit(" · "), count)
    earlier = F.array_join(F.transform("history", lambda h: F.concat(h["source"], F.lit(": "), h["name"], F.lit(" ("), h["date"], F.lit(")"))), ", ")
    reasons = F.array_join(F.filter("reasons", lambda r: ~F.startswith(r, F.lit(RESTATED[0])) & ~F.startswith(r, F.lit(RESTATED[1]))), "; ")
    dated = F.concat("date", F.lit(" ["), "source", F.lit("] "))
    if markdown:
        name = F.when(F.col("url") != "", F.concat(F.lit("["), "name", F.lit("]("), "url", F.lit(")"))).otherwise(F.col("name"))
        more = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n    - *"), "description", F.lit("*"))).otherwise("")
        filing = F.concat(F.lit("  - "), dated, name, F.lit(": "), reasons, more)
    else:
        name = F.when(F.col("name") == F.col("venue_name"), "").otherwise(F.concat("name", F.lit(" — ")))
        line = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("\n      "), c)).otherwise("")
        filing = F.concat(F.lit("    "), dated, name, reasons, line("description"), line("url"))
    rows = venues.select(*_line(1, 1, 0, F.concat(over, head))).unionByName(_filings(made, venues).select(*_line(1, 2, F.col("position"), filing)))
    rows = rows.unionByName(venues.where(F.size("history") > 0).select(*_line(1, 3, 0, F.concat(F.lit("  - earlier: " if markdown else "    earlier: "), earlier))))
    sums = made.shown.agg(F.coalesce(F.sum("n_entries"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"))
    end = F.when(F.col("n") > 0, F.concat(F.lit("\n"), F.col("n").cast("string"), F.lit(" new signal(s) at "), F.col("v").cast("string"), F.lit(" venue(s)."))).otherwise("\nNo new signals.")
    end = F.concat(end, F.lit(f"\n(archived {archived} signals older than the window)" if archived else ""))
    return _fixed(one, 0, ("# " if markdown else "") + HEADER.format(days=days)).unionByName(rows).unionByName(_fixed(sums, 2, end))


def _json(value: object, by: int) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * by)


def _entry(e: dict) -> dict:
    own = {k: e[k] for k in ("source", "id", "name", "address", "neighborhood", "date", "score", "bucket")}
    return own | {"reasons": list(e["reasons"]), "url": e["url"], "description": e["description"] or ""}


def _block(row: dict) -> str:
    """The text of a row of JSON; all but the last of a list have a comma."""
    comma = "" if row["ends"] else ","
    if row["part"] == 2:
        by = 4 if row["section"] == 1 else 8
        return " " * by + _json(_entry(row), by) + comma
    if row["part"] == 1:
        head = {k: row[k] for k in ("name", "address", "neighborhood", "date", "score", "bucket")}
        return "    " + _json(head, 4).removesuffix("\n    }") + ',\n      "filings": ['
    history = [{k: h[k] for k in ("source", "name", "date")} for h in row["history"]]
    return '      ],\n      "history": ' + _json(history, 6) + "\n    }" + comma


def json_rows(made: Digest, days: int, min_score: int, archived: int, generated_at: str | None = None) -> DataFrame:
    """The rows of the JSON digest, keys in the order of the contract; entries are all venues' filings one after the other."""
    now = generated_at or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    top = {"tool": TOOL, "generated_at": now, "window_days": days, "min_score": min_score, "archived": archived}
    venues = placed(made.shown)
    some = made.shown.select(F.lit(1).alias("x")).limit(1).agg(F.count(F.lit(1)).alias("some"))  # one row
    both = lambda a, b: F.when(F.col("some") > 0, a).otherwise(b)
    fields = ["source", "id", "name", "address", "neighborhood", "date", "score", "bucket", "reasons", "url", "description", "history"]
    none = {"source": F.lit(""), "id": F.lit(""), "reasons": F.array().cast("array<string>"), "url": F.lit(""), "description": F.lit("")}
    entries = _filings(made, venues).withColumns({"bucket": bucket(F.col("score")), "history": F.array().cast(made.shown.schema["history"].dataType)})
    keyed = lambda rows, section, part, ends: rows.select(*_line(section, part, F.col("position") if "position" in rows.columns else 0, F.lit("")), ends.alias("ends"), *fields)
    heads, final = venues.withColumns(none | {"bucket": bucket(F.col("score"))}), F.col("position") == F.col("n_entries")
    rows = keyed(entries, 1, 2, F.col("ends") & final).unionByName(keyed(entries, 3, 2, final))
    rows = rows.unionByName(keyed(heads, 3, 1, F.col("ends"))).unionByName(keyed(heads, 3, 3, F.col("ends")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([_block(r) for r in b.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ORDER), text], [*ORDER, "text"])

    made_rows = rows.mapInArrow(run, "section int, bucket_rank int, hood_down int, hood_new string, hood string, venue_rank int, part int, position int, text string")
    head = json.dumps(top, indent=2, ensure_ascii=False).removesuffix("\n}") + ',\n  "entries": ['
    start, between, end = _fixed(some, 0, both(head, head + "],")), _fixed(some, 2, both('  ],\n  "venues": [', '  "venues": []')), _fixed(some, 4, both("  ]\n}", "}"))
    return start.unionByName(made_rows).unionByName(between).unionByName(end)


def printed(rows: DataFrame) -> Iterator[str]:
    """The texts in order, a line break after each; the driver holds a partition at a time."""
    return (r["text"] + "\n" for r in rows.orderBy(*ORDER).select("text").toLocalIterator())


def write(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """The document as files, in the order of their names, each written by a task; joined they are the document."""
    by = [parts, *ORDER] if parts else ORDER
    rows.repartitionByRange(*by).sortWithinPartitions(*ORDER).select("text").write.text(path)


def text(made: Digest, days: int, markdown: bool = False, archived: int = 0) -> str:
    with made.kept():
        return "".join(printed(lines(made, days, markdown, archived)))


def as_json(made: Digest, days: int, min_score: int, archived: int, generated_at: str | None = None) -> str:
    with made.kept():
        return "".join(printed(json_rows(made, days, min_score, archived, generated_at))).removesuffix("\n")
