"""The keyed table of signals on plain Parquet, as a log: a commit adds files of the rows that it changes, reads merge them.

Base files hold a row a key, clustered by date; changes hold whole rows, with the dates and delivery that they keep
resolved when they are written, so the newest row of a key says all. A read takes the newest row of each changed key
and the base rows of all other keys: only changes are grouped, the base is filtered where it is read. When the changes
of a source outgrow a share of its base, or are too many files, they are merged into a new base. Every file's least and
largest date and its number of undelivered rows stand in the log, so a window reads only files that can have rows of it.

Beside the rows the store keeps, by (key, source), the newest filings at an address and under a name and the first
with a neighborhood. A commit merges its rows into these lists; only where a stored filing changed or lost its key
are the lists of that key made anew from the rows.

For sources whose rules ask for a first event it keeps the beginnings of their ids too, in files by ranges of hashed
buckets: a batch reads those that its own keys fall in.
"""

from __future__ import annotations

import bisect
import urllib.parse
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harbinger.functions.textnorm import matchable_address, matchable_name, trim
from harbinger.operators.corroborate import HISTORY_HITS, MIN_SCORE, NAME_HITS
from harbinger.operators.log import Change, Log, State

KEY = ["source", "external_id"]
SCHEMA = "source string, external_id string, name string, address string, date string, neighborhood string, raw string, score int, reasons array<string>, first_seen string, seen boolean"
PAYLOAD = ["name", "address", "neighborhood", "raw", "score", "reasons"]
KEPT = ["date", "first_seen", "seen"]


def deduplicated(batch: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per key of a batch, as if its rows came one after the other: dates and delivery of the first, the rest of the last."""
    return _folded(batch, seq).drop("times")


def _folded(batch: DataFrame, seq: str) -> DataFrame:
    """deduplicated, with the number of rows of each key."""
    one = batch.groupBy(*KEY).agg(F.min_by(F.struct(*KEPT), seq).alias("_first"), F.max_by(F.struct(*PAYLOAD), seq).alias("_last"), F.count(F.lit(1)).alias("times"))
    return one.select(*KEY, "_first.*", "_last.*", "times")


def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or refresh: a stored row keeps its date, first_seen and seen and takes the batch's payload. batch: one row per key."""
    new = batch.select(*KEY, *[F.col(c).alias(f"_{c}") for c in KEPT + PAYLOAD], F.lit(True).alias("_is"))
    rows = stored.withColumn("_was", F.lit(True)).join(new, KEY, "full")
    kept = [F.when(F.col("_was"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in KEPT]
    taken = [F.when(F.col("_is"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in PAYLOAD]
    return rows.select(*KEY, *kept, *taken).select(*[f.split()[0] for f in SCHEMA.split(", ")])


def refreshed(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rows only, as `merged` would leave them, with what each was before (null for a new key)."""
    old = stored.select(*KEY, F.struct(*[c for c in stored.columns if c not in KEY]).alias("was"))
    kept = [F.when(F.col("was").isNotNull(), F.col(f"was.{c}")).otherwise(F.col(c)).alias(c) for c in KEPT]
    others = [c for c in batch.columns if c not in (*KEY, *KEPT)]
    return batch.join(old, KEY, "left").select(*KEY, *others, *kept, "was")


def new_only(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows of a full snapshot whose key is not stored."""
    return snapshot.join(stored.select(*KEY), KEY, "left_anti")


def marked_seen(stored: DataFrame, delivered: DataFrame) -> DataFrame:
    """delivered: (source, id) of what was shown."""
    keys = delivered.select("source", F.col("id").alias("external_id")).distinct().withColumn("_hit", F.lit(True))
    return stored.join(keys, KEY, "left").withColumn("seen", F.col("seen") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def stale(cutoff: str, min_score: int) -> Column:
    """Undelivered, dated before the cutoff and strong enough to have been shown."""
    return ~F.col("seen") & (F.col("date") != "") & (F.col("date") < cutoff) & (F.col("score") >= min_score)


def archived(stored: DataFrame, cutoff: str, min_score: int) -> DataFrame:
    return stored.withColumn("seen", F.col("seen") | stale(cutoff, min_score))


def legacy_rows(businesses: DataFrame | None, permits: DataFrame | None) -> DataFrame | None:
    """The rows of the two old tables as signals, one a key."""
    split = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(c), "; "))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    old = []
    if businesses is not None:
        name = F.when(text("dba_name") != "", text("dba_name")).otherwise(text("ownership_name"))
        old.append(businesses.select(F.lit("business").alias("source"), F.col("uniqueid").alias("external_id"), name.alias("name"), text("address").alias("address"), text("dba_start_date").alias("date"), text("neighborhood").alias("neighborhood"), "score", split("reasons").alias("reasons"), "seen"))
    if permits is not None:
        old.append(permits.select(F.lit("permit").alias("source"), F.col("permit_number").alias("external_id"), F.concat(F.lit("Permit "), "permit_number").alias("name"), text("address").alias("address"), text("filed_date").alias("date"), text("neighborhood").alias("neighborhood"), "score", split("reasons").alias("reasons"), "seen"))
    out = None
    for rows in old:
        rows = rows.withColumns({"raw": F.lit(""), "first_seen": F.col("date"), "seen": F.coalesce(F.col("seen"), F.lit(0)).cast("boolean"), "score": F.coalesce(F.col("score"), F.lit(0)).cast("int")}).dropDuplicates(KEY)
        out = rows if out is None else out.unionByName(rows)
    return out


def migrated(stored: DataFrame, businesses: DataFrame | None, permits: DataFrame | None) -> DataFrame:
    """The rows of the two old tables whose keys are not stored yet, added."""
    rows = legacy_rows(businesses, permits)
    return stored if rows is None else stored.unionByName(new_only(stored, rows).select(*stored.columns))


def watermark(dates: Column, since: str, today: str) -> Column:
    """An aggregate: the newest of the dates fetched, at least since, at most today."""
    return F.least(F.greatest(F.coalesce(F.max(dates), F.lit("")), F.lit(since)), F.lit(today))


def prefixes(external_id: Column) -> Column:
    """Every beginning of an id that ends in a dash, in lower-case ASCII."""
    low = F.translate(external_id, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.split(low, "-")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), i), "-"), F.lit("-"))))


def beginning(key: Column) -> Column:
    """What the ids of a key begin with."""
    return F.concat(F.translate(key, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("-"))


def first_events(batch: DataFrame, stored_ids: DataFrame, key: str = "permit", date: str = "date", seq: str = "seq") -> DataFrame:
    """first_of for stored_ids: (external_id), each a key, a dash and more."""
    return first_of(batch, stored_ids.select(F.explode(prefixes(F.col("external_id"))).alias("prefix")), key, date, seq)


def first_of(batch: DataFrame, seen: DataFrame, key: str = "permit", date: str = "date", seq: str = "seq") -> DataFrame:
    """The batch with `first`: whether a key's event is the first ever, in (date, seq) order.

    seen: (prefix), beginnings of stored ids, at least those that the batch's keys ask for. A key was seen if any id,
    stored or earlier in the batch, begins with the key and a dash; this is an equality of prefixes, no pattern match.
    Rows of a null key are first, one by one. One row per row of the batch."""
    rows = batch.withColumn("_p", beginning(F.col(key)))
    seen = seen.select(F.col("prefix").alias("_p")).where("_p is not null").distinct().withColumn("_stored", F.lit(True))
    own = rows.select(F.explode(prefixes(F.concat(F.col(key), F.lit("-"), F.col(date)))).alias("_p"), F.struct(F.col(date).alias("d"), F.col(seq).alias("s")).alias("at"))
    earliest = own.where("_p is not null").groupBy("_p").agg(F.min("at").alias("_least"))
    rows = rows.join(seen, "_p", "left").join(earliest, "_p", "left")
    first = F.col("_stored").isNull() & (F.struct(F.col(date).alias("d"), F.col(seq).alias("s")) <= F.col("_least"))
    return rows.withColumn("first", F.coalesce(first, F.lit(True))).drop("_p", "_stored", "_least")


NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: What a data file holds beside a signal: its keys, and the version that wrote the row.
KEYS = "address_key string, name_key string"
ROWS = f"{SCHEMA}, {KEYS}, commit long"
#: kind (address, name or hood), the key there, and a source's filings; date is first_seen and name the neighborhood of a hood.
#: What a row was before a commit changed it, in the files of changes.
WAS = "name string, address string, date string, neighborhood string, score int, first_seen string, seen boolean, address_key string, name_key string"
ITEMS = "array<struct<date:string,name:string,id:string>>"
LISTS = "kind string, key string, source string, items array<struct<date:string,name:string,id:string>>, commit long"
MOST = {"address": HISTORY_HITS, "name": NAME_HITS, "hood": 1}
#: Sources whose rules ask for a first event.
FIRSTS = ("health",)
#: Beginnings of ids, by buckets of their hash; a file of them holds a range of buckets.
STARTS = "source string, bucket string, prefix string, commit long"
BUCKETS, STARTS_A_FILE = 4096, 1 << 18
#: Changed keys up to which they are broadcast to the base rows that they hide.
BROADCAST_ROWS = 500_000


def with_keys(rows: DataFrame) -> DataFrame:
    """Keys are made once, when a row is written."""
    return rows.withColumns({"address_key": matchable_address(F.col("address")), "name_key": matchable_name(F.col("name"))})


def new_rows(rows: DataFrame) -> DataFrame:
    past = f"struct<{', '.join(f.replace(' ', ':', 1) for f in WAS.split(', '))}>"
    return rows.select(*NAMES).withColumns({"was": F.lit(None).cast(past), "times": F.lit(1).cast("long")})


def facts(rows: DataFrame) -> DataFrame:
    """(kind, key, source, date, name, id): what a row says for each list that it belongs to."""
    return rows.select(F.explode(_facts()).alias("f")).select("f.*")


def _facts(at: str = "") -> Column:
    """The facts of a row. at: a struct column with the row, as `was`."""
    c = lambda n: F.col(f"{at}.{n}" if at else n)
    counts, placed = (c("score") >= MIN_SCORE) & (c("address") != ""), c("address") != ""
    one = lambda kind, holds, key, date, name, id: F.when(holds & (key != ""), F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.col("source"), date.alias("date"), name.alias("name"), id.alias("id")))
    every = F.array(
        one("address", counts, c("address_key"), c("date"), c("name"), F.lit("")), one("name", counts, c("name_key"), c("date"), c("name"), F.lit("")),
        one("hood", placed & (trim(c("neighborhood")) != ""), c("address_key"), c("first_seen"), c("neighborhood"), F.col("external_id")),
    )
    return F.filter(every, lambda f: f.isNotNull())


def moved(rows: DataFrame) -> DataFrame:
    """(lost, kind, key, source, date, name, id), each once: the facts that rows have and had not before (`was`), and those that they have lost.
    A row is compared with itself; where one row takes what another gives up, the fact is in both."""
    now, before = _facts(), F.when(F.col("was").isNotNull(), _facts("was")).otherwise(F.filter(_facts(), lambda f: F.lit(False)))
    told = lambda of, lost: F.transform(of, lambda f: F.struct(F.lit(lost).alias("lost"), f.alias("f")))
    both = rows.select(F.explode(F.array(F.struct(now.alias("now"), before.alias("before")))).alias("x"))
    return both.select(F.explode(F.concat(told(F.array_except("x.before", "x.now"), True), told(F.array_except("x.now", "x.before"), False))).alias("m")).select("m.lost", "m.f.*").distinct()


def bucket(prefix: Column) -> Column:
    """Three hexadecimal digits."""
    return F.lpad(F.hex(F.pmod(F.xxhash64(prefix), F.lit(BUCKETS))), 3, "0")


def starts(rows: DataFrame) -> DataFrame:
    """(source, bucket, prefix) of the rows' ids, each once."""
    out = rows.select("source", F.explode(prefixes(F.col("external_id"))).alias("prefix")).where("prefix is not null").distinct()
    return out.select("source", bucket(F.col("prefix")).alias("bucket"), "prefix")


def lists(of: DataFrame) -> DataFrame:
    """(kind, key, source, items): the newest distinct filings of (key, source), of a hood the first; cut by a window, so
    that no more than these are gathered."""
    hood = F.col("kind") == "hood"
    # one order serves both: a key is of one kind, where the other's terms are all null
    order = Window.partitionBy("kind", "key", "source").orderBy(F.when(~hood, F.col("date")).desc(), F.when(hood, F.col("date")), F.when(hood, F.col("id")).otherwise(F.col("name")))
    rows = of.distinct().withColumn("n", F.row_number().over(order))
    most = F.when(F.col("kind") == "address", MOST["address"]).when(F.col("kind") == "name", MOST["name"]).otherwise(MOST["hood"])
    return rows.where(F.col("n") <= most).groupBy("kind", "key", "source").agg(F.sort_array(F.collect_list(F.struct("n", "date", "name", "id"))).alias("x")).select(
        "kind", "key", "source", F.transform("x", lambda x: F.struct(x["date"].alias("date"), x["name"].alias("name"), x["id"].alias("id"))).alias("items")
    )


class Store:
    """Signals, their lists by key, and meta values under a folder. See the module's text and `log`.

    A source's changes are merged into its base when their bytes pass `share` of the base and `least_bytes`, or when
    they are `most_files`. firsts: sources whose beginnings of ids are kept."""

    def __init__(self, spark: SparkSession, root: str, share: float = 0.25, least_bytes: int = 32 << 20, most_files: int = 64, keep_s: float = 7 * 86400, firsts: Iterable[str] = FIRSTS):
        self.firsts = frozenset(firsts)
        self.spark, self.share, self.least_bytes, self.most_files = spark, share, least_bytes, most_files
        self.log = Log(spark, root, keep_s)
        self.root = self.log.root

    def version(self) -> int:
        return self.log.version()

    def meta(self) -> dict[str, str]:
        """Watermarks by source: a handful of values."""
        return self.log.state().meta

    def set_meta(self, values: dict[str, str | None]) -> int:
        """Sets values, None deletes."""
        return self.log.commit(lambda state, version: Change(meta=values) if {k: state.meta.get(k) for k in values} != values else None, list(values))[0]

    def _write(self, rows: DataFrame, table: str, base: bool) -> list[dict]:
        """Writes rows and describes the files: one more pass, over narrow columns of what was written, which also counts what the caller wants to know."""
        name, by_source = f"write={uuid.uuid4().hex}", table != "lists"
        most = STARTS_A_FILE if table == "starts" else 0
        rows.write.partitionBy(*(["source"] if by_source else [])).option("maxRecordsPerFile", most).parquet(f"{self.root}/data/{name}")
        back = self.spark.read.schema(rows.schema).option("basePath", f"{self.root}/data/{name}").parquet(f"{self.root}/data/{name}")
        date = F.col("date") if table == "signals" else F.col("bucket") if table == "starts" else F.lit("")
        unseen = ~F.col("seen") if table == "signals" else F.lit(False)
        new, times = (F.col("was").isNull(), F.col("times")) if "was" in rows.columns else (F.lit(False), F.lit(0))
        got = back.groupBy(F.col("_metadata.file_path").alias("path"), "source" if by_source else F.lit("").alias("source")).agg(
            F.first("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(date).alias("lo"), F.max(date).alias("hi"), F.count(F.when(unseen, 1)).alias("unseen"), F.count(F.when(new, 1)).alias("new"), F.sum(times).alias("times"),
        )
        short = lambda p: "data/" + urllib.parse.unquote(p).rsplit("/data/", 1)[1]
        return [r.asDict() | {"path": short(r["path"]), "table": table, "base": base} for r in got.collect()]

    def _read(self, files: list[dict], schema: str) -> DataFrame:
        if not files:  # no rows that a plan knows of, where those of a list would be Python's
            return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]).where(F.lit(False))
        names = StructType.fromDDL(schema).names
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*sorted(f"{self.root}/{f['path']}" for f in files)).select(*names)

    def _newest(self, files: list[dict], key: list[str], schema: str, keep: Callable[[dict], bool] = lambda f: True) -> DataFrame:
        """The newest row of every key; `keep` may leave out base files."""
        change = [f for f in files if not f["base"]]
        base = self._read([f for f in files if f["base"] and keep(f)], schema)
        if not change:
            return base
        rows = self._read(change, schema)
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), "commit").alias("x")).select(*key, "x.*").select(*rows.columns)
        # nulls among keys are equal to each other, as they are when grouped
        hidden = rows.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
        hidden = F.broadcast(hidden) if sum(f["rows"] for f in change) <= BROADCAST_ROWS else hidden
        same = [base[c].eqNullSafe(hidden[f"_{c}"]) for c in key]
        return base.join(hidden, same, "left_anti").unionByName(newest)

    def _signals(self, state: State, sources: Iterable[str | None] | None = None, lo: str | None = None, hi: str | None = None, unseen: bool = False) -> DataFrame:
        """Rows with their keys. lo, hi: dates a file must reach; unseen: base files without undelivered rows are left out."""
        files = [f for f in state.files.values() if f["table"] == "signals" and (sources is None or f["source"] in set(sources))]
        files = [f for f in files if (lo is None or f["hi"] >= lo) and (hi is None or f["lo"] <= hi)]
        return self._newest(files, KEY, ROWS, lambda f: not unseen or f["unseen"] > 0)

    def signals(self) -> DataFrame:
        return self._signals(self.log.state()).select(*NAMES)

    def window(self, lo: str, hi: str) -> DataFrame:
        """Undelivered rows dated from lo to hi, read from the files that can have some. A row and the row that it hides
        have one date, so files of other dates change nothing."""
        return self._signals(self.log.state(), None, lo, hi, True).select(*NAMES).where(~F.col("seen") & F.col("date").between(lo, hi))

    def listed(self, kind: str) -> DataFrame:
        """(key, source, items) of address, name or hood."""
        files = [f for f in self.log.state().files.values() if f["table"] == "lists"]
        return self._newest(files, ["kind", "key", "source"], LISTS).where((F.col("kind") == kind) & (F.size("items") > 0)).select("key", "source", "items")

    def seen(self, source: str, asked: DataFrame) -> DataFrame:
        """Those of asked (prefix) that a stored id of the source begins with. What is read follows asked: the files whose
        buckets it falls in. A store without them, of a former layout, is read whole, and gets them with the next commit."""
        state = self.log.state()
        files = [f for f in state.files.values() if f["table"] == "starts" and f["source"] == source]
        asked = asked.select("prefix", bucket(F.col("prefix")).alias("bucket")).where("prefix is not null").distinct()
        if not files:
            return starts(self._signals(state, [source])).join(asked, ["bucket", "prefix"]).select("prefix")
        counts = {r["bucket"]: r["count"] for r in asked.groupBy("bucket").count().collect()}  # at most BUCKETS rows
        hit = sorted(counts)
        due = lambda f: bisect.bisect_left(hit, f["lo"]) < bisect.bisect_right(hit, f["hi"])
        have = self._read([f for f in files if due(f)], STARTS).where(F.col("bucket").isin(hit))
        asked = F.broadcast(asked) if sum(counts.values()) <= BROADCAST_ROWS else asked
        return have.join(asked, ["bucket", "prefix"]).select("prefix").distinct()

    def _starts(self, state: State, change: list[dict], version: int) -> list[dict]:
        """The beginnings of new ids, written; of all ids where the source has no such file yet."""
        out = []
        for source in sorted({f["source"] for f in change if f["source"]} & self.firsts):
            had = [f for f in state.files.values() if f["table"] == "starts" and f["source"] == source]
            new = self._read([f for f in change if f["source"] == source], f"{ROWS}, was struct<score:int>").where("was is null").select(*KEY)
            rows = new if had else new.unionByName(self._signals(state, [source]).select(*KEY))
            made = starts(rows).withColumn("commit", F.lit(version).cast("long"))
            out += self._write(made if had else self._by_bucket(made), "starts", not had)
        return out

    @staticmethod
    def _by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("bucket").sortWithinPartitions("source", "bucket", "prefix")

    def _lists(self, state: State, change: list[dict], version: int, sources: list, replace: bool) -> list[dict]:
        """The lists that a commit's rows change, written; replace: those of the sources hold nothing but these rows."""
        rows = self._read(change, f"{ROWS}, was struct<{', '.join(f.replace(' ', ':', 1) for f in WAS.split(', '))}>")
        key, had = ["kind", "key", "source"], [f for f in state.files.values() if f["table"] == "lists"]
        old = self._newest(had, ["kind", "key", "source"], LISTS).drop("commit")
        empty = lambda keys: keys.withColumn("items", F.array().cast(ITEMS))
        write = lambda made: self._write(made.withColumn("commit", F.lit(version).cast("long")), "lists", not had)
        if replace:
            made = lists(facts(rows))
            gone = old.where(F.col("source").isin(*sources)).select(*key).join(made, key, "left_anti")
            return write(made.unionByName(empty(gone)) if had else made)
        told = moved(rows).persist()
        lost, came = told.where("lost").drop("lost"), told.where("not lost").drop("lost")
        try:
            kept = old.join(came.select(*key).distinct(), key, "left_semi").select(*key, F.explode("items").alias("i")).select(*key, "i.*")
            made = lists(kept.unionByName(came))
            if not lost.isEmpty():
                again = lost.select(*key).distinct()
                whole = self._signals(state, sources).join(rows.select(*KEY), KEY, "left_anti").unionByName(rows.drop("was"))
                anew = lists(facts(whole).join(again, key, "left_semi"))
                made = made.join(again, key, "left_anti").unionByName(anew).unionByName(empty(again.join(anew, key, "left_anti")))
            return write(made)
        finally:
            told.unpersist()

    def _put(self, state: State, version: int, rows: DataFrame, sources: list, replace: bool = False) -> list[dict]:
        """rows: signals with `was` and `times`. A source without files gets a base, clustered by date."""
        first = replace or not any(f["table"] == "signals" and f["source"] in sources for f in state.files.values())
        rows = rows.select(*NAMES, "was", "times")
        if first:  # keys are made behind the shuffle, which reads its input twice to find ranges
            rows = rows.repartitionByRange("source", "date", "external_id").sortWithinPartitions("source", "date")
        rows = with_keys(rows).withColumn("commit", F.lit(version).cast("long")).select(*NAMES, "address_key", "name_key", "commit", "was", "times")
        add = self._write(rows, "signals", first)
        return add + self._starts(state, add, version) + (self._lists(state, add, version, sources, replace) if add or replace else [])

    def commit(self, signals: DataFrame, meta: dict[str, str], only: Iterable[str] | None = None) -> int:
        """Replaces the sources in `only` (None: all) by these signals, and their lists with them."""
        every = only is None
        rows = new_rows(signals if every else signals.where(F.col("source").isin(*only)))

        def make(state: State, version: int) -> Change:
            gone = [k for k, f in state.files.items() if every or f["table"] != "lists" and f["source"] in set(only)]
            left = State(state.version, {k: f for k, f in state.files.items() if k not in set(gone)}, state.meta)
            return Change(self._put(left, version, rows, list(only or []), True), gone, {**({k: None for k in state.meta} if every else {}), **meta})

        return self.log.commit(make, ["*"] if every else only)[0]

    def upsert(self, batch: DataFrame, meta: dict[str, str] | None = None, counts: dict | None = None) -> int:
        """Inserts or refreshes; what is written follows the batch. counts gets `rows` (of the batch) and `new` (keys)."""
        only = sorted((r[0] for r in batch.select("source").distinct().collect()), key=lambda s: (s is not None, s))

        def make(state: State, version: int) -> Change | None:
            if not only:
                return Change(meta=meta, result=[]) if meta else None
            one = _folded(batch, "seq")
            stored = self._signals(state, only).select(*KEY, *[f.split()[0] for f in WAS.split(", ")])
            add = self._put(state, version, refreshed(stored, one), only)
            return Change(add, [], meta or {}, [f for f in add if f["table"] == "signals"])

        version, written = self.log.commit(make, [str(s) for s in only] or list(meta or {}))
        if counts is not None:
            counts.update(rows=sum(f["times"] for f in written or []), new=sum(f["new"] for f in written or []))
        self.compact(only)
        return version

    def deliver(self, delivered: DataFrame, cutoff: str, min_score: int) -> int:
        """Marks what was shown and archives what is stale; writes only rows that this changes. Returns how many were archived."""
        keys = delivered.select("source", F.col("id").alias("external_id")).distinct().withColumn("_hit", F.lit(True))
        past = [f.split()[0] for f in WAS.split(", ")]

        def make(state: State, version: int) -> Change | None:
            rows = self._signals(state, unseen=True).where(~F.col("seen")).join(keys, KEY, "left").where(F.col("_hit") | stale(cutoff, min_score))
            # an archived row has no past here, so that those are counted
            rows = rows.withColumns({"was": F.when(F.col("_hit"), F.struct(*past)), "times": F.lit(1).cast("long"), "seen": F.lit(True), "commit": F.lit(version).cast("long")})
            add = self._write(rows.select(*NAMES, "address_key", "name_key", "commit", "was", "times"), "signals", False)
            return Change(add, [], {}, add) if add else None

        written = self.log.commit(make, ["*"])[1] or []
        self.compact({f["source"] for f in written})
        return sum(f["new"] for f in written)

    def migrate(self, businesses: DataFrame | None, permits: DataFrame | None) -> int:
        """Takes over the old tables; their watermarks' names change with them."""
        names = {"watermark:businesses": "watermark:business", "watermark:permits": "watermark:permit"}
        only = ["business", "permit"]
        rows = legacy_rows(businesses, permits)

        def make(state: State, version: int) -> Change:
            new = {names[k]: v for k, v in state.meta.items() if k in names}
            add = self._put(state, version, new_rows(new_only(self._signals(state, only), rows)), only) if rows is not None else []
            return Change(add, [], {**{k: None for k in names if k in state.meta}, **new})

        return self.log.commit(make, only)[0]

    def compact(self, sources: Iterable[str | None], force: bool = False) -> None:
        """Merges the changes of sources that have too many into their base, and those of the lists. A row keeps the version
        that wrote it, so writers who come in between lose nothing."""

        def due(files: list[dict]) -> bool:
            change, base = [f for f in files if not f["base"]], sum(f["bytes"] for f in files if f["base"])
            size = sum(f["bytes"] for f in change)
            return bool(change) and (force or len(change) > self.most_files or size > max(self.share * base, self.least_bytes))

        def merge(table: str, source: str | None) -> None:
            mine = lambda state: [f for f in state.files.values() if f["table"] == table and (table == "lists" or f["source"] == source)]

            def make(state: State, version: int) -> Change | None:
                files = mine(state)
                if not due(files):
                    return None
                if table == "lists":
                    rows = self._newest(files, ["kind", "key", "source"], LISTS).where(F.size("items") > 0).repartitionByRange("kind", "key")
                elif table == "starts":
                    rows = self._by_bucket(self._read(files, STARTS).groupBy("source", "bucket", "prefix").agg(F.min("commit").alias("commit")))
                else:
                    rows = self._newest(files, KEY, ROWS)
                    rows = rows.repartitionByRange("date", "external_id").sortWithinPartitions("date")
                return Change(self._write(rows, table, True), [f["path"] for f in files])

            if due(mine(self.log.state())):
                self.log.commit(make, [])

        for source in sources:
            merge("signals", source)
            merge("starts", source)
        merge("lists", None)
