"""All queries over the driver's tables, by name, and their SQL.

The driver's tables hold no filings, so filings are synthesised from orders, customers, nations, parts, events and
pages by fixed integer arithmetic (never presented as real). The same rules stand here as Spark SQL and, in
`catalog_sql`, as DuckDB SQL; the operators' own logic is written twice, independently.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import catalog_sql
from harbinger.functions import html as ht
from harbinger.functions import textnorm as tn
from harbinger.operators import corroborate as co
from harbinger.operators import scoring, store
from harbinger.operators import venues as ve
from harbinger.operators.tables import scratch
from harbinger.plans import digest
from harbinger.sources import feeds, report

AS_OF, DAYS, MIN_SCORE = "2001-08-01", 365, 2
CUTOFF = "2000-08-01"
#: Raw rows that one task makes and scores.
ROWS_A_TASK = 1 << 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals projected from orders, customer and nation."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    return spark.sql(catalog_sql.FILINGS.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN nation", "JOIN {nation}"), **t)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as the store has them."""
    return filings(spark, sf_dir).select("source", "external_id", "name", "address", "date", "neighborhood", F.lit("").alias("raw"), "score", F.array(F.lit("filed")).alias("reasons"), F.col("date").alias("first_seen"), "seen")


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that raw rows are projected from. They are a few bytes each and what is made of them is dear, so they are dealt to tasks
    by their number: by bytes all of them would be one task's."""
    keys = table(spark, sf_dir, "part").select("p_partkey")
    return keys.repartition(-(-keys.count() // ROWS_A_TASK) or 1, "p_partkey")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r): raw JSON rows projected from part, parsed."""
    part = part_keys(spark, sf_dir)
    rows = spark.sql(catalog_sql.RAW_FIELDS.replace("FROM part", "FROM {part}"), part=part)
    strings = [c for c in rows.columns if c not in ("id", "tables", "display")]
    flags = lambda c: F.when(F.col(c) == 1, F.lit("true")).when(F.col(c) == 2, F.lit('"true"')).otherwise(F.lit("false"))
    body = F.concat(F.regexp_replace(F.to_json(F.struct(*strings)), r"\}$", ""), F.lit(',"tablesandchairs":'), flags("tables"), F.lit(',"displaymerchandise":'), flags("display"), F.lit("}"))
    return rows.select("id", F.try_parse_json(body).alias("r"))


def feed_signals(spark, sf_dir):
    """Every feed's signals from the same raw rows; that of inspections as in its first, quiet run."""
    rows = spark.sql(catalog_sql.FEED_ROWS.replace("FROM part", "FROM {part}"), part=part_keys(spark, sf_dir))
    strings = [F.col(c).alias("id" if c == "vid" else c) for c in rows.columns if c not in ("id", "tables", "display")]
    flags = lambda c: F.when(F.col(c) == 1, F.lit("true")).when(F.col(c) == 2, F.lit('"true"')).otherwise(F.lit("false"))
    body = F.concat(F.regexp_replace(F.to_json(F.struct(*strings)), r"\}$", ""), F.lit(',"tablesandchairs":'), flags("tables"), F.lit(',"displaymerchandise":'), flags("display"), F.lit("}"))
    raw = rows.select(F.col("id").cast("long").alias("seq"), body.alias("raw"))
    every = feeds.shared(raw, feeds.FEEDS.values(), "2024-12-31", None, [f.key for f in feeds.FEEDS.values() if f.quiet_backfill])
    every = every.select("source", "external_id", "name", "address", "date", "neighborhood", "score", F.array_join("reasons", "; ").alias("reasons"), "seen", "raw")
    return every.withColumn("raw_record", F.get_json_object("raw", "$.record_id")).drop("raw")


def scored(rule) -> callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw_rows(spark, sf_dir).select("id", rule(F.col("r")).alias("s")).select("id", F.col("s.score").alias("score"), F.array_join("s.reasons", "; ").alias("reasons"))

    return query


def score_license(spark, sf_dir):
    """Class from p_size, action by id, both kinds."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("t"), F.get(F.array(*map(F.lit, ("ORI", "PER", "PRM", "PER/PRM", "", "XXX"))), (F.col("p_partkey") % 6).cast("int")).alias("a"))
    one = lambda issued: rows.select("id", F.lit("issued" if issued else "application").alias("kind"), scoring.license_score(F.col("t"), F.col("a"), issued).alias("s"))
    return one(False).unionByName(one(True)).select("id", "kind", F.col("s.score").alias("score"), F.array_join("s.reasons", "; ").alias("reasons"))


def first_event_per_key(spark, sf_dir):
    """Events as inspections: which is a user's first; ids of every seventh user are stored already."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("permit"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("seq"), "user_id")
    ids = e.where("user_id % 7 = 0").select(F.concat("permit", F.lit("-2000-01-01")).alias("external_id")).distinct()
    return store.first_events(e.drop("user_id"), ids).select("seq", "permit", "date", "first")


def watermark(spark, sf_dir):
    """Two feeds of every source: one read to its newest day, one of its old rows only, which stays at its start."""
    rows = filings(spark, sf_dir)
    rule = lambda d: store.watermark(d, "1999-01-01", "2001-06-30")
    return rows.groupBy("source").agg(rule(F.col("date")).alias("watermark"), rule(F.when(F.col("date") < "1995-01-01", F.col("date"))).alias("at_start"))


def report_days(spark, sf_dir):
    """A window per order: with a watermark, a since, both or none."""
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 != 0, F.date_sub(d, (k % 41).cast("int"))).alias("watermark"), F.when(k % 3 == 0, F.date_sub(d, (k % 7).cast("int"))).alias("since"), d.alias("end"))
    return report.report_days(rows).select("id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _batch(rows: DataFrame) -> DataFrame:
    """A batch of refreshed and new rows, some keys twice."""
    k = F.col("k")
    again = rows.where("k % 3 = 0").withColumns({"seq": k * 2, "score": ((k + 1) % 6).cast("int"), "name": F.concat("name", F.lit(" NEW")), "date": F.lit("2001-07-15"), "seen": F.lit(False)})
    twice = rows.where("k % 9 = 0").withColumns({"seq": k * 2 + 1, "score": ((k + 2) % 6).cast("int"), "name": F.concat("name", F.lit(" LAST")), "date": F.lit("2001-07-20"), "seen": F.lit(True)})
    fresh = rows.where("k % 10 = 0").withColumns({"seq": k * 2, "external_id": F.concat(F.lit("new"), "external_id")})
    return again.unionByName(twice).unionByName(fresh)


def upsert_merge(spark, sf_dir):
    rows = filings(spark, sf_dir)
    full = rows.withColumns({"raw": F.lit(""), "reasons": F.array(F.lit("filed")), "first_seen": F.col("date")})
    base = full.where("k % 4 <> 1").drop("k")
    out = store.merged(base, store.deduplicated(_batch(full).drop("k")))
    return out.select("source", "external_id", "name", "date", "first_seen", "score", "seen")


def _store(spark: SparkSession, **options) -> store.Store:
    """A store of this call's own in the folder that driver and executors share."""
    return store.Store(spark, f"{scratch(spark)}/harbinger-stores/{uuid.uuid4().hex}", **options)


def upsert_sink(spark, sf_dir):
    """upsert_merge by the store: a first commit, then the batch as changes, read merged."""
    full = filings(spark, sf_dir).withColumns({"raw": F.lit(""), "reasons": F.array(F.lit("filed")), "first_seen": F.col("date")})
    s = _store(spark)
    s.commit(full.where("k % 4 <> 1").drop("k"), {})
    s.upsert(_batch(full).drop("k"))
    return s.signals().select("source", "external_id", "name", "date", "first_seen", "score", "seen")


def _two_commits(spark, sf_dir) -> store.Store:
    """A store that got the filings in two parts: the second part's rows, and a part of the first with another name,
    address, neighborhood and score before that is put right by the second."""
    rows = stored(spark, sf_dir)
    k = F.col("external_id").cast("long")
    wrong = rows.where(k % 5 == 2).withColumns({"name": F.concat(F.lit("Wrong "), "name"), "address": F.lit("1 Wrong Street"), "neighborhood": F.lit("Nowhere"), "score": F.lit(5)})
    s = _store(spark)
    s.commit(rows.where(k % 5 < 2).unionByName(wrong), {})
    s.upsert(rows.where(k % 5 >= 2).withColumn("seq", F.lit(0)))
    return s


def digest_from_store(spark, sf_dir):
    """digest_order from a store's window and lists, after a commit that changes rows and adds others."""
    return digest.from_store(_two_commits(spark, sf_dir), AS_OF, DAYS, MIN_SCORE).filings()


def corroborate_from_store(spark, sf_dir):
    """corroborate_address from the store's lists."""
    s = _two_commits(spark, sf_dir)
    entries = digest.rescued(digest.candidates(s.window(CUTOFF, AS_OF), CUTOFF, AS_OF, digest.selection_floor(MIN_SCORE)), MIN_SCORE).withColumn("key", tn.matchable_address(F.col("address")))
    rows = entries.join(co.listed_index(s.listed("address"), digest.keys_of(entries, F.col("key"))), "key", "left")
    return rows.select("source", "id", co.listed(co.others(F.col("filings"), F.col("source"), co.ADDRESS_HITS)).alias("hits"))


def snapshot_diff(spark, sf_dir):
    rows = filings(spark, sf_dir)
    return store.new_only(rows.where("k % 4 <> 1"), rows).select("source", "external_id", "name")


def mark_seen(spark, sf_dir):
    rows = stored(spark, sf_dir)
    shown = rows.where("score >= 4").select("source", F.col("external_id").alias("id"))
    return store.marked_seen(rows, shown).select("source", "external_id", "seen")


def archive_stale(spark, sf_dir):
    return store.archived(stored(spark, sf_dir), CUTOFF, MIN_SCORE).select("source", "external_id", "seen")


def legacy_migrate(spark, sf_dir):
    rows = filings(spark, sf_dir)
    k = F.col("k")
    old = rows.where("source = 'business'").select(F.col("external_id").alias("uniqueid"), F.when(k % 5 == 0, "").otherwise(F.col("name")).alias("dba_name"), F.concat(F.lit("Owner "), "external_id").alias("ownership_name"), F.col("date").alias("dba_start_date"), "neighborhood", "address", F.lit("a; b").alias("reasons"), "score", F.col("seen").cast("int").alias("seen"))
    permits = rows.where("source = 'permit'").select(F.col("external_id").alias("permit_number"), F.col("date").alias("filed_date"), "neighborhood", "address", F.lit("").alias("reasons"), "score", F.col("seen").cast("int").alias("seen"))
    have = stored(spark, sf_dir).where("cast(external_id as long) % 24 = 0")
    return store.migrated(have, old, permits).select("source", "external_id", "name", "address", "date", "first_seen", "score", F.array_join("reasons", "; ").alias("reasons"), "seen")


def _entries(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stored(spark, sf_dir)
    return rows, digest.rescued(digest.candidates(rows, CUTOFF, AS_OF, digest.selection_floor(MIN_SCORE)), MIN_SCORE), co.corroborators(rows)


def digest_candidates(spark, sf_dir):
    return _entries(spark, sf_dir)[1].select("source", "id", "name", "address", "date", "neighborhood", "score", "url")


def corroborate_address(spark, sf_dir):
    _, entries, history = _entries(spark, sf_dir)
    rows = entries.withColumn("key", tn.matchable_address(F.col("address"))).join(co.address_index(history), "key", "left")
    return rows.select("source", "id", co.listed(co.others(F.col("filings"), F.col("source"), co.ADDRESS_HITS)).alias("hits"))


def corroborate_name(spark, sf_dir):
    _, entries, history = _entries(spark, sf_dir)
    rows = entries.withColumn("key", tn.matchable_name(F.col("name"))).join(co.name_index(history), "key", "left")
    return rows.select("source", "id", co.listed(co.others(F.col("filings"), F.col("source"), co.NAME_HITS)).alias("hits"))


def inherit_neighborhood(spark, sf_dir):
    rows, entries, _ = _entries(spark, sf_dir)
    return co.inherit(entries, co.neighborhoods(rows)).select("source", "id", "neighborhood")


def _digest(spark, sf_dir) -> digest.Digest:
    return digest.build(stored(spark, sf_dir), AS_OF, DAYS, MIN_SCORE)


def corroborated_scores(spark, sf_dir):
    return _digest(spark, sf_dir).entries.select("source", "id", "score", F.size("reasons").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons"))


def neighborhood_filter(spark, sf_dir):
    """Both filters by neighborhood: of stored rows by pattern, and of entries after inheritance."""
    rows, entries, _ = _entries(spark, sf_dir)
    stored_rows = digest.candidates(rows, CUTOFF, AS_OF, digest.selection_floor(MIN_SCORE), "T_on_1")
    inherited = digest.in_neighborhood(co.inherit(entries, co.neighborhoods(rows)), "TiOn_2")
    one = lambda x, kind: x.select(F.lit(kind).alias("filter"), "source", "id", "neighborhood")
    return one(stored_rows, "stored").unionByName(one(inherited, "entries"))


def venue_assign(spark, sf_dir):
    return ve.assign(_entries(spark, sf_dir)[1]).select("source", "id", "venue_key")


def venue_summary(spark, sf_dir):
    rows = ve.summarize(ve.assign(_entries(spark, sf_dir)[1]))
    return rows.select("venue_key", "name", "address", "neighborhood", "score", "date", F.col("n_entries").cast("int").alias("n_entries"), "first_id")


def venue_history(spark, sf_dir):
    shown = _digest(spark, sf_dir).shown
    return shown.select("venue_key", co.listed(F.col("history")).alias("earlier"))


def digest_order(spark, sf_dir):
    """The flagship: every filing of the digest with its venue, in display order."""
    return _digest(spark, sf_dir).filings()


def bucket_counts(spark, sf_dir):
    rows = stored(spark, sf_dir)
    return rows.groupBy(ve.bucket(F.col("score")).alias("bucket"), ve.source_rank(F.col("source")).alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("seen"), 1).otherwise(0)).alias("n_seen"))


def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ht.strip_tags(F.col("html")).alias("text"))


def parse_report(spark, sf_dir):
    """A report page per 50 suppliers, built from supplier and read back."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    k = F.col("k").cast("string")
    td = lambda x: F.concat(F.lit('<td class="c">'), x, F.lit("</td>"))
    blank = td(F.lit("x"))
    owner = F.concat(F.when(F.col("k") % 3 == 0, F.concat(F.lit("<b>DBA:</b> Caf&amp;e "), k, F.lit("<br/>"))).otherwise(F.lit("")), F.col("n"), F.lit(" &amp; Sons<br />"), k, F.lit(" Main St<br>Town"))
    kind = F.concat(F.get(F.array(*map(F.lit, ("41", "47", "20", "x", "99"))), (F.col("k") % 5).cast("int")), F.lit(" | Y"))
    county = F.when(F.col("k") % 4 == 0, "19").otherwise("38")
    row = F.concat(F.lit('<tr><th><a href="/x?LICENSE='), k, F.lit('">'), k, F.lit("</a></th>"), td(F.lit("ACT")), td(kind), blank, td(owner), blank, td(F.lit("ORI")), blank, blank, blank, blank, td(F.concat(k, F.lit("  Main <i>St</i>"))), td(F.lit("Town")), td(county), td(F.lit("94100")), blank, F.lit("</tr>"))
    pages = s.select(F.floor(F.col("k") / 50).alias("page"), F.struct("k", row.alias("row")).alias("x")).groupBy("page").agg(F.concat(F.lit("<table><tr><th>License</th></tr>"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))
    return report.parsed(pages).select("license_number", "status", "license_type", "action", "dba", "owner", "street", "city", "zip")


def snippet(spark, sf_dir):
    """Descriptions of conversations' texts, for every source by turn."""
    c = table(spark, sf_dir, "conversations")
    source = F.get(F.array(*map(F.lit, ("permit", "planning", "business", "electrical"))), (F.col("conv_id") % 4).cast("int"))
    return c.select("conv_id", "turn", digest.snippet(source, F.to_json(F.struct(F.col("text").alias("description")))).alias("snippet"))


QUERIES = {
    "addr_norm": lambda s, d: filings(s, d).select("source", "external_id", tn.address_key(F.col("address")).alias("address_key")),
    "name_match_key": lambda s, d: filings(s, d).select("source", "external_id", tn.name_key(F.col("name")).alias("name_key")),
    "norm_date": lambda s, d: filings(s, d).select("source", "external_id", tn.normal_date(F.when(F.col("k") % 3 == 0, F.replace("date", F.lit("-"), F.lit(""))).when(F.col("k") % 3 == 1, F.concat("date", F.lit("T00:00:00.000"))).otherwise(F.concat(F.lit(" "), "date"))).alias("day")),
    "address_without_zip": lambda s, d: filings(s, d).select("source", "external_id", tn.without_zip(F.concat("address", F.when(F.col("k") % 2 == 0, F.lit("  94110")).otherwise(F.lit(" 9411")))).alias("street")),
    "score_business": scored(scoring.business), "score_permit": scored(scoring.permit), "score_planning": scored(scoring.planning), "score_electrical": scored(scoring.electrical), "score_plumbing": scored(scoring.plumbing),
    "score_fire": scored(scoring.fire), "score_vending": scored(scoring.vending), "score_mobile_food": scored(scoring.mobile_food), "score_entertainment": scored(scoring.entertainment), "score_tables_chairs": scored(scoring.tables_chairs),
} | {f.__name__: f for f in (
    score_license, feed_signals, first_event_per_key, watermark, report_days, upsert_merge, upsert_sink, digest_from_store, corroborate_from_store, snapshot_diff, mark_seen, archive_stale, legacy_migrate, digest_candidates, corroborate_address, corroborate_name, inherit_neighborhood,
    corroborated_scores, neighborhood_filter, venue_assign, venue_summary, venue_history, digest_order, bucket_counts, strip_tags, parse_report, snippet,
)}
SQL = catalog_sql.SQL | {"upsert_sink": catalog_sql.SQL["upsert_merge"], "digest_from_store": catalog_sql.SQL["digest_order"], "corroborate_from_store": catalog_sql.SQL["corroborate_address"]}
