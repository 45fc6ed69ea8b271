"""URL filters by a temporal list join.

A block list is a log of dated entries: a pattern is added at one time and may be removed at a later one. The
log becomes validity intervals per pattern, and every capture is judged by the patterns active when it was
fetched. A pattern is a host (it covers its subdomains) or a host and a path (it covers the paths below it).
Each capture is looked up under the keys that could cover it: its host and the host's parents, alone and with
each leading part of its path. So the as-of join is an equality of keys with an interval as residual.

Captures of the same address and time are judged once. The intervals are counted: up to common.BROADCAST_ROWS they go
to where the captures are, and no key is shuffled; a longer list is joined by shuffle, with a key's captures spread
over SALTS parts and the list repeated for each, so that a host with a third of all captures is no single task.

A null or hostless address is kept with verdict `invalid`; a null time matches only entries without a start.
Times compare half open: an entry counts from its start and no more at its end. Adding what is active, or
removing what is not, changes nothing; of entries of one pattern and time the removal counts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger.llm import common

SALTS = 16


def intervals(log: DataFrame) -> DataFrame:
    """(pattern, action add|remove, at) to (pattern, valid_from, valid_to); valid_to is null while active."""
    order = Window.partitionBy("pattern").orderBy(F.col("at").asc_nulls_first(), F.col("add").desc())
    rows = log.select(F.lower("pattern").alias("pattern"), (F.col("action") == "add").alias("add"), "at").where("pattern is not null and add is not null")
    changes = rows.withColumn("was", F.coalesce(F.lag("add").over(order), F.lit(False))).where("add <> was")
    spans = changes.withColumn("valid_to", F.lead("at").over(order)).where("add")
    return spans.select("pattern", F.col("at").alias("valid_from"), "valid_to").where("valid_to is null or valid_from is null or valid_from < valid_to")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def path_of(url: Column) -> Column:
    """The path as it stands, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, most: Column) -> Column:
    """Every pattern of at most that many path parts that covers this host and path."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(1), most)
    paths = F.when(F.size(steps) == 0, F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    )
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lower(p))))))


def judge(captures: DataFrame, log: DataFrame, *, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures with host, n_active (entries that cover them at their time), pattern (the longest, then the
    first in order) and verdict (block, allow, invalid). Columns of the captures may have any names: where they have one
    of these, the new one is called list_ and the name."""
    spans = common.table(intervals(log), "url-intervals")
    rows = spans.count()
    once = captures.select(F.col(url_col).alias("u"), F.col(time_col).alias("t")).distinct().withColumn("h", F.coalesce(host_of(F.col("u")), F.lit("")))
    deepest = log.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("most"))  # parts of the longest path in the list
    looked = once.where("h <> ''").crossJoin(F.broadcast(deepest)).select("u", "t", F.explode(keys(F.col("h"), path_of(F.col("u")), F.col("most"))).alias("key"))
    hit = (F.col("key") == F.col("pattern")) & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("t"))) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    if rows <= common.BROADCAST_ROWS:
        matched = looked.join(F.broadcast(spans), hit)
    else:
        salt = F.pmod(F.xxhash64("u", "t"), F.lit(SALTS)).cast("int")
        entries = spans.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = looked.withColumn("salt", salt).join(entries, hit & (F.col("salt") == F.col("part")))
    found = matched.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.length("pattern")).alias("n"), F.col("pattern"))).alias("best"))
    own = {c.lower() for c in captures.columns}
    u, t, n, best, host = (common.unused(c, captures.columns) for c in ("u", "t", "n", "best", "host_"))
    found = found.select(F.col("u").alias(u), F.col("t").alias(t), F.col("n").alias(n), F.col("best.pattern").alias(best))
    mine = captures.withColumn(host, F.coalesce(host_of(F.col(url_col)), F.lit("")))
    joined = mine.join(found, (F.col(url_col) == F.col(u)) & F.col(time_col).eqNullSafe(F.col(t)), "left")
    verdict = F.when(F.col(host) == "", "invalid").when(F.col(n) > 0, "block").otherwise("allow")
    out = {"host": F.col(host), "n_active": F.coalesce(F.col(n), F.lit(0)), "pattern": F.col(best), "verdict": verdict}
    return joined.select(*[F.col(f"`{c}`") for c in captures.columns], *[v.alias(k if k not in own else common.unused(f"list_{k}", captures.columns)) for k, v in out.items()])


def derived_log(pages: DataFrame) -> DataFrame:
    """A dated list for the pages table, which has none: by rule from each host's smallest page_id (days since the
    first of January 2024). A third of the hosts are listed and later removed, some are listed again; others have
    their first folder listed; one entry names a whole domain, and every eleventh page of two folders or more is listed with
    its whole path, however deep."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), F.get(F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != ""), F.lit(0)).alias("folder")).where("host <> ''")
    firsts = hosts.groupBy("host").agg(F.min("page_id").alias("m"))
    m, day = F.col("m"), (F.col("m") * 31 % 365).cast("int")
    entry = lambda pattern, action, at, when: F.when(when, F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), at.cast("int").alias("at")))
    rows = F.array(
        entry(F.col("host"), "add", day, m % 3 == 0), entry(F.col("host"), "remove", day + 60 + m % 90, m % 3 == 0), entry(F.col("host"), "add", day + 200, m % 7 == 0)
    )
    folders = hosts.where("folder is not null").groupBy("host", "folder").agg(F.min("page_id").alias("m")).where("m % 5 = 1")
    below = folders.select(F.concat("host", F.lit("/"), F.lower("folder")).alias("pattern"), F.lit("add").alias("action"), (F.col("m") * 17 % 365).cast("int").alias("at"))
    named = firsts.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("x.*")
    domain = pages.sparkSession.createDataFrame([("example.org", "add", 300), ("example.org", "remove", 320)], "pattern string, action string, at int")
    steps = F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != "")
    deep = pages.where("page_id % 11 = 3").select("page_id", host_of(F.col("url")).alias("host"), steps.alias("steps")).where("host <> '' and size(steps) > 1")
    deep = deep.select(F.concat("host", F.lit("/"), F.lower(F.array_join("steps", "/"))).alias("pattern"), F.lit("add").alias("action"), (F.col("page_id") * 13 % 365).cast("int").alias("at"))
    return named.unionByName(below).unionByName(deep).unionByName(domain)


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages judged at their fetch day, derived from page_id as the table has none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", (F.col("page_id") * 97 % 400).cast("int"))
    return judge(captures, derived_log(pages)).select("page_id", "fetched", "host", "n_active", "pattern", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST(page_id * 97 % 400 AS INTEGER) AS fetched,
    coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages),
f AS (SELECT host, min(page_id) AS m FROM p WHERE host <> '' GROUP BY host),
d AS (SELECT host, steps[1] AS folder, min(page_id) AS m FROM p WHERE host <> '' AND len(steps) > 0 GROUP BY ALL HAVING min(page_id) % 5 = 1),
log AS (
  SELECT host AS pattern, 1 AS adds, m * 31 % 365 AS since FROM f WHERE m % 3 = 0
  UNION ALL SELECT host, 0, m * 31 % 365 + 60 + m % 90 FROM f WHERE m % 3 = 0
  UNION ALL SELECT host, 1, m * 31 % 365 + 200 FROM f WHERE m % 7 = 0
  UNION ALL SELECT host || '/' || lower(folder), 1, m * 17 % 365 FROM d
  UNION ALL SELECT host || '/' || lower(array_to_string(steps, '/')), 1, page_id * 13 % 365 FROM p WHERE host <> '' AND page_id % 11 = 3 AND len(steps) > 1
  UNION ALL SELECT 'example.org', 1, 300 UNION ALL SELECT 'example.org', 0, 320),
c AS (SELECT * FROM (SELECT *, coalesce(lag(adds) OVER w, 0) AS was FROM log WINDOW w AS (PARTITION BY pattern ORDER BY since, adds DESC)) WHERE adds <> was),
s AS (SELECT * FROM (SELECT pattern, adds, since AS valid_from, lead(since) OVER (PARTITION BY pattern ORDER BY since, adds DESC) AS valid_to FROM c) WHERE adds = 1 AND (valid_to IS NULL OR valid_from < valid_to)),
h AS (SELECT *, string_split(host, '.') AS parts FROM p WHERE host <> ''),
k AS (
  SELECT DISTINCT page_id, fetched, array_to_string(parts[i:], '.') || lower(CASE WHEN j = 0 THEN '' ELSE '/' || array_to_string(steps[1:j], '/') END) AS key
  FROM h, unnest(range(1, len(parts) + 1)) AS a(i), unnest(range(0, len(steps) + 1)) AS b(j)),
hit AS (SELECT page_id, count(*) AS n_active, arg_min(pattern, {'n': -length(pattern), 'p': pattern}) AS pattern FROM k JOIN s ON key = pattern AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY page_id)
SELECT p.page_id, p.fetched, p.host, coalesce(n_active, 0) AS n_active, pattern, CASE WHEN p.host = '' THEN 'invalid' WHEN n_active > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN hit USING (page_id)
"""
