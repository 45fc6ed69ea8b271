"""Daily license reports, scraped: days to fetch, the form's nonce, and the table's rows as columns."""

from __future__ import annotations

import datetime
import re
import time
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from harbinger.functions.html import cells, raw_cells, strip_tags
from harbinger.functions.textnorm import trim
from harbinger.operators import scoring

# Fixed values of the site and of the report's layout.
PAGE = "https://www.abc.ca.gov/licensing/licensing-reports/new-applications/"
POST = "https://www.abc.ca.gov/wp-admin/admin-post.php"
FORM, COUNTY = "abclqs_daily_report", "38"
KINDS = {"NewApplications": ("2", "/licensing/licensing-reports/new-applications/"), "IssuedLicenses": ("1", "/licensing/licensing-reports/issued-licenses/")}
BACKFILL_DAYS, MOST_DAYS, PAUSE_S, TIMEOUT_S, MIN_SCORE = 14, 30, 0.3, 60, 2


def extract_nonce(page: str) -> str | None:
    m = re.search(rf'name="{FORM}" value="([^"]+)"', page)
    return m[1] if m else None


def days_to_fetch(watermark: str | None, since: str | None, end: datetime.date) -> list[datetime.date]:
    """From since, or the day after the watermark, or the backfill, to end; at most the last MOST_DAYS before it."""

    def read(s: str | None) -> datetime.date | None:
        try:
            return datetime.date.fromisoformat(s[:10]) if s else None
        except ValueError:
            return None

    day, s, w = datetime.timedelta(days=1), read(since), read(watermark)
    start = s or (w + day if w else end - BACKFILL_DAYS * day)
    start = max(start, end - MOST_DAYS * day)
    return [start + k * day for k in range((end - start).days + 1)]


def report_days(bounds: DataFrame) -> DataFrame:
    """(watermark, since, end) date columns, the first two null where unset, to one row per day."""
    start = F.coalesce("since", F.date_add("watermark", 1), F.date_sub("end", BACKFILL_DAYS))
    start = F.greatest(start, F.date_sub("end", MOST_DAYS))
    return bounds.withColumn("day", F.explode(F.when(start <= F.col("end"), F.sequence(start, F.col("end"))).otherwise(F.array().cast("array<date>"))))


def owner_lines(row: Column) -> Column:
    body = F.coalesce(F.get(raw_cells(row), F.lit(3)), F.lit(""))
    return F.filter(F.transform(F.split(body, r"<br/>|<br />|<br>|\n"), strip_tags), lambda x: x != "")


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (html and any other columns) to one row per license of the county."""
    row = F.col("_row")
    rows = pages.withColumn("_row", F.explode(F.slice(F.split("html", "<tr"), 2, 1 << 30))).withColumn("_row", F.regexp_extract("_row", r"(?s)\A(.*?)(</tr>|\z)", 1))
    rows = rows.withColumns({"license_number": F.regexp_extract(row, 'LICENSE=([^"]*)"', 1), "_has": row.rlike('LICENSE=[^"]*"'), "_c": cells(row), "_o": owner_lines(row)})
    rows = rows.where(F.col("_has") & (F.size("_c") >= 14)).where(F.get("_c", F.lit(12)) == COUNTY)
    cell = lambda i: F.get("_c", F.lit(i))
    first, second = F.coalesce(F.get("_o", F.lit(0)), F.lit("")), F.coalesce(F.get("_o", F.lit(1)), F.lit(""))
    named = F.upper(first).startswith("DBA:")
    number = trim(F.split_part(cell(1), F.lit("|"), F.lit(1)))
    out = {
        "status": cell(0), "license_type": F.coalesce(F.when(number.rlike("^[+]?[0-9]+$"), number.try_cast("int")), F.lit(0)), "action": cell(5), "dba": F.when(named, trim(F.substr(first, F.lit(5)))).otherwise(""),
        "owner": F.when(named, second).otherwise(first), "street": cell(10), "city": cell(11), "zip": cell(13),
    }
    return rows.select(*[c for c in pages.columns if c != "html"], "license_number", *[v.alias(k) for k, v in out.items()])


def signals(licenses: DataFrame, today: str) -> DataFrame:
    """Parsed licenses (with kind, day and seq) to signals with seq."""
    issued = F.col("kind") == "IssuedLicenses"
    score = F.when(issued, scoring.license_score(F.col("license_type"), F.col("action"), True)).otherwise(scoring.license_score(F.col("license_type"), F.col("action")))
    raw = F.to_json(F.struct(F.col("kind").alias("report"), "license_number", "status", "license_type", "action", "dba", "owner", "street", "city", "zip"))
    return licenses.select(
        "seq", F.lit("abc").alias("source"), F.concat("license_number", F.when(issued, "-issued").otherwise("")).alias("external_id"), F.coalesce(F.nullif("dba", F.lit("")), "owner").alias("name"), F.col("street").alias("address"),
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.lit("").alias("neighborhood"), raw.alias("raw"), score["score"].alias("score"), score["reasons"].alias("reasons"), F.lit(today).alias("first_seen"), F.lit(False).alias("seen"),
    ).where(F.col("score") >= MIN_SCORE)


class Scan(InputPartition):
    """All reports of a run, one after the other, with the form's nonce."""

    def __init__(self, days: list[str], nonce: str):
        self.days, self.nonce = days, nonce


class ReportReader(DataSourceReader):
    """One task asks for all reports in order, with a pause after each, as the site is not to be asked by many at once; the
    form page is read once a run, where the scan is planned."""

    def __init__(self, options: dict):
        self.options = options  # keys match in any case

    def partitions(self):
        days = [d for d in self.options["days"].split(",") if d]
        if not days:
            return []
        nonce = extract_nonce(urllib.request.urlopen(self.options.get("page", PAGE), timeout=TIMEOUT_S).read().decode())
        if nonce is None:
            raise RuntimeError("the report page has no form nonce; its layout may have changed")
        return [Scan(days, nonce)]

    def read(self, partition):
        post, pause = self.options.get("post", POST), float(self.options.get("pause", PAUSE_S))
        for text in partition.days:
            day = datetime.date.fromisoformat(text)
            for kind, (number, referer) in KINDS.items():
                form = {"action": FORM, "url": referer, "rpttype": number, FORM: partition.nonce, "_wp_http_referer": referer, "abclqs-date": day.strftime("%m/%d/%Y")}
                html = urllib.request.urlopen(post, urllib.parse.urlencode(form).encode(), timeout=TIMEOUT_S).read().decode(errors="replace")
                yield kind, day, html
                time.sleep(pause)


class ReportSource(DataSource):
    """`format("harbinger_report")`; options: days (comma separated), page, post, pause (seconds after each request)."""

    @classmethod
    def name(cls):
        return "harbinger_report"

    def schema(self):
        return "kind string, day date, html string"

    def reader(self, schema):
        return ReportReader(self.options)
