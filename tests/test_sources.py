"""The paged source, the stream by keys and the paced scan against a small service of our own."""

import http.server
import json
import re
import threading
import time
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from harbinger.functions.fields import field
from harbinger.operators import store
from harbinger.operators.scoring import rule
from harbinger.sources import feeds, report, rest
from harbinger.streaming import ingest


class Service:
    """A dataset whose rows have :id and :updated_at; understands the queries that the source makes."""

    def __init__(self):
        self.rows, self.calls, self.fail, service = [], [], {}, self

        class Handler(http.server.BaseHTTPRequestHandler):
            def reply(self, status, body):
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):
                at = urlparse(self.path)
                if at.path == "/form":
                    service.calls.append(("form", time.monotonic()))
                    return self.reply(200, b'<input name="abclqs_daily_report" value="n1">')
                q = {k[1:]: v[0] for k, v in parse_qs(at.query).items()}
                service.calls.append(q)
                key = ("count" if q.get("select") == "count(*)" else "page", q.get("offset"))
                if service.fail.get(key):
                    service.fail[key] -= 1
                    return self.reply(503, b"busy")
                self.reply(200, json.dumps(service.answer(q)).encode())

            def do_POST(self):
                self.rfile.read(int(self.headers["Content-Length"]))
                service.calls.append(("report", time.monotonic()))
                self.reply(200, b"<table></table>")

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, q):
        rows = [r for r in self.rows if self.holds(r, q.get("where", ""))]
        if q.get("select") == "count(*)":
            return [{"count": str(len(rows))}]
        by = [c.split() for c in q["order"].split(",")]
        rows.sort(key=lambda r: [r[c[0]] for c in by], reverse=by[0][-1] == "DESC")
        rows = rows[int(q["offset"]) :][: int(q["limit"])]
        want = q.get("select", "*")
        return [{k: v for k, v in r.items() if want == ":*,*" or (want == "*" and k[0] != ":") or k in want.split(",")} for r in rows]

    @staticmethod
    def holds(row, where):
        key = (row[":updated_at"], row[":id"])
        for op, at, _, i in re.findall(r"\(:updated_at ([<>]) '([^']*)' OR \(:updated_at = '([^']*)' AND :id [<>]=? '([^']*)'\)\)", where):
            if not (key > (at, i) if op == ">" else key <= (at, i)):
                return False
        return all(row[f] >= v for f, v in re.findall(r"(\w+) >= '([^']*)'", where))

    def put(self, n, at, date):
        self.rows = [r for r in self.rows if r[":id"] != f"row-{n:04d}"]
        self.rows.append({":id": f"row-{n:04d}", ":updated_at": at, "permit_number": str(n), "inspection_date": date, "dba": f"Place {n}"})


@pytest.fixture
def service():
    made = Service()
    yield made
    made.server.shutdown()


def options(service, **more):
    return {"base": service.base, "dataset": "d", "pageSize": "5", "pagesPerTask": "8", "dateField": "inspection_date", "since": "2026-01-01"} | more


def test_forty_pages_in_tasks_and_a_page_is_tried_again_alone(spark, service):
    spark.dataSource.register(rest.RestSource)
    for n in range(200):
        service.put(n, "t1", f"2026-{1 + n % 9:02d}-01")
    service.put(500, "t1", "2025-12-31")
    service.fail[("page", "85")] = 2
    rows = spark.read.format("harbinger_rest").options(**options(service)).load()
    assert rows.rdd.getNumPartitions() == 5
    service.calls.clear()
    got = rows.collect()
    assert sorted(r["seq"] for r in got) == list(range(200)) and {json.loads(r["raw"])["permit_number"] for r in got} == {str(n) for n in range(200)}
    offsets = [c["offset"] for c in service.calls if "select" not in c]
    assert offsets.count("85") == 3 and all(offsets.count(str(k)) == 1 for k in range(0, 200, 5) if k != 85)
    dates = [json.loads(r["raw"])["inspection_date"] for r in sorted(got, key=lambda r: r["seq"])]
    assert dates == sorted(dates) and not any(":" in k for k in json.loads(got[0]["raw"]))


def test_rows_that_come_are_read_and_rows_that_go_are_told(service):
    for n in range(23):
        service.put(n, "t1", "2026-02-01")
    reader = rest.RestReader(options(service, pagesPerTask="2"))
    parts = reader.partitions()
    assert [(p.lo, p.hi) for p in parts] == [(0, 10), (10, 20), (20, None)]
    for n in range(23, 30):
        service.put(n, "t2", "2026-03-01")
    assert [seq for p in parts for seq, _ in reader.read(p)] == list(range(30))
    service.rows = service.rows[:21]
    with pytest.raises(RuntimeError, match="fewer"):
        list(reader.read(parts[-1]))
    service.rows = service.rows[:12]
    with pytest.raises(RuntimeError, match="short"):
        list(reader.read(parts[1]))
    service.rows = []
    empty = reader.partitions()
    assert len(empty) == 1 and list(reader.read(empty[0])) == []


def test_a_service_without_counts_is_read_by_one_task(service):
    for n in range(12):
        service.put(n, "t1", "2026-02-01")
    plain = service.answer
    service.answer = lambda q: plain(q | {"select": "*", "order": ":id"}) if q.get("select") == "count(*)" else plain(q)
    reader = rest.RestReader({"base": service.base, "dataset": "d", "pageSize": "5"})
    assert len(reader.partitions()) == 1 and [seq for seq, _ in reader.read(reader.partitions()[0])] == list(range(12))
    assert [c["order"] for c in service.calls if "select" not in c] == [":id"] * 3


def test_ranges_hold_each_row_once_while_rows_change(service):
    for n in range(57):
        service.put(n, f"t{n // 7}", "2026-02-01")
    reader = rest.RestStreamReader(options(service, pagesPerTask="2"))
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    numbers = lambda part: [json.loads(raw)["permit_number"] for _, raw in reader.read(part)]
    assert len(parts) == 6 and end == {"at": "t8", "id": "row-0056"}
    assert len({seq for p in parts for seq, _ in reader.read(p)}) == 57
    seen = numbers(parts[0])
    for n in (3, 20, 40):  # changed between the tasks: now in a later batch
        service.put(n, "t9", "2026-02-02")
    seen += [n for p in parts[1:] for n in numbers(p)]
    later = reader.latestOffset()
    again = [n for p in reader.partitions(end, later) for n in numbers(p)]
    assert sorted(again) == ["20", "3", "40"] and sorted(seen + again, key=int) == sorted([*map(str, range(57)), "3"], key=int)
    assert reader.partitions(later, reader.latestOffset()) == []


def test_a_stream_takes_old_dates_once_and_its_first_run_is_quiet(spark, service, tmp_path):
    """A row of an old date that arrives between two runs is stored, once, and as news; the first run is not."""
    spark.dataSource.register(rest.RestSource)
    feed, s = feeds.FEEDS["health"], store.Store(spark, f"file://{tmp_path}/db")
    for n in range(12):
        service.put(n, "2026-07-01T00", f"2026-06-{1 + n:02d}T00:00:00")
    go = lambda: ingest.run(spark.readStream.format("harbinger_rest").options(**options(service)).load(), feed, s, "2026-07-02", f"file://{tmp_path}/cp")
    go()
    assert s.signals().count() == 12 and s.signals().where("not seen").count() == 0 and s.meta() == {"watermark:health": "2026-06-12"}
    service.put(99, "2026-07-02T00", "2026-05-05T00:00:00")
    go()
    go()
    got = s.signals().where("not seen").collect()
    assert [r["external_id"] for r in got] == ["99-2026-05-05T00:00:00"] and s.signals().count() == 13 and s.version() == 3


def test_a_first_run_of_many_batches_is_quiet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = lambda n: json.dumps({"seq": n, "raw": json.dumps({"permit_number": str(n), "inspection_date": f"2026-06-{n:02d}T00:00:00", "dba": "x"})})
    for n in (1, 2):
        (tmp_path / f"in/{n}.json").write_text(raw(n))
    feed, s = feeds.FEEDS["health"], store.Store(spark, f"file://{tmp_path}/db")
    rows = lambda: spark.readStream.schema("seq long, raw string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    ingest.run(rows(), feed, s, "2026-07-02", f"file://{tmp_path}/cp")
    assert s.version() == 3 and s.signals().where("seen").count() == 2 and "backfill:health" not in s.meta()
    (tmp_path / "in/3.json").write_text(raw(3))
    ingest.run(rows(), feed, s, "2026-07-02", f"file://{tmp_path}/cp")
    assert [r["external_id"] for r in s.signals().where("not seen").collect()] == ["3-2026-06-03T00:00:00"]


def test_reports_are_asked_for_one_by_one(spark, service):
    spark.dataSource.register(report.ReportSource)
    form = {"page": f"{service.base}/form", "post": f"{service.base}/report", "pause": "0.05"}
    pages = spark.read.format("harbinger_report").options(days="2026-07-01,2026-07-02,2026-07-03", **form).load().collect()
    assert [(r["kind"], str(r["day"])) for r in pages] == [(k, f"2026-07-0{d}") for d in (1, 2, 3) for k in report.KINDS]
    names, times = zip(*service.calls, strict=True)
    assert names == ("form", *["report"] * 6) and min(b - a for a, b in zip(times[1:], times[2:], strict=False)) >= 0.05


def test_a_feed_of_ones_own(spark, service, tmp_path, monkeypatch):
    """Adding a feed is one entry: extractors and a rule."""
    score = lambda r: rule((F.contains(field(r, "dba"), F.lit("7")), 4, F.lit("a seven")), (F.lit(True), 1, F.lit("a kiosk")))
    own = feeds.Feed("kiosk", "d", "inspection_date", feeds.get("permit_number"), feeds.get("dba"), lambda r: F.lit("1 Oak St"), feeds.nothing, score, min_store_score=2)
    monkeypatch.setitem(feeds.FEEDS, "kiosk", own)
    for n in range(30):
        service.put(n, "t1", "2026-06-20T00:00:00")
    s = store.Store(spark, f"file://{tmp_path}/db")
    assert ingest.fetch(spark, s, "2026-07-02", base=service.base, only=["kiosk"]) == ({"kiosk": 3}, {})
    got = s.signals().orderBy("external_id").collect()
    assert [(r["source"], r["external_id"], r["score"], r["reasons"], r["date"]) for r in got] == [("kiosk", i, 5, ["a seven", "a kiosk"], "2026-06-20") for i in ("17", "27", "7")]
    assert s.meta() == {"watermark:kiosk": "2026-06-20"} and s.listed("address").where("key = '1 OAK ST'").first()["source"] == "kiosk"
