"""Behaviour of the filing operators on small rows of our own."""

import datetime
import http.server
import json
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from harbinger import cli, config
from harbinger.functions import fields, html, textnorm
from harbinger.operators import corroborate, scoring, store, venues
from harbinger.plans import digest, render
from harbinger.sources import feeds, report, rest
from harbinger.streaming import ingest


def values(spark, xs, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").select("i", make(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(("make", "cases"), [
    (textnorm.address_key, {"12 Oak Street": "12 OAK ST", " 12  oak st., Apt 4": "12 OAK ST", "TWO FIRST AVENUE": "2 1ST AVE", "88-90 Spear St # 7": "88 SPEAR ST", "UNIT 5 Pier": "UNIT 5 PIER", "5 Elm #702": "5 ELM #702", "": "", None: "", "a-b Elm Hy": "A-B ELM HWY"}),
    (textnorm.name_key, {"Joe’s Tacos LLC": "JOE TACO", "Glass & Co. Inc": "GLASS", "BUS stop": "BUS STOP", "LLC": "", "Co-op Corp Ltd": "CO OP", "Zoé's": "ZOÉ"}),
    (textnorm.normal_date, {"20260701": "2026-07-01", "2026-07-01T00:00:00": "2026-07-01", " 2026": "2026", "": "", None: ""}),
    (textnorm.without_zip, {"1 A  St 94110": "1 A St", "1 A St 9411": "1 A St 9411", "94110": "", "": ""}),
    (html.strip_tags, {"<b>a</b> &amp;lt; b": "a < b", "x > y": "x y", "a<unclosed": "a", "&#8217;": "'"}),
    (lambda c: scoring.has_bar(c), {"wet bar": False, "sports bar": True, "rebar": False, "bar": True, "grab bar, wine bar": True}),
])
def test_normal_forms(spark, make, cases):
    assert values(spark, list(cases), make) == [v if isinstance(v, bool) else v for v in cases.values()]


def test_fields_count_only_their_own_kind(spark):
    raw = ['{"a":" x "}', '{"a":1}', '{"a":"true"}', '{"a":true}', "no json", None, '{"a":"1e3"}', '{"a":"NaN"}', '{"a":2.5}']
    assert values(spark, raw, lambda c: fields.field(fields.parsed(c), "a")) == ["x", "", "true", "", "", "", "1e3", "NaN", ""]
    assert values(spark, raw, lambda c: fields.flag(fields.parsed(c), "a")) == [False, False, False, True, False, False, False, False, False]
    assert values(spark, raw, lambda c: fields.number(fields.parsed(c), "a")) == [None, 1.0, None, None, None, None, 1000.0, None, 2.5]


@pytest.mark.parametrize(("rule", "row", "score"), [
    (scoring.business, {"lic_code_description": "Barber"}, 2), (scoring.business, {"self_reported_naics_code": "4451", "dba_name": "A", "ownership_name": "a"}, 2), (scoring.permit, {"description": "New restaurant, change of use", "estimated_cost": "100000"}, 4),
    (scoring.permit, {"description": "newly", "estimated_cost": 100000.5}, 1), (scoring.fire, {"permit_type_description": "Temporary Place of Assembly"}, 0), (scoring.fire, {"permit_type_description": "neighborhood"}, 3), (scoring.electrical, {"description": "kitchen", "permit_valuation": "60000"}, 2),
    (scoring.plumbing, {"description": "grease"}, 2), (scoring.tables_chairs, {"tablesandchairs": True}, 3), (scoring.mobile_food, {"facilitytype": "TRUCK"}, 3), (scoring.vending, {"describewhatyouwillsell": "Tacos"}, 3), (scoring.planning, {"description": "Takeout"}, 2), (scoring.entertainment, {}, 2),
])
def test_scores(spark, rule, row, score):
    got = values(spark, [json.dumps(row)], lambda c: rule(fields.parsed(c)))[0]
    assert got["score"] == score and (score == 0) == (got["reasons"] == [])


def test_report_days_and_page(spark):
    end = datetime.date(2026, 7, 1)
    assert len(report.days_to_fetch(None, None, end)) == 15 and len(report.days_to_fetch("2026-01-01", None, end)) == 31
    assert report.days_to_fetch("2026-07-01", None, end) == [] and report.days_to_fetch("2026-06-01", "2026-06-30", end)[0] == datetime.date(2026, 6, 30)
    assert report.extract_nonce('<input name="abclqs_daily_report" value="ab12">') == "ab12" and report.extract_nonce('name="abclqs_daily_report" value=""') is None
    cell = lambda x: f"<td>{x}</td>"
    row = lambda n, county: f'<tr><th><a href="?LICENSE={n}">{n}</a></th>' + "".join(map(cell, ["ACTIVE", "47 | Y", "", "dba: Bean<br/>Owner LLC<br>1 A St", "", "PER", "", "", "", "", "1 A St", "SF", county, "94110", ""])) + "</tr>"
    page = "<table><tr><th>License</th></tr>" + row(1, "38") + row(2, "19") + "<tr><td>short</td></tr></table>"
    got = report.parsed(spark.createDataFrame([("IssuedLicenses", end, page)], "kind string, day date, html string"))
    assert [r.asDict() for r in got.drop("kind", "day").collect()] == [{"license_number": "1", "status": "ACTIVE", "license_type": 47, "action": "PER", "dba": "Bean", "owner": "Owner LLC", "street": "1 A St", "city": "SF", "zip": "94110"}]
    s = report.signals(got.withColumn("seq", F.lit(0)), "2026-07-02").first()
    assert (s["external_id"], s["score"], s["name"], s["date"]) == ("1-issued", 3, "Bean", "2026-07-01")


def signal(source, external_id, address="1 Oak St", date="2026-07-01", score=3, name=None, hood="", seen=False):
    return Row(source=source, external_id=external_id, name=name or f"Name {external_id}", address=address, date=date, neighborhood=hood, raw="{}", score=score, reasons=["r"], first_seen=date, seen=seen)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), store.SCHEMA)


def test_merge_keeps_dates_and_delivery(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.upsert(frame(spark, signal("permit", "1", seen=True)).withColumn("seq", F.lit(0)), {"watermark:permit": "2026-07-01"})
    s.upsert(frame(spark, signal("permit", "1", date="2026-08-01", score=5), signal("permit", "2", score=1), signal("permit", "2", date="2026-09-09", score=2)).withColumn("seq", F.monotonically_increasing_id()))
    got = {r["external_id"]: (r["date"], r["score"], r["seen"]) for r in s.signals().collect()}
    assert got["1"] == ("2026-07-01", 5, True) and got["2"][1] == 2 and s.meta() == {"watermark:permit": "2026-07-01"} and s.version() == 2


def test_archive_and_seen(spark):
    rows = frame(spark, signal("a", "old", date="2026-01-01"), signal("a", "empty", date=""), signal("a", "weak", date="2026-01-01", score=1), signal("a", "new"))
    assert {r["external_id"] for r in store.archived(rows, "2026-06-01", 2).where("seen").collect()} == {"old"}
    shown = spark.createDataFrame([("a", "new")], "source string, id string")
    assert {r["external_id"] for r in store.marked_seen(rows, shown).where("seen").collect()} == {"new"}


def test_first_events_see_prefixes(spark):
    batch = spark.createDataFrame([("P1", "2024-01-02", 1), ("P1", "2024-01-01", 2), ("P1-A", "2024-01-01", 3), ("Q", "2024-01-01", 4), ("S", "2024-01-01", 5)], "permit string, date string, seq long")
    ids = spark.createDataFrame([("s-x-2020",)], "external_id string")
    got = {r["seq"]: r["first"] for r in store.first_events(batch, ids).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_digest_end_to_end(spark, tmp_path, capsys):
    rows = [
        signal("permit", "p", "1 Oak Street", score=1, hood="Mission"), signal("abc", "a", "1 OAK ST", "2026-06-30", name="Bean"), signal("business", "b", "1 Oak St", score=1), signal("mobile_food", "m", "", name="Beans LLC", score=2),
        signal("permit", "lone", "9 Elm St", score=1), signal("health", "old", "1 Oak St", "2025-01-01", name="Prior", seen=True), signal("vending", "stale", "7 Fir St", "2026-01-01"),
    ]
    made = digest.build(frame(spark, *rows), "2026-07-02", 7, 2)
    shown = {r["name"]: r for r in made.shown.collect()}
    assert set(shown) == {"Bean"} and {e["id"] for e in made.filings().collect()} == {"p", "a", "m"}
    assert shown["Bean"]["neighborhood"] == "Mission" and [h["name"] for h in shown["Bean"]["history"]] == ["Prior"]
    text = render.text(made, 7)
    assert "Bean — 1 OAK ST" in text and "3 new signal(s) at 1 venue(s)." in text and "corroborated by" not in text
    out = json.loads(render.as_json(made, 7, 2, 0, "now"))
    assert list(out) == ["tool", "generated_at", "window_days", "min_score", "archived", "entries", "venues"] and len(out["entries"]) == 3 and any("corroborated by" in r for e in out["entries"] for r in e["reasons"])
    db = f"file://{tmp_path}/db"
    s = store.Store(spark, db)
    s.commit(frame(spark, *rows), {})
    assert cli.main(["--db", db, "digest", "--json", "--dry-run"], spark, "2026-07-02") == 0 and s.version() == 1
    other = f"file://{tmp_path}/other"
    store.Store(spark, other).commit(frame(spark, *rows), {})
    assert cli.main(["--db", other, "digest", "--md"], spark, "2026-07-02") == 0
    assert capsys.readouterr().out.endswith("\n3 new signal(s) at 1 venue(s).\n(archived 1 signals older than the window)\n")
    assert cli.main(["--db", db, "digest", "--json"], spark, "2026-07-02") == 0
    assert json.loads(capsys.readouterr().out)["archived"] == 1
    assert {r["external_id"] for r in s.signals().where("seen").collect()} == {"p", "a", "m", "old", "stale"}
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["digest", "--md", "--json"])


def test_venues_do_not_merge_addresses(spark):
    e = lambda i, name, address: (f"s{i}", str(i), name, address, "2026-07-01", "", 2)
    rows = spark.createDataFrame([e(1, "Taco King", "1 Oak St"), e(2, "Taco Kings", "2 Elm St"), e(3, "taco king", ""), e(4, "Solo Cart", ""), e(5, "Solo Carts", ""), e(6, "", "")], "source string, id string, name string, address string, date string, neighborhood string, score int")
    got = {r["id"]: r["venue_key"] for r in venues.assign(rows).collect()}
    assert got == {"1": "A:1 OAK ST", "2": "A:2 ELM ST", "3": "A:1 OAK ST", "4": "N:SOLO CART", "5": "N:SOLO CART", "6": "I:s6:6"}


def test_hot_address_is_cut_before_it_is_gathered(spark):
    rows = spark.range(500).select(F.lit("permit").alias("source"), F.concat(F.lit("n"), "id").alias("name"), F.lit("1 Oak St").alias("address"), F.lit("2026-01-01").alias("date"))
    assert corroborate.address_index(rows).select(F.size("filings")).first()[0] == corroborate.HISTORY_HITS


def test_migration(spark):
    old = spark.createDataFrame([("7", "", "Owner", "2026-01-01", "H", "1 A", "a; b", 2, 1)], "uniqueid string, dba_name string, ownership_name string, dba_start_date string, neighborhood string, address string, reasons string, score int, seen int")
    got = store.migrated(frame(spark), old, None).first()
    assert (got["name"], got["reasons"], got["seen"], got["first_seen"]) == ("Owner", ["a", "b"], True, "2026-01-01")


@pytest.fixture
def service():
    """A paged dataset: fails once, then serves 7 rows."""
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            from urllib.parse import parse_qs, urlparse

            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            calls.append(q)
            if len(calls) == 1:
                self.send_response(503)
                self.end_headers()
                return
            if "count" in q.get("$select", ""):
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b'[{"count":"7"}]')
                return
            lo = int(q["$offset"])
            body = json.dumps([{"permit_number": str(k), "description": "new cafe", "filed_date": f"2026-07-0{k + 1}T00:00:00"} for k in range(7)][lo : lo + int(q["$limit"])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls
    server.shutdown()


def test_rest_source_pages_retries_and_ingests(spark, service, tmp_path):
    base, calls = service
    spark.dataSource.register(rest.RestSource)
    rows = spark.read.format("harbinger_rest").options(base=base, dataset="x", dateField="filed_date", since="2026-07-01", pageSize="3", pagesPerTask="1").load().persist()
    assert rows.rdd.getNumPartitions() == 3 and sorted(r["seq"] for r in rows.collect()) == list(range(7))
    asked = [c for c in calls if "$select" not in c]
    assert {c["$where"] for c in calls} == {"filed_date >= '2026-07-01'"} and sorted(c["$offset"] for c in asked) == ["0", "3", "6"] and len(calls) == 6
    s = store.Store(spark, f"file://{tmp_path}/db")
    assert ingest.ingest(s, feeds.FEEDS["permit"], rows, "2026-07-05", "2026-07-01", False) == 7
    assert s.meta() == {"watermark:permit": "2026-07-05"} and s.signals().where("score = 3").count() == 7
    again = [feeds.signals(rows, f, "2026-07-05").count() for f in (feeds.FEEDS["health"], feeds.FEEDS["planning"])]
    assert again[0] == 7 and again[1] == 0


def test_streamed_batches_meet_the_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"seq":1,"raw":"{\\"permit_number\\":\\"1\\",\\"description\\":\\"bar\\",\\"filed_date\\":\\"20260701\\"}"}\n')
    s = store.Store(spark, f"file://{tmp_path}/db")
    for _ in range(2):
        rows = spark.readStream.schema("seq long, raw string").json(f"file://{tmp_path}/in")
        ingest.stream(rows, feeds.FEEDS["permit"], s, "2026-07-02", f"file://{tmp_path}/cp").awaitTermination()
    assert s.signals().count() == 1 and s.meta() == {"watermark:permit": "2026-07-01"} and s.version() == 1


def test_config(spark, tmp_path, capsys):
    assert config.parse('app_token = "x"').app_token == "x" and config.load(f"file://{tmp_path}/db", spark) == config.Config()
    for db in (f"file://{tmp_path}/db", f"file://{tmp_path}/db/", str(tmp_path / "db"), f"file:{tmp_path}/db"):
        (tmp_path / "config.toml").write_text('app_token = "from file"')
        assert config.load(db, spark).app_token == "from file"
        (tmp_path / "config.toml").write_text("app_token = [")
        assert config.load(db, spark) == config.Config() and "config.toml" in capsys.readouterr().err
    assert config.path_for("db") == "./config.toml" and config.app_token(" ", config.Config("f")) == "f" and config.app_token("e", config.Config("f")) == "e"


class City:
    """Pages of all feeds and of the report; what a test sets as status fails."""

    def __init__(self):
        self.calls, self.status, self.rows, city = [], {}, {}, self

        class Handler(http.server.BaseHTTPRequestHandler):
            def reply(self, status, body):
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):
                from urllib.parse import parse_qs, urlparse

                at = urlparse(self.path)
                q = {k: v[0] for k, v in parse_qs(at.query).items()}
                name = at.path.rsplit("/", 1)[-1].removesuffix(".json")
                city.calls.append((name, q, self.headers.get("X-App-Token")))
                if name == "form":
                    return self.reply(200, b'<input name="abclqs_daily_report" value="n1">')
                status = city.status.get(name, [])
                if status:
                    return self.reply(status.pop(0), b"no")
                if q.get("$select") == "count(*)" and isinstance(city.rows.get(name, []), list):
                    return self.reply(200, json.dumps([{"count": str(len(city.rows.get(name, [])))}]).encode())
                lo = int(q.get("$offset", 0))
                self.reply(200, json.dumps(city.rows.get(name, [])[lo : lo + int(q.get("$limit", 9))] if isinstance(city.rows.get(name, []), list) else city.rows[name]).encode())

            def do_POST(self):
                from urllib.parse import parse_qs

                form = {k: v[0] for k, v in parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()).items()}
                city.calls.append(("report", form, None))
                cells = ["ACTIVE", "47 | Y", "", "dba: Bean<br/>Owner LLC<br>1 A St", "", "ORI", "", "", "", "", "1 A St", "SF", "38", "94110", ""]
                self.reply(200, ('<table><tr><th>x</th></tr><tr><th><a href="?LICENSE=5">5</a></th>' + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>").encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def city():
    made = City()
    yield made
    made.server.shutdown()


@pytest.mark.parametrize(("status", "calls", "error"), [([429, 500], 3, None), ([503, 503, 503], 3, "503"), ([404], 1, "404"), ([400], 1, "400")])
def test_pages_are_tried_again(city, status, calls, error):
    city.status["x"], waits = list(status), []
    if error:
        with pytest.raises(RuntimeError, match=error):
            rest.get_page(f"{city.base}/x", "key", waits.append)
    else:
        assert rest.get_page(f"{city.base}/x", "key", waits.append) == []
    assert len(city.calls) == calls and waits == list(range(1, calls)) and {c[2] for c in city.calls} == {"key"}


def test_pages_of_another_shape_and_lost_servers(city):
    city.rows["x"] = {"error": True}
    with pytest.raises(rest.BadShape):
        rest.get_page(f"{city.base}/x")
    waits = []
    with pytest.raises(RuntimeError):
        rest.get_page("http://127.0.0.1:9/x", None, waits.append)
    assert waits == [1, 2]


def test_fetch_reads_every_feed_and_goes_on_after_failures(spark, city, tmp_path):
    ids = {f.dataset: f.key for f in feeds.FEEDS.values()}
    health, permit, fire = (feeds.FEEDS[k].dataset for k in ("health", "permit", "fire"))
    city.rows[health] = [{"permit_number": "9", "inspection_date": "2026-06-01T00:00:00", "dba": "Old Cafe", "street_address": "1 Oak St"}]
    city.rows[permit] = [{"permit_number": "7", "filed_date": "2027-01-01T00:00:00", "description": "new cafe", "street_number": "1", "street_name": "Oak", "street_suffix": "St", "unit": "4"}]
    city.status[fire] = [404]
    s = store.Store(spark, f"file://{tmp_path}/db")
    form = {"page": f"{city.base}/form", "post": f"{city.base}/report", "pause": "0"}
    run = lambda **o: ingest.fetch(spark, s, "2026-07-02", token="key", base=city.base, report_options=form, **o)
    stored, failed = run(only=["health", "permit", "fire", "vending", "abc"], since=None)
    assert set(failed) == {"fire"} and "404" in failed["fire"] and stored == {"health": 1, "permit": 1, "vending": 0, "abc": 30}
    rows = {(r["source"], r["external_id"]): r for r in s.signals().collect()}
    assert rows["permit", "7"]["address"] == "1 Oak St, unit 4" and rows["abc", "5"]["name"] == "Bean" and set(rows) == {("permit", "7"), ("health", "9-2026-06-01T00:00:00"), ("abc", "5"), ("abc", "5-issued")}
    assert rows["health", "9-2026-06-01T00:00:00"]["seen"] and not rows["permit", "7"]["seen"]  # the first run of a quiet feed is no news
    assert s.meta() == {"watermark:health": "2026-06-01", "watermark:permit": "2026-07-02", "watermark:abc": "2026-07-01"}
    asked = lambda name: [c[1].get("$where") for c in city.calls if c[0] == name][-1]
    assert asked(health) == "inspection_date >= '2024-01-01'" and asked(permit) == "filed_date >= '2026-04-03'" and asked(feeds.FEEDS["vending"].dataset) is None
    assert [c[0] for c in city.calls].count("form") == 1
    assert {c[2] for c in city.calls if c[0] in ids} == {"key"} and len({c[1]["abclqs-date"] for c in city.calls if c[0] == "report"}) == 15
    city.rows[health].append({"permit_number": "10", "inspection_date": "2026-06-02T00:00:00", "dba": "New Cafe"})
    assert run(only=["health"])[0] == {"health": 1} and asked(health) == "inspection_date >= '2026-06-01'"
    assert {r["external_id"]: r["seen"] for r in s.signals().where("source = 'health'").collect()} == {"9-2026-06-01T00:00:00": True, "10-2026-06-02T00:00:00": False}
    run(only=["health"], since="2026-05-05", full=True)
    assert asked(health) == "inspection_date >= '2026-05-05'"
    run(only=["health"], full=True)
    assert asked(health) == "inspection_date >= '2024-01-01'"
    assert run(only=["abc"])[0] == {"abc": 0}


def test_digest_shows_buckets_hoods_and_venues_in_order(spark):
    e = lambda i, hood, score, date: signal(f"s{i}", str(i), f"{i}00 Oak St", date, score, f"Bar Number {i} X", hood)
    rows = [e(1, "B", 3, "2026-07-01"), e(2, "A", 5, "2026-06-30"), e(3, "C", 5, "2026-07-01"), e(4, "A", 4, "2026-07-01"), e(5, "", 3, "2026-07-01"), e(6, "B", 2, "2026-07-02"), e(7, "A", 5, "2026-06-30")]
    flat = digest.build(frame(spark, *rows), "2026-07-02", 7, 2).filings().collect()
    keys = [(r["bucket_rank"], -r["hood_score"], r["hood_date"], r["venue_rank"]) for r in flat]
    assert [r["id"] for r in flat] == ["3", "2", "7", "4", "1", "6", "5"] and [k[3] for k in keys] == [1, 1, 2, 3, 1, 2, 1]


def test_markdown_and_json_word_by_word(spark):
    rows = [signal("permit", "p", "1 Oak Street", score=3, hood="Mission"), signal("abc", "a", "1 OAK ST", "2026-06-30", name="Bean"), signal("health", "old", "1 Oak St", "2025-01-01", name="Prior", seen=True)]
    made = digest.build(frame(spark, *rows), "2026-07-02", 7, 2)
    assert render.text(made, 7, True) == """# Early signals — last 7 days

## 🔥 Strong signals

### Mission

- **Bean** — 1 OAK ST — score 5 — 2 filings
  - 2026-07-01 [permit] [Name p](https://dbiweb02.sfgov.org/dbipts/default.aspx?page=Permit&PermitNumber=p): r
  - 2026-06-30 [abc] [Bean](https://www.abc.ca.gov/licensing/license-lookup/single-license/?RPTTYPE=12&LICENSE=a): r
  - earlier: health: Prior (2025-01-01)

2 new signal(s) at 1 venue(s).
"""
    out = json.loads(render.as_json(made, 7, 2, 0, "now"))
    venue = out["venues"][0]
    assert list(venue) == ["name", "address", "neighborhood", "date", "score", "bucket", "filings", "history"] and list(venue["filings"][0]) == ["source", "id", "name", "address", "neighborhood", "date", "score", "bucket", "reasons", "url", "description"]
    assert venue["history"] == [{"source": "health", "name": "Prior", "date": "2025-01-01"}] and out["entries"] == venue["filings"] and venue["filings"][1]["reasons"] == ["r", "corroborated by permit: Name p (2026-07-01), health: Prior (2025-01-01)"]
    none = digest.Digest(made.entries, made.shown.where("false"))
    assert render.text(none, 7, True, 3).endswith("\n\nNo new signals.\n(archived 3 signals older than the window)\n")
    assert json.loads(render.as_json(none, 7, 2, 0, "now"))["venues"] == []


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    """Byte for byte what is printed and what json.dumps gives, over several files, with every bucket."""
    e = lambda i, hood, score, date: signal(("permit", "abc")[i % 2], str(i), f"{i // 2}00 Oak St", date, score, f"Bär {i} \"X\"", hood)
    made = digest.build(frame(spark, *[e(i, "ABC"[i % 3], 1 + i % 4, f"2026-07-0{1 + i % 2}") for i in range(24)]), "2026-07-02", 7, 1)
    with made.kept():
        for name, rows in (("md", render.lines(made, 7, True)), ("json", render.json_rows(made, 7, 1, 2, "now"))):
            want = "".join(render.printed(rows))
            render.write(rows, f"file://{tmp_path}/{name}", 5)
            files = sorted((tmp_path / name).glob("part-*"))
            assert len(files) > 2 and "".join(f.read_text() for f in files) == want
    out = json.loads(want)
    assert json.dumps(out, indent=2, ensure_ascii=False) + "\n" == want and len(out["entries"]) == 24 and out["entries"] == [f for v in out["venues"] for f in v["filings"]]
    assert {v["bucket"] for v in out["venues"]} == {"strong", "watch"} and len(out["venues"]) == 12


def test_a_venue_of_very_many_entries_is_short_rows(spark):
    rows = spark.range(20_000).select(F.lit("permit").alias("source"), F.col("id").cast("string").alias("id"), F.concat(F.lit("Name "), "id").alias("name"), F.lit("1 Oak St").alias("address"), F.lit("2026-07-01").alias("date"), F.lit("").alias("neighborhood"), (F.col("id") % 5).cast("int").alias("score"))
    filed = spark.createDataFrame([("1 Oak St", [("2026-07-01", "permit", "Name 3"), ("2026-06-30", "abc", "Other")])], f"address string, filings array<{corroborate.ENTRY}>")
    assigned = venues.assign(rows.join(F.broadcast(filed), "address"))
    v = venues.summarize(assigned).collect()
    assert len(v) == 1 and v[0]["n_entries"] == 20_000 and [h["name"] for h in v[0]["history"]] == ["Other"] and len(str(v[0])) < 1000
    got = venues.members(assigned).where("position <= 2 or position = 20000").orderBy("position").collect()
    assert [(r["id"], r["position"]) for r in got] == [("10004", 1), ("10009", 2), ("9995", 20_000)]


def test_entries_of_a_neighborhood(spark):
    rows = [signal("permit", "1", "1 Oak St", hood="Outer Mission"), signal("abc", "2", "1 Oak St"), signal("fire", "3", "9 Elm St", hood="Marina"), signal("vending", "4", "8 Elm St")]
    made = digest.build(frame(spark, *rows), "2026-07-02", 7, 2, "mISS")
    assert {r["id"] for r in made.entries.collect()} == {"1", "2"}  # the second inherits it
    assert [r["id"] for r in digest.candidates(frame(spark, *rows), "2026-06-01", "2026-07-02", 1, "mar_na").collect()] == ["3"]


def test_init_makes_a_store(spark, tmp_path):
    assert cli.main(["--db", f"file://{tmp_path}/db", "init"], spark, "2026-07-02") == 0
    assert store.Store(spark, f"file://{tmp_path}/db").signals().count() == 0
