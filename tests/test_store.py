"""The store as a log: what a commit writes, several writers, readers of old versions, windows, and lists by key."""

import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.operators import corroborate, store
from harbinger.operators.log import Log
from harbinger.sources import feeds
from harbinger.streaming import ingest
from tests.test_reference_operators import frame, signal


def batch(spark, *rows):
    return frame(spark, *rows).withColumn("seq", F.monotonically_increasing_id())


def many(spark, n, source="permit", shift=0, **change):
    rows = spark.range(shift, shift + n).select(
        F.lit(source).alias("source"), F.col("id").cast("string").alias("external_id"), F.concat(F.lit("Name "), "id").alias("name"), F.concat("id", F.lit(" Oak Street")).alias("address"),
        F.date_format(F.date_add(F.lit("2020-01-01"), (F.col("id") % 1000).cast("int")), "yyyy-MM-dd").alias("date"), F.lit("Mission").alias("neighborhood"), F.sha2(F.col("id").cast("string"), 512).alias("raw"),
        F.lit(3).alias("score"), F.array(F.lit("r")).alias("reasons"), F.lit("2020-01-01").alias("first_seen"), F.lit(False).alias("seen"),
    )
    return rows.withColumns({k: F.lit(v) for k, v in change.items()} | {"seq": F.lit(0)})


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_an_upsert_writes_what_the_batch_changes(spark, tmp_path):
    """At two table sizes, the second twenty times the first."""
    wrote = []
    for n in (1000, 20_000):
        s = store.Store(spark, f"file://{tmp_path}/{n}")
        s.upsert(many(spark, n))
        before, counts = size(tmp_path / str(n)), {}
        s.upsert(many(spark, 200, shift=n - 100, name="Changed", date="1999-01-01"), {}, counts)
        wrote.append(size(tmp_path / str(n)) - before)
        assert counts == {"rows": 200, "new": 100} and s.signals().count() == n + 100
        got = s.signals().where("name = 'Changed'").groupBy("date").count().collect()
        assert {r["date"]: r["count"] for r in got}["1999-01-01"] == 100 and len(got) > 1  # stored rows keep their dates
    assert wrote[1] < 1.3 * wrote[0]


def test_rows_and_lists_follow_random_batches(spark, tmp_path):
    """After each commit, compaction among them: rows as if merged one batch after the other, lists as from all rows."""
    rng = np.random.default_rng(4)
    s = store.Store(spark, f"file://{tmp_path}/db", most_files=5)
    plain = frame(spark).collect()
    names, streets, hoods = ["Bean LLC", "Beans", "Taco King", "X", ""], ["1 Oak Street", "1 OAK ST", "2 Elm St", "", "5"], ["", "Mission", "Marina", " "]
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    for step in range(4):
        rows = [signal(pick(["permit", "abc", "fire"]), str(rng.integers(0, 25)), pick(streets), f"2026-0{rng.integers(1, 7)}-01", int(rng.integers(0, 5)), pick(names), pick(hoods)) for _ in range(14)]
        rows = list({(r["source"], r["external_id"]): r for r in rows}.values())
        plain = store.merged(spark.createDataFrame(plain, store.SCHEMA), frame(spark, *rows)).collect()
        s.upsert(batch(spark, *rows), {"step": str(step)})
        if step == 2:
            s.compact(["permit", "abc", "fire"], force=True)
            assert all(f["base"] for f in s.log.state().files.values())
        assert sorted(map(str, s.signals().collect())) == sorted(map(str, plain))
    whole = spark.createDataFrame(plain, store.SCHEMA)
    history = corroborate.corroborators(whole)
    for kind, want in (("address", corroborate.address_index(history)), ("name", corroborate.name_index(history))):
        got = corroborate.listed_index(s.listed(kind), want.select("key"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and s.listed(kind).select("key").distinct().count() == want.count()
    want = corroborate.neighborhoods(whole)
    assert sorted(map(str, corroborate.listed_neighborhoods(s.listed("hood"), want.select("key")).collect())) == sorted(map(str, want.collect()))
    assert s.meta() == {"step": "3"}


def test_a_hot_key_is_a_short_list_and_gains_from_late_rows(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.upsert(many(spark, 2000, address="1 Oak St"))
    top = lambda: [i["date"] for i in s.listed("address").where("source = 'permit'").first()["items"]]
    assert top() == ["2022-09-26"] * 2 + ["2022-09-25"] * 2 + ["2022-09-24"] * 2 + ["2022-09-23"] * 2 + ["2022-09-22"] * 2
    s.upsert(batch(spark, signal("permit", "late", "1 Oak Street", "2025-01-01"), signal("permit", "old", "1 Oak St", "1990-01-01")))
    assert top()[:2] == ["2025-01-01", "2022-09-26"] and len(top()) == corroborate.HISTORY_HITS
    s.upsert(batch(spark, signal("permit", "late", "9 Elm St", "2025-01-01")))  # moved: the tenth newest comes back
    assert top()[0] == "2022-09-26" and len(top()) == corroborate.HISTORY_HITS


def test_two_writers_lose_nothing(spark, tmp_path):
    """Threads that commit to the same and to different sources at once."""
    db = f"file://{tmp_path}/db"
    store.Store(spark, db).commit(frame(spark, signal("permit", "0")), {})
    failed = []

    def work(k):
        try:
            mine = store.Store(spark, db)
            for j in range(2):
                mine.upsert(batch(spark, signal("permit", f"{k}-{j}"), signal(f"own{k}", str(j))), {f"watermark:{k}": str(j)})
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = store.Store(spark, db)
    assert not failed and s.meta() == {f"watermark:{k}": "1" for k in range(2)} and s.version() == 5
    got = sorted((r["source"], r["external_id"]) for r in s.signals().collect())
    assert got == sorted([("permit", "0"), *(("permit", f"{k}-{j}") for k in range(2) for j in range(2)), *((f"own{k}", str(j)) for k in range(2) for j in range(2))])
    assert s.listed("address").where("source = 'permit'").first()["items"][0]["name"].startswith("Name") and s.log.commit_of(5)["version"] == 5


def test_a_version_is_claimed_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/db")
    assert log.create("1.json", "{}") and not log.create("1.json", "other") and log._read("1.json") == {}
    assert [x.name for x in (tmp_path / "db/log").iterdir() if not x.name.startswith(".")] == ["1.json"]


def test_old_frames_read_after_many_commits(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db", most_files=1)
    s.upsert(batch(spark, signal("permit", "1"), signal("a:b/c %", "a"), signal("", "none")))
    old = s.signals()
    for k in range(5):
        s.upsert(batch(spark, signal("permit", str(k), score=4), signal("a:b/c %", f"a{k}")))
    s.log.expire()
    assert sorted(r["external_id"] for r in old.collect()) == ["1", "a", "none"]
    assert sorted(r["external_id"] for r in s.signals().collect()) == sorted([*"01234", "a", *(f"a{k}" for k in range(5)), "none"])


def test_what_no_reader_can_have_goes(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db", most_files=1, keep_s=0)
    for k in range(3):
        s.upsert(batch(spark, signal("permit", str(k))))
    (tmp_path / "db/data/write=lost").mkdir()  # of a writer that failed
    s.log.expire()
    used = {f["path"].split("/")[1] for f in s.log.state().files.values()}
    assert {x.name for x in (tmp_path / "db/data").iterdir() if not x.name.startswith(".")} == used
    assert s.signals().count() == 3


def test_state_files_shorten_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("harbinger.operators.log.STATE_EVERY", 2)
    s = store.Store(spark, f"file://{tmp_path}/db", keep_s=0)
    for k in range(5):
        s.upsert(batch(spark, signal("permit", str(k))), {"n": str(k)})
    names = sorted(x.name for x in (tmp_path / "db/log").iterdir() if not x.name.startswith("."))
    assert "4.state" in names and "5.json" in names and "1.json" not in names
    assert s.signals().count() == 5 and s.meta() == {"n": "4"} and store.Store(spark, s.root).version() == 5


@pytest.mark.parametrize("step", ["_write", "create"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    db = f"file://{tmp_path}/db"
    store.Store(spark, db).commit(frame(spark, signal("permit", "1"), signal("abc", "a")), {"m": "1"})

    def lost(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.Store if step == "_write" else Log, step, lost)
        with pytest.raises(OSError):
            store.Store(spark, db).upsert(batch(spark, signal("permit", "2")), {"m": "2"})
    again = store.Store(spark, db)
    assert (again.version(), again.meta(), {r["external_id"] for r in again.signals().collect()}) == (1, {"m": "1"}, {"1", "a"})
    assert again.upsert(batch(spark, signal("permit", "2"))) == 2
    assert {r["external_id"] for r in store.Store(spark, db).signals().collect()} == {"1", "2", "a"}


def test_windows_read_the_files_that_can_have_rows(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.upsert(many(spark, 4000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in s.log.state().files.values() if f["table"] == "signals"]
    assert len(files) >= 4 and all(f["unseen"] == f["rows"] for f in files)
    inside = [f for f in files if f["hi"] >= "2022-09-01" and f["lo"] <= "2022-09-30"]
    got = s.window("2022-09-01", "2022-09-30")
    assert len(got.inputFiles()) == len(inside) < len(files) and got.count() == s.signals().where("date between '2022-09-01' and '2022-09-30'").count() == 4 * 26
    # a row whose newer version lies in a change is that version, also where only the base reaches the window
    s.upsert(batch(spark, signal("permit", "999", name="Newer", date="1999-01-01")))
    assert s.window("2022-09-26", "2022-09-26").where("name = 'Newer'").select("external_id", "date").collect() == [("999", "2022-09-26")]
    assert s.window("1999-01-01", "1999-01-01").count() == 0
    # delivered files are not read again once they are the base
    assert s.deliver(got.select("source", F.col("external_id").alias("id")), "2022-01-01", 2) == s.signals().where("date < '2022-01-01'").count()
    s.compact(["permit"], force=True)
    assert s.window("2020-01-01", "2021-12-31").count() == 0
    assert s.window("2022-01-01", "2022-12-31").count() == 4 * (31 + 28 + 31 + 30 + 31 + 30 + 31 + 31)  # January to August; September is delivered


def test_replaced_sources_lose_their_lists(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.commit(frame(spark, signal("permit", "1", "1 Oak St"), signal("abc", "2", "2 Elm St")), {"a": "1"})
    s.commit(frame(spark, signal("permit", "3", "3 Fir St")), {}, ["permit"])
    assert sorted(r["key"] for r in s.listed("address").collect()) == ["2 ELM ST", "3 FIR ST"] and s.meta() == {"a": "1"}
    assert sorted(r["external_id"] for r in s.signals().collect()) == ["2", "3"]
    s.commit(frame(spark), {})
    assert s.signals().count() == 0 and s.listed("address").count() == 0 and s.meta() == {}


def test_migration_takes_over_rows_and_watermarks(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.commit(frame(spark, signal("business", "7", name="Kept")), {"watermark:businesses": "2026-01-01", "x": "y"})
    columns = "uniqueid string, dba_name string, ownership_name string, dba_start_date string, neighborhood string, address string, reasons string, score int, seen int"
    old = spark.createDataFrame([("7", "A", "O", "2026-01-01", "H", "1 A", "a; b", 2, 1), ("8", "", "Owner", "2026-01-02", "H", "1 Oak St", "a; b", 2, 1)], columns)
    for _ in range(2):
        s.migrate(old, None)
        assert {r["external_id"]: r["name"] for r in s.signals().collect()} == {"7": "Kept", "8": "Owner"} and s.meta() == {"watermark:business": "2026-01-01", "x": "y"}
    assert s.listed("address").where("key = '1 OAK ST'").count() == 1


def inspections(spark, rows, start=0):
    made = [(start + k, json.dumps({"permit_number": p, "inspection_date": f"{d}T00:00:00", "dba": "x"})) for k, (p, d) in enumerate(rows)]
    return spark.createDataFrame(made, "seq long, raw string")


def test_first_events_of_batches_are_those_of_all_rows(spark, tmp_path):
    """Three batches through the kept beginnings, against what stored ids say; the store is compacted in between."""
    s = store.Store(spark, f"file://{tmp_path}/db", share=0, least_bytes=0)
    days = [[("A", "2026-06-01"), ("A", "2026-06-02"), ("b-7", "2026-06-01"), ("", "2026-06-01")], [("a", "2026-06-05"), ("B", "2026-06-03"), ("C", "2026-06-02"), ("C", "2026-06-01")], [("c", "2026-06-09"), ("b-7", "2026-06-08"), ("D", "2026-06-08"), ("B-7-1", "2026-06-01")]]
    feed, have, want = feeds.FEEDS["health"], [], set()
    for day in days:
        rows = inspections(spark, day)
        ids = spark.createDataFrame([(i,) for i in have], "external_id string")
        batch = spark.createDataFrame([(p, f"{d}T00:00:00", k) for k, (p, d) in enumerate(day)], "permit string, date string, seq long")
        want |= {f"{r['permit']}-{r['date']}" for r in store.first_events(batch, ids).collect() if r["first"]}
        ingest.ingest(s, feed, rows, "2026-07-02", "", False)
        have = [r["external_id"] for r in s.signals().collect()]
        assert set(have) == want
    assert want == {f"{p}-2026-06-{d}T00:00:00" for p, d in [("A", "01"), ("b-7", "01"), ("", "01"), ("C", "01"), ("D", "08"), ("B-7-1", "01")]}
    assert len([f for f in s.log.state().files.values() if f["table"] == "starts"]) == 1


def test_first_events_read_what_the_batch_asks_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "STARTS_A_FILE", 500)
    ids = lambda n: many(spark, n, "health").withColumn("external_id", F.concat("external_id", F.lit("-2026-06-01")))
    asked = spark.createDataFrame([("17-",), ("none-",), (None,), ("17-",)], "prefix string")
    read = []
    for n in (2000, 20_000):
        s = store.Store(spark, f"file://{tmp_path}/{n}")
        s.upsert(ids(n))
        got = s.seen("health", asked)
        assert [r["prefix"] for r in got.collect()] == ["17-"]
        read.append((len(got.inputFiles()), sum(f["table"] == "starts" for f in s.log.state().files.values())))
    assert read[0][0] <= 4 and read[1][0] <= 4 and read[1][1] > 5 * read[0][1]  # a bucket lies in one file, or on the edge of two
    before = s.log.state().files
    s.upsert(ids(20_050))  # 50 new ids, 2020 refreshed
    added = [f for k, f in s.log.state().files.items() if k not in before and f["table"] == "starts"]
    assert 50 <= sum(f["rows"] for f in added) <= 50 * 3
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    assert sorted(r["prefix"] for r in s.seen("health", asked.unionByName(spark.createDataFrame([("20049-",)], "prefix string"))).collect()) == ["17-", "20049-"]
    assert s.seen("health", asked.where("false")).count() == 0 and s.seen("other", asked).count() == 0


def test_beginnings_come_to_stores_without_them_and_go_with_their_source(spark, tmp_path):
    row = lambda *ids: batch(spark, *[signal("health", i) for i in ids])
    asked = spark.createDataFrame([("p-",), ("q-",), ("r-",)], "prefix string")
    have = lambda s: sorted(r["prefix"] for r in s.seen("health", asked).collect())
    at = f"file://{tmp_path}/db"
    store.Store(spark, at, firsts=()).upsert(row("p-1"))
    s = store.Store(spark, at)
    assert have(s) == ["p-"]
    s.upsert(row("Q-1"))
    assert have(s) == ["p-", "q-"] and any(f["table"] == "starts" for f in s.log.state().files.values())
    s.commit(frame(spark, signal("health", "r-1")), {}, ["health"])
    assert have(s) == ["r-"]
    s.commit(frame(spark), {})
    assert have(s) == []


def test_facts_that_rows_take_and_lose_are_told_in_one_pass(spark):
    past = f"struct<{', '.join(f.replace(' ', ':', 1) for f in store.WAS.split(', '))}>"
    was = lambda name, hood, score: (name, "1 Oak St", "2026-01-01", hood, score, "2026-01-01", False, "1 OAK ST", name.upper())
    row = lambda id, name, hood, score, before: ("permit", id, name, "1 Oak St", "2026-01-01", hood, "", score, [], "2026-01-01", False, "1 OAK ST", name.upper(), before)
    rows = spark.createDataFrame([
        row("1", "Same", "North", 3, was("Same", "North", 3)), row("2", "After", "North", 3, was("Before", "North", 3)), row("3", "Weak", "", 1, was("Weak", "South", 2)), row("4", "Fresh", "", 2, None), row("5", "Before", "", 2, was("After", "", 2)),
    ], f"{store.SCHEMA}, {store.KEYS}, was {past}")
    made = store.moved(rows)
    got = {(r["lost"], r["kind"], r["name"], r["id"]) for r in made.collect()}
    a_and_n = lambda lost, *names: {(lost, kind, n, "") for kind in ("address", "name") for n in names}
    assert got == a_and_n(True, "Before", "After", "Weak") | a_and_n(False, "After", "Before", "Fresh") | {(True, "hood", "South", "3")}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("ExistingRDD") + plan.count("LocalRelation") == 1
    listed = store.lists(store.facts(rows))
    assert listed._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert [[i["name"] for i in r["items"]] for r in listed.where("kind = 'hood'").collect()] == [["North"]]
    assert [[i["name"] for i in r["items"]] for r in listed.where("kind = 'address'").collect()] == [["After", "Before", "Fresh", "Same"]]
