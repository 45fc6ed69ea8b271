"""Every catalog query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from harbinger import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as from '{SF}/{t}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), c.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).astype(str).values))
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_raw_rows_are_parsed_once_for_all_feeds_and_dealt_by_number(spark, monkeypatch):
    from harbinger import catalog

    monkeypatch.setattr(catalog, "ROWS_A_TASK", 16)
    rows = catalog.raw_rows(spark, SF)
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 16) > 1
    plan = catalog.feed_signals(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    parses = plan.count("parseJson(")
    assert 1 <= parses <= 3 and "Union" not in plan  # for what is first, and for all signals


def test_shared_rows_give_each_feed_its_own_signals(spark):
    from harbinger.sources import feeds

    raw = [(0, '{"permit_number": "P1", "inspection_date": "2024-02-03", "dba": "A", "id": "7", "dbaname": "Cart"}'), (1, '{"permit_number": "P1", "inspection_date": "2024-01-03", "dba": "A"}'), (2, '{"permit_number": "-", "inspection_date": "-"}'), (3, "no json"), (4, '{"dba": 3, "inspection_date": "2024-01-01"}')]
    rows = spark.createDataFrame(raw, "seq long, raw string")
    of = [feeds.FEEDS[k] for k in ("health", "vending", "entertainment")]
    got = sorted(map(str, feeds.shared(rows, of, "2024-12-31", None, ["health"]).collect()))
    assert got == sorted(str(r) for f in of for r in feeds.signals(rows, f, "2024-12-31", None, f.key == "health").collect())
    assert [r["seq"] for r in feeds.signals(rows, of[0], "2024-12-31").orderBy("seq").collect()] == [1, 4]
