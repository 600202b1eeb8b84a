"""Every registered query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from sightline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SQL = catalog.ORACLE_SQL | catalog.SLOW_SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if x is None or str(x) in ("nan", "<NA>", "None", "NaT"):
        return "NULL"
    if isinstance(x, bool) or str(x) in ("True", "False"):
        return str(x)
    if isinstance(x, str):
        return x
    if hasattr(x, "__len__"):
        return str([plain(y) for y in x])
    try:
        return repr(round(float(x), 5) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(math.isfinite(v) for v in __spark_entry__.entry(spark).first().asDict().values())


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(rows(catalog.QUERIES["l5_review_queue"](spark, SF).toPandas()))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_measured_bins_of_every_event(spark, tmp_path):
    events = [(5, 20.0), (199_999, 0.0), (200_000, 20.0), (3_000_000, 150.0)]
    spark.createDataFrame(events, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["v22_measured_bins"](spark, str(tmp_path)).collect()
    want = {(e, i) for e, v in events for i in range(12) if v < i * 180 / 11 < v + 40}
    assert {(r.event_id, r.i) for r in got} == want and {e for e, _ in want} == {e for e, _ in events}


def test_long_evidence_reads_each_table_once(spark):
    plan = catalog.QUERIES["u2_long_evidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


@pytest.mark.parametrize("name", ["g17_sighting_strength", "l5_review_queue", "l4_next_sighting"])
def test_sightings_are_joined_as_one_row_each_in_tasks_of_bounded_size(spark, monkeypatch, name):
    from sightline.operators import shared
    from sightline.plans import inputs

    monkeypatch.setattr(inputs, "TASK_LINES", 500)
    before, sides = rows(catalog.QUERIES[name](spark, SF).toPandas()), inputs.sighting_sides(spark, SF)
    monkeypatch.setattr(inputs, "TASK_LINES", 1 << 17)
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == before
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert shared.materialise(sides).count() == lines.select("l_orderkey").distinct().count()
    plan = sides._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [sighting" in plan and f", {-(-lines.count() // 500)}" in plan
