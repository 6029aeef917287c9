"""Every catalogued query against its DuckDB twin on the smallest dataset."""

from __future__ import annotations

import glob
import math
import os

import pytest

from skerry.plans.catalog import ORACLE_SQL, QUERIES
from skerry.streaming.windows import tumbling_counts


@pytest.fixture(scope="module")
def con(sf):
    c = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return "NaN" if math.isnan(v) else float(f"{float(v):.11g}") + 0.0
    except TypeError:
        return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["order_nulls_all", "order_multi_key_all", "order_by_expr_all", "win_order_alias_all"])
def test_whole_order(spark, sf, con, name):
    """All rows, in the order of the twin."""
    df = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLE_SQL[name])
    assert df.columns == [d[0] for d in cursor.description]
    want = [tuple(map(plain, r)) for r in cursor.fetchall()]
    assert [tuple(map(plain, r)) for r in df.collect()] == want
    if name == "order_nulls_all":
        assert {s is None for _, s in want} == {True, False}


def test_stream_is_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = tumbling_counts(stream, "ts", "1 hour", ["event_type"]).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in tumbling_counts(events, "ts", "1 hour", ["event_type"]).collect()}
    assert {tuple(r) for r in spark.table("counted").collect()} == want
