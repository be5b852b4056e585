"""Every query with a SQL twin gives the twin's rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidestore.plans.oracles import ORACLE_SQL
from tidestore.plans.queries import QUERIES
from tidestore.plans.scenarios import ORACLES, SCENARIOS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def canonical(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return str(v) if isinstance(v, bool | str) else repr(float(v))

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES | SCENARIOS))
def test_query(spark, sql, name):
    got = (QUERIES | SCENARIOS)[name](spark, SF)
    want = sql.sql((ORACLE_SQL | ORACLES)[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert canonical([r.asDict() for r in got.collect()], columns) == canonical(rows, columns)


def test_entry(spark):
    assert entry.entry(spark).columns == QUERIES["fetch_many"](spark, SF).columns


def test_flagship_plan_prunes_and_pushes_down(spark, tmp_path):
    from tidestore.model import StoreConfig
    from tidestore.plans import tables
    from tidestore.plans.queries import END, FLAGSHIP, START
    from tidestore.sources.store import SampleStore

    with SampleStore(spark, StoreConfig(base_dir=f"file://{tmp_path}")) as store:
        store.bulk_import(tables.event_samples(spark, SF))
        store.replace_catalog(tables.event_metrics(spark, SF))
        plan = store.fetch_many(FLAGSHIP, START, END)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    assert "GreaterThan(time" in plan and "LessThan(time" in plan
