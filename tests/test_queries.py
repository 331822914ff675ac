"""Every query over the smallest tables against its SQL in DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from loomspan import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert df.columns
        return
    sql = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, found), rows(columns, sql.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-6) if all(isinstance(x, (int, float)) for x in (*a, *b)) else str(a) == str(b) or all(x == y or isinstance(x, float) and abs(x - y) < 1e-4 for x, y in zip(a, b))


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["dim", "value", "n", "errors"]


def test_plans_prune_and_avoid_products(spark):
    """Scans read the columns they need, and no plan has a Cartesian product or a Python node outside the few that need one."""
    python = {"w8_lanes", "w8_lane_sizes", "i14_skill_attribution", "o6_fuzzy_matches", "j7_attached_spans"}
    for name, query in catalog.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert name in python or not any(x in plan for x in ("Python", "Pandas", "MapInArrow")), name
    plan = catalog.QUERIES["c28_json_fields"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan and "value" not in plan.split("ReadSchema")[1]
