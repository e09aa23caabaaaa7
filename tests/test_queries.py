"""Every registered query against its DuckDB counterpart, on the smallest tables."""

import math

import duckdb
import pytest

from corvella.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, int) or hasattr(value, "as_tuple") else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    said = duck.execute(registry.oracles()[name])
    names = [d[0] for d in said.description]
    assert sorted(got.columns) == sorted(names)
    want = _rows(names, said.fetchall())
    assert want and _rows(got.columns, [tuple(r) for r in got.collect()]) == want


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_module():
    import __spark_entry__ as entry

    assert {"hybrid_search"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scans(spark):
    """The wide columns are read only where they are used, and each leg cuts before it is merged."""
    plan = registry.queries()["acl_retrieval"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = registry.queries()["llm_logs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [IsNotNull" in plan
    plan = registry.queries()["hybrid_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") >= 2 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
