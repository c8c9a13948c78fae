"""Every catalogue query against its DuckDB SQL on the smallest test data."""

import os

import duckdb
import pytest

from auditloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    result = duck.execute(catalog.oracle_sql()[name])
    wanted_names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(wanted_names)
    assert _rows(found.columns, found.collect()) == _rows(wanted_names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    found = catalog.queries()[name](spark, SF)
    assert found.count() >= 0 and len(set(found.columns)) == len(found.columns)


def test_every_check_has_rows(spark):
    from auditloom.operators.checks import REGISTRY

    found = {r["rule_id"] for r in catalog.queries()["findings"](spark, SF).select("rule_id").distinct().collect()}
    assert found == set(REGISTRY)
