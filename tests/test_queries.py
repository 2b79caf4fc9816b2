"""Every core query with SQL against DuckDB on the smallest tables."""

import importlib
import importlib.util

import pytest

from tests.compare import same
from tests.conftest import DATA

PARTS = [importlib.import_module(m) for m in ("splitloom.plans.quality", "splitloom.plans.splits")]
SQL = {k: (m.QUERIES[k], s) for m in PARTS for k, s in m.SQL.items()}
REST = {k: f for m in PARTS for k, f in m.QUERIES.items() if k not in m.SQL}
needs_data = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, *SQL[name], DATA / "sf0.001")


@needs_data
@pytest.mark.parametrize("name", sorted(REST))
def test_query_without_sql_runs(spark, name):
    df = REST[name](spark, str(DATA / "sf0.001"))
    rows = df.collect()
    assert {r["side"] for r in rows} <= {0, 1} and len({r["id"] for r in rows}) == len(rows)


def test_core_stands_without_llm(monkeypatch):
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("splitloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(e, "_MODULES", [m if "llm" not in m else "splitloom.no_such_part" for m in e._MODULES])
    assert "p3_found" in e.queries() and "p1_found" not in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
