"""The subpackage's queries with SQL against DuckDB on the smallest tables."""

import pytest

from splitloom.llm.queries import QUERIES, SQL
from tests.compare import same
from tests.conftest import DATA

needs_data = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], DATA / "sf0.001")


@needs_data
@pytest.mark.parametrize("name,columns", [("p7_found", ["item_id", "doc_id"]), ("p8_found", ["doc_id", "subject"]), ("p1_splits", ["chp_id", "group_spk", "split"]), ("p2_sample", ["plan_id", "table_name", "category", "record_id"])])
def test_query_columns_and_keys(spark, name, columns):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    assert df.columns == columns
    rows = df.collect()
    assert len(set(map(tuple, rows))) == len(rows)
