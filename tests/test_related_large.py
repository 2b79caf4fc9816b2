"""Edges and points where thousands of records hold one value."""

import random

import duckdb
import pytest

from splitloom.operators import related
from splitloom.operators.dataset import Relation, SplitDataset
from splitloom.operators.related import point_scores, related_edges
from splitloom.plans import splits


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """2,100 suppliers of one nation, with copies, and some others."""
    rng, d = random.Random(1), tmp_path_factory.mktemp("suppliers")
    rows = [(i, 0 if i < 2100 else rng.choice([1, 2, None]), rng.choice([5.0, None]) if i % 40 == 0 else round(rng.uniform(-900, 900), 2)) for i in range(2200)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{d}/supplier.parquet/*.parquet'")
    return str(d), con


def test_edges_of_a_value_of_many_records_equal_sql(spark, suppliers):
    d, con = suppliers
    got = splits.edges_mixed(spark, d).selectExpr("count(*)", "count(DISTINCT src, dst)", "sum(capacity)").first()
    want = con.execute(f"SELECT count(*), sum(capacity) FROM ({splits.SQL['edges_mixed']})").fetchall()[0]
    assert got[0] == got[1] == want[0] > 2_200_000 and abs(got[2] - want[1]) < 1e-3


def test_points_beside_a_value_of_many_records_equal_sql(spark, suppliers):
    d, con = suppliers
    got = {(r["id"], r["set"]): r["score"] for r in splits.point_scores_mixed(spark, d).collect()}
    want = {(r[0], r[1]): r[2] for r in con.execute(f"SELECT id, set, score FROM ({splits.SQL['point_scores_mixed']})").fetchall()}
    assert len(want) == 88 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_pairs_by_row_and_by_value_are_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"{i:03d}", [rng.choice("pqrs") for _ in range(rng.randrange(4))], [rng.randrange(30) * 0.4 for _ in range(rng.randrange(3))], [rng.choice("xy") for _ in range(rng.randrange(3))]) for i in range(150)]
    df = spark.createDataFrame([*rows, ("n", None, None, None), ("far", [], [1e15, 1e16], ["x"]), ("nan", [], [float("nan")], None)], "id string, s array<string>, g array<double>, b array<string>").selectExpr("*", "array(1.0D) AS weights")
    ds = SplitDataset(df, ("s", "g", "b"), ("s", "g", "b"), similar=(Relation("set_intersection", 0.0, 2.0), Relation("gaussian", 0.6, 0.5), Relation("boolean", 0.0, 0.25)))
    sets = df.selectExpr("CASE WHEN id < '075' THEN 'low' ELSE 'high' END AS set", "id")

    def both():
        edges = {(r["src"], r["dst"]): round(r["capacity"], 9) for r in related_edges(ds, df.selectExpr("id AS class_id")).collect()}
        return edges, {(r["id"], r["set"]): round(r["score"], 9) for r in point_scores(ds, df.where("id LIKE '%5' OR id > 'a'"), sets).collect()}

    want = both()
    assert len(want[0]) > 4000
    monkeypatch.setattr(related, "HOLDERS", 7)
    assert both() == want
    monkeypatch.setattr(related, "WIDE", -1)
    assert both() == want
