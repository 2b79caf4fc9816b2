"""Node cuts of many records: the graph has a vertex for each class of copies, the records stay in tables."""

import random

import pytest

from splitloom.config import ConstraintSpec, SplitConfig
from splitloom.operators import kernel as kn
from splitloom.operators import splitters as sp
from splitloom.operators.dataset import SplitDataset


def test_more_records_than_a_task_holds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"{i:04d}", [f"b{i % 7}"], [f"s{i % 7 // 2 if i % 3 else i % 7}"], [rng.uniform(1, 9)], [1.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, b array<string>, s array<string>, y array<double>, weights array<double>")
    ds = SplitDataset(df, ("b", "s", "y"), ("b", "s"), ("y",))
    conf = SplitConfig((1, 2), (3,), (ConstraintSpec("mean"),), (1.0,), splitter="min_node_cut", seed=3, max_iter=70)
    monkeypatch.setattr(kn, "MAX_POSTINGS", 100)
    got = sp.split(ds, conf)
    side = {r["id"]: r["side"] for r in got.assignment.collect()}
    value = {r[0]: r for r in rows}
    ends = [[value[i] for i in side if side[i] == k] for k in (0, 1)]
    assert all(ends) and len(side) < len(rows)
    for f in (1, 2):
        assert not {r[f][0] for r in ends[0]} & {r[f][0] for r in ends[1]}
    mean = [sum(r[3][0] for r in e) / len(e) for e in ends]
    history = {r["iter"]: r["total"] for r in got.history.collect()}
    assert sorted(history) == list(range(71)) and abs(min(history.values()) - got.total) < 1e-12 and abs(abs(mean[0] - mean[1]) - got.total) < 1e-9
    monkeypatch.setattr(kn, "MAX_POSTINGS", 5)
    with pytest.raises(ValueError, match="a graph of more than 5 edges"):
        sp.split(ds, conf)
