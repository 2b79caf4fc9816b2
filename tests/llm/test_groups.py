import random

import pytest

from splitloom.llm.match_groups import contract_components, match_groups
from splitloom.llm.related_splits import chapter_groups, hash_to_min, related_splits, rendezvous
from tests.conftest import union_find

SCHEMA = "chp_id string, spk_id array<string>, author_id array<string>"


def graphs():
    rng = random.Random(1)
    yield "random", [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    yield "path", [(i, i + 1) for i in rng.sample(range(150), 150)]
    yield "cycle", [(i, (i + 1) % 90) for i in range(90)]
    yield "star", [(500, i) for i in range(300)]
    yield "tree", [(i, (i - 1) // 2) for i in range(1, 200)]
    yield "wheel and tails", [(0, i) for i in range(1, 30)] + [(i, i % 29 + 1) for i in range(1, 30)] + [(100 + i, i) for i in range(30)] + [(200 + i, 100 + i) for i in range(30)]
    yield "theta", [(0, 1), (1, 2), (2, 9), (0, 3), (3, 4), (4, 9), (0, 5), (5, 9), (20, 21), (21, 20), (30, 30)]


@pytest.mark.parametrize("name,edges", list(graphs()))
def test_components_equal_union_find(spark, name, edges):
    df = spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:20]], (None, 1), (1, None)], "src long, dst long")
    want = union_find(edges)
    got = {r["id"]: r["component"] for r in hash_to_min(df).collect()}
    assert got == want
    got = {r["id"]: r["component"] for r in contract_components(df, local_edges=0 if name in ("random", "wheel and tails", "cycle") else 10**6).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert set(got) == linked
    groups = {}
    for v, c in got.items():
        groups.setdefault(c, set()).add(want[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want[v] for v in linked})


def test_no_edges(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert hash_to_min(empty).count() == 0 and contract_components(empty).count() == 0


def test_chapter_groups(spark):
    rows = [("1", ["5"], ["9"]), ("chp1", ["spk6"], None), (None, ["6", "7"], ["8"]), ("2", ["7"], []), ("3", None, ["8"]), ("4", None, None), ("0", ["1"], ["1"]), ("5", ["?"], ["-1"]), ("6", ["9"], ["99"]), ("6", ["9"], ["99"])]
    got = {r["chp_id"]: r["group_spk"] for r in chapter_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 5, 2: 5, 3: 5, 4: None, 5: None, 6: 9}
    assert chapter_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(2)
    rows = [(str(i), [str(1 if i < 300 else rng.randrange(2, 900))], [str(1000 + rng.randrange(900)) if i >= 300 else "1000"]) for i in range(1, 1500)]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = related_splits(spark.createDataFrame(rows, SCHEMA), shares).collect()
    assert len(out) == 1499
    seen = {}
    for r in out:
        assert seen.setdefault(r["group_id"], r["split"]) == r["split"]
    again = {r["chp_id"]: r["split"] for r in related_splits(spark.createDataFrame(rows[::-1], SCHEMA), shares).collect()}
    assert again == {r["chp_id"]: r["split"] for r in out}


def test_rendezvous_shares(spark):
    sizes = spark.createDataFrame([(i, 1) for i in range(20_000)] + [(10**6, 6000)], "group_id long, n long")
    out = rendezvous(sizes, {"train": 8, "validation": 1, "test": 1}).join(sizes, "group_id").groupBy("split").sum("n").collect()
    share = {r["split"]: r["sum(n)"] / 26_000 for r in out}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    with pytest.raises(ValueError):
        rendezvous(sizes, {"train": 1, "test": 0})


def test_chapters_of_many_rows_and_hot_speakers(spark):
    rng = random.Random(6)
    rows = []
    for i in range(4000):
        chp = "7" if i % 3 == 0 else str(rng.randrange(1, 2500))
        rows.append((chp if rng.random() < 0.95 else None, [str(rng.randrange(1, 900)) for _ in range(rng.randrange(3))], [str(1 if i % 2 else rng.randrange(1, 500))] if rng.random() < 0.6 else None))
    for tied in (rows[:150], rows):
        edges, chapters = [], set()
        for c, s, a in tied:
            names = [("s", int(x)) for x in s or []] + [("t", int(x)) for x in a or []] + ([("u", int(c))] if c else [])
            edges += [(names[0], n) for n in names]
            chapters |= {int(c)} if c else set()
        root = union_find(edges)
        want = {c: root["u", c][1] if root["u", c][0] == "s" else None for c in chapters}
        assert {r["chp_id"]: r["group_spk"] for r in chapter_groups(spark.createDataFrame(tied, SCHEMA)).collect()} == want


@pytest.mark.parametrize("buckets", [None, 3])
def test_match_groups(spark, buckets):
    rec = spark.createDataFrame([("a", ["1", "s2"]), ("B ", ["2"]), ("c", None), ("d", ["77"]), ("e", ["5", "5"]), ("e", ["+5"]), ("f", ["05"]), (None, ["5"]), ("", ["5"]), ("g", ["0"])], "id string, spks array<string>").selectExpr("*", "1 AS src", "2 AS dst", "3 AS v")
    m = spark.createDataFrame([("C", " x"), ("X", "c"), ("d", "d"), ("y", "Z "), (None, "a"), ("", "a")], "left_id string, right_id string")
    got = {r["id"]: r["group_id"] for r in match_groups(rec, m, buckets).collect()}
    assert got == {"A": "A", "B": "A", "C": "C", "X": "C", "E": "E", "F": "E", "Y": "Y", "Z": "Y"}
    none = spark.createDataFrame([], "id string, spks array<string>")
    assert match_groups(none, spark.createDataFrame([], "left_id string, right_id string")).count() == 0
