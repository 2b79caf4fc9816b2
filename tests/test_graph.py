import itertools
import random

import pytest
from pyspark.sql import functions as F

from splitloom.operators import graph as gr
from splitloom.operators.components import components
from splitloom.operators.dataset import SplitDataset
from splitloom.operators.edges import classes, cosine_edges, gaussian_edges, levenshtein_edges, point_to_set, record_links, shared_value_edges, class_representatives
from splitloom.workspace import join_per_key, shared_dir
from tests.conftest import union_find


def records(spark, rows, *fields):
    return spark.createDataFrame([(i, *v, [1.0]) for i, *v in rows], f"id string, {', '.join(f'{f} array<string>' for f in fields)}, weights array<double>")


@pytest.mark.parametrize("local", [0, 150, 10**6])
def test_components_equal_union_find(spark, local):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(9, 9), (77777, 77777)]
    df = spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:40]], (None, 3), (3, None)], "src long, dst long")
    assert {r["id"]: r["component"] for r in components(df, local_edges=local).collect()} == union_find(edges)


def test_local_components_of_texts_and_chains(spark):
    names = [f"é{i:04d}" for i in range(3000)]
    random.Random(3).shuffle(names)
    edges = list(zip(names, names[1:])) + [("x", "x")]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {**dict.fromkeys(names, min(names)), "x": "x"}


def test_components_of_nothing_and_of_loops(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert components(empty).count() == 0
    assert [tuple(r) for r in components(spark.createDataFrame([(4, 4)], "src long, dst long")).collect()] == [(4, 4)]


def test_join_per_key_with_a_hot_key(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    for how in ("inner", "left"):
        want = rows.join(right, "k", how).select("k", "id", "x").exceptAll(join_per_key(rows, right, "k", how=how).select("k", "id", "x"))
        assert want.count() == 0 and rows.join(right, "k", how).count() == join_per_key(rows, right, "k", how=how).count()


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_links_and_classes(spark):
    rows = [("a", ["x"]), ("b", ["x", "y", "x"]), ("c", ["y", "x"]), ("d", ["z", None]), ("e", []), ("f", None), ("g", ["z"])]
    ds = SplitDataset(records(spark, rows, "v"), ("v",), ("v",))
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in record_links(ds).collect()}
    assert got == {"a": ("a", 2), "b": ("b", 2), "c": ("b", 2), "d": ("d", 1), "g": ("d", 1), "e": ("e", 0), "f": ("e", 0)}
    assert {r["id"]: r["class_size"] for r in classes(ds).collect()}["b"] == 2
    with pytest.raises(ValueError):
        shared_value_edges(class_representatives(ds), ("v",), max_holders=1)


def test_links_with_hot_values_and_without_pairs(spark):
    rng = random.Random(8)
    rows = [(f"{i:03d}", [rng.choice("aaab"), rng.choice("cdefgh")][: rng.randrange(3)], [str(rng.randrange(4))] if rng.random() < 0.9 else None) for i in range(200)]
    ds = SplitDataset(records(spark, rows, "f", "g"), ("f", "g"), ("f", "g"))
    tags = {i: {("f", x) for x in f or []} | {("g", x) for x in g or []} for i, f, g in rows}
    want = {i: sum(1 for j in tags if j != i and tags[i] & tags[j]) for i in tags}
    assert {r["id"]: r["n_links"] for r in record_links(ds).collect()} == want
    assert {r["id"]: r["n_links"] for r in record_links(ds, max_values=1).collect()} == want


def test_links_of_wide_classes_among_hot_values(spark):
    # 2,500 classes hold one value, and some have more values than inclusion and exclusion takes
    rows = [(str(i), ["hot", str(i)] if i % 2 else [str(i)]) for i in range(5000)] + [(f"w{k}", ["hot"] * (k != 2) + [str(x) for x in range(100 * k, 100 * k + 20)]) for k in (0, 0, 1, 2)] + [("none", [])]
    rows = [(f"{i}-{n}" if i == "w0" else i, v) for n, (i, v) in enumerate(rows)]
    ds = SplitDataset(spark.createDataFrame([(*r, [1.0]) for r in rows], "id string, f array<string>, weights array<double>"), ("f",), ("f",))
    got = {r["id"]: r["n_links"] for r in record_links(ds).collect()}
    holders = {}
    for i, v in rows:
        for x in v:
            holders.setdefault(x, set()).add(i)
    assert got == {i: len(set().union(*[holders[x] for x in v]) - {i}) for i, v in rows}


def test_completeness(spark):
    ds = SplitDataset(records(spark, [("a", ["x"]), ("b", ["x", "y"]), ("c", ["y", "x"])], "v"), ("v",), ("v",))
    assert tuple(gr.is_complete(ds).first()) == (3, 3, True)
    ds = SplitDataset(records(spark, [("a", ["x"]), ("b", ["x", "y"]), ("c", ["y"])], "v"), ("v",), ("v",))
    assert tuple(gr.is_complete(ds).first()) == (3, 2, False)


def test_rollup(spark):
    rows = [("a", ["x"], ["0"]), ("b", ["x", "y"], ["1"]), ("c", ["z"], ["1"]), ("d", None, ["2"])]
    ds = SplitDataset(records(spark, rows, "v", "g"), ("v", "g"), ("v",), ("g",))
    rolled, members = gr.from_components(ds)
    assert {(r["component"], r["id"]) for r in members.collect()} == {("0", "a"), ("0", "b"), ("1", "c"), ("2", "d")}
    first = rolled.records.where("id = '0'").first()
    assert first["g"] == [["0"], ["1"]] and first["weights"] == [1.0, 1.0] and rolled.factors == ("component",)
    assert sorted(r["value"] for r in rolled.constraint_rows(0).collect()) == ["0", "1", "1", "2"]
    one, _ = gr.from_components(SplitDataset(records(spark, [("a", ["x"]), ("b", ["x"])], "v"), ("v",), ("v",)))
    assert one.factors == ("v",)


def test_gaussian_edges_equal_brute_force(spark):
    import math

    rng = random.Random(2)
    pts = [(f"{i:03d}", rng.choice([rng.uniform(-5, 5), 1.0, -2.0])) for i in range(120)] + [("n", None), ("q", float("nan"))]
    got = {(r["src"], r["dst"]): r["capacity"] for r in gaussian_edges(spark.createDataFrame(pts, "id string, x double"), 0.6).collect()}
    rep = {}
    for i, x in pts:
        if x is not None and x == x:
            rep[x] = min(i, rep.get(x, i))
    want = {tuple(sorted((a, b))) for (x, a), (y, b) in itertools.combinations(rep.items(), 2) if math.exp(-((x - y) ** 2)) > 0.6}
    assert set(got) == want


def test_cosine_edges_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v[5], v[6] = v[4] * 3, 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    got = {(r["src"], r["dst"]) for r in cosine_edges(df, 0.8).collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.8 and i != 6 and j != 6}


def test_levenshtein_edges_equal_brute_force(spark):
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(4)
    texts = list({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(120)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, texts[0]), (1000, None)], "id long, value string")
    got = {(r["src"], r["dst"]) for r in levenshtein_edges(df, 0.6).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 1 - dist(texts[i], texts[j]) / max(len(texts[i]), len(texts[j])) > 0.6 + 1e-12}
    assert got == want


def test_point_to_set(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "src string, dst string, capacity double")
    ids = spark.createDataFrame([("b",), ("d",), (None,)], "id string")
    assert point_to_set(e, "a", ids).first()["score"] == 1.0 and point_to_set(e, "d", ids).first()["score"] == 0.0


def test_minimum_node_cut_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(4, 8)
        e = [(str(i), str(j)) for i in range(n) for j in range(i) if rng.random() < 0.45]
        g = dict(gr.adjacency(e))
        for i in range(n):
            g.setdefault(str(i), set())
        pairs = [(s, t) for s, t in itertools.combinations(g, 2) if t not in g[s]]
        for s, t in pairs[:4]:
            cut = gr.minimum_node_cut(gr.defaultdict(set, g), s, t)

            def apart(c):
                return not any(s in p and t in p for p in gr.plain_components(g, set(c)))

            assert s not in cut and t not in cut and apart(cut)
            others = [x for x in g if x not in (s, t)]
            assert len(cut) == next(k for k in range(len(others) + 1) if any(apart(c) for c in itertools.combinations(others, k)))
