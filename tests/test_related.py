"""Graphs, components and candidates by other similarities than equal values, against brute force."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from splitloom.config import ConstraintSpec, SplitConfig
from splitloom.operators import candidates as cd
from splitloom.operators import graph as gr
from splitloom.operators import report
from splitloom.operators import splitters as sp
from splitloom.operators.dataset import Relation, SplitDataset
from splitloom.operators.edges import class_representatives, classes, cosine_best
from splitloom.operators.related import factor_edges, point_scores, related_edges, related_nodes
from tests.conftest import union_find

THRESH = {"gaussian": 0.6, "levenshtein": 0.6, "cosine": 0.9}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def one(name, f, g):
    """Similarity of two sets."""
    if not f or not g:
        return 0.0
    if name == "set_intersection":
        return float(len(set(f) & set(g)))
    if name == "boolean":
        return float(set(f) == set(g))
    if name == "gaussian":
        v = math.exp(-((sum(set(f)) / len(set(f)) - sum(set(g)) / len(set(g))) ** 2))
    elif name == "levenshtein":
        v = max(1 - edit(a, b) / max(len(a), len(b)) for a in f for b in g)
    else:
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))
        v = max(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for a in f for b in g)
    return v if v > THRESH[name] else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(9)
    rows = []
    for i in range(36):
        words = ["".join(rng.choice("ab") for _ in range(5)) for _ in range(rng.randrange(3))]
        vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(rng.randrange(3))]
        rows.append((f"{i:02d}", [rng.choice("pqrstuvw") for _ in range(rng.randrange(3))], [rng.randrange(40) * 0.5 for _ in range(rng.randrange(3))], words, vectors, [float(i)], [1.0]))
    rows += [("x1", *rows[3][1:]), ("x2", *rows[3][1:]), ("n", None, None, None, None, None, [1.0])]
    df = spark.createDataFrame(rows, "id string, s array<string>, g array<double>, l array<string>, c array<array<double>>, y array<double>, weights array<double>")
    return rows, df


MIXES = [(("set_intersection", "s", 1.0),), (("boolean", "s", 2.0),), (("gaussian", "g", 1.0),), (("levenshtein", "l", 0.5),), (("cosine", "c", 1.0),), (("set_intersection", "s", 2.0), ("gaussian", "g", 0.5), ("levenshtein", "l", 1.0))]


def of(df, mix):
    return SplitDataset(df, ("s", "g", "l", "c", "y"), tuple(f for _, f, _ in mix), ("y",), similar=tuple(Relation(n, THRESH.get(n, 0.0), w) for n, _, w in mix))


@pytest.mark.parametrize("mix", MIXES, ids=lambda m: "+".join(x[0] for x in m))
def test_edges_components_and_nodes(spark, data, mix):
    rows, df = data
    ds, at = of(df, mix), {"s": 1, "g": 2, "l": 3, "c": 4}
    value = {r[0]: r for r in rows}
    sim = {(a, b): sum(w * one(n, value[a][at[f]], value[b][at[f]]) for n, f, w in mix) for a in value for b in value if a < b}
    reps = class_representatives(ds)
    names = {r["class_id"] for r in reps.collect()}
    got = {(r["src"], r["dst"]): r["capacity"] for r in related_edges(ds, reps).collect()}
    want = {p: v for p, v in sim.items() if v > 0 and set(p) <= names}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert len(names) < len(rows) and {r["class_id"] for r in classes(ds).collect()} == names
    root = union_find([p for p, v in sim.items() if v > 0], value)
    assert {r["id"]: r["root"] for r in gr.record_components(ds, numbered=False).collect()} == root
    ranks = gr.component_summary(ds, ranked=True).orderBy("rank").collect()
    assert [r["n_records"] for r in ranks] == sorted((r["n_records"] for r in ranks), reverse=True) and [r["rank"] for r in ranks] == list(range(len(ranks)))
    n = gr.is_complete(ds).first()
    assert n["n_pairs"] == sum(v > 0 for v in sim.values()) and not n["is_complete"]
    assert {(r["src"], r["dst"]) for r in factor_edges(ds, 0, reps).collect()} == {p for p in sim if set(p) <= names and one(mix[0][0], value[p[0]][at[mix[0][1]]], value[p[1]][at[mix[0][1]]]) > 0}
    # a value's graph: its owners and the records similar to the value alone
    nodes = {(r["n"], r["id"]) for r in related_nodes(ds).select("n", "id").collect()}
    assert nodes == {(k, i) for k, (_, f, _) in enumerate(mix) for i in value if value[i][at[f]]}
    # no record of one side is related to one of the other by single values
    cands, members = sp.random_candidates(ds, 40, 3)
    sides = members.unpack().collect()
    assert len(sides) > 0
    for c in {r["cand_id"] for r in sides}:
        a, b = ([r["id"] for r in sides if r["cand_id"] == c and r["side"] == k] for k in (0, 1))
        for n, f, _ in mix:
            if n != "boolean":
                for i in a:
                    for j in b:
                        assert not any(one(n, [v], [w]) > 0 for v in value[i][at[f]] for w in value[j][at[f]] if n != "gaussian" or len(set(value[j][at[f]])) == 1)
    whole = report.overlap_test_sets(ds, members.only(0))
    assert whole.count() == len(rows) and report.overlap_stats(ds, whole).where("split_a IN (0, 1) AND split_b IN (0, 1) AND overlap > 0").count() == 0


def test_points_against_sets(spark, data):
    rows, df = data
    mix = MIXES[-1]
    ds, at, value = of(df, mix), {"s": 1, "g": 2, "l": 3}, {r[0]: r for r in rows}
    sets = {"odd": [r[0] for r in rows[1:36:2]], "few": ["00", "x1"], "self": ["05"]}
    points = ["00", "03", "05", "x2", "n"]
    table = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v], "set string, id string")
    got = {(r["id"], r["set"]): r["score"] for r in point_scores(ds, spark.createDataFrame([(p,) for p in points], "id string"), table).collect()}
    for p in points:
        for k, v in sets.items():
            want = max([sum(w * one(n, value[p][at[f]], value[i][at[f]]) for n, f, w in mix) for i in v if i != p], default=0.0)
            assert abs(got[p, k] - want) < 1e-9, (p, k)


def test_node_cut_and_clusters_with_similarities(spark):
    rows = [(f"{i:02d}", [float(i) * 0.5], [float(i)], [1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, g array<double>, y array<double>, weights array<double>")
    ds = SplitDataset(df, ("g", "y"), ("g",), ("y",), similar=(Relation("gaussian", 0.6),))
    conf = SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), max_iter=12, splitter="min_node_cut")
    cut = {r["id"]: r["side"] for r in sp.split(ds, conf).assignment.collect()}
    assert len(cut) == 11 and set(cut.values()) == {0, 1}
    clusters = {r["id"]: r["side"] for r in sp.split(ds, replace(conf, splitter="spectral_clustering")).assignment.collect()}
    assert len(clusters) == 12 and clusters["00"] != clusters["11"] and clusters["00"] == clusters["01"]
    vns = sp.split(ds, replace(conf, splitter="vns", max_iter=2, max_neighbors=20)).assignment.collect()
    side = {r["id"]: r["side"] for r in vns}
    assert all(not (f"{i + 1:02d}" in side and f"{i:02d}" in side and side[f"{i + 1:02d}"] != side[f"{i:02d}"]) for i in range(11))


def test_copies_weigh_in_a_node_cut(spark):
    # two ways from the left to the right: over one record, and over three copies
    rows = [("a", ["l"]), ("b", ["l", "u"]), ("c1", ["u", "v"]), ("c2", ["u", "v"]), ("c3", ["u", "v"]), ("d", ["v", "r"]), ("e", ["r"])]
    df = spark.createDataFrame([(i, f, [1.0], [1.0]) for i, f in rows], "id string, f array<string>, y array<double>, weights array<double>")
    _, sizes, hubs = gr.class_graph(SplitDataset(df, ("f", "y"), ("f",), ("y",)))
    graph = gr.adjacency([(r["class_id"], r["hub"]) for r in hubs.collect()])
    weight = {r["class_id"]: r["class_size"] for r in sizes.collect()} | {h: math.inf for h in graph if h.startswith(gr.HUB)}
    assert gr.minimum_node_cut(graph, "a", "e", weight) in ({"b"}, {"d"}) and gr.minimum_node_cut(graph, "b", "d", weight) == {"c1"}


def test_cosine_best(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)] + [(100, [0.0] * 4, 1), (101, None, 1), (102, [1.0] * 4, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    for block in (4096, 2):
        got = {(r["query_id"], r["label"]): r["cosine"] for r in cosine_best(df.where("id IN (0, 7, 100, 102)"), df, "label", block).collect()}
        want = {}
        for q in (0, 7, 102):
            for i, v, k in rows[:60]:
                if i != q:
                    w = next(r[1] for r in rows if r[0] == q)
                    c = sum(x * y for x, y in zip(w, v)) / math.sqrt(sum(x * x for x in w) * sum(x * x for x in v))
                    want[q, k] = max(want.get((q, k), -2), c)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_row_way_equals_the_table_way(spark):
    rng = random.Random(4)
    rows = [(str(i), [str(rng.randrange(6)) for _ in range(rng.randrange(3))], [str(rng.randrange(9))] if i % 7 else None, [1.0]) for i in range(80)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, g array<string>, weights array<double>"), ("f", "g"), ("f", "g"))
    masks = cd.random_masks(ds.postings().select("n", "value").distinct(), 130, 5)
    table = cd.PackedSides(cd.packed_sides(ds.postings(), masks, 2), 130)
    row = cd.RandomSides(ds, 130, 5)
    assert sorted(map(tuple, row.unpack().collect())) == sorted(map(tuple, table.unpack().collect()))
    assert sorted(map(tuple, row.only(77).collect())) == sorted(map(tuple, table.only(77).collect())) == sorted((r["id"], r["side"]) for r in row.unpack().where(F.col("cand_id") == 77).collect())
