import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitloom.config import ConstraintSpec, SplitConfig, parse_config
from splitloom.functions.similarity import REGISTRY, register, similarity
from splitloom.operators import candidates as cd
from splitloom.operators import constraints as cn
from splitloom.operators import kernel as kn
from splitloom.operators import report
from splitloom.operators import splitters as sp
from splitloom.operators.dataset import SplitDataset, dense_index
from splitloom.operators.graph import record_components
from splitloom.sources import tables

TYPES = ["str", "str", "float", "float", "float"]


def conf(**kw):
    base = {"factor_types": TYPES, "factor_idxs": [1, 2], "constraint_idxs": [3, 4, 5], "constraints": [{"name": "mean_tuple", "values": [0.5, 0.5], "reduction": "mean"}, {"name": "mean", "reduction": "mean"}, {"name": "sum_tuple", "values": {"values": [0.8, 0.2], "power": 1.0}, "reduction": "sum"}], "constraint_weights": [0.1, 0.1, 10]}
    return parse_config(base | kw)


@pytest.fixture(scope="module")
def dummy(spark, dummy_tsv):
    return tables.read_tsv(spark, dummy_tsv, conf())


@pytest.fixture(scope="module")
def kl_data(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("kl") / "kl.tsv"
    p.write_text("id\tspeaker\tprompt \na\ts1\t0\nb\ts2\t0\nc\ts2\t1\nd\ts3\t1\ne\ts3\t2\nf\ts1,s4\t2\ng\ts4\t2\n")
    c = parse_config({"factor_types": ["str", "int"], "factor_idxs": [1], "constraint_idxs": [2], "constraints": ["kl"], "kl_smooth": 0.1, "kl_direction": "symmetric"})
    return tables.read_tsv(spark, str(p), c), c


def members(spark, *splits):
    rows = [(k, i, s) for k, sides in enumerate(splits) for s, ids in enumerate(sides) for i in ids]
    return spark.createDataFrame(rows, "cand_id long, id string, side int"), spark.range(len(splits)).toDF("cand_id")


def test_tsv(dummy):
    rows = {r["id"]: r for r in dummy.records.collect()}
    assert rows["g"]["speaker"] == ["s5", "s6"] and rows["a"]["weights"] == [0.0176787] and rows["c"]["duration"] == [4.0]
    assert dummy.factors == ("speaker", "prompt") and len(dummy) == 7


def test_pair_similarity_goldens(spark, dummy):
    rows = {r["id"]: r for r in dummy.records.collect()}
    want = {"ab": 1, "ac": 0, "ad": 0, "bc": 1, "bd": 0, "df": 1, "dg": 1, "fg": 2}
    fn = similarity("set_intersection")
    for (a, b), s in want.items():
        df = spark.createDataFrame([(rows[a][f], rows[b][f]) for f in dummy.factors], "f array<string>, g array<string>")
        for x, y in (("f", "g"), ("g", "f")):
            assert df.agg(F.sum(fn(F.col(x), F.col(y)))).first()[0] == s


def test_similarities(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(similarity("cosine")(F.array("a"), F.array("b"), 0.5)).first()[0] == 0.0
    assert df.select(similarity("cosine")(F.array("a", "b"), F.array("a"), 0.5)).first()[0] == 1.0
    assert df.select(similarity("gaussian")(F.col("a"), F.col("b"), 0.1)).first()[0] == pytest.approx(np.exp(-0.25))
    with pytest.raises(ValueError):
        register("cosine")(lambda f, g: f)
    assert "levenshtein" in REGISTRY


def test_constraint_goldens(spark, dummy):
    ds = SplitDataset(dummy.records, dummy.fields, dummy.factors, ("gender", "duration"))
    m, c = members(spark, "ab", "ac", ("a", "bc"), ("ab", "cde"), ("ab", "cd"), ("abc", ""))
    got = {r["cand_id"]: r for r in cn.constraint_scores(ds, (ConstraintSpec("mean_tuple", [0.5, 0.5]), ConstraintSpec("mean")), m, c).collect()}
    assert [got[i]["score0"] for i in range(4)] == [1, 1, 0.5, 1]
    assert got[4]["score1"] == pytest.approx(5.75)
    assert got[5]["total"] == cn.WORST_SCORE and got[5]["score0"] is None


def test_kl_goldens(spark, kl_data):
    ds, c = kl_data
    m, cands = members(spark, "ab", ("ace", "bdf"), ("abc", "def"))
    got = {r["cand_id"]: r["score0"] for r in cn.constraint_scores(ds, c.specs, m, cands).collect()}
    assert got[0] == pytest.approx(0, abs=1e-12) and got[1] == pytest.approx(0, abs=1e-12) and got[2] == pytest.approx(1.8451651137717715)


def test_kl_is_symmetric_and_not_negative(spark, kl_data):
    ds, c = kl_data
    rng = random.Random(1)
    splits = []
    for _ in range(20):
        ids = rng.sample("abcdefg", 6)
        splits += [("".join(ids[:3]), "".join(ids[3:])), ("".join(ids[3:]), "".join(ids[:3]))]
    m, cands = members(spark, *splits)
    got = {r["cand_id"]: r["score0"] for r in cn.constraint_scores(ds, c.specs, m, cands).collect()}
    for i in range(0, 40, 2):
        assert got[i] >= -1e-12 and got[i] == pytest.approx(got[i + 1])


def test_exhaustive_goldens(dummy, kl_data):
    ds, c = kl_data
    best, where = kn.exhaustive_search(kn.load_kernel(ds, c.specs, c.constraint_weights))
    assert best == pytest.approx(0, abs=1e-12) and sorted(where) == ["0101", "1010"]
    k = kn.load_kernel(dummy, conf().specs, conf().constraint_weights)
    best, where = kn.exhaustive_search(k)
    assert best == pytest.approx(2.4241) and where == ["011111|1011"]
    bits = [np.array([c == "1" for c in part]) for part in where[0].split("|")]
    side = k.sides(bits)
    assert [k.ids[i] for i in np.nonzero(side == 0)[0]] == list("defg") and [k.ids[i] for i in np.nonzero(side == 1)[0]] == ["b"]


def test_kernel_scores_equal_dataframe_scores(spark, dummy):
    specs = (ConstraintSpec("mean"), ConstraintSpec("sum_tuple", {"values": [0.8, 0.2], "power": 2.0}, "sum"), ConstraintSpec("max_entropy", [0.3, 0.7], "concat"), ConstraintSpec("kl", {"smooth": 0.2, "direction": "reverse"}, "concat"))
    for weighting in ("none", "weighted"):
        ds = SplitDataset(dummy.records, dummy.fields, dummy.factors, ("duration", "fraction", "gender", "prompt"), weighting)
        k = kn.load_kernel(ds, specs, (1.0, 2.0, 3.0, 4.0))
        rng = np.random.default_rng(2)
        sides = [rng.integers(-1, 2, 7) for _ in range(12)]
        rows = [(c, k.ids[i], int(s)) for c, x in enumerate(sides) for i, s in enumerate(x) if s >= 0]
        got = {r["cand_id"]: r for r in cn.constraint_scores(ds, specs, spark.createDataFrame(rows, "cand_id long, id string, side int"), spark.range(12).toDF("cand_id"), (1.0, 2.0, 3.0, 4.0)).collect()}
        for c, x in enumerate(sides):
            assert got[c]["total"] == pytest.approx(k.score(x)[0])


def test_packed_equals_plain_and_literal_sets(spark):
    rng = random.Random(3)
    rows = [(str(i), [str(rng.randrange(12)) for _ in range(rng.randrange(0, 4))], [rng.choice("xyz")], [1.0]) for i in range(150)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, g array<string>, weights array<double>"), ("f", "g"), ("f", "g"))
    posts = ds.postings()
    masks = cd.random_masks(posts.select("n", "value").distinct(), 70, 5)
    packed = {tuple(r) for r in cd.unpack_members(cd.packed_sides(posts, masks, 2), 70).collect()}
    bits = cd.mask_bits(masks, 70)
    assert packed == {tuple(r) for r in cd.plain_members(posts, bits, 2).collect()}
    chosen = {(r["cand_id"], r["n"], r["value"]): r["bit"] for r in bits.collect()}
    want = set()
    for c in range(70):
        for i, f, g, _ in rows:
            picks = [[chosen[c, n, v] for v in set(vs)] for n, vs in ((0, f), (1, g))]
            if all(picks) and all(all(p) for p in picks):
                want.add((c, i, 0))
            if all(picks) and not any(any(p) for p in picks):
                want.add((c, i, 1))
    assert packed == want
    constant = {r["cand_id"] for r in cd.constant_candidates(masks, 70).collect()}
    by = lambda c, n: {b for (k, m, _), b in chosen.items() if k == c and m == n}
    assert constant == {c for c in range(70) if len(by(c, 0)) == 1 or len(by(c, 1)) == 1}


def test_neighbours(spark):
    s = spark.createDataFrame([(0, 0, "011"), (1, 0, "01"), (2, 0, "0001")], "cand_id long, n int, bits string")
    got = {}
    for r in cd.neighbours(s).collect():
        got.setdefault(r["cand_id"], set()).add(r["neighbour"])
    assert got == {0: {"001", "010"}, 1: {"10"}, 2: {"1001", "0101", "0011"}}
    two = cd.neighbourhood(spark.createDataFrame([("00011",)], "bits string"), 2, 1000)
    assert {r["bits"] for r in two.collect()} == {"".join(x) for x in itertools.product("01", repeat=5) if sum(a != b for a, b in zip(x, "00011")) == 2 and len(set(x)) == 2}
    assert cd.neighbourhood(spark.createDataFrame([("00011",)], "bits string"), 2, 3).count() == 3


def test_index_bits_of_many_values(spark):
    values = spark.range(100).select(F.lit(0).alias("n"), F.format_string("%03d", "id").alias("value"), F.col("id").alias("pos"))
    bits = cd.index_bits(values, 0, 0, 2**99 + 1)
    assert {r["value"] for r in bits.where("bit").collect()} == {"000", "099"}
    assert cd.bit_strings(bits, values).first()["bits"] == "1" + "0" * 98 + "1"
    with pytest.raises(ValueError):
        cd.index_bits(values, 0, 0, 0)


def check_partition(ds, result):
    part = report.overlap_test_sets(ds, result.assignment)
    rows = part.collect()
    ids = [r["id"] for r in ds.records.select("id").collect()]
    assert sorted(r["id"] for r in rows) == sorted(ids)
    posts = ds.postings().join(part, "id").where("split < 2")
    shared = posts.groupBy("n", "value").agg(F.count_distinct("split").alias("k")).where("k > 1")
    assert shared.count() == 0
    return part


@pytest.mark.parametrize("name", ["random", "VNS"])
def test_splitters_on_dummy(dummy, name):
    c = conf(splitter=name, max_iter=120 if name == "random" else 10, max_neighbors=50, num_shake_neighborhoods=3, num_search_neighborhoods=3)
    result = sp.split(dummy, c)
    part = check_partition(dummy, result)
    history = sorted(result.history.collect(), key=lambda r: r["iter"])
    assert min(r["total"] for r in history) == pytest.approx(result.total)
    if name == "VNS":
        totals = [r["total"] for r in history]
        assert totals == sorted(totals, reverse=True)
        assert result.total == pytest.approx(2.4241)
    stats = report.split_stats(dummy, c.specs, part)
    assert stats.agg(F.sum("length")).first()[0] == 7
    o = {(r["split_a"], r["split_b"], r["field"]): r["overlap"] for r in report.overlap_stats(dummy, part).collect()}
    assert o[0, 1, "speaker"] == 0 and o[1, 0, "prompt"] == 0


def test_random_search_is_repeatable_and_refuses_one_value(spark, dummy):
    a, b = (sorted(map(tuple, sp.split(dummy, conf(max_iter=60)).assignment.collect())) for _ in range(2))
    assert a == b
    one = SplitDataset(dummy.records.withColumn("speaker", F.array(F.lit("s"))), dummy.fields, dummy.factors, dummy.constraints)
    with pytest.raises(ValueError):
        sp.split(one, conf(max_iter=60))


def test_vns_large_finds_as_good_a_split(spark):
    rows = [(str(i), [str(i // 3)], [float(i % 7)], [1.0]) for i in range(60)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, x array<double>, weights array<double>"), ("f", "x"), ("f",), ("x",))
    c = SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), max_iter=3, num_shake_neighborhoods=2)
    r = sp.vns_large(ds, c)
    totals = [h["total"] for h in sorted(r.history.collect(), key=lambda h: h["iter"])]
    assert totals == sorted(totals, reverse=True) and totals[-1] <= totals[0]
    check_partition(ds, r)


def test_vns_large_searches_neighbourhoods_of_the_shaken_point(spark, monkeypatch):
    rows = [(f"{i:02d}", [f"{i // 2:02d}"], ["u" if i % 3 else "v"], [float(i * i)], [1.0]) for i in range(24)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, g array<string>, x array<double>, weights array<double>"), ("f", "g", "x"), ("f",), ("x",))
    c = SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="vns", seed=2, max_iter=1, num_shake_neighborhoods=1, num_search_neighborhoods=2, max_neighbors=130)
    jobs = []
    packed = cd.packed_sides
    monkeypatch.setattr(cd, "packed_sides", lambda p, masks, n: jobs.append(masks.groupBy("block").count().count()) or packed(p, masks, n))
    r = sp.vns_large(ds, c)
    history = sorted(r.history.collect(), key=lambda h: h["iter"])
    assert max(jobs) >= 1 and len(jobs) >= 4  # the start, the shaken point, its neighbours, the result
    k = kn.load_kernel(ds, c.specs, c.constraint_weights)
    for h in history:  # the bits are those of the incumbent
        assert set(h["bits"]) == {"0", "1"}
        assert k.score(k.sides([np.array([b == "1" for b in h["bits"]])]))[0] == pytest.approx(h["total"])
    check_partition(ds, r)
    assert history[-1]["total"] <= history[0]["total"]


def test_vns_beyond_one_task_checks_completeness(spark, monkeypatch):
    rows = [(str(i), ["same", str(i)], [float(i)], [1.0]) for i in range(5)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, x array<double>, weights array<double>"), ("f", "x"), ("f",), ("x",))
    monkeypatch.setattr(kn, "MAX_POSTINGS", 3)
    with pytest.raises(ValueError, match="nothing can be held out"):
        sp.split(ds, SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="vns", max_iter=0))


def test_sampled_flips():
    rng, bits = np.random.default_rng(1), [np.array([True, False, False, False, True]), np.array([True, False])]
    for depth, most in ((1, 100), (1, 3), (2, 130), (3, 7)):
        out = kn.sampled_flips(bits, depth, most, rng)
        assert 0 < len(out) <= most and len({frozenset(o) for o in out}) == len(out) and {len(o) for o in out} == {depth}
        for o in out:
            x = bits
            for at in o:
                x = kn.flipped(x, at)
            assert all(b.any() and not b.all() for b in x)
    assert len(kn.sampled_flips(bits, 1, 100, rng)) == 6


def test_multi_seed_and_best_runs(dummy):
    runs = sp.multi_seed(dummy, conf(max_iter=2, max_neighbors=10, num_shake_neighborhoods=1, num_search_neighborhoods=1), 2).select("run", "iter", "total")
    assert {r["run"] for r in runs.collect()} == {0, 1, 2}
    assert report.best_runs(runs, 1).count() == 1
    h = report.best_so_far(runs).collect()
    assert all(r["best"] <= r["total"] for r in h)


def chain(spark, n=9):
    rows = [(f"{i:02d}", [str(i), str(i + 1)], [float(i)], [1.0]) for i in range(n)]
    return SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, x array<double>, weights array<double>"), ("f", "x"), ("f",), ("x",))


def test_min_node_cut(spark):
    ds = chain(spark)
    c = SplitConfig((1,), (2,), (ConstraintSpec("sum_tuple", {"values": [10.0, 26.0], "power": 1.0}, "sum"),), (1.0,), splitter="min_node_cut", max_iter=30)
    r = sp.split(ds, c)
    check_partition(ds, r)
    sides = {x["id"]: x["side"] for x in r.assignment.collect()}
    assert len(sides) == 8  # a chain falls apart when one vertex goes
    two = SplitDataset(ds.records.where("id <> '04'"), ds.fields, ds.factors, ds.constraints)
    with pytest.raises(ValueError):
        sp.split(two, c)
    same = SplitDataset(ds.records.withColumn("f", F.array(F.lit("1"))), ds.fields, ds.factors, ds.constraints)
    with pytest.raises(ValueError):
        sp.split(same, c)


def test_spectral_finds_the_two_groups(spark):
    rows = [(f"{i:02d}", ["l" if i < 6 else "r", *(["bridge"] if i in (0, 6) else [])], [float(i)], [1.0]) for i in range(10)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, x array<double>, weights array<double>"), ("f", "x"), ("f",), ("x",))
    r = sp.split(ds, SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="spectral_clustering"))
    sides = {x["id"]: x["side"] for x in r.assignment.collect()}
    assert {sides[f"{i:02d}"] for i in range(6)} == {0} and {sides[f"{i:02d}"] for i in range(6, 10)} == {1}


def labelled(ds, way):
    """Smallest id of the cluster of every record, by the dense or the large way."""
    from splitloom.workspace import Workspace

    ws = Workspace(ds.records.sparkSession, "t")
    reps = sp.class_representatives(ds)
    label = way(ws, *(ws.write(x) for x in sp.class_postings(ds, reps)), SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="spectral_clustering", num_splits=3))
    rows = sp.classes(ds).join(label, "class_id").select("id", "cluster").collect()
    first = {c: min(r["id"] for r in rows if r["cluster"] == c) for c in {r["cluster"] for r in rows}}
    return {r["id"]: first[r["cluster"]] for r in rows}


def test_spectral_is_the_same_folded_and_large(spark):
    # three groups of records with copies, a few bridges
    groups = [[f"{g}{i % 4}", f"{g}{(i + 1) % 4}"] for g, n in (("a", 16), ("b", 12), ("c", 8)) for i in range(n)]
    rows = [(f"{i:02d}", [*v, *(["bridge"] if i in (0, 16, 28) else [])], [float(i)], [1.0]) for i, v in enumerate(groups)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, x array<double>, weights array<double>"), ("f", "x"), ("f",), ("x",))
    w = np.array([[1e-4 + len(set(p[1]) & set(q[1])) if p is not q else 0.0 for q in rows] for p in rows])
    plain = kn.spectral_labels(w, 3)
    want = {r[0]: min(q[0] for q, c in zip(rows, plain) if c == plain[i]) for i, r in enumerate(rows)}
    assert len(set(want.values())) == 3
    assert labelled(ds, sp._spectral_dense) == want
    assert labelled(ds, sp._spectral_large) == want


def test_spectral_beyond_4000_records_keeps_edgeless_classes(spark, monkeypatch):
    rows = spark.range(4500).select(F.format_string("%05d", "id").alias("id"), F.when(F.col("id") % 9 < 8, F.array((F.col("id") % 9 % 5).cast("string"))).otherwise(F.array().cast("array<string>")).alias("f"), F.array(F.col("id").cast("double")).alias("x"), F.array(F.lit(1.0)).alias("weights"))
    ds = SplitDataset(rows, ("f", "x"), ("f",), ("x",))
    c = SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="spectral_clustering")
    large = sp._spectral_large
    monkeypatch.setattr(sp, "_spectral_large", lambda *a: large(*a, rounds=3))  # all six eigenvalues are nearly 1
    for most in (4000, 2):  # dense and large
        monkeypatch.setattr(sp, "MAX_CLASSES", most)
        got = {r["id"]: r["side"] for r in sp.split(ds, c).assignment.collect()}
        assert len(got) == 4500 and set(got.values()) == {0, 1}
        kept = {(-1 if int(i) % 9 == 8 else int(i) % 9 % 5, s) for i, s in got.items()}
        assert len(kept) == 6  # classes stay whole


def test_disconnected(spark):
    rows = [(str(i), [str(i // 4)], [float(i)], [1.0]) for i in range(40)]
    ds = SplitDataset(spark.createDataFrame(rows, "id string, f array<string>, x array<double>, weights array<double>"), ("f", "x"), ("f",), ("x",))
    r = sp.split(ds, SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="disconnected", max_iter=59))
    assert r.assignment.count() == 40
    check_partition(ds, r)
    assert {x["root"] for x in record_components(ds).collect()} == {min(str(i) for i in range(4 * k, 4 * k + 4)) for k in range(10)}
    with pytest.raises(ValueError):
        sp.split(chain(spark), SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="disconnected"))


def test_overlap_classes(spark):
    rows = [("a", ["1"], ["x"]), ("b", ["2"], ["y"]), ("c", ["1", "2"], ["y"]), ("d", ["2"], ["x", "y"]), ("e", ["1", "2"], ["x", "y"]), ("f", ["3", "2"], ["y", "z"]), ("g", None, [])]
    ds = SplitDataset(spark.createDataFrame([(*r, [1.0]) for r in rows], "id string, f array<string>, g array<string>, weights array<double>"), ("f", "g"), ("f", "g"))
    part = report.overlap_test_sets(ds, spark.createDataFrame([("a", 0), ("b", 1)], "id string, side int"))
    assert {r["id"]: r["split"] for r in part.collect()} == {"a": 0, "b": 1, "c": 3, "d": 4, "e": 2, "f": 5, "g": 5}


def test_dense_index_slices_and_subsets(spark, dummy):
    idx = {r["id"]: r["index"] for r in dummy.indexed().collect()}
    assert idx == {c: i for i, c in enumerate("abcdefg")}
    assert [r["id"] for r in dummy.slice(1, 6, 2).records.orderBy("id").collect()] == ["b", "d", "f"]
    assert dummy.record(6).first()["id"] == "g" and dummy.record(7).count() == 0
    assert dense_index(spark.range(0), ["id"]).count() == 0
    sub = dummy.subset(spark.createDataFrame([("a",), ("b",), ("zz",)], "id string"), renormalise=True)
    assert sub.records.agg(F.sum(F.col("weights")[0])).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        dummy.slice(-1)


def test_partition_files_and_restriction(spark, dummy, tmp_path):
    part = spark.createDataFrame([("a", 0), ("b", 0), ("c d", 1)], "id string, split int")
    tables.write_partition(part, str(tmp_path / "p"))
    back = tables.read_partition(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == [("a", 0), ("b", 0), ("c d", 1)]
    assert len(tables.restrict(dummy, back, 0)) == 2
    with pytest.raises(ValueError):
        tables.restrict(dummy, back, 1)


def test_supervisions_and_manifests(spark, tmp_path):
    import gzip

    one = [{"id": "1", "recording_id": "r1", "speaker": "s1", "duration": 2.0}, {"id": "1", "recording_id": "r1", "speaker": "s2", "duration": 1.0}, {"id": "2", "recording_id": "r2", "speaker": "s1", "duration": 3.0}]
    two = [{"id": "1", "recording_id": "r9", "speaker": "s9", "duration": 50.0}, {"id": "3", "recording_id": "r1", "speaker": "s1", "duration": 4.0}]
    for name, rows in (("a", one), ("b", two)):
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as f:
            f.write("\n".join(map(json.dumps, rows)))
    c = parse_config({"format": "lhotse", "factor_idxs": [1], "constraint_idxs": [2], "constraints": ["sum"], "lhotse_fields": ["speaker"]})
    ds = tables.read_supervisions(spark, [str(tmp_path / "a.jsonl.gz"), str(tmp_path / "b.jsonl.gz")], c)
    got = {r["id"]: (r["speaker"], r["duration"], r["weights"]) for r in ds.records.collect()}
    assert got == {"r1": (["s1", "s2"], [7.0], [0.7]), "r2": (["s1"], [3.0], [0.3])}


def test_pandas_and_gml(spark, tmp_path):
    import pandas as pd

    ds = tables.from_pandas(spark, pd.DataFrame({"key": ["a", "b"], "f": [["x"], ["x", "y"]], "v": [1.0, 2.0]}), parse_config({"factor_idxs": [1], "constraint_idxs": [2], "constraints": ["mean"]}))
    assert len(ds) == 2 and ds.constraint_rows(0).count() == 2
    tables.write_gml(ds.records.select("id"), spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, capacity double"), str(tmp_path / "g.gml"))
    text = (tmp_path / "g.gml").read_text()
    assert text.count("node [") == 2 and "source 0" in text and 'label "b"' in text


def test_configurations():
    legacy = parse_config({"factor_idxs": [1], "constraint_idxs": [2, 3], "constraints": ["mean_tuple", "sum_tuple"], "mean_tuple": [0.5, 0.5], "sum_tuple": [0.8, 0.2], "Gaussian_thresh": 0.3, "splitter": "VNS", "constraints_weights": [1, 2]})
    assert legacy.specs[1].values == {"values": [0.8, 0.2], "power": 1.0} and legacy.gaussian_thresh == 0.3 and legacy.splitter == "vns" and legacy.constraint_weights == (1.0, 2.0)
    assert parse_config({"factor_idxs": [1], "constraint_idxs": [2], "constraints": [{"name": "max_entropy"}]}).specs[0].values == [0.0, 1.0]
    for bad in ({"factor_idxs": []}, {"factor_idxs": [1], "constraint_idxs": [9], "constraints": ["mean"]}, {"factor_idxs": [1], "constraint_idxs": [2], "constraints": []}, {"factor_idxs": [1], "factor_types": ["eval"]}):
        with pytest.raises(ValueError):
            parse_config(bad, 3)


def test_similarities_of_a_configuration():
    base = {"factor_idxs": [2, 1], "constraint_idxs": [2], "constraints": ["mean"], "similarity_functions": ["gaussian", "levenshtein"], "factor_weights": [2, 0.5], "Gaussian_thresh": 0.3, "levenshtein_thresh": 0.6}
    c = parse_config(base)
    assert [c.relation(i) for i in (0, 1)] == [("gaussian", 0.3, 2.0), ("levenshtein", 0.6, 0.5)]
    for bad in ({"similarity_functions": ["gaussian", "no such"]}, {"factor_weights": [1, 0]}, {"similarity_functions": ["gaussian"]}):
        with pytest.raises(ValueError):
            parse_config(base | bad)


def test_command_line(spark, dummy_tsv, tmp_path):
    import yaml

    from splitloom.cli import run

    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"factor_types": TYPES, "factor_idxs": [1, 2], "constraint_idxs": [3, 4, 5], "constraints": ["mean_tuple", "mean", "sum_tuple"], "mean_tuple": [0.5, 0.5], "sum_tuple": [0.8, 0.2], "splitter": "random", "max_iter": 60}))
    total = run(spark, str(tmp_path / "out"), str(tmp_path / "c.yaml"), [dummy_tsv], seed=3)
    assert total < cn.WORST_SCORE
    assert tables.read_partition(spark, str(tmp_path / "out/partition")).count() == 7
    assert json.loads((tmp_path / "out/config.json").read_text())["seed"] == 3
    assert spark.read.json(str(tmp_path / "out/overlaps")).count() > 0
    assert {len(r["scores"]) for r in spark.read.json(str(tmp_path / "out/history")).where("total < 99999").collect()} == {3}
    run(spark, str(tmp_path / "seeds"), str(tmp_path / "c.yaml"), [dummy_tsv], jobs=2, top=2)
    assert spark.read.json(str(tmp_path / "seeds/best_seeds")).count() == 2


def test_the_configured_similarity_changes_what_is_related(spark, dummy_tsv, tmp_path):
    import yaml

    from splitloom.cli import run

    base = {"factor_types": TYPES, "factor_idxs": [4], "constraint_idxs": [3], "constraints": [{"name": "kl", "values": {"smooth": 0.1}}], "splitter": "random", "max_iter": 300, "gaussian_thresh": 0.001}
    sides = {}
    for name in ("set_intersection", "gaussian"):
        (tmp_path / "c.yaml").write_text(yaml.safe_dump(base | {"similarity_functions": [name]}))
        run(spark, str(tmp_path / name), str(tmp_path / "c.yaml"), [dummy_tsv])
        sides[name] = {r["id"]: r["split"] for r in tables.read_partition(spark, str(tmp_path / name / "partition")).collect()}
        shown = {r["value"] for r in spark.read.json(str(tmp_path / name / "distributions")).collect()}
        assert shown == {"0.0", "1.0"}
    # durations 2.3 and 4 as well as 31.0 and 32.5 are near each other: no such pair is on two sides
    for a, b in (("a", "c"), ("e", "f")):
        assert {sides["gaussian"][a], sides["gaussian"][b]} != {0, 1}
    assert set(sides["set_intersection"].values()) == {0, 1}


def test_stream_equals_batch(spark, tmp_path):
    from splitloom.streaming.assign import assign_stream, decide, frozen_values

    posts = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "id string, n int, value string")
    frozen = frozen_values(posts, spark.createDataFrame([("a", 0), ("b", 1)], "id string, split int"))
    new = spark.createDataFrame([("2024-01-01 00:00:01", "p", 0, "x"), ("2024-01-01 00:00:02", "p", 0, "y"), ("2024-01-01 00:00:03", "q", 0, "y"), ("2024-01-01 00:01:00", "r", 0, "z"), ("2024-01-02 00:00:00", "late", 0, "x")], "t string, id string, n int, value string").select(F.to_timestamp("t").alias("event_time"), "id", "n", "value")
    new.write.parquet(str(tmp_path / "in"))
    batch = {r["id"]: r["split"] for r in decide(assign_stream(new, frozen)).collect()}
    assert batch == {"p": 2, "q": 1, "r": 0, "late": 0}
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = decide(assign_stream(stream, frozen)).writeStream.outputMode("complete").format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["split"] for r in spark.table("assigned").collect()} == batch
