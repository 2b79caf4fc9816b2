import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitloom.llm.proportional_sample import allocate, draw, gender_path, plan_check, plan_quotas, record_categories, target_report

TARGETS = "plan_id int, table_name string, category string, target_share double, min_records int, sample_rate double"


def test_categories(spark):
    nan = float("nan")
    rows = [("a", [0.0, nan]), ("a", [1.0, -1.0]), ("b", None), ("c", []), ("d", [2.0, 2.0]), ("d", [0.0, None]), (None, [1.0]), ("e", [10.0, 9.0]), ("f", [float("inf")])]
    df = spark.createDataFrame(rows, "id string, g array<double>").withColumn("category", F.lit("clash")).withColumn("record_id", F.lit(1))
    assert {r["record_id"]: r["category"] for r in record_categories(df, F.col("id"), "g").collect()} == {"a": "0+1", "b": "none", "c": "none", "d": "0+2", "e": "9+10", "f": "none"}


def family(c):
    return ("none",) if c == "none" else ("some", "several" if "+" in c else "single", str(c.count("+") + 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["0", "1", "2", "0+1", "1+2", "none"]), st.floats(0, 1), st.integers(0, 5), st.integers(0, 60)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 120))
def test_allocation(rows, size):
    norm = sum(r[1] for r in rows) or 1
    rows = [{"category": c, "path": family(c), "share": s / max(norm, 1), "least": m, "available": a} for c, s, m, a in rows]
    got = allocate(rows, size)
    q = {c: a.quota for c, a in got.items()}
    for r in rows:
        assert (got[r["category"]].lacking > 0) == (r["available"] < size * r["share"] * (1 - 1e-12) or r["available"] < r["least"])
    floor = {r["category"]: min(r["least"], r["available"]) for r in rows}
    assert all(floor[r["category"]] <= q[r["category"]] <= r["available"] for r in rows)
    wanted = int(size * min(1.0, sum(r["share"] for r in rows)) + 0.5)
    assert sum(q.values()) == min(max(wanted, sum(floor.values())), sum(r["available"] for r in rows))
    if all(r["available"] >= size * r["share"] + 1 and r["least"] == 0 for r in rows):
        assert all(abs(q[r["category"]] - size * r["share"]) < 1.001 for r in rows)


def test_unmet_quota_goes_to_siblings_before_cousins(spark):
    rows = [{"category": c, "path": family(c), "share": s, "least": 0, "available": a} for c, s, a in (("0", 0.4, 10), ("1", 0.2, 100), ("0+1", 0.4, 100))]
    quotas = lambda rows: {c: a.quota for c, a in allocate(rows, 100).items()}
    assert quotas(rows) == {"0": 10, "1": 50, "0+1": 40}
    assert allocate(rows, 100)["0"].lacking > 29.9 and allocate(rows, 100)["1"].lacking == 0
    rows[1]["available"] = 30
    assert quotas(rows) == {"0": 10, "1": 30, "0+1": 60}
    # four levels: brothers, then first, then second cousins, then the rest
    deep = [("a", "xyz", 0), ("b", "xyz", 5), ("c", "xyw", 10), ("d", "xu", 20), ("e", "v", 100)]
    rows = [{"category": c, "path": tuple(p), "share": 1.0 if c == "a" else 0.0, "least": 0, "available": a} for c, p, a in deep]
    assert quotas(rows) == {"a": 0, "b": 5, "c": 10, "d": 20, "e": 65}
    got = spark.createDataFrame([("none",), ("1",), ("0+2",)], "c string").select(gender_path(F.col("c")).alias("p")).collect()
    assert [tuple(r["p"]) for r in got] == [family("none"), family("1"), family("0+2")]


def test_a_tree_of_ones_own(spark):
    recs = spark.createDataFrame([("t", f"{c}{i}", c) for c, n in (("x", 10), ("y", 100), ("z", 100)) for i in range(n)], "table_name string, record_id string, category string")
    targets = spark.createDataFrame([(1, "t", c, s, 0, 100 / 210) for c, s in (("x", 0.5), ("y", 0.2), ("z", 0.3))], TARGETS)
    for kin, want in ((("x", "z"), {"x": 10, "y": 20, "z": 70}), (("x", "y"), {"x": 10, "y": 60, "z": 30})):
        tree = spark.createDataFrame([(c, ["a"] if c in kin else ["b"]) for c in "xyz"], "category string, path array<string>")
        quotas = plan_quotas(recs, targets, tree)
        assert {r["category"]: r["quota"] for r in quotas.collect()} == want
        assert [tuple(r)[2:] for r in plan_check(quotas, draw(recs, quotas)).collect()] == [(100, True, True)]


def test_draw_is_exact_and_repeatable(spark, monkeypatch):
    from splitloom.llm import proportional_sample as ps

    monkeypatch.setattr(ps, "BUCKET_RECORDS", 50)
    rng = random.Random(1)
    recs = spark.createDataFrame([("t", str(i), rng.choice(["0", "0", "1", "none"])) for i in range(3000)], "table_name string, record_id string, category string")
    targets = spark.createDataFrame([(1, "t", "0", 0.5, 0, 0.3), (1, "t", "1", 0.5, 0, 0.3), (2, "t", "none", 1.0, 0, 0.9), (2, "t", "7", 0.0, 2, 0.9), (3, "other", "0", 1.0, 1, 0.5), (4, "t", "0", None, None, 0.1), (5, "t", "1", 0.05, 0, 0.1), (5, "t", "1", 0.05, 3, 0.1), (None, None, None, None, None, None)], TARGETS)
    quotas = plan_quotas(recs, targets)
    q = {(r["plan_id"], r["category"]): r["quota"] for r in quotas.collect()}
    assert q[1, "0"] == 450 and q[1, "1"] == 450 and q[2, "7"] == 0 and q[3, "0"] == 0 and q[4, "0"] == 0 and q[5, "1"] == 30
    out = draw(recs, quotas).collect()
    n = {}
    for r in out:
        n[r["plan_id"], r["category"]] = n.get((r["plan_id"], r["category"]), 0) + 1
    assert n == {k: v for k, v in q.items() if v}
    assert len({(r["plan_id"], r["record_id"]) for r in out}) == len(out)
    assert sorted(map(tuple, draw(recs.repartition(7), quotas).collect())) == sorted(map(tuple, out))
    report = {(r["plan_id"], r["category"]): r["is_short"] for r in target_report(quotas, targets.where("plan_id IS NOT NULL")).collect()}
    assert report[1, "0"] is False and report[2, "none"] is True and report[2, "7"] is True and report[3, "0"] is True


def test_empty_tables(spark):
    recs = spark.createDataFrame([], "table_name string, record_id string, category string")
    targets = spark.createDataFrame([(1, "t", "0", 0.5, 1, 0.3)], TARGETS)
    assert [r["quota"] for r in plan_quotas(recs, targets).collect()] == [0]
    assert draw(recs, plan_quotas(recs, targets)).count() == 0
    assert plan_quotas(recs, spark.createDataFrame([], TARGETS)).count() == 0
