import random
from collections import Counter, defaultdict

from splitloom.functions.ids import spelled_number
from splitloom.operators.heavy_keys import key_counts, speaker_author_profile, weighted_percentiles, weighted_values
from pyspark.sql import functions as F

SCHEMA = "chp_id string, spk_id array<string>, author_id array<string>"


def test_spelled_numbers(spark):
    cases = {"12": 12, " 012\t": 12, "12\xa0": 12, "+7": 7, "spk7": 7, "S_7": 7, "7.0": 7, "7.00": 7, "007": 7, "0": None, "-1": None, "": None, None: None, "n/a": None, "7.5": None, "1e3": None, "7 8": None, "spk-7": None, "9" * 18: 10**18 - 1, "9" * 19: None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", spelled_number(F.col("x")).alias("n")).collect()
    assert {r["x"]: r["n"] for r in got} == cases


def test_profile_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "", "n/a", *map(str, range(1, 30))]), [rng.choice(["1", "spk1", " 1", "2", "?", None, str(rng.randrange(3, 40))]) for _ in range(rng.randrange(3))] or None, [str(rng.randrange(0, 6)) for _ in range(rng.randrange(3))]) for _ in range(800)]
    rows += rows[:50]
    got = {(r["field_name"], r["key_id"]): r for r in speaker_author_profile(spark.createDataFrame(rows, SCHEMA).withColumn("key_id", F.lit("clash")), 0.1).collect()}

    def nums(xs):
        out = set()
        for x in xs or []:
            x = (x or "").strip().removeprefix("spk")
            if x.isdigit() and int(x) > 0:
                out.add(int(x))
        return out

    n, chapters, partners = Counter(), defaultdict(Counter), defaultdict(Counter)
    for c, s, a in rows:
        s, a = nums(s), nums(a)
        for field, own, other in (("spk_id", s, a), ("author_id", a, s)):
            for k in own:
                n[field, k] += 1
                chapters[field, k].update(nums([c]))
                partners[field, k].update(other)
    assert set(got) == set(n)
    for k, r in got.items():
        assert (r["n_rows"], r["n_chapters"], r["n_partners"]) == (n[k], len(chapters[k]), len(partners[k]))
        assert r["is_hot"] == (n[k] / len(rows) >= 0.1)
        if chapters[k]:
            top = min(chapters[k].items(), key=lambda x: (-x[1], x[0]))
            assert (r["top_chapter"], r["top_chapter_rows"]) == top
        else:
            assert r["top_chapter"] is None


def test_profile_of_empty_and_null_tables(spark):
    assert speaker_author_profile(spark.createDataFrame([], SCHEMA)).count() == 0
    assert speaker_author_profile(spark.createDataFrame([(None, None, None)] * 3, SCHEMA)).count() == 0


def test_percentiles_with_ties_and_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(50))) for _ in range(3000)] + [("cold", 7.0)] * 5 + [("one", -1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["share"]): r["value"] for r in weighted_percentiles(weighted_values(df, ["k"], "v"), ["k"], "v", [0.0, 0.1, 0.5, 0.95, 1.0], blocks=16).collect()}
    for k in ("hot", "cold", "one"):
        vs = sorted(v for a, v in rows if a == k)
        for share in (0.0, 0.1, 0.5, 0.95, 1.0):
            need = max(1, share * len(vs))
            assert got[k, share] == next(v for i, v in enumerate(vs, 1) if i >= need - 1e-9)
    assert not any(k == "none" for k, _ in got)


def test_key_counts_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2), ("b", 1)], "k string, v long")
    got = {r["k"]: tuple(r)[1:] for r in key_counts(weighted_values(df, ["k"], "v"), ["k"], "v").collect()}
    assert got == {"a": (2, 0, None, None), "b": (2, 2, 1, 1)}


def test_cuts_below(spark):
    from bisect import bisect_left

    from splitloom.operators.heavy_keys import cuts_below

    for n in (0, 1, 2, 3, 7, 8, 1023):
        cuts = [i * 0.5 for i in range(n)]
        df = spark.createDataFrame([(x * 0.25 - 1,) for x in range(40)] + [(1e9,)], "v double")
        assert all(r["c"] == bisect_left(cuts, r["v"]) for r in df.withColumn("c", cuts_below(df["v"], cuts)).collect())
