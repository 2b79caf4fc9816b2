import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from splitloom.llm.token_packing import count_tokens, pack, pack_documents, pack_examples, pack_vectors, packing_check, split_long, token_counts

TOKEN = re.compile(r"\w+|[^\w\s]+")
DOCS = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_counts_equal_the_tokenizer(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    assert token_counts(texts).tolist() == [len(TOKEN.findall(t or "")) for t in texts]


def test_counts_in_small_chunks():
    texts = ["a b", None, "", "é́x y", "x" * 50, "...!? a_b-c", "\x1c\x85"]
    assert token_counts(texts, most=3).tolist() == [len(TOKEN.findall(t or "")) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 2), st.integers(0, 20)), max_size=60))
def test_no_container_is_too_full(items):
    cap = np.array([50, 4, 40])
    sizes = np.array(items, np.int64).reshape(-1, 3)
    at = pack_vectors(sizes, cap)
    assert len(at) == len(items)
    for c in set(at.tolist()):
        assert (sizes[at == c].sum(0) <= cap).all()


def test_an_item_above_the_capacity_is_refused():
    with pytest.raises(ValueError):
        pack_vectors(np.array([[3]]), np.array([2]))


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(5, 900, 3000), np.ones(3000, int), rng.integers(0, 5, 3000)], 1)
    used = pack_vectors(sizes, np.array([2048, 64, 2048])).max() + 1
    assert used <= np.ceil(sizes[:, 0].sum() / 2048) * 1.01 + 1


def test_documents(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000])) for i in range(300)] + [(1000, None), (1001, " \n"), (1, "dup dup")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "5 AS n_tokens", "6 AS piece", "7 AS container_id")
    out = pack_documents(df, 100, 10).collect()
    room = {}
    for r in out:
        n, k = room.get(r["container_id"], (0, 0))
        room[r["container_id"]] = n + r["n_tokens"], k + 1
        assert r["piece"] == 0 or r["item_tokens"] > 100
        assert r["first_token"] == r["piece"] * 100
    assert all(n <= 100 and k <= 10 for n, k in room.values())
    want = sorted((i, n) for i, t in rows for n in [len(TOKEN.findall(t or ""))] if n)
    got = {}
    for r in out:
        key = r["doc_id"], r["item_tokens"]
        got[key] = got.get(key, 0) + r["n_tokens"]
    assert sum(got.values()) == sum(n for _, n in want) and {k for k in got} == set(want)
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_pieces(spark):
    items = spark.createDataFrame([(1, 10), (2, 11), (3, 20), (4, 1)], "doc_id long, n_tokens long")
    got = sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in split_long(items, 10).collect())
    assert got == [(1, 0, 10), (2, 0, 10), (2, 1, 1), (3, 0, 10), (3, 1, 10), (4, 0, 1)]


def test_groups_bound_the_work_of_a_task(spark):
    items = spark.range(500).selectExpr("id", "id % 7 + 1 AS size")
    out = pack(items, {"size": 20}, group_items=50)
    assert out.count() == 500 and out.groupBy("container_id").sum("size").where("`sum(size)` > 20").count() == 0
    assert count_tokens(spark.createDataFrame([(1, None)], DOCS)).count() == 0


def test_instruction_examples_keep_three_limits(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("w" for _ in range(n))
    rows = [(i, words(rng.randrange(0, 60)) or None, words(rng.randrange(0, 90))) for i in range(400)]
    # above one limit or both, without answer, without prompt, empty, and a repeated one
    rows += [(900, words(500), words(10)), (901, words(3), words(450)), (902, words(20), None), (903, None, words(7)), (904, "", None), (905, words(2), words(2)), (905, words(2), words(2))]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, answer string").selectExpr("*", "1 AS n_tokens", "2 AS container_id")
    limits = {"n_tokens": 128, "segments": 4, "loss_tokens": 64}
    out = pack_examples(df, 128, 4, 64)
    got = out.collect()
    count = lambda t: len((t or "").split())
    for c in {r["container_id"] for r in got}:
        mine = [r for r in got if r["container_id"] == c]
        assert sum(r["n_tokens"] for r in mine) <= 128 and len(mine) <= 4 and sum(r["loss_tokens"] for r in mine) <= 64
    for i, prompt, answer in rows:
        mine = [r for r in got if r["doc_id"] == i]
        copies = sum(x[0] == i for x in rows)
        whole = count(prompt) + count(answer)
        assert sum(r["n_tokens"] for r in mine) == copies * whole and sum(r["loss_tokens"] for r in mine) == copies * count(answer)
        assert len(mine) == (0 if not whole else copies if whole <= 128 and count(answer) <= 64 else -(-whole // 64))
    assert tuple(packing_check(out, limits, 0.85).first()) == (sum(r["n_tokens"] for r in got), True, True, True)
    # the check sees what is wrong
    one = out.limit(1).cache()
    assert not packing_check(out.unionByName(out.where("doc_id = 900 AND piece = 1")), limits, 0.1).first()["pieces_in_order"]
    assert not packing_check(out.withColumn("container_id", F.lit(1).cast("bigint")), limits, 0.1).first()["within_limits"]
    assert not packing_check(out.withColumn("container_id", F.monotonically_increasing_id()), limits, 0.9).first()["well_filled"]
    assert tuple(packing_check(one.where("false"), limits, 0.9).first()) == (0, True, True, True)
    assert pack_examples(df.where("false")).count() == 0


def test_copies_of_an_item_are_spread(spark):
    items = spark.createDataFrame([(1, 3)] * 4000, "doc_id long, n_tokens long")
    out = pack(items, {"n_tokens": 30}, group_items=500)
    sizes = [r["count"] for r in out.groupBy(F.shiftright("container_id", 32)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700 and out.count() == 4000
