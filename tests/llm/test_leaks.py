import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from splitloom.llm import leak_search
from splitloom.llm.leak_search import RULES, SHARED, LeakRules, best_span, build_index, find_leaks, gram_hashes, search_batch, winnow, wording, words
from tests.conftest import DATA

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def make_items(rng, n=60):
    nouns = ["w" + "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    out = []
    for i in range(n):
        body = [rng.choice(nouns) if rng.random() < 0.75 else rng.choice(["the", "of", "to", "and", "each"]) for _ in range(70)]
        out.append((i, "Write a function that takes one argument and returns the result. " + " ".join(body) + ". You may assume that the input is never empty, and return minus one if there is no such value."))
    return out


def filler(rng, n):
    return " ".join("f" + str(rng.randrange(3000)) for _ in range(n))


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k, w = int(rng.integers(2, 6)), int(rng.integers(1, 5))
        shared = rng.integers(0, 50, w + k - 1)
        docs = [np.concatenate([rng.integers(0, 50, int(rng.integers(0, 9))), shared, rng.integers(0, 50, int(rng.integers(0, 9)))]).astype(np.int32) for _ in range(2)]
        prints = [set(gram_hashes(d, k)[winnow(gram_hashes(d, k), w)].tolist()) for d in docs]
        assert prints[0] & prints[1]


def test_words_without_dressing():
    assert words("// The <b>Big</b> cat&#39;s\\n\\tsnake_case&nbsp;É9") == ["the", "big", "cat", "s", "snake", "case", "é9"]
    assert words(None) == [] and words("") == []


def test_planted_passages_are_found_and_decoys_are_not(spark):
    rng = random.Random(7)
    items = make_items(rng)
    docs, want = [], set()
    for d in range(400):
        item, text = rng.choice(items)
        own = words(text)[11:-18]
        kind = d % 8
        start = rng.randrange(0, len(own) - 40)
        if kind in (0, 1, 2):
            span = own[start : start + 30]
            if kind == 1:  # one word in eight changed
                span = [f"zz{i}" if i % 8 == 5 else x for i, x in enumerate(span)]
            if kind == 2:  # dressed
                span = [x.upper() + rng.choice(["\n// ", " <b>", "</b> ", "&quot;", "_"]) for x in span]
            body = (" " if kind != 2 else "").join(span)
            want.add((item, d))
        elif kind == 3:  # a short quote
            body = " ".join(own[start : start + 10])
        elif kind == 4:  # common wording
            body = "Write a function that takes one argument and returns the result. You may assume that the input is never empty, and return minus one if there is no such value."
        elif kind == 5:  # the item's words in another order
            body = " ".join(rng.sample(own, len(own)))
        else:
            body = ""
        docs.append((d, f"{filler(rng, 20)} {body} {filler(rng, 20)}"))
    docs += [(1000, docs[0][1]), (1001, None), (1002, ""), (1003, filler(rng, 200_000)), (1004, docs[8][1] + filler(rng, 100_000))]
    want |= {(i, 1000) for i, d in want if d == 0} | {(i, 1004) for i, d in want if d == 8}
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS item_id", "2 AS n_words")
    it = spark.createDataFrame([*items, (900, None), (901, "")], ITEMS).selectExpr("*", "'x' AS doc_id")
    got = {(r["item_id"], r["doc_id"]) for r in find_leaks(df, it).collect()}
    assert got == want
    # blocks of a few items give the same pairs
    small = {(r["item_id"], r["doc_id"]) for r in find_leaks(df, it, LeakRules(block_chars=5000)).collect()}
    assert small == want


def test_empty_tables(spark):
    items = spark.createDataFrame(make_items(random.Random(1), 3), ITEMS)
    assert find_leaks(spark.createDataFrame([], DOCS), items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c d e")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_a_single_item_can_be_found(spark, n):
    items = make_items(random.Random(2), n)
    got = find_leaks(spark.createDataFrame([(1, items[0][1])], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r["item_id"], r["doc_id"]) for r in got] == [(0, 1)]


@pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")
@pytest.mark.parametrize("length,changed,most", [(20, 0, 0.0), (20, 2, 0.02), (24, 3, 0.02)])
def test_short_passages_of_real_items_are_found(length, changed, most):
    """Windows without common wording and with three runs of four words that no other item has; at most the share ``most`` is missed."""
    table = pd.read_parquet(DATA / "sf0.001/eval_items.parquet").dropna(subset=["text"])
    items = [(i, words(t)) for i, t in zip(table["item_id"], table["text"])]
    grams = lambda t: [tuple(t[i : i + 4]) for i in range(len(t) - 3)]
    holders = Counter(g for _, t in items for g in set(grams(t)))
    over, rng = wording([t for _, t in items], RULES), random.Random(3)
    passages = []
    for i, t in items:
        for a in range(0, len(t) - length + 1, 3):
            span = t[a : a + length]
            if not set(grams(span)) & over.common and sum(holders[g] == 1 for g in grams(span)) >= 3:
                for j in rng.sample(range(1, length - 1), changed):
                    span[j] = "zzqq"
                passages.append((i, span))
    index = build_index([([i], t) for i, t in items], over, RULES)
    texts = [np.fromiter((index.vocabulary.get(w, -1) for w in t), np.int32, len(t)) for _, t in passages]
    got = {(n, index.names[k][0]) for n, k, *_ in search_batch(index, texts)}
    missed = sum((n, i) not in got for n, (i, _) in enumerate(passages))
    assert len(passages) > 500 and missed <= most * len(passages)
    assert all(i == passages[n][0] for n, i in got)


@pytest.mark.parametrize("copies", [1, 10, 11, 20, 100])
def test_repeated_items_are_found_every_time(spark, copies):
    rng = random.Random(4)
    items = make_items(rng, 200)
    items += [(1000 + i, items[3][1]) for i in range(copies)]
    docs = [(1, f"{filler(rng, 30)} {items[3][1]} {filler(rng, 30)}"), (2, filler(rng, 90))]
    got = {(r["item_id"], r["doc_id"]) for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(3, 1)} | {(1000 + i, 1) for i in range(copies)}


def spans_by_trial(same, weight, own, rules):
    at, best = np.nonzero(same)[0], 0
    for i, a in enumerate(at):
        for j, b in enumerate(at[i:]):
            n, kept, all_of_it, heavy = b - a + 1, j + 1, weight[a : b + 1].sum(), weight[at[i : i + j + 1]].sum()
            runs = own[a : max(a, b - rules.k + 2)].sum()
            one = heavy >= rules.min_weight_share * all_of_it - 1e-9 and (heavy >= rules.min_weight or runs >= rules.min_own)
            two = heavy >= rules.own_weight_share * all_of_it - 1e-9 and runs >= rules.many_own and kept >= rules.own_same * n - 1e-9
            if n >= rules.min_words and kept >= rules.min_same * n - 1e-9 and (one or two):
                best = max(best, n)
    return best


def test_best_span_equals_trial(monkeypatch):
    rng = np.random.default_rng(5)
    for rules in (RULES, SHARED):
        for n in range(250):
            m = int(rng.integers(15, 90))
            same, weight, own = rng.random(m) < rng.choice([0.7, 0.85, 0.97]), rng.random(m) * rng.choice([0.3, 1.0]), rng.random(m - 3) < 0.3
            monkeypatch.setattr(leak_search, "SPAN_CELLS", 1 if n % 2 else 10**6)
            assert best_span(same, weight, own & same[: m - 3], rules)[0] == spans_by_trial(same, weight, own & same[: m - 3], rules)


def test_long_items_take_little_memory():
    import time
    import tracemalloc

    rng = np.random.default_rng(6)
    m = 50_000
    for share in (1.0, 0.9, 0.745, 0.6):
        same, weight, own = rng.random(m) < share, rng.random(m), rng.random(m - 3) < 0.1
        tracemalloc.start()
        start = time.time()
        best_span(same, weight, own, RULES)
        assert tracemalloc.get_traced_memory()[1] < 300e6 and time.time() - start < 120
        tracemalloc.stop()
