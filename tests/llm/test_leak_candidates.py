"""No hit is dropped before what it belongs to is judged."""

import random

import numpy as np

from splitloom.llm import leak_search
from splitloom.llm.leak_search import RULES, SHARED, build_index, find_leaks, search_batch, words, wording
from tests.llm.test_leaks import DOCS, ITEMS, filler, make_items


def found(spark, docs, items):
    return {(r["item_id"], r["doc_id"]) for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}


def test_passages_that_some_items_share_are_found_with_changes(spark):
    """Five items hold the passage, and three changed words leave few fingerprints."""
    rng = random.Random(1)
    items, docs, want = make_items(rng, 195), [], set()
    for f in range(8):
        body = [f"q{f}x{i}" for i in range(40)]
        items += [(1000 + 10 * f + v, " ".join([*body, *[f"v{v}y{rng.randrange(10**6)}" for _ in range(30)]])) for v in range(5)]
        span = [f"zz{i}" if i in (5, 11, 17) else x for i, x in enumerate(body[7:27])]
        docs.append((f, f"{filler(rng, 20)} {' '.join(span)} {filler(rng, 20)}"))
        want |= {(1000 + 10 * f + v, f) for v in range(5)}
    assert found(spark, docs, items) == want


def test_a_passage_with_hits_in_common_wording_only_is_found(spark):
    rng = random.Random(2)
    phrase = ["once", "upon", "some", "long", "time"]
    items = make_items(rng, 150)
    items += [(500 + i, " ".join([*[f"a{i}w{j}" for j in range(20)], *phrase, *[f"b{i}w{j}" for j in range(20)]])) for i in range(30)]
    item = words(items[155][1])
    span = [f"zz{i}" if i in (4, 10, 15) else x for i, x in enumerate([*item[15:19], "x", *phrase, "x", *item[26:30], "x", *item[31:35]])]
    # the item's words around the phrase, one in seven changed: no clean run of five but the phrase
    items[155] = (505, " ".join([*item[:19], "m1", *phrase, "m2", *item[26:30], "m3", *item[31:]]))
    docs = [(1, " ".join(span)), (2, " ".join([filler(rng, 9), *phrase, filler(rng, 9)]))]
    assert found(spark, docs, items) == {(505, 1)}


def test_common_wording_alone_is_no_leak(spark):
    """Thirty words of twelve items in two hundred, unchanged; with words of one item beside them it is that item's."""
    rng = random.Random(3)
    story = [f"s{i}" for i in range(30)]
    items = make_items(rng, 190) + [(700 + i, " ".join([*story, *[f"t{i}w{j}" for j in range(30)]])) for i in range(12)]
    docs = [(1, " ".join([filler(rng, 20), *story, filler(rng, 20)])), (2, " ".join([*story, *[f"t4w{j}" for j in range(10)], filler(rng, 20)]))]
    assert found(spark, docs, items) == {(704, 2)}


def test_the_bound_leaves_out_no_leak(monkeypatch):
    rng = random.Random(4)
    stock = [f"w{i}" for i in range(60)]
    phrases = [[rng.choice(stock) for _ in range(12)] for _ in range(9)]
    text = lambda n: [w for _ in range(n) for w in (rng.choice(phrases) if rng.random() < 0.7 else [rng.choice(stock) for _ in range(6)])]
    items = [([i], text(5)) for i in range(60)]
    docs = []
    for _ in range(80):
        d = text(3) + rng.choice(items)[1][:40] + text(rng.randrange(12))
        docs.append([w if rng.random() < 0.93 else "other" for w in d])
    for rules in (RULES, SHARED):
        index = build_index(items, wording([t for _, t in items], rules), rules)
        texts = [np.fromiter((index.vocabulary.get(w, -1) for w in d), np.int32, len(d)) for d in docs]
        got = sorted(search_batch(index, texts))
        with monkeypatch.context() as m:
            m.setattr(leak_search, "HITS", 40)
            m.setattr(leak_search, "CELLS", 500)
            assert sorted(search_batch(index, texts)) == got
            m.setattr(leak_search, "_worth", lambda index, ids, start, text, item, shift, begin: np.ones(len(begin), bool))
            assert sorted(search_batch(index, texts)) == got
        assert len(got) > 40
