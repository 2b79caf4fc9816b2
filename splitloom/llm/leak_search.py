"""Documents that carry passages of test items (winnowed fingerprints, extended hits).

Test items are the stated query set: they are read to the driver, and an index of a block of them (all, unless they have more than
``block_chars`` characters) goes to every task. The documents are read once per block, and nothing is shuffled. Both sides are cut into words and every k words
hashed; of every ``window`` successive hashes the smallest is kept as a fingerprint, so any ``window + k - 1``
successive words that both sides share have a fingerprint in common. Every hit, of common wording too, is then extended along its
diagonal: what a document carries of an item is judged by the longest span with few words changed, not by how many hits it has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: What only dresses a text: tags of running text, character entities, escaped line ends and tabs (fixed values).
DRESSING = re.compile(r"</?(?:b|i|u|br|p|em|strong|code|pre|tt|span|li)\s*/?>|&(?:quot|apos|amp|lt|gt|nbsp|#\d+|#x[0-9a-f]+);|\\[nrt]", re.IGNORECASE)
#: ASCII letters in lower case, digits as they are, all else blank.
_ASCII = str.maketrans({c: c.lower() if c.isalnum() else " " for c in map(chr, range(128))})


@dataclass(frozen=True)
class LeakRules:
    """What counts as a leak. A passage of 20 words with three changed still has five clean ones in a row: k=4, window=2."""

    k: int = 4
    window: int = 2
    #: Successive words of the item that the document must carry and the share of them that must be unchanged.
    min_words: int = 20
    min_same: float = 0.75
    #: A word weighs 1 if one item alone holds it, 0 if all do, and ln(items / holders) / ln(items) between. Tasks of the same make
    #: share their light words; a passage keeps this share of its weight, and this much in all or so many runs of k words that no other
    #: item has (an item's own wording may be made of ordinary words).
    min_weight_share: float = 0.8
    min_weight: float = 6.0
    min_own: int = 3
    #: With so many of its own runs, and this share of its words, this share of the weight is enough: few changes may hit heavy words.
    many_own: int = 4
    own_same: float = 0.85
    own_weight_share: float = 0.7
    #: A run of k words that more different items hold is common wording: a span without any other unchanged run is no leak.
    common_items: int = 10
    #: Words by which a passage may be shifted by insertions and deletions.
    drift: int = 12
    #: Characters of item text in a block; the index of a block is some ten times as large.
    block_chars: int = 8_000_000


RULES = LeakRules()
#: Every run of 20 words that an item and a document share unchanged, common wording too: what winnowing guarantees to find.
SHARED = LeakRules(min_same=1.0, min_weight_share=0.0, min_weight=0.0, min_own=0, common_items=1 << 40, drift=0)

#: Pairs of a begin and an end that :func:`best_span` looks at together.
SPAN_CELLS = 1_000_000
#: Hits of successive texts that are held at once, and words of diagonals that are compared at once.
HITS, CELLS = 1_000_000, 2_000_000


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, in lower case, without dressing."""
    if not text:
        return []
    if "<" in text or "&" in text or "\\" in text:
        text = DRESSING.sub(" ", text)
    return text.translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k successive word numbers; 0 where one of them is negative (unknown)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        known &= part >= 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every ``window`` successive ones (all positions, if there are fewer)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.arange(len(h))
    low = h[:n]
    for j in range(1, window):
        low = np.minimum(low, h[j : j + n])
    keep = np.zeros(len(h), bool)
    for j in range(window):
        keep[j : j + n] |= h[j : j + n] == low
    return np.nonzero(keep)[0]


@dataclass
class ItemIndex:
    """A block of items: word numbers, weights, runs of k words of an item alone (``own``) and runs that are not common wording (``rare``), and
    fingerprints sorted by hash with their item and position. ``flat`` has the items one after another, ``first`` where each begins."""

    rules: LeakRules
    vocabulary: dict[str, int]
    names: list[list[int]]
    ids: list[np.ndarray]
    weight: list[np.ndarray]
    own: list[np.ndarray]
    rare: list[np.ndarray]
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    flat: tuple[np.ndarray, ...] = ()
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))


@dataclass
class Wording:
    """Over all different items: how many there are, how many hold a word, the runs of k words common to many, and those of one only."""

    items: int
    holders: Counter
    common: set[tuple[str, ...]]
    own: set[tuple[str, ...]]


def wording(texts: list[list[str]], rules: LeakRules) -> Wording:
    """``texts`` are different: a repeated item has the wording of one."""
    grams: Counter = Counter()
    holders: Counter = Counter()
    for t in texts:
        grams.update({tuple(t[i : i + rules.k]) for i in range(len(t) - rules.k + 1)})
        holders.update(set(t))
    return Wording(len(texts), holders, {g for g, n in grams.items() if n > rules.common_items}, {g for g, n in grams.items() if n == 1})


def build_index(items: list[tuple[list[int], list[str]]], over: Wording, rules: LeakRules) -> ItemIndex:
    """Index of a block, with all fingerprints of its items."""
    vocabulary: dict[str, int] = {}
    index = ItemIndex(rules, vocabulary, [], [], [], [], [])
    hs, its, ats = [], [], []
    for n, (name, t) in enumerate(items):
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t), np.int32, len(t))
        h = gram_hashes(ids, rules.k)
        keep = winnow(h, rules.window)
        index.names.append(name)
        index.ids.append(ids)
        # a single item has nothing to be compared with: its words weigh as if it were one of two
        n_items = max(over.items, 2)
        index.weight.append(np.array([math.log(n_items / over.holders[w]) / math.log(n_items) for w in t]))
        index.own.append(np.array([tuple(t[i : i + rules.k]) in over.own for i in range(len(h))], bool))
        index.rare.append(np.array([tuple(t[i : i + rules.k]) not in over.common for i in range(len(h))], bool))
        hs.append(h[keep])
        its.append(np.full(len(keep), n, np.int32))
        ats.append(keep.astype(np.int32))
    if hs:
        h = np.concatenate(hs)
        order = np.argsort(h, kind="stable")
        index.hashes, index.item, index.at = h[order], np.concatenate(its)[order], np.concatenate(ats)[order]
        # runs of k words are padded to the length of their item
        whole = [[np.pad(x, (0, len(t) - len(x))) for x, t in zip(part, index.ids)] for part in (index.own, index.rare)]
        index.flat = tuple(np.concatenate(x) for x in (index.ids, index.weight, *whole))
        index.first = np.concatenate(([0], np.cumsum([len(t) for t in index.ids])))
    return index


def best_span(same: np.ndarray, weight: np.ndarray, own: np.ndarray, rules: LeakRules, rare: np.ndarray | None = None) -> tuple[int, int, float]:
    """(words, unchanged words, their weight) of the longest span that begins and ends unchanged, keeps the shares and is the item's own
    by weight or by ``own``, true where a run of k words of this item alone begins and is unchanged; zeros if there is none. ``rare``: true where an
    unchanged run begins that is not common wording; a span has at least one.

    Begins are taken in order, some at a time, and only ends that would make a longer span are looked at; a begin from which no such end
    keeps the shares is passed over. At most SPAN_CELLS pairs are held at once."""
    at = np.nonzero(same)[0]
    m = len(at)
    if m < rules.min_words * rules.min_same or (weight[at].sum() < rules.min_weight and own.sum() < rules.min_own):
        return 0, 0, 0.0
    whole = np.concatenate(([0.0], np.cumsum(weight)))
    unchanged = np.concatenate(([0.0], np.cumsum(weight[at])))
    runs = np.concatenate(([0], np.cumsum(own)))
    seldom = None if rare is None else np.concatenate(([0], np.cumsum(rare)))
    # a span keeps a share when what its end has reached is no less than what its begin has used up
    least = min(rules.min_weight_share, rules.own_weight_share)
    used = np.arange(m) - rules.min_same * at, unchanged[:-1] - least * whole[at]
    reached = np.arange(1, m + 1) - rules.min_same * (at + 1), unchanged[1:] - least * whole[at + 1]
    ahead = [np.maximum.accumulate(r[::-1])[::-1] for r in reached]
    best, need, begins, some = (0, 0, 0.0), rules.min_words, np.arange(m), 64
    while len(begins):
        j = np.searchsorted(at, at[begins] + need - 1)
        begins, j = begins[j < m], j[j < m]
        begins = begins[(ahead[0][j] >= used[0][begins] - 1e-9) & (ahead[1][j] >= used[1][begins] - 1e-9)]
        if not len(begins):
            break
        i = begins[:some, None]
        begins, some = begins[some:], max(1, SPAN_CELLS // m)
        ends = np.arange(np.searchsorted(at, at[i[0, 0]] + need - 1), m)[None, :]
        length = at[ends] - at[i] + 1
        kept = ends - i + 1
        heavy = unchanged[ends + 1] - unchanged[i]
        till, since = np.clip(at[ends] - rules.k + 2, 0, len(own)), np.minimum(at[i], len(own))
        inside = runs[till] - runs[since]
        all_of_it = whole[at[ends] + 1] - whole[at[i]]
        heavy_enough = (heavy >= rules.min_weight_share * all_of_it - 1e-9) & ((heavy >= rules.min_weight) | (inside >= rules.min_own))
        own_enough = (heavy >= rules.own_weight_share * all_of_it - 1e-9) & (inside >= rules.many_own) & (kept >= rules.own_same * length - 1e-9)
        good = (length >= need) & (kept >= rules.min_same * length - 1e-9) & (heavy_enough | own_enough)
        if seldom is not None:
            good &= seldom[till] > seldom[since]
        if good.any():
            a, b = np.unravel_index(np.argmax(np.where(good, length, 0)), length.shape)
            best = int(length[a, b]), int(kept[a, b]), float(heavy[a, b])
            need = best[0] + 1
    return best


def search_batch(index: ItemIndex, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
    """``(text, item, words, unchanged, weight)`` of every leak in texts given as word numbers (-1: a word of no item)."""
    rules = index.rules
    if not texts or not len(index.hashes):
        return []
    gap = np.full(1, -1, np.int32)
    ids = np.concatenate([x for t in texts for x in (t, gap)])
    start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    h = gram_hashes(ids, rules.k)
    keep = np.zeros(len(h), bool)
    keep[winnow(h, rules.window)] = True
    at = np.nonzero(keep & (h != 0))[0]
    lo = np.searchsorted(index.hashes, h[at], "left")
    hit = lo < len(index.hashes)
    hit[hit] = index.hashes[lo[hit]] == h[at[hit]]
    at, lo = at[hit], lo[hit]
    if not len(at):
        return []
    n = np.searchsorted(index.hashes, h[at], "right") - lo
    text = np.searchsorted(start, at, "right") - 1
    return [x for a, b in _hit_runs(text, n) for x in _extended(index, ids, start, text[a:b], at[a:b], lo[a:b], n[a:b])]


def _hit_runs(text: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of fingerprints of whole texts that have together at most HITS hits ``n``, or of one text."""
    ends = np.concatenate((np.nonzero(np.diff(text))[0] + 1, [len(text)]))
    upto = np.cumsum(n)
    first, before, last = 0, 0, 0
    for e in ends.tolist():
        if last > first and upto[e - 1] - before > HITS:
            yield first, last
            first, before = last, upto[last - 1]
        last = e
    yield first, last


def _extended(index: ItemIndex, ids: np.ndarray, start: np.ndarray, text: np.ndarray, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The leaks among the hits of some texts: fingerprints at ``at``, each with ``n`` rows of the index from ``lo``."""
    rules = index.rules
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    text, item, shift = np.repeat(text, n), index.item[rows], np.repeat(at, n) - index.at[rows]
    order = np.lexsort((shift, item, text))
    text, item, shift = text[order], item[order], shift[order]
    new = (np.diff(text) != 0) | (np.diff(item) != 0)
    once = np.concatenate(([True], new | (np.diff(shift) != 0)))
    text, item, shift = text[once], item[once], shift[once]
    cut = np.nonzero((np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(shift) > rules.drift))[0] + 1
    begin = np.concatenate(([0], cut))
    end = np.concatenate((cut, [len(item)]))
    worth = _worth(index, ids, start, text, item, shift, begin)
    best: dict[tuple[int, int], tuple[int, int, float]] = {}
    for a, b in zip(begin[worth].tolist(), end[worth].tolist()):
        k, t = int(item[a]), int(text[a])
        wanted = index.ids[k]
        same, runs = np.zeros(len(wanted), bool), np.zeros(len(index.own[k]), bool)
        for s in shift[a:b].tolist():
            i0, i1 = max(0, int(start[t]) - s), min(len(wanted), int(start[t + 1]) - 1 - s)
            if i1 > i0:
                here = wanted[i0:i1] == ids[i0 + s : i1 + s]
                same[i0:i1] |= here
                m = max(0, i1 - i0 - rules.k + 1)
                runs[i0 : i0 + m] |= np.logical_and.reduce([here[j : j + m] for j in range(rules.k)])
        span = best_span(same, index.weight[k], runs & index.own[k], rules, runs & index.rare[k])
        if span[0] and span > best.get((t, k), (0,)):
            best[t, k] = span
    return [(t, k, *span) for (t, k), span in best.items()]


def _worth(index: ItemIndex, ids: np.ndarray, start: np.ndarray, text: np.ndarray, item: np.ndarray, shift: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which clusters of diagonals, from ``begin`` on, may hold a leak: those whose unchanged words and runs, all diagonals together, are enough.

    A bound, not a choice: no other cluster has a span that :func:`best_span` would find.
    """
    rules, (words_, weight, own, rare) = index.rules, index.flat
    low = np.maximum(0, start[text] - shift)
    size = np.minimum(index.first[item + 1] - index.first[item], start[text + 1] - 1 - shift) - low
    upto = np.cumsum(size)
    sums = np.zeros((4, len(item)))
    a = 0
    while a < len(item):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + CELLS, "right")))
        some, since = size[a:b], upto[a:b] - size[a:b] - (upto[a] - size[a])
        i = np.arange(some.sum()) + np.repeat(low[a:b] - since, some)
        at = i + np.repeat(index.first[item[a:b]], some)
        here = words_[at] == ids[i + np.repeat(shift[a:b], some)]
        run = here.copy()
        for j in range(1, rules.k):
            run[:-j] &= here[j:]
            run[since + some - j] = False
        for k, x in enumerate((here, here * weight[at], run & own[at], run & rare[at])):
            sums[k, a:b] = np.add.reduceat(x.astype(float), since)
        a = b
    kept, heavy, own_runs, rare_runs = np.add.reduceat(sums, begin, axis=1)
    return (kept >= rules.min_words * rules.min_same - 1e-6) & ((heavy >= rules.min_weight - 1e-6) | (own_runs >= rules.min_own)) & (rare_runs > 0)


def batches_of(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of together at most ``most`` characters (or one text), with the place of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def find_leaks(documents: DataFrame, items: DataFrame, rules: LeakRules = RULES) -> DataFrame:
    """``(item_id, doc_id, n_words, n_same, weight)``: every document that carries a passage of an item, with its longest span.

    Null and empty texts carry nothing and hold nothing; an item of less than ``min_words`` words, or whose words weigh
    less than ``min_weight`` and that has less than ``min_own`` runs of words of its own, is never found, nor is a span of common wording alone.
    Repeated rows of a document give repeated results. Items of the same words are searched once and reported each, however many
    there are. Items are read to the driver (they are the stated query set); a block of them is sent to the tasks, at most
    ``block_chars`` characters or one item, and every further block costs one more reading of the documents. Document texts never leave their task.
    """
    spark = documents.sparkSession
    named: dict[tuple[str, ...], list] = {}
    for r in items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        named.setdefault(tuple(words(r["text"])), []).append(r["item_id"])
    over = wording([list(t) for t in named], rules)
    blocks: list[list] = [[]]
    size = 0
    for t, ids in named.items():
        chars = sum(map(len, t)) + len(t)
        if blocks[-1] and size + chars > rules.block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((ids, list(t)))
        size += chars
    key = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", key), T.StructField("n_words", T.IntegerType()), T.StructField("n_same", T.IntegerType()), T.StructField("weight", T.DoubleType())])
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    found = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(build_index(block, over, rules))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            number = index.vocabulary.get
            for pdf in batches:
                docs, out = pdf["doc_id"].to_list(), []
                for first, chunk in batches_of(pdf["text"].to_list()):
                    split = (words(x) for x in chunk)
                    numbered = [np.fromiter(map(number, t, repeat(-1)), np.int32, len(t)) for t in split]
                    out += [(name, docs[first + t], *rest) for t, k, *rest in search_batch(index, numbered) for name in index.names[k]]
                yield pd.DataFrame(out, columns=schema.names)

        part = texts.mapInPandas(search, schema)
        found = part if found is None else found.union(part)
    return found
