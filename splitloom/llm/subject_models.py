"""Subject areas of documents: interpolated n-gram language models against background models.

Names and words of a text are cut into words (camel case and underscores too). For every subject an interpolated
bigram model is trained on hand-labelled documents; background models of all documents and of each
language stand for what any file contains. A subject can be accepted for a document only if the cross-entropy of its words falls
when the subject's model is mixed into the background. How many subjects are accepted is calibrated on held-out labels: by the number of
words that speak for a subject, alone and beside those of the document's other subjects.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = re.compile("[̀-ͯ]+")
#: Bytes of letters in lower case, bytes above ASCII as they are, byte 1 (end of a text), all else blank.
_BYTES = np.array([ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b >= 128 or b == 1 else 32 for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_END = b"\x01"


@dataclass(frozen=True)
class SubjectRules:
    #: Labelled documents used for training, per subject and in all; the rest of the labels is not read. Their order is that of a hash of doc_id.
    per_subject: int = 200
    most_labelled: int = 2000
    #: Labelled documents longer than this are not used for training.
    most_chars: int = 50_000
    #: Distinct labelled documents of a subject that must hold a word before it can speak for it.
    least_docs: int = 2
    #: Weight, in words, of the unigram model behind the bigrams and of the background behind the unigrams.
    bigram_back: float = 20.0
    unigram_back: float = 50.0
    rounds: int = 6
    folds: int = 3
    #: Weight, in words, of the background of all documents behind that of one language.
    language_back: float = 20_000.0
    #: Share of a subject's labelled documents that must hold a word, beside least_docs.
    least_share: float = 0.01
    #: Times that a word counts in one document when models are trained.
    most_repeats: int = 5
    #: Assumed share of subject words in a labelled document.
    subject_words: float = 0.2
    #: A word is looked at when a subject's model gives it so many times its background probability.
    least_lift: float = 8.0
    #: Prior share of a subject's words in any text.
    prior: float = 0.06
    #: Spellings of ``lang`` that this share of all documents has get a background model of their own (so at most 500 do), the others that of all.
    language_share: float = 0.002
    #: Lower bound of the calibrated mass: labels name no document without a subject, so they cannot tell how much chance alone gives.
    least_mass: float = 1.25


RULES = SubjectRules()


def text_words(texts: Iterable[str]) -> list[bytes]:
    """Words of the texts in order, each text closed by the word ``\\x01``: letters only, lower case, no accents, camel case cut."""
    plain = []
    for t in texts:
        if not t.isascii():
            t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
        plain.append(t.replace("\x01", " ") if "\x01" in t else t)
    raw = np.frombuffer(" \x01 ".join([*plain, ""]).encode("utf-8", "replace"), np.uint8)
    cut = np.nonzero(_LOWER[raw[:-1]] & _UPPER[raw[1:]])[0] + 1
    return np.insert(_BYTES[raw], cut, 32).tobytes().split()


def base(word: bytes) -> bytes:
    """A word without a plural s."""
    return word[:-1] if len(word) > 3 and word[-1:] == b"s" and word[-2:-1] not in (b"s", b"u") else word


@dataclass
class Vocabulary:
    """Numbers of the words of the labelled documents, with the spellings that count as each of them."""

    number: dict[bytes, int]
    size: int

    @staticmethod
    def of(docs: list[list[bytes]], least: int = 2) -> "Vocabulary":
        held = Counter()
        for d in docs:
            held.update({base(w) for w in d})
        number = {w: i for i, w in enumerate(sorted(w for w, n in held.items() if n >= least and len(w) > 2))}
        size = len(number)
        for w, i in list(number.items()):
            for end in (b"s", b"es"):
                number.setdefault(w + end, i)
        number[_END] = -2
        return Vocabulary(number, size)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers; -1 for other words, -2 for the end of a text."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))


@dataclass
class Background:
    """Counts over all documents: words by language group (row 0: all languages) and the pairs that labelled documents hold."""

    words: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray

    def probabilities(self, back: float) -> np.ndarray:
        """``p[group, word]``: the model of a language is interpolated with that of all documents."""
        total = self.words[0]
        p = np.empty(self.words.shape)
        p[0] = (total + 0.5) / (total.sum() + 0.5 * len(total))
        p[1:] = (self.words[1:] + back * p[0]) / (self.words[1:].sum(1, keepdims=True) + back)
        return p


@dataclass
class SubjectModel:
    """``unigram[w, s]``, ``back[v, s]`` (weight of the unigram after context v) and ``bigram[pair, s]``; ``ground`` are the backgrounds."""

    subjects: list[str]
    vocabulary: Vocabulary
    unigram: np.ndarray
    back: np.ndarray
    pairs: np.ndarray
    bigram: np.ndarray
    ground: np.ndarray
    ground_back: np.ndarray
    ground_bigram: np.ndarray
    telling: np.ndarray
    prior: float
    mass: float = 3.0
    share: float = 0.25

    def mass_of(self, ids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that speak for each subject, and the bits that each subject saves, one row per text of ``ids`` (texts end with -2, ``groups`` has their languages).

        The background of a word is the larger of its probabilities under all documents and under its text's language. A word
        speaks for a subject with its posterior. The bits are the fall of the text's cross-entropy, in all its
        words, when the subject's model is mixed into the background with its prior share; words that no subject lifts change nothing.
        """
        ends = np.nonzero(ids == -2)[0]
        k = len(self.subjects)
        at = np.nonzero(ids >= 0)[0]
        at = at[self.telling[ids[at]]]
        if not len(at):
            return np.zeros((len(ends), k)), np.zeros((len(ends), k))
        text = np.searchsorted(ends, at)
        w = ids[at]
        v = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
        v = np.where(v < 0, len(self.unigram), v)
        p = self.back[v] * self.unigram[w]
        b = np.maximum(self.ground[0, w], self.ground[groups[text], w]) * self.ground_back[v]
        if len(self.pairs):
            code = v.astype(np.int64) * len(self.unigram) + w
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            seen = self.pairs[place] == code
            p[seen] += self.bigram[place[seen]]
            b[seen] += self.ground_bigram[place[seen]]
        own = p * self.prior
        z = own / (own.sum(1, keepdims=True) + b[:, None])
        bits = np.log2(1 - self.prior + own / b[:, None])
        return tuple(np.stack([np.bincount(text, x[:, j], len(ends)) for j in range(k)], 1) for x in (z, bits))

    def accept(self, mass: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return (bits > 0) & (mass >= self.mass) & (mass >= self.share * mass.sum(1, keepdims=True))


def pairs_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Codes of successive words of the vocabulary."""
    ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return ids[:-1][ok].astype(np.int64) * n + ids[1:][ok]


def known_pairs(docs: list[np.ndarray], n: int, least: int) -> np.ndarray:
    """Pairs that at least ``least`` of the documents hold, sorted."""
    if not docs:
        return np.zeros(0, np.int64)
    codes, held = np.unique(np.concatenate([np.unique(pairs_of(d, n)) for d in docs]), return_counts=True)
    return codes[held >= least]


def train(docs: list[tuple[np.ndarray, int, set[int]]], subjects: list[str], vocabulary: Vocabulary, background: Background, rules: SubjectRules = RULES) -> SubjectModel:
    """Models from ``(word numbers, language group, subjects)`` of labelled documents.

    A labelled document also holds common words and may have two subjects. Rounds of expectation and maximisation give each of
    its words to one of its subjects or to the background, so that what all files share leaves the subjects' counts.
    """
    k, n = len(subjects), vocabulary.size
    ground = background.probabilities(rules.language_back)
    bags = []
    for ids, g, subs in docs:
        w, c = np.unique(ids[ids >= 0], return_counts=True)
        # a word that fills a file says no more about a subject than one that stands there a few times
        bags.append((w, np.minimum(c, rules.most_repeats), np.maximum(ground[0, w], ground[g, w]), sorted(subs)))
    uni, holders = np.zeros((n, k)), np.zeros((n, k))
    for w, c, _, subs in bags:
        for s in subs:
            uni[w, s] += c
            holders[w, s] += 1
    least = np.maximum(rules.least_docs, rules.least_share * np.array([sum(s in d[2] for d in docs) for s in range(k)]))
    uni[holders < least] = 0
    uni = uni / np.maximum(uni.sum(0), 1)
    counts = uni
    for _ in range(rules.rounds):
        counts = np.zeros((n, k))
        for w, c, b, subs in bags:
            if subs:
                own = uni[np.ix_(w, subs)] * (rules.subject_words / len(subs))
                counts[np.ix_(w, subs)] += own / (own.sum(1) + (1 - rules.subject_words) * b + 1e-12)[:, None] * c[:, None]
        counts[holders < least] = 0
        uni = counts / np.maximum(counts.sum(0), 1e-9)
    uni = (counts + rules.unigram_back * ground[0][:, None]) / (counts.sum(0) + rules.unigram_back)
    telling = uni.max(1) > rules.least_lift * ground[0]
    # bigrams: each occurrence counts as far as its second word was given to the subject
    pairs = background.pairs
    grams, after = np.zeros((len(pairs), k)), np.zeros((n + 1, k))
    for ids, g, subs in docs:
        code = pairs_of(ids, n)
        if not len(pairs) or not len(code) or not subs:
            continue
        place = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        place = place[pairs[place] == code]
        v, w = pairs[place] // n, pairs[place] % n
        sub = sorted(subs)
        own = uni[np.ix_(w, sub)] * (rules.subject_words / len(sub))
        z = own / (own.sum(1) + (1 - rules.subject_words) * np.maximum(ground[0, w], ground[g, w]))[:, None]
        for j, s in enumerate(sub):
            np.add.at(grams[:, s], place, z[:, j])
            np.add.at(after[:, s], v, z[:, j])
    v = pairs // n
    back = rules.bigram_back / (after + rules.bigram_back)
    follow = np.bincount(v, background.pair_counts, n + 1) if len(pairs) else np.zeros(n + 1)
    return SubjectModel(
        subjects, vocabulary, uni, back, pairs, grams / (after[v] + rules.bigram_back), ground,
        rules.bigram_back / (follow + rules.bigram_back), background.pair_counts / (follow[v] + rules.bigram_back), telling, rules.prior,
    )


def calibrate(docs: list[tuple[np.ndarray, int, set[int]]], subjects: list[str], vocabulary: Vocabulary, background: Background, rules: SubjectRules = RULES) -> tuple[float, float]:
    """(mass, share) with the best F1 over labelled documents, each scored by a model that was trained without its fold."""
    rows, saved, truth = [], [], []
    for f in range(rules.folds):
        held = [d for i, d in enumerate(docs) if i % rules.folds == f]
        rest = [d for i, d in enumerate(docs) if i % rules.folds != f]
        if held and rest:
            m = train(rest, subjects, vocabulary, background, rules)
            mass, bits = m.mass_of(np.concatenate([np.append(ids[ids != -2], -2) for ids, _, _ in held]), np.array([g for _, g, _ in held]))
            rows.append(mass)
            saved.append(bits)
            truth += [[s in subs for s in range(len(subjects))] for _, _, subs in held]
    if not rows:
        return max(3.0, rules.least_mass), 0.25
    mass, want, saves = np.concatenate(rows), np.array(truth), np.concatenate(saved) > 0
    total = mass.sum(1, keepdims=True)
    best = (-1.0, 3.0, 0.25)
    for t in np.arange(rules.least_mass, 8.1, 0.25):
        for s in np.arange(0.04, 0.45, 0.02):
            got = saves & (mass >= t) & (mass >= s * total)
            f1 = 2 * (got & want).sum() / max(1, got.sum() + want.sum())
            best = max(best, (round(float(f1), 4), float(t), float(s)))
    return best[1], best[2]


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: list[str], rules: SubjectRules = RULES) -> list[tuple[str, str | None, set[str]]]:
    """``(text, lang, subjects)`` of the labelled documents used for training: at most ``most_labelled``, chosen by hash of their id."""
    known = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).select("doc_id", "subject").distinct()
    order = F.xxhash64("doc_id")
    top = known.withColumn("_rank", F.row_number().over(Window.partitionBy("subject").orderBy(order, "doc_id"))).where(F.col("_rank") <= rules.per_subject)
    chosen = top.select("doc_id").distinct().orderBy(order, "doc_id").limit(rules.most_labelled)
    sets = known.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("subject").alias("subs"))
    # at most most_labelled rows of a number and a few names
    rows = documents.select("doc_id", "text", "lang").where(F.length("text").between(1, rules.most_chars)).join(F.broadcast(sets), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "subs")).alias("r"))
    got = sorted(once.select("doc_id", "r.*").collect(), key=lambda r: str(r["doc_id"]))
    return [(r["text"], r["lang"], set(r["subs"])) for r in got]


def _language(c: str = "lang"):
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def language_groups(documents: DataFrame, rules: SubjectRules = RULES) -> dict[str, int]:
    """Numbers, from 1, of the languages that enough documents have; every other is 0."""
    counts = documents.groupBy(_language().alias("l")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("_all")))
    rows = counts.crossJoin(total).where(F.col("n") >= rules.language_share * F.col("_all")).orderBy(F.desc("n"), "l").collect()
    return {r["l"]: i + 1 for i, r in enumerate(rows)}


def _chunks(pdf: pd.DataFrame, groups: dict[str, int], most: int = 4_000_000) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(row numbers, texts, language groups) of runs of rows with together at most ``most`` characters, or one row."""
    texts = [t or "" for t in pdf["text"].to_list()]
    g = np.array([groups.get(x, 0) for x in pdf["_lang"].to_list()], np.int64)
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield np.arange(first, i), texts[first:i], g[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield np.arange(first, len(texts)), texts[first:], g[first:]


def count_background(documents: DataFrame, vocabulary: Vocabulary, pairs: np.ndarray, groups: dict[str, int]) -> Background:
    """Counts of the vocabulary and of the pairs over the whole texts of all documents; every task sends one row per number it met."""
    sc = documents.sparkSession.sparkContext
    sent = sc.broadcast((vocabulary, pairs, groups))
    n, width = vocabulary.size, len(groups) + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, known, of = sent.value
        words, grams = np.zeros(width * n, np.int64), np.zeros(len(known), np.int64)
        for pdf in batches:
            for _, texts, g in _chunks(pdf, of):
                ids = vocab.numbers(text_words(texts))
                text = np.searchsorted(np.nonzero(ids == -2)[0], np.arange(len(ids)))
                ok = ids >= 0
                words += np.bincount(g[text[ok]] * n + ids[ok], minlength=len(words))
                if len(known):
                    code = pairs_of(ids, n)
                    place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    grams += np.bincount(place[known[place] == code], minlength=len(grams))
        for kind, c in ((0, words), (1, grams)):
            at = np.nonzero(c)[0]
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "at": at, "n": c[at]})

    rows = documents.select("text", _language().alias("_lang")).where(F.length("text") > 0).mapInPandas(count, "kind int, at long, n long")
    # at most groups x vocabulary + pairs rows
    total = rows.groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    words, grams = np.zeros(width * n), np.zeros(len(pairs))
    for kind, out in ((0, words), (1, grams)):
        part = total[total["kind"] == kind]
        out[part["at"].to_numpy()] = part["n"].to_numpy()
    words = words.reshape(width, n)
    words[0] = words.sum(0)
    return Background(words, pairs, grams)


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, rules: SubjectRules = RULES) -> tuple[SubjectModel, dict[str, int]]:
    """Model and language groups. The subjects are those of ``areas``, at most 1,000."""
    subjects = [r["subject"] for r in areas.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").limit(1001).collect()]
    if len(subjects) > 1000:
        raise ValueError("more than 1,000 subjects")
    sample = labelled_sample(documents, labels, subjects, rules)
    groups = language_groups(documents, rules)
    cut = [text_words([t])[:-1] for t, _, _ in sample]
    # copies of a labelled document must not make its words look common
    seen: set[tuple] = set()
    fresh = []
    for i, w in enumerate(cut):
        key = (tuple(sorted(set(w))), tuple(sorted(sample[i][2])))
        if key not in seen:
            seen.add(key)
            fresh.append(i)
    vocabulary = Vocabulary.of([cut[i] for i in fresh], rules.least_docs)
    number = {s: i for i, s in enumerate(subjects)}
    docs = [(vocabulary.numbers(cut[i]), groups.get((sample[i][1] or "").strip(" ").lower(), 0), {number[s] for s in sample[i][2]}) for i in fresh]
    background = count_background(documents, vocabulary, known_pairs([d for d, _, _ in docs], vocabulary.size, rules.least_docs), groups)
    model = train(docs, subjects, vocabulary, background, rules)
    model.mass, model.share = calibrate(docs, subjects, vocabulary, background, rules)
    return model, groups


def assign(documents: DataFrame, model: SubjectModel, groups: dict[str, int]) -> DataFrame:
    """``(doc_id, subject, mass, share, bits)``: one row per document and accepted subject.

    ``mass`` is the number of words that speak for the subject, ``share`` its part of all such words of the
    document, ``bits`` what its model saves of the cross-entropy per word. Null and empty texts have no subject. Repeated rows of a document give repeated results.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model, groups))
    schema = T.StructType([documents.schema["doc_id"], T.StructField("subject", T.StringType()), T.StructField("mass", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("bits", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, of = sent.value
        names = np.array(m.subjects, object)
        for pdf in batches:
            docs = pdf["doc_id"].to_numpy()
            for rows, texts, g in _chunks(pdf, of):
                ids = m.vocabulary.numbers(text_words(texts))
                mass, bits = m.mass_of(ids, g)
                length = np.diff(np.concatenate(([-1], np.nonzero(ids == -2)[0]))) - 1
                at, s = np.nonzero(m.accept(mass, bits))
                yield pd.DataFrame({"doc_id": docs[rows[at]], "subject": names[s], "mass": mass[at, s], "share": mass[at, s] / mass.sum(1)[at], "bits": bits[at, s] / length[at]})

    return documents.select("doc_id", "text", _language().alias("_lang")).where(F.length("text") > 0).mapInPandas(score, schema)


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, rules: SubjectRules = RULES) -> DataFrame:
    """Subjects of all documents by models trained on a bounded sample of the labels; see :func:`assign`. Without labels nothing is assigned."""
    model, groups = fit(documents, labels, areas, rules)
    return assign(documents, model, groups)
