"""Split search inside one task, for datasets small enough to be held there.

Neighbourhood search and spectral clustering are sequential. For data up to MAX_POSTINGS postings they run on
numpy arrays, many seeds side by side as tasks; larger data takes the DataFrame searches in ``splitters``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from splitloom.config import ConstraintSpec
from splitloom.operators.constraints import WORST_SCORE, constraint, kl_divergence, reduce_values
from splitloom.operators.dataset import SplitDataset
from splitloom.operators.related import related_nodes

MAX_POSTINGS = 2_000_000


@dataclass
class Kernel:
    """``record[n], value[n]``: postings of factor n by number; ``numeric[i]`` and ``coded[i]`` hold constraint i."""

    ids: list[str]
    values: list[list[str]]
    record: list[np.ndarray]
    value: list[np.ndarray]
    weight: np.ndarray
    numeric: dict[int, np.ndarray]
    coded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list]]
    specs: tuple[ConstraintSpec, ...]
    cweights: tuple[float, ...]

    def __post_init__(self):
        n = len(self.ids)
        self.degree = [np.bincount(r, minlength=n) for r in self.record]

    def sides(self, bits: list[np.ndarray]) -> np.ndarray:
        """0, 1 or -1 for every record."""
        n = len(self.ids)
        a, b = np.ones(n, bool), np.ones(n, bool)
        for r, v, d, x in zip(self.record, self.value, self.degree, bits):
            hit = np.bincount(r, x[v], n)
            a &= (hit == d) & (d > 0)
            b &= (hit == 0) & (d > 0)
        return np.where(a, 0, np.where(b, 1, -1))

    def stat(self, i: int, who: np.ndarray) -> float:
        """Statistic of constraint ``i`` over a set of records given as a mask."""
        s = self.specs[i]
        if i in self.numeric:
            r = self.numeric[i]
            ok = who & ~np.isnan(r)
            if constraint(s.name).stat == "sum":
                return float(r[ok].sum())
            return float((self.weight[ok] * r[ok]).sum() / self.weight[ok].sum()) if ok.any() else float("nan")
        rec, val, w, vocab = self.coded[i]
        c = np.bincount(val[who[rec]], w[who[rec]], len(vocab))
        c = c[c > 0]
        if len(c) <= 1:
            return 1.0
        p = c / c.sum()
        return float(1 + (p * np.log(p)).sum() / np.log(len(c)))

    def distribution(self, i: int, who: np.ndarray, smooth: float) -> np.ndarray:
        rec, val, w, vocab = self.coded[i]
        c = np.bincount(val[who[rec]], w[who[rec]], len(vocab))
        return (c + smooth) / (c.sum() + smooth * len(vocab))

    def score(self, side: np.ndarray) -> tuple[float, list[float]]:
        a, b = side == 0, side == 1
        if not a.any() or not b.any():
            return WORST_SCORE, [float("nan")] * len(self.specs)
        out = []
        for i, s in enumerate(self.specs):
            v = s.values
            if s.name in ("kl", "kl_tuple"):
                p, q = (self.distribution(i, x, float(v.get("smooth", 1e-6))) for x in (a, b))
                way = v.get("direction", "forward")
                if s.name == "kl":
                    out.append(kl_divergence(p, q, way))
                else:
                    at = [list(v["vocab"]).index(x) for x in self.coded[i][3]]
                    t = [np.array(d, float)[at] for d in v["dist"]]
                    out.append(kl_divergence(t[0], p, way) + kl_divergence(t[1], q, way))
                continue
            x, y = self.stat(i, a), self.stat(i, b)
            if s.name == "max_entropy":
                w = v or [0.0, 1.0]
                out.append(w[0] * x + w[1] * y)
            elif s.name in ("mean", "sum"):
                out.append(abs(x - y))
            else:
                t, power = (v["values"], v.get("power", 1.0)) if isinstance(v, dict) else (v, 1.0)
                out.append(abs(x - t[0]) ** power + abs(y - t[1]) ** power)
        total = sum(w * x for w, x in zip(self.cweights, out))
        return (total if total == total else WORST_SCORE), out


def load_kernel(ds: SplitDataset, specs: tuple[ConstraintSpec, ...], cweights: tuple[float, ...]) -> Kernel:
    """The dataset as arrays; refuses data with more than MAX_POSTINGS postings or records."""
    fields = tuple(ds.factors)
    nodes = ds.postings().select("n", "value", "id") if ds.plain else related_nodes(ds)
    if nodes.limit(MAX_POSTINGS + 1).count() > MAX_POSTINGS or ds.records.limit(MAX_POSTINGS + 1).count() > MAX_POSTINGS:
        raise ValueError(f"more than {MAX_POSTINGS} postings: use the DataFrame searches")
    w = F.aggregate(F.coalesce("weights", F.array(F.lit(1.0))), F.lit(0.0), lambda s, x: s + x) if ds.weighting == "weighted" else F.lit(1.0)
    numeric = [i for i, s in enumerate(specs) if constraint(s.name).kind == "numeric"]
    cols = [reduce_values(ds.records, ds.constraints[i], specs[i].reduction, ds.weighting).alias(f"r{i}") for i in numeric]
    rows = ds.records.select("id", w.alias("w"), *cols).orderBy("id").collect()
    ids = [r["id"] for r in rows]
    at = {x: i for i, x in enumerate(ids)}
    values, record, value = [], [], []
    # values in the order of their positions
    order = [(r["n"], r["value"]) for r in ds.values().orderBy("n", "pos").select("n", "value").collect()]
    held = [(r["n"], r["value"], at[r["id"]]) for r in nodes.collect()]
    for n in range(len(fields)):
        values.append([v for k, v in order if k == n])
        number = {v: i for i, v in enumerate(values[-1])}
        mine = sorted((i, number[v]) for k, v, i in held if k == n)
        record.append(np.array([i for i, _ in mine], np.int64))
        value.append(np.array([v for _, v in mine], np.int64))
    coded = {}
    for i, s in enumerate(specs):
        if i not in numeric:
            long = ds.constraint_rows(i).collect()
            vocab = list((s.values or {}).get("vocab") or []) if isinstance(s.values, dict) else []
            vocab = vocab or sorted({r["value"] for r in long})
            number = {v: j for j, v in enumerate(vocab)}
            long = [r for r in long if r["value"] in number]
            coded[i] = (np.array([at[r["id"]] for r in long], np.int64), np.array([number[r["value"]] for r in long], np.int64), np.array([r["weight"] if ds.weighting == "weighted" else 1.0 for r in long], float), vocab)
    return Kernel(ids, values, record, value, np.array([r["w"] for r in rows], float), {i: np.array([np.nan if r[f"r{i}"] is None else r[f"r{i}"] for r in rows], float) for i in numeric}, coded, tuple(specs), tuple(cweights))


def random_bits(k: Kernel, rng: np.random.Generator) -> list[np.ndarray]:
    """Per factor a random choice of values, never all or none."""
    out = []
    for v in k.values:
        if len(v) < 2:
            raise ValueError("a factor with fewer than two values cannot be split")
        while True:
            x = rng.random(len(v)) < 0.5
            if x.any() and not x.all():
                out.append(x)
                break
    return out


def flips(bits: list[np.ndarray]) -> list[tuple[int, int]]:
    """(factor, value) whose flip leaves a choice that is neither all nor none; of two values the swap stands once."""
    out = []
    for n, x in enumerate(bits):
        if len(x) == 2:
            out.append((n, 0))
        else:
            s = int(x.sum())
            out += [(n, j) for j in range(len(x)) if not (x[j] and s == 1) and not (not x[j] and s == len(x) - 1)]
    return out


def flipped(bits: list[np.ndarray], at: tuple[int, int]) -> list[np.ndarray]:
    n, j = at
    x = ~bits[n] if len(bits[n]) == 2 else bits[n].copy()
    if len(bits[n]) != 2:
        x[j] = ~x[j]
    return [x if i == n else b for i, b in enumerate(bits)]


def neighbours_at(bits: list[np.ndarray], depth: int, most: int, rng: np.random.Generator) -> list[list[np.ndarray]]:
    """Up to ``most`` distinct choices exactly ``depth`` flips away: all of them for depth 1 if they fit, else seeded random walks."""
    if depth == 1:
        way = flips(bits)
        rng.shuffle(way)
        return [flipped(bits, tuple(w)) for w in way[:most]]
    out, seen = [], set()
    for _ in range(4 * most):
        cur = bits
        used: set = set()
        for _ in range(depth):
            way = [w for w in flips(cur) if w not in used]
            if not way:
                break
            w = way[int(rng.integers(len(way)))]
            used.add(w)
            cur = flipped(cur, w)
        key = b"".join(np.packbits(x).tobytes() for x in cur)
        if key not in seen and len(used) == depth:
            seen.add(key)
            out.append(cur)
        if len(out) >= most:
            break
    return out


def sampled_flips(bits: list[np.ndarray], depth: int, most: int, rng: np.random.Generator) -> list[list[tuple[int, int]]]:
    """What to flip for up to ``most`` distinct choices exactly ``depth`` flips away, as ``neighbours_at``, without a list of all values per step."""
    sizes = [1 if len(x) == 2 else len(x) for x in bits]
    first = np.concatenate(([0], np.cumsum(sizes)))
    if depth == 1 and first[-1] <= most:
        way = flips(bits)
        rng.shuffle(way)
        return [[tuple(int(x) for x in w)] for w in way]
    chosen = [int(x.sum()) for x in bits]
    out, seen = [], set()
    for _ in range(4 * most):
        count, used = list(chosen), []
        for _ in range(50 * depth):
            g = int(rng.integers(first[-1]))
            n = int(np.searchsorted(first, g, "right")) - 1
            j = g - int(first[n])
            if (n, j) in used:
                continue
            if len(bits[n]) != 2:
                c = count[n] + (-1 if bits[n][j] else 1)
                if not 0 < c < len(bits[n]):
                    continue
                count[n] = c
            used.append((n, j))
            if len(used) == depth:
                break
        key = frozenset(used)
        if len(used) == depth and key not in seen:
            seen.add(key)
            out.append(used)
        if len(out) >= most:
            break
    return out


def bit_text(bits: list[np.ndarray]) -> str:
    return "|".join("".join("1" if x else "0" for x in b) for b in bits)


def variable_neighbourhood_search(k: Kernel, seed: int, max_iter: int, shakes: int, searches: int, most: int) -> tuple[np.ndarray, list[tuple[int, float, str, list[float]]]]:
    """Best sides and the incumbent's (iteration, total, bits, score of each constraint) after every iteration.

    Each iteration shakes the incumbent by 1, 2, ... flips, searches growing neighbourhoods of the shaken point for a better
    one, and moves to it when it also beats the incumbent.
    """
    rng = np.random.default_rng(seed)
    best = random_bits(k, rng)
    total, parts = k.score(k.sides(best))
    history = [(0, total, bit_text(best), parts)]
    for it in range(1, max_iter + 1):
        for depth in range(1, shakes + 1):
            shaken = neighbours_at(best, depth, 1, rng)
            if not shaken:
                continue
            point, value = shaken[0], k.score(k.sides(shaken[0]))[0]
            found, low = point, value
            for near in range(1, searches + 1):
                options = [(k.score(k.sides(o))[0], bit_text(o), o) for o in neighbours_at(point, near, most, rng)]
                if options:
                    s, _, o = min(options, key=lambda x: x[:2])
                    if s < low:
                        found, low = o, s
                        break
            if low < total:
                best = found
                total, parts = k.score(k.sides(best))
                break
        history.append((it, total, bit_text(best), parts))
    return k.sides(best), history


def exhaustive_search(k: Kernel) -> tuple[float, list[str]]:
    """Least total over all choices of a tiny dataset, and the bit texts that reach it."""
    import itertools

    options = [[np.array([c == "1" for c in format(i, f"0{len(v)}b")]) for i in range(1, 2 ** len(v) - 1)] for v in k.values]
    best, where = WORST_SCORE + 1, []
    for bits in itertools.product(*options):
        s = k.score(k.sides(list(bits)))[0]
        if s < best - 1e-12:
            best, where = s, []
        if abs(s - best) <= 1e-12:
            where.append(bit_text(list(bits)))
    return best, where


def spectral_labels(affinity: np.ndarray, clusters: int, seed: int = 0) -> np.ndarray:
    """Cluster of each vertex: k-means on the leading eigenvectors of the normalised affinity matrix."""
    n = len(affinity)
    d = affinity.sum(1)
    scale = 1 / np.sqrt(np.where(d > 0, d, 1))
    _, vectors = np.linalg.eigh(affinity * scale[:, None] * scale[None, :])
    return k_means(vectors[:, -clusters:], clusters, seed)


def folded_labels(record: np.ndarray, value: np.ndarray, sizes: np.ndarray, smoothing: float, clusters: int, seed: int = 0) -> np.ndarray:
    """Cluster of each class of copies, the same as over its records: postings ``(record, value)`` of classes of ``sizes`` records each.

    The affinity of two records is the number of values they share plus ``smoothing``. Its leading eigenvectors are equal on copies, so
    they are those of a matrix over classes, where a class of s copies has a vertex weight of s.
    """
    m = len(sizes)
    holds = np.zeros((m, int(value.max(initial=-1)) + 1)) if m * (int(value.max(initial=-1)) + 1) <= 20_000_000 else None
    if holds is not None:
        holds[record, value] = 1
        shared = holds @ holds.T
    else:
        shared = np.zeros((m, m))
        order = np.argsort(value, kind="stable")
        for rows in np.split(record[order], np.nonzero(np.diff(value[order]))[0] + 1):
            shared[np.ix_(rows, rows)] += 1
    return affinity_labels(shared, sizes, smoothing, clusters, seed)


def affinity_labels(shared: np.ndarray, sizes: np.ndarray, smoothing: float, clusters: int, seed: int = 0) -> np.ndarray:
    """The same from the similarities of classes; the diagonal holds that of two copies."""
    own = np.diag(shared) + smoothing
    d = (shared + smoothing) @ sizes - own
    scale = np.sqrt(sizes / np.where(d > 0, d, 1))
    _, vectors = np.linalg.eigh((shared + smoothing) * scale[:, None] * scale[None, :] - np.diag(own / np.where(d > 0, d, 1)))
    return k_means(vectors[:, -clusters:], clusters, seed, sizes)


def k_means(x: np.ndarray, clusters: int, seed: int = 0, weight: np.ndarray | None = None) -> np.ndarray:
    """Cluster of each row, rows scaled to length one; best of ten starts."""
    n = len(x)
    w = np.ones(n) if weight is None else weight
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(n, int))
    for _ in range(10):
        centre = x[[int(rng.integers(n))]]
        while len(centre) < clusters:
            far = w * ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.vstack([centre, x[int(rng.choice(n, p=far / far.sum()))] if far.sum() > 0 else x[int(rng.integers(n))]])
        for _ in range(100):
            label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.stack([np.average(x[label == c], axis=0, weights=w[label == c]) if (label == c).any() else centre[c] for c in range(clusters)])
            if np.allclose(new, centre):
                break
            centre = new
        cost = (w[:, None] * (x - centre[label]) ** 2).sum()
        if cost < best[0] - 1e-12:
            best = (cost, label)
    return best[1]
