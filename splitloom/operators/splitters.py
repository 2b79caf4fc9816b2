"""Searches for a good split, by name.

Every search returns ``SplitResult``: the assignment ``(id, side)``, the history ``(run, iter, total, bits, scores)``, with the score of each
constraint, and the total of the best.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.config import SplitConfig
from splitloom.operators import candidates as cd
from splitloom.operators import graph as gr
from splitloom.operators import kernel as kn
from splitloom.operators.constraints import constraint_scores
from splitloom.operators.dataset import Relation, SplitDataset
from splitloom.operators.edges import class_representatives, classes, tagged
from splitloom.operators.related import related_edges
from splitloom.workspace import Workspace, join_per_key


@dataclass
class SplitResult:
    assignment: DataFrame
    history: DataFrame
    total: float


#: Rows of packed sides, postings times blocks, that one job of the large neighbourhood search makes.
PACKED = 20_000_000
#: Classes of copies whose affinities are held as a dense matrix.
MAX_CLASSES = 4000
_HISTORY = "run int, iter int, total double, bits string, scores array<double>"
REGISTRY: dict[str, Callable[[SplitDataset, SplitConfig], SplitResult]] = {}


def register(name: str):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"splitter {name} exists")
        REGISTRY[name] = fn
        return fn

    return add


def split(ds: SplitDataset, conf: SplitConfig) -> SplitResult:
    """Run the splitter that ``conf`` names (in any case)."""
    name = conf.splitter.lower()
    if name not in REGISTRY:
        raise ValueError(f"unknown splitter {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](ds, conf)


def random_candidates(ds: SplitDataset, n_candidates: int, seed: int) -> tuple[DataFrame, cd.RandomSides | cd.PackedSides]:
    """``(cand_id)`` of the usable candidates, and the members of all."""
    masks = cd.random_masks(ds.postings().select("n", "value").distinct(), n_candidates, seed)
    cands = ds.records.sparkSession.range(n_candidates).select(F.col("id").alias("cand_id")).join(cd.constant_candidates(masks, n_candidates), "cand_id", "left_anti")
    if ds.plain:
        return cands, cd.RandomSides(ds, n_candidates, seed)
    # records near a value belong to its graph, too
    ws = Workspace(ds.records.sparkSession, "random")
    return cands, cd.PackedSides(ws.write(cd.packed_sides(gr.factor_nodes(ds), masks, len(ds.factors))), n_candidates)


@register("random")
def random_search(ds: SplitDataset, conf: SplitConfig) -> SplitResult:
    """Best of 1 + max_iter random candidates, all scored in one job; ties go to the smaller number."""
    n = 1 + (100_000 if conf.max_iter is None else conf.max_iter)
    cands, members = random_candidates(ds, n, conf.seed)
    scores = Workspace(ds.records.sparkSession, "scores").write(constraint_scores(ds, conf.specs, members, cands, conf.constraint_weights))
    best = cd.best_candidate(scores).first()
    if best is None:
        raise ValueError("no usable candidate: a factor has fewer than two values, or max_iter is too small")
    parts = F.array(*[F.col(f"score{i}") for i in range(len(conf.specs))]).cast("array<double>")
    history = scores.select(F.lit(conf.seed).alias("run"), F.col("cand_id").cast("int").alias("iter"), "total", F.lit(None).cast("string").alias("bits"), parts.alias("scores"))
    return SplitResult(members.only(best["cand_id"]), history, best["total"])


def _kernel_result(ds: SplitDataset, k: kn.Kernel, side: np.ndarray, history: list[tuple], run: int, total: float) -> SplitResult:
    spark = ds.records.sparkSession
    kind = ds.records.schema["id"].dataType.simpleString()
    rows = [(i, int(s)) for i, s in zip(k.ids, side) if s >= 0]
    return SplitResult(spark.createDataFrame(rows, f"id {kind}, side int"), spark.createDataFrame([(run, *h) for h in history], _HISTORY), total)


def vns_runs(ds: SplitDataset, conf: SplitConfig, seeds: list[int]) -> tuple[kn.Kernel, DataFrame]:
    """``(run, iter, total, bits, scores, sides)`` of one search per seed, each in a task of its own; ``sides`` stands in the last row of a run."""
    spark = ds.records.sparkSession
    k = kn.load_kernel(ds, conf.specs, conf.constraint_weights)
    sent = spark.sparkContext.broadcast(k)
    args = (200 if conf.max_iter is None else conf.max_iter, conf.num_shake_neighborhoods, conf.num_search_neighborhoods, conf.max_neighbors)

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        side, history = kn.variable_neighbourhood_search(sent.value, int(key[0]), *args)
        out = pd.DataFrame(history, columns=["iter", "total", "bits", "scores"])
        out.insert(0, "run", int(key[0]))
        out["sides"] = [None] * (len(out) - 1) + ["".join("01-"[s] for s in side)]
        return out

    return k, spark.createDataFrame([(s,) for s in seeds], "run int").groupBy("run").applyInPandas(run, f"{_HISTORY}, sides string")


@register("vns")
def vns(ds: SplitDataset, conf: SplitConfig) -> SplitResult:
    """Variable neighbourhood search; in one task for data that fits there, as packed jobs over DataFrames otherwise."""
    if conf.check_complete and gr.is_complete(ds).first()["is_complete"]:
        raise ValueError("every two records share a value: nothing can be held out")
    if gr.factor_nodes(ds).limit(kn.MAX_POSTINGS + 1).count() > kn.MAX_POSTINGS or ds.records.limit(kn.MAX_POSTINGS + 1).count() > kn.MAX_POSTINGS:
        return vns_large(ds, conf)
    k, runs = vns_runs(ds, conf, [conf.seed])
    rows = sorted(runs.collect(), key=lambda r: r["iter"])
    side = np.array(["01-".index(c) for c in rows[-1]["sides"]])
    return _kernel_result(ds, k, np.where(side == 2, -1, side), [(r["iter"], r["total"], r["bits"], r["scores"]) for r in rows], conf.seed, rows[-1]["total"])


def vns_large(ds: SplitDataset, conf: SplitConfig) -> SplitResult:
    """The same search over DataFrames: records stay in tables, the driver holds one bit per factor value and the flips of the neighbours.

    60 neighbours share a BIGINT per value; the blocks of a neighbourhood are scored together as long as they give PACKED rows, one
    group-by over the postings for each job. Equal neighbours in a tie go by number, not by bit text.
    """
    spark, ws = ds.records.sparkSession, Workspace(ds.records.sparkSession, "vns")
    rng = np.random.default_rng(conf.seed)
    postings, seen = ws.write_with(gr.factor_nodes(ds).select("n", "value", "id"), rows=F.count(F.lit(1)))
    values = ws.write(ds.values().select("n", "value", F.col("pos").cast("int").alias("pos")))
    sizes = {r["n"]: r["c"] for r in values.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    if any(sizes.get(n, 0) < 2 for n in range(len(ds.factors))):
        raise ValueError("a factor with fewer than two values cannot be split")
    best = []
    for n in range(len(ds.factors)):
        x = rng.random(sizes[n]) < 0.5
        while x.all() or not x.any():
            x = rng.random(sizes[n]) < 0.5
        best.append(x)

    def masks_of(bits: list[np.ndarray], options: list[list[tuple[int, int]]]) -> DataFrame:
        """``(block, n, value, mask)`` of the choices ``options`` flips away from ``bits``."""
        flip: dict[tuple[int, int, int], int] = {}
        for i, option in enumerate(options):
            for n, j in option:
                for at in (0, 1) if len(bits[n]) == 2 else (j,):
                    flip[i // cd.BLOCK, n, at] = flip.get((i // cd.BLOCK, n, at), 0) | 1 << i % cd.BLOCK
        packed = spark.createDataFrame([(n, np.packbits(x).tobytes()) for n, x in enumerate(bits)], "n int, chosen binary")
        byte = F.conv(F.hex(F.expr("substring(chosen, pos div 8 + 1, 1)")), 16, 10).cast("int")
        on = F.call_function("shiftright", byte, 7 - F.col("pos") % 8).bitwiseAND(1) == 1
        base = values.join(F.broadcast(packed), "n").withColumn("on", on).drop("chosen").crossJoin(F.broadcast(spark.range(-(-len(options) // cd.BLOCK)).toDF("block")))
        change = spark.createDataFrame([(*k, m) for k, m in flip.items()], "block bigint, n int, pos int, flip bigint")
        mask = F.when(F.col("on"), F.lit(cd.FULL)).otherwise(F.lit(0)).cast("bigint").bitwiseXOR(F.coalesce("flip", F.lit(0).cast("bigint")))
        return base.join(F.broadcast(change), ["block", "n", "pos"], "left").select("block", "n", "value", mask.alias("mask"))

    def best_of(bits: list[np.ndarray], options: list[list[tuple[int, int]]]) -> tuple[float, list[tuple[int, int]], list[float]]:
        found = []
        step = cd.BLOCK * max(1, PACKED // max(1, seen["rows"]))
        for a in range(0, len(options), step):
            part = options[a : a + step]
            sides = ws.write(cd.packed_sides(postings, masks_of(bits, part), len(ds.factors)))
            cands = spark.range(len(part)).select(F.col("id").alias("cand_id"))
            top = cd.best_candidate(constraint_scores(ds, conf.specs, cd.PackedSides(sides, len(part)), cands, conf.constraint_weights)).first()
            ws.drop(sides)
            found.append((float(top["total"]), a + top["cand_id"], [top[f"score{i}"] for i in range(len(conf.specs))]))
        total, i, parts = min(found, key=lambda x: x[:2])
        return total, options[i], parts

    def moved(bits: list[np.ndarray], option: list[tuple[int, int]]) -> list[np.ndarray]:
        for at in option:
            bits = kn.flipped(bits, at)
        return bits

    total, _, parts = best_of(best, [[]])
    history = [(conf.seed, 0, total, kn.bit_text(best), parts)]
    for it in range(1, (200 if conf.max_iter is None else conf.max_iter) + 1):
        for depth in range(1, conf.num_shake_neighborhoods + 1):
            shake = kn.sampled_flips(best, depth, 1, rng)
            if not shake:
                continue
            point = moved(best, shake[0])
            low, _, low_parts = best_of(point, [[]])
            found = point
            for near in range(1, conf.num_search_neighborhoods + 1):
                options = kn.sampled_flips(point, near, conf.max_neighbors, rng)
                if options:
                    s, option, s_parts = best_of(point, options)
                    if s < low:
                        found, low, low_parts = moved(point, option), s, s_parts
                        break
            if low < total:
                best, total, parts = found, low, low_parts
                break
        # an incumbent that stays shares its text
        history.append((conf.seed, it, total, history[-1][3] if total == history[-1][2] else kn.bit_text(best), parts))
    sides = cd.packed_sides(postings, masks_of(best, [[]]), len(ds.factors))
    return SplitResult(ws.write(cd.unpack_members(sides, 1).select("id", "side")), spark.createDataFrame(history, _HISTORY), total)


@register("min_node_cut")
def min_node_cut(ds: SplitDataset, conf: SplitConfig) -> SplitResult:
    """Best of 1 + max_iter random minimum node cuts of a connected, incomplete similarity graph; one task per share of the cuts.

    Copies (records with equal values) are one vertex that weighs as many records, shared values are vertices that cannot be cut, so
    the graph has an edge per class and value. It is held in memory: more than MAX_POSTINGS edges are an error. Records stay in tables and
    take the sides of their classes, so there may be any number of them; all cuts are scored in one job.
    """
    spark, ws = ds.records.sparkSession, Workspace(ds.records.sparkSession, "cuts")
    member, sizes, hubs = gr.class_graph(ds)
    hubs = ws.write(hubs)
    if hubs.count() > kn.MAX_POSTINGS or sizes.count() > kn.MAX_POSTINGS:
        raise ValueError(f"a graph of more than {kn.MAX_POSTINGS} edges")
    size: dict[str, float] = {r["class_id"]: r["class_size"] for r in sizes.collect()}
    graph = gr.adjacency([(r["class_id"], r["hub"]) for r in hubs.collect()])
    names = sorted(size)
    for c in names:
        graph.setdefault(c, set())
    if len(gr.plain_components(graph)) > 1:
        raise ValueError("the graph is not connected: split its components instead")
    if all(len(set().union(*(graph[h] for h in graph[c]))) == len(names) for c in names) or len(names) < 2:
        raise ValueError("the graph is complete: nothing can be held out")
    weight = size | {h: np.inf for h in graph if h.startswith(gr.HUB)}
    sent = spark.sparkContext.broadcast((dict(graph), weight, names, np.cumsum([size[c] for c in names])))
    seed, n = conf.seed, 1 + (200 if conf.max_iter is None else conf.max_iter)

    def cuts(batches):
        g, w, classes_, upto = sent.value
        for pdf in batches:
            rows = []
            for it in pdf["id"]:
                rng = np.random.default_rng([seed, int(it)])
                while True:
                    # the classes of two records
                    s, t = (classes_[int(x)] for x in np.searchsorted(upto, rng.integers(upto[-1], size=2), "right"))
                    if s != t and not g[s] & g[t]:
                        break
                train, held = gr.cut_sides(g, gr.minimum_node_cut(g, s, t, w), rng.shuffle)
                rows.append((int(it), "".join("0" if c in train else "1" if c in held else "-" for c in classes_)))
            yield pd.DataFrame(rows, columns=["iter", "sides"])

    found = ws.write(spark.range(n).repartition(min(n, spark.sparkContext.defaultParallelism)).mapInPandas(cuts, "iter int, sides string"))
    kind = sizes.schema["class_id"].dataType.simpleString()
    bit = lambda side: F.bit_or(F.when(F.col("side") == side, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("iter") % cd.BLOCK)).otherwise(F.lit(0).cast("bigint")))
    packed = found.select("iter", F.posexplode(F.split("sides", "")).alias("at", "side")).groupBy("at", F.expr(f"cast(iter div {cd.BLOCK} AS bigint)").alias("block")).agg(bit("0").alias("train"), bit("1").alias("held"))
    packed = packed.join(spark.createDataFrame(list(enumerate(names)), f"at int, class_id {kind}"), "at").groupBy("class_id").agg(F.collect_list(F.struct("block", "train", "held")).alias("_b"))
    sides = join_per_key(member, packed, "class_id", sizes.select("class_id", F.col("class_size").alias("n"))).select("id", F.explode("_b").alias("_b")).select("_b.block", "id", "_b.train", "_b.held")
    members = cd.PackedSides(ws.write(sides), n)
    scores = ws.write(constraint_scores(ds, conf.specs, members, spark.range(n).toDF("cand_id"), conf.constraint_weights))
    best = cd.best_candidate(scores).first()
    parts = F.array(*[F.col(f"score{i}") for i in range(len(conf.specs))]).cast("array<double>")
    history = scores.select(F.lit(seed).alias("run"), F.col("cand_id").cast("int").alias("iter"), "total", F.lit(None).cast("string").alias("bits"), parts.alias("scores"))
    return SplitResult(members.only(best["cand_id"]), history, float(best["total"]))


@register("spectral_clustering")
def spectral(ds: SplitDataset, conf: SplitConfig) -> SplitResult:
    """Largest cluster to train, second largest to the held-out side; the others are unused.

    Affinity: similarity (by default the number of shared values) plus a small constant off the diagonal. Copies are folded into classes of their size and stay together.
    Dense eigenvectors up to MAX_CLASSES classes, however many records; the same matrix by subspace iteration over postings
    (an approximation) beyond. Every record gets a cluster. Ties in size go to the cluster with the smaller member.
    """
    if conf.num_splits < 2:
        raise ValueError("at least two clusters")
    spark, ws = ds.records.sparkSession, Workspace(ds.records.sparkSession, "spectral")
    member = ws.write(classes(ds).select("id", "class_id"))
    reps = ws.write(class_representatives(ds))
    postings, sizes = class_postings(ds, reps)
    small = sizes.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES and postings.limit(kn.MAX_POSTINGS + 1).count() <= kn.MAX_POSTINGS
    if any(r != Relation() for r in ds.relations):
        if not small:
            raise ValueError(f"with similarities other than equal values at most {MAX_CLASSES} classes of copies are clustered")
        label = _spectral_related(ds, ws, reps, conf)
    else:
        label = (_spectral_dense if small else _spectral_large)(ws, ws.write(postings), ws.write(sizes), conf)
    rows = ws.write(member.join(label, "class_id").select("id", "cluster"))
    ranked = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("m")).orderBy(F.desc("c"), "m").limit(2).collect()
    side = spark.createDataFrame([(r["cluster"], s) for s, r in enumerate(ranked)], "cluster int, side int")
    out = ws.write(rows.join(F.broadcast(side), "cluster").select(F.lit(0).cast("bigint").alias("cand_id"), "id", "side"))
    top = constraint_scores(ds, conf.specs, out, spark.range(1).toDF("cand_id"), conf.constraint_weights).first()
    row = (conf.seed, 0, float(top["total"]), None, [top[f"score{i}"] for i in range(len(conf.specs))])
    return SplitResult(out.select("id", "side"), spark.createDataFrame([row], _HISTORY), float(top["total"]))


def class_postings(ds: SplitDataset, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(class_id, v)``, the values of classes, and ``(class_id, s, own)``, their records and number of values."""
    tags = F.concat(*[F.transform(f, tagged(n)) for n, f in enumerate(ds.factors)])
    return reps.select("class_id", F.explode(tags).alias("v")), reps.select("class_id", F.col("class_size").cast("double").alias("s"), F.size(tags).cast("double").alias("own"))


def _spectral_dense(ws: Workspace, postings: DataFrame, sizes: DataFrame, conf: SplitConfig) -> DataFrame:
    rows = sizes.orderBy("class_id").collect()
    at = {r["class_id"]: i for i, r in enumerate(rows)}
    values: dict[str, int] = {}
    pairs = [(at[r["class_id"]], values.setdefault(r["v"], len(values))) for r in postings.orderBy("v", "class_id").toLocalIterator()]
    where = np.array(pairs, np.int64).reshape(-1, 2)
    label = kn.folded_labels(where[:, 0], where[:, 1], np.array([r["s"] for r in rows]), conf.spectral_smoothing, min(conf.num_splits, len(rows)), conf.seed)
    return ws.spark.createDataFrame([(r["class_id"], int(c)) for r, c in zip(rows, label)], f"class_id {sizes.schema['class_id'].dataType.simpleString()}, cluster int")


def _spectral_related(ds: SplitDataset, ws: Workspace, reps: DataFrame, conf: SplitConfig) -> DataFrame:
    """The dense way with the similarities and weights of the dataset."""
    rows = reps.select("class_id", F.col("class_size").cast("double").alias("s"), *[F.size(f).alias(f"n{i}") for i, f in enumerate(ds.factors)]).orderBy("class_id").collect()
    at = {r["class_id"]: i for i, r in enumerate(rows)}
    shared = np.zeros((len(rows), len(rows)))
    for r in related_edges(ds, reps).toLocalIterator():
        shared[at[r["src"]], at[r["dst"]]] = shared[at[r["dst"]], at[r["src"]]] = r["capacity"]
    for i, r in enumerate(rows):
        shared[i, i] = sum(x.weight * (r[f"n{n}"] if x.name == "set_intersection" else float(r[f"n{n}"] > 0)) for n, x in enumerate(ds.relations))
    label = kn.affinity_labels(shared, np.array([r["s"] for r in rows]), conf.spectral_smoothing, min(conf.num_splits, len(rows)), conf.seed)
    return ws.spark.createDataFrame([(r["class_id"], int(c)) for r, c in zip(rows, label)], f"class_id {reps.schema['class_id'].dataType.simpleString()}, cluster int")


def _spectral_large(ws: Workspace, postings: DataFrame, sizes: DataFrame, conf: SplitConfig, rounds: int = 60) -> DataFrame:
    """``(class_id, cluster)`` without pairs of classes: a product with the affinity is a sum per value and a sum per class.

    The first eigenvector is known (the root of the degrees); the others are found by at most ``rounds`` rounds of subspace iteration.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k, smooth = conf.num_splits, conf.spectral_smoothing
    holders = ws.write(postings.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    n = sizes.agg(F.sum("s")).first()[0]

    def over_values(x: DataFrame, names: list[str]) -> DataFrame:
        """Per class the sums over its values of the sums over their holders."""
        per = postings.join(x, "class_id").groupBy("v").agg(*[F.sum(c).alias(c) for c in names])
        return join_per_key(postings, per, "v", holders).groupBy("class_id").agg(*[F.sum(c).alias(f"_{c}") for c in names])

    d = F.coalesce("_s", F.lit(0.0)) + smooth * n - F.col("own") - smooth
    base = sizes.join(over_values(sizes.select("class_id", "s"), ["s"]), "class_id", "left").withColumn("d", d).drop("_s")
    base = ws.write(base.withColumn("d", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)))
    cols = [f"x{j}" for j in range(k)]
    noise = [(F.xxhash64(F.lit(conf.seed), F.lit(j), "class_id") / F.lit(2.0**63)).alias(f"x{j}") for j in range(1, k)]
    x = ws.write(base.select("*", F.sqrt(F.col("s") * F.col("d")).alias("x0"), *noise))
    turn, scale = _orthonormal(x, cols), F.sqrt(F.col("s") / F.col("d"))
    for _ in range(rounds):
        x = x.select("class_id", "s", "own", "d", *turn)
        y = x.select("class_id", *[(scale * F.col(c)).alias(c) for c in cols])
        every = x.agg(*[F.sum(scale * F.col(c)) for c in cols]).first()
        near = x.join(over_values(y, cols), "class_id", "left")
        # one is added to the diagonal: the eigenvalues lie between -1 and 1, and those next to 1 are wanted
        step = [(scale * (F.coalesce(f"_{c}", F.lit(0.0)) + smooth * e) + (1 - (F.col("own") + smooth) / F.col("d")) * F.col(c)).alias(f"z{c[1:]}") for c, e in zip(cols, every)]
        z = ws.write(near.select("class_id", "s", "own", "d", *cols, *step))
        new = [f"z{j}" for j in range(k)]
        seen = z.agg(*[F.sum(F.col(a) * F.col(b)) for a in cols for b in new], *[F.sum(F.col(b) * F.col(b)) for b in new]).first()
        left = 1 - sum(v * v for v in seen[: k * k]) / max(sum(seen[k * k :]), 1e-300)
        x = z.select("class_id", "s", "own", "d", *[F.col(b).alias(c) for b, c in zip(new, cols)])
        turn = _orthonormal(x, cols)
        if left < 1e-10:
            break
    long = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    points = ws.write(x.select("class_id", "s", *turn).select("class_id", "s", F.transform(F.array(*cols), lambda v: v / F.greatest(long, F.lit(1e-12))).alias("p")))
    points = points.select("class_id", "s", array_to_vector("p").alias("features"))
    models = [KMeans(k=k, seed=conf.seed + i, maxIter=100, weightCol="s").fit(points) for i in range(3)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(points).select("class_id", F.col("prediction").alias("cluster"))


def _orthonormal(x: DataFrame, cols: list[str]) -> list[Column]:
    """Columns that are combinations of ``cols`` with length one over all rows and at right angles."""
    k = len(cols)
    sums = x.agg(*[F.sum(F.col(a) * F.col(b)) for a in cols for b in cols]).first()
    gram = np.array(list(sums), float).reshape(k, k)
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    low = np.linalg.inv(np.linalg.cholesky(gram / size[:, None] / size[None, :] + 1e-13 * np.eye(k))) / size[None, :]
    return [sum((float(low[j, i]) * F.col(cols[i]) for i in range(j + 1)), F.lit(0.0)).alias(c) for j, c in enumerate(cols)]


@register("disconnected")
def disconnected(ds: SplitDataset, conf: SplitConfig) -> SplitResult:
    """Random search over components instead of values: no leftover records. A connected dataset is an error."""
    comp = Workspace(ds.records.sparkSession, "disconnected").write(gr.record_components(ds, numbered=False))
    if comp.select("root").distinct().limit(2).count() < 2:
        raise ValueError("the dataset has one component")
    roots = ds.records.join(comp, "id").withColumn("component", F.array("root")).drop("root")
    over = SplitDataset(roots, (*ds.fields, "component"), ("component",), ds.constraints, ds.weighting)  # a component is related to itself only
    return random_search(over, conf)


def multi_seed(ds: SplitDataset, conf: SplitConfig, jobs: int) -> DataFrame:
    """``(run, iter, total, bits, scores, sides)`` of vns for the seeds 0 to ``jobs``, that is jobs + 1 runs, one task each."""
    return vns_runs(ds, conf, list(range(jobs + 1)))[1]


def best_of_seeds(ds: SplitDataset, conf: SplitConfig, jobs: int) -> SplitResult:
    """The best of the runs of the configured splitter for the seeds 0 to ``jobs`` (jobs + 1 runs), ties to the smaller seed, with the history of all.

    Runs of vns on data that fits a task are tasks side by side; others follow one another.
    """
    if conf.splitter.lower() == "vns":
        nodes = gr.factor_nodes(ds).limit(kn.MAX_POSTINGS + 1).count()
        if nodes <= kn.MAX_POSTINGS and ds.records.limit(kn.MAX_POSTINGS + 1).count() <= kn.MAX_POSTINGS:
            k, runs = vns_runs(ds, conf, list(range(jobs + 1)))
            rows = sorted(runs.collect(), key=lambda r: (r["run"], r["iter"]))
            last = min((r for r in rows if r["sides"] is not None), key=lambda r: (r["total"], r["run"]))
            side = np.array(["01-".index(c) for c in last["sides"]])
            out = _kernel_result(ds, k, np.where(side == 2, -1, side), [], last["run"], last["total"])
            return SplitResult(out.assignment, ds.records.sparkSession.createDataFrame([(r["run"], r["iter"], r["total"], r["bits"], r["scores"]) for r in rows], _HISTORY), last["total"])
    found = [split(ds, replace(conf, seed=s)) for s in range(jobs + 1)]
    history = found[0].history
    for r in found[1:]:
        history = history.unionByName(r.history)
    best = min(found, key=lambda r: r.total)
    return SplitResult(best.assignment, history, best.total)
