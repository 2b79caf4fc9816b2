"""Which records are related, by the similarity of each factor.

Every similarity is held at the level of distinct values: who holds a value, and which values are near each other. Components,
candidates and overlaps need no pairs of records; only the similarity graph itself has edges, between classes of copies.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.functions.similarity import mean_of
from splitloom.operators.dataset import SplitDataset, flat_values, vector_texts
from splitloom.operators.edges import cosine_edges, gaussian_edges, levenshtein_edges
from splitloom.workspace import Workspace, join_per_key

#: Holders of a value that one block of pairs is made of.
HOLDERS = 500
#: Pairs that a task looks at, as far as MAX_TASKS goes.
PAIRS, MAX_TASKS = 1_000_000, 10_000
#: Values of a set that a row carries along when pairs are scored.
WIDE = 32


def compared_values(ds: SplitDataset, n: int) -> Column:
    """``array<string>``: what factor ``n`` of a record is compared by.

    The values for set_intersection and levenshtein, the whole set as one text for boolean, the mean for gaussian, the vectors as texts for cosine.
    """
    f, name = ds.factors[n], ds.relations[n].name
    values = flat_values(ds.records, f)
    if name == "boolean":
        return F.when(F.size(values) > 0, F.array(F.to_json(F.struct(F.array_sort(values).alias("v"))))).otherwise(F.array().cast("array<string>"))
    if name == "gaussian":
        numbers = F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
        return F.when(F.size(numbers) > 0, F.array(mean_of(numbers).cast("string"))).otherwise(F.array().cast("array<string>"))
    if name == "cosine":
        return vector_texts(ds.records, f)
    return F.transform(values, lambda x: x.cast("string"))


def near_values(values: DataFrame, name: str, thresh: float) -> DataFrame | None:
    """``(value, other, sim)``: pairs of different values of ``values(value)`` that are similar, in both orders; None where only equal ones are."""
    if name == "gaussian":
        # one number may be spelled in several ways: numbers are compared, texts that spell them meet
        numbers = values.select("value", F.col("value").try_cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
        x = numbers.select("x").distinct()
        edges = gaussian_edges(x.select(F.col("x").alias("id"), "x"), thresh).union(x.select("x", "x", F.lit(1.0)))
        src, dst = numbers.select(F.col("value").alias("src"), F.col("x").alias("a")), numbers.select(F.col("value").alias("dst"), F.col("x").alias("b"))
        edges = edges.toDF("a", "b", "capacity").join(src, "a").join(dst, "b").where("a <> b OR src < dst").select("src", "dst", "capacity")
    elif name == "levenshtein":
        edges = levenshtein_edges(values.select(F.col("value").alias("id"), "value"), thresh)
    elif name == "cosine":
        vector = F.from_json("value", "v array<double>")["v"]
        edges = cosine_edges(values.select(F.col("value").alias("id"), vector.alias("vector")), thresh)
    else:
        return None
    return edges.select(F.col("src").alias("value"), F.col("dst").alias("other"), F.col("capacity").alias("sim")).union(edges.select("dst", "src", "capacity"))


def holders(ds: SplitDataset, n: int, rows: DataFrame | None = None) -> DataFrame:
    """``(value, id)``: what records (or ``rows`` of the dataset) are compared by in factor ``n``."""
    return (rows or ds.records).select(F.explode(compared_values(ds, n)).alias("value"), "id")


def related_ties(ds: SplitDataset, ws: Workspace) -> DataFrame:
    """``(src, dst)``: edges with the components of the similarity graph. Holders of a value are tied to the smallest of them, and these where
    their values are near; no pairs of records are formed."""
    out = None
    for n, r in enumerate(ds.relations):
        held = ws.write(holders(ds, n))
        first = ws.write(held.groupBy("value").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
        ties = join_per_key(held, first.select("value", "first"), "value", first.select("value", "n")).select(F.col("id").alias("src"), F.col("first").alias("dst"))
        near = near_values(first.select("value"), r.name, r.thresh)
        if near is not None:
            one = near.where("value < other").join(first.select("value", F.col("first").alias("src")), "value")
            ties = ties.union(one.join(first.select(F.col("value").alias("other"), F.col("first").alias("dst")), "other").select("src", "dst"))
        out = ties if out is None else out.union(ties)
    return out


def related_nodes(ds: SplitDataset) -> DataFrame:
    """``(n, value, id)``: the records of each value's graph, its owners and the records that are similar to it."""
    own = ds.postings().select("n", "value", "id")
    ws = Workspace(ds.records.sparkSession, "nodes")
    for n, r in enumerate(ds.relations):
        if r.name in ("set_intersection", "boolean"):
            continue
        held = ws.write(holders(ds, n))
        mine = own.where(F.col("n") == n).select("value")
        near = near_values(ws.write(mine.union(held.select("value")).distinct()), r.name, r.thresh)
        near = near.join(mine.distinct(), "value", "left_semi")
        if r.name == "gaussian":
            # a value is near a record whose mean it equals, though the record may not hold it
            near = near.select("value", "other").union(mine.distinct().select("value", F.col("value").alias("other")))
        own = own.union(near.select("value", "other").join(held.withColumnRenamed("value", "other"), "other").select(F.lit(n).alias("n"), "value", "id"))
    return own.distinct()


def _band(x: Column, thresh: float, step: int = 0) -> Column:
    """The number of a mean's band of the width within which gaussian similarity lies above ``thresh``, as text."""
    if not 0 < thresh < 1:
        raise ValueError("the threshold lies between 0 and 1")
    return (F.floor(x / F.lit(math.sqrt(-math.log(thresh)))).cast("double") + step).cast("string")


def _meet(left: DataFrame, right: DataFrame, ws: Workspace) -> DataFrame:
    """Rows of ``left(key, src, ...)`` beside those of ``right(key, dst, ...)`` with the same key, however many hold it.

    Holders of a key in ``right`` are dealt to blocks of HOLDERS, each of which meets those in ``left`` in a place of its own; there is a task for every PAIRS pairs.
    """
    n = left.groupBy("key").agg(F.count(F.lit(1)).alias("_a")).join(right.groupBy("key").agg(F.count(F.lit(1)).alias("_b")), "key")
    sizes, seen = ws.write_with(n, pairs=F.coalesce(F.sum(F.col("_a").cast("double") * F.col("_b")), F.lit(0.0)))
    hot = sizes.where(F.col("_b") > HOLDERS).select("key", F.ceil(F.col("_b") / HOLDERS).cast("int").alias("_n"))
    tasks = int(min(MAX_TASKS, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen["pairs"] // PAIRS)))
    blocks = F.coalesce("_n", F.lit(1))
    a = left.join(hot, "key", "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_n")
    b = right.join(hot, "key", "left").withColumn("_block", F.pmod(F.xxhash64("dst"), blocks).cast("int")).drop("_n")
    return a.repartition(tasks, "key", "_block").join(b.repartition(tasks, "key", "_block"), ["key", "_block"]).drop("_block")


def similar_pairs(ds: SplitDataset, left: DataFrame, right: DataFrame, ws: Workspace, ordered: bool = True) -> DataFrame:
    """``(src, dst, capacity)`` for a row of ``left`` and another of ``right`` (rows of the dataset, by id) with a similarity above 0: the weighted sum over
    factors. ``ordered``: pairs with src < dst only.

    A row carries what it is compared by, so that each pair is scored where it is met and kept at the first key that it has in common: no pairs are
    shuffled. Texts, vectors and sets of more than WIDE values are compared value by value, and the values of a pair are summed by a group-by.
    """
    way = F.col("src") < F.col("dst") if ordered else F.col("src") != F.col("dst")
    light = all(r.name in ("set_intersection", "boolean", "gaussian") for r in ds.relations)
    if light:
        most = F.greatest(F.lit(0), *[F.size(compared_values(ds, n)) for n in range(len(ds.factors))])
        light = (right.select(F.max(most).alias("k")).first()["k"] or 0) <= WIDE
    return (_pairs_by_row if light else _pairs_by_value)(ds, left, right, ws, way).where("capacity > 0")


def _named(n: int, value: Column) -> Column:
    """A key that no other factor has."""
    return F.concat(F.lit(f"{n}:"), value)


def _pairs_by_row(ds: SplitDataset, left: DataFrame, right: DataFrame, ws: Workspace, way: Column) -> DataFrame:
    number = lambda c: F.get(c, F.lit(0)).cast("double")

    def side(rows: DataFrame, name: str, tag: str, steps: tuple[int, ...]) -> DataFrame:
        cols, keys = [], []
        for n, r in enumerate(ds.relations):
            c, named = F.col(f"_c{n}"), partial(_named, n)
            cols.append((number(compared_values(ds, n)) if r.name == "gaussian" else compared_values(ds, n)).alias(f"_c{n}"))
            keys.append(F.when(c.isNotNull(), F.array_distinct(F.array(*[named(_band(c, r.thresh, i)) for i in steps]))).otherwise(F.array().cast("array<string>")) if r.name == "gaussian" else F.transform(c, named))
        got = rows.select(F.col("id").alias(name), *cols)
        return got.select(name, *[F.col(f"_c{n}").alias(f"{tag}{n}") for n in range(len(cols))], F.explode(F.concat(*keys)).alias("key"))

    met = _meet(side(left, "src", "_l", (-1, 0, 1)), side(right, "dst", "_r", (0,)), ws)
    first, total = [], F.lit(0.0)
    for n, r in enumerate(ds.relations):
        a, b = F.col(f"_l{n}"), F.col(f"_r{n}")
        if r.name == "gaussian":
            v = F.when(a == b, 1.0).otherwise(F.exp(-F.pow(a - b, F.lit(2.0))))
            sim, key = F.when(v > r.thresh, v).otherwise(0.0), _band(b, r.thresh)
        elif r.name == "boolean":
            sim, key = F.when((F.size(a) > 0) & (a == b), 1.0).otherwise(0.0), F.get(a, F.lit(0))
        else:
            sim, key = F.size(F.array_intersect(a, b)).cast("double"), F.array_min(F.array_intersect(a, b))
        first.append(F.when(sim > 0, _named(n, key)))
        total = total + F.lit(float(r.weight)) * sim
    return met.where(way & (F.col("key") == F.coalesce(*first))).select("src", "dst", total.alias("capacity"))


def _pairs_by_value(ds: SplitDataset, left: DataFrame, right: DataFrame, ws: Workspace, way: Column) -> DataFrame:
    out = None
    for n, r in enumerate(ds.relations):
        a, b = (ws.write(holders(ds, n, rows)) for rows in (left, right))
        one, other = a.select("value", F.col("value").alias("key"), F.col("id").alias("src"), F.lit(1.0).alias("sim")), b.select(F.col("value").alias("key"), F.col("id").alias("dst"))
        near = near_values(a.select("value").union(b.select("value")).distinct(), r.name, r.thresh)
        if near is not None:
            one = one.unionByName(one.drop("key", "sim").join(near, "value").withColumnRenamed("other", "key"))
        # a pair may be met by several values
        best = F.sum("sim") if r.name == "set_intersection" else F.max("sim")
        part = _meet(one.drop("value"), other, ws).where(way).groupBy("src", "dst").agg((F.lit(float(r.weight)) * best).alias("capacity"))
        out = part if out is None else out.union(part)
    return out.groupBy("src", "dst").agg(F.sum("capacity").alias("capacity"))


def related_edges(ds: SplitDataset, reps: DataFrame) -> DataFrame:
    """``(src, dst, capacity)`` between the representatives ``reps(class_id, ...)`` of classes of copies, or any records of that name: the weighted sum over
    factors of their similarities. There are as many edges as pairs that share a value."""
    rows = ds.records.join(reps.select(F.col("class_id").alias("id")), "id", "left_semi")
    return similar_pairs(ds, rows, rows, Workspace(ds.records.sparkSession, "edges"))


def factor_edges(ds: SplitDataset, n: int, reps: DataFrame) -> DataFrame:
    """``(src, dst, capacity)`` by the similarity of factor ``n`` alone, unweighted."""
    from dataclasses import replace

    return related_edges(replace(ds, factors=(ds.factors[n],), similar=(replace(ds.relations[n], weight=1.0),)), reps)


def point_scores(ds: SplitDataset, points: DataFrame, sets: DataFrame) -> DataFrame:
    """``(id, set, score)``: the largest weighted similarity of each point of ``points(id)`` to a member of each set of ``sets(set, id)``; 0 if there is none.

    A point is not compared with itself. Edges stand for classes of copies: members of a point's own class are as similar to it as it is to itself.
    """
    from splitloom.operators.edges import class_representatives, classes

    ws = Workspace(ds.records.sparkSession, "points")
    of = ws.write(classes(ds).select("id", "class_id", "class_size"))
    reps = ws.write(class_representatives(ds).select(F.col("class_id").alias("id")))
    point = ws.write(points.select("id").distinct().join(of.select("id", F.col("class_id").alias("src")), "id"))
    asked, every = ds.records.join(point.select(F.col("src").alias("id")), "id", "left_semi"), ds.records.join(reps, "id", "left_semi")
    own = None
    for n, r in enumerate(ds.relations):
        k = F.size(compared_values(ds, n))
        part = F.lit(float(r.weight)) * (k.cast("double") if r.name == "set_intersection" else F.when(k > 0, 1.0).otherwise(0.0))
        own = part if own is None else own + part
    loops = asked.select(F.col("id").alias("src"), F.col("id").alias("dst"), own.alias("capacity"))
    near = similar_pairs(ds, asked, every, ws, ordered=False).union(loops)
    member = sets.join(of.select("id", F.col("class_id").alias("dst"), "class_size"), "id")
    # a class of copies is met once per set; whether it holds another record than the point is told by its members
    met = member.groupBy("set", "dst").agg(F.count_distinct("id").alias("_m"), F.min("id").alias("_one"))
    hit = point.join(near, "src").join(met, "dst").where((F.col("_m") > 1) | (F.col("_one") != F.col("id"))).groupBy("id", "set").agg(F.max("capacity").alias("score"))
    grid = points.select("id").distinct().crossJoin(F.broadcast(sets.select("set").distinct()))
    return grid.join(hit, ["id", "set"], "left").select("id", "set", F.coalesce("score", F.lit(0.0)).alias("score"))
