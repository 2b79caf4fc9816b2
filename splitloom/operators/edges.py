"""Similarity graphs without quadratic work inside groups.

Records with the same value sets are copies of one class; edges are kept between class representatives, with the
membership beside them. Classes meet by equi-joins on values, on bands of numbers or on cells of vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.operators.dataset import SplitDataset, flat_values, vectors_of
from splitloom.workspace import Workspace, join_per_key, size_measures


def _sets(ds: SplitDataset) -> list[Column]:
    """The sorted sets of the factors, sets of vectors where these are compared."""
    return [F.array_sort((vectors_of if r.name == "cosine" else flat_values)(ds.records, f)).alias(f) for f, r in zip(ds.factors, ds.relations)]


def classes(ds: SplitDataset) -> DataFrame:
    """``(id, class_id, class_size, <factors>)``: records with equal sets in every factor form a class, named by its smallest id."""
    sets = _sets(ds)
    rows = ds.records.select("id", *sets)
    sizes = rows.groupBy(*ds.factors).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    keys = [f"_k{i}" for i in range(len(ds.factors))]
    left = rows.select("*", *[F.to_json(F.struct(f)).alias(k) for f, k in zip(ds.factors, keys)])
    right = sizes.select("class_id", "class_size", *[F.to_json(F.struct(f)).alias(k) for f, k in zip(ds.factors, keys)])
    return left.join(right, keys).drop(*keys)


def class_representatives(ds: SplitDataset) -> DataFrame:
    """``(class_id, class_size, <factors>)``: one row per class."""
    sets = _sets(ds)
    return ds.records.select("id", *sets).groupBy(*ds.factors).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))


def shared_value_edges(reps: DataFrame, fields: tuple[str, ...], weights: tuple[float, ...] | None = None, max_holders: int = 2000) -> DataFrame:
    """``(src, dst, capacity)`` between classes: the weighted sum over fields of the number of shared values.

    A value that more than ``max_holders`` classes hold would alone give millions of pairs; it is refused here, and
    such graphs are handled over postings (components, splits and overlaps need no pairs).
    """
    weights = weights or (1.0,) * len(fields)
    long = None
    for n, f in enumerate(fields):
        part = reps.select(F.lit(n).alias("n"), F.explode(F.transform(f, lambda x: x.cast("string"))).alias("value"), F.col("class_id").alias("id"))
        long = part if long is None else long.unionByName(part)
    long = Workspace(reps.sparkSession, "edges").write(long)
    most = long.groupBy("n", "value").count().agg(F.max("count")).first()[0]
    if (most or 0) > max_holders:
        raise ValueError(f"a value is held by {most} classes; use postings instead of pairs")
    a, b = long.select("n", "value", F.col("id").alias("src")), long.select("n", "value", F.col("id").alias("dst"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("n") + 1)
    return a.join(b, ["n", "value"]).where("src < dst").groupBy("src", "dst").agg(F.sum(weight).alias("capacity"))


def pooled_edges(reps: DataFrame, fields: tuple[str, ...], weight: float = 1.0) -> DataFrame:
    """Edges when the values of all fields are thrown together before they are compared (for comparison only)."""
    pool = F.array_distinct(F.concat(*[F.transform(f, lambda x: x.cast("string")) for f in fields]))
    return shared_value_edges(reps.select("class_id", pool.alias("pool")), ("pool",), (weight,))


def tagged(n: int):
    """Values of factor ``n`` as texts that no other factor has."""
    return lambda x: F.concat(F.lit(f"{n}:"), x.cast("string"))


def record_links(ds: SplitDataset, max_values: int = 10) -> DataFrame:
    """``(id, class_id, n_links)``: one row per record with the number of other records that share a value with it.

    Records of classes of at most ``max_values`` values (all factors together) are counted without pairs, however many hold a value: those
    that share one of k values with a class are counted by inclusion and exclusion over the 2^k - 1 sets of its values, each counted once
    for all classes. Wider classes would need too many sets: they meet the classes that hold their values, one distinct pair for each,
    and the pairs count for both sides. A record without values has no links.
    """
    ws = Workspace(ds.records.sparkSession, "links")
    member = ws.write(classes(ds).select("id", "class_id", "class_size"))
    tags = F.concat(*[F.transform(f, tagged(n)) for n, f in enumerate(ds.factors)])
    reps, seen = ws.write_with(class_representatives(ds).select("class_id", "class_size", tags.alias("tags")), most=F.coalesce(F.max(F.size("tags")), F.lit(0)))
    choice = F.explode(F.expr("sequence(1L, shiftleft(1L, size(tags)) - 1)"))
    sets = reps.where((F.size("tags") > 0) & (F.size("tags") <= max_values)).withColumn("c", choice)
    picked = F.filter("tags", lambda x, i: F.call_function("shiftright", F.col("c"), i.cast("int")).bitwiseAND(F.lit(1)) == 1)
    sets = ws.write(sets.select("class_id", "class_size", F.to_json(F.struct(picked.alias("s"))).alias("s"), F.when(F.bit_count("c") % 2 == 1, 1).otherwise(-1).alias("sign")))
    held, measured = ws.write_with(sets.groupBy("s").agg(F.sum("class_size").alias("held"), F.count(F.lit(1)).alias("n")), **size_measures())
    near = join_per_key(sets, held.select("s", "held"), "s", held.select("s", "n"), measured=measured).groupBy("class_id").agg((F.sum(F.col("sign") * F.col("held")) - 1).alias("_links"))
    if seen["most"] > max_values:
        near = near.unionByName(_wide_links(reps, max_values, ws)).groupBy("class_id").agg(F.sum("_links").alias("_links"))
    sizes = member.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    out = join_per_key(member.select("id", "class_id"), near, "class_id", sizes, how="left")
    return out.select("id", "class_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"))


def _wide_links(reps: DataFrame, max_values: int, ws: Workspace, salts: int = 16) -> DataFrame:
    """``(class_id, _links)``: links of classes of more than ``max_values`` values, and of the others with them; parts of a class add up.

    The holders of a value are spread over ``salts`` tasks, so a value that most records hold is not joined in one.
    """
    holders = reps.select("class_id", "class_size", (F.size("tags") > max_values).alias("wide"), F.pmod(F.xxhash64("class_id"), F.lit(salts)).cast("int").alias("salt"), F.explode("tags").alias("v"))
    wide = reps.where(F.size("tags") > max_values)
    ask = wide.select(F.col("class_id").alias("w"), F.col("class_size").alias("n"), F.explode("tags").alias("v")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = ws.write(ask.join(holders, ["v", "salt"]).where("w <> class_id").groupBy("w", "class_id").agg(F.first("n").alias("n"), F.first("class_size").alias("class_size"), F.first("wide").alias("wide")))
    own = wide.select("class_id", (F.col("class_size") - 1).alias("_links"))
    return own.unionByName(pairs.select(F.col("w").alias("class_id"), F.col("class_size").alias("_links"))).unionByName(pairs.where("NOT wide").select("class_id", F.col("n").alias("_links")))


def equal_value_classes(ds: SplitDataset, field: str) -> DataFrame:
    """``(id, class_id, n_links)`` for the boolean similarity: linked are the records with the same set of values."""
    rows = ds.records.select("id", F.to_json(F.struct(F.array_sort(flat_values(ds.records, field)).alias("v"))).alias("k"))
    sizes = rows.groupBy("k").agg(F.min("id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    return rows.join(sizes, "k").select("id", "class_id", "n_links")


def gaussian_edges(points: DataFrame, thresh: float) -> DataFrame:
    """``(src, dst, capacity)`` for ``points(id, x)``: pairs with exp(-(x-y)^2) above ``thresh``, 0 < thresh < 1.

    exp(-d^2) > t is |d| < sqrt(-ln t): points fall into bands of that width and meet those of the same and the next band only. Points with
    one value are one class (its smallest id); null and NaN values are similar to nothing.
    """
    if not 0 < thresh < 1:
        raise ValueError("the threshold lies between 0 and 1")
    width = math.sqrt(-math.log(thresh))
    reps = points.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("x").agg(F.min("id").alias("id"))
    band = reps.withColumn("band", F.floor(F.col("x") / F.lit(width)))
    near = band.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("band").alias("b1"))
    other = band.select(F.col("id").alias("dst"), F.col("x").alias("x2"), "band")
    pairs = near.join(other, "band").where((F.col("band") > F.col("b1")) | (F.col("src") < F.col("dst")))
    score = F.exp(-F.pow(F.col("x1") - F.col("x2"), F.lit(2.0)))
    return pairs.withColumn("capacity", score).where(F.col("capacity") > thresh).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "capacity")


def cosine_search(queries: DataFrame, vectors: DataFrame, thresh: float, block: int = 4096) -> DataFrame:
    """``(query_id, id, cosine)``: vectors whose cosine with a query exceeds ``thresh``; a stated query set against all rows.

    Both inputs are ``(id, vector array<float>)``. Queries are sent in blocks of ``block`` and multiplied with each batch of vectors;
    the vectors are never shuffled. Zero, null and NaN vectors are similar to nothing; a vector does not find itself.
    """
    import numpy as np
    import pandas as pd

    def search(names, q, pdf):
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        norm = np.sqrt((v * v).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(norm[:, None] > 0, (v @ q.T) / norm[:, None], 0.0)
        a, b = np.nonzero(c > thresh)
        out = pd.DataFrame({"query_id": [names[j] for j in b], "id": pdf["id"].to_numpy()[a], "cosine": c[a, b]})
        return out[out["query_id"] != out["id"]]

    kind = vectors.schema["id"].dataType.simpleString()
    return _against(queries, vectors.where("vector IS NOT NULL").select("id", "vector"), search, f"query_id {kind}, id {kind}, cosine double", block)


def _against(queries: DataFrame, rows: DataFrame, found, schema: str, block: int) -> DataFrame:
    """``found(names, unit vectors, batch)`` for every block of the queries and every batch of ``rows``.

    Queries are the stated set: the driver holds one block of them at a time, and each block reads the rows once.
    """
    import numpy as np

    spark, out = rows.sparkSession, None

    def add(ids: list, unit: list):
        sent = spark.sparkContext.broadcast((ids, np.stack(unit) if unit else None))

        def run(batches, sent=sent):
            names, q = sent.value
            for pdf in batches:
                if len(names) and len(pdf):
                    yield found(names, q, pdf)

        one = rows.mapInPandas(run, schema)
        return one if out is None else out.unionByName(one)

    ids, unit = [], []
    for r in queries.where("vector IS NOT NULL").select("id", "vector").toLocalIterator():
        v = np.asarray(r["vector"], float)
        if np.isfinite(v).all() and (v * v).sum() > 0:
            ids.append(r["id"])
            unit.append(v / np.sqrt((v * v).sum()))
        if len(ids) == block:
            out = add(ids, unit)
            ids, unit = [], []
    return add(ids, unit) if ids or out is None else out


def cosine_best(queries: DataFrame, vectors: DataFrame, label: str, block: int = 4096) -> DataFrame:
    """``(query_id, <label>, cosine)``: the largest cosine of each query of ``(id, vector)`` with another vector of each label of ``(id, vector, label)``.

    A stated query set against all rows, as :func:`cosine_search`; each batch of vectors sends one row per query and label. Vectors that are similar
    to nothing (zero, null, NaN) are left out, null labels too.
    """
    import numpy as np
    import pandas as pd

    def best(names, q, pdf):
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        norm = np.sqrt((v * v).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
        c = (v[ok] / norm[ok, None]) @ q.T
        at = pd.Index(names).get_indexer(pdf["id"].to_numpy()[ok])
        c[np.nonzero(at >= 0)[0], at[at >= 0]] = -np.inf
        top = pd.DataFrame(c, columns=range(len(names))).groupby(pdf["label"].to_numpy()[ok]).max().stack()
        top = top[top > -np.inf]
        return pd.DataFrame({"query_id": [names[j] for j in top.index.get_level_values(1)], "label": top.index.get_level_values(0), "cosine": top.to_numpy()})

    rows = vectors.where(F.col("vector").isNotNull() & F.col(label).isNotNull()).select("id", "vector", F.col(label).alias("label"))
    parts = _against(queries, rows, best, f"query_id {vectors.schema['id'].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, cosine double", block)
    return parts.groupBy("query_id", "label").agg(F.max("cosine").alias("cosine")).withColumnRenamed("label", label)


def cosine_edges(vectors: DataFrame, thresh: float, dims: int = 3) -> DataFrame:
    """``(src, dst, capacity)`` for ``vectors(id, vector)``: pairs with a cosine above ``thresh``, exact.

    Unit vectors with cosine above t are closer than r = sqrt(2 - 2t), in every coordinate too: their first ``dims`` coordinates fall
    into cells of width r, and a vector meets those of neighbouring cells only. The nearer t is to 1, the fewer meet.
    Equal vectors are one class (its smallest id); zero and null vectors are similar to nothing.
    """
    r = math.sqrt(max(2 - 2 * thresh, 1e-12))
    unit = vectors.groupBy("vector").agg(F.min("id").alias("id")).where(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) > 0)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = unit.select("id", F.transform("vector", lambda x: F.try_divide(x.cast("double"), norm)).alias("u"))
    cell = [F.floor(F.coalesce(F.get("u", F.lit(i)), F.lit(0.0)) / F.lit(r)).alias(f"c{i}") for i in range(dims)]
    placed = unit.select("id", "u", *cell)
    near = placed.select(F.col("id").alias("src"), F.col("u").alias("u1"), *[f"c{i}" for i in range(dims)])
    for i in range(dims):
        near = near.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + k for k in (-1, 0, 1)])))
    dot = F.aggregate(F.zip_with("u1", "u", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = near.join(placed.withColumnRenamed("id", "dst"), [f"c{i}" for i in range(dims)]).where("src < dst")
    return pairs.withColumn("capacity", dot).where(F.col("capacity") > thresh).select("src", "dst", "capacity")


def levenshtein_edges(texts: DataFrame, thresh: float) -> DataFrame:
    """``(src, dst, capacity)`` for ``texts(id, value)``: different texts with 1 - distance / longer length above ``thresh``.

    With at most d edits, one of d + 1 pieces of a text stands unchanged in the other near its place: texts meet on
    (length, piece number, piece). Equal texts are one class (its smallest id).
    """
    reps = texts.where("value IS NOT NULL").groupBy("value").agg(F.min("id").alias("id"))
    share = 1.0 - thresh
    # d < share * longer length; the other text is at most d characters longer or shorter
    size = F.length("value")
    a = reps.select(F.col("id").alias("src"), F.col("value").alias("v1"), size.alias("l1"))
    a = a.withColumn("d", F.ceil(F.col("l1") * F.lit(share) - 1e-9).cast("int") - 1).where("d >= 0")
    step = F.greatest(F.lit(1), F.floor(F.col("l1") / (F.col("d") + 1)).cast("int"))
    a = a.withColumn("step", step).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("d"))))
    a = a.withColumn("at", F.col("p") * F.col("step") + 1)
    a = a.withColumn("len", F.when(F.col("p") == F.col("d"), F.col("l1") - F.col("at") + 1).otherwise(F.col("step")))
    keys = a.select("src", "v1", "l1", "d", F.substring("v1", F.col("at"), F.col("len")).alias("piece"), "at", "len")
    shape = keys.select("l1", "d", "at", "len").distinct()
    # pieces of the shorter or equal texts at the places where a longer text's piece may stand
    b = reps.select(F.col("id").alias("dst"), F.col("value").alias("v2"), size.alias("l2"))
    lengths = b.select("l2").distinct().join(shape, (F.col("l2") <= F.col("l1")) & (F.col("l1") - F.col("l2") <= F.col("d")))
    lengths = lengths.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("d")), F.greatest(F.lit(1), F.least(F.col("at") + F.col("d"), F.col("l2") - F.col("len") + 1)))))
    cut = b.join(lengths, "l2").select("dst", "v2", "l1", "d", "at", "len", F.substring("v2", F.col("s"), F.col("len")).alias("piece")).distinct()
    pairs = keys.join(cut, ["l1", "d", "at", "len", "piece"]).where((F.col("src") != F.col("dst"))).select("src", "v1", "dst", "v2").distinct()
    sim = 1.0 - F.levenshtein("v1", "v2") / F.greatest(F.length("v1"), F.length("v2"))
    out = pairs.withColumn("capacity", sim).where(F.col("capacity") > thresh + 1e-12)
    return out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "capacity").distinct()


def point_to_set(edges: DataFrame, point: str, ids: DataFrame) -> DataFrame:
    """``(id, score)``: the largest capacity between ``point`` and a member of ``ids(id)``, one row; 0 if there is no edge."""
    both = edges.select("src", "dst", "capacity").union(edges.select("dst", "src", "capacity"))
    hit = both.where(F.col("src") == point).join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return hit.agg(F.coalesce(F.max("capacity"), F.lit(0.0)).alias("score")).select(F.lit(point).alias("id"), "score")
