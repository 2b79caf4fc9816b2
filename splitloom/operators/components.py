"""Connected components by alternating star contraction, safe for hubs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitloom.workspace import Workspace, join_per_key, size_measures

#: Edges that one task solves by itself. Beyond, rounds of contraction go on until so few are left or all are stars.
LOCAL_EDGES = 1_000_000


def _star(arcs: DataFrame, ws: Workspace) -> tuple[DataFrame, bool, DataFrame]:
    """``arcs`` with the smallest of a vertex and its neighbours in ``arcs`` (``src`` to ``dst``) as ``m``, whether the arcs are stars, and the table of minima.

    They are stars when no vertex has two smaller neighbours, or smaller and larger ones.
    """
    low = arcs.groupBy("src").agg(F.least(F.first("src"), F.min("dst")).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("dst") < F.col("src")).alias("down"))
    open_ = F.count_if((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("n") > 1)))
    low, measured = ws.write_with(low, **size_measures(), open=open_)
    return join_per_key(arcs, low.select("src", "m"), "src", low.select("src", "n"), measured=measured), not measured["open"], low


def smallest_reached(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of the vertices 0 to n - 1."""
    root = np.arange(n)
    while True:
        a, b = root[src], root[dst]
        apart = a != b
        if not apart.any():
            return root
        src, dst = src[apart], dst[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def local_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of at most LOCAL_EDGES edges, loops included, by one task."""
    kind = edges.schema["src"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("component", kind)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            ends = [pd.concat([p[c] for p in parts]).to_numpy() for c in ("src", "dst")]
            names, at = np.unique(np.concatenate(ends), return_inverse=True)
            root = smallest_reached(*np.split(at, 2), len(names))
            yield pd.DataFrame({"id": names, "component": names[root]})

    return edges.select("src", "dst").repartition(1).mapInPandas(solve, schema)


def components(edges: DataFrame, ws: Workspace | None = None, max_rounds: int = 64, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(src, dst)``; the component is its smallest vertex.

    Large-star and small-star steps alternate until the edges are stars (a vertex points at its component), or until at most
    ``local_edges`` are left, which one task solves. Per vertex only a minimum is shuffled; hubs meet their minimum by a broadcast
    of bounded size. Loops, repeated and reversed edges are allowed; a loop makes its vertex a component. Edges with a
    null end are dropped. An empty table gives an empty result.
    """
    ws = ws or Workspace(edges.sparkSession, "components")
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    count = {"n": F.count(F.lit(1))}
    every, seen = ws.write_with(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), **count)
    if seen["n"] <= local_edges:
        return local_components(every)
    verts = every.select(F.col("src").alias("id")).union(every.select("dst")).distinct()
    cur = every.where("src <> dst")
    for _ in range(max_rounds):
        if seen["n"] <= local_edges:
            return verts.join(local_components(cur), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        reached, done, low = _star(cur.union(cur.select("dst", "src")), ws)
        if done:
            roots = cur.select(F.col("src").alias("id"), F.col("dst").alias("component"))
            return verts.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        large = ws.write(reached.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct())
        stars, _, low2 = _star(large, ws)
        small = stars.select(F.greatest("dst", "m").alias("src"), F.least("dst", "m").alias("dst")).union(stars.select("src", F.col("m").alias("dst")))
        new, seen = ws.write_with(small.where("src <> dst").distinct(), **count)
        ws.drop(large, cur, low, low2)
        cur = new
    raise RuntimeError(f"no stars after {max_rounds} rounds")
