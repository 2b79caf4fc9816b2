"""Consolidating pairwise matches into groups.

The graph is shrunk before it is solved: vertices of degree one are stripped, chains of degree-two vertices
are compressed by list ranking (pointer doubling), again and again; the reduced core is solved by one task if it is small
and by star contraction otherwise, and the removed vertices then take the label of what they hung on, last removed first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.functions.ids import BLANKS, spelled_numbers
from splitloom.operators.components import LOCAL_EDGES, components
from splitloom.operators.dataset import dense_index
from splitloom.workspace import Workspace, join_per_key, size_measures


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that are not in ``gone(v, frm)``; both ends are the key, so a hub's edges stay spread."""
    cut = gone.select(F.greatest("v", "frm").alias("src"), F.least("v", "frm").alias("dst"))
    return edges.join(cut, ["src", "dst"], "left_anti").select("src", "dst")


def shrink(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame | None, int]:
    """Edges without vertices of degree one and two, ``(v, parent, rooted)`` for these, and their number; ``rooted``: the whole component is removed.

    Degree one is stripped; a chain of degree-two vertices becomes one edge between its ends, by list ranking: each low vertex
    holds a pointer away from each neighbour (one of degree one a single pointer to its neighbour). Doubling replaces a pointer to a
    chain vertex by that vertex's pointer onwards, so after k rounds it has passed 2**k vertices, and while any chain is
    unfinished some of its pointers arrive in each round. Pointers on a cycle never do: when none arrives, those that are left are on
    cycles, and their vertices stay for the core. A chain that ends in a vertex of degree one hangs on its other end as a whole.
    """
    deg = _arcs(edges).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).cast("int").alias("deg"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    low, seen = ws.write_with(deg.where("deg <= 2"), n=F.count(F.lit(1)))
    if not seen["n"]:
        return edges, None, 0
    # kind of the vertex that a pointer stands on: 0 stays, 1 has degree one, 2 is on a chain and is entered from via
    way = F.when(F.col("deg") == 1, F.array(F.struct(F.col("a").alias("frm"), F.col("a").alias("to")))).otherwise(F.array(F.struct(F.col("a").alias("frm"), F.col("b").alias("to")), F.struct(F.col("b").alias("frm"), F.col("a").alias("to"))))
    start = low.select("v", F.explode(way).alias("w")).select("v", "w.frm", "w.to", F.col("v").alias("via"))
    going = {"more": F.count_if(F.col("kind") == 2)}
    kind = low.select(F.col("v").alias("to"), F.col("deg").alias("_deg"))
    cur, seen = ws.write_with(join_per_key(start, kind, "to", how="left").select("v", "frm", "to", "via", F.coalesce("_deg", F.lit(0)).alias("kind")), **going)
    left = seen["more"]
    while left:
        onward = cur.select(F.col("v").alias("to"), F.col("frm").alias("via"), F.col("to").alias("to2"), F.col("via").alias("via2"), F.col("kind").alias("kind2"))
        moved = cur.where("kind = 2").join(onward, ["to", "via"]).select("v", "frm", F.col("to2").alias("to"), F.col("via2").alias("via"), F.col("kind2").alias("kind"))
        new, seen = ws.write_with(cur.where("kind <> 2").select(*cur.columns).union(moved.select(*cur.columns)), **going)
        ws.drop(cur)
        cur = new
        if seen["more"] == left:
            break
        left = seen["more"]
    ends = cur.groupBy("v").agg(F.min("frm").alias("a"), F.max("frm").alias("b"), F.max("kind").alias("worst"), F.min("kind").alias("best"), F.count(F.lit(1)).alias("n"), F.min("to").alias("e1"), F.max("to").alias("e2"), F.min(F.struct("kind", "to"))["to"].alias("end"))
    ends, seen = ws.write_with(ends.where("worst < 2"), m=F.count(F.lit(1)))
    if not seen["m"]:
        return edges, None, 0
    links = ends.where("n = 2 AND worst = 0 AND e1 <> e2").select(F.col("e2").alias("src"), F.col("e1").alias("dst"))
    gone = ends.select("v", F.explode(F.array_distinct(F.array("a", "b"))).alias("frm"))
    shorter = ws.write(_without(edges, gone).union(links).distinct())
    # of two ends of degree one the smaller is the root of the whole chain, itself included
    root = F.when(F.col("n") == 1, F.least("v", "e1")).otherwise(F.least("e1", "e2"))
    hung = ends.select("v", F.when(F.col("best") == 1, root).otherwise(F.col("end")).alias("parent"), (F.col("best") == 1).alias("rooted"))
    ws.drop(low, cur)
    return shorter, hung, seen["m"]


def contract_components(edges: DataFrame, ws: Workspace | None = None, core_share: float = 0.05, max_rounds: int = 32, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(src, dst)`` with a neighbour; vertices of one component share the label.

    The label is a vertex of the component, not always the smallest. Rounds of stripping and compressing go
    on while one removes at least ``core_share`` of the vertices that were there at first. Loops, repeated and reversed edges and null ends
    are ignored. An empty table gives an empty result.
    """
    ws = ws or Workspace(edges.sparkSession, "contract")
    cur = ws.write(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    hung, first = [], None
    for _ in range(max_rounds):
        shorter, low, n = shrink(cur, ws)
        if not n:
            break
        hung.append(low)
        ws.drop(cur)
        cur = shorter
        first = first or n
        if n < core_share * first:
            break
    labels = components(cur, ws, local_edges=local_edges)
    for h in reversed(hung):
        labels = ws.write(labels)
        up = labels.select(F.col("id").alias("parent"), "component")
        down = ws.write(join_per_key(h, up, "parent", how="left"))
        # a parent without a label lost all its edges: it is the root of what hangs on it
        bare = down.where("component IS NULL AND NOT rooted").select(F.col("parent").alias("id"), F.col("parent").alias("component")).distinct()
        labels = labels.union(down.select(F.col("v").alias("id"), F.coalesce("component", "parent").alias("component"))).union(bare)
    return labels


def _record(c: str) -> Column:
    up = F.upper(F.btrim(F.col(c), F.lit(BLANKS)))
    return F.when(up != "", up)


def record_numbers(ids: DataFrame, ws: Workspace, buckets: int | None = None) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """``(k, id)``: a number for each distinct text of ``ids(id)``, and a function that replaces a column of texts by their numbers.

    Numbers are 64-bit hashes, which no shuffle has to look up. Whether two texts share a hash is seen while the table is written; if any do,
    all texts are numbered by their order instead and looked up by joins. ``buckets`` limits the hashes (for tests).
    """

    def hashed(c: str) -> Column:
        h = F.xxhash64(c)
        return F.pmod(h, F.lit(buckets)) if buckets else h

    clash = {"clash": F.count_if(F.col("id") != F.col("other"))}
    table, seen = ws.write_with(ids.where("id IS NOT NULL").groupBy(hashed("id").alias("k")).agg(F.min("id").alias("id"), F.max("id").alias("other")), **clash)
    if not seen["clash"]:
        return table.select("k", "id"), lambda df, c: df.withColumn(c, F.when(F.col(c).isNotNull(), hashed(c)))
    numbered = ws.write(dense_index(ids.where("id IS NOT NULL").select("id").distinct(), ["id"], "k", ws).select("k", "id"))
    return numbered, lambda df, c: join_per_key(df, numbered.select(F.col("id").alias(c), F.col("k").alias("_k")), c).drop(c).withColumnRenamed("_k", c)


def match_groups(records: DataFrame, matches: DataFrame, buckets: int | None = None) -> DataFrame:
    """``(id, group_id)``: one row per record that is linked to another, with the smallest id of its group.

    Records are the ids of ``records(id, spks)`` and those named only in ``matches(left_id, right_id)``,
    compared in upper case without outer blanks; null and blank ids are no records. Two are linked by a match
    or by naming the same speaker number: all records of a speaker are tied to one of them, so a speaker of n records costs
    n - 1 edges. A speaker that only one record names ties nobody. Texts are numbered first; all rounds run over numbers.
    """
    ws = Workspace(records.sparkSession, "matches")
    named = records.select(_record("id").alias("src"), spelled_numbers(F.col("spks")).alias("ks")).where("src IS NOT NULL")
    pairs = matches.select(_record("left_id").alias("src"), _record("right_id").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    ids = named.select(F.col("src").alias("id")).union(pairs.select("src")).union(pairs.select("dst"))
    numbers, number = record_numbers(ids, ws, buckets)
    named = ws.write(number(named.select("src", F.explode("ks").alias("k")), "src").select("src", "k").distinct())
    shared, measured = ws.write_with(named.groupBy("k").agg(F.min("src").alias("dst"), F.count(F.lit(1)).alias("n")), **size_measures())
    tied = join_per_key(named, shared.where("n > 1").select("k", "dst"), "k", shared.select("k", "n"), measured=measured).select("src", "dst")
    pairs = number(number(pairs, "src"), "dst").select("src", "dst")
    labels = ws.write(contract_components(pairs.union(tied), ws).withColumnRenamed("id", "k").join(numbers, "k").select("id", "component"))
    least, measured = ws.write_with(labels.groupBy("component").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")), **size_measures())
    return join_per_key(labels, least.select("component", "group_id"), "component", least.select("component", "n"), measured=measured).select("id", "group_id")
