"""Factor graphs over postings: completeness, components, component datasets, node cuts."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitloom.operators.components import components
from splitloom.operators.dataset import SplitDataset, dense_index
from splitloom.operators.edges import class_representatives, classes, record_links, tagged
from splitloom.operators.related import related_edges, related_nodes, related_ties
from splitloom.workspace import Workspace, join_per_key


def factor_nodes(ds: SplitDataset, similar: DataFrame | None = None) -> DataFrame:
    """``(n, value, id)``: the records of each value's graph: its owners and the records similar to it, by the dataset's relations or as ``similar(n, value, id)`` says."""
    if similar is None and not ds.plain:
        return related_nodes(ds)
    own = ds.postings().select("n", "value", "id")
    return own if similar is None else own.union(similar.select("n", "value", "id")).distinct()


def gaussian_nodes(points: DataFrame, n: int, thresh: float) -> DataFrame:
    """``(n, value, id)``: for every value of ``points(id, x)`` the records with a value near it, by a band join over distinct values."""
    from splitloom.operators.edges import gaussian_edges

    distinct = points.where(F.col("x").isNotNull() & ~F.isnan("x")).select(F.col("x").alias("id"), "x").distinct()
    edges = gaussian_edges(distinct, thresh)
    near = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("v", "w").union(distinct.select(F.col("id").alias("v"), F.col("id").alias("w")))
    return near.join(points.select("id", F.col("x").alias("w")), "w").select(F.lit(n).alias("n"), F.col("v").cast("string").alias("value"), "id").distinct()


def value_ties(postings: DataFrame) -> DataFrame:
    """``(src, dst)``: every record of ``postings(n, value, id)`` tied to the smallest that holds the same value, one edge per posting.

    Values are no vertices and no pairs of records are formed. A value that most records hold is met by broadcast.
    """
    keyed = postings.select(F.concat_ws(":", F.col("n").cast("string"), "value").alias("k"), "id")
    first = keyed.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return join_per_key(keyed, first.select("k", "first"), "k", first.select("k", "n")).select(F.col("id").alias("src"), F.col("first").alias("dst"))


def record_components(ds: SplitDataset, numbered: bool = True) -> DataFrame:
    """``(id, root[, component_id])``: records that are related directly or through others; ``root`` is the smallest id of the component.

    ``component_id`` numbers components from 0 by their root. A record without values is a component of its own.
    """
    ws = Workspace(ds.records.sparkSession, "records")
    ties = value_ties(ds.postings()) if all(r.name == "set_intersection" for r in ds.relations) else related_ties(ds, ws)
    found = components(ties, ws).withColumnRenamed("component", "root")
    out = ds.records.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    if not numbered:
        return out
    out = ws.write(out)
    roots = dense_index(out.select("root").distinct(), ["root"], "component_id", ws)
    sizes = out.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return join_per_key(out, roots, "root", sizes).select("id", "root", "component_id")


def is_complete(ds: SplitDataset) -> DataFrame:
    """``(n_records, n_pairs, is_complete)``: whether every two records are related. For equal values linked pairs are counted, not formed."""
    if any(r.name != "set_intersection" for r in ds.relations):
        links = related_pairs(ds)
        return links.withColumn("is_complete", F.col("n_pairs") == F.expr("n_records * (n_records - 1) div 2"))
    links = record_links(ds).agg(F.count(F.lit(1)).alias("n_records"), F.expr("coalesce(sum(n_links), 0) div 2").cast("bigint").alias("n_pairs"))
    return links.withColumn("is_complete", F.col("n_pairs") == F.expr("n_records * (n_records - 1) div 2"))


def related_pairs(ds: SplitDataset) -> DataFrame:
    """``(n_records, n_pairs)``: pairs of different classes by the edges between them, pairs of copies by the sizes of the classes."""
    reps = Workspace(ds.records.sparkSession, "classes").write(class_representatives(ds))
    size = reps.select("class_id", "class_size")
    between = related_edges(ds, reps).join(size.select(F.col("class_id").alias("src"), F.col("class_size").alias("a")), "src").join(size.select(F.col("class_id").alias("dst"), F.col("class_size").alias("b")), "dst").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("between"))
    some = F.lit(False)
    for f in ds.factors:
        some = some | (F.size(f) > 0)
    within = reps.agg(F.coalesce(F.sum("class_size"), F.lit(0)).alias("n_records"), F.coalesce(F.sum(F.when(some, F.expr("class_size * (class_size - 1) div 2"))), F.lit(0)).alias("within"))
    return within.crossJoin(F.broadcast(between)).select("n_records", (F.col("within") + F.col("between")).alias("n_pairs"))


def component_summary(ds: SplitDataset, ranked: bool = False) -> DataFrame:
    """``(root, n_records[, rank])``: the components, ranked from 0 by size, largest first, ties by root; more than one row means that the dataset is disconnected."""
    sizes = record_components(ds, numbered=False).groupBy("root").agg(F.count(F.lit(1)).alias("n_records"))
    return dense_index(sizes.withColumn("_size", -F.col("n_records")), ["_size", "root"], "rank").drop("_size") if ranked else sizes


def from_components(ds: SplitDataset) -> tuple[SplitDataset, DataFrame]:
    """A dataset with one record per component and ``(component, id)``, its members.

    Every field becomes the list of its members' sets, in id order, and the weights are the members' weights in that order; the only factor
    is the new field ``component``. Members of a component are gathered in one row: use this for data whose components are
    bounded, and work over the membership otherwise. With at most one component the dataset is returned as it is.
    """
    comp = Workspace(ds.records.sparkSession, "rollup").write(record_components(ds))
    member = comp.select(F.col("component_id").cast("string").alias("component"), "id")
    if comp.select("component_id").distinct().limit(2).count() <= 1:
        return ds, member
    one = F.coalesce(F.col("weights"), F.array(F.lit(1.0)))
    rows = ds.records.join(comp, "id").select(F.col("component_id").cast("string").alias("component"), F.struct("id", *ds.fields, F.aggregate(one, F.lit(0.0), lambda s, x: s + x).alias("_w")).alias("m"))
    grouped = rows.groupBy("component").agg(F.array_sort(F.collect_list("m")).alias("m"))
    records = grouped.select(F.col("component").alias("id"), *[F.col("m").getField(f).alias(f) for f in ds.fields], F.array("component").alias("component"), F.col("m").getField("_w").alias("weights"))
    return replace(ds, records=records, fields=(*ds.fields, "component"), factors=("component",), similar=()), member


def graph_tables(ds: SplitDataset) -> tuple[DataFrame, DataFrame]:
    """``(id, class_id)`` and the class edges ``(src, dst, capacity)``: the similarity graph with copies folded, by the dataset's relations and weights."""
    return classes(ds).select("id", "class_id"), related_edges(ds, Workspace(ds.records.sparkSession, "graph").write(class_representatives(ds)))


#: Stands before the name of a shared value in a class graph, so that it is no record's.
HUB = "\U0010ffff"


def class_graph(ds: SplitDataset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, class_id)``, ``(class_id, class_size)`` and ``(class_id, hub)``: classes of copies are adjacent when they share a hub, a value if
    equal values relate, else an edge of the similarity graph. No pairs are formed for values."""
    ws = Workspace(ds.records.sparkSession, "classes")
    member, reps = ws.write(classes(ds).select("id", "class_id")), ws.write(class_representatives(ds))
    if all(r.name == "set_intersection" for r in ds.relations):
        hubs = reps.select("class_id", F.explode(F.concat(*[F.transform(f, tagged(n)) for n, f in enumerate(ds.factors)])).alias("hub"))
    else:
        hubs = related_edges(ds, reps).select(F.explode(F.array("src", "dst")).alias("class_id"), F.to_json(F.struct("src", "dst")).alias("hub"))
    return member, reps.select("class_id", "class_size"), hubs.select("class_id", F.concat(F.lit(HUB), "hub").alias("hub"))


def adjacency(edges: list[tuple[str, str]]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def plain_components(graph: dict[str, set[str]], without: set[str] = frozenset()) -> list[set[str]]:
    """Components of a small graph after removing some vertices, largest first, ties by smallest member."""
    left, out = set(graph) - set(without), []
    while left:
        todo, seen = [next(iter(left))], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in graph[x] if y in left and y not in seen]
        left -= seen
        out.append(seen)
    return sorted(out, key=lambda c: (-len(c), min(c)))


def minimum_node_cut(graph: dict[str, set[str]], s: str, t: str, size: dict[str, float] | None = None) -> set[str]:
    """The lightest set of vertices, neither s nor t, whose removal separates the non-adjacent vertices s and t.

    A vertex weighs 1, or what ``size`` says; one of infinite weight is never cut (a value that its holders share).
    Every vertex becomes an arc of its weight from its in- to its out-side; shortest augmenting paths give the maximum flow, and
    the cut vertices are those whose in-side can still be reached while their out-side cannot.
    """
    if t in graph[s]:
        raise ValueError("adjacent vertices have no node cut")
    size = size or {}
    used: dict[str, float] = defaultdict(float)
    flow: dict[str, dict[str, float]] = defaultdict(dict)

    def left(v: str) -> float:
        return math.inf if v in (s, t) else size.get(v, 1) - used[v]

    def reach() -> dict:
        """From each vertex side that is reached the one before it and what can still flow between them."""
        start = (s, 1)
        came, todo = {start: None}, deque([start])
        while todo:
            v, side = todo.popleft()
            if side:  # at the out-side: along edges, or back through the vertex
                steps = [((w, 0), math.inf) for w in graph[v]]
                if used[v]:
                    steps.append(((v, 0), used[v]))
            else:  # at the in-side: through the vertex, or back along flow that enters it
                steps = [((w, 1), flow[w][v]) for w in graph[v] if flow[w].get(v)]
                if left(v):
                    steps.append(((v, 1), left(v)))
            for x, room in steps:
                if x not in came:
                    came[x] = ((v, side), room)
                    if x == (t, 0):
                        return came
                    todo.append(x)
        return came

    while True:
        came = reach()
        if (t, 0) not in came:
            return {v for v in graph if (v, 0) in came and (v, 1) not in came}
        way, x = [], (t, 0)
        while came[x] is not None:
            way.append((came[x][0], x, came[x][1]))
            x = came[x][0]
        more = min(room for _, _, room in way)
        for (v, a), (w, b), _ in way:
            if a == 1 and b == 0 and v != w:
                flow[v][w] = flow[v].get(w, 0) + more
            elif a == 0 and b == 1 and v != w:
                flow[w][v] -= more
            else:
                used[v] += more if b == 1 else -more


def cut_sides(graph: dict[str, set[str]], cut: set[str], shuffle) -> tuple[set[str], set[str]]:
    """Components left by a cut in shuffled order, dealt to the sides in turn with the last one held out. Shared values are on no side."""
    parts = [c for c in ({v for v in p if not v.startswith(HUB)} for p in plain_components(graph, cut)) if c]
    shuffle(parts)
    train, held = set(), set()
    for i, p in enumerate(parts[:-1]):
        (train if i % 2 == 0 else held).update(p)
    if parts:
        held.update(parts[-1])
    return train, held
