"""Queries for the split operators over the test tables, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.config import ConstraintSpec, SplitConfig
from splitloom.functions.similarity import similarity
from splitloom.operators import candidates as cd
from splitloom.operators import constraints as cn
from splitloom.operators import edges as ed
from splitloom.operators import graph as gr
from splitloom.operators import report
from splitloom.operators import splitters as sp
from splitloom.operators.dataset import Relation, SplitDataset
from splitloom.operators.related import factor_edges, point_scores, related_edges
from splitloom.sources import tables
from splitloom.streaming.assign import assign_stream, decide, frozen_values
from splitloom.workspace import Workspace

SEED = 7
N = 60


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(df: DataFrame, key: str, **fields: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), *[c.alias(k) for k, c in fields.items()], F.array(F.lit(1.0)).alias("weights"))


def orders(spark: SparkSession, d: str, factors: tuple[str, ...] = ("customer",), constraints: tuple[str, ...] = (), weighting: str = "none") -> SplitDataset:
    """Orders as records: customer and the suppliers of the lines as factors, price, status and priority as constraints; weighted by the share of the price."""
    o = _t(spark, d, "orders")
    total = o.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("_total"))
    rec = o.crossJoin(F.broadcast(total)).select(F.col("o_orderkey").cast("string").alias("id"), F.array("o_custkey").alias("customer"), F.array("o_totalprice").alias("price"), F.array("o_orderstatus").alias("status"), F.array("o_orderpriority").alias("priority"), F.array(F.lit(1.0) if weighting == "none" else F.col("o_totalprice") / F.col("_total")).alias("weights"))
    fields = ["customer", "price", "status", "priority"]
    if "supplier" in factors:
        lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_set("l_suppkey").alias("supplier"))
        rec = rec.join(lines, "id", "left")
        fields.append("supplier")
    return SplitDataset(rec, tuple(fields), factors, constraints, weighting)


def _suppliers(spark: SparkSession, d: str) -> SplitDataset:
    s = _t(spark, d, "supplier")
    return SplitDataset(_records(s, "s_suppkey", nation=F.array("s_nationkey"), balance=F.array("s_acctbal")), ("nation", "balance"), ("nation",))


def _parts(spark: SparkSession, d: str) -> SplitDataset:
    p = _t(spark, d, "part")
    return SplitDataset(_records(p, "p_partkey", brand=F.array("p_brand"), type=F.array("p_type"), size=F.array("p_size")), ("brand", "type", "size"), ("brand", "type"), ("size",))


def _candidates(ds: SplitDataset, n: int = N) -> tuple[DataFrame, cd.RandomSides]:
    return sp.random_candidates(ds, n, SEED)


def _scores(spark: SparkSession, d: str, specs: list[ConstraintSpec], fields: tuple[str, ...], factors: tuple[str, ...] = ("customer",), weighting: str = "none") -> DataFrame:
    ds = orders(spark, d, factors, fields, weighting)
    cands, members = _candidates(ds)
    return cn.constraint_scores(ds, tuple(specs), members, cands)


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# sources and accessors


def tsv_like_multivalue(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    cell = F.concat_ws(",", F.col("user_id").cast("string"), F.regexp_replace("props", r'[^0-9,]', ""), F.lit(" 7"), F.lit("x"), F.lit(""))
    return e.select("event_id", F.array_sort(tables.multi_value(cell, "bigint")).alias("numbers"), F.size(tables.multi_value(cell, "string")).alias("n_texts"))


def group_records(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("duration"))
    g = tables.group_supervisions(lines, ["l_suppkey"], "l_orderkey")
    return g.select("id", F.col("l_suppkey").alias("suppliers"), F.col("duration")[0].alias("quantity"), F.round(F.col("fraction")[0], 12).alias("fraction"))


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.dedup_first([o.where(F.col("o_orderstatus") == s) for s in ("P", "F", "O")], "o_custkey")


def partition_subset_renorm(spark: SparkSession, d: str) -> DataFrame:
    ds = orders(spark, d, weighting="weighted")
    part = ds.records.select("id", F.when(F.col("status")[0] == "F", 0).otherwise(1).alias("split"))
    return tables.restrict(ds, part, 0).records.select("id", F.round(F.col("weights")[0], 12).alias("weight"))


def slice_records(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    ds = SplitDataset(_records(c, "c_custkey", nation=F.array("c_nationkey")), ("nation",), ("nation",))
    return ds.slice(10, 1000, 7).records.select("id", F.col("nation")[0].alias("nation"))


def record_at(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).record(100)


def record_json(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).as_json()


def aligned_fields(spark: SparkSession, d: str) -> DataFrame:
    r = orders(spark, d, constraints=("price",)).field_rows(("price",))
    return r.select("id", F.col("price")[0].alias("price"), F.col("weights")[0].alias("weight"))


# indexes and graphs


def constraint_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    ds = SplitDataset(_records(docs.where("doc_id IS NOT NULL"), "doc_id", source=F.array("source"), lang=F.array("lang")), ("source", "lang"), ("source",), ("lang",))
    return ds.inverted_index(("lang",))


def factor_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, ("customer", "supplier")).inverted_index(("customer", "supplier"))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, constraints=("priority",)).vocabulary(0)


def factor_values(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, ("customer", "supplier")).values()


def factor_node_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("x"))
    near = gr.gaussian_nodes(s, 1, 0.5)
    return gr.factor_nodes(_suppliers(spark, d), near).groupBy("n", "value").agg(F.count(F.lit(1)).alias("n_records"))


def links_set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return ed.record_links(orders(spark, d))


def links_customer_supplier(spark: SparkSession, d: str) -> DataFrame:
    return ed.record_links(orders(spark, d, ("customer", "supplier")))


def links_boolean(spark: SparkSession, d: str) -> DataFrame:
    return ed.equal_value_classes(_suppliers(spark, d), "nation")


def edges_weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    return ed.shared_value_edges(ed.class_representatives(_parts(spark, d)), ("brand", "type"), (1.0, 0.5))


def edges_pooled(spark: SparkSession, d: str) -> DataFrame:
    return ed.pooled_edges(ed.class_representatives(_parts(spark, d)), ("brand", "type"))


def edges_gaussian(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_acctbal") / 20).alias("x"))
    return _rounded(ed.gaussian_edges(s, 0.5), 9, "capacity")


def search_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _rounded(ed.cosine_search(v.where("id % 50 = 0"), v, 0.3), 9, "cosine")


def edges_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    return _rounded(ed.levenshtein_edges(p, 0.6), 9, "capacity")


def point_to_set_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest cosine of every vector whose id is divisible by 50 with another vector of each label, over all rows."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return _rounded(ed.cosine_best(v.where("id % 50 = 0"), v, "label"), 9, "cosine")


def similarity_expressions(spark: SparkSession, d: str) -> DataFrame:
    """All registered similarities of an order's suppliers and line numbers (numbers, texts, and vectors of number and square): one row per order."""
    l = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("a"), F.array_sort(F.collect_set(F.col("l_linenumber").cast("bigint"))).alias("b"))
    one, two = F.col("a"), F.col("b")
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    vector = lambda c: F.transform(c, lambda x: F.array(x.cast("double"), F.lit(10.0)))
    return l.select(
        "l_orderkey", similarity("set_intersection")(one, two).alias("shared"), similarity("boolean")(one, two).alias("equal"), similarity("boolean")(one, two, any_value=True).alias("any_equal"),
        F.round(similarity("gaussian")(F.transform(one, lambda x: x / 50.0), F.transform(two, lambda x: x / 50.0), 0.1), 9).alias("near"), F.round(similarity("levenshtein")(text(one), text(two), 0.3), 9).alias("edit"),
        F.round(similarity("cosine")(vector(one), vector(two), 0.5), 9).alias("angle"),
    )


def _near_suppliers(spark: SparkSession, d: str) -> SplitDataset:
    """Suppliers related by their nation (weight 2) and, as far as 0.5, by their balance (weight 0.5)."""
    return replace(_suppliers(spark, d), factors=("nation", "balance"), similar=(Relation("set_intersection", 0.0, 2.0), Relation("gaussian", 0.5, 0.5)))


def edges_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Edges between all suppliers, copies too."""
    ds = _near_suppliers(spark, d)
    return _rounded(related_edges(ds, ds.records.select(F.col("id").alias("class_id"))), 9, "capacity")


def edges_single_factor(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by their balance alone, as a configured factor."""
    ds = _near_suppliers(spark, d)
    return _rounded(factor_edges(ds, 1, ed.class_representatives(ds)), 9, "capacity")


def components_gaussian(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose balances are near each other, directly or through others."""
    c = _t(spark, d, "customer")
    ds = SplitDataset(_records(c, "c_custkey", balance=F.array(F.col("c_acctbal") / 4)), ("balance",), ("balance",), similar=(Relation("gaussian", 0.5),))
    return gr.record_components(ds, numbered=False)


def components_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose names differ in few letters, directly or through others: the number of parts in each component."""
    p = _t(spark, d, "part")
    ds = SplitDataset(_records(p, "p_partkey", name=F.array("p_name")), ("name",), ("name",), similar=(Relation("levenshtein", 0.6),))
    return gr.component_summary(ds)


def point_scores_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose id is divisible by 50 against those in debt and those in credit: the largest weighted similarity."""
    ds = _near_suppliers(spark, d)
    s = _t(spark, d, "supplier").select(F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("set"), F.col("s_suppkey").cast("string").alias("id"))
    return _rounded(point_scores(ds, ds.records.where("cast(id as bigint) % 50 = 0"), s), 9, "score")


def read_tsv_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as tab-separated text and read again: ids, cells of several values, types, weights."""
    p = _t(spark, d, "part")
    cells = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(",", "p_brand", "p_type", "p_brand").alias("kinds"), F.concat_ws(",", F.col("p_size").cast("string"), F.lit("x"), F.lit("")).alias("size"), (F.col("p_size") / 100).cast("string").alias("Fraction"))
    path = f"{Workspace(spark, 'tsv').root}/parts"
    cells.write.option("sep", "\t").option("header", True).csv(path)
    conf = SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), factor_types=("str", "int", "float"))
    r = tables.read_tsv(spark, path, conf).records
    return r.select("id", F.array_sort("kinds").alias("kinds"), F.col("size")[0].alias("size"), F.size("size").alias("n_sizes"), F.col("weights")[0].alias("weight"))


def read_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as two manifests of supervisions that overlap, read and grouped by order."""
    l = _t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("recording_id"), F.col("l_suppkey").cast("string").alias("speaker"), F.col("l_quantity").alias("duration"), "l_linenumber")
    root = Workspace(spark, "manifests").root
    for k, part in (("one", l.where("l_linenumber <= 4")), ("two", l.where("l_linenumber >= 3"))):
        part.drop("l_linenumber").write.option("compression", "gzip").json(f"{root}/{k}")
    conf = SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), format="lhotse", lhotse_fields=("speaker",))
    r = tables.read_supervisions(spark, [f"{root}/one", f"{root}/two"], conf).records
    return r.select("id", "speaker", F.col("duration")[0].alias("duration"), F.round(F.col("fraction")[0], 12).alias("fraction"))


def graph_is_complete(spark: SparkSession, d: str) -> DataFrame:
    return gr.is_complete(_suppliers(spark, d))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return gr.record_components(_interviews(spark, d))


def _interviews(spark: SparkSession, d: str) -> SplitDataset:
    """Interviews by id, with the raw spellings of their speakers as the factor."""
    c = _t(spark, d, "connected_eg").where("id IS NOT NULL")
    g = c.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("spks"))).alias("spks"), F.array_distinct(F.flatten(F.collect_set("room"))).alias("room"))
    return SplitDataset(g.withColumn("weights", F.array(F.lit(1.0))), ("spks", "room"), ("spks",), ("room",))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return gr.component_summary(_interviews(spark, d)).groupBy("n_records").agg(F.count(F.lit(1)).alias("n_components"))


def component_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled, _ = gr.from_components(_suppliers(spark, d))
    return rolled.records.select("id", F.size("nation").alias("n_members"), F.array_min(F.flatten("nation")).alias("nation"), F.size("weights").alias("n_weights"))


# candidates


def split_single_factor(spark: SparkSession, d: str) -> DataFrame:
    ds = orders(spark, d, ("customer", "supplier"))
    masks = cd.random_masks(ds.postings().select("n", "value").distinct(), 4, SEED)
    m = cd.factor_members(ds.postings(), cd.mask_bits(masks, 4))
    return m.groupBy("cand_id", "n", "side").agg(F.count(F.lit(1)).alias("n_records"), F.min("id").alias("first_id"))


def split_collapsed(spark: SparkSession, d: str) -> DataFrame:
    _, members = _candidates(orders(spark, d, ("customer", "supplier")))
    return members.unpack().groupBy("cand_id", "side").agg(F.count(F.lit(1)).alias("n_records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def split_collapsed_plain(spark: SparkSession, d: str) -> DataFrame:
    ds = orders(spark, d, ("customer", "supplier"))
    masks = cd.random_masks(ds.postings().select("n", "value").distinct(), 8, SEED)
    m = cd.plain_members(ds.postings(), cd.mask_bits(masks, 8), 2)
    return m.groupBy("cand_id", "side").agg(F.count(F.lit(1)).alias("n_records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def split_from_index(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers split by nation with the power-set index 0101...: every second nation is selected."""
    ds = _suppliers(spark, d)
    values = ds.values()
    k = values.count()
    return cd.plain_members(ds.postings(), cd.index_bits(values, 0, 0, int(("01" * k)[:k], 2)), 1)


def split_neighbors(spark: SparkSession, d: str) -> DataFrame:
    ds = _suppliers(spark, d)
    values = ds.values()
    strings = cd.bit_strings(cd.mask_bits(cd.random_masks(values, 4, SEED), 4), values)
    return cd.neighbours(strings).select("cand_id", "n", F.col("flipped").cast("int").alias("flipped"), "neighbour")


# constraints


def score_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d, [ConstraintSpec("mean"), ConstraintSpec("mean", None, "max")], ("price", "price")), 6, "score0", "score1", "total")


def _lines(spark: SparkSession, d: str, field: str) -> SplitDataset:
    """Orders by customer with the quantities of their lines (a set of several numbers), or by nation of the customer with one set for each order."""
    q = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_sort(F.collect_set("l_quantity")).alias("qty"))
    ds = orders(spark, d, ("customer",), ())
    rec = ds.records.join(q, "id").select("id", "customer", "qty", "weights")
    if field == "component":
        rec = rec.groupBy(F.col("customer")[0].cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "qty"))).getField("qty").alias("qty"), F.collect_list(F.lit(1.0)).alias("weights")).withColumn("customer", F.array("id"))
    return SplitDataset(rec, ("customer", "qty"), ("customer",), ("qty",) * 5)


_REDUCED = (ConstraintSpec("mean"), ConstraintSpec("sum", None, "sum"), ConstraintSpec("mean", None, "min"), ConstraintSpec("mean", None, "max"), ConstraintSpec("kl", {"smooth": 0.1}, "concat"))


def score_reductions(spark: SparkSession, d: str) -> DataFrame:
    """Every reduction of fields with several values."""
    ds = _lines(spark, d, "order")
    cands, members = _candidates(ds)
    return _rounded(cn.constraint_scores(ds, _REDUCED, members, cands), 6, *[f"score{i}" for i in range(5)], "total")


def score_component_reductions(spark: SparkSession, d: str) -> DataFrame:
    """Every reduction of the fields of components: one set of values for each of their members."""
    ds = _lines(spark, d, "component")
    cands, members = _candidates(ds)
    return _rounded(cn.constraint_scores(ds, _REDUCED, members, cands), 6, *[f"score{i}" for i in range(5)], "total")


def score_mean_tuple(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d, [ConstraintSpec("mean_tuple", [250000.0, 240000.0])], ("price",)), 6, "score0", "total")


def score_mean_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d, [ConstraintSpec("mean")], ("price",), weighting="weighted"), 5, "score0", "total")


def score_sum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d, [ConstraintSpec("sum", None, "sum")], ("price",), ("customer", "supplier")), 2, "score0", "total")


def score_sum_tuple(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d, [ConstraintSpec("sum_tuple", {"values": [0.5, 0.5], "power": 2.0}, "sum")], ("price",), ("customer",), "weighted").select("cand_id", "n0", "n1", (F.col("score0") / 1e10).alias("score0")), 6, "score0")


def _kl(direction: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(_scores(spark, d, [ConstraintSpec("kl", {"smooth": 0.1, "direction": direction}, "concat")], ("status",)), 9, "score0", "total")

    q.__name__ = f"score_kl_{direction}"
    return q


def score_kl_tuple(spark: SparkSession, d: str) -> DataFrame:
    spec = ConstraintSpec("kl_tuple", {"smooth": 0.1, "direction": "forward", "vocab": ["F", "O", "P"], "dist": [[0.4, 0.4, 0.2], [0.5, 0.25, 0.25]]}, "concat")
    return _rounded(_scores(spark, d, [spec], ("status",)), 9, "score0", "total")


def score_max_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d, [ConstraintSpec("max_entropy", [0.25, 0.75], "concat")], ("priority",)), 9, "score0", "total")


def kl_distributions(spark: SparkSession, d: str) -> DataFrame:
    ds = orders(spark, d, constraints=("status",))
    cands, members = _candidates(ds)
    return _rounded(cn.distributions(ds, 0, members, cands, 0.1), 9, "p0", "p1")


def score_total_worst(spark: SparkSession, d: str) -> DataFrame:
    """Candidate 100 puts all suppliers on one side, candidate 101 splits them by nation."""
    ds = SplitDataset(_suppliers(spark, d).records, ("nation", "balance"), ("nation",), ("balance",))
    ids = ds.records.select("id", F.col("nation")[0].alias("k"))
    members = ids.select(F.lit(100).cast("bigint").alias("cand_id"), "id", F.lit(0).alias("side")).union(ids.select(F.lit(101).cast("bigint"), "id", (F.col("k") % 2).cast("int")))
    cands = spark.range(100, 103).toDF("cand_id")
    return _rounded(cn.constraint_scores(ds, (ConstraintSpec("mean"),), members, cands, (2.0,)), 6, "score0", "total")


# search and reports

_SPECS = (ConstraintSpec("mean"), ConstraintSpec("kl", {"smooth": 0.1, "direction": "symmetric"}, "concat"))


def _conf(**kw) -> SplitConfig:
    return SplitConfig((1,), (2, 3), _SPECS, (0.001, 10.0), seed=SEED, **kw)


def random_search_best(spark: SparkSession, d: str) -> DataFrame:
    ds = orders(spark, d, ("customer",), ("price", "status"))
    cands, members = _candidates(ds)
    scores = cn.constraint_scores(ds, _SPECS, members, cands, (0.001, 10.0))
    return _rounded(cd.best_candidate(scores), 6, "score0", "score1", "total")


def random_split(spark: SparkSession, d: str) -> DataFrame:
    ds = orders(spark, d, ("customer",), ("price", "status"))
    return sp.split(ds, _conf(max_iter=N - 1)).assignment


def _partition(spark: SparkSession, d: str) -> tuple[SplitDataset, DataFrame]:
    """Orders by customer and suppliers; side 0: candidate 0 of the seed."""
    ds = orders(spark, d, ("customer", "supplier"), ("price",))
    _, members = _candidates(ds, 1)
    return ds, Workspace(spark, "partition").write(report.overlap_test_sets(ds, members.only(0)))


def overlap_test_sets(spark: SparkSession, d: str) -> DataFrame:
    return _partition(spark, d)[1]


def overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.overlap_stats(*_partition(spark, d))


def split_stats(spark: SparkSession, d: str) -> DataFrame:
    ds, part = _partition(spark, d)
    return _rounded(report.split_stats(ds, (ConstraintSpec("mean"),), part), 6, "stat0")


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the orders as three runs of twenty iterations."""
    s = _scores(spark, d, [ConstraintSpec("mean")], ("price",))
    return Workspace(spark, "history").write(s.select((F.col("cand_id") % 3).cast("int").alias("run"), F.floor(F.col("cand_id") / 3).cast("int").alias("iter"), F.round("total", 6).alias("total")))


def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return report.best_so_far(_history(spark, d))


def finite_scores(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d)
    return report.finite_scores(h.withColumn("total", F.when(F.col("iter") % 5 == 0, F.lit(cn.WORST_SCORE)).otherwise(F.col("total"))))


def best_seed_topk(spark: SparkSession, d: str) -> DataFrame:
    return report.best_runs(_history(spark, d), 2)


def index_ranges(spark: SparkSession, d: str) -> DataFrame:
    ds = _suppliers(spark, d)
    values = ds.values()
    return report.index_ranges(cd.bit_strings(cd.mask_bits(cd.random_masks(values, 20, SEED), 20), values))


def stream_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user against a frozen split of users; the same operators run on a stream of events."""
    e = _t(spark, d, "events")
    posts = e.select(F.col("ts").alias("event_time"), F.col("event_id").cast("string").alias("id"), F.lit(0).alias("n"), F.col("user_id").cast("string").alias("value"))
    old = posts.where("event_time < timestamp'2024-01-10'").select("id", "n", "value")
    part = old.select("id", (F.col("value").cast("int") % 2).alias("split"))
    out = decide(assign_stream(posts.where("event_time >= timestamp'2024-01-10'"), frozen_values(old, part)))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "id", "split")


def _vns(spark: SparkSession, d: str) -> tuple[SplitDataset, SplitConfig]:
    ds = SplitDataset(_suppliers(spark, d).records, ("nation", "balance"), ("nation",), ("balance",))
    return ds, SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="vns", seed=SEED, max_iter=10, num_shake_neighborhoods=3, num_search_neighborhoods=3, max_neighbors=50)


def vns_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.split(*_vns(spark, d)).assignment


def _cut(spark: SparkSession, d: str) -> tuple[SplitDataset, SplitConfig]:
    """Parts that share a brand or a size; at most 25 x 50 classes of copies, however many parts."""
    p = _t(spark, d, "part")
    ds = SplitDataset(_records(p, "p_partkey", brand=F.array("p_brand"), size=F.array("p_size"), price=F.array("p_retailprice")), ("brand", "size", "price"), ("brand", "size"), ("price",))
    return ds, SplitConfig((1, 2), (3,), (ConstraintSpec("mean"),), (1.0,), splitter="min_node_cut", seed=SEED, max_iter=15)


def min_node_cut_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.split(*_cut(spark, d)).assignment


def _spectral(spark: SparkSession, d: str) -> tuple[SplitDataset, SplitConfig]:
    ds = SplitDataset(_suppliers(spark, d).records, ("nation", "balance"), ("nation",), ("balance",))
    return ds, SplitConfig((1,), (2,), (ConstraintSpec("mean"),), (1.0,), splitter="spectral_clustering", seed=SEED)


def spectral_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.split(*_spectral(spark, d)).assignment


def _checked(ds: SplitDataset, conf: SplitConfig) -> DataFrame:
    """``(both_sides, shared_values, score_agrees)`` of a search's result: whether both sides have records, how many factor values stand on both, and
    whether the reported total is that of the assignment."""
    spark, r = ds.records.sparkSession, sp.split(ds, conf)
    out = Workspace(spark, "checked").write(r.assignment)
    top = cn.constraint_scores(ds, conf.specs, out.select(F.lit(0).cast("bigint").alias("cand_id"), "id", "side"), spark.range(1).toDF("cand_id"), conf.constraint_weights)
    both = ds.postings().join(out, "id").groupBy("n", "value").agg(F.count_distinct("side").alias("c")).agg(F.count_if(F.col("c") > 1).alias("shared_values"))
    # a side without records has the worst score
    agrees = (F.abs(F.col("total") - F.lit(r.total)) <= 1e-9 * (1 + abs(r.total))).alias("score_agrees")
    return top.select(((F.col("n0") > 0) & (F.col("n1") > 0)).alias("both_sides"), agrees).crossJoin(F.broadcast(both))


def vns_check(spark: SparkSession, d: str) -> DataFrame:
    return _checked(*_vns(spark, d))


def min_node_cut_check(spark: SparkSession, d: str) -> DataFrame:
    return _checked(*_cut(spark, d))


def spectral_check(spark: SparkSession, d: str) -> DataFrame:
    return _checked(*_spectral(spark, d))


def disconnected_split(spark: SparkSession, d: str) -> DataFrame:
    ds = orders(spark, d, ("customer",), ("price", "status"))
    return sp.split(ds, SplitConfig((1,), (2, 3), _SPECS, (0.001, 10.0), splitter="disconnected", seed=SEED, max_iter=59)).assignment


QUERIES = {
    f.__name__: f
    for f in (
        tsv_like_multivalue, group_records, dedup_keep_first, partition_subset_renorm, slice_records, record_at, record_json, aligned_fields, constraint_inverted_index, factor_inverted_index, vocab, factor_values,
        factor_node_counts, links_set_intersection, links_customer_supplier, links_boolean, edges_weighted_sum, edges_pooled, edges_gaussian, search_cosine, edges_levenshtein, point_to_set_max, similarity_expressions, edges_mixed, edges_single_factor, components_gaussian, components_levenshtein, point_scores_mixed, read_tsv_records, read_manifests, graph_is_complete,
        graph_components, component_sizes, component_rollup, split_single_factor, split_collapsed, split_collapsed_plain, split_from_index, split_neighbors, score_mean, score_mean_tuple, score_mean_weighted,
        score_sum, score_sum_tuple, _kl("forward"), _kl("reverse"), _kl("symmetric"), score_kl_tuple, score_max_entropy, kl_distributions, score_total_worst, random_search_best, random_split, overlap_test_sets,
        overlap_stats, split_stats, best_so_far, finite_scores, best_seed_topk, index_ranges, stream_assignment, vns_split, min_node_cut_split, spectral_split, disconnected_split, vns_check, min_node_cut_check, spectral_check, score_reductions, score_component_reductions,
    )
}

_CUST = "SELECT 0 AS n, CAST(o_custkey AS VARCHAR) AS value, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey IS NOT NULL"
_SUPP = "SELECT DISTINCT 1 AS n, CAST(l_suppkey AS VARCHAR) AS value, CAST(l_orderkey AS VARCHAR) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IS NOT NULL"
_ROOT = "SELECT 0 AS n, min(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey) AS value, CAST(o_orderkey AS VARCHAR) AS id FROM orders"
_NATION = "SELECT 0 AS n, CAST(s_nationkey AS VARCHAR) AS value, CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_nationkey IS NOT NULL"


def _sides(post: str, factors: int, n: int = N) -> str:
    return f"""post AS ({post}), vals AS (SELECT DISTINCT n, value FROM post),
mask AS (SELECT n, value, CAST('0x' || substr(md5('{SEED}:0:' || n || ':' || value), 1, 15) AS BIGINT) AS m FROM vals),
cand AS (SELECT CAST(range AS BIGINT) AS cand_id FROM range({n})),
bits AS (SELECT cand_id, n, value, (m >> CAST(cand_id AS INTEGER)) & 1 = 1 AS bit FROM mask, cand),
ok AS (SELECT cand_id FROM (SELECT cand_id, n, bool_and(bit) AS al, bool_or(bit) AS an FROM bits GROUP BY ALL) GROUP BY cand_id HAVING NOT bool_or(al) AND bool_and(an)),
mem AS MATERIALIZED (SELECT cand_id, id, CASE WHEN al THEN 0 WHEN NOT an THEN 1 END AS side FROM (SELECT cand_id, id, bool_and(bit) AS al, bool_or(bit) AS an, count(DISTINCT n) AS k FROM post JOIN bits USING (n, value) GROUP BY ALL) WHERE k = {factors} AND (al OR NOT an))"""


_W1 = _sides(_CUST, 1)
_W2 = _sides(f"{_CUST} UNION ALL {_SUPP}", 2)
_PRICE = """st AS (SELECT cand_id, side, count(*) AS len, avg(o_totalprice) AS a, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM mem JOIN orders ON id = CAST(o_orderkey AS VARCHAR) GROUP BY ALL),
w AS (SELECT cand_id, coalesce(max(len) FILTER (side = 0), 0) AS n0, coalesce(max(len) FILTER (side = 1), 0) AS n1, max(a) FILTER (side = 0) AS a0, max(a) FILTER (side = 1) AS a1, coalesce(max(s) FILTER (side = 0), 0) AS s0, coalesce(max(s) FILTER (side = 1), 0) AS s1 FROM ok LEFT JOIN st USING (cand_id) GROUP BY ALL)"""


def _score(with_: str, expr: str, digits: int) -> str:
    return f"WITH {with_}, {_PRICE} SELECT cand_id, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN round({expr}, {digits}) END AS score0, CASE WHEN n0 > 0 AND n1 > 0 THEN round({expr}, {digits}) ELSE 99999.0 END AS total FROM w"


def _dist(col: str, values: str) -> str:
    return f"""voc AS (SELECT DISTINCT {col} AS value FROM orders WHERE {col} IS NOT NULL),
cnt AS (SELECT cand_id, {col} AS value, count(*) FILTER (side = 0) AS c0, count(*) FILTER (side = 1) AS c1 FROM mem JOIN orders ON id = CAST(o_orderkey AS VARCHAR) WHERE {col} IS NOT NULL GROUP BY ALL),
grid AS (SELECT ok.cand_id, voc.value, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1 FROM ok CROSS JOIN voc LEFT JOIN cnt ON cnt.cand_id = ok.cand_id AND cnt.value = voc.value),
pq AS (SELECT cand_id, value, (c0 + 0.1) / (sum(c0) OVER (PARTITION BY cand_id) + 0.1 * {values}) AS p, (c1 + 0.1) / (sum(c1) OVER (PARTITION BY cand_id) + 0.1 * {values}) AS q FROM grid)"""


_KL = "kl AS (SELECT cand_id, sum(p * (ln(p) - ln(q))) AS f, sum(q * (ln(q) - ln(p))) AS r FROM pq GROUP BY ALL)"


def _kl_sql(expr: str) -> str:
    return f"WITH {_W1}, {_PRICE}, {_dist('o_orderstatus', '(SELECT count(*) FROM voc)')}, {_KL} SELECT cand_id, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN round({expr}, 9) END AS score0, CASE WHEN n0 > 0 AND n1 > 0 THEN round({expr}, 9) ELSE 99999.0 END AS total FROM w JOIN kl USING (cand_id)"


_PART = f"""{_sides(f"{_CUST} UNION ALL {_SUPP}", 2, 1)},
tv AS (SELECT DISTINCT n, value FROM post JOIN mem USING (id) WHERE side = 0),
leftover AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT id FROM mem)),
touch AS (SELECT id, bool_or(n = 0) AS t0, bool_or(n = 1) AS t1 FROM post SEMI JOIN tv USING (n, value) GROUP BY ALL),
part AS (SELECT id, side AS split FROM mem UNION ALL SELECT id, 2 + CASE WHEN coalesce(t0, false) THEN 0 ELSE 2 END + CASE WHEN coalesce(t1, false) THEN 0 ELSE 1 END FROM leftover LEFT JOIN touch USING (id))"""

_HIST = f"{_W1}, {_PRICE}, h AS (SELECT CAST(cand_id % 3 AS INTEGER) AS run, CAST(cand_id // 3 AS INTEGER) AS iter, CASE WHEN n0 > 0 AND n1 > 0 THEN round(abs(a0 - a1), 6) ELSE 99999.0 END AS total FROM w)"

_SUPP_COMP = "SELECT s_nationkey AS k, min(CAST(s_suppkey AS VARCHAR)) AS root, count(*) AS c FROM supplier GROUP BY ALL"

_INTERVIEWS = """i AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(spks) AS s FROM connected_eg WHERE id IS NOT NULL) WHERE s IS NOT NULL),
all_ids AS (SELECT DISTINCT id FROM connected_eg WHERE id IS NOT NULL),
e AS (SELECT DISTINCT id AS a, min(id) OVER (PARTITION BY s) AS b FROM i),
g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
cc(v, lab) USING KEY (v) AS (SELECT id, id FROM all_ids UNION SELECT g.b, min(cc.lab) FROM cc JOIN g ON g.a = cc.v JOIN recurring.cc AS old ON old.v = g.b WHERE cc.lab < old.lab GROUP BY g.b)"""

_NEAR = "s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_nationkey AS k, s_acctbal AS x FROM supplier)"
_MIXED = f"{_NEAR}, m AS (SELECT a.id AS src, b.id AS dst, CASE WHEN a.k = b.k THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN exp(-pow(a.x - b.x, 2)) > 0.5 THEN 0.5 * exp(-pow(a.x - b.x, 2)) ELSE 0 END AS c FROM s a JOIN s b ON a.id < b.id AND (a.k = b.k OR exp(-pow(a.x - b.x, 2)) > 0.5))"
_CHECKED = "SELECT true AS both_sides, 0::BIGINT AS shared_values, true AS score_agrees"


def _reduced(record: str) -> str:
    """Scores of the reductions: a record is an order or all orders of a customer."""
    return f"""WITH {_W1},
q AS (SELECT DISTINCT l_orderkey, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rec AS (SELECT {record} AS rid, any_value(CAST(o_custkey AS VARCHAR)) AS cust, sum(q) / count(*) AS me, sum(q) AS su, min(q) AS mi, max(q) AS ma FROM q JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
mm AS (SELECT cand_id, value AS cust, CASE WHEN bit THEN 0 ELSE 1 END AS side FROM bits),
st AS (SELECT cand_id, side, count(*) AS n, avg(me) AS me, sum(su) AS su, avg(mi) AS mi, avg(ma) AS ma FROM mm JOIN rec USING (cust) GROUP BY ALL),
w AS (SELECT cand_id, max(n) FILTER (side = 0) AS n0, max(n) FILTER (side = 1) AS n1, abs(max(me) FILTER (side = 0) - max(me) FILTER (side = 1)) AS s0, abs(max(su) FILTER (side = 0) - max(su) FILTER (side = 1)) AS s1, abs(max(mi) FILTER (side = 0) - max(mi) FILTER (side = 1)) AS s2, abs(max(ma) FILTER (side = 0) - max(ma) FILTER (side = 1)) AS s3 FROM ok JOIN st USING (cand_id) GROUP BY ALL),
voc AS (SELECT DISTINCT q AS value FROM q),
cnt AS (SELECT cand_id, q AS value, count(*) FILTER (side = 0) AS c0, count(*) FILTER (side = 1) AS c1 FROM q JOIN orders ON l_orderkey = o_orderkey JOIN mm ON cust = CAST(o_custkey AS VARCHAR) GROUP BY ALL),
grid AS (SELECT ok.cand_id, voc.value, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1 FROM ok CROSS JOIN voc LEFT JOIN cnt ON cnt.cand_id = ok.cand_id AND cnt.value = voc.value),
pq AS (SELECT cand_id, value, (c0 + 0.1) / (sum(c0) OVER (PARTITION BY cand_id) + 0.1 * (SELECT count(*) FROM voc)) AS p, (c1 + 0.1) / (sum(c1) OVER (PARTITION BY cand_id) + 0.1 * (SELECT count(*) FROM voc)) AS q FROM grid), {_KL}
SELECT cand_id, n0, n1, round(s0, 6) AS score0, round(s1, 6) AS score1, round(s2, 6) AS score2, round(s3, 6) AS score3, round(f, 6) AS score4, round(s0 + s1 + s2 + s3 + f, 6) AS total FROM w JOIN kl USING (cand_id)"""


SQL = {
    "tsv_like_multivalue": "WITH t AS (SELECT event_id, list_filter([user_id, TRY_CAST(regexp_replace(props, '[^0-9,]', '', 'g') AS BIGINT), 7], lambda x: x IS NOT NULL) AS v FROM events) SELECT event_id, list_sort(list_distinct(v)) AS numbers, CAST(len(list_distinct(v)) + 1 AS INTEGER) AS n_texts FROM t",
    "group_records": "SELECT CAST(l_orderkey AS VARCHAR) AS id, list_sort(list(DISTINCT l_suppkey)) AS suppliers, sum(l_quantity) AS quantity, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 12) AS fraction FROM lineitem GROUP BY l_orderkey",
    "dedup_keep_first": "WITH m AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS k FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM m QUALIFY k = min(k) OVER (PARTITION BY o_custkey)",
    "partition_subset_renorm": "WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT CAST(o_orderkey AS VARCHAR) AS id, round(o_totalprice / (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM f), 12) AS weight FROM f",
    "slice_records": "WITH i AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS nation, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS k FROM customer) SELECT id, nation FROM i WHERE k >= 10 AND k < 1000 AND (k - 10) % 7 = 0",
    "record_at": "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY 1 LIMIT 1 OFFSET 100",
    "record_json": """SELECT CAST(p_partkey AS VARCHAR) AS id, '{"brand":["' || p_brand || '"],"type":["' || p_type || '"],"size":[' || p_size || ']}' AS json FROM part""",
    "aligned_fields": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, 1.0::DOUBLE AS weight FROM orders",
    "constraint_inverted_index": "SELECT 0 AS n, lang AS value, count(DISTINCT doc_id) AS n_records, min(CAST(doc_id AS VARCHAR)) AS first_id, max(CAST(doc_id AS VARCHAR)) AS last_id FROM documents WHERE lang IS NOT NULL GROUP BY ALL",
    "factor_inverted_index": f"WITH post AS ({_CUST} UNION ALL {_SUPP}) SELECT n, value, count(*) AS n_records, min(id) AS first_id, max(id) AS last_id FROM post GROUP BY ALL",
    "vocab": "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL",
    "factor_values": f"WITH post AS ({_CUST} UNION ALL {_SUPP}), c AS (SELECT n, value, count(*) AS n_records FROM post GROUP BY ALL) SELECT n, value, row_number() OVER (PARTITION BY n ORDER BY CAST(value AS BIGINT)) - 1 AS pos, n_records FROM c",
    "factor_node_counts": f"WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS x FROM supplier), v AS (SELECT DISTINCT x FROM s), near AS (SELECT DISTINCT 1 AS n, CAST(v.x AS VARCHAR) AS value, s.id FROM v JOIN s ON exp(-pow(v.x - s.x, 2)) > 0.5 OR v.x = s.x) SELECT n, value, count(*) AS n_records FROM (SELECT n, value, id FROM ({_NATION}) UNION SELECT n, value, id FROM near) GROUP BY ALL",
    "links_set_intersection": "SELECT CAST(o_orderkey AS VARCHAR) AS id, min(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey) AS class_id, count(*) OVER (PARTITION BY o_custkey) - 1 AS n_links FROM orders",
    "links_customer_supplier": f"WITH post AS ({_CUST} UNION ALL {_SUPP}), g AS (SELECT id, list_sort(list(n || ':' || value)) AS k FROM post GROUP BY ALL), c AS (SELECT id, min(id) OVER (PARTITION BY k) AS class_id FROM g), p AS (SELECT a.id, count(DISTINCT b.id) - 1 AS n_links FROM post a JOIN post b USING (n, value) GROUP BY a.id) SELECT id, class_id, n_links FROM c JOIN p USING (id)",
    "links_boolean": "SELECT CAST(s_suppkey AS VARCHAR) AS id, min(CAST(s_suppkey AS VARCHAR)) OVER (PARTITION BY s_nationkey) AS class_id, count(*) OVER (PARTITION BY s_nationkey) - 1 AS n_links FROM supplier",
    "edges_weighted_sum": "WITH c AS (SELECT p_brand AS b, p_type AS t, min(CAST(p_partkey AS VARCHAR)) AS id FROM part GROUP BY ALL) SELECT x.id AS src, y.id AS dst, CASE WHEN x.b = y.b THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN x.t = y.t THEN 0.5::DOUBLE ELSE 0 END AS capacity FROM c x JOIN c y ON x.id < y.id AND (x.b = y.b OR x.t = y.t)",
    "edges_pooled": "WITH c AS (SELECT p_brand AS b, p_type AS t, min(CAST(p_partkey AS VARCHAR)) AS id FROM part GROUP BY ALL) SELECT x.id AS src, y.id AS dst, CAST(len(list_intersect([x.b, x.t], [y.b, y.t])) AS DOUBLE) AS capacity FROM c x JOIN c y ON x.id < y.id AND (x.b = y.b OR x.t = y.t)",
    "edges_gaussian": "WITH c AS (SELECT s_acctbal / 20 AS x, min(CAST(s_suppkey AS VARCHAR)) AS id FROM supplier GROUP BY s_acctbal / 20) SELECT a.id AS src, b.id AS dst, round(exp(-pow(a.x - b.x, 2)), 9) AS capacity FROM c a JOIN c b ON a.id < b.id AND exp(-pow(a.x - b.x, 2)) > 0.5",
    "search_cosine": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND list_cosine_similarity(q.e, v.e) > 0.3",
    "edges_levenshtein": "WITH c AS (SELECT p_name AS v, min(p_partkey) AS id FROM part GROUP BY ALL) SELECT a.id AS src, b.id AS dst, round(1.0 - levenshtein(a.v, b.v)::DOUBLE / greatest(length(a.v), length(b.v)), 9) AS capacity FROM c a JOIN c b ON a.id < b.id AND 1.0 - levenshtein(a.v, b.v)::DOUBLE / greatest(length(a.v), length(b.v)) > 0.6 + 1e-12",
    "point_to_set_max": "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT q.vec_id AS query_id, v.label, round(max(list_cosine_similarity(q.e, v.e)), 9) AS cosine FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND v.label IS NOT NULL GROUP BY ALL",
    "similarity_expressions": """WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS a, list_sort(list(DISTINCT CAST(l_linenumber AS BIGINT))) AS b FROM lineitem GROUP BY ALL),
g AS (SELECT *, exp(-pow((list_avg(a) - list_avg(b)) / 50.0, 2)) AS near, list_max(flatten(list_transform(a, lambda x: list_transform(b, lambda y: 1.0 - levenshtein(CAST(x AS VARCHAR), CAST(y AS VARCHAR))::DOUBLE / greatest(length(CAST(x AS VARCHAR)), length(CAST(y AS VARCHAR))))))) AS edit,
list_max(flatten(list_transform(a, lambda x: list_transform(b, lambda y: (x * y + 100.0) / (sqrt(x * x + 100.0) * sqrt(y * y + 100.0)))))) AS angle FROM l)
SELECT l_orderkey, CAST(len(list_intersect(a, b)) AS DOUBLE) AS shared, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END AS equal, CASE WHEN list_has_any(a, b) THEN 1.0::DOUBLE ELSE 0 END AS any_equal, CASE WHEN near > 0.1 THEN round(near, 9) ELSE 0 END AS near, CASE WHEN edit > 0.3 THEN round(edit, 9) ELSE 0 END AS edit, CASE WHEN angle > 0.5 THEN round(angle, 9) ELSE 0 END AS angle FROM g""",
    "edges_mixed": f"WITH {_MIXED} SELECT src, dst, round(c, 9) AS capacity FROM m",
    "edges_single_factor": f"WITH {_NEAR} SELECT a.id AS src, b.id AS dst, round(exp(-pow(a.x - b.x, 2)), 9) AS capacity FROM s a JOIN s b ON a.id < b.id AND exp(-pow(a.x - b.x, 2)) > 0.5",
    "components_gaussian": "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal / 4 AS x FROM customer WHERE c_acctbal IS NOT NULL), g AS (SELECT *, CASE WHEN exp(-pow(x - lag(x) OVER w, 2)) > 0.5 THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (ORDER BY x, id)), k AS (SELECT *, sum(s) OVER (ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT id, min(id) OVER (PARTITION BY k) AS root FROM k",
    "components_levenshtein": "WITH RECURSIVE p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS v FROM part), n AS (SELECT v, min(id) AS id, count(*) AS c FROM p GROUP BY v), g AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND 1.0 - levenshtein(a.v, b.v)::DOUBLE / greatest(length(a.v), length(b.v)) > 0.6 + 1e-12), cc(v, lab) USING KEY (v) AS (SELECT id, id FROM n UNION SELECT g.b, min(cc.lab) FROM cc JOIN g ON g.a = cc.v JOIN recurring.cc AS old ON old.v = g.b WHERE cc.lab < old.lab GROUP BY g.b) SELECT lab AS root, CAST(sum(c) AS BIGINT) AS n_records FROM cc JOIN n ON n.id = cc.v GROUP BY lab",
    "point_scores_mixed": f"WITH {_MIXED}, e AS (SELECT src, dst, c FROM m UNION ALL SELECT dst, src, c FROM m), t AS (SELECT CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS set, CAST(s_suppkey AS VARCHAR) AS id FROM supplier), q AS (SELECT id FROM t WHERE CAST(id AS BIGINT) % 50 = 0), k AS (SELECT q.id, t.set, max(c) AS c FROM q JOIN e ON e.src = q.id JOIN t ON t.id = e.dst GROUP BY ALL) SELECT q.id, n.set, round(coalesce(k.c, 0), 9) AS score FROM q CROSS JOIN (SELECT DISTINCT set FROM t) n LEFT JOIN k ON k.id = q.id AND k.set = n.set",
    "read_tsv_records": "SELECT CAST(p_partkey AS VARCHAR) AS id, list_sort([p_brand, p_type]) AS kinds, CAST(p_size AS BIGINT) AS size, 1 AS n_sizes, p_size / 100 AS weight FROM part",
    "read_manifests": "SELECT CAST(l_orderkey AS VARCHAR) AS id, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS speaker, sum(l_quantity) AS duration, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 12) AS fraction FROM lineitem GROUP BY l_orderkey",
    "vns_check": _CHECKED,
    "min_node_cut_check": _CHECKED,
    "spectral_check": _CHECKED,
    "score_reductions": _reduced("CAST(l_orderkey AS VARCHAR)"),
    "score_component_reductions": _reduced("CAST(o_custkey AS VARCHAR)"),
    "graph_is_complete": f"WITH c AS ({_SUPP_COMP}) SELECT CAST(sum(c) AS BIGINT) AS n_records, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS n_pairs, sum(c * (c - 1) // 2) = sum(c) * (sum(c) - 1) // 2 AS is_complete FROM c",
    "graph_components": f"WITH RECURSIVE {_INTERVIEWS}, r AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS k FROM (SELECT DISTINCT lab FROM cc)) SELECT v AS id, lab AS root, k AS component_id FROM cc JOIN r USING (lab)",
    "component_sizes": f"WITH RECURSIVE {_INTERVIEWS} SELECT c AS n_records, count(*) AS n_components FROM (SELECT count(*) AS c FROM cc GROUP BY lab) GROUP BY c",
    "component_rollup": f"WITH c AS ({_SUPP_COMP}) SELECT CAST(row_number() OVER (ORDER BY root) - 1 AS VARCHAR) AS id, CAST(c AS INTEGER) AS n_members, k AS nation, CAST(c AS INTEGER) AS n_weights FROM c",
    "split_single_factor": f"WITH {_sides(f'{_CUST} UNION ALL {_SUPP}', 2, 4)}, f AS (SELECT cand_id, n, id, CASE WHEN bool_and(bit) THEN 0 WHEN NOT bool_or(bit) THEN 1 END AS side FROM post JOIN bits USING (n, value) GROUP BY ALL) SELECT cand_id, n, side, count(*) AS n_records, min(id) AS first_id FROM f WHERE side IS NOT NULL GROUP BY ALL",
    "split_collapsed": f"WITH {_W2} SELECT cand_id, side, count(*) AS n_records, min(id) AS first_id, max(id) AS last_id FROM mem GROUP BY ALL",
    "split_collapsed_plain": f"WITH {_sides(f'{_CUST} UNION ALL {_SUPP}', 2, 8)} SELECT cand_id, side, count(*) AS n_records, min(id) AS first_id, max(id) AS last_id FROM mem GROUP BY ALL",
    "split_from_index": "WITH v AS (SELECT s_nationkey AS k, row_number() OVER (ORDER BY s_nationkey) - 1 AS pos FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)) SELECT 0::BIGINT AS cand_id, CAST(s_suppkey AS VARCHAR) AS id, CAST(1 - pos % 2 AS INTEGER) AS side FROM supplier JOIN v ON k = s_nationkey",
    "split_neighbors": f"WITH {_sides(_NATION, 1, 4)}, st AS (SELECT cand_id, 0 AS n, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY CAST(value AS BIGINT)) AS b FROM bits GROUP BY ALL), f AS (SELECT cand_id, n, CAST(i AS INTEGER) AS flipped, substr(b, 1, CAST(i AS INTEGER) - 1) || CASE WHEN substr(b, CAST(i AS INTEGER), 1) = '1' THEN '0' ELSE '1' END || substr(b, CAST(i AS INTEGER) + 1) AS neighbour FROM st, range(1, 1000) r(i) WHERE i <= length(b)) SELECT * FROM f WHERE contains(neighbour, '0') AND contains(neighbour, '1')",
    "score_mean": f"WITH {_W1}, {_PRICE} SELECT cand_id, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN round(abs(a0 - a1), 6) END AS score0, CASE WHEN n0 > 0 AND n1 > 0 THEN round(abs(a0 - a1), 6) END AS score1, CASE WHEN n0 > 0 AND n1 > 0 THEN round(2 * abs(a0 - a1), 6) ELSE 99999.0 END AS total FROM w",
    "score_mean_tuple": _score(_W1, "abs(a0 - 250000.0) + abs(a1 - 240000.0)", 6),
    "score_mean_weighted": f"WITH {_W1}, {_PRICE}, x AS (SELECT cand_id, side, sum(o_totalprice * o_totalprice) / sum(o_totalprice) AS a FROM mem JOIN orders ON id = CAST(o_orderkey AS VARCHAR) GROUP BY ALL), y AS (SELECT cand_id, max(a) FILTER (side = 0) AS b0, max(a) FILTER (side = 1) AS b1 FROM x GROUP BY ALL) SELECT cand_id, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN round(abs(b0 - b1), 5) END AS score0, CASE WHEN n0 > 0 AND n1 > 0 THEN round(abs(b0 - b1), 5) ELSE 99999.0 END AS total FROM w LEFT JOIN y USING (cand_id)",
    "score_sum": _score(_W2, "abs(s0 - s1)", 2),
    "score_sum_tuple": f"WITH {_W1}, {_PRICE}, t AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t FROM orders), x AS (SELECT cand_id, side, sum(o_totalprice * (o_totalprice / t)) AS s FROM mem JOIN orders ON id = CAST(o_orderkey AS VARCHAR), t GROUP BY ALL), y AS (SELECT cand_id, coalesce(max(s) FILTER (side = 0), 0) AS b0, coalesce(max(s) FILTER (side = 1), 0) AS b1 FROM x GROUP BY ALL) SELECT cand_id, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN round((pow(abs(b0 - 0.5), 2) + pow(abs(b1 - 0.5), 2)) / 1e10, 6) END AS score0 FROM w LEFT JOIN y USING (cand_id)",
    "score_kl_forward": _kl_sql("f"),
    "score_kl_reverse": _kl_sql("r"),
    "score_kl_symmetric": _kl_sql("(f + r) / 2"),
    "score_kl_tuple": f"WITH {_W1}, {_PRICE}, {_dist('o_orderstatus', '3')}, tg(value, t0, t1) AS (VALUES ('F', 0.4::DOUBLE, 0.5::DOUBLE), ('O', 0.4::DOUBLE, 0.25::DOUBLE), ('P', 0.2::DOUBLE, 0.25::DOUBLE)), kl AS (SELECT cand_id, sum(t0 * (ln(t0) - ln(p)) + t1 * (ln(t1) - ln(q))) AS f FROM pq JOIN tg USING (value) GROUP BY ALL) SELECT cand_id, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN round(f, 9) END AS score0, CASE WHEN n0 > 0 AND n1 > 0 THEN round(f, 9) ELSE 99999.0 END AS total FROM w JOIN kl USING (cand_id)",
    "score_max_entropy": f"WITH {_W1}, {_PRICE}, cnt AS (SELECT cand_id, side, o_orderpriority AS v, count(*)::DOUBLE AS c FROM mem JOIN orders ON id = CAST(o_orderkey AS VARCHAR) WHERE o_orderpriority IS NOT NULL GROUP BY ALL), pr AS (SELECT *, c / sum(c) OVER (PARTITION BY cand_id, side) AS p FROM cnt), en AS (SELECT cand_id, side, CASE WHEN count(*) > 1 THEN 1 + sum(p * ln(p)) / ln(count(*)) ELSE 1 END AS e FROM pr GROUP BY ALL), x AS (SELECT cand_id, sum(CASE side WHEN 0 THEN 0.25 ELSE 0.75 END * e) AS f FROM en GROUP BY ALL) SELECT cand_id, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN round(f, 9) END AS score0, CASE WHEN n0 > 0 AND n1 > 0 THEN round(f, 9) ELSE 99999.0 END AS total FROM w LEFT JOIN x USING (cand_id)",
    "kl_distributions": f"WITH {_W1}, {_dist('o_orderstatus', '(SELECT count(*) FROM voc)')} SELECT cand_id, value, round(p, 9) AS p0, round(q, 9) AS p1 FROM pq",
    "score_total_worst": "WITH a AS (SELECT count(*) FILTER (s_nationkey % 2 = 0) AS n0, count(*) FILTER (s_nationkey % 2 = 1) AS n1, abs(avg(s_acctbal) FILTER (s_nationkey % 2 = 0) - avg(s_acctbal) FILTER (s_nationkey % 2 = 1)) AS m, count(*) AS c FROM supplier) SELECT 100::BIGINT AS cand_id, c AS n0, 0::BIGINT AS n1, NULL::DOUBLE AS score0, 99999.0::DOUBLE AS total FROM a UNION ALL SELECT 101, n0, n1, round(m, 6), round(2 * m, 6) FROM a UNION ALL SELECT 102, 0, 0, NULL, 99999.0",
    "random_search_best": f"WITH {_W1}, {_PRICE}, {_dist('o_orderstatus', '(SELECT count(*) FROM voc)')}, {_KL}, s AS (SELECT cand_id, n0, n1, abs(a0 - a1) AS x, (f + r) / 2 AS y FROM w JOIN kl USING (cand_id) WHERE n0 > 0 AND n1 > 0) SELECT cand_id, n0, n1, round(x, 6) AS score0, round(y, 6) AS score1, round(0.001 * x + 10 * y, 6) AS total FROM s ORDER BY 0.001 * x + 10 * y, cand_id LIMIT 1",
    "random_split": f"WITH {_W1}, {_PRICE}, {_dist('o_orderstatus', '(SELECT count(*) FROM voc)')}, {_KL}, s AS (SELECT cand_id FROM w JOIN kl USING (cand_id) WHERE n0 > 0 AND n1 > 0 ORDER BY 0.001 * abs(a0 - a1) + 10 * (f + r) / 2, cand_id LIMIT 1) SELECT id, side FROM mem JOIN s USING (cand_id)",
    "disconnected_split": f"WITH {_sides(_ROOT, 1)}, {_PRICE}, {_dist('o_orderstatus', '(SELECT count(*) FROM voc)')}, {_KL}, s AS (SELECT cand_id FROM w JOIN kl USING (cand_id) WHERE n0 > 0 AND n1 > 0 ORDER BY 0.001 * abs(a0 - a1) + 10 * (f + r) / 2, cand_id LIMIT 1) SELECT id, side FROM mem JOIN s USING (cand_id)",
    "overlap_test_sets": f"WITH {_PART} SELECT id, split FROM part",
    "overlap_stats": f"WITH {_PART}, sz AS (SELECT split, count(*) AS n_records FROM part GROUP BY ALL), pp AS (SELECT post.n, post.value, post.id, part.split FROM post JOIN part USING (id)), hv AS (SELECT DISTINCT n, value, split AS split_a FROM pp), hit AS (SELECT split_a, split AS split_b, n, count(DISTINCT id) AS n_overlap FROM pp JOIN hv USING (n, value) WHERE split <> split_a GROUP BY ALL), fl(n, field) AS (VALUES (0, 'customer'), (1, 'supplier')) SELECT a.split AS split_a, b.split AS split_b, field, coalesce(n_overlap, 0) AS n_overlap, b.n_records, round(coalesce(n_overlap, 0) / b.n_records, 4) AS overlap FROM sz a JOIN sz b ON a.split <> b.split CROSS JOIN fl LEFT JOIN hit ON hit.split_a = a.split AND hit.split_b = b.split AND hit.n = fl.n",
    "split_stats": f"WITH {_PART} SELECT CAST(split AS BIGINT) AS split, count(*) AS length, round(avg(o_totalprice), 6) AS stat0 FROM part JOIN orders ON id = CAST(o_orderkey AS VARCHAR) GROUP BY split",
    "best_so_far": f"WITH {_HIST} SELECT run, iter, total, min(total) OVER (PARTITION BY run ORDER BY iter) AS best FROM h",
    "finite_scores": f"WITH {_HIST}, x AS (SELECT run, iter, CASE WHEN iter % 5 = 0 THEN 99999.0 ELSE total END AS total FROM h) SELECT run, iter, total, CASE WHEN total < 99999 THEN total ELSE max(total) FILTER (total < 99999) OVER (PARTITION BY run) END AS shown FROM x",
    "best_seed_topk": f"WITH {_HIST} SELECT run, arg_max(total, iter) AS total FROM h GROUP BY run ORDER BY 2, 1 LIMIT 2",
    "index_ranges": f"WITH {_sides(_NATION, 1, 20)}, st AS (SELECT cand_id, 0 AS n, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY CAST(value AS BIGINT)) AS b FROM bits GROUP BY ALL) SELECT n, min(b) AS least, max(b) AS most FROM st GROUP BY ALL",
    "stream_assignment": "WITH old AS (SELECT DISTINCT user_id, user_id % 2 AS side FROM events WHERE ts < TIMESTAMP '2024-01-10') SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, CAST(event_id AS VARCHAR) AS id, CASE WHEN coalesce(side, 0) = 1 THEN 1 ELSE 0 END AS split FROM events e LEFT JOIN old ON old.user_id = e.user_id WHERE ts >= TIMESTAMP '2024-01-10'",
}
