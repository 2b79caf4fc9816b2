"""What a finished split looks like: leftover sets, overlaps, statistics, search history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitloom.config import ConstraintSpec
from splitloom.operators.constraints import WORST_SCORE, distributions, side_stats
from splitloom.operators.dataset import SplitDataset
from splitloom.operators.graph import factor_nodes
from splitloom.workspace import Workspace, join_per_key, size_measures


def _keyed(postings: DataFrame) -> DataFrame:
    """``(k, n, id, ...)``: factor and value as one key."""
    return postings.withColumn("k", F.concat_ws(":", F.col("n").cast("string"), "value"))




def _bits(w: int) -> Column:
    """The numbers from 63 w on whose bits ``b<w>`` has."""
    return F.filter(F.sequence(F.lit(63 * w), F.lit(63 * w + 62)), lambda a: F.call_function("shiftright", F.col(f"b{w}"), a - 63 * w).bitwiseAND(F.lit(1)) == 1)


def overlap_test_sets(ds: SplitDataset, assignment: DataFrame) -> DataFrame:
    """``(id, split)`` of all records: 0 train, 1 held out, else 2 + the class of the leftover.

    ``assignment(id, side)``. Digit n of the class (first factor first) is 0 if the record has, or is similar to, a value of factor n on the
    train side and 1 if not; a record without values in a factor shares none.
    """
    ws = Workspace(ds.records.sparkSession, "overlap")
    sides = assignment.select("id", F.col("side").cast("int").alias("side"))
    # records and assignment are evaluated once
    rows = ws.write(ds.records.select("id", ds.posting_array().alias("p")).join(sides, "id", "left"))
    keyed = _keyed(rows.select("id", "side", F.explode("p").alias("p")).select("id", "side", "p.n", "p.value"))
    per, measured = ws.write_with(keyed.groupBy("k").agg(F.max(F.col("side") == 0).alias("train"), F.count(F.lit(1)).alias("n")), **size_measures())
    rest = keyed.where("side IS NULL").select("k", F.col("n").alias("f"), "id")
    if not ds.plain:
        near = _keyed(factor_nodes(ds)).join(rows.where("side IS NULL").select("id"), "id", "left_semi")
        rest, measured = near.select("k", F.col("n").alias("f"), "id"), None
    touched = join_per_key(rest, per.where("train").select("k"), "k", per.select("k", "n") if ds.plain else None, measured=measured).groupBy("id").agg(F.expr("bit_or(shiftleft(1L, f))").alias("m"))
    left = rows.where("side IS NULL").select("id").join(touched, "id", "left").fillna(0, ["m"])
    k = len(ds.factors)
    digits = F.concat(*[F.when(F.expr(f"shiftright(m, {n}) & 1 = 1"), "0").otherwise("1") for n in range(k)])
    return rows.where("side IS NOT NULL").select("id", F.col("side").alias("split")).unionByName(left.select("id", (F.conv(digits, 2, 10).cast("int") + 2).alias("split")))


def overlap_stats(ds: SplitDataset, partition: DataFrame) -> DataFrame:
    """``(split_a, split_b, field, n_overlap, n_records, overlap)`` for all ordered pairs of different non-empty splits.

    The share, rounded to 4 digits, of the records of ``split_b`` that have a value of the factor that also occurs in ``split_a``.
    """
    ws = Workspace(ds.records.sparkSession, "overlap")
    keyed = ws.write(_keyed(ds.postings()).select("k", "field", "id").join(partition.select("id", "split"), "id"))
    # the splits that hold a value, 2 + 2 ** factors at most, as bits of as many numbers as it takes
    words = range(-(-(2 + 2 ** len(ds.factors)) // 63))
    bits = [F.when(F.floor(F.col("split") / 63) == w, F.expr("shiftleft(1L, cast(split % 63 as int))")).otherwise(F.lit(0).cast("bigint")).alias(f"b{w}") for w in words]
    either = [F.bit_or(f"b{w}").alias(f"b{w}") for w in words]
    per, measured = ws.write_with(keyed.select("k", *bits).groupBy("k").agg(*either, F.count(F.lit(1)).alias("n")), **size_measures())
    if ds.plain:
        met = join_per_key(keyed, per.drop("n"), "k", per.select("k", "n"), measured=measured)
    else:
        named = F.element_at(F.array(*[F.lit(f) for f in ds.factors]), F.col("n") + 1).alias("field")
        near = _keyed(factor_nodes(ds)).select("k", named, "id").join(partition.select("id", "split"), "id")
        met = join_per_key(near, per.drop("n"), "k")
    hit = met.groupBy("id", "split", "field").agg(*either).groupBy("split", "field", *[f"b{w}" for w in words]).agg(F.count(F.lit(1)).alias("c"))
    hit = hit.select(F.explode(F.flatten(F.array(*[_bits(w) for w in words]))).alias("split_a"), F.col("split").alias("split_b"), "field", "c").where("split_a <> split_b")
    counts = hit.groupBy("split_a", "split_b", "field").agg(F.sum("c").alias("n_overlap"))
    sizes = partition.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"))
    fields = ds.records.sparkSession.createDataFrame([(f,) for f in ds.factors], "field string")
    # all pairs of splits, of which there are 2 + 2 ** factors at most
    grid = sizes.select(F.col("split").alias("split_a")).crossJoin(sizes.select(F.col("split").alias("split_b"), "n_records")).where("split_a <> split_b").crossJoin(F.broadcast(fields))
    out = grid.join(counts, ["split_a", "split_b", "field"], "left").fillna(0, ["n_overlap"])
    return out.select("split_a", "split_b", "field", "n_overlap", "n_records", F.round(F.col("n_overlap") / F.col("n_records"), 4).alias("overlap"))


def split_stats(ds: SplitDataset, specs: tuple[ConstraintSpec, ...], partition: DataFrame) -> DataFrame:
    """``(split, length, stat0, stat1, ...)``: size and statistics of every split of ``partition(id, split)``."""
    members = partition.select(F.col("split").cast("bigint").alias("cand_id"), "id", F.lit(0).alias("side"))
    return side_stats(ds, specs, members).drop("side").withColumnRenamed("cand_id", "split")


def split_distributions(ds: SplitDataset, specs: tuple[ConstraintSpec, ...], partition: DataFrame) -> DataFrame:
    """``(split, constraint, value, share)``: the smoothed distribution of every kl or kl_tuple constraint (by position) in every split; values are texts."""
    members = partition.select(F.col("split").cast("bigint").alias("cand_id"), "id", F.lit(0).alias("side"))
    out = ds.records.sparkSession.createDataFrame([], "split bigint, constraint int, value string, share double")
    for i, s in enumerate(specs):
        if s.name in ("kl", "kl_tuple"):
            v = s.values or {}
            dist = distributions(ds, i, members, members.select("cand_id").distinct(), float(v.get("smooth", 1e-6)), v.get("vocab"))
            out = out.union(dist.select(F.col("cand_id").alias("split"), F.lit(i).alias("constraint"), F.col("value").cast("string"), F.col("p0").alias("share")))
    return out


def best_so_far(history: DataFrame) -> DataFrame:
    """``(run, iter, total, best)``: the least total up to each iteration of each run."""
    w = Window.partitionBy("run").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best", F.min("total").over(w))


def finite_scores(history: DataFrame) -> DataFrame:
    """``history`` with ``shown``: WORST_SCORE replaced by the largest other total of the run (null if there is none)."""
    top = history.where(F.col("total") < WORST_SCORE).groupBy("run").agg(F.max("total").alias("_top"))
    return history.join(top, "run", "left").withColumn("shown", F.when(F.col("total") < WORST_SCORE, F.col("total")).otherwise(F.col("_top"))).drop("_top")


def best_runs(history: DataFrame, k: int) -> DataFrame:
    """``(run, total)``: the ``k`` runs with the least final total, ties to the smaller run."""
    last = history.groupBy("run").agg(F.max_by("total", "iter").alias("total"))
    return last.orderBy("total", "run").limit(k)


def index_ranges(history: DataFrame) -> DataFrame:
    """``(n, least, most)``: smallest and largest bit text of each factor over ``history(n, bits)``; texts of one length compare as numbers."""
    return history.groupBy("n").agg(F.min("bits").alias("least"), F.max("bits").alias("most"))
