"""Constraint scores of many candidate splits at once.

``members(cand_id, id, side)`` says which records a candidate puts on side 0 (train) or 1 (held out); packed members
(``candidates``) are unpacked beside the fields they need, so no row per candidate and record is shuffled. Numeric constraints
are reduced to one number per record, then all of them and all candidates are aggregated in one group-by; distributions take one more, over values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitloom.config import ConstraintSpec
from splitloom.operators.candidates import with_fields
from splitloom.operators.dataset import SplitDataset, flat_values

#: Score of a candidate with an empty side (fixed value).
WORST_SCORE = 99999.0

REDUCTIONS = ("mean", "sum", "min", "max", "concat", "none")


def reduce_values(df: DataFrame, field: str, reduction: str, weighting: str) -> Column:
    """One number per record. Unweighted: mean, sum, min or max of all its values.

    Weighted: a record's (or each component member's) weight multiplies sum, min and max, and weighs the members in the mean.
    A record without values gets null and takes no part.
    """
    if reduction not in REDUCTIONS:
        raise ValueError(f"unknown reduction {reduction}")
    kind = df.schema[field].dataType
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    plus = lambda s, x: s + x
    one = F.coalesce(F.col("weights"), F.array(F.lit(1.0)))
    weight = F.aggregate(one, F.lit(0.0), plus)

    def number(c: Column) -> Column:
        return F.filter(F.transform(c, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))

    values = number(F.flatten(F.filter(F.col(field), lambda x: x.isNotNull()))) if nested else number(flat_values(df, field))
    total = F.aggregate(values, F.lit(0.0), plus)
    if weighting == "none":
        plain = {"mean": total / F.size(values), "sum": total, "min": F.array_min(values), "max": F.array_max(values)}
    elif nested:
        each = F.zip_with(F.col(field), one, lambda s, w: F.struct(F.aggregate(number(F.coalesce(s, F.array())), F.lit(0.0), plus).alias("s"), w.alias("w")))
        weighed = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["s"] * x["w"])
        plain = {"mean": weighed / weight, "sum": weighed, "min": weight * F.array_min(values), "max": weight * F.array_max(values)}
    else:
        plain = {"mean": total / F.size(values), "sum": weight * total, "min": weight * F.array_min(values), "max": weight * F.array_max(values)}
    if reduction not in plain:
        raise ValueError(f"reduction {reduction} gives no number")
    return F.when(F.size(values) > 0, plain[reduction])


@dataclass(frozen=True)
class Constraint:
    """A registered constraint: ``kind`` numeric uses (stat of side 0, stat of side 1) as columns, kind values uses distributions."""

    kind: str
    stat: str
    score: Callable


REGISTRY: dict[str, Constraint] = {}


def register(name: str, constraint: Constraint) -> None:
    if name in REGISTRY:
        raise ValueError(f"constraint {name} exists")
    REGISTRY[name] = constraint


def constraint(name: str) -> Constraint:
    if name not in REGISTRY:
        raise ValueError(f"unknown constraint {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


def _tuple_cost(a: Column, b: Column, values: list[float], power: float = 1.0) -> Column:
    return F.pow(F.abs(a - F.lit(float(values[0]))), F.lit(float(power))) + F.pow(F.abs(b - F.lit(float(values[1]))), F.lit(float(power)))


register("mean", Constraint("numeric", "mean", lambda a, b, v: F.abs(a - b)))
register("mean_tuple", Constraint("numeric", "mean", lambda a, b, v: _tuple_cost(a, b, v)))
register("sum", Constraint("numeric", "sum", lambda a, b, v: F.abs(a - b)))
register("sum_tuple", Constraint("numeric", "sum", lambda a, b, v: _tuple_cost(a, b, v["values"], v.get("power", 1.0))))


def _divergence(p: Column, q: Column, direction: str) -> Column:
    forward, reverse = p * (F.ln(p) - F.ln(q)), q * (F.ln(q) - F.ln(p))
    if direction == "forward":
        return forward
    if direction == "reverse":
        return reverse
    if direction == "symmetric":
        return (forward + reverse) / 2
    raise ValueError(f"unknown direction {direction}")


def _value_rows(ds: SplitDataset, n: int, members) -> DataFrame:
    """``(cand_id, side, value, w)``: the values of constraint ``n`` of every member with their weights."""
    rows = with_fields(members, ds.records, ds.constraint_values(n).alias("_z")).select("cand_id", "side", F.explode("_z").alias("_z"))
    return rows.select("cand_id", "side", F.col("_z.value").alias("value"), (F.col("_z.weight") if ds.weighting == "weighted" else F.lit(1.0)).alias("w"))


def _value_sums(ds: SplitDataset, n: int, members: DataFrame, vocab: list | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vocabulary, the weights of its values on both sides ``(cand_id, value, w0, w1)``, and ``(cand_id, t0, t1)`` over all values."""
    rows = _value_rows(ds, n, members)
    if vocab is not None:
        words = ds.records.sparkSession.createDataFrame([(v,) for v in vocab], T.StructType([T.StructField("value", rows.schema["value"].dataType)]))
    else:
        words = ds.vocabulary(n)
    words = words.distinct()
    # the vocabulary meets sums per candidate and value, not their rows
    sums = rows.groupBy("cand_id", "value").agg(F.sum(F.when(F.col("side") == 0, F.col("w"))).alias("w0"), F.sum(F.when(F.col("side") == 1, F.col("w"))).alias("w1")).join(words, "value", "left_semi")
    return words, sums, sums.groupBy("cand_id").agg(F.sum("w0").alias("t0"), F.sum("w1").alias("t1"))


def _share(s: int) -> Column:
    """(sum of weights + smooth) / (total + smooth x values) of a side, from w, t, k and smooth."""
    return (F.coalesce(f"w{s}", F.lit(0.0)) + F.col("smooth")) / (F.coalesce(f"t{s}", F.lit(0.0)) + F.col("smooth") * F.col("k"))


def distributions(ds: SplitDataset, n: int, members: DataFrame, cands: DataFrame, smooth: float, vocab: list | None = None) -> DataFrame:
    """``(cand_id, value, p0, p1)``: smoothed shares of every vocabulary value on both sides of every candidate.

    p = (sum of weights + smooth) / (total + smooth x values). The vocabulary is that of the whole dataset unless
    given, and never grows; values outside it are ignored.
    """
    words, sums, total = _value_sums(ds, n, members, vocab)
    size = words.agg(F.count(F.lit(1)).alias("k"))
    # every candidate meets every value of a fixed vocabulary: the result has that size by definition
    grid = cands.select("cand_id").crossJoin(words)
    full = grid.join(sums, ["cand_id", "value"], "left").join(total, "cand_id", "left").crossJoin(F.broadcast(size)).withColumn("smooth", F.lit(smooth))
    return full.select("cand_id", "value", _share(0).alias("p0"), _share(1).alias("p1"))


def _kl_scores(ds: SplitDataset, n: int, spec: ConstraintSpec, members: DataFrame, cands: DataFrame) -> DataFrame:
    v = spec.values or {}
    direction, smooth = v.get("direction", "forward"), float(v.get("smooth", 1e-6))
    if spec.name == "kl_tuple":
        if not v.get("vocab"):
            raise ValueError("kl_tuple needs a vocabulary")
        dist = distributions(ds, n, members, cands, smooth, v["vocab"])
        target = ds.records.sparkSession.createDataFrame([(w, float(a), float(b)) for w, a, b in zip(v["vocab"], *v["dist"])], T.StructType([T.StructField("value", dist.schema["value"].dataType), T.StructField("q0", T.DoubleType()), T.StructField("q1", T.DoubleType())]))
        cost = _divergence(F.col("q0"), F.col("p0"), direction) + _divergence(F.col("q1"), F.col("p1"), direction)
        return dist.join(F.broadcast(target), "value").groupBy("cand_id").agg(F.sum(cost).alias("score"))
    # values that a candidate has on neither side all have the same shares: they are counted, not listed
    words, sums, total = _value_sums(ds, n, members, v.get("vocab"))
    size = words.agg(F.count(F.lit(1)).alias("k"))
    seen = sums.join(total, "cand_id").crossJoin(F.broadcast(size)).withColumn("smooth", F.lit(smooth))
    per = seen.groupBy("cand_id").agg(F.sum(_divergence(_share(0), _share(1), direction)).alias("_seen"), F.count(F.lit(1)).alias("_n"), F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.first("k").alias("k"))
    rest = per.withColumns({"w0": F.lit(0.0), "w1": F.lit(0.0), "smooth": F.lit(smooth)})
    unseen = F.when(F.col("k") > F.col("_n"), (F.col("k") - F.col("_n")) * _divergence(_share(0), _share(1), direction)).otherwise(0.0)
    return rest.select("cand_id", (F.col("_seen") + unseen).alias("score"))


def entropy_stats(ds: SplitDataset, n: int, members: DataFrame) -> DataFrame:
    """``(cand_id, side, stat)``: 1 + sum(p ln p) / ln k over the k values seen on a side; 1 (the worst) if there is one value only."""
    sums = _value_rows(ds, n, members).groupBy("cand_id", "side", "value").agg(F.sum("w").alias("w"))
    # sum(p ln p) = sum(w ln w) / W - ln W needs no second pass for the total
    per = sums.where("w > 0").groupBy("cand_id", "side").agg(F.sum("w").alias("t"), F.sum(F.col("w") * F.ln("w")).alias("wl"), F.count(F.lit(1)).alias("k"))
    return per.select("cand_id", "side", F.when(F.col("k") > 1, 1.0 + (F.col("wl") / F.col("t") - F.ln("t")) / F.ln(F.col("k").cast("double"))).otherwise(1.0).alias("stat"))


def _entropy_scores(ds: SplitDataset, n: int, spec: ConstraintSpec, members: DataFrame, cands: DataFrame) -> DataFrame:
    w = spec.values or [0.0, 1.0]
    weight = F.when(F.col("side") == 0, F.lit(float(w[0]))).otherwise(F.lit(float(w[1])))
    return entropy_stats(ds, n, members).groupBy("cand_id").agg(F.sum(weight * F.col("stat")).alias("score"))


register("kl", Constraint("values", "distribution", _kl_scores))
register("kl_tuple", Constraint("values", "distribution", _kl_scores))
register("max_entropy", Constraint("values", "entropy", _entropy_scores))


def _numeric(ds: SplitDataset, specs: tuple[ConstraintSpec, ...]) -> tuple[list[Column], list[int]]:
    """``_w, r0, r1, ...``: one reduced number per numeric constraint, and which these are."""
    at = [i for i, s in enumerate(specs) if constraint(s.name).kind == "numeric"]
    cols = [reduce_values(ds.records, ds.constraints[i], specs[i].reduction, ds.weighting).alias(f"r{i}") for i in at]
    w = F.aggregate(F.coalesce("weights", F.array(F.lit(1.0))), F.lit(0.0), lambda s, x: s + x) if ds.weighting == "weighted" else F.lit(1.0)
    return [w.alias("_w"), *cols], at


def side_stats(ds: SplitDataset, specs: tuple[ConstraintSpec, ...], members: DataFrame) -> DataFrame:
    """``(cand_id, side, length, stat0, stat1, ...)``: size and the statistic of every numeric or entropy constraint of each side."""
    reduced, at = _numeric(ds, specs)
    aggs = [F.count(F.lit(1)).alias("length")]
    for i in at:
        r, w = F.col(f"r{i}"), F.col("_w")
        if constraint(specs[i].name).stat == "mean":
            aggs.append((F.sum(w * r) / F.sum(F.when(r.isNotNull(), w))).alias(f"stat{i}"))
        else:
            aggs.append(F.coalesce(F.sum(r), F.lit(0.0)).alias(f"stat{i}"))
    out = with_fields(members, ds.records, *reduced).groupBy("cand_id", "side").agg(*aggs)
    for i, s in enumerate(specs):
        if s.name == "max_entropy":
            out = out.join(entropy_stats(ds, i, members).withColumnRenamed("stat", f"stat{i}"), ["cand_id", "side"], "left")
    return out


def constraint_scores(ds: SplitDataset, specs: tuple[ConstraintSpec, ...], members: DataFrame, cands: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """``(cand_id, n0, n1, score0, score1, ..., total)`` for every candidate of ``cands(cand_id)``.

    Constraints count by position, so two on one field both count. ``total`` is the weighted sum; a candidate with an empty side
    gets WORST_SCORE as total and null scores. A constraint that has no value on a side gives null and WORST_SCORE, too.
    """
    if len(specs) != len(ds.constraints):
        raise ValueError("one constraint for each constraint field")
    weights = weights or (1.0,) * len(specs)
    numeric = [i for i, s in enumerate(specs) if constraint(s.name).kind == "numeric"]
    stats = side_stats(ds, tuple(s if s.name != "max_entropy" else ConstraintSpec("kl", s.values, s.reduction) for s in specs), members)
    wide = stats.groupBy("cand_id").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == s, F.col("length"))), F.lit(0)).alias(f"n{s}") for s in (0, 1)],
        *[F.max(F.when(F.col("side") == s, F.col(f"stat{i}"))).alias(f"s{i}_{s}") for i in numeric for s in (0, 1)],
    )
    out = cands.select("cand_id").join(wide, "cand_id", "left").fillna(0, ["n0", "n1"])
    for i, spec in enumerate(specs):
        c = constraint(spec.name)
        if c.kind == "numeric":
            out = out.withColumn(f"score{i}", c.score(F.col(f"s{i}_0"), F.col(f"s{i}_1"), spec.values))
        else:
            out = out.join(c.score(ds, i, spec, members, cands).withColumnRenamed("score", f"score{i}"), "cand_id", "left")
    full = (F.col("n0") > 0) & (F.col("n1") > 0)
    scores = [F.when(full, F.col(f"score{i}")).alias(f"score{i}") for i in range(len(specs))]
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.col(f"score{i}")
    return out.select("cand_id", "n0", "n1", *scores, F.when(full, F.coalesce(total, F.lit(WORST_SCORE))).otherwise(F.lit(WORST_SCORE)).alias("total"))


def kl_divergence(p: list[float], q: list[float], direction: str = "forward") -> float:
    """The same divergence for two plain lists, used by the single-task searches."""
    f = sum(a * math.log(a / b) for a, b in zip(p, q))
    r = sum(b * math.log(b / a) for a, b in zip(p, q))
    return {"forward": f, "reverse": r, "symmetric": (f + r) / 2}[direction]
