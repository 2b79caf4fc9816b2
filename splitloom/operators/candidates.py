"""Candidate splits over factor values, evaluated many at a time.

A candidate selects factor values. A record is on side 0 when all its values are selected, on side 1 when none is, and on neither
otherwise or when it has no value in some factor. Up to 60 candidates are packed into one BIGINT per value, so one group-by
with bitwise aggregates decides all of them for a record.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.operators.dataset import SplitDataset, flat_values

#: Candidates in a block: 15 hex digits of an md5.
BLOCK = 60
FULL = (1 << BLOCK) - 1


def md5_mask(seed: int, block: Column, n: Column, value: Column) -> Column:
    """60 random bits for (seed, block, factor, value), the same in every engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), n.cast("string"), value)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def random_masks(values: DataFrame, n_candidates: int, seed: int = 0) -> DataFrame:
    """``(block, n, value, mask)``: bit j of a block is the choice of candidate 60 x block + j. ``values(n, value)`` are the factor values."""
    blocks = values.sparkSession.range(-(-n_candidates // BLOCK)).select(F.col("id").alias("block"))
    out = values.select("n", "value").crossJoin(F.broadcast(blocks))
    return out.select("block", "n", "value", md5_mask(seed, F.col("block"), F.col("n"), F.col("value")).alias("mask"))


def mask_bits(masks: DataFrame, n_candidates: int) -> DataFrame:
    """``(cand_id, n, value, bit)``: the packed choices one by one."""
    j = F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))
    bits = masks.withColumn("j", j).select((F.col("block") * BLOCK + F.col("j")).cast("bigint").alias("cand_id"), "n", "value", F.expr("(shiftright(mask, j) & 1) = 1").alias("bit"))
    return bits.where(F.col("cand_id") < n_candidates)


def constant_candidates(masks: DataFrame, n_candidates: int) -> DataFrame:
    """``(cand_id)`` of candidates that select all or none of the values of some factor: their sides are empty."""
    per = masks.groupBy("block", "n").agg(F.expr("bit_and(mask)").alias("al"), F.expr("bit_or(mask)").alias("an"))
    bad = per.groupBy("block").agg(F.expr(f"bit_or(al | (~an & {FULL}L))").alias("bad"))
    j = F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))
    out = bad.withColumn("j", j).where(F.expr("(shiftright(bad, j) & 1) = 1")).select((F.col("block") * BLOCK + F.col("j")).cast("bigint").alias("cand_id"))
    return out.where(F.col("cand_id") < n_candidates)


def packed_sides(postings: DataFrame, masks: DataFrame, n_factors: int) -> DataFrame:
    """``(block, id, train, held)``: bit j of ``train`` (``held``) says that candidate j puts the record on side 0 (1)."""
    hit = postings.select("n", "value", "id").join(masks, ["n", "value"])
    per = hit.groupBy("block", "id").agg(F.expr("bit_and(mask)").alias("al"), F.expr("bit_or(mask)").alias("an"), F.expr("bit_or(shiftleft(1L, n))").alias("seen"))
    whole = per.where(F.col("seen") == F.lit((1 << n_factors) - 1))
    return whole.select("block", "id", F.col("al").alias("train"), F.expr(f"~an & {FULL}L").alias("held"))


def unpack_members(sides: DataFrame, n_candidates: int) -> DataFrame:
    """``(cand_id, id, side, ...)`` for records on a side of a candidate, with what other columns ``sides`` has."""
    more = [c for c in sides.columns if c not in ("block", "id", "train", "held")]
    # no condition on the masks before they are unpacked: it would be pushed below the expressions that make them, which would run twice
    out = sides.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(min(BLOCK, n_candidates) - 1))))
    side = F.expr("CASE WHEN shiftright(train, j) & 1 = 1 THEN 0 WHEN shiftright(held, j) & 1 = 1 THEN 1 END")
    out = out.select((F.col("block") * BLOCK + F.col("j")).cast("bigint").alias("cand_id"), "id", side.alias("side"), *more)
    return out.where((F.col("cand_id") < n_candidates) & F.col("side").isNotNull())


@dataclass(frozen=True)
class PackedSides:
    """Members of candidates as packed sides ``(block, id, train, held)``: fields of the records join one row per block, not one per candidate."""

    sides: DataFrame
    n_candidates: int

    def fields(self, records: DataFrame, cols: list[Column]) -> DataFrame:
        """``(cand_id, id, side, cols)`` for every member."""
        return unpack_members(self.sides.join(records.select("id", *cols), "id"), self.n_candidates)

    def unpack(self) -> DataFrame:
        return unpack_members(self.sides, self.n_candidates)

    def only(self, cand_id: int) -> DataFrame:
        """``(id, side)`` of one candidate."""
        return _only(self.sides, cand_id)


@dataclass(frozen=True)
class RandomSides:
    """Members of random candidates, decided inside each record's row: the choice of a value is a hash, so nothing is joined or shuffled.

    The same sides as :func:`packed_sides` over :func:`random_masks`. Ids are unique.
    """

    ds: SplitDataset
    n_candidates: int
    seed: int

    def packed(self, records: DataFrame, cols: list[Column]) -> DataFrame:
        """``(block, id, train, held, cols)``."""
        values = [F.transform(flat_values(self.ds.records, f), lambda x: x.cast("string")) for f in self.ds.factors]
        rows = records.select("id", *cols, *[v.alias(f"_v{n}") for n, v in enumerate(values)])
        more = [c for c in rows.columns if not c.startswith("_v")]
        for n in range(len(values)):
            rows = rows.where(F.size(f"_v{n}") > 0)
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(-(-self.n_candidates // BLOCK) - 1).cast("bigint"))))
        al, an = F.lit(FULL).cast("bigint"), F.lit(0).cast("bigint")
        for n in range(len(values)):
            rows = rows.withColumn(f"_v{n}", F.transform(f"_v{n}", partial(md5_mask, self.seed, F.col("block"), F.lit(n))))
            al = al.bitwiseAND(F.aggregate(f"_v{n}", F.lit(FULL).cast("bigint"), lambda a, x: a.bitwiseAND(x)))
            an = an.bitwiseOR(F.aggregate(f"_v{n}", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)))
        return rows.select(*more, "block", al.alias("train"), F.lit(FULL).cast("bigint").bitwiseAND(F.bitwise_not(an)).alias("held"))

    def fields(self, records: DataFrame, cols: list[Column]) -> DataFrame:
        """``(cand_id, id, side, cols)`` for every member; ``records`` are those of the dataset."""
        return unpack_members(self.packed(records, cols), self.n_candidates)

    def unpack(self) -> DataFrame:
        return self.fields(self.ds.records, [])

    def only(self, cand_id: int) -> DataFrame:
        """``(id, side)`` of one candidate."""
        return _only(self.packed(self.ds.records, []), cand_id)


def _only(sides: DataFrame, cand_id: int) -> DataFrame:
    bit = [F.expr(f"(shiftright({c}, {cand_id % BLOCK}) & 1) = 1") for c in ("train", "held")]
    return sides.where(F.col("block") == cand_id // BLOCK).select("id", F.when(bit[0], 0).when(bit[1], 1).alias("side")).where("side IS NOT NULL")


def with_fields(members, records: DataFrame, *cols: Column) -> DataFrame:
    """``(cand_id, id, side, cols)``: columns of the records beside every member; ``members(cand_id, id, side)`` or packed."""
    if isinstance(members, DataFrame):
        return members.join(records.select("id", *cols), "id")
    return members.fields(records, list(cols))


def plain_members(postings: DataFrame, bits: DataFrame, n_factors: int) -> DataFrame:
    """The same from ``bits(cand_id, n, value, bit)``, one row per candidate and posting."""
    hit = postings.select("n", "value", "id").join(bits, ["n", "value"])
    per = hit.groupBy("cand_id", "id").agg(F.expr("bool_and(bit)").alias("al"), F.expr("bool_or(bit)").alias("an"), F.expr("bit_or(shiftleft(1L, n))").alias("seen"))
    side = F.when(F.col("al"), 0).when(~F.col("an"), 1)
    return per.where(F.col("seen") == F.lit((1 << n_factors) - 1)).select("cand_id", "id", side.alias("side")).where(F.col("side").isNotNull())


def factor_members(postings: DataFrame, bits: DataFrame) -> DataFrame:
    """``(cand_id, n, id, side)``: the split of each factor alone, before the factors are intersected."""
    hit = postings.select("n", "value", "id").join(bits, ["n", "value"])
    per = hit.groupBy("cand_id", "n", "id").agg(F.expr("bool_and(bit)").alias("al"), F.expr("bool_or(bit)").alias("an"))
    return per.select("cand_id", "n", "id", F.when(F.col("al"), 0).when(~F.col("an"), 1).alias("side")).where(F.col("side").isNotNull())


def index_bits(values: DataFrame, cand_id: int, n: int, index: int) -> DataFrame:
    """``(cand_id, n, value, bit)`` of a power-set index of any size: its binary digits, first digit first, over the sorted values of factor ``n``.

    ``values(n, value, pos)``; the index lies between 1 and 2 ** values - 2.
    """
    size = values.where(F.col("n") == n).count()
    if not 1 <= index <= 2**size - 2:
        raise ValueError(f"the index lies between 1 and {2**size - 2}")
    digits = format(index, f"0{size}b")
    return values.where(F.col("n") == n).select(F.lit(cand_id).cast("bigint").alias("cand_id"), "n", "value", (F.substring(F.lit(digits), F.col("pos").cast("int") + 1, F.lit(1)) == "1").alias("bit"))


def bit_strings(bits: DataFrame, values: DataFrame) -> DataFrame:
    """``(cand_id, n, bits)``: the digits of each factor over its sorted values as text.

    A text has as many digits as the factor has values, by definition; where that is too long, work with ``bits``.
    """
    placed = bits.join(values.select("n", "value", "pos"), ["n", "value"])
    return placed.groupBy("cand_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("b")).select("cand_id", "n", F.array_join(F.transform("b", lambda x: F.when(x["bit"], "1").otherwise("0")), "").alias("bits"))


def neighbours(strings: DataFrame) -> DataFrame:
    """``(cand_id, n, bits, flipped, neighbour)`` for ``strings(cand_id, n, bits)``: all one-bit flips that are not constant.

    For two values the only neighbour of 01 is 10 and the other way round.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("bits")))
    flip = F.overlay(F.col("bits"), F.when(F.substring(F.col("bits"), F.col("flipped"), F.lit(1)) == "1", "0").otherwise("1"), F.col("flipped"))
    out = strings.where("bits <> ''").withColumn("flipped", at).withColumn("neighbour", flip)
    swap = F.when(F.col("bits").isin("01", "10"), F.reverse("bits")).otherwise(F.col("neighbour"))
    out = out.withColumn("neighbour", swap)
    return out.where(F.col("neighbour").contains("0") & F.col("neighbour").contains("1")).where(~F.col("bits").isin("01", "10") | (F.col("flipped") == 1))


def neighbourhood(strings: DataFrame, depth: int, max_neighbors: int, seed: int = 0) -> DataFrame:
    """``(bits)``: texts at exactly ``depth`` flips from the texts of ``strings(bits)``, at most ``max_neighbors``, in seeded random order."""
    seen = strings.select("bits").distinct()
    cur = seen
    for _ in range(depth):
        step = neighbours(cur.select(F.lit(0).alias("cand_id"), F.lit(0).alias("n"), "bits")).select(F.col("neighbour").alias("bits")).distinct().join(seen, "bits", "left_anti")
        step = step.orderBy(F.xxhash64(F.lit(seed), "bits"), "bits").limit(max_neighbors)
        seen, cur = seen.union(step).distinct(), step
    return cur


def best_candidate(scores: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """The one row of ``scores`` with the least total; ties go to the smaller bit texts (if given), then to the smaller number."""
    order = ["total", "cand_id"]
    if strings is not None:
        scores = scores.join(strings, "cand_id")
        order = ["total", "bits", "cand_id"]
    return scores.orderBy(*order).limit(1)
