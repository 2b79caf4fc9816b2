"""Samples whose categories have given shares, with minima and a report of what could not be met.

Quotas are allocated top-down over a tree of categories of any depth: a node hands its quota to its children, and what a
child cannot fill goes to its siblings; only what a whole family cannot fill goes on to the cousins, and what they
cannot fill to the next wider circle. The draw at the leaves takes the first ranks of a permutation of each category.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitloom.functions.ids import spelled_number
from splitloom.workspace import Workspace

#: Records in a bucket of the permutation; only buckets that a quota cuts are ranked, each in a task of its own.
BUCKET_RECORDS = 50_000


def gender_category(values: Column) -> Column:
    """Distinct whole numbers of an array in rising order, joined by ``+``; ``none`` if there is none (NaN, negative and null values are ignored)."""
    kept = F.filter(values, lambda x: (x >= 0) & (x < 1e18))
    codes = F.array_sort(F.array_distinct(F.transform(kept, lambda x: x.cast("bigint"))))
    return F.when(F.size(codes) > 0, F.array_join(F.transform(codes, lambda x: x.cast("string")), "+")).otherwise("none")


def record_categories(df: DataFrame, record: Column, values: str) -> DataFrame:
    """``(record_id, category)``: one row per record, its category taken from the values in all its rows. Rows without a record are left out."""
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(values), F.array().cast("array<double>")), lambda x: (x >= 0) & (x < 1e18))))
    rows = df.select(record.alias("record_id"), clean.alias("v")).where(F.col("record_id").isNotNull())
    return rows.groupBy("record_id").agg(F.flatten(F.collect_set("v")).alias("v")).select("record_id", gender_category(F.col("v")).alias("category"))


def gender_path(category: Column) -> Column:
    """The families of a gender category, widest first: with or without a value, then one value or how many."""
    n = F.size(F.split(category, r"\+"))
    return F.when(category == "none", F.array(F.lit("none"))).otherwise(F.array(F.lit("some"), F.when(n == 1, "single").otherwise("several"), n.cast("string")))


def _fill(want: list[float], room: list[int], total: int) -> list[int]:
    """Whole quotas near ``want`` (largest remainders), none above ``room``; what one cannot take goes to the others in proportion to what they want."""
    got = [0] * len(want)
    rest = min(total, sum(room))
    while rest > 0:
        free = [i for i in range(len(want)) if got[i] < room[i]]
        goal = {i: max(want[i] - got[i], 0.0) for i in free}
        if sum(goal.values()) < 1e-9:  # all wishes met: the rest goes to those that want most
            goal = {i: want[i] for i in free}
            if sum(goal.values()) < 1e-9:
                goal = {i: float(room[i] - got[i]) for i in free}
        scale = min(1.0, rest / sum(goal.values())) if sum(max(want[i] - got[i], 0.0) for i in free) >= rest else rest / sum(goal.values())
        exact = {i: min(goal[i] * scale, room[i] - got[i]) for i in free}
        step = {i: math.floor(exact[i] + 1e-9) for i in free}
        spare = rest - sum(step.values())
        for i in sorted(free, key=lambda i: (-(exact[i] - step[i]), i)):
            if spare > 0 and exact[i] - step[i] > 1e-9 and got[i] + step[i] < room[i]:
                step[i] += 1
                spare -= 1
        if not any(step.values()):
            step[max(free, key=lambda i: (goal[i], -i))] = 1
        for i in free:
            got[i] += step[i]
        rest = min(total, sum(room)) - sum(got)
    return got


@dataclass
class Allotment:
    """What a category wants (not rounded), gets, and lacks: its wish or minimum above its own records, passed on to its relatives."""

    wanted: float
    quota: int
    lacking: float


def _hand_down(members: list[tuple[tuple[str, ...], int]], want: list[float], room: list[int], quota: int, got: list[int]) -> None:
    """Spread ``quota`` over the leaves ``(rest of the path, number)``: by the next name of their paths first, then within each."""
    families: dict[str, list[tuple[tuple[str, ...], int]]] = {}
    for path, i in members:
        # a leaf without further names is a family of its own
        families.setdefault(f"/{path[0]}" if path else f"={i:09d}", []).append((path[1:], i))
    names = sorted(families)
    kin = [[i for _, i in families[f]] for f in names]
    for f, q in zip(names, _fill([sum(want[i] for i in k) for k in kin], [sum(room[i] for i in k) for k in kin], quota)):
        if len(families[f]) == 1:
            got[families[f][0][1]] += q
        else:
            _hand_down(families[f], want, room, q, got)


def allocate(rows: list[dict], size: float) -> dict[str, Allotment]:
    """Allotment of each category; ``rows`` have ``category, path, share, least, available``, the path from the widest family to the narrowest.

    ``size`` is the size of the sample before it is rounded. Every category first gets its minimum (as far as it has records). The rest
    of the size x the sum of the shares is handed down the tree: to families by what their members want and up to what they
    hold, then to their families, then to the members. A minimum above the share takes from the others, not from the size, as long as they
    have more than their own minimum.
    """
    rows = sorted(rows, key=lambda r: r["category"])
    floor = [min(r["least"], r["available"]) for r in rows]
    whole = math.floor(size + 0.5)
    total = max(math.floor(whole * min(1.0, sum(r["share"] for r in rows)) + 0.5), sum(floor))
    want = [max(whole * r["share"] - f, 0.0) for r, f in zip(rows, floor)]
    room = [r["available"] - f for r, f in zip(rows, floor)]
    got = list(floor)
    _hand_down([(tuple(r["path"]), i) for i, r in enumerate(rows)], want, room, total - sum(floor), got)
    out = {}
    for r, q in zip(rows, got):
        wanted = size * r["share"]
        # a wish that equals the number of records up to rounding errors is met
        lacking = max(wanted * (1 - 1e-12) - r["available"], r["least"] - r["available"], 0.0)
        out[r["category"]] = Allotment(wanted, q, lacking)
    return out


_QUOTA = "plan_id int, table_name string, category string, records bigint, available bigint, wanted double, quota bigint, lacking double"


def _plan_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one plan for one table; its rows are as many as its targets."""
    records = int(pdf["records"].iloc[0])
    rows = [{"category": c, "path": g["path"].iloc[0], "share": float(g["target_share"].sum()), "least": int(g["min_records"].max()), "available": int(g["available"].iloc[0])} for c, g in pdf.groupby("category")]
    got = allocate(rows, float(pdf["sample_rate"].iloc[0]) * records)
    return pd.DataFrame([(pdf["plan_id"].iloc[0], pdf["table_name"].iloc[0], r["category"], records, r["available"], a.wanted, a.quota, a.lacking) for r in rows for a in [got[r["category"]]]], columns=[x.split()[0] for x in _QUOTA.split(", ")])


def plan_quotas(records: DataFrame, targets: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """``(plan_id, table_name, category, records, available, wanted, quota, lacking)`` for ``records(table_name, record_id, category)``.

    ``tree(category, path array<string>)`` names the families of each category, widest first, to any depth; without it, or for a
    category that it does not name, those of gender categories hold. ``lacking``: what the category's own records are short of its wish or minimum. Several target rows of one category in a plan add up; their largest minimum holds. Null shares and minima count
    as 0; a plan for a table without records gets quotas of 0. Rows without plan, category or rate are left out.
    """
    counts = records.groupBy("table_name", "category").agg(F.count(F.lit(1)).alias("available"))
    totals = counts.groupBy("table_name").agg(F.sum("available").alias("records"))
    known = targets.where("plan_id IS NOT NULL AND category IS NOT NULL AND sample_rate IS NOT NULL").select("plan_id", "table_name", "category", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_records", F.lit(0)).alias("min_records"), "sample_rate")
    joined = known.join(counts, ["table_name", "category"], "left").join(totals, "table_name", "left").fillna(0, ["available", "records"])
    path = gender_path(F.col("category"))
    if tree is not None:
        joined = joined.join(tree.select("category", F.col("path").alias("_path")).dropDuplicates(["category"]), "category", "left")
        path = F.coalesce("_path", path)
    return joined.withColumn("path", path).groupBy("plan_id", "table_name").applyInPandas(_plan_quotas, _QUOTA)


def draw(records: DataFrame, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """``(plan_id, table_name, category, record_id)``: the first ``quota`` ranks of each plan's permutation of each category.

    The permutation orders records by a hash of seed, plan and record. Ranks are dense over the whole category without
    gathering it: records fall into buckets by hash, counts per bucket tell which buckets are taken whole, and only the bucket
    that the quota cuts is ranked row by row. What is broadcast has one row per target.
    """
    wide = F.broadcast(quotas.where("quota > 0").select("plan_id", "table_name", "category", "quota", F.greatest(F.lit(1), (F.col("available") / BUCKET_RECORDS).cast("int")).alias("_buckets")))
    hashed = records.select("table_name", "category", "record_id").join(wide, ["table_name", "category"]).withColumn("_h", F.xxhash64(F.lit(seed), "plan_id", "record_id"))
    hashed = hashed.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 20), F.col("_buckets").cast("bigint")))
    keys = ["plan_id", "table_name", "category"]
    counts = hashed.groupBy(*keys, "_b", "quota").agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")))
    cut = upto.where(F.col("_upto") >= F.col("quota")).groupBy(*keys).agg(F.min_by(F.struct("_b", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_rest")), "_b").alias("_cut"))
    marked = hashed.join(F.broadcast(cut), keys)
    whole = marked.where(F.col("_b") < F.col("_cut._b"))
    ranked = marked.where(F.col("_b") == F.col("_cut._b")).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "record_id"))).where(F.col("_rank") <= F.col("_cut._rest"))
    return whole.select(*keys, "record_id").union(ranked.select(*keys, "record_id"))


def target_report(quotas: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target row: what it wants, what there is, what is drawn, what is lacking and ``is_short``.

    A category is short when the allocation had to pass on a part of its wish, sample_rate x records x target_share, or of its
    minimum, because its own records do not suffice; see :func:`allocate`. Targets without plan, category or rate, or for a table without
    records, are short.
    """
    got = quotas.select("plan_id", "table_name", "category", "records", "available", "quota", "lacking")
    want = F.col("sample_rate") * F.col("records") * F.coalesce("target_share", F.lit(0.0))
    out = targets.join(got, ["plan_id", "table_name", "category"], "left").withColumn("wanted", want)
    short = F.coalesce(F.col("lacking") > 0, F.lit(True)) | (F.coalesce("records", F.lit(0)) == 0)
    return out.select("plan_id", "table_name", "category", "target_share", "min_records", "sample_rate", "records", "available", "wanted", "quota", "lacking", short.alias("is_short"))


def plan_check(quotas: DataFrame, drawn: DataFrame) -> DataFrame:
    """``(plan_id, table_name, total, in_bounds, drawn_as_allotted)`` of every plan.

    ``total`` is the sum of its quotas, ``in_bounds`` whether every quota is at most the records of its category, ``drawn_as_allotted`` whether
    the draw holds just the quota of each category and no record twice.
    """
    keys = ["plan_id", "table_name"]
    n = drawn.groupBy(*keys, "category", "record_id").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys, "category").agg(F.sum("_c").alias("_n"), F.max("_c").alias("_most"))
    both = quotas.join(n, [*keys, "category"], "left").fillna(0, ["_n", "_most"])
    return both.groupBy(*keys).agg(F.sum("quota").alias("total"), F.min(F.col("quota").between(0, F.col("available"))).alias("in_bounds"), F.min((F.col("_n") == F.col("quota")) & (F.col("_most") <= 1)).alias("drawn_as_allotted"))


def gender_records(chapters: DataFrame, interviews: DataFrame) -> DataFrame:
    """``(table_name, record_id, category)`` of the two tables that are sampled, written once to the shared folder."""
    a = record_categories(chapters, spelled_number(F.col("chp_id")).cast("string"), "spk_gender").select(F.lit("disconnected_subset_eg").alias("table_name"), "record_id", "category")
    b = record_categories(interviews, F.col("id"), "subj_gender").select(F.lit("connected_fraction_constraints").alias("table_name"), "record_id", "category")
    return Workspace(chapters.sparkSession, "sample").write(a.union(b))
