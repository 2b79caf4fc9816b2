"""Per-key results although a handful of keys hold most rows.

Value-frequency compression: rows are first grouped by (key, value), which spreads a hot key over as many
groups as it has values and shrinks repeats to one weighted value. Distinct counts, modes and percentiles
then come exactly from the weighted values; per key only running sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitloom.functions.ids import spelled_number, spelled_numbers


def weighted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, value, weight)``: one row per key and distinct value, null values included, with its row count."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"))


def key_counts(freq: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, distinct non-null values and the most frequent value (ties: the smallest) of every key, for numeric values.

    ``freq`` is the result of :func:`weighted_values`. A key that has only nulls gets 0 values and a null mode.
    """
    top = F.max_by(F.struct(F.col(value).alias("value"), F.col("weight").alias("n")), F.struct(F.col(value).isNotNull(), F.col("weight"), -F.col(value)))
    return freq.groupBy(*keys).agg(F.sum("weight").alias("n_rows"), F.count(value).alias("n_values"), top.alias("_top")).select(*keys, "n_rows", "n_values", F.col("_top.value").alias("mode"), F.when(F.col("_top.value").isNotNull(), F.col("_top.n")).alias("mode_rows"))


def cuts_below(v: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are below ``v``, by binary search."""
    if not cuts:
        return F.lit(0)
    bounds = F.lit(cuts)
    steps = F.lit([1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.element_at(bounds, F.least(at + step, F.lit(len(cuts)))) < v), at + step).otherwise(at))


def weighted_percentiles(freq: DataFrame, keys: list[str], value: str, shares: list[float], blocks: int = 1024) -> DataFrame:
    """Exact lower percentiles (the smallest value whose cumulated weight reaches share x total) per key.

    A key's values are spread over ``blocks`` value ranges, cut at approximate quantiles of all values. Block
    totals (at most ``blocks`` rows a key) find the block that holds a percentile; only that block's values
    are then ordered, so no task sees all values of a key. Nulls are left out; a key without values has no row.
    """
    spark = freq.sparkSession
    rows = freq.where(F.col(value).isNotNull())
    cuts = rows.stat.approxQuantile(value, [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))
    cuts = sorted(set(cuts))
    rows = rows.withColumn("_block", cuts_below(F.col(value).cast("double"), cuts))
    totals = rows.groupBy(*keys, "_block").agg(F.sum("weight").alias("_w"))
    w = Window.partitionBy(*keys).orderBy("_block")
    totals = totals.withColumn("_upto", F.sum("_w").over(w)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    wanted = spark.createDataFrame([(float(s),) for s in shares], "share double")
    need = totals.crossJoin(F.broadcast(wanted)).withColumn("_need", F.greatest(F.col("share") * F.col("_all"), F.lit(1.0)))
    hit = need.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_w") < F.col("_need"))).select(*keys, "_block", "share", (F.col("_need") - F.col("_upto") + F.col("_w")).alias("_rest"))
    inner = rows.join(hit, [*keys, "_block"])
    w2 = Window.partitionBy(*keys, "_block", "share").orderBy(value)
    inner = inner.withColumn("_cum", F.sum("weight").over(w2))
    return inner.where((F.col("_cum") >= F.col("_rest")) & (F.col("_cum") - F.col("weight") < F.col("_rest"))).select(*keys, "share", F.col(value).alias("value"))


def chapter_keys(df: DataFrame, *also: str) -> DataFrame:
    """``(field_name, key_id, chp, partners, *also)``: one row per row of the table and number that it names in a field."""
    rows = df.select(*also, spelled_number(F.col("chp_id")).alias("chp"), spelled_numbers(F.col("spk_id")).alias("spk"), spelled_numbers(F.col("author_id")).alias("author"))
    sides = F.array(F.struct(F.lit("spk_id").alias("field_name"), F.col("spk").alias("ids"), F.col("author").alias("partners")), F.struct(F.lit("author_id").alias("field_name"), F.col("author").alias("ids"), F.col("spk").alias("partners")))
    return rows.select(*also, "chp", F.explode(sides).alias("s")).select("s.field_name", F.explode("s.ids").alias("key_id"), "chp", "s.partners", *also)


def speaker_author_profile(df: DataFrame, hot_share: float = 0.02) -> DataFrame:
    """Rows, chapters and partners of every speaker and author, and which of them are hot.

    Result: ``field_name, key_id, n_rows, n_chapters, top_chapter, top_chapter_rows, n_partners, top_partner,
    top_partner_rows, is_hot``. A row counts once for each number it names, however often or however
    spelled. Rows without a chapter count as rows; ids that spell no number have no result. ``is_hot``: named
    in at least ``hot_share`` of all rows of the table. An empty table gives no rows.
    """
    keys = ["field_name", "key_id"]
    named = chapter_keys(df)
    by_chapter = key_counts(weighted_values(named, keys, "chp"), keys, "chp")
    pairs = named.select(*keys, F.explode("partners").alias("partner"))
    by_partner = key_counts(weighted_values(pairs, keys, "partner"), keys, "partner")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    chapters = by_chapter.select(*keys, "n_rows", F.col("n_values").alias("n_chapters"), F.col("mode").alias("top_chapter"), F.col("mode_rows").alias("top_chapter_rows"))
    partners = by_partner.select(*keys, F.col("n_values").alias("n_partners"), F.col("mode").alias("top_partner"), F.col("mode_rows").alias("top_partner_rows"))
    out = chapters.join(partners, keys, "left").withColumn("n_partners", F.coalesce("n_partners", F.lit(0).cast("bigint")))
    return out.crossJoin(F.broadcast(total)).withColumn("is_hot", F.col("n_rows") / F.col("_total") >= F.lit(hot_share)).drop("_total")
