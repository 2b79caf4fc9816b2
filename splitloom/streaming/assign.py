"""New records against a frozen split, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frozen_values(postings: DataFrame, partition: DataFrame) -> DataFrame:
    """``(n, value, in_train, in_held)``: which sides of a frozen partition hold a value."""
    sides = postings.join(partition.where("split IN (0, 1)"), "id")
    return sides.groupBy("n", "value").agg(F.max(F.col("split") == 0).alias("in_train"), F.max(F.col("split") == 1).alias("in_held"))


def assign_stream(new_postings: DataFrame, frozen: DataFrame) -> DataFrame:
    """``(event_time, id, n, value, touches)``: each posting of a stream of new records with the side that already holds its value.

    ``touches`` is train, held, both or none. A stream-static join: stateless, in append mode, one row per posting, so a record with
    many values never has to be gathered; :func:`decide` folds finished batches.
    """
    side = F.when(F.col("in_train") & F.col("in_held"), "both").when(F.col("in_train"), "train").when(F.col("in_held"), "held").otherwise("none")
    return new_postings.join(frozen, ["n", "value"], "left").select("event_time", "id", "n", "value", side.alias("touches"))


def decide(touched: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """``(window, id, split)``: 0 if a record touches only train (or nothing), 1 if only held out, 2 if both, per event-time window.

    Late postings are accepted up to the watermark.
    """
    rows = touched.withWatermark("event_time", watermark) if touched.isStreaming else touched
    train, held = F.max(F.col("touches").isin("train", "both")), F.max(F.col("touches").isin("held", "both"))
    split = F.when(train & held, 2).when(held, 1).otherwise(0)
    return rows.groupBy(F.window("event_time", window), "id").agg(split.alias("split"))
