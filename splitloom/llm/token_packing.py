"""Items of varying size in containers of fixed capacity (vector bin packing, dot-product heuristic)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitloom.workspace import Workspace

#: Items packed together by one task. A group leaves about one container part empty, so its size bounds the loss.
GROUP_ITEMS = 20_000
MOST_PARTITIONS = 10_000

_classes: list[np.ndarray] = []


def _character_classes() -> np.ndarray:
    """0: white space, 1: letters, digits and underscore, 2: all else, for every code point."""
    if not _classes:
        table = np.full(0x110000, 2, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum() or c == "_":
                table[i] = 1
            elif c.isspace():
                table[i] = 0
        _classes.append(table)
    return _classes[0]


def token_counts(texts: list[str | None], most: int = 4_000_000) -> np.ndarray:
    """WordPunct tokens (``\\\\w+|[^\\\\w\\\\s]+``) of each text; 0 for null."""
    out = np.zeros(len(texts), np.int64)
    table = _character_classes()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= most):
            size += len(texts[last] or "")
            last += 1
        part = [t or "" for t in texts[first:last]]
        codes = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = table[codes]
        begins = kind != 0
        begins[1:] &= kind[1:] != kind[:-1]
        upto = np.concatenate(([0], np.cumsum(begins)))
        ends = np.cumsum([len(t) + 1 for t in part])
        out[first:last] = np.diff(upto[np.concatenate(([0], ends))])
        first = last
    return out


def count_tokens(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every row with a text; null texts are left out, empty ones have 0."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": token_counts(pdf["_text"].to_list())})

    return documents.select("doc_id", F.col(text).alias("_text")).where(F.col("_text").isNotNull()).mapInPandas(count, schema)


def split_long(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` with ``piece, first_token, n_tokens, item_tokens``: an item of more than ``capacity`` tokens in full pieces and a rest, any other whole."""
    number = F.expr(f"sequence(0L, greatest(0L, cast(ceil(item_tokens / {int(capacity)}) as bigint) - 1))")
    out = items.withColumnRenamed("n_tokens", "item_tokens").withColumn("piece", F.explode(number))
    return out.withColumn("first_token", F.col("piece") * capacity).withColumn("n_tokens", F.least(F.lit(capacity).cast("bigint"), F.col("item_tokens") - F.col("first_token")))


def pack_vectors(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Container number of every row of ``sizes``; no container exceeds ``capacity`` in any dimension.

    Dot-product heuristic: of all items that fit, the one goes into the open container whose relative sizes have the largest
    product with the relative room left; a container is closed when nothing fits. Items of equal sizes are
    interchangeable, so the search runs over distinct size vectors.
    """
    if (sizes > capacity).any():
        raise ValueError("an item exceeds the capacity")
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    order = np.argsort(kind_of, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(kind_of, minlength=len(kinds)))))
    nxt, end = start[:-1].copy(), start[1:]
    relative = kinds / capacity
    out = np.empty(len(sizes), np.int64)
    alive = np.arange(len(kinds))
    container, left = 0, len(sizes)
    while left:
        room = capacity.astype(np.int64).copy()
        fits = alive[nxt[alive] < end[alive]]
        alive = fits
        while len(fits):
            k = fits[np.argmax(relative[fits] @ (room / capacity))]
            out[order[nxt[k]]] = container
            nxt[k] += 1
            left -= 1
            room -= kinds[k]
            if nxt[k] == end[k]:
                fits = fits[fits != k]
            fits = fits[(kinds[fits] <= room).all(1)]
        container += 1
    return out


def pack(items: DataFrame, limits: dict[str, int], group_items: int = GROUP_ITEMS) -> DataFrame:
    """``items`` with ``container_id``: containers of at most ``limits[column]`` in every column named there.

    Items are spread over groups of about ``group_items`` by a hash of their columns and their place in the table (so copies of one item
    are spread, too), and each group is packed by one task, so a task's work does not grow with the data. Sizes must not be null, negative or above the limit (split longer items
    first). An empty table gives no rows.
    """
    names = list(limits)
    capacity = np.array([limits[c] for c in names], np.int64)
    groups = max(1, -(-items.count() // group_items))
    schema = T.StructType([T.StructField("container_id", T.LongType()), *items.schema.fields])

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = pack_vectors(pdf[names].to_numpy(np.int64), capacity)
        pdf = pdf.drop(columns="_group")
        pdf.insert(0, "container_id", key[0] * (1 << 32) + number)
        return pdf

    # rows are small and the work on them is not: partitions are counted by groups, not by bytes
    spread = items.withColumn("_group", F.pmod(F.xxhash64(*items.columns, F.monotonically_increasing_id()), F.lit(groups))).repartition(min(groups, MOST_PARTITIONS), "_group")
    return spread.groupBy("_group").applyInPandas(one, schema)


def pack_documents(documents: DataFrame, capacity: int = 2048, segments: int = 256) -> DataFrame:
    """``(container_id, doc_id, piece, first_token, n_tokens, item_tokens, segments, loss_tokens)``: all texts in containers.

    Limits: tokens, segments (texts or pieces in a container) and loss-bearing tokens; every token of a plain document bears
    loss. Only texts longer than a container are split, into full pieces and one rest. Texts without tokens and null texts
    take no room and are left out. Repeated rows of a document are packed each.
    """
    counted = Workspace(documents.sparkSession, "packing").write(count_tokens(documents))
    pieces = split_long(counted.where("n_tokens > 0"), capacity).select("doc_id", "piece", "first_token", "n_tokens", "item_tokens", F.lit(1).cast("bigint").alias("segments"), F.col("n_tokens").alias("loss_tokens"))
    return pack(pieces, {"n_tokens": capacity, "segments": segments, "loss_tokens": capacity})


def count_example_tokens(examples: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, loss_tokens)`` of ``examples(doc_id, prompt, answer)``: tokens of both parts, of which those of the answer bear loss. A null part has none."""
    schema = T.StructType([examples.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("loss_tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answer = token_counts(pdf["_answer"].to_list())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": token_counts(pdf["_prompt"].to_list()) + answer, "loss_tokens": answer})

    return examples.select("doc_id", F.col("prompt").alias("_prompt"), F.col("answer").alias("_answer")).mapInPandas(count, schema)


def pack_examples(examples: DataFrame, capacity: int = 2048, segments: int = 16, loss_capacity: int = 1536) -> DataFrame:
    """``(container_id, doc_id, piece, first_token, n_tokens, item_tokens, segments, loss_tokens)``: instruction data in containers.

    ``examples(doc_id, prompt, answer)``; the answer follows its prompt and alone bears loss. A container keeps all three limits: tokens,
    examples and loss-bearing tokens. Only an example above a limit is split, into pieces that keep both limits; its prompt comes first.
    Examples without tokens take no room and are left out. Repeated rows are packed each.
    """
    counted = Workspace(examples.sparkSession, "packing").write(count_example_tokens(examples).where("n_tokens > 0")).withColumnRenamed("n_tokens", "item_tokens")
    # a piece of the answer is no longer than either limit; the prompt takes the room in front of the first ones
    size = min(capacity, loss_capacity)
    fits = (F.col("item_tokens") <= capacity) & (F.col("loss_tokens") <= loss_capacity)
    n = F.when(fits, 1).otherwise(F.ceil(F.col("item_tokens") / size)).cast("bigint")
    out = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).withColumn("_fits", fits)
    first = F.when(F.col("_fits"), F.lit(0)).otherwise(F.col("piece") * size).cast("bigint")
    length = F.when(F.col("_fits"), F.col("item_tokens")).otherwise(F.least(F.lit(size).cast("bigint"), F.col("item_tokens") - F.col("piece") * size))
    prompt = F.col("item_tokens") - F.col("loss_tokens")
    out = out.withColumns({"first_token": first, "n_tokens": length, "segments": F.lit(1).cast("bigint")})
    loss = F.col("first_token") + F.col("n_tokens") - F.greatest(F.col("first_token"), F.least(prompt, F.col("first_token") + F.col("n_tokens")))
    out = out.withColumn("loss_tokens", loss).select("doc_id", "piece", "first_token", "n_tokens", "item_tokens", "segments", "loss_tokens")
    return pack(out, {"n_tokens": capacity, "segments": segments, "loss_tokens": loss_capacity})


def packing_check(packed: DataFrame, limits: dict[str, int], least_fill: float) -> DataFrame:
    """``(tokens, pieces_in_order, within_limits, well_filled)``, one row about the containers of ``packed``.

    ``pieces_in_order``: the pieces of every item begin where the last one ended and hold all its tokens. ``well_filled``: the containers use
    at least ``least_fill`` of the room of the scarcest limit, but for one container of each group of items packed together.
    """
    per = packed.groupBy("container_id").agg(*[F.sum(c).alias(c) for c in limits])
    used = [F.sum(c) / F.lit(float(m)) for c, m in limits.items()]
    room = F.greatest(*used) >= least_fill * (F.count(F.lit(1)) - F.count_distinct(F.shiftright("container_id", 32)))
    whole = per.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.bool_and(_every([F.col(c) <= m for c, m in limits.items()])), F.lit(True)).alias("within_limits"), F.coalesce(room, F.lit(True)).alias("well_filled"))
    # copies of an item have the same pieces: the sum of begins and lengths tells whether they follow one another without a gap
    item = packed.groupBy("doc_id", "item_tokens").agg(F.sum("n_tokens").alias("n"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("copies"), F.min((F.col("first_token") == 0) == (F.col("piece") == 0)).alias("ok"))
    order = item.agg(F.coalesce(F.bool_and(F.col("ok") & (F.col("n") == F.col("copies") * F.col("item_tokens"))), F.lit(True)).alias("pieces_in_order"))
    return whole.crossJoin(F.broadcast(order)).select("tokens", "pieces_in_order", "within_limits", "well_filled")


def _every(conditions: list) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
