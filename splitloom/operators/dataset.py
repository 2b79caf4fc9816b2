"""Records with multi-valued fields, and the long tables derived from them.

``records`` has an ``id``, one array column per field and ``weights``. Everything else is derived lazily: postings (one row
per record and factor value), values with their positions, constraint rows, vocabularies, slices and subsets.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitloom.workspace import Workspace


def flat_values(df: DataFrame, field: str) -> Column:
    """Distinct non-null values of a field as an array: scalars are wrapped, arrays of arrays flattened."""
    kind = df.schema[field].dataType
    c = F.col(field)
    if not isinstance(kind, T.ArrayType):
        c = F.array(c)
    elif isinstance(kind.elementType, T.ArrayType):
        c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast(f"array<{_element(kind)}>")), lambda x: x.isNotNull()))


def vectors_of(df: DataFrame, field: str) -> Column:
    """``array<array<double>>``: the distinct vectors of a record; a field of numbers is one vector. Null and empty vectors are none."""
    kind = df.schema[field].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"cosine compares vectors, {field} has none")
    c = F.col(field) if isinstance(kind.elementType, T.ArrayType) else F.array(field)
    numbers = F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: F.transform(v, lambda x: x.cast("double")))
    return F.coalesce(F.array_distinct(F.filter(numbers, lambda v: F.size(v) > 0)), F.array().cast("array<array<double>>"))


def vector_texts(df: DataFrame, field: str) -> Column:
    """The vectors of a record as texts, which join and sort."""
    return F.transform(vectors_of(df, field), lambda v: F.to_json(F.struct(v.alias("v"))))


def _element(kind: T.DataType) -> str:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind.simpleString()


def dense_index(df: DataFrame, order: list[str], name: str = "index", ws: Workspace | None = None) -> DataFrame:
    """``df`` with a dense 0-based position in ``order``, without gathering the rows in one task.

    Rows are range-partitioned and sorted; the sizes of the partitions (a few numbers each) give every
    partition its offset. Ties keep some order of their own.
    """
    ws = ws or Workspace(df.sparkSession, "index")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ws.write(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_part"], r["n"]) for r in marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset bigint")
    return marked.join(F.broadcast(table), "_part").withColumn(name, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")


@dataclass(frozen=True)
class Relation:
    """How two records are compared in a factor: similarity by name, its threshold, and its weight in the sum over factors."""

    name: str = "set_intersection"
    thresh: float = 0.0
    weight: float = 1.0


@dataclass(frozen=True)
class SplitDataset:
    """Records, one for each id, and the roles of their fields. ``weighting`` none: constraints are plain statistics; weighted: records count by their weights."""

    records: DataFrame
    fields: tuple[str, ...]
    factors: tuple[str, ...]
    constraints: tuple[str, ...] = ()
    weighting: str = "none"
    #: One for each factor; none: equal values relate records, each with weight 1.
    similar: tuple[Relation, ...] = ()

    @property
    def relations(self) -> tuple[Relation, ...]:
        return self.similar or (Relation(),) * len(self.factors)

    @property
    def plain(self) -> bool:
        """Whether a value's graph is made of its owners only."""
        return all(r.name in ("set_intersection", "boolean") for r in self.relations)

    def __post_init__(self):
        if len(self.relations) != len(self.factors):
            raise ValueError("one relation for each factor")
        missing = [f for f in (*self.factors, *self.constraints) if f not in self.fields]
        if missing:
            raise ValueError(f"no such fields: {missing}")

    def _with(self, records: DataFrame) -> "SplitDataset":
        return replace(self, records=records)

    def __len__(self) -> int:
        return self.records.count()

    def indexed(self) -> DataFrame:
        """Records with their dense position by id (ids compare as strings)."""
        return dense_index(self.records, ["id"])

    def record(self, i: int) -> DataFrame:
        """The id at position ``i``; no row beyond the end."""
        return self.indexed().where(F.col("index") == i).select("id")

    def slice(self, start: int = 0, stop: int | None = None, step: int = 1) -> "SplitDataset":
        """Records at the positions of a slice with non-negative bounds and positive step."""
        if start < 0 or step < 1 or (stop is not None and stop < 0):
            raise ValueError("bounds must not be negative, steps must be positive")
        keep = (F.col("index") >= start) & ((F.col("index") - start) % step == 0)
        if stop is not None:
            keep = keep & (F.col("index") < stop)
        return self._with(self.indexed().where(keep).drop("index"))

    def subset(self, ids: DataFrame, renormalise: bool = False) -> "SplitDataset":
        """Records whose id is in ``ids(id)``; ``renormalise`` scales the weights to sum to 1 (the ``fraction`` field stays as it is)."""
        kept = self.records.join(ids.select("id").distinct(), "id", "left_semi")
        if renormalise:
            total = kept.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)).alias("_total"))
            kept = kept.crossJoin(F.broadcast(total)).withColumn("weights", F.transform("weights", lambda x: x / F.col("_total"))).drop("_total")
        return self._with(kept)

    def posting_array(self, fields: tuple[str, ...] | None = None) -> Column:
        """``array<struct(n, field, value)>`` of a record: its distinct values of each factor (n counts factors from 0). Values are texts."""

        def named(i: int, f: str) -> Column:
            values = vector_texts(self.records, f) if fields is None and self.relations[i].name == "cosine" else flat_values(self.records, f)
            return F.transform(values, lambda x: F.struct(F.lit(i).alias("n"), F.lit(f).alias("field"), x.cast("string").alias("value")))

        return F.concat(*[named(i, f) for i, f in enumerate(fields or self.factors)])

    def postings(self, fields: tuple[str, ...] | None = None) -> DataFrame:
        """``(n, field, value, id)``: one row per record and distinct value of each factor, from one pass over the records."""
        return self.records.select(F.explode(self.posting_array(fields)).alias("p"), "id").select("p.n", "p.field", "p.value", "id")

    def values(self) -> DataFrame:
        """``(n, value, pos, n_records)``: distinct values of each factor in rising order (numbers by number), positions from 0."""
        out = None
        for i, f in enumerate(self.factors):
            of = vector_texts if self.relations[i].name == "cosine" else flat_values
            v = self.records.select(F.explode(of(self.records, f)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n_records"))
            part = dense_index(v, ["v"], "pos").select(F.lit(i).alias("n"), F.col("v").cast("string").alias("value"), "pos", "n_records")
            out = part if out is None else out.unionByName(part)
        return out

    def inverted_index(self, fields: tuple[str, ...]) -> DataFrame:
        """``(n, value, n_records, first_id, last_id)`` for the values of the named fields; the records themselves are the postings."""
        return self.postings(fields).groupBy("n", "value").agg(F.count(F.lit(1)).alias("n_records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))

    def constraint_values(self, n: int) -> Column:
        """``array<struct(value, weight)>`` of a record: the values of constraint ``n``, component members with their own weights.

        A record's weight applies to each of its values. A component has one set of values and one weight for each member.
        """
        f = self.constraints[n]
        kind = self.records.schema[f].dataType
        one = F.coalesce(F.col("weights"), F.array(F.lit(1.0)))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            return F.flatten(F.zip_with(f, one, lambda vs, w: F.transform(F.coalesce(vs, F.array().cast(kind.elementType)), lambda v: F.struct(v.alias("value"), w.alias("weight")))))
        total = F.aggregate(one, F.lit(0.0), lambda a, x: a + x)
        return F.transform(flat_values(self.records, f), lambda v: F.struct(v.alias("value"), total.alias("weight")))

    def constraint_rows(self, n: int) -> DataFrame:
        """``(id, value, weight)``: one row per record and value of constraint ``n``."""
        rows = self.records.select("id", F.explode(self.constraint_values(n)).alias("z"))
        return rows.select("id", F.col("z.value").alias("value"), F.col("z.weight").alias("weight"))

    def vocabulary(self, n: int) -> DataFrame:
        """``(value)``: sorted distinct values of a constraint field."""
        return self.records.select(F.explode(flat_values(self.records, self.constraints[n])).alias("value")).distinct()

    def field_rows(self, fields: tuple[str, ...]) -> DataFrame:
        """``(id, fields, weights)`` in id order, so values and weights stay aligned in a row."""
        return self.records.select("id", *fields, "weights").orderBy("id")

    def as_json(self) -> DataFrame:
        """``(id, json)``: a printable form of every record."""
        return self.records.select("id", F.to_json(F.struct(*self.fields)).alias("json"))
