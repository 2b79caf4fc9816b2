"""Sources of datasets (TSV, supervision manifests, pandas, partitions) and sinks of results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.config import TYPES, SplitConfig
from splitloom.operators.dataset import Relation, SplitDataset, dense_index
from splitloom.workspace import Workspace


def multi_value(cell, kind: str):
    """The distinct values of a comma-separated cell, cast; empty parts and parts that cannot be cast are dropped."""
    parts = F.transform(F.split(cell, ","), lambda x: F.trim(x))
    cast = F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.try_cast(kind))
    return F.coalesce(F.array_distinct(F.filter(cast, lambda x: x.isNotNull())), F.array().cast(f"array<{kind}>"))


def dataset(records: DataFrame, conf: SplitConfig) -> SplitDataset:
    """A dataset over ``records`` (id first) with the roles of its 1-based field indices. A missing ``weights`` column becomes 1."""
    fields = [c for c in records.columns if c not in ("id", "weights")]
    if max((*conf.factors, *conf.constraints)) > len(fields) or min((*conf.factors, *conf.constraints)) < 1:
        raise ValueError(f"field indices must be between 1 and {len(fields)}")
    if "weights" not in records.columns:
        records = records.withColumn("weights", F.array(F.lit(1.0)))
    order = sorted(range(len(conf.factors)), key=lambda i: conf.factors[i])
    factors, similar = tuple(fields[conf.factors[i] - 1] for i in order), tuple(Relation(*conf.relation(i)) for i in order)
    return SplitDataset(records, tuple(fields), factors, tuple(fields[i - 1] for i in conf.constraints), conf.weighting, similar)


def read_tsv(spark: SparkSession, path: str | list[str], conf: SplitConfig) -> SplitDataset:
    """Tab-separated file with a header line, id first, comma-separated values in cells.

    Weights come from the column ``fraction`` in any case, 1 where there is none. Rows without an id are left out.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    names = [c.strip() for c in raw.columns]
    raw = raw.toDF(*names)
    types = [TYPES[t] for t in conf.factor_types] + ["string"] * len(names)
    cols = [F.trim(F.col(f"`{names[0]}`")).alias("id")] + [multi_value(F.col(f"`{c}`"), types[i]).alias(c) for i, c in enumerate(names[1:])]
    frac = next((c for c in names[1:] if c.lower() == "fraction"), None)
    weights = F.array(F.coalesce(F.element_at(multi_value(F.col(f"`{frac}`"), "double"), 1), F.lit(1.0)) if frac else F.lit(1.0))
    return dataset(raw.select(*cols, weights.alias("weights")).where("id IS NOT NULL AND id <> ''"), conf)


def dedup_first(manifests: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of manifests without the keys that an earlier manifest holds; repeats inside one manifest stay."""
    out = None
    for i, m in enumerate(manifests):
        part = m.withColumn("manifest_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = out.groupBy(key).agg(F.min("manifest_no").alias("manifest_no"))
    return out.join(first, [key, "manifest_no"], "left_semi").drop("manifest_no")


def group_supervisions(rows: DataFrame, fields: list[str], key: str = "recording_id", duration: str = "duration") -> DataFrame:
    """``(id, fields, duration, fraction, weights)``: one record per key with its distinct values, total duration and share of the whole."""
    per = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(*[F.array_sort(F.collect_set(f)).alias(f) for f in fields], F.coalesce(F.sum(duration), F.lit(0.0)).alias("_d"))
    total = per.agg(F.sum("_d").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("_d") / F.col("_total")).otherwise(F.lit(0.0))
    return per.crossJoin(F.broadcast(total)).select("id", *fields, F.array("_d").alias("duration"), F.array(share).alias("fraction"), F.array(share).alias("weights"))


def read_supervisions(spark: SparkSession, paths: list[str], conf: SplitConfig) -> SplitDataset:
    """JSON-lines manifests (plain or gz), one path each, grouped into records."""
    rows = dedup_first([spark.read.json(p) for p in paths])
    return dataset(group_supervisions(rows, list(conf.lhotse_fields), conf.lhotse_groupby), conf)


def from_pandas(spark: SparkSession, pdf, conf: SplitConfig) -> SplitDataset:
    """A pandas frame whose first column is the id; lists are multi-valued fields."""
    return dataset(spark.createDataFrame(pdf.rename(columns={pdf.columns[0]: "id"})), conf)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """``(id, split)`` from a text file of ``id split`` lines; the split is what follows the last blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.regexp_extract("value", r"^(.*)\s+(\d+)\s*$", 1), F.regexp_extract("value", r"^(.*)\s+(\d+)\s*$", 2)
    return lines.select(parts[0].alias("id"), parts[1].try_cast("int").alias("split")).where("split IS NOT NULL")


def restrict(ds: SplitDataset, partition: DataFrame, split: int) -> SplitDataset:
    """The records of one split with weights that sum to 1 again; fewer than two records are an error."""
    ids = partition.where(F.col("split") == split).select("id")
    out = ds.subset(ids, renormalise=True)
    if out.records.limit(2).count() < 2:
        raise ValueError(f"split {split} has fewer than two records")
    return out


def write_partition(partition: DataFrame, path: str) -> None:
    """``id split`` lines; one folder of text files."""
    partition.select(F.concat_ws(" ", "id", F.col("split").cast("string")).alias("value")).write.mode("overwrite").text(path)


def expand_components(partition: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, split)`` of the members of partitioned components; ``members(component, id)``."""
    return members.join(partition.select(F.col("id").alias("component"), "split"), "component").select("id", "split")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_config(conf: SplitConfig, path: str) -> None:
    """The effective configuration, on the driver's file system."""
    Path(path).write_text(json.dumps(conf.as_dict(), indent=1, default=str))


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as GML text, streamed to one file on the driver's file system; nodes are numbered in id order, edges of unknown nodes left out."""
    ws = Workspace(nodes.sparkSession, "gml")
    numbered = ws.write(dense_index(nodes.select("id").distinct(), ["id"], "index", ws))
    ends = edges.join(numbered.toDF("src", "source"), "src").join(numbered.toDF("dst", "target"), "dst").select("source", "target", "capacity")
    with Path(path).open("w") as out:
        out.write("graph [\n")
        for r in numbered.orderBy("index").toLocalIterator():
            label = str(r["id"]).replace("&", "&amp;").replace('"', "&quot;")
            out.write(f'  node [\n    id {r["index"]}\n    label "{label}"\n  ]\n')
        for r in ends.orderBy("source", "target").toLocalIterator():
            out.write(f"  edge [\n    source {r['source']}\n    target {r['target']}\n    capacity {r['capacity']}\n  ]\n")
        out.write("]\n")
