"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back, so a lost executor costs a
re-read and nothing else. The folder is the one the session names in ``spark.checkpoint.dir``; a local
session that names none gets a temporary folder of its own, deleted at the end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys with more than 1/HEAVY_KEYS of all rows are joined by broadcast, so at most HEAVY_KEYS rows are broadcast.
HEAVY_KEYS = 1000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="splitloom-")
        atexit.register(shutil.rmtree, _own_dirs[sc.applicationId], ignore_errors=True)
    return _own_dirs[sc.applicationId]


class Workspace:
    """Numbered tables of one operator call; a superseded table can be dropped to save disk."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/splitloom-{label}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._splitloom_path = path
        return out

    def write_with(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """Like :meth:`write`, with aggregates that are taken while the rows are written.

        A stage that is run again after a lost executor may count its rows twice: use the figures to choose
        a way or to see whether anything changed, not as results.
        """
        seen = Observation()
        out = self.write(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
        return out, seen.get

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_splitloom_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def size_measures() -> dict[str, Column]:
    """What to measure while a table with the rows per key (``n``) is written."""
    return {"total": F.coalesce(F.sum("n"), F.lit(0)), "most": F.coalesce(F.max("n"), F.lit(0))}


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, sizes: DataFrame | None = None, how: str = "inner", measured: dict | None = None) -> DataFrame:
    """Join ``rows`` with at most one row per key of ``per_key``, whatever share of the rows one key has.

    Keys that hold more than 1/HEAVY_KEYS of the rows (their number is bounded by that) meet their row by
    broadcast, all others by a shuffle on the key. ``sizes(key, n)`` gives the rows per key and is
    computed here when it is not given, ``measured`` its :func:`size_measures`. Rows whose key is null match nothing; ``how`` is inner or left.
    """
    if sizes is None:
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if measured is None:
        measured = sizes.agg(*[c.alias(k) for k, c in size_measures().items()]).first().asDict()
    cut = max(10_000, measured["total"] // HEAVY_KEYS)
    if measured["most"] <= cut:
        return rows.join(per_key, key, how)
    heavy = sizes.where((F.col("n") > cut) & F.col(key).isNotNull()).select(key)
    few = F.broadcast(per_key.join(F.broadcast(heavy), key, "left_semi"))
    hot = rows.join(F.broadcast(heavy), key, "left_semi").join(few, key, how)
    rest = rows.join(F.broadcast(heavy), key, "left_anti").join(per_key, key, how)
    return hot.unionByName(rest)
