"""Command line: ``python -m splitloom.cli ODIR CONFIG METADATA... [--seed N | --jobs N] [--use-components] [--partition-and-split FILE:K]``.

Below ODIR: config.json, history (with the score of every constraint), partition, stats, distributions, overlaps; with ``--jobs`` also best_seeds.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from splitloom.config import parse_config
from splitloom.operators import report
from splitloom.operators.graph import from_components
from splitloom.operators.splitters import best_of_seeds, split
from splitloom.sources import tables
from splitloom.workspace import Workspace


def run(spark: SparkSession, odir: str, conf_path: str, metadata: list[str], seed: int | None = None, use_components: bool = False, partition_and_split: str | None = None, jobs: int | None = None, top: int = 5) -> float:
    """Read, split, report; returns the total score. Results are written below ``odir``. ``jobs``: the best of the seeds 0 to ``jobs``, and the ``top`` of them."""
    import yaml

    raw = yaml.safe_load(Path(conf_path).read_text())
    conf = parse_config(raw)
    conf = replace(conf, seed=conf.seed if seed is None else seed, use_components=use_components, partition_and_split=partition_and_split)
    ds = tables.read_tsv(spark, metadata, conf) if conf.format == "tsv" else tables.read_supervisions(spark, metadata, conf)
    # distributions are compared over the vocabulary of the whole data, before any restriction
    specs = []
    for i, s in enumerate(conf.specs):
        if s.name in ("kl", "kl_tuple") and not s.values.get("vocab"):
            s = replace(s, values=s.values | {"vocab": sorted(r["value"] for r in ds.vocabulary(i).collect())})
        specs.append(s)
    conf = replace(conf, specs=tuple(specs))
    if partition_and_split:
        file, _, k = partition_and_split.rpartition(":")
        ds = tables.restrict(ds, tables.read_partition(spark, file), int(k))
    members = None
    searched = ds
    if use_components:
        searched, members = from_components(ds)
    result = split(searched, conf) if jobs is None else best_of_seeds(searched, conf, jobs)
    part = result.assignment.select("id", F.col("side").alias("split"))
    if members is not None and searched is not ds:
        part = tables.expand_components(part, members)
    whole = Workspace(spark, "cli").write(report.overlap_test_sets(ds, part.select("id", F.col("split").alias("side"))))
    out = Path(odir)
    out.mkdir(parents=True, exist_ok=True)
    tables.write_config(conf, str(out / "config.json"))
    tables.write_json(result.history, str(out / "history"))
    tables.write_partition(whole, str(out / "partition"))
    tables.write_json(report.split_stats(ds, conf.specs, whole), str(out / "stats"))
    tables.write_json(report.split_distributions(ds, conf.specs, whole), str(out / "distributions"))
    if jobs is not None:
        tables.write_json(report.best_runs(result.history, top), str(out / "best_seeds"))
    tables.write_json(report.overlap_stats(ds, whole), str(out / "overlaps"))
    return result.total


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("odir")
    p.add_argument("config")
    p.add_argument("metadata", nargs="+")
    p.add_argument("--seed", type=int)
    p.add_argument("--jobs", type=int)
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--use-components", action="store_true")
    p.add_argument("--partition-and-split")
    a = p.parse_args()
    spark = SparkSession.builder.appName("splitloom").getOrCreate()
    print(run(spark, a.odir, a.config, a.metadata, a.seed, a.use_components, a.partition_and_split, a.jobs, a.top))


if __name__ == "__main__":
    main()
