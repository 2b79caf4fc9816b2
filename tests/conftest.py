import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1]) + ":" + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dummy_tsv(tmp_path_factory):
    """Seven records in the tab-separated form."""
    rows = ["id\tspeaker\tprompt\tgender\tduration\tfraction", "a\ts1\tp1\t0\t2.3\t0.0176787", "b\ts1\tp2\t0\t15.2\t0.116833", "c\ts2\tp2\t1\t4\t0.0307456", "d\ts2\tp3\t1\t25\t0.19216", "e\ts3\tp3\t1\t32.5\t0.249808", "f\ts4,s5\tp3\t0\t31.0\t0.238278", "g\ts5,s6\tp3,p4\t0\t20.1\t0.154497"]
    path = tmp_path_factory.mktemp("tsv") / "dummy.tsv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def union_find(edges, vertices=()):
    """Component of every vertex, named by its smallest member."""
    parent = {v: v for v in vertices}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in parent}
