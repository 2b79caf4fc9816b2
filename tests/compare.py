"""A query's rows against its SQL, as the driver compares them."""

import datetime
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, query, sql: str, folder: Path) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, str(folder))
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in res.fetchall())
    assert got == want
