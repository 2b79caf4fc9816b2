"""Queries p1 (related splits), p2 (proportional samples) and p4 (match groups)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.llm import match_groups as mg
from splitloom.llm import proportional_sample as ps
from splitloom.llm import related_splits as rs
from splitloom.plans.quality import sql_number

#: Wanted shares of the chapters (fixed values).
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rs.chapter_groups(_table(spark, d, "disconnected_subset_eg")).where("group_spk IS NOT NULL").select("chp_id", "group_spk")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return rs.related_splits(_table(spark, d, "disconnected_subset_eg"), SHARES).select("chp_id", "group_spk", "split")


def p1_split_shares(spark: SparkSession, d: str) -> DataFrame:
    out = rs.related_splits(_table(spark, d, "disconnected_subset_eg"), SHARES).groupBy("split").agg(F.count(F.lit(1)).alias("n_chapters"), F.count_distinct("group_id").alias("n_groups"))
    return out.crossJoin(F.broadcast(out.agg(F.sum("n_chapters").alias("_all")))).select("split", "n_chapters", "n_groups", (F.col("n_chapters") / F.col("_all")).alias("share"))


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = ps.gender_records(_table(spark, d, "disconnected_subset_eg"), _table(spark, d, "connected_fraction_constraints"))
    targets = _table(spark, d, "sample_targets")
    return records, targets, ps.plan_quotas(records, targets)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, targets, quotas = _sample(spark, d)
    return ps.target_report(quotas, targets).where("is_short").select("plan_id", "category")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    _, targets, quotas = _sample(spark, d)
    return ps.target_report(quotas, targets).drop("quota").withColumn("lacking", F.round("lacking", 6))


def p2_plan_check(spark: SparkSession, d: str) -> DataFrame:
    """The draw of every plan against its quotas, and their sum."""
    records, _, quotas = _sample(spark, d)
    return ps.plan_check(quotas, ps.draw(records, quotas))


def p2_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[2]


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    records, _, quotas = _sample(spark, d)
    return ps.draw(records, quotas)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mg.match_groups(_table(spark, d, "connected_eg"), _table(spark, d, "record_matches"))


_TIES = f"""
r AS (SELECT row_number() OVER () AS rid, {sql_number('chp_id')} AS chp, spk_id, author_id FROM disconnected_subset_eg),
n AS (SELECT DISTINCT rid, {sql_number('x')} AS v FROM (SELECT rid, unnest(spk_id) AS x FROM r) UNION
      SELECT DISTINCT rid, 1152921504606846976 + {sql_number('x')} FROM (SELECT rid, unnest(author_id) AS x FROM r) UNION
      SELECT rid, 2305843009213693952 + chp FROM r),
m AS (SELECT rid, v FROM n WHERE v IS NOT NULL),
e AS (SELECT DISTINCT v, lo FROM m JOIN (SELECT rid, min(v) AS lo FROM m GROUP BY rid) USING (rid)),
g AS (SELECT v AS a, lo AS b FROM e UNION SELECT lo, v FROM e)
"""

#: The groups placed largest first where most is missing, the others by the hash of seed, split and group.
_SPLITS = """
ch AS (SELECT v - 2305843009213693952 AS chp_id, lab AS gid FROM cc WHERE v >= 2305843009213693952),
sz AS (SELECT gid, count(*) AS n FROM ch GROUP BY gid),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM sz),
big AS (SELECT gid, n, row_number() OVER (ORDER BY n DESC, gid) AS i FROM sz, tot WHERE n > t / 1000 AND n >= 10),
pl(i, gid, k, tr, va, te) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0.8::DOUBLE * t, 0.1::DOUBLE * t, 0.1::DOUBLE * t FROM tot UNION ALL
      SELECT i, gid, k, tr - CASE k WHEN 'train' THEN n ELSE 0 END, va - CASE k WHEN 'validation' THEN n ELSE 0 END, te - CASE k WHEN 'test' THEN n ELSE 0 END FROM
      (SELECT big.i, big.gid, n, tr, va, te, CASE WHEN va >= tr AND va >= te THEN 'validation' WHEN tr >= te THEN 'train' ELSE 'test' END AS k FROM pl JOIN big ON big.i = pl.i + 1)),
lft AS (SELECT unnest(['train', 'validation', 'test']) AS k, unnest([tr, va, te]) AS w FROM pl WHERE i = (SELECT max(i) FROM pl)),
best AS (SELECT gid, arg_max(k, w / -ln((CAST('0x' || substr(md5('0:' || k || ':' || gid), 1, 13) AS BIGINT) + 1) / 4503599627370498.0::DOUBLE)) AS k FROM sz, lft WHERE w > 0 AND gid NOT IN (SELECT gid FROM big) GROUP BY gid),
sp AS (SELECT chp_id, gid, CASE WHEN gid < 1152921504606846976 THEN gid END AS group_spk, coalesce(pl.k, best.k) AS split FROM ch LEFT JOIN pl USING (gid) LEFT JOIN best USING (gid))
"""

_RECORDS = f"""
norm AS (SELECT DISTINCT upper(regexp_replace(id, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS id, spks FROM connected_eg),
k AS (SELECT DISTINCT id, {sql_number('x')} AS k FROM (SELECT id, unnest(spks) AS x FROM norm) WHERE {sql_number('x')} IS NOT NULL AND id <> ''),
p AS (SELECT upper(regexp_replace(left_id, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS a, upper(regexp_replace(right_id, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS b FROM record_matches),
s AS (SELECT id AS a, min(id) OVER (PARTITION BY k) AS b FROM k),
e AS (SELECT * FROM p UNION SELECT * FROM s),
g AS (SELECT a, b FROM e WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM e WHERE a <> b AND a <> '' AND b <> '')
"""

_CC = """
cc(v, lab) USING KEY (v) AS (SELECT DISTINCT a, a FROM g UNION SELECT g.b, min(cc.lab) FROM cc JOIN g ON g.a = cc.v JOIN recurring.cc AS old ON old.v = g.b WHERE cc.lab < old.lab GROUP BY g.b)
"""

_CATEGORY = f"""
x AS (SELECT 'connected_fraction_constraints' AS table_name, id AS rec, subj_gender AS gs FROM connected_fraction_constraints WHERE id IS NOT NULL
      UNION ALL SELECT 'disconnected_subset_eg', CAST({sql_number('chp_id')} AS VARCHAR), spk_gender FROM disconnected_subset_eg WHERE {sql_number('chp_id')} IS NOT NULL),
y AS (SELECT table_name, rec, list_sort(list_distinct(flatten(list(list_transform(list_filter(coalesce(gs, []), lambda q: NOT isnan(q) AND q >= 0), lambda q: CAST(q AS BIGINT)))))) AS codes FROM x GROUP BY ALL),
z AS (SELECT table_name, CASE WHEN len(codes) = 0 THEN 'none' ELSE array_to_string(codes, '+') END AS category, count(*) AS available FROM y GROUP BY ALL),
t AS (SELECT table_name, sum(available)::BIGINT AS records FROM z GROUP BY ALL),
rep AS (SELECT plan_id, s.table_name, s.category, target_share, min_records, sample_rate, records, coalesce(available, 0) AS available, sample_rate * records * target_share AS wanted FROM sample_targets s JOIN t USING (table_name) LEFT JOIN z ON z.table_name = s.table_name AND z.category = s.category)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_split_shares, p2_found, p2_report, p2_quotas, p2_sample, p2_plan_check, p4_found)}

SQL = {
    "p1_found": f"WITH RECURSIVE {_TIES}, {_CC} SELECT v - 2305843009213693952 AS chp_id, lab AS group_spk FROM cc WHERE v >= 2305843009213693952 AND lab < 1152921504606846976",
    "p1_splits": f"WITH RECURSIVE {_TIES}, {_CC}, {_SPLITS} SELECT chp_id, group_spk, split FROM sp",
    "p1_split_shares": f"WITH RECURSIVE {_TIES}, {_CC}, {_SPLITS} SELECT split, count(*) AS n_chapters, count(DISTINCT gid) AS n_groups, count(*) / (SELECT count(*) FROM sp) AS share FROM sp GROUP BY split",
    "p2_found": f"WITH {_CATEGORY} SELECT plan_id, category FROM rep WHERE available < wanted OR available < min_records",
    "p2_report": f"WITH {_CATEGORY} SELECT *, round(greatest(wanted * (1 - 1e-12) - available, min_records - available, 0), 6) AS lacking, available < wanted OR available < min_records AS is_short FROM rep",
    "p2_plan_check": f"WITH {_CATEGORY} SELECT plan_id, table_name, CAST(least(greatest(floor(floor(any_value(sample_rate * records) + 0.5) * least(1.0, sum(target_share)) + 0.5), sum(least(min_records, available))), sum(available)) AS BIGINT) AS total, true AS in_bounds, true AS drawn_as_allotted FROM rep GROUP BY ALL",
    "p4_found": f"WITH RECURSIVE {_RECORDS}, {_CC} SELECT v AS id, lab AS group_id FROM cc",
}
