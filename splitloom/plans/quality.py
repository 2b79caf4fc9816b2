"""Queries on failing lines (p3) and on keys that hold most rows (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.operators.heavy_keys import chapter_keys, speaker_author_profile, weighted_percentiles, weighted_values
from splitloom.sources.raw_lines import failed_lines, load_lines


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/raw_lines.parquet")


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/disconnected_subset_eg.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_lines(_lines(spark, d)).select("line_id", "reason")


def p3_loaded_constraints(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(_lines(spark, d), "dummy_constraints.tsv")


def p3_loaded_fraction_constraints(spark: SparkSession, d: str) -> DataFrame:
    return load_lines(_lines(spark, d), "dummy_fraction_constraints.tsv")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return speaker_author_profile(_chapters(spark, d)).where("is_hot").select("field_name", "key_id")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return speaker_author_profile(_chapters(spark, d))


def p5_delay_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile of the seconds between recording and loading, per speaker and author."""
    df = _chapters(spark, d).withColumn("delay", F.unix_seconds("loaded_at") - F.unix_seconds("recorded_at"))
    keys = ["field_name", "key_id"]
    named = chapter_keys(df, "delay")
    return weighted_percentiles(weighted_values(named, keys, "delay"), keys, "delay", [0.5, 0.95])


_NUM = r"TRY_CAST(NULLIF(regexp_extract({x}, '^[\s\p{{Z}}]*(?:\p{{L}}+[_:# ]?)?\+?0*([1-9][0-9]{{0,17}})(?:\.0*)?[\s\p{{Z}}]*$', 1), '') AS BIGINT)"


def sql_number(x: str) -> str:
    """SQL for the number that a text spells."""
    return _NUM.format(x=x)


_NAMED = f"""
rows_ AS (SELECT row_number() OVER () AS rid, {sql_number('chp_id')} AS chp, spk_id, author_id, date_diff('second', date_trunc('second', recorded_at), date_trunc('second', loaded_at)) AS delay FROM disconnected_subset_eg),
spk AS (SELECT DISTINCT rid, {sql_number('x')} AS k FROM (SELECT rid, unnest(spk_id) AS x FROM rows_) WHERE {sql_number('x')} IS NOT NULL),
aut AS (SELECT DISTINCT rid, {sql_number('x')} AS k FROM (SELECT rid, unnest(author_id) AS x FROM rows_) WHERE {sql_number('x')} IS NOT NULL),
named AS (SELECT 'spk_id' AS field_name, k AS key_id, rid FROM spk UNION ALL SELECT 'author_id', k, rid FROM aut)
"""

_WS = "' ' || chr(9) || chr(10) || chr(13)"
_NUMBER = r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$"
_LINES = f"""
l0 AS (SELECT line_id, file_name, rtrim(coalesce(raw_line, ''), {_WS}) AS line, CASE file_name WHEN 'dummy_constraints.tsv' THEN 5 ELSE 6 END AS width FROM raw_lines),
l1 AS (SELECT *, regexp_matches(line, '^("([^"]|"")*"|[^"\t][^"\t]*|)(\t("([^"]|"")*"|[^"\t][^"\t]*|))*$') AS fine,
  regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^\t]*)', 1) AS raw_cells FROM l0),
l2 AS (SELECT *, list_transform(raw_cells, lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) AS c, len(raw_cells) AS n FROM l1),
l3 AS (SELECT *, len(list_filter(string_split(c[4], ','), lambda x: NOT regexp_matches(x, '{_NUMBER}'))) AS bad_g,
  len(list_filter(string_split(c[5], ','), lambda x: NOT (regexp_matches(x, '{_NUMBER}') AND coalesce(TRY_CAST(trim(x) AS DOUBLE) > 0, false)))) AS bad_d,
  CASE WHEN width = 6 THEN len(list_filter(string_split(c[6], ','), lambda x: NOT (regexp_matches(x, '{_NUMBER}') AND coalesce(TRY_CAST(trim(x) AS DOUBLE) > 0 AND TRY_CAST(trim(x) AS DOUBLE) <= 1, false)))) ELSE 0 END AS bad_f FROM l2),
l4 AS (SELECT *, CASE WHEN NOT fine THEN 'quoting' WHEN n <> width THEN 'column_count' WHEN trim(c[1], {_WS}) = '' OR bad_g > 0 OR bad_d > 0 OR bad_f > 0 THEN 'value' END AS reason FROM l3)
"""


def _loaded(file: str, fraction: bool) -> str:
    text = "list_filter(list_transform(string_split(c[{i}], ','), lambda x: trim(x, " + _WS + ")), lambda x: x <> '')"
    nums = "list_transform(string_split(c[{i}], ','), lambda x: CAST(trim(x) AS DOUBLE))"
    last = f", {nums.format(i=6)} AS fraction" if fraction else ""
    return f"WITH {_LINES} SELECT line_id, trim(c[1], {_WS}) AS id, {text.format(i=2)} AS speaker, {text.format(i=3)} AS prompt, {nums.format(i=4)} AS gender, {nums.format(i=5)} AS duration{last} FROM l4 WHERE reason IS NULL AND file_name = '{file}'"


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded_constraints, p3_loaded_fraction_constraints, p5_found, p5_profile, p5_delay_percentiles)}

SQL = {
    "p3_found": f"WITH {_LINES} SELECT line_id, reason FROM l4 WHERE reason IS NOT NULL",
    "p3_loaded_constraints": _loaded("dummy_constraints.tsv", False),
    "p3_loaded_fraction_constraints": _loaded("dummy_fraction_constraints.tsv", True),
    "p5_found": f"WITH {_NAMED} SELECT field_name, key_id FROM named GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM disconnected_subset_eg)",
    "p5_profile": f"""WITH {_NAMED},
pairs AS (SELECT 'spk_id' AS field_name, spk.k AS key_id, aut.k AS partner FROM spk JOIN aut USING (rid) UNION ALL SELECT 'author_id', aut.k, spk.k FROM aut JOIN spk USING (rid)),
p AS (SELECT field_name, key_id, partner, count(*) AS n FROM pairs GROUP BY ALL),
pt AS (SELECT field_name, key_id, count(*) AS n_partners, arg_max(partner, (n, -partner)) AS top_partner, max(n) AS top_partner_rows FROM p GROUP BY ALL),
c AS (SELECT field_name, key_id, chp, count(*) AS n FROM named JOIN rows_ USING (rid) GROUP BY ALL),
ct AS (SELECT field_name, key_id, sum(n)::BIGINT AS n_rows, count(chp) AS n_chapters, arg_max(chp, (n, -chp)) FILTER (chp IS NOT NULL) AS top_chapter, max(n) FILTER (chp IS NOT NULL) AS top_chapter_rows FROM c GROUP BY ALL)
SELECT field_name, key_id, n_rows, n_chapters, top_chapter, top_chapter_rows, coalesce(n_partners, 0) AS n_partners, top_partner, top_partner_rows, n_rows >= 0.02 * (SELECT count(*) FROM disconnected_subset_eg) AS is_hot FROM ct LEFT JOIN pt USING (field_name, key_id)""",
}
SQL["p5_delay_percentiles"] = f"""WITH {_NAMED},
d AS (SELECT field_name, key_id, delay, row_number() OVER (PARTITION BY field_name, key_id ORDER BY delay) AS r, count(*) OVER (PARTITION BY field_name, key_id) AS n FROM named JOIN rows_ USING (rid) WHERE delay IS NOT NULL)
SELECT field_name, key_id, 0.5::DOUBLE AS share, min(delay) FILTER (r >= 0.5 * n) AS value FROM d GROUP BY ALL UNION ALL SELECT field_name, key_id, 0.95::DOUBLE, min(delay) FILTER (r >= 0.95 * n) FROM d GROUP BY ALL"""
