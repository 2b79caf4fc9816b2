"""Queries p6 (containers), p7 (leaks) and p8 (subjects)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.llm.leak_search import DRESSING, SHARED, find_leaks
from splitloom.llm.subject_models import subject_areas
from splitloom.llm.token_packing import pack_documents, pack_examples, packing_check
from splitloom.workspace import Workspace


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p7_item_report(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that carry a passage of it; items that did not leak have 0."""
    n = _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
    return _table(spark, d, "eval_items").select("item_id", "kind").join(n, "item_id", "left").fillna(0, ["n_docs"])


def p7_shared_spans(spark: SparkSession, d: str) -> DataFrame:
    """Items and documents that share a run of at least 20 words unchanged, common wording too: all that winnowing guarantees, against SQL."""
    return find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"), SHARED).select("item_id", "doc_id").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents")).where("item_tokens > 2048").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, and the share of the containers' room that is used."""
    c = pack_documents(_table(spark, d, "documents")).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.sum("segments").alias("segments"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.max("segments").alias("most_segments"), (F.sum("n") / (F.count(F.lit(1)) * 2048)).alias("used"))


def p6_packing_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers of all texts keep the limits, hold every token once and are filled to 98 %."""
    packed = Workspace(spark, "packed").write(pack_documents(_table(spark, d, "documents")))
    return packing_check(packed, {"n_tokens": 2048, "segments": 256, "loss_tokens": 2048}, 0.98)


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Texts as instruction data: what stands before the first blank line is the prompt, the rest the answer; a text without a blank line is all answer."""
    t = F.col("text")
    cut = F.instr(t, "\n\n")
    doc = _table(spark, d, "documents").where("text IS NOT NULL")
    return doc.select("doc_id", F.when(cut > 0, F.substring(t, F.lit(1), cut)).alias("prompt"), F.when(cut > 0, F.substring(t, cut, F.length(t))).otherwise(t).alias("answer"))


def p6_examples(spark: SparkSession, d: str) -> DataFrame:
    """Texts as instruction data under three limits that all bind: tokens, examples and loss-bearing tokens."""
    return pack_examples(_examples(spark, d))


def p6_examples_check(spark: SparkSession, d: str) -> DataFrame:
    packed = Workspace(spark, "packed").write(p6_examples(spark, d))
    return packing_check(packed, {"n_tokens": 2048, "segments": 16, "loss_tokens": 1536}, 0.95)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(_table(spark, d, "documents"), _table(spark, d, "subject_labels"), _table(spark, d, "subject_areas"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each subject and their share of all documents; documents of several subjects count for each."""
    docs = _table(spark, d, "documents").agg(F.count_distinct("doc_id").alias("_all"))
    n = _subjects(spark, d).groupBy("subject").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("mass").alias("words"))
    return n.crossJoin(F.broadcast(docs)).select("subject", "n_docs", "words", (F.col("n_docs") / F.col("_all")).alias("share"))


QUERIES = {f.__name__: f for f in (p6_found, p6_containers, p6_fill, p6_packing_check, p6_examples, p6_examples_check, p7_found, p7_item_report, p7_shared_spans, p8_found, p8_composition)}

_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+'))"


def _runs(table: str, key: str) -> str:
    """The hashes of all runs of 20 words of a table's texts."""
    dressing = DRESSING.pattern.replace("'", "''")
    return f"""(SELECT DISTINCT {key}, md5(array_to_string(t[i + 1 : i + 20], ' ')) AS h FROM (SELECT {key}, t, unnest(range(len(t) - 19)) AS i FROM
(SELECT {key}, regexp_extract_all(lower(regexp_replace(text, '{dressing}', ' ', 'gi')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {table} WHERE {key} IS NOT NULL)))"""


SQL = {
    "p7_shared_spans": f"SELECT DISTINCT item_id, doc_id FROM {_runs('eval_items', 'item_id')} JOIN {_runs('documents', 'doc_id')} USING (h)",
    "p6_found": f"SELECT DISTINCT doc_id FROM documents WHERE {_TOKENS} > 2048",
    "p6_packing_check": f"SELECT CAST(coalesce(sum({_TOKENS}), 0) AS BIGINT) AS tokens, true AS pieces_in_order, true AS within_limits, true AS well_filled FROM documents",
    "p6_examples_check": f"SELECT CAST(coalesce(sum({_TOKENS}), 0) AS BIGINT) AS tokens, true AS pieces_in_order, true AS within_limits, true AS well_filled FROM documents",
}
