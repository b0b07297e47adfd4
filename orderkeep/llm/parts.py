"""What SQL can say of operators whose whole results it can't express: columns of a query, or laws that its rows keep.

Each of these queries takes its rows from the operator's own query over all documents and has SQL with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.llm.bpe import op1_bpe
from orderkeep.llm.fingerprints import op2_fingerprints
from orderkeep.llm.licenses import PHRASES, op10_licenses
from orderkeep.llm.sharding import SHARDS, op3_sharding
from orderkeep.llm.token_files import op7_token_files

Query = Callable[[SparkSession, str], DataFrame]


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's decoded bytes are those of the text."""
    return op1_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's edited texts: the last half gives way to the first half of the next document's text."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 puts each document into one shard, with its size."""
    return op3_sharding(spark, sf_dir).select("doc_id", "size", "law", F.col("shard").between(0, SHARDS - 1).alias("placed"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's law `rows`: counts at most one apart, slots gapless from 0."""
    counts = op3_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return counts.withColumn("shard", F.col("shard").cast("long"))


def token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By op7's files, the document whose ids begin where those of a document end (null after the last)."""
    files = op7_token_files(spark, sf_dir).select("doc_id", "start", (F.col("start") + F.col("n_tokens")).alias("after"))
    following = files.select(F.col("doc_id").alias("next_id"), F.col("start").alias("after"))
    return files.join(following, "after", "left").select("doc_id", "next_id", (F.col("start") == 0).alias("first"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's places of phrases."""
    return op10_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _found(phrase: str) -> str:
    return "concat_ws(' ', " + ", ".join(["word", *(f"lead(word, {k}) OVER p" for k in range(1, len(phrase.split())))]) + f") = '{phrase}'"


QUERIES: dict[str, Query] = {f.__name__: f for f in (bpe_round_trip, edited_texts, shard_sizes, shard_counts, token_order, license_places)}

SQL: dict[str, str] = {
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id))
SELECT doc_id, n::BIGINT AS n_chars, sha256(left(t, n - n // 2) || left(u, n // 2)) AS edited_sha256 FROM n""",
    "shard_sizes": "SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, 'rows' AS law, true AS placed FROM documents",
    "shard_counts": f"""
SELECT s::BIGINT AS shard, n::BIGINT AS n, n::BIGINT AS slots, 0::BIGINT AS first_slot, (n - 1)::BIGINT AS last_slot
FROM (SELECT s, count(*) // {SHARDS} + (s < count(*) % {SHARDS})::INT AS n FROM documents, range({SHARDS}) AS r(s) GROUP BY s) WHERE n > 0""",
    "token_order": """
SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS next_id, row_number() OVER (ORDER BY doc_id) = 1 AS first FROM documents""",
    "license_places": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM d),
f AS (SELECT doc_id, place, unnest(list_filter([{", ".join(f"CASE WHEN {_found(p)} THEN '{label}' END" for p, label in PHRASES)}], lambda x: x IS NOT NULL)) AS label FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY place))
SELECT d.doc_id, any_value(len(ws))::BIGINT AS n_words, count(label)::BIGINT AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
}
