"""The registered queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import chaining, chat, decontaminate, packing, pii, quality, secrets, sharding, simhash, suffixes
from lodestar.llm.common import documents

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel"
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.recover(conversations, chat.fit(conversations))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_context"
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(documents(spark, sf_dir), rest=True)


QUERIES = {q.__name__: q for q in (op1_sharding, op2_quality_rules, op3_secret_scan, op4_simhash_near_dedup, op5_chat_formatting, op6_suffix_dedup, op7_personal_data, op8_benchmark_decontamination, op9_packing, op10_fuzzy_passages)}

_WORD = r"[^\x20\x09-\x0D]+"

#: Hashes, fingerprints, tokens, compressed sizes and alignments are beyond SQL; tests/llm has plain Python for those.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
    l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
    n AS (SELECT *, translate(array_to_string(own, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
          FROM (SELECT *, regexp_extract_all(line, '{_WORD}') AS own FROM l) WHERE len(own) > 0),
    hosts AS (SELECT host, count(DISTINCT text) AS n_host FROM d GROUP BY host),
    bad AS (SELECT host, norm FROM n JOIN hosts USING (host) GROUP BY host, norm, n_host HAVING count(DISTINCT text) > {quality.MIN_DOCS} AND count(DISTINCT text) > {quality.MAX_SHARE}::DOUBLE * n_host),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad.norm IS NOT NULL) AS gone_lines, coalesce(sum(len(own)) FILTER (bad.norm IS NOT NULL), 0)::BIGINT AS gone
          FROM n LEFT JOIN bad USING (host, norm) GROUP BY doc_id),
    w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
    five AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS k, lead(word, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM five WHERE last IS NOT NULL) WHERE c > 1),
    inside AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(5) t(j) GROUP BY doc_id),
    s AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
          (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
          coalesce(gone_lines, 0) AS gone_lines, coalesce(gone, 0) AS gone FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
    b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND n_words - gone >= {quality.MIN_WORDS} AND n_words - gone >= {quality.MIN_REMAINING}::DOUBLE * n_words AS kept, gone_lines AS n_removed_lines, gone AS n_removed_words FROM b
    """,
}
