"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import (
    conversation_repair,
    decontamination,
    html_template,
    language_id,
    lm_scoring,
    packing,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    topk_search,
    toxicity,
    url_filter,
)
from tidepool.llm.common import read_columns

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(
        read_columns(spark, sf_dir, "documents", ["doc_id", "text"]),
        read_columns(spark, sf_dir, "labels", ["doc_id", "toxic"]),
    )


def op4_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(read_columns(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(
        read_columns(spark, sf_dir, "pages", ["page_id", "url", "html"]),
        read_columns(spark, sf_dir, "documents", ["text", "lang"]),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        read_columns(spark, sf_dir, "documents", ["doc_id", "text"]),
        read_columns(spark, sf_dir, "benchmark", ["item_id", "text"]),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_columns(spark, sf_dir, "documents", ["doc_id", "text"]))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(
        read_columns(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), lambda vec_id: vec_id % 20 == 0
    )


#: The rules that op11_url_filter applies: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read_columns(spark, sf_dir, "pages", ["page_id", "url"]), rules)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_columns(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conversation_repair.summaries(conversation_repair.damage(rows))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(
        read_columns(spark, sf_dir, "documents", ["doc_id", "text"]),
        tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"),
    )


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_lm_scoring, op3_toxicity, op4_html_template, op5_language_id, op6_packing, op7_decontamination, op8_simhash, op9_suffix_dedup, op10_topk_search, op11_url_filter, op12_conversation_repair, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.substring_dedup_sql(), "op7_decontamination": decontamination.contamination_sql(), "op10_topk_search": OP10_SQL, "op11_url_filter": url_filter.judge_sql(URL_RULES)}
