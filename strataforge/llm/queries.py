"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard, pieces, quality, sharding, surrogates, token_counts, token_files, topk, toxicity
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintained(table(spark, sf_dir, "documents"))


#: chr(9) to chr(13) and space part words; the history is that of token_counts.maintained.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, text FROM documents WHERE doc_id IS NULL OR doc_id % 10 NOT IN (0, 1)
  UNION ALL
  SELECT doc_id, 'revised', lang, text || ' ' || text FROM documents WHERE doc_id % 10 = 1),
c AS (
  SELECT source, lang, 'words-1' AS version, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM d
  UNION ALL
  SELECT source, lang, 'bytes-1', coalesce(strlen(text), 0) FROM d)
SELECT source, lang, version, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM c GROUP BY ALL
"""


def token_counts_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's rollup by a real tokenizer: part of the table moves from words to its version."""
    import public_tokenizers

    bpe = token_counts.of_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.migrated(table(spark, sf_dir, "documents"), {"words-1": token_counts.words}, {"bpe-49k": bpe})


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_offending"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


#: DuckDB lists count from 1; scores of equal rows are ordered by vec_id.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_toxicity": op3_toxicity,
        "op4_decontamination": op4_decontamination,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_token_files": op6_token_files,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_sharding": op8_sharding,
        "op9_pii_surrogates": op9_pii_surrogates,
        "op10_sentencepiece": op10_sentencepiece,
        "token_counts_bpe": token_counts_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_token_counts": OP1_SQL, "op7_exact_top_k": OP7_SQL}
