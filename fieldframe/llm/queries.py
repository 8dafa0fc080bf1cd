"""The queries opN_<name> and pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw_scoring, exact_dedup, line_dedup, media, minhash_dedup, mixing, packing, quality_gam, secrets, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_mix_copy").alias("copy"), F.round("_mix_rate", 9).alias("rate"), F.col("_mix_key").alias("shuffle_key"), F.md5("text").alias("text_md5"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scoring.ctw_scores(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_copies(media.pictures(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_mixing": op2_mixing,
        "op3_line_dedup": op3_line_dedup,
        "op4_packing": op4_packing,
        "op5_ctw_scoring": op5_ctw_scoring,
        "op6_media": op6_media,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_quality": op9_quality,
        "op10_secrets": op10_secrets,
    }


OP2 = """
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
rates AS (SELECT source, (size ** 0.5e0) / (SELECT sum(size ** 0.5e0) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
steps AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1.0e0) END)) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM rates)),
drawn AS (SELECT doc_id, source, md5(text) AS text_md5, (('0x' || left(md5('mix:' || doc_id), 13))::BIGINT + 0.5e0) / 4503599627370496e0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, any_value(d.text_md5) AS text_md5, any_value(s.rate) AS rate, count(*) AS n
  FROM (SELECT row_number() OVER () AS r, * FROM drawn) d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.cdf <= d.u GROUP BY d.r, d.doc_id, d.source),
copies AS (SELECT doc_id, source, rate, text_md5, unnest(generate_series(0, n - 1))::INTEGER AS copy FROM counted)
SELECT doc_id, source, copy, round(rate, 9) AS rate, md5('mix/shuffle:' || doc_id || ':' || copy) AS shuffle_key, text_md5 FROM copies
"""

OP8 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op8_exact_dedup": OP8}
