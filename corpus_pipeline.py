"""The corpus pipeline: documents in, packed sequences out. Each stage is one operator over all that is left.

Cases, in every stage: null and empty texts stay documents (the classifier scores them, they have no lines, no shingles
and one token); a null doc_id stays, and the quality and near-duplicate stages, which drop by doc_id, never drop it; rows
that repeat a doc_id are dropped or kept together by those two; an empty table gives an empty one; texts of any length are
read whole; further columns stay as they are, whatever their names, up to the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm import line_dedup, minhash_dedup, mixing, packing, quality_gam


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    scores = quality_gam.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = scores.where("predicted = 0").select("doc_id")
    return docs.join(bad.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an equal or similar line precedes in the corpus. A document that loses all its
    lines goes."""
    out = line_dedup.dedup_lines(docs).where("_n_dropped < _n_lines or _n_dropped = 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words a shingle, similarity 0.8 or more."""
    found = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(found.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources wants them, shuffled."""
    return mixing.mix_sources(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: No stage but the mixture could be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder that the next one reads."""
    from fieldframe.llm.common import Scratch

    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
