"""Differences of records: field tables joined on record and field. A nested field's path is part of the key, so nested
records need no recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of the operations.
OPS = {"Set": 1, "Delete": 2, "Update": 3, "Merge": 4}


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, op, value) of what turns old into new: Set where only new has the key, Delete where only old has it,
    Update where values differ. One full outer join on the keys."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full")
    op = F.when(F.col("_in_old").isNull(), "Set").when(F.col("_in_new").isNull(), "Delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "Update")
    return both.withColumn("op", op).where("op is not null").select(*keys, "op", F.col("_new").alias(value))


def apply(base: DataFrame, ops: DataFrame, keys: list[str], value: str, strict: bool = False) -> DataFrame:
    """base with the operations applied. An Update without the field is an error: a row with `error`, or with strict a
    failed query."""
    a = base.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    b = ops.select(*keys, "op", F.col(value).alias("_new"))
    both = a.join(b, keys, "full").where("op is null or op <> 'Delete'")
    missing = F.col("op").isin("Update", "Merge") & F.col("_in_old").isNull()
    error = F.when(missing, F.raise_error(F.lit("InvalidTargetFid")).cast("string") if strict else F.lit("InvalidTargetFid"))
    return both.select(*keys, F.when(F.col("op").isNull(), F.col("_old")).otherwise(F.col("_new")).alias(value), error.alias("error"))


def top_level(ops: DataFrame, *keys: str, path: str = "path") -> DataFrame:
    """Operations on a nested field table (keys, path, fid, op) as those on the records' own fields: one (keys, fid, op,
    n). Changes inside a record that both sides have are one Merge of it; n is how many."""
    inside = F.size(path) > 0
    top = F.when(inside, F.get(path, F.lit(0))).otherwise(F.col("fid"))
    found = ops.select(*keys, top.alias("fid"), F.when(~inside, F.col("op")).alias("_own"))
    return found.groupBy(*keys, "fid").agg(F.coalesce(F.max("_own"), F.lit("Merge")).alias("op"), F.count("*").alias("n"))


def merge_error(base: DataFrame, ops: DataFrame, *keys: str) -> DataFrame:
    """keys, fid and error of top_level operations that can't be applied to a base's own fields (keys, fid, tag): Merge
    and Update without the field are InvalidTargetFid, Merge of what is no record MergeConflict."""
    tags = base.select(*keys, "fid", F.col("tag").alias("_tag"))
    both = ops.where("op in ('Merge', 'Update')").join(tags, [*keys, "fid"], "left")
    error = F.when(F.col("_tag").isNull(), "InvalidTargetFid").when((F.col("op") == "Merge") & (F.col("_tag") != "r"), "MergeConflict")
    return both.withColumn("error", error).where("error is not null").select(*keys, "fid", "error")


def op_counts(ops: DataFrame, *keys: str) -> DataFrame:
    return ops.groupBy(*keys, "op").agg(F.count("*").alias("n"))


def context_error(algorithm: Column, compression: Column, base: Column, required: Column) -> Column:
    """Null where a delta may be applied to that snapshot."""
    return F.when(~algorithm.isin(0, 1), "UnknownAlgorithm").when(~compression.isin(0, 1), "UnknownCompression").when(F.coalesce(base, F.lit(0)) == 0, "NoBaseSnapshot").when(base != required, "WrongBaseSnapshot")


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key: a grouped maximum, for streams of changes with many to a key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_c")).select(*keys, "_c.*")
