"""Numbers and neighbours in the order of a key's rows, without one task for each key.

A cell is a column that ascends with the order, such as a day or a score's hundredth. Rows are sorted in cells of a key;
what one cell hands to the next is taken from a table of one row for each key and cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _joined(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, "_cell"]
    right = cells.select(*[F.col(k).alias(f"_r{k}") for k in names], *[c for c in cells.columns if c not in names])
    on = [rows[k].eqNullSafe(F.col(f"_r{k}")) for k in names]
    return rows.join(right, on, "left").drop(*[f"_r{k}" for k in names])


def numbered(df: DataFrame, keys: list[str], cell: Column, *order: Column | str, out: str = "rank") -> DataFrame:
    """Adds the row's number, from 1, among its keys' rows."""
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(*order)))
    return _joined(rows, counts, keys).withColumn(out, F.col("_before") + F.col("_k")).drop("_cell", "_k", "_before")


def previous(df: DataFrame, keys: list[str], cell: Column, value: str, *order: str, out: str) -> DataFrame:
    """Adds the value of the row before among the keys' rows; null for the first one."""
    rows = df.withColumn("_cell", cell)
    last = rows.groupBy(*keys, "_cell").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(W.partitionBy(*keys).orderBy("_cell")))
    w = W.partitionBy(*keys, "_cell").orderBy(*order)
    rows = rows.withColumns({"_k": F.row_number().over(w), "_own": F.lag(value).over(w)})
    found = F.when(F.col("_k") == 1, F.col("_last")[value]).otherwise(F.col("_own"))
    return _joined(rows, last, keys).withColumn(out, found).drop("_cell", "_k", "_own", "_last")
