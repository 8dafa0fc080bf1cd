"""Boxes that meet: against brute force and SQL, with cells on all three axes."""

from __future__ import annotations

import duckdb
import numpy as np
from oracle import norm
from pyspark.sql import functions as F

from fieldframe.functions import spatial
from fieldframe.plans import queries


def test_boxes_meet_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    low = np.round(rng.uniform(-30, 30, (120, 3)), 0)
    high = low + np.round(rng.uniform(0, 25, (120, 3)), 0)  # touching ones too, several cells long
    rows = [(i, tuple(map(float, a)), tuple(map(float, b))) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    point = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([(i, (a, b)) for i, a, b in rows], f"id int, box struct<min:{point},max:{point}>")
    found = spatial.boxes_joined(df, "box", (8.0, 8.0, 8.0), F.col("a.id") < F.col("b.id")).select("a.id", "b.id").collect()
    want = [(i, j) for i in range(120) for j in range(i + 1, 120) if (low[i] <= high[j]).all() and (high[i] >= low[j]).all()]
    assert len(want) > 50
    assert sorted(map(tuple, found)) == want


def test_lines_of_one_price_are_told_apart_by_the_other_axes(spark, tmp_path):
    n = 3000
    lines = spark.range(n).select(F.floor(F.col("id") / 2).alias("l_orderkey"), F.lit(1000.0).alias("l_extendedprice"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), (F.col("id") * 10).alias("l_suppkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    box = F.struct(*[F.struct(*[(F.col(c) + s * w).alias(a) for a, c, w in zip("xyz", ("l_extendedprice", "l_quantity", "l_suppkey"), (2, 1, 20), strict=True)]).alias(e) for e, s in (("min", -1), ("max", 1))])
    cells = spatial.in_cells(lines.select(box.alias("box")), "box", (16.0, 8.0, 160.0))
    assert cells.groupBy("_cell").count().agg(F.max("count")).first()[0] < 20  # of 3,000, which share their cell of x
    got = sorted(map(tuple, queries.QUERIES["spa_bbox_join"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(tuple(map(norm, r)) for r in con.execute(queries.SQL["spa_bbox_join"]).fetchall())
    assert got
