"""Every query with SQL gives what DuckDB gives; those without give rows."""

from __future__ import annotations

import pytest
from oracle import both, connection

from fieldframe.plans import queries


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, sf, name):
    got, want = both(spark, con, queries.QUERIES[name], queries.SQL[name], sf)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_quantization_errors_are_within_a_step(spark, sf):
    row = queries.QUERIES["quant_roundtrip"](spark, sf).agg({"int8_ok": "min", "int4_ok": "min"}).first()
    assert all(row)


def test_every_order_is_received(spark, sf):
    got = queries.QUERIES["spa_receiver"](spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert got.count() == lines.count()
    assert got.select("l_orderkey").distinct().count() == lines.select("l_orderkey").distinct().count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
