from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import both, connection

from fieldframe.llm import exact_dedup, mixing, queries


def brute_exact(rows):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    return sorted((d, min(groups[norm(t)]), len(groups[norm(t)]), d == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)


def test_exact(odd, odd_rows):
    assert sorted(map(tuple, exact_dedup.exact_duplicates(odd).collect())) == brute_exact(odd_rows)


def test_exact_levels(spark):
    """Groups that part at every level, and texts that end where another goes on."""
    rows = []
    for end in (0, 1, 63, 64, 65, 511, 512, 513, 4096, 5000, 40000):
        for tail in ("", "", "y", "z"):
            rows.append((len(rows), "x" * end + tail))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df).collect())) == brute_exact(rows)


def test_exact_empty(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0


@given(st.lists(st.binary(max_size=40), max_size=30))
def test_radix_groups(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t].append(i)
    assert sorted(map(sorted, exact_dedup.radix_groups(texts))) == sorted(groups.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    got, want = both(spark, connection(sf), queries.queries()[name], queries.oracle_sql()[name], sf)
    assert got == want


def test_mixture_hits_its_targets(spark):
    df = spark.range(30000).selectExpr("id AS doc_id", "repeat('w', 99) AS text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) AS source")
    out = mixing.mix_sources(df, {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert set(n) == {"a", "b"}
    assert n["a"] + n["b"] == pytest.approx(20000, rel=0.05)
    assert n["a"] / n["b"] == pytest.approx(3, rel=0.08)


def test_mixture_cases(odd, empty):
    out = mixing.mix_sources(odd, budget=3.0)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert out.where("source is null").count() > 0
    assert mixing.mix_sources(empty).count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix_sources(odd.repartition(3), budget=3.0).collect()))


def test_poisson_is_poisson(spark):
    """Mean and variance of a large rate, by inversion."""
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text", "'s' AS source")
    counts = mixing.mix_sources(df, budget=60.0).groupBy("doc_id").count()
    mean, var = counts.selectExpr("avg(count)", "variance(count)").first()
    assert mean == pytest.approx(60, rel=0.03)
    assert var == pytest.approx(60, rel=0.15)


def test_distributions_of_large_rates(spark):
    """Arrays grow with the root of the rate; what they leave out has no weight."""
    import math

    from pyspark.sql import functions as F

    rates = [0.3, 5.0, 180.0, 260.0, 20000.0, 1e6]
    df = spark.createDataFrame([(r,) for r in rates], "rate double").withColumn("least", mixing.poisson_least(F.col("rate")))
    for r in df.withColumn("cdf", mixing.poisson_cdf(F.col("rate"), F.col("least"))).collect():
        assert len(r.cdf) <= 24 * math.sqrt(r.rate) + 63  # both ends rounded outwards, both included
        assert r.cdf[-1] == pytest.approx(1, abs=1e-6)
        assert (r.least == 0) == (r.rate <= 12 * math.sqrt(r.rate) + 30)
        median = r.least + sum(c < 0.5 for c in r.cdf)
        assert abs(median - r.rate) < 1
