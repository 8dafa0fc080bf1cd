"""Column functions: everything here is a Catalyst expression. `register` makes SQL functions of the common ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession


#: SQL functions: name, arguments, body. They are macros, so they stay in Catalyst.
SQL = {
    "ff_crc": ("t STRING", "crc32(encode(t, 'UTF-8'))"),
    "ff_checksum": ("fid INT, hint STRING, v STRING", "lpad(hex(crc32(encode(concat_ws(':', CAST(fid AS STRING), hint, v), 'UTF-8'))), 8, '0')"),
    "ff_freshness": ("ts BIGINT, now_ms BIGINT, decay DOUBLE", "coalesce(exp(-(CAST(greatest(now_ms - ts, 0) AS DOUBLE) / 3600000e0) / decay), 0.5e0)"),
    "ff_penalty": ("risk INT", "CASE risk WHEN 0 THEN 1e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.5e0 ELSE 0.1e0 END"),
    "ff_score": ("fresh DOUBLE, importance INT, conf DOUBLE, risk INT", "least(1e0, greatest(0e0, (0.3e0 * fresh + 0.4e0 * (importance / 255e0) + 0.3e0 * conf) * CASE risk WHEN 0 THEN 1e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.5e0 ELSE 0.1e0 END))"),
    "ff_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0e0, (s, x) -> s + x)"),
    "ff_traceparent": ("trace STRING", "concat('00-', rpad(substring(lower(regexp_replace(trace, '[^0-9A-Fa-f]', '')), 1, 32), 32, '0'), '-0123456789abcdef-01')"),
    "ff_expired": ("ts BIGINT, ttl BIGINT, now_ms BIGINT", "greatest(now_ms - ts, 0) > ttl"),
    "ff_fid_range": ("fid INT", "CASE WHEN fid <= 255 THEN 'Core' WHEN fid <= 16383 THEN 'Standard' WHEN fid <= 32767 THEN 'Extended' ELSE 'Private' END"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions of SQL known to the session, and the Python ones over Arrow batches."""
    from pyspark.sql import functions as F

    from ..sources import text, values

    for name, (args, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")

    def over(one):  # noqa: ANN001, ANN202
        @F.arrow_udf("string")
        def run(x: pa.Array) -> pa.Array:
            return pa.array([None if v is None else one(v) for v in x.to_pylist()], pa.string())

        return run

    def canonical(v: str) -> str | None:
        try:
            return values.record_text(text.read(v))
        except values.RecordError:
            return None

    spark.udf.register("ff_sanitize", over(text.sanitize))
    spark.udf.register("ff_canonical", over(canonical))
    spark.udf.register("ff_expand_short", over(text.expand_short))
