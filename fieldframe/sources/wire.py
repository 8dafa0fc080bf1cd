"""Records as bodies of HTTP messages and values of Kafka records, and checks of record text against a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import transport
from ..operators import registry as registry_operators
from . import binary, text, values
from .text import Options, read
from .values import RecordError


def from_body(df: DataFrame, body: str, content_type: str, *keys: str, out: str = "fields") -> DataFrame:
    """Fields of bodies: content types with `binary` or `octet-stream` are frames, with `text` record text, others an
    error."""
    both = df.withColumn("_body", F.struct(F.col(body).cast("binary").alias("data"), F.col(content_type).alias("type")))

    def one(row: dict) -> list[dict]:
        kind = row["type"] or ""
        if "binary" in kind or "octet-stream" in kind:
            return values.field_rows(binary.read_frame(row["data"]))
        if "text" in kind:
            return values.field_rows(read(row["data"].decode(), Options()))
        raise RecordError("UnsupportedContentType", kind)

    return binary._over(both, list(keys), "_body", out, one, values.FIELD_SCHEMA)


def to_kafka(df: DataFrame, rec: str, env: str, key: Column, *keys: str) -> DataFrame:
    """key, value and headers as the Kafka sink takes them."""
    frames = binary.encode_column(df.select(*keys, rec, env, key.alias("_key")), rec, *keys, env, "_key", out="value")
    return frames.select(*keys, F.col("_key").cast("binary").alias("key"), "value", transport.kafka_headers(transport.to_headers(F.col(env), transport.KAFKA)).alias("headers"))


def from_kafka(df: DataFrame, *keys: str) -> DataFrame:
    """Fields and envelope of rows of a Kafka source read with includeHeaders."""
    env = transport.from_headers(transport.from_kafka_headers(F.col("headers")), transport.KAFKA)
    rows = df.select(*keys, "value", env.alias("envelope"))
    return binary.decode_column(rows, "value", *keys, "envelope")


def check_text(df: DataFrame, column: str, dimension: DataFrame, *keys: str) -> DataFrame:
    """keys, fid and result of every field of record text that a registry does not hold valid; lines that can't be read
    are one row with their error."""
    parsed = text.parse(df, column, *keys, options=Options(normalize=False))
    bad = parsed.where("error is not null").select(*keys, F.lit(None).cast("int").alias("fid"), F.col("error.class").alias("result"))
    fields = parsed.where("error is null").select(*keys, F.explode("fields").alias("x")).select(*keys, "x.fid", "x.tag")
    return registry_operators.invalid(fields, dimension).select(*keys, "fid", "result").unionByName(bad)
