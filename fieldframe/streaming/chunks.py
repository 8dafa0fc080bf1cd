"""Payloads in chunks: cutting, checking, putting together, flow control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checksum

CHUNK = 4096
WINDOW = 65536


def split(df: DataFrame, payload: str, *keys: str, chunk: int = CHUNK) -> DataFrame:
    """keys, seq, kind (Begin, Chunk, End), payload and checksum: a stream's frames. An empty payload is Begin and End."""
    n = F.ceil(F.octet_length(payload) / chunk).cast("int")
    cut = lambda k: F.substring(F.col(payload), (k - 1) * chunk + 1, F.lit(chunk))
    none = F.lit(None).cast("binary")
    body = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("seq"), F.lit("Chunk").alias("kind"), cut(k).alias("payload"))))
    ends = lambda seq, kind: F.array(F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), none.alias("payload")))
    frames = F.concat(ends(F.lit(0), "Begin"), F.coalesce(body, F.array().cast("array<struct<seq:int,kind:string,payload:binary>>")), ends(n + 1, "End"))
    out = df.select(*keys, F.explode(frames).alias("_f")).select(*keys, "_f.*")
    return out.withColumn("checksum", F.when(F.col("kind") == "Chunk", checksum.xor_words(F.col("payload"))).otherwise(F.lit(0).cast("long")))


def reassemble(frames: DataFrame, *keys: str) -> DataFrame:
    """keys, payload, total_bytes and error of each stream: frames in order of seq. A stream's chunks meet in one row, so
    their size is bounded by the payload's."""
    bad = (F.col("kind") == "Chunk") & (checksum.xor_words(F.col("payload")) != F.col("checksum"))
    found = frames.withColumn("_bad", bad).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "payload"))).alias("_f"), F.max("_bad").alias("_bad"), F.count_if(F.col("kind") == "Begin").alias("_begins"), F.count_if(F.col("kind") == "End").alias("_ends"), F.max_by("kind", "seq").alias("_last"), F.min_by("kind", "seq").alias("_first"), F.max("seq").alias("_max"), F.count_distinct("seq").alias("_n")
    )
    error = F.when((F.col("_begins") == 0) | (F.col("_first") != "Begin"), "StreamNotStarted").when(F.col("_begins") > 1, "UnexpectedFrame").when(F.col("_bad"), "ChecksumMismatch").when((F.col("_ends") == 0) | (F.col("_last") != "End"), "StreamNotComplete").when(F.col("_n") != F.col("_max") + 1, "MissingChunk")
    # bytes are joined as they are: a cast to string neither checks nor changes them
    whole = F.array_join(F.transform(F.filter("_f", lambda x: x["kind"] == "Chunk"), lambda x: x["payload"].cast("string")), "").cast("binary")
    out = found.withColumn("error", error).withColumn("payload", F.when(F.col("error").isNull(), F.coalesce(whole, F.lit(b""))))
    return out.select(*keys, "payload", F.octet_length("payload").cast("long").alias("total_bytes"), "error")


def in_flight(frames: DataFrame, size: str, order: str, *keys: str, acked: str | None = None, window: int = WINDOW) -> DataFrame:
    """Adds in_flight (bytes sent and not acknowledged before a frame) and can_send: a running sum in each stream."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sent = F.col(size) - (F.col(acked) if acked else F.lit(0))
    total = F.greatest(F.coalesce(F.sum(sent).over(w), F.lit(0)), F.lit(0))
    return frames.withColumn("in_flight", total).withColumn("can_send", F.col("in_flight") < window)


def available(in_flight_bytes: Column, window: int = WINDOW) -> Column:
    return F.greatest(F.lit(window) - in_flight_bytes, F.lit(0))
