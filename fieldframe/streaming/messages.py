"""Message streams: event time, duplicates, expiry, routing, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import routing


def with_event_time(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay)


def deduplicated(df: DataFrame) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(["source", "sequence"])


def decided(df: DataFrame, now_ms: int, threshold: float = 0.7) -> DataFrame:
    """Adds age_ms, expired and decision; df has timestamp_ms, kind, priority, ttl_ms, source."""
    now = F.lit(now_ms)
    ts = F.col("timestamp_ms")
    out = df.withColumns({"age_ms": routing.age_ms(ts, now), "expired": routing.is_expired(ts, F.col("ttl_ms"), now)})
    importance = routing.base_importance(F.col("priority"), ts, F.col("source"), now)
    return out.withColumn("decision", routing.route(F.col("kind"), F.col("priority"), F.col("expired"), importance, threshold))


def metrics(df: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by window and kind; df has event_time, kind, decision."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return df.groupBy(w, "kind").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == routing.DROP).alias("dropped"), F.count_if(F.col("decision") == routing.LLM).alias("to_llm"))


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(F.session_window("event_time", gap), "source").agg(F.count("*").alias("n"))


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]]) -> DataStreamWriter:
    """Each batch's rows to the sink of their decision, expired ones too: nothing goes without a trace. The batch number
    lets a sink drop a batch that it has had."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for decision, sink in sinks.items():
            sink(batch.where(F.col("decision") == decision), number)
        batch.unpersist()

    return df.writeStream.foreachBatch(each)
