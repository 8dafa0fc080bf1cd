"""Context scoring: freshness, confidence, risk and importance of an envelope or record, and what is made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

# Weights, penalties and defaults.
RISKS = ("Low", "Medium", "High", "Critical")
PENALTY = (1.0, 0.8, 0.5, 0.1)


@dataclass(frozen=True)
class Weights:
    freshness: float = 0.3
    importance: float = 0.4
    confidence: float = 0.3

    def normalized(self) -> Weights:
        total = self.freshness + self.importance + self.confidence
        return Weights(self.freshness / total, self.importance / total, self.confidence / total) if total > 0 else self


@dataclass(frozen=True)
class Scorer:
    decay_hours: float = 24.0
    importance: int = 128
    risk: int = 0
    confidence: float = 0.5
    trusted: tuple[str, ...] = ()
    suspicious: tuple[str, ...] = ()
    weights: Weights = field(default_factory=Weights)


def freshness(timestamp_ms: Column, now_ms: Column, decay_hours: float = 24.0) -> Column:
    """exp(-age in hours / decay); an age below 0 is 0, no timestamp is 0.5."""
    age = F.greatest(now_ms - timestamp_ms, F.lit(0)).cast("double")
    return F.when(timestamp_ms.isNull(), F.lit(0.5)).otherwise(F.exp(-(age / 3600000.0) / F.lit(float(decay_hours))))


def _any_in(source: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.greatest(*[source.contains(w) for w in words], F.lit(False)), F.lit(False)) if words else F.lit(False)


def confidence(source: Column, scorer: Scorer) -> Column:
    more = min(scorer.confidence + 0.2, 1.0)
    return F.when(_any_in(source, scorer.trusted), F.lit(more)).otherwise(F.lit(scorer.confidence))


def risk(source: Column, scorer: Scorer) -> Column:
    return F.when(_any_in(source, scorer.suspicious), F.lit(2)).otherwise(F.lit(scorer.risk))


def penalty(level: Column) -> Column:
    out = F.lit(PENALTY[0])
    for k in (1, 2, 3):
        out = F.when(level == k, F.lit(PENALTY[k])).otherwise(out)
    return out


def composite(fresh: Column, importance: Column, conf: Column, level: Column, weights: Weights | None = None) -> Column:
    w = weights or Weights()
    raw = F.lit(w.freshness) * fresh + F.lit(w.importance) * (importance.cast("double") / 255.0) + F.lit(w.confidence) * conf
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * penalty(level)))


def with_profile(df: DataFrame, now_ms: int, scorer: Scorer | None = None, timestamp: str = "timestamp_ms", source: str = "source", importance: str | None = None) -> DataFrame:
    """Adds freshness, importance, risk, confidence and score. importance: a column that overrides the default."""
    s = scorer or Scorer()
    own = F.coalesce(F.col(importance), F.lit(s.importance)) if importance else F.lit(s.importance)
    df = df.withColumns({"freshness": freshness(F.col(timestamp), F.lit(now_ms), s.decay_hours), "importance": own.cast("int"), "risk": risk(F.col(source), s), "confidence": confidence(F.col(source), s)})
    return df.withColumn("score", composite(F.col("freshness"), F.col("importance"), F.col("confidence"), F.col("risk"), s.weights))


def score_record(fields: DataFrame, importance: DataFrame, *keys: str, scorer: Scorer | None = None) -> DataFrame:
    """keys, freshness, importance, risk, confidence, score and hints of records without an envelope, from their field
    table: the largest importance of their fields, neutral freshness and confidence, and the hint field_count.
    importance: (fid, importance), at most 65,536 ids."""
    s = scorer or Scorer()
    found = fields.join(F.broadcast(importance), "fid", "left").groupBy(*keys).agg(F.coalesce(F.max("importance"), F.lit(s.importance)).cast("int").alias("importance"), F.count("*").alias("_n"))
    half = F.lit(0.5)
    found = found.withColumns({"freshness": half, "risk": F.lit(0), "confidence": half, "hints": F.create_map(F.lit("field_count"), F.col("_n").cast("string"))})
    return found.withColumn("score", composite(half, F.col("importance"), half, F.col("risk"), s.weights)).drop("_n")


def score_combined(envelopes: DataFrame, records: DataFrame, now_ms: int, *keys: str, scorer: Scorer | None = None) -> DataFrame:
    """Envelopes (keys, timestamp_ms, source, and hints if there are any) with their records' profiles (score_record):
    the record's importance takes the default's place, and its hints are merged over the envelope's."""
    s = scorer or Scorer()
    own = envelopes if "hints" in envelopes.columns else envelopes.withColumn("hints", F.create_map().cast("map<string,string>"))
    theirs = records.select(*keys, F.col("importance").alias("_importance"), F.col("hints").alias("_hints"))
    out = with_profile(own.join(theirs, list(keys), "left"), now_ms, s, importance="_importance")
    over = F.coalesce(F.col("_hints"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.col("hints"), lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return out.withColumn("hints", F.map_concat(kept, over)).drop("_importance", "_hints")


def rank_within(df: DataFrame, key: str, *order: str, cells: int = 1000) -> DataFrame:
    """Adds rank: the place by score among a key's rows, best first; `order` settles ties. Scores are cut into cells, so
    a key's rows are sorted by many tasks."""
    return ordered.numbered(df, [key], -F.floor(F.col("score") * cells), F.desc("score"), *order)


def by_threshold(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("score") >= least)


def by_freshness(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("freshness") >= least)


def by_importance(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("importance") >= least)


def by_risk(df: DataFrame, most: int) -> DataFrame:
    return df.where(F.col("risk") <= most)


def reweighted(df: DataFrame, weights: Weights) -> DataFrame:
    return df.withColumn("score", composite(F.col("freshness"), F.col("importance"), F.col("confidence"), F.col("risk"), weights))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Best first; `order` settles ties. A global sort by range, not one task."""
    return df.orderBy(F.col("score").desc(), *order)


def top_k(df: DataFrame, k: int, *order: str) -> DataFrame:
    return ranked(df, *order).limit(k)


def stats(df: DataFrame) -> DataFrame:
    """One row: count, averages (importance by whole division) and how many of each risk; zeros for no rows."""
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return df.agg(
        F.count("*").alias("n"),
        zero(F.avg("freshness"), "double").alias("avg_freshness"),
        zero(F.floor(F.sum(F.col("importance").cast("long")) / F.count("*")), "long").alias("avg_importance"),
        zero(F.avg("confidence"), "double").alias("avg_confidence"),
        *[F.count_if(F.col("risk") == k).alias(f"{name.lower()}_risk") for k, name in enumerate(RISKS)],
    )
