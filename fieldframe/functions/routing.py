"""Message kinds, expiry and routing decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context

# Default priority and time to live in ms, by kind.
DEFAULTS = {"Alert": (255, 1000), "Command": (150, 2000), "Query": (120, 5000), "State": (100, 10000), "Event": (100, 5000)}
LLM, LOCAL, DROP = "SendToLLM", "ProcessLocally", "Drop"


def parse_kind(s: Column) -> Column:
    """The kind's name in any case; null for no kind."""
    name = F.initcap(F.lower(s))
    return F.when(name.isin(*DEFAULTS), name)


def _default(kind: Column, k: int) -> Column:
    out = F.lit(None).cast("int")
    for name, values in DEFAULTS.items():
        out = F.when(kind == name, F.lit(values[k])).otherwise(out)
    return out


def default_priority(kind: Column) -> Column:
    return _default(kind, 0)


def default_ttl_ms(kind: Column) -> Column:
    return _default(kind, 1)


def age_ms(timestamp_ms: Column, now_ms: Column) -> Column:
    return F.when(timestamp_ms.isNotNull(), F.greatest(now_ms - timestamp_ms, F.lit(0)))


def is_expired(timestamp_ms: Column, ttl_ms: Column, now_ms: Column) -> Column:
    """Null where there is no timestamp: that is an error, not a yes or no."""
    return age_ms(timestamp_ms, now_ms) > ttl_ms


def expiry_error(timestamp_ms: Column) -> Column:
    """Whether a message is too old can't be told without its time."""
    return F.when(timestamp_ms.isNull(), "MissingTimestamp")


def quality_of_service(kind: Column, priority: Column, ttl_ms: Column) -> Column:
    """struct<priority, ttl_ms>: what is given, else the kind's own."""
    return F.struct(F.coalesce(priority, default_priority(kind)).alias("priority"), F.coalesce(ttl_ms, default_ttl_ms(kind)).alias("ttl_ms"))


def is_expired_at(expires_at: Column, now_ms: Column) -> Column:
    """By an absolute time; equal instants have expired."""
    return F.coalesce(expires_at <= now_ms, F.lit(False))


def base_importance(priority: Column, timestamp_ms: Column, source: Column, now_ms: Column, scorer: context.Scorer | None = None) -> Column:
    s = scorer or context.Scorer()
    score = context.composite(context.freshness(timestamp_ms, now_ms, s.decay_hours), F.lit(s.importance), context.confidence(source, s), context.risk(source, s), s.weights)
    return 0.5 * (priority.cast("double") / 255.0) + 0.5 * score


def route(kind: Column, priority: Column, expired: Column, importance: Column, threshold: float = 0.7, alerts: bool = True, drop_expired: bool = True) -> Column:
    """Null where expiry is asked for and can't be told (expiry_error)."""
    decision = F.when(expired.isNull(), F.lit(None)).when(expired, DROP) if drop_expired else F.when(F.lit(False), DROP)
    if alerts:
        decision = decision.when((kind == "Alert") & (priority > 200), LLM)
    return decision.when(kind.isin("Event", "State") & (importance >= threshold), LLM).otherwise(LOCAL)


# ---------------------------------------------------------------- rules about content


@dataclass(frozen=True)
class Rule:
    """A field's condition and the decision where it holds. op: equals, contains, in, between (both ends in), above,
    below, exists, missing. A value of another type never holds."""

    field: str
    op: str
    value: object = None
    decision: str = LLM

    def holds(self, col: Column) -> Column:
        v = self.value
        test = {
            "equals": lambda: col == F.lit(v),
            "contains": lambda: col.contains(v),
            "in": lambda: col.isin(*v),
            "between": lambda: col.between(*v),
            "above": lambda: col > F.lit(v),
            "below": lambda: col < F.lit(v),
            "exists": col.isNotNull,
            "missing": col.isNull,
        }[self.op]()
        return F.coalesce(test, F.lit(False))


def critical_to_llm(field: str) -> Rule:
    """Messages whose field says `critical`."""
    return Rule(field, "equals", "critical", LLM)


def drop_spam(field: str) -> Rule:
    """Messages whose field contains `spam`."""
    return Rule(field, "contains", "spam", DROP)


def route_by_content(df: DataFrame, rules: list[Rule], kind: Column, priority: Column, expired: Column, threshold: float = 0.7) -> Column:
    """Expired first (null where that can't be told), then the first rule that holds, then alerts, then priority / 255
    against the threshold."""
    decision = F.when(expired.isNull(), F.lit(None)).when(expired, DROP)
    for r in rules:
        decision = decision.when(r.holds(df[r.field]), r.decision)
    decision = decision.when((kind == "Alert") & (priority > 200), LLM)
    return decision.otherwise(F.when(priority.cast("double") / 255.0 >= threshold, LLM).otherwise(LOCAL))


def band(priority: Column) -> Column:
    """low 0-50, normal 51-200, high 201-255."""
    return F.when(priority <= 50, "low").when(priority <= 200, "normal").otherwise("high")


def metrics(df: DataFrame, *keys: Column) -> DataFrame:
    """Messages, drop rate, LLM rate and p99 of the age, by keys; df has kind, decision and age_ms."""
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("n"), (F.count_if(F.col("decision") == DROP) / n).alias("drop_rate"), (F.count_if(F.col("decision") == LLM) / n).alias("llm_rate"), F.percentile_approx("age_ms", 0.99, 10000).alias("age_p99"))
