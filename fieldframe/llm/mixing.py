"""Mixing sources to target weights by Poisson replication.

A source of size s (bytes of text, one more for each document) whose target share of a mixture of size T is w gets the
mean repetition rate w * T / s. Each document's count is that Poisson distribution inverted at a number in (0, 1) made
from an MD5 of seed and doc_id, so it depends on nothing but them; the document is exploded by its count, and a second
MD5 deals all copies to random partitions and orders each one: a global shuffle without a sampling pass.

A source's distribution is an array over 12 standard deviations and 30 on both sides of its mean, so it grows with the
root of the rate. The table of sources is grouped first (partial sums, so a hot source is no hot task), measured, and
joined back: up to `MOST_BROADCAST` bytes it is broadcast, so documents are moved once, by the shuffle; beyond that both
sides are merged by source, and adaptive execution splits hot ones. Everything is DataFrame code; the text rides along untouched.

Cases: a null source is a source of its own; null and empty texts have size 1; rows that repeat a doc_id get the same
count; sources that `targets` doesn't name get weight 0 and go; an empty table gives no rows; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Bytes of the sources' distributions that may be broadcast: 8 for each number, 100 for each source.
MOST_BROADCAST = 32 << 20

#: 16^13: 13 hexadecimal digits are exact in a double.
SPAN = float(16**13)


def unit(seed: str, *cols: Column) -> Column:
    """A number in (0, 1), the same for the same values everywhere."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / SPAN


def poisson_least(rate: Column) -> Column:
    """The first count of poisson_cdf: 12 standard deviations and 30 below the mean, 0 at least. What lies below has a
    probability under 1e-30."""
    return F.greatest(F.lit(0), F.floor(rate - 12 * F.sqrt(rate) - 30)).cast("int")


def poisson_cdf(rate: Column, least: Column) -> Column:
    """P(least <= X <= least), P(least <= X <= least + 1), ... up to 12 standard deviations and 30 beyond the mean. In
    logarithms, so that a rate of thousands does not underflow."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    factorial = F.aggregate(F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.ln(k.cast("double")))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, k: Column) -> Column:
        first = F.when(least > 0, -rate + least * F.ln(rate) - factorial).otherwise(-rate)
        log = F.when(k == least, first).otherwise(acc["log"] + F.ln(rate) - F.ln(k.cast("double")))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(least, most), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0) -> DataFrame:
    """(source, size, rate). targets: weight by source; without it a weight is size ** alpha (alpha 1 keeps the natural
    mixture, 0 makes sources equal). budget: size of the mixture in times of the input's."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, weight double")
        weighted = sizes.join(given, sizes["source"].eqNullSafe(given["source"])).select(sizes["source"], "size", "weight")
    total = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_size") * F.lit(float(budget)) / F.col("size")
    return weighted.join(F.broadcast(total)).select("source", "size", rate.alias("rate"))  # total: one row


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """Rows of docs, each as often as its Poisson count says, shuffled, with rate, copy (from 0) and shuffle_key."""
    rates = source_rates(pick(docs, "source", "text"), targets, alpha, budget).where("rate > 0")
    rates = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), poisson_least(F.col("rate")).alias("_least"))
    rates = rates.withColumn("_cdf", poisson_cdf(F.col("_rate"), F.col("_least")))
    rates = Scratch(docs.sparkSession, "mixing").table(rates, "rates")
    size = rates.agg(F.coalesce(F.sum(F.size("_cdf") * 8 + F.coalesce(F.octet_length("_source"), F.lit(0)) + 100), F.lit(0))).first()[0]
    rates = F.broadcast(rates) if size <= MOST_BROADCAST else rates.hint("merge")
    joined = docs.join(rates, docs["source"].eqNullSafe(rates["_source"]))
    u = unit(seed, docs["doc_id"])
    count = F.col("_least") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    held = joined.withColumn("_u", u).withColumn("_count", count).where("_count > 0")
    copies = held.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(seed + "/shuffle"), docs["doc_id"].cast("string"), F.col("_copy").cast("string")))
    out = copies.select(*[docs[c] for c in docs.columns], F.col("_rate").alias("_mix_rate"), F.col("_copy").alias("_mix_copy"), key.alias("_mix_key"))
    return out.repartition("_mix_key").sortWithinPartitions("_mix_key")
