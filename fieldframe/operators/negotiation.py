"""What two peers agree on: features, conflicting names, types, known fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The value types that a peer of each version reads (tags of the binary format).
SUPPORTED = {4: ("i", "f", "b", "s", "sa"), 5: ("i", "f", "b", "s", "sa", "r", "ra")}


def supports_type(version: Column, tag: Column) -> Column:
    """Whether a peer of that version reads values of that type; unknown versions read none."""
    out = F.lit(False)
    for v, tags in SUPPORTED.items():
        out = F.when(version == v, tag.isin(*tags)).otherwise(out)
    return out


def intersect_features(local: Column, remote: Column, names: list[str]) -> Column:
    """struct of flags: supports_* where both have it, requires_* where either does."""
    both = lambda n: (local[n] & remote[n]) if n.startswith("supports_") else (local[n] | remote[n])
    return F.struct(*[both(n).alias(n) for n in names])


def name_conflicts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(fid, local_name, remote_name) where one id has two names."""
    a = local.select("fid", F.col("name").alias("local_name"))
    b = remote.select("fid", F.col("name").alias("remote_name"))
    return a.join(b, "fid").where("local_name <> remote_name")


def type_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(fid, expected, found), by fid."""
    a = expected.select("fid", F.col("expected"))
    b = actual.select("fid", F.col("expected").alias("found"))
    return a.join(b, "fid").where("expected <> found").orderBy("fid")


def agreed(known: DataFrame, response: DataFrame) -> DataFrame:
    """Known ids and those that the response has as ACTIVE, without its tombstoned ones; deprecated ones stay."""
    active = response.where("status = 'ACTIVE'").select("fid")
    gone = response.where("status = 'TOMBSTONED'").select("fid")
    return known.select("fid").union(active).distinct().join(gone, "fid", "left_anti")


def supported(fields: DataFrame, agreed_fids: DataFrame) -> DataFrame:
    return fields.join(F.broadcast(agreed_fids), "fid", "left_semi")
