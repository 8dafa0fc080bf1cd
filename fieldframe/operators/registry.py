"""The field registry as a table (fid, name, expected, range, status, since, description), what is checked against it,
peers' versions, and dictionaries of names, importance and equivalent values.

Registry tables are dimensions: their size is bounded by the 65,536 field ids, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "fid int, name string, expected string, range string, status string, since string, description string, unit string"
# Expected type by tag, ranges of field ids.
EXPECTED = {"i": "Int", "f": "Float", "b": "Bool", "s": "String", "sa": "StringArray", "ia": "IntArray", "fa": "FloatArray", "ba": "BoolArray", "r": "Record", "ra": "RecordArray", "v": "Embedding", "qv": "QuantizedEmbedding"}
RANGES = {"code": ((255, "Core"), (16383, "Standard"), (32767, "Extended")), "spec": ((1023, "Core"), (16383, "Standard"), (32767, "Extended"))}
STATUSES = ("PROPOSED", "ACTIVE", "DEPRECATED", "TOMBSTONED")


def fid_range(fid: Column, policy: str = "code") -> Column:
    out = F.lit("Private")
    for most, name in reversed(RANGES[policy]):
        out = F.when(fid <= most, name).otherwise(out)
    return out


def type_name(tag: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in EXPECTED.items():
        out = F.when(tag == k, v).otherwise(out)
    return out


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A registry file: sections core, standard, extended and tombstoned, each a list of entries of `key: value` lines.
    Read as text by Spark, so any file system will do; a registry has at most 65,536 entries."""
    section, entry, rows = "", {}, []
    for line in [r.value for r in spark.read.text(path).collect()]:
        body = line.split(" #")[0].rstrip()
        bare = body.strip()
        if not bare or bare.startswith("#"):
            continue
        if not body.startswith((" ", "-")):
            if entry:
                rows.append(entry)
            section, entry = bare.split(":")[0], {}
            continue
        if bare.startswith("- "):
            if entry:
                rows.append(entry)
            entry, bare = {"section": section}, bare[2:]
        key, _, value = bare.partition(":")
        if entry:
            entry[key.strip()] = value.strip().strip("\"'")
    if entry:
        rows.append(entry)
    names = {"core": "Core", "standard": "Standard", "extended": "Extended", "tombstoned": "Extended"}
    made = [(int(e["fid"]), e.get("name"), e.get("type"), names.get(e["section"]), e.get("status", "ACTIVE").upper(), e.get("since"), e.get("description"), e.get("unit")) for e in rows if e.get("fid", "").isdigit()]
    return spark.createDataFrame(made, COLUMNS)


def validate(fields: DataFrame, registry: DataFrame, policy: str = "code") -> DataFrame:
    """fields (fid, tag, ...) with `result`: Valid, Tombstoned, TypeMismatch, Deprecated or Unknown. Private ids are
    always valid."""
    dim = registry.select(F.col("fid").alias("_fid"), "expected", F.col("range").alias("_range"), "status")
    joined = fields.join(F.broadcast(dim), F.col("fid") == F.col("_fid"), "left")
    where = F.coalesce("_range", fid_range(F.col("fid"), policy))
    result = (
        F.when(where == "Private", "Valid")
        .when(F.col("_fid").isNull(), "Unknown")
        .when(F.col("status") == "TOMBSTONED", "Tombstoned")
        .when((F.col("expected") != "Any") & (F.col("expected") != type_name(F.col("tag"))), "TypeMismatch")
        .when(F.col("status") == "DEPRECATED", "Deprecated")
        .otherwise("Valid")
    )
    return joined.withColumn("result", result).drop("_fid", "_range", "status")


def invalid(fields: DataFrame, registry: DataFrame) -> DataFrame:
    return validate(fields, registry).where("result <> 'Valid'")


def enforce(fields: DataFrame, registry: DataFrame, mode: str = "none") -> DataFrame:
    """mode none or warn: adds result; error: fails on any that is not valid. Tombstoned ids always fail."""
    out = validate(fields, registry)
    bad = F.col("result") == "Tombstoned" if mode != "error" else F.col("result") != "Valid"
    return out.withColumn("result", F.when(bad, F.raise_error(F.concat(F.lit("field "), F.col("fid"), F.lit(": "), F.col("result"))).cast("string")).otherwise(F.col("result")))


def unknown(fields: DataFrame, registry: DataFrame) -> DataFrame:
    return fields.join(F.broadcast(registry.select("fid")), "fid", "left_anti")


def statistics(registry: DataFrame) -> DataFrame:
    return registry.groupBy("expected", "status").agg(F.count("*").alias("n"))


def duplicates(registry: DataFrame) -> DataFrame:
    return registry.groupBy("fid").agg(F.count("*").alias("n")).where("n > 1")


def problems(registry: DataFrame) -> DataFrame:
    """(fid, problem): out of its section's range, a bad name, an unknown status."""
    checks = F.array(
        F.when(fid_range(F.col("fid"), "spec") != F.col("range"), "RANGE"),
        F.when(~F.col("name").rlike("^[a-z][a-z0-9_]*$"), "NAME"),
        F.when(~F.col("status").isin(*STATUSES), "STATUS"),
    )
    return registry.select("fid", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem"))


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fid, change) for what breaks readers of old: a full outer join."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.fid") == F.col("n.fid"), "full")
    live = F.col("o.fid").isNotNull() & F.col("n.fid").isNotNull()
    differ = lambda c: live & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    gone = F.col("o.status") == "TOMBSTONED"
    changes = F.array(
        F.when(F.col("n.fid").isNull() & ~gone, "REMOVED"),
        F.when(differ("expected") & ~gone, "TYPE_CHANGE"),
        F.when(differ("unit") & ~gone, "UNIT_CHANGE"),
        F.when(differ("name") & ~gone, "NAME_CHANGE"),
        F.when(live & gone & (F.col("n.status") != "TOMBSTONED"), "TOMBSTONE_REUSE"),
    )
    return both.select(F.coalesce("o.fid", "n.fid").alias("fid"), F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("change"))


# ---------------------------------------------------------------- peers


def version_key(v: Column) -> Column:
    """A version as a struct that orders like its first three numbers; parts that are none are passed over."""
    parts = F.filter(F.transform(F.split(v, r"\."), lambda p: F.when(p.rlike("^[+]?[0-9]+$"), p).try_cast("int")), lambda n: n.isNotNull())
    return F.struct(*[F.coalesce(F.get(parts, F.lit(k)), F.lit(0)).alias(f"v{k}") for k in range(3)])


def entries(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registry's entries of the wanted ids (fid)."""
    return registry.join(wanted.select("fid").distinct(), "fid", "left_semi").select(*registry.columns)


# Other spellings of the expected types.
TYPE_SPELLINGS = {"Int": ("int", "integer"), "Float": ("float", "double"), "Bool": ("bool", "boolean"), "String": ("string", "str"), "StringArray": ("stringarray", "string_array"), "IntArray": ("intarray", "int_array"), "FloatArray": ("floatarray", "float_array"), "BoolArray": ("boolarray", "bool_array"), "Record": ("record", "nestedrecord", "nested_record"), "RecordArray": ("recordarray", "record_array", "nestedarray"), "Any": ("any",)}


def parse_type(s: Column) -> Column:
    """The expected type's name by any of its spellings, in any case; null for none."""
    out = F.lit(None).cast("string")
    for name, words in TYPE_SPELLINGS.items():
        out = F.when(F.lower(s).isin(*words), name).otherwise(out)
    return out


def parse_status(s: Column) -> Column:
    return F.when(F.upper(s).isin(*STATUSES), F.upper(s))


def peers(peer_versions: DataFrame, local: str) -> DataFrame:
    """(peer, version) with ahead and behind: how the local version compares; a peer without version is behind us."""
    mine, theirs = version_key(F.lit(local)), version_key(F.col("version"))
    return peer_versions.withColumns({"ahead": F.col("version").isNull() | (mine > theirs), "behind": F.col("version").isNotNull() & (mine < theirs)})


def delta_for_peers(peer_versions: DataFrame, registry: DataFrame, local: str) -> DataFrame:
    """All entries for every peer that the local registry is ahead of."""
    return peers(peer_versions, local).where("ahead").select("peer").join(F.broadcast(registry.select("fid", "name")))


# ---------------------------------------------------------------- dictionaries


def importance_by_record(fields: DataFrame, importance: DataFrame, *keys: str, default: int = 128) -> DataFrame:
    """The largest importance of a record's fields, or the default."""
    found = fields.join(F.broadcast(importance), "fid", "left")
    return found.groupBy(*keys).agg(F.coalesce(F.max("importance"), F.lit(default)).alias("importance"))


#: Entries of a table of equivalences that may be broadcast; larger ones are joined by key.
MOST_BROADCAST = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def normalize_strings(fields: DataFrame, equivalences: DataFrame, case: str | None = None) -> DataFrame:
    """String fields with their dictionary's value: exact first, then trimmed and in lower case, then the case rule.
    equivalences: (fid, from, to)."""
    exact = equivalences.select(F.col("fid").alias("_f1"), F.col("from").alias("_from1"), F.col("to").alias("_to1"))
    loose = equivalences.groupBy("fid", F.lower(F.trim("from")).alias("_k")).agg(F.min("to").alias("_to2")).select(F.col("fid").alias("_f2"), F.col("_k").alias("_from2"), "_to2")
    out = fields.join(_small(exact), (F.col("fid") == F.col("_f1")) & (F.col("s") == F.col("_from1")), "left")
    out = out.join(_small(loose), (F.col("fid") == F.col("_f2")) & (F.lower(F.trim("s")) == F.col("_from2")), "left")
    rule = {"lower": F.lower, "upper": F.upper}.get(case, lambda s: s)
    return out.withColumn("s", F.when(F.col("tag") == "s", F.coalesce("_to1", "_to2", rule(F.col("s")))).otherwise(F.col("s"))).drop("_f1", "_from1", "_to1", "_f2", "_from2", "_to2")


def normalize_float(x: Column, digits: int | None = None) -> Column:
    """-0 as 0, rounded half away from zero when digits are given."""
    x = F.when(x == 0, F.lit(0.0)).otherwise(x)
    return F.round(x, digits) if digits is not None else x


def normalize_bool(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


# Spellings that a boolean field's equivalences know.
BOOL_SPELLINGS = {"1": ("true", "TRUE", "True", "yes", "YES", "Yes"), "0": ("false", "FALSE", "False", "no", "NO", "No")}


def bool_equivalences(spark: SparkSession, fid: int) -> DataFrame:
    return spark.createDataFrame([(fid, s, to) for to, words in BOOL_SPELLINGS.items() for s in words], "fid int, from string, to string")
