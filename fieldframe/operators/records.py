"""Records: arrays of fields. A field is struct<pos, fid, tag, i, f, b, s, sa, ia, fa, ba>; pos is its place as it was
added, tag names its type (i f b s sa ia fa ba), and the value is in the column of that name. Records keep order and
duplicates; sorting is by (fid, pos). Nested records are rows of the field table with a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checksum, fmt

TYPES = {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "sa": "array<string>", "ia": "array<bigint>", "fa": "array<double>", "ba": "array<boolean>"}
FIELD = "struct<pos:int,fid:int,tag:string," + ",".join(f"{k}:{v}" for k, v in TYPES.items()) + ">"
# Limits of structure.
MAX_DEPTH, MAX_FIELDS, MAX_STRING, MAX_ITEMS = 32, 4096, 16384, 1024


def field(pos: int | Column, fid: int | Column, tag: str, value: Column) -> Column:
    col = lambda x: F.lit(x) if isinstance(x, int) else x
    values = [(value if k == tag else F.lit(None)).cast(t).alias(k) for k, t in TYPES.items()]
    return F.struct(col(pos).cast("int").alias("pos"), col(fid).cast("int").alias("fid"), F.lit(tag).alias("tag"), *values)


def record(*fields: tuple[int, str, Column] | tuple[int, str, Column, Column]) -> Column:
    """From (fid, tag, value) or (fid, tag, value, present), in that order; a null value is no field."""
    made = []
    for pos, spec in enumerate(fields):
        present = spec[2].isNotNull() if len(spec) == 3 else spec[3] & spec[2].isNotNull()
        made.append(F.when(present, field(pos, spec[0], spec[1], spec[2])))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def add(rec: Column, fid: int, tag: str, value: Column) -> Column:
    return F.array_append(rec, field(F.size(rec), fid, tag, value))


def get(rec: Column, fid: int) -> Column:
    """The first field with that id, or null."""
    return F.get(F.filter(rec, lambda x: x["fid"] == fid), F.lit(0))


def remove(rec: Column, fid: int) -> Column:
    """Without any field of that id."""
    return F.filter(rec, lambda x: x["fid"] != fid)


def sort(rec: Column) -> Column:
    """By fid; fields of one fid stay in their order."""
    return F.array_sort(rec, lambda a, b: F.when(a["fid"] != b["fid"], a["fid"] - b["fid"]).otherwise(a["pos"] - b["pos"]))


def _is_empty(x: Column) -> Column:
    out = (x["tag"] == "s") & (x["s"] == "")
    for k in ("sa", "ia", "fa", "ba"):
        out = out | ((x["tag"] == k) & (F.size(x[k]) == 0))
    return out


def canonical(rec: Column) -> Column:
    """Sorted, without empty strings and arrays."""
    return F.filter(sort(rec), lambda x: ~_is_empty(x))


def _number(x: Column, plain: bool) -> Column:
    return fmt.plain_float_text(x) if plain else fmt.float_text(x)


def _by_tag(x: Column, string, item, plain: bool, sep: str = ",") -> Column:  # noqa: ANN001
    cases = {
        "i": x["i"].cast("string"),
        "f": _number(x["f"], plain),
        "b": fmt.bit_text(x["b"]),
        "s": string(x["s"]),
        "sa": F.array_join(F.transform(x["sa"], item), sep),
        "ia": F.array_join(F.transform(x["ia"], lambda v: v.cast("string")), sep),
        "fa": F.array_join(F.transform(x["fa"], lambda v: _number(v, plain)), sep),
        "ba": F.array_join(F.transform(x["ba"], fmt.bit_text), sep),
    }
    out = F.lit(None).cast("string")
    for tag, text in cases.items():
        out = F.when(x["tag"] == tag, text).otherwise(out)
    return out


def value_text(x: Column, literals: bool = True, sep: str = ",") -> Column:
    """A field's value as record text has it."""
    string = lambda s: fmt.string_text(s, literals)
    text = _by_tag(x, string, string, False, sep)
    return F.when(x["tag"].isin("sa", "ia", "fa", "ba"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)


def checksum_text(x: Column) -> Column:
    """A field's value as checksums see it: bare strings, items joined by commas, no -0."""
    return _by_tag(x, lambda s: s, lambda s: s, True)


def field_checksum(x: Column, hints: bool = True) -> Column:
    return checksum.field_checksum(x["fid"], x["tag"] if hints else None, checksum_text(x))


def field_text(x: Column, hints: bool = False, checksums: bool = False) -> Column:
    parts = [F.lit("F"), x["fid"].cast("string")]
    if hints:
        parts += [F.lit(":"), x["tag"]]
    parts += [F.lit("="), value_text(x)]
    if checksums:
        parts += [F.lit("#"), checksum.show(field_checksum(x, hints))]
    return F.concat(*parts)


def text(rec: Column, hints: bool = False, checksums: bool = False, sep: str = "\n") -> Column:
    """Canonical text: one field a line, or joined by semicolons."""
    return F.array_join(F.transform(canonical(rec), lambda x: field_text(x, hints, checksums)), sep)


def canonical_hash(rec: Column) -> Column:
    return F.xxhash64(text(rec, hints=True))


def canonical_equal(a: Column, b: Column) -> Column:
    strip = lambda r: F.transform(sort(r), lambda x: F.struct(*[x[k] for k in ("fid", "tag", *TYPES)]))
    return strip(a) == strip(b)


def is_stable(rec: Column) -> Column:
    """Whether the canonical form of the canonical form is itself."""
    return canonical(rec) == canonical(canonical(rec))


def order_violations(rec: Column) -> Column:
    """Neighbours of which the second has the smaller fid."""
    fids = F.transform(rec, lambda x: x["fid"])
    steps = F.zip_with(F.slice(fids, 1, F.greatest(F.size(fids) - 1, F.lit(0))), F.slice(fids, 2, F.greatest(F.size(fids), F.lit(0))), lambda a, b: b < a)
    return F.size(F.filter(steps, lambda x: F.coalesce(x, F.lit(False))))


def limit_error(rec: Column, max_fields: int = MAX_FIELDS, max_string: int = MAX_STRING, max_items: int = MAX_ITEMS) -> Column:
    """Null, or the first limit that a record breaks, fields in their order; lengths are in bytes."""
    long = lambda s: F.octet_length(s) > max_string

    def one(x: Column) -> Column:
        size = F.coalesce(*[F.when(x["tag"] == k, F.size(x[k])) for k in ("sa", "ia", "fa", "ba")], F.lit(0))
        return F.when((x["tag"] == "s") & long(x["s"]), "StringTooLong").when(size > max_items, "ArrayTooLong").when((x["tag"] == "sa") & F.exists(F.coalesce(x["sa"], F.array().cast("array<string>")), long), "StringTooLong")

    first = F.get(F.filter(F.transform(rec, one), lambda e: e.isNotNull()), F.lit(0))
    return F.when(F.size(rec) > max_fields, "TooManyFields").otherwise(first)


# ---------------------------------------------------------------- the field table


def to_fields(df: DataFrame, rec: str, *keys: str) -> DataFrame:
    """One row for each field: keys, pos, fid, tag and the values."""
    return df.select(*keys, F.inline(rec))


def to_records(fields: DataFrame, *keys: str) -> DataFrame:
    """The reverse: keys and `rec`. A record's fields meet in one row, so their number is bounded by the record's."""
    whole = F.struct("pos", "fid", "tag", *TYPES)
    return fields.groupBy(*keys).agg(F.array_sort(F.collect_list(whole)).alias("rec"))


def wide(fields: DataFrame, key: str, columns: dict[int, tuple[str, str]]) -> DataFrame:
    """One column for each known fid: {fid: (name, tag)}; the first field of an id counts."""
    aggs = [F.min_by(F.when(F.col("fid") == fid, F.col(tag)), F.when(F.col("fid") == fid, F.col("pos"))).alias(name) for fid, (name, tag) in columns.items()]
    return fields.groupBy(key).agg(*aggs)


def depth(fields: DataFrame, *keys: str) -> DataFrame:
    """Depth of each top-level field of a field table with `path` (fids of what holds the field, outermost first): 0
    for a scalar, 1 and the deepest child for a nested record, 1 for an empty one."""
    own = F.size("path") + F.when(F.col("tag").isin("r", "ra"), 1).otherwise(0)
    top = F.when(F.size("path") > 0, F.get("path", F.lit(0))).otherwise(F.col("fid"))
    return fields.groupBy(*keys, top.alias("top_fid")).agg(F.max(own).cast("int").alias("depth"))


def dedup(df: DataFrame, rec: str, order: str) -> DataFrame:
    """The first of each group of canonically equal records, by canonical text; a grouped minimum, no window."""
    keyed = df.withColumn("_text", text(F.col(rec), hints=True))
    return keyed.groupBy("_text").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_r"), F.count("*").alias("copies")).select("_r.*", "copies")


def lagged_violations(fields: DataFrame, *keys: str) -> DataFrame:
    """order_violations over a field table, by window."""
    w = W.partitionBy(*keys).orderBy("pos")
    return fields.withColumn("_before", F.lag("fid").over(w)).groupBy(*keys).agg(F.count_if(F.col("fid") < F.col("_before")).alias("violations"))
