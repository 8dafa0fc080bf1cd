"""Records as prompt text: short forms, explained lines, hints, paths, short ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt, ordered
from . import records


def short_form(rec: Column) -> Column:
    """`fid=value;...` by fid; empties stay, and only characters decide about quotes."""
    return F.array_join(F.transform(records.sort(rec), lambda x: F.concat(x["fid"].cast("string"), F.lit("="), records.value_text(x, literals=False))), ";")


def _name(names: Column, fid: Column) -> Column:
    return F.try_element_at(names, fid)


def explained(rec: Column, names: Column, column: int = 20, hints: bool = True) -> Column:
    """Canonical lines, each with its field's name as a comment at that column or two spaces on. names: map<int, string>.

    The reader of these lines sees names next to numbers; lines of unnamed fields are left as they are."""

    def line(x: Column) -> Column:
        base = records.field_text(x, hints)
        size = F.octet_length(base)
        pad = F.repeat(F.lit(" "), F.when(size < column, F.lit(column) - size).otherwise(F.lit(2)))
        return F.when(_name(names, x["fid"]).isNull(), base).otherwise(F.concat(base, pad, F.lit("# "), _name(names, x["fid"])))

    return F.array_join(F.transform(records.canonical(rec), line), "\n")


def hinted(rec: Column, hints: Column) -> Column:
    """`F12=1 # name@sem` lines. hints: map<int, string>."""

    def line(x: Column) -> Column:
        base = F.concat(F.lit("F"), x["fid"].cast("string"), F.lit("="), records.value_text(x, literals=False))
        return F.when(_name(hints, x["fid"]).isNull(), base).otherwise(F.concat(base, F.lit(" # "), _name(hints, x["fid"]), F.lit("@sem")))

    return F.array_join(F.transform(records.sort(rec), line), "\n")


def flatten(fields: DataFrame, *keys: str) -> DataFrame:
    """Leaves of a field table with the path of fids (and places in arrays, from 1) that leads to each."""
    return fields.where("tag not in ('r', 'ra', 'v', 'qv')").withColumn("path_text", F.concat_ws(".", F.transform("path", lambda p: p.cast("string")), F.col("fid").cast("string"))).select(*keys, "path_text", "tag", *records.TYPES)


def unflatten(fid: Column) -> Column:
    """struct<base, leaf>: ids from 256 on are a base and a leaf byte, smaller ones stand for themselves."""
    return F.when(fid >= 256, F.struct(F.shiftright(fid, 8).alias("base"), fid.bitwiseAND(F.lit(255)).alias("leaf"))).otherwise(F.struct(F.lit(None).cast("int").alias("base"), fid.alias("leaf")))


def short_id(name: Column) -> Column:
    """Names of up to three bytes in lower case, longer ones as first letter and number of bytes; `x` for no name."""
    size = F.octet_length(name)
    return F.when(size == 0, "x").when(size <= 3, F.lower(name)).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), size.cast("string")))


def short_ids(df: DataFrame, name: str, order: str, cell: int = 4096) -> DataFrame:
    """Adds base, short_id (later names of one base get its number) and collides. order: a number; rows are numbered in
    cells of it, as a base can have any share of all names."""
    out = df.withColumn("base", short_id(F.col(name)))
    out = ordered.numbered(out, ["base"], F.floor(F.col(order) / cell), order, out="_n")
    sizes = out.groupBy("base").agg((F.count("*") > 1).alias("collides"))
    n = F.col("_n") - 1
    return out.join(sizes, "base").withColumn("short_id", F.when(n == 0, F.col("base")).otherwise(F.concat(F.col("base"), n.cast("string")))).drop("_n")


# ---------------------------------------------------------------- prompts


def needs_prompt_quotes(s: Column) -> Column:
    return (s == "") | s.rlike(r'^[0-9]|[ \t\n\r,;\[\]{}"\\#=]')


def prompt_string(s: Column, minimize: bool = True) -> Column:
    return F.when(F.lit(not minimize) | needs_prompt_quotes(s), fmt.quoted(s)).otherwise(s)


def prompt_float(x: Column) -> Column:
    return fmt.float_text(x)


def prompt_array(items: Column, minimize: bool = True, optimize: bool = True) -> Column:
    """Strings in brackets, with as few quotes and blanks as options allow."""
    shown = F.transform(items, lambda s: F.when(F.lit(not optimize) | needs_prompt_quotes(s), fmt.quoted(s)).otherwise(s))
    return fmt.bracketed(shown, "," if minimize or not optimize else ", ")


def prompt_value(x: Column, minimize: bool = True, optimize: bool = True) -> Column:
    """A field's value for a prompt."""
    sep = "," if minimize and optimize else ", "
    cases = {
        "i": x["i"].cast("string"),
        "f": prompt_float(x["f"]),
        "b": fmt.bit_text(x["b"]),
        "s": prompt_string(x["s"], minimize),
        "sa": prompt_array(x["sa"], minimize, optimize),
        "ia": fmt.bracketed(F.transform(x["ia"], lambda v: v.cast("string")), sep),
        "fa": fmt.bracketed(F.transform(x["fa"], prompt_float), sep),
        "ba": fmt.bracketed(F.transform(x["ba"], fmt.bit_text), sep),
    }
    out = F.lit("")
    for tag, text in cases.items():
        out = F.when(x["tag"] == tag, text).otherwise(out)
    return out
