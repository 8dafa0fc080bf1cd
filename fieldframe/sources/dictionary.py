"""Semantic dictionaries: a YAML file of fields with name, type, importance and equivalences, as three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .values import RecordError

# Types that an entry may name.
KINDS = {"int", "float", "bool", "string", "string_array", "int_array", "float_array", "bool_array", "record", "record_array", "embedding"}


@dataclass(frozen=True)
class Dictionary:
    names: DataFrame  # fid, name
    importance: DataFrame  # fid, importance
    equivalences: DataFrame  # fid, from, to


def parse(text: str) -> dict[int, dict]:
    """The entries by fid, checked."""
    out: dict[int, dict] = {}
    entry: dict | None = None
    inside = equal = False
    depth = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        key, value = key.strip().strip("\"'"), value.strip().strip("\"'")
        if indent == 0:
            inside = key == "fields"
        elif inside and (depth is None or indent <= depth):
            depth = indent
            if not key.isdigit() or int(key) > 65535:
                raise RecordError("ParseError", f"field id {key}")
            if int(key) in out:
                raise RecordError("DuplicateFieldId", key, int(key))
            entry = out[int(key)] = {"equivalences": {}}
            equal, inner = False, None
        elif inside and entry is not None:
            inner = indent if inner is None else inner
            if indent > inner and equal:
                entry["equivalences"][key] = value
                continue
            equal = key == "equivalences"
            if not equal:
                entry[key] = value
    if depth is None:
        raise RecordError("ParseError", "no fields")
    for fid, e in out.items():
        if "name" not in e:
            raise RecordError("ParseError", "no name", fid)
        if "type" in e and e["type"].lower() not in KINDS:
            raise RecordError("InvalidType", e["type"], fid)
        if "importance" in e and not (e["importance"].isdigit() and int(e["importance"]) <= 255):
            raise RecordError("ParseError", f"importance {e['importance']}", fid)
    return out


def load(spark: SparkSession, path: str) -> Dictionary:
    entries = parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # a dictionary has 65,536 entries at most
    return Dictionary(
        spark.createDataFrame([(f, e["name"]) for f, e in entries.items()], "fid int, name string"),
        spark.createDataFrame([(f, int(e["importance"])) for f, e in entries.items() if "importance" in e], "fid int, importance int"),
        spark.createDataFrame([(f, a, b) for f, e in entries.items() for a, b in e["equivalences"].items()], "fid int, from string, to string"),
    )


def add(tables: Dictionary, names: DataFrame | None = None, importance: DataFrame | None = None, equivalences: DataFrame | None = None) -> Dictionary:
    """With further rows; of a key's several values the new one counts."""

    def merged(old: DataFrame, new: DataFrame | None, *keys: str) -> DataFrame:
        return old if new is None else old.join(new, list(keys), "left_anti").unionByName(new)

    return Dictionary(merged(tables.names, names, "fid"), merged(tables.importance, importance, "fid"), merged(tables.equivalences, equivalences, "fid", "from"))
