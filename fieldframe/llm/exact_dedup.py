"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes, level by level, until a group is a singleton or its texts have ended. A level
is a run of bytes (64, then eight times as many each time), and a group's documents are told apart by those bytes
themselves; no digest decides equality. Level sizes grow so that the number of rounds follows the logarithm of the
longest text.

* Each scan task first radix-splits its own batch, so a text with any number of copies enters the shuffles once per
  batch.
* A round is a grouped minimum over (group, bytes) joined back to the documents of groups with two or more, so a hot
  prefix is pre-aggregated and its join can be split by adaptive execution; singletons leave at once.
* Levels are columns of one table in the shared folder: a round reads only its own bytes.

Cases: a null text counts as empty; empty texts are equal to each other, and a text of white space alone is one space;
repeated rows with one doc_id are one group of that size; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Ends of the levels in bytes; the last level takes all that is left.
LEVELS = (64, 512, 4096, 32768, 262144, 2097152)


def normalise(text: str | None) -> bytes:
    """Each run of the six ASCII white-space characters as one space."""
    raw = (text or "").encode()
    out = b" ".join(raw.split())
    if not out:
        return b" " if raw else b""
    return b" " * (raw[:1] in b" \t\n\v\f\r") + out + b" " * (raw[-1:] in b" \t\n\v\f\r")


def radix_groups(texts: list[bytes], width: int = 8) -> Iterator[list[int]]:
    """Groups of equal texts: recursive MSD split by successive bytes, `width` of them at a time."""
    todo = [(list(range(len(texts))), 0, width)]
    while todo:
        rows, at, step = todo.pop()
        if len(rows) == 1:
            yield rows
            continue
        parts: dict[bytes, list[int]] = {}
        for i in rows:
            parts.setdefault(texts[i][at : at + step], []).append(i)
        for cut, part in parts.items():
            if len(cut) < step:
                yield part
            else:
                todo.append((part, at + step, step * 4))


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [normalise(t) for t in batch.column("text").to_pylist()]
        reps: list[int] = [0] * len(ids)
        for group in radix_groups(texts):
            first = min(group, key=lambda i: (ids[i] is None, ids[i]))
            for i in group:
                reps[i] = first
        cuts = (0, *LEVELS)
        own = [i == r for i, r in enumerate(reps)]
        cols = {
            "doc_id": pa.array(ids, pa.int64()),
            "row": pa.array(range(len(ids)), pa.int64()),
            "rep_row": pa.array(reps, pa.int64()),
            "sha": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        for k, a in enumerate(cuts):
            b = cuts[k + 1] if k + 1 < len(cuts) else None
            cols[f"c{k}"] = pa.array([t[a:b] if mine else None for t, mine in zip(texts, own, strict=True)], pa.binary())
        yield pa.RecordBatch.from_pydict(cols)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    levels = len(LEVELS) + 1
    schema = "doc_id long, row long, rep_row long, sha string, " + ", ".join(f"c{k} binary" for k in range(levels))
    split = pick(docs, "doc_id", "text").mapInArrow(_split, schema)
    # rows are numbered within their batch; with the batch's first number (unique within the task) they get a table-wide id
    split = split.withColumn("u", F.monotonically_increasing_id()).withColumn("rep", F.col("u") - F.col("row") + F.col("rep_row"))
    table = scratch.table(split.drop("row", "rep_row"), "split", compression="zstd")

    reps = table.where("u = rep")
    state = reps.select(F.col("u"), F.lit(0).cast("long").alias("g"))
    ended = []
    for k in range(levels):
        now = reps.select("u", F.col(f"c{k}").alias("c"))
        now = now.withColumn("g", F.lit(0).cast("long")) if k == 0 else now.join(state.hint("merge"), "u")
        groups = now.groupBy("g", "c").agg(F.min("u").alias("to"), F.count("*").alias("n")).where("n > 1")
        last = k == levels - 1
        width = F.lit(1 << 62) if last else F.lit(LEVELS[k] - (LEVELS[k - 1] if k else 0))
        found = now.join(groups.drop("n").hint("merge"), ["g", "c"]).select("u", F.col("to").alias("g"), (F.octet_length("c") < width).alias("done"))
        found = scratch.table(found, f"level{k}")
        ended.append(found.where("done").select("u", "g"))
        state = found.where("not done").select("u", "g")
        if last or state.isEmpty():
            break
    same = ended[0]
    for more in ended[1:]:
        same = same.unionAll(more)
    same = same.withColumnRenamed("u", "rep")
    rows = table.select("doc_id", "rep", "sha").join(same.hint("merge"), "rep", "left").select("doc_id", "sha", F.coalesce("g", "rep").alias("g"))
    groups = rows.groupBy("g").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups.hint("merge"), "g").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
