"""Conflict-constrained best-fit packing of documents into sequences.

A document has its words and one end token, or the value of `length`. What fills whole sequences is cut off as pieces
that stand alone; the rest is packed. In a bin, no two pieces may come from the same source or the same duplicate
cluster: each bin carries a bitmap of its sources and one of its clusters. Bins are kept in the order of the room they
have left; from the first one with room enough, successors are tried until one is compatible, which is the tightest
compatible bin, else a bin is opened. Longer pieces come first, then smaller doc_ids.

Rows are dealt to shards of about `shard` rows each, by a hash of the row, so a hot source or cluster spreads evenly,
and each shard packs on its own: memory and time are bounded and a lost shard is packed again. Only doc_id, source,
length and cluster are moved, never texts.

Cases: a null or empty text is one end token; a null source or cluster is a value as any other; rows that repeat a doc_id are
pieces of one cluster, told apart by `copy`; equal lengths go by doc_id; an empty table gives no rows; a text of any length is
cut whole; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, U64, mix, pick, pieces, span_hashes, utf8, word_spans

CAPACITY = 2048
SHARD = 4096
SCHEMA = "doc_id long, copy int, piece int, bin long, position int, n_tokens int, source string"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, position) of each item, in the order given."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << k for k, c in enumerate(dict.fromkeys(clusters))}
    order: list[tuple[int, int]] = []  # (room left, bin), ascending
    held: list[tuple[int, int]] = []  # bitmaps of each bin
    out = []
    for need, s, c in zip(lengths, sources, clusters, strict=True):
        sb, cb = source_bit[s], cluster_bit[c]
        at = bisect_left(order, (need, -1))
        while at < len(order) and (held[order[at][1]][0] & sb or held[order[at][1]][1] & cb):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
            held[b] = (held[b][0] | sb, held[b][1] | cb)
        else:
            room, b = capacity, len(held)
            held.append((sb, cb))
        out.append((b, capacity - room))
        insort(order, (room - need, b))
    return out


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length in words and the end, and a hash of the word sequence as the cluster of copies."""
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        for i, j in pieces(offs):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, first = word_spans(part, at)
            words = mix(span_hashes(FOLD[part], starts, ends) ^ mix((np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64) + U64(1)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("source")[i:j], pa.array(np.diff(first) + 1), pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)), batch.column("own_n")[i:j], batch.column("own_cluster")[i:j]], ["doc_id", "source", "n", "cluster", "own_n", "own_cluster"])


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-(r["n"] % capacity), r["doc_id"] is None, r["doc_id"] or 0, r["cluster"] or 0, r["source"] or "", r["n"]))
        out, seen, number = [], {}, 0
        part = []
        for r in rows:
            copy = seen[r["doc_id"]] = seen.get(r["doc_id"], -1) + 1
            whole, rest = divmod(r["n"], capacity)
            for p in range(whole):
                out.append((r["doc_id"], copy, p, number, 0, capacity, r["source"]))
                number += 1
            if rest:
                part.append((r, copy, whole, rest))
        placed = best_fit([x[3] for x in part], [x[0]["source"] for x in part], [(x[0]["cluster"]) for x in part], capacity)
        out += [(r["doc_id"], copy, p, number + b, at, rest, r["source"]) for (r, copy, p, rest), (b, at) in zip(part, placed, strict=True)]
        base = table["shard"][0].as_py() << 32
        cols = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        cols[3] = [base + b for b in cols[3]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "copy", "piece", "bin", "position", "n_tokens", "source"])

    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, length: str | None = None, cluster: str | None = None) -> DataFrame:
    """(doc_id, copy, piece, bin, position, n_tokens, source): where each piece of each row of docs(doc_id, text,
    source) goes. length, cluster: columns to take instead of words and equal word sequences, either or both; length has to be 1 or
    more."""
    none = F.lit(None).cast("long")
    given = [F.greatest(F.coalesce(docs[length].cast("long"), F.lit(1)), F.lit(1)) if length else none, F.xxhash64(docs[cluster]) if cluster else none]
    given = [c.alias(n) for c, n in zip(given, ("own_n", "own_cluster"), strict=True)]
    if length and cluster:
        items = docs.select(docs["doc_id"], docs["source"], *given)
    else:
        items = docs.select(docs["doc_id"], docs["source"], docs["text"], *given).mapInArrow(_measure, "doc_id long, source string, n long, cluster long, own_n long, own_cluster long")
    items = items.select("doc_id", "source", F.col("own_n" if length else "n").alias("n"), F.col("own_cluster" if cluster else "cluster").alias("cluster"))
    shards = max(1, math.ceil(docs.count() / shard))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))
    # rows are few bytes and much work: a number of tasks of its own, or they would be coalesced by their bytes
    return items.repartition(math.ceil(shards / 8), "shard").groupBy("shard").applyInArrow(_pack(capacity), SCHEMA)
