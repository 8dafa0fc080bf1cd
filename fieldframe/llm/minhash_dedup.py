"""Near-dedup of documents by b-bit MinHash.

1. One pass over the texts gives for each document the number of distinct word shingles, a 128-bit cryptographic digest of
   its words, the lowest 4 bits of 128 minima packed into eight longs, and the band keys, made from the full minima.
2. Documents with the same words in the same order have equal sets: they are one class, and only its smallest doc_id
   goes on. However many copies there are, they meet in a grouped minimum, never in pairs. Equal sets in another order
   are found and confirmed as any others.
3. Every member of a band bucket is paired with the bucket's smallest doc_id. The packed signatures are compared by bit
   counts in the join condition; (matches / 128 - 1/16) / (1 - 1/16) corrects for equal low bits by chance. Pairs well
   below the threshold go no further.
4. The rest are confirmed on full shingle sets; confirmed pairs give connected components.
5. A bucket that still spans several components may hide a link that its first member doesn't have. Its documents get a
   finer sketch, 2 bits of 1024 minima, and all members outside the first member's component meet the members of other
   components, each pair once, in the first bucket that the two share. The join condition holds the finer estimate, so
   only pairs next to the threshold come out, and step 4 is repeated for them. So no candidate is dropped and no bucket
   is expanded into all its pairs.

With 5 minima a band and 25 bands, a pair at similarity 0.85 is missed with probability 5e-7, one at 0.8 with 7e-5.

Cases: null, empty and white-space-only texts have no shingles and are linked with nothing, not even each other; a text
of fewer words than a shingle has its whole sequence as one; repeated rows are copies; ties go to the smallest doc_id;
an empty table gives no rows; texts are read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, U64, Scratch, components, distinct_by_row, hash_seeds, joined_components, minima, mix, pick, pieces, shingle_hashes, span_hashes, utf8, word_digests, word_spans

HASHES = 128
BITS = 4
ROWS = 5
BANDS = HASHES // ROWS
#: What the signature estimate may lack of the threshold: five standard errors of 128 matches at 0.85.
SLACK = 0.16
#: The finer sketch, and what its estimate may lack: 4.5 standard errors of 1024 matches of 2 bits.
FINE_HASHES, FINE_BITS, FINE_SLACK = 1024, 2, 0.06
FINE = [f"w{i}" for i in range(FINE_HASHES * FINE_BITS // 64)]
SIGNATURE = [f"s{i}" for i in range(HASHES * BITS // 64)]


def shingle_sets(texts: pa.Array, k: int, digests: bool = False) -> Iterator[tuple]:
    """For each piece of rows i..j: sorted distinct shingle hashes and their offsets, and digests of the words."""
    data, offs = utf8(texts)
    for i, j in pieces(offs):
        part, at = FOLD[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends, first = word_spans(part, at)
        found = distinct_by_row(*shingle_hashes(span_hashes(part, starts, ends), first, k))
        yield (i, j, *found, word_digests(part, at, starts, ends, first)) if digests else (i, j, *found)


def band_keys(least: np.ndarray, rows: int, bands: int) -> np.ndarray:
    keys = np.empty((len(least), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(least), b + 1, np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            x = mix(x * U64(0x9E3779B97F4A7C15) + least[:, c])
        keys[:, b] = x
    return keys


def pack(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The lowest bits of each minimum, side by side in longs."""
    low = (least & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(least), -1, 64 // bits)
    return np.bitwise_or.reduce(low << (np.arange(64 // bits, dtype=np.uint64) * U64(bits)), axis=2)


def _sketch(k: int):
    seeds = hash_seeds(HASHES, 7)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, offs, said in shingle_sets(batch.column("text"), k, digests=True):
                least = minima(values, offs, seeds)
                packed = pack(least).view(np.int64)
                keys = band_keys(least, ROWS, BANDS).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(np.diff(offs)), pa.array(said[:, 0].copy()), pa.array(said[:, 1].copy()), *[pa.array(np.ascontiguousarray(packed[:, c])) for c in range(packed.shape[1])], bands], ["doc_id", "n_shingles", "h1", "h2", *SIGNATURE, "bands"])

    return sketch


def _sets(k: int, fine: bool):
    seeds = hash_seeds(FINE_HASHES, 8)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, offs in shingle_sets(batch.column("text"), k):
                more = pack(minima(values, offs, seeds), FINE_BITS).view(np.int64).T if fine else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values.view(np.int64))), *[pa.array(np.ascontiguousarray(w)) for w in more]], ["doc_id", "set", *FINE[: len(more)]])

    return sets


def estimate(a: str, b: str, words: list[str] = SIGNATURE, bits: int = BITS) -> Column:
    """Similarity by the signatures of two aliases, corrected for low bits that agree by chance."""
    ones = F.lit(sum(1 << i for i in range(0, 63, bits)))
    differ = None
    for s in words:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (1, 2)[: bits // 2]:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(ones))
        differ = n if differ is None else differ + n
    chance = 1 / (1 << bits)
    return ((1 - differ / F.lit(float(len(words) * 64 // bits))) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text): documents whose sets of k-word
    shingles have 100 * intersection >= percent * union are linked."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = pick(docs, "doc_id", "text")
    schema = "doc_id long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", bands array<long>"
    sketch = scratch.table(texts.mapInArrow(_sketch(k), schema), "sketch")
    some = sketch.where("n_shingles > 0")

    # classes of equal words
    same = scratch.table(some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(same.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = scratch.table(reps.select("doc_id", "n_shingles", *SIGNATURE, "bands"), "reps")

    keys = reps.select("doc_id", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "first")
    members = scratch.table(keys.join(buckets.hint("merge"), "band"), "members")  # (band, doc_id, first): only buckets of two or more
    candidates = members.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    floor = percent / 100 - SLACK
    pairs = scratch.table(_likely(candidates, reps, floor), "pairs")
    sets = scratch.table(_fetch(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), k), "sets")
    links = scratch.table(_confirmed(pairs, sets, percent), "links")
    scratch.drop("sets")
    labels = scratch.table(components(scratch, links, "cc1"), "labels1")

    # buckets that span several components
    known = members.join(labels.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left").select("band", "doc_id", "first", F.coalesce("component", "doc_id").alias("part"))
    heads = known.where("doc_id = first").select("band", F.col("part").alias("head"))
    # only buckets of several parts go on
    open_ = known.join(heads.hint("merge"), "band")
    open_ = scratch.table(open_.join(open_.where("part <> head").select("band").distinct().hint("merge"), "band", "left_semi"), "open")
    if not open_.isEmpty():
        fine = scratch.table(_fetch(texts, open_.select("doc_id"), k, fine=True), "fine")
        placed = open_.join(fine.select("doc_id", *FINE).hint("merge"), "doc_id").join(reps.select("doc_id", "n_shingles", "bands").hint("merge"), "doc_id")
        strays = placed.where("part <> head").alias("x")
        # a stray has met the head already; those of the head's component other than the head, and other strays, are left
        rest = placed.where("doc_id <> first").alias("y")
        meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.head")) | (F.col("x.doc_id") < F.col("y.doc_id")))
        meet = meet & (F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * percent)
        meet = meet & (estimate("x", "y", FINE, FINE_BITS) >= percent / 100 - FINE_SLACK)
        once = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.array_position("x.bands", F.col("x.band"))
        more = strays.join(rest.hint("merge"), meet & once).select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct()
        more = scratch.table(_confirmed(more, fine, percent), "more")
        if not more.isEmpty():
            labels = scratch.table(joined_components(scratch, labels, more, "cc2"), "labels2")

    found = same.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    rows = sketch.select("doc_id", "n_shingles", "h1", "h2")
    out = rows.join(found.hint("merge"), ["n_shingles", "h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _likely(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    sig = reps.select("doc_id", *SIGNATURE)
    left = pairs.join(sig.withColumnRenamed("doc_id", "a").hint("merge"), "a").alias("x")
    return left.join(sig.alias("y").hint("merge"), (F.col("x.b") == F.col("y.doc_id")) & (estimate("x", "y") >= floor)).select("a", "b")


def _fetch(texts: DataFrame, ids: DataFrame, k: int, fine: bool = False) -> DataFrame:
    """Shingle sets of the documents with those ids, read again from the texts; fine: with the finer sketch."""
    wanted = texts.join(ids.distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return wanted.mapInArrow(_sets(k, fine), "doc_id long, set array<long>" + "".join(f", {w} long" for w in FINE if fine))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough by their full sets."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * percent).select("a", "b")
