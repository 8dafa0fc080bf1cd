"""Shared pieces: shared-folder tables, Arrow text kernels, connected components.

Every kernel works on Arrow string columns in pieces of a few MB, so the memory of a Python worker follows the piece
(or the longest single document), never the partition.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at a time.
PIECE = 1 << 20

U64 = np.uint64
#: Bytes with A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_MIX = [U64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: For each number of bytes up to eight, a word with those bytes set.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


# ---------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset and the master is local (tests, a laptop) one is
    made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldframe-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


#: Shuffle files of a table that is written can go: the table is what later steps read. Set for the write alone.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run in the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete_quietly, spark, self.root)

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        before = self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def pick(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns of a table, so that others with any name do no harm."""
    return docs.select(*[docs[c] for c in cols])


def blank(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("")))


# ---------------------------------------------------------------- Arrow kernels


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(col) else np.empty(0, np.uint8)
    return data, offs - offs[0]


def pieces(offs: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x *= _MIX[0]
    x ^= x >> U64(33)
    x *= _MIX[1]
    x ^= x >> U64(33)
    return x


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:n])
    edge[offs] = True
    first = edge[:n] & solid
    last = edge[1:] & solid
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, whatever its place. Every eight bytes are mixed with their
    number in the span before they are added up, so no algebra of the text carries over; seeds are independent."""
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", buf.data, strides=(1,))
    size = ends - starts
    key = U64(int(_MIX[3]) * (2 * seed + 1) % 2**64)

    def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        x = (eight[at] & _MASKS[np.minimum(left, 8)]) ^ key
        x *= _MIX[0]
        x ^= x >> U64(32)
        return x * _MIX[1]

    total = mix(block(starts, size))
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) >> 3  # blocks after the first
        first = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(first, n) + 1
        at = np.repeat(starts[long], n) + 8 * k
        total[long] += np.add.reduceat(mix(block(at, np.repeat(ends[long], n) - at) + k.astype(np.uint64) * _MIX[4]), first)
    return mix(total + size.astype(np.uint64) * _MIX[2])


def word_digests(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 digests (rows x 2 longs) of each row's words, joined by one space."""
    data, keep = data.copy(), ~SPACE[data]
    more = np.ones(len(ends), bool)
    more[first[1:][np.diff(first) > 0] - 1] = False  # a row's last word
    data[ends[more]] = 32
    keep[ends[more]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offs].tolist()
    view = memoryview(data[keep])
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]), "<i8").reshape(-1, 2)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all rows, and the offsets (n + 1) by row. A row of fewer words has its whole
    sequence as one; a row without words has none."""
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offs = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=offs[1:])
    out = np.empty(offs[-1], np.uint64)
    if len(words) >= k:
        rolled = words[: len(words) - k + 1] * _MIX[0]
        for j in range(1, k):
            rolled = (rolled ^ (rolled >> U64(29))) * _MIX[1] + words[j : len(words) - k + 1 + j] * _MIX[(j % 3) + 2]
        long = np.repeat(counts >= k, per)
        at = np.arange(len(out)) - np.repeat(offs[:-1], per) + np.repeat(first[:-1], per)
        out[long] = rolled[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = U64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[first[i] : first[i + 1]]:
                x = (x ^ (x >> U64(31))) * _MIX[4] + w
        out[offs[i]] = x
    return mix(out), offs


def distinct_by_row(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    values = values.copy()
    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if j - i > 1:
            values[i:j].sort()
    new = np.ones(len(values), bool)
    if len(values):
        new[1:] = values[1:] != values[:-1]
        new[offs[:-1][offs[:-1] < len(values)]] = True
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(new, out=total[1:])
    return values[new], total[offs]


def minima(values: np.ndarray, offs: np.ndarray, seeds: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """MinHash minima (rows x seeds, uint32) of each row's values; rows without values get the largest number. The values
    are hashes already: an odd factor deals each seed another order."""
    n, k = len(offs) - 1, len(seeds)
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offs))
    if not len(full):
        return out
    low = (values >> U64(32)).astype(np.uint32)
    for i, j in pieces(np.append(offs[full], offs[-1]), block):
        rows = full[i:j]
        a = offs[rows[0]]
        b = offs[rows[-1] + 1]
        x, cuts = low[a:b], offs[rows] - a
        y, least = np.empty_like(x), np.empty((k, len(rows)), np.uint32)
        for s in range(k):
            np.multiply(x, seeds[s], out=y)
            np.minimum.reduceat(y, cuts, out=least[s])
        out[rows] = least.T
    return out


def hash_seeds(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


# ---------------------------------------------------------------- connected components


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) for each vertex of an edge, component
    being the smallest id reachable. Alternates large-star and small-star steps, each a grouped minimum joined back, so
    that no vertex's neighbours meet in one task; every round is a table in the shared folder. No edges: no rows."""
    links = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    turn = 0
    while not _settled(links):
        turn += 1
        if turn == 100:
            raise RuntimeError(f"{name}: components have not settled after {turn - 1} rounds")
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # small-star: what a points at, all smaller than a, is pointed at the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        small = small.where("a <> b").distinct()
        links = scratch.table(small, f"{name}-{turn}")
        if turn > 1:
            scratch.drop(f"{name}-{turn - 1}")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def joined_components(scratch: Scratch, labels: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """Components (id, component) after further edges (a, b): only the components that these join are gone through."""
    part = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_part")).hint("merge")
    between = more.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    joined = scratch.table(components(scratch, between, name), f"{name}-joined")
    moved = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")).hint("merge"), "component", "left")
    moved = moved.select("id", F.coalesce("to", "component").alias("component"))
    return moved.unionAll(joined.join(labels.select("id").hint("merge"), "id", "left_anti").select("id", "component"))


def _settled(links: DataFrame) -> bool:
    """Whether links (a > b) are stars: every vertex points at one smaller one at most, and none of those points on. As
    rounds keep what hangs together, each star then is a component."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("out")), F.struct(F.col("b").alias("v"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    seen = ends.groupBy("v").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return seen.where("n > 1 or (n = 1 and least = 0)").isEmpty()
