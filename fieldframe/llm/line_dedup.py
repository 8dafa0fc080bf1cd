r"""Fuzzy line dedup by MinHash.

A line is what `\n` separates; A-Z count as a-z. Lines of fewer than `min_chars` characters always stay. Lines with
equal text, or with a Jaccard similarity of 0.8 or more between their sets of 5-character shingles, are linked; of each
connected component the first line by (doc_id, line number) stays, all others go.

1. One pass gives each line its identity, a 128-bit cryptographic digest (BLAKE2), and each distinct line of a few MB of
   text its MinHash minima; lines that a task has had lately are left out. Copies of a line fall together by identity
   and never meet in pairs.
2. `BANDS` keys of `ROWS` minima each make buckets. A walk over rows sorted by band pairs each member with the first
   line and with the one before it; no bucket is held in memory or expanded into all its pairs.
3. Of lines that agree with another one of a bucket in enough packed low bits of their minima, the texts are fetched
   once, with a finer sketch: the parities of how many of the line's shingles fall to each of 2048 bits. The number of
   differing bits gives the size of the two sets' difference within a few shingles, so nearly all pairs that come out
   are similar enough. They are verified: the Jaccard similarity is counted from both whole sets, character by character.
4. Verified pairs give components by distributed large-star and small-star steps.
5. Buckets that still span several components are gone through once more, the lines of each against those of the
   others, in a join whose condition holds both sketches.
6. A last pass over the texts takes each line's component, keeps the first position of each, and rebuilds documents.

The minima are 60, five to a band, so a pair at 0.8 is a candidate with probability 0.99, at 0.85 with 0.999 and at 0.9
with 0.99999.

Cases: null and empty texts have no lines to lose and stay as they are; empty lines stay; equal lines within a document
count as any others; rows that repeat a doc_id with another text are documents of their own, in the order of the texts'
hashes, and rows that repeat both are one document; an empty table gives no rows; lines of any length are read whole;
further columns stay. Lines that share 64 bits of their identity with another line, but not all 128, are compared for
equality only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import FOLD, U64, Scratch, components, distinct_by_row, hash_seeds, joined_components, minima, mix, pick, pieces, utf8

SHINGLE = 5
MIN_CHARS = 10
PERCENT = 80
ROWS = 5
BANDS = 12
HASHES = ROWS * BANDS
#: Low bits kept of the last 32 minima, in one long. A pair has to agree in as many of them at least to go on: a pair at
#: 0.8 does with probability 0.999.
BITS, KEPT, AGREE = 2, 32, 20
#: The finer sketch: bits of a line's parities, the shingles from which only every second, fourth ... is taken, and how
#: many standard errors a pair's differing bits may be above what is expected at the threshold.
PARITIES, LEVEL, ERRORS = 2048, 8192, 4.5
#: Shingles that are hashed at a time, so that they stay in the processor's cache.
BLOCK = 1 << 14


class Lines:
    """Lines of `min_chars` characters or more of a piece of text, in its order, with their 128-bit identities: BLAKE2 of the
    line's bytes with A-Z as a-z."""

    def __init__(self, texts: pa.Array, min_chars: int):
        self.raw, offs = utf8(texts)
        self.data = data = np.frombuffer(self.raw.tobytes().lower(), np.uint8)  # of bytes, only A-Z have small ones
        n = len(offs) - 1
        newline = np.flatnonzero(data == 10)
        row_b = np.searchsorted(offs, newline, "right") - 1
        # a text's lines begin with it and after each newline; a stable sort keeps a text's first line before the others
        rows = np.concatenate([np.arange(n), row_b])
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        begins = np.concatenate([offs[:-1], newline + 1])[order]
        ends = np.concatenate([newline, offs[1:]])[np.argsort(np.concatenate([row_b, np.arange(n)]), kind="stable")]
        first = np.searchsorted(rows, np.arange(n))
        number = np.arange(len(rows)) - first[rows]
        # characters are bytes but for those that continue one
        more = np.flatnonzero(data.view(np.int8) < -64)
        size = ends - begins - (np.searchsorted(more, ends) - np.searchsorted(more, begins))
        use = size >= max(min_chars, SHINGLE)
        self.row, self.number, self.begin, self.end, self.size = rows[use], number[use], begins[use], ends[use], size[use]
        view = memoryview(data)
        digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)])
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        self.h1, self.h2 = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def distinct(self) -> np.ndarray:
        """One line for each content, in the order of the text."""
        return np.sort(np.unique(self.h1, return_index=True)[1])

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the given lines, one or more in the text's order, and their offsets."""
        view = memoryview(self.data)
        data = b"".join([view[a:b] for a, b in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)])
        cp = np.frombuffer(data, np.uint8) if data.isascii() else np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        size = self.size[which]
        stop = np.cumsum(size)
        offs = np.concatenate([[0], np.cumsum(size - SHINGLE + 1)])
        x = np.empty(len(cp) - SHINGLE + 1, np.uint64)
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            low = cp[a : a + len(part) + SHINGLE - 1].astype(np.uint64)
            low += U64(0x9E37)
            low *= U64(0xD6E8FEB86659FD93)
            low ^= low >> U64(32)
            part[:] = low[: len(part)]
            for k in range(1, SHINGLE):
                part *= U64(0x9E3779B97F4A7C15)
                part += low[k : k + len(part)]
            part ^= part >> U64(32)
            part *= U64(0xC4CEB9FE1A85EC53)
        inside = np.ones(len(x), bool)
        for k in range(1, SHINGLE):
            inside[stop[:-1] - k] = False  # these would reach into the next line
        return x[inside], offs

    def text(self, i: int) -> str:
        return self.raw[self.begin[i] : self.end[i]].tobytes().decode()


def _pieces(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, int, Lines]]:
    _, offs = utf8(batch.column("text"))
    for i, j in pieces(offs):
        yield i, j, Lines(batch.column("text")[i:j], min_chars)


def _band_keys(lines: Lines, which: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least = minima(*lines.shingles(which), seeds)
    keys = np.empty((len(which), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(which), b + 1, np.uint64)
        for c in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x * U64(0x9E3779B97F4A7C15) + least[:, c])
        keys[:, b] = x
    return keys.view(np.int64), least


#: Slots of the table by which a task leaves out most lines that it has had: 8 MB.
SEEN = 1 << 20


#: A band row as it is moved: many of one part of the keys are one binary value.
BAND = np.dtype([("band", "<i8"), ("id", "<i8"), ("s0", "<i8")])
#: Band rows that a task gathers before it deals them out: 12 MB. Parts of the keys for each shuffle partition.
GATHERED, PARTS = 1 << 19, 4


def _dealt(parts: int, rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The band rows of `rows` dealt by key to parts, as rows (part, packed)."""

    def deal(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = {n: np.concatenate([b.column(n).to_numpy() for b in some]) for n in BAND.names}
        part = (mix(cols["band"].view(np.uint64)) % U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        packed = np.empty(len(part), BAND)
        for n, c in cols.items():
            packed[n] = c[order]
        found, at = np.unique(part[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([x.tobytes() for x in np.split(packed, at[1:])], pa.binary())], ["part", "packed"])

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in rows(batches):
            held.append(b)
            n += len(b)
            if n >= GATHERED:
                yield deal(held)
                held, n = [], 0
        if held:
            yield deal(held)

    return dealt


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (part, packed) sorted by part: the band rows, sorted by band within each part. A part is held in memory,
    so there have to be as many parts as the input asks for."""

    def opened(some: list[bytes]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(some), BAND)
        order = np.argsort(rows["band"])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n])[order]) for n in BAND.names], list(BAND.names))

    last, held = None, []
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if held and part != last:
                yield opened(held)
                held = []
            last = part
            held.append(packed)
    if held:
        yield opened(held)


def _bands(min_chars: int):
    seeds = hash_seeds(HASHES, 3)
    shifts = (np.arange(KEPT, dtype=np.uint64) * U64(BITS))[None, :]

    def bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SEEN, np.uint64)
        for batch in batches:
            for _, _, lines in _pieces(batch, min_chars):
                which = lines.distinct()
                slot = (lines.h1[which] & U64(SEEN - 1)).astype(np.int64)
                new = seen[slot] != lines.h1[which]
                which, slot = which[new], slot[new]
                if not len(which):
                    continue
                seen[slot] = lines.h1[which]
                keys, least = _band_keys(lines, which, seeds)
                low = (least[:, -KEPT:] & np.uint32((1 << BITS) - 1)).astype(np.uint64)
                sig = np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lines.h1[which].view(np.int64), BANDS)), pa.array(keys.ravel()), pa.array(np.repeat(sig, BANDS))], ["id", "band", "s0"])

    return bands


def _positions(min_chars: int):
    def positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, lines in _pieces(batch, min_chars):
                row = pa.array(lines.row)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j].take(row), batch.column("own")[i:j].take(row), pa.array(lines.number.astype(np.int32)), pa.array(lines.h1.view(np.int64)), pa.array(lines.h2.view(np.int64))], ["doc_id", "own", "line", "id", "id2"])

    return positions


def _parities(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line its number of distinct shingles, the level of its sketch and the sketch: to each of PARITIES bits,
    whether an odd number of its distinct shingles fall there. Where two sketches differ, so do the sets, shingle by
    shingle but for those that meet in a bit. Of lines with more than LEVEL shingles, one in 2 ** level is taken."""
    values, offs = distinct_by_row(values, offs)
    n = np.diff(offs)
    level = np.ceil(np.log2(np.maximum(n / LEVEL, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    values = mix(values)
    taken = (values >> U64(40)) & ((U64(1) << level[row].astype(np.uint64)) - U64(1)) == 0
    bit = (values[taken] & U64(PARITIES - 1)).astype(np.int64)
    row = row[taken]
    words = np.empty((len(n), PARITIES // 64), np.int64)
    for a in range(0, len(n), 256):
        i, j = np.searchsorted(row, (a, a + 256))
        some = min(256, len(n) - a)
        odd = np.bincount((row[i:j] - a) * PARITIES + bit[i:j], minlength=some * PARITIES) & 1
        words[a : a + some] = np.packbits(odd.astype(np.uint8).reshape(some, PARITIES), axis=1).view(np.int64)
    return n, level, words


def _texts(min_chars: int, bits: np.ndarray):
    """Lines that the bit map has, with the finer sketch."""
    size = U64(len(bits) * 8 - 1)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in batches:
            for _, _, lines in _pieces(batch, min_chars):
                which = lines.distinct()
                slot = (lines.h1[which] & size).astype(np.int64)
                which = which[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                which = which[[h not in had for h in lines.h1[which].tolist()]]
                had = had if len(had) < SEEN else set()
                had.update(lines.h1[which].tolist())
                if len(which):
                    n, level, words = _parities(*lines.shingles(which))
                    sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
                    line = pa.array([lines.text(i) for i in which], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(lines.h1[which].view(np.int64)), pa.array(lines.h2[which].view(np.int64)), line, pa.array(n), pa.array(level), sketch], ["id", "id2", "line", "n", "level", "sketch"])

    return texts


#: Bits of the map that spares the shuffle most lines without a candidate: a fixed 2 MB, however large the input is.
MAP_BITS = 1 << 24


def _bit_map(ids: DataFrame) -> np.ndarray:
    """One bit for each id's lowest bits, grouped by 64-bit word (so at most MAP_BITS / 64 rows come to the driver).
    With very many ids it fills up and merely spares less."""
    word = F.col("id").bitwiseAND(F.lit(MAP_BITS - 1))
    words = ids.select(F.shiftright(word, 6).alias("w"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint8)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, A-Z as a-z, and the strings' offsets."""
    data, offs = utf8(texts)
    data = FOLD[data]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), chars[offs]


def similar(x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """For each pair of strings: 100 * intersection >= percent * union of their sets of shingles. The shingles
    themselves are compared: characters are numbered, so that SHINGLE of them and the pair's number fill a word."""
    n = len(x)
    (a, a_offs), (b, b_offs) = _characters(x), _characters(y)
    both = np.concatenate([a, b])
    rank = np.zeros(int(both.max()) + 1 if len(both) else 1, np.uint64)  # by code point
    rank[both] = 1
    np.cumsum(rank, out=rank)
    bits = max(1, (int(rank[-1]) - 1).bit_length())
    if bits * SHINGLE + n.bit_length() > 64:
        if n > 1:
            return np.concatenate([similar(x[: n // 2], y[: n // 2], percent), similar(x[n // 2 :], y[n // 2 :], percent)])
        s, t = ({c[i : i + SHINGLE].tobytes() for i in range(len(c) - SHINGLE + 1)} for c in (a, b))
        return np.array([100 * len(s & t) >= percent * len(s | t)])

    def distinct(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if len(codes) < SHINGLE:
            return np.empty(0, np.uint64)
        value = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            value = (value << U64(bits)) | codes[k : k + len(value)]
        row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offs))[: len(value)]
        inside = np.arange(len(value)) + SHINGLE <= np.repeat(offs[1:], np.diff(offs))[: len(value)]
        keys = np.sort((row[inside] << U64(bits * SHINGLE)) | value[inside])
        return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys

    codes = (rank - U64(1))[both]
    x_set, y_set = distinct(codes[: len(a)], a_offs), distinct(codes[len(a) :], b_offs)
    both = np.sort(np.concatenate([x_set, y_set]))
    count = lambda keys: np.bincount((keys >> U64(bits * SHINGLE)).astype(np.int64), minlength=n)
    common = count(both[1:][both[1:] == both[:-1]])
    return common * 100 >= (count(x_set) + count(y_set) - common) * percent


def _jaccard(percent: int):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                yield batch.select(["a", "b"]).filter(pa.array(similar(batch.column("x"), batch.column("y"), percent)))

    return verify


def _agree(a: str, b: str) -> Column:
    """Minima whose low bits are equal."""
    x = F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))
    folded = x
    for shift in range(1, BITS):
        folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
    return KEPT - F.bit_count(folded.bitwiseAND(F.lit(sum(1 << (BITS * i) for i in range(KEPT)))))


def _near(a: str, b: str, percent: int) -> Column:
    """Whether a pair may be similar enough by its sketches. Sets of together s shingles at the threshold differ in
    d = s (100 - percent) / (100 + percent); d shingles in m bits leave m / 2 (1 - e^(-2d/m)) of them odd. Sketches of
    unlike levels say nothing."""
    m = float(PARITIES)
    size = [F.col(f"{x}.n") for x in (a, b)]
    most = (size[0] + size[1]) * ((100 - percent) / (100 + percent)) / F.pow(F.lit(2.0), F.col(f"{a}.level"))
    odd = (1 - F.exp(most * (-2 / m))) * (m / 2)
    e4 = F.exp(most * (-4 / m))
    # beyond level 0 the sample's size varies too
    spread = F.sqrt((1 - e4) * (m / 4) - F.when(F.col(f"{a}.level") == 0, most * e4).otherwise(0.0))
    differ = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    close = F.least(*size) * 100 >= F.greatest(*size) * percent
    return close & ((F.col(f"{a}.level") != F.col(f"{b}.level")) | (differ <= odd + spread * ERRORS + 3))


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (band, id, s0) sorted by band: the lines of each bucket of several, with the bucket's first line here and the
    one before by id. A batch gives a line of a bucket once; a bucket that spans batches may give it again. Between
    batches only one line of the last bucket, its first line and whether it has been given out are kept."""
    last = None  # band, id, s0, first, whether it still waits for a second line of its bucket
    schema = ["band", "id", "s0", "first", "prev"]
    for batch in batches:
        band, id_, s0 = (batch.column(c).to_numpy() for c in ("band", "id", "s0"))
        if last:
            band, id_, s0 = (np.concatenate([[x], y]) for x, y in zip(last[:3], (band, id_, s0), strict=True))
        if not len(band):
            continue
        edge = np.concatenate([[True], band[1:] != band[:-1], [True]])
        # most buckets are one row; of these only the batch's first and last can go on
        use = ~(edge[1:] & edge[:-1])
        use[0] = use[-1] = True
        band, id_, s0 = band[use], id_[use], s0[use]
        order = np.lexsort((id_, np.cumsum(np.concatenate([[True], band[1:] != band[:-1]]))))
        band, id_, s0 = band[order], id_[order], s0[order]
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (id_[1:] != id_[:-1])])
        band, id_, s0 = band[new], id_[new], s0[new]
        start = np.concatenate([[True], band[1:] != band[:-1]])
        bucket = np.cumsum(start) - 1
        first = id_[start][bucket]
        prev = np.concatenate([id_[:1], id_[:-1]])
        size = np.bincount(bucket)
        several = (size > 1)[bucket]
        if last:
            first[bucket == 0] = last[3]
            if not last[4]:  # given out before
                several &= (bucket != 0) | (id_ != last[1])
        waits = bool(size[-1] == 1 and (len(size) > 1 or not last or last[4]))
        if several.any():
            some = [pa.array(x[several]) for x in (band, id_, s0, first)]
            yield pa.RecordBatch.from_arrays([*some, pa.array(prev[several], mask=start[several])], schema)
        last = (band[-1], id_[-1], s0[-1], first[-1], waits)


def line_classes(scratch: Scratch, docs: DataFrame, min_chars: int = MIN_CHARS, percent: int = PERCENT) -> DataFrame:
    """(id, id2, component) of the lines that are linked to a line with another text; id and id2 are their identity, and
    component is the smallest id."""
    texts = pick(docs, "doc_id", "text")
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = texts.select("text").mapInArrow(_dealt(parts, _bands(min_chars)), "part int, packed binary")
    keys = keys.repartition("part").sortWithinPartitions("part")
    members = scratch.table(keys.mapInArrow(lambda batches: _walk(_opened(batches)), "band long, id long, s0 long, first long, prev long"), "members")
    # lines that agree enough with another one of a bucket
    x, y = members.alias("x"), members.select("band", "id", "s0").alias("y")
    some = x.join(y.hint("merge"), (F.col("x.band") == F.col("y.band")) & (F.col("x.id") != F.col("y.id")) & (_agree("x.", "y.") >= AGREE), "left_semi")
    some = scratch.table(some, "some")
    found = scratch.table(_lines(texts, some.select("id"), min_chars), "found")
    sketch = found.select("id", "n", "level", "sketch")

    later = some.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("first", "prev"))).alias("b")).where("b is not null and a <> b").distinct()
    pairs = _with(_with(later, sketch, "a", "x"), sketch, "b", "y").where(_near("x", "y", percent)).select("a", "b")
    links = scratch.table(_verified(pairs, found, percent), "links")
    labels = scratch.table(components(scratch, links, "cc1"), "labels1")

    known = some.join(labels.hint("merge"), "id", "left").select("band", "id", "s0", "first", F.coalesce("component", "id").alias("part"))
    open_ = known.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("band", F.col("least").alias("head"))
    open_ = scratch.table(known.join(open_.hint("merge"), "band").select("band", "id", "s0", "part", "head").distinct(), "open")
    if not open_.isEmpty():
        bands = open_.groupBy("id").agg(F.sort_array(F.collect_list("band")).alias("bands"))  # BANDS at most
        placed = open_.join(sketch.hint("merge"), "id").join(bands.hint("merge"), "id")
        strays, rest = placed.where("part <> head").alias("x"), placed.alias("y")
        meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.part") != F.col("y.part")) & (_agree("x.", "y.") >= AGREE)
        meet = meet & ((F.col("y.part") == F.col("y.head")) | (F.col("x.id") < F.col("y.id"))) & _near("x", "y", percent)
        once = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.band")
        more = strays.join(rest.hint("merge"), meet & once).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
        more = scratch.table(_verified(more, found, percent), "more")
        if not more.isEmpty():
            labels = scratch.table(joined_components(scratch, labels, more, "cc2"), "labels2")
    return labels.join(found.select("id", "id2").hint("merge"), "id")


def _with(pairs: DataFrame, sketch: DataFrame, end: str, name: str) -> DataFrame:
    """pairs with the columns of one end as a struct."""
    held = sketch.select(F.col("id").alias(end), F.struct("n", "level", "sketch").alias(name))
    return pairs.join(held.hint("merge"), end)


def _lines(texts: DataFrame, ids: DataFrame, min_chars: int) -> DataFrame:
    """(id, id2, line, n, level, sketch) of the lines with those ids, read again from the texts."""
    ids = ids.distinct()
    lines = texts.select("text").mapInArrow(_texts(min_chars, _bit_map(ids)), "id long, id2 long, line string, n long, level long, sketch array<long>")
    # of lines that share 64 bits, the one with the least other 64 stands for them; the others keep to equality
    found = lines.join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("id2").alias("id2"), F.min_by(F.struct("line", "n", "level", "sketch"), "id2").alias("r"))
    return found.select("id", "id2", "r.*")


def _verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    x = lines.select(F.col("id").alias("a"), F.col("line").alias("x"))
    y = lines.select(F.col("id").alias("b"), F.col("line").alias("y"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_jaccard(percent), "a long, b long")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines with those numbers; null where there is nothing to do."""

    def rest(text: str | None, numbers: np.ndarray | None) -> str | None:
        if text is None or numbers is None:
            return None
        out = set(numbers.tolist())
        return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in out])

    return pd.Series([rest(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, percent: int = PERCENT) -> DataFrame:
    """docs with only the lines that stay in `text`, and _n_lines and _n_dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    labels = line_classes(scratch, docs, min_chars, percent)
    texts = pick(docs, "doc_id", "text").withColumn("own", F.xxhash64("text"))  # doc_id and own tell documents apart
    places = texts.mapInArrow(_positions(min_chars), "doc_id long, own long, line int, id long, id2 long")
    placed = places.join(labels.hint("merge"), ["id", "id2"], "left").select("doc_id", "own", "line", F.coalesce("component", "id").alias("class"), F.when(F.col("component").isNull(), F.col("id2")).alias("class2"))
    placed = scratch.table(placed, "places")
    kept = placed.groupBy("class", "class2").agg(F.min(F.struct("doc_id", "own", "line")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    same = placed["class"].eqNullSafe(kept["class"]) & placed["class2"].eqNullSafe(kept["class2"])
    gone = placed.join(kept.hint("merge"), same).where("doc_id is distinct from keep.doc_id or own <> keep.own or line <> keep.line")
    gone = scratch.table(gone.groupBy(F.col("doc_id").alias("_doc_id"), F.col("own").alias("_own")).agg(F.collect_set("line").alias("_gone")), "gone")
    joined = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.xxhash64(docs["text"]) == F.col("_own")), "left")
    left = F.coalesce(_without(F.when(F.col("_gone").isNotNull(), docs["text"]), "_gone"), docs["text"])
    text = F.coalesce(docs["text"], F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(*[left.alias(c) if c == "text" else docs[c] for c in docs.columns], n_lines.alias("_n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("_n_dropped"))
