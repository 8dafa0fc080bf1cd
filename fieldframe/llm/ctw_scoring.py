"""Language-model scores by context-tree weighting over bytes.

The model. A text is its bytes with A-Z as a-z and one end byte (FF, which UTF-8 never has); FF stands for what precedes
it. Each byte is eight binary decisions, and each decision has a node in the context tree of every depth from 0 to
`DEPTH` bytes. A node's Krichevsky-Trofimov estimate P_e and its children's weighted probabilities are mixed half and
half, P_w = (P_e + product of children's P_w) / 2, from the deepest nodes up. A decision's probability then is, from the
deepest node of its context up, beta * KT + (1 - beta) * deeper, with beta = P_e / (2 P_w); contexts without training
data have 1/2. Counts come from the training texts alone and do not change while texts are scored, so a byte's code
length depends on nothing but its DEPTH + 1 bytes: the model is a table over them.

How it is computed. Texts are dealt to blocks of bounded size by hash. Each block gives its distinct byte grams and words
with their training counts, so what is gathered follows the input. Grams are dealt by their two most recent context
bytes, a subtree each; one pass sends the weighted probabilities of those subtrees' roots (at most 256 x 256 x 255) up
to the depths 0 and 1, a second one computes every gram's code length. Lengths and word counts go back to the blocks
that asked for them, a compressed row for each block and subtree, and whole texts are scored there. A task holds a block,
or a subtree with the rows of all blocks that asked for it; nothing that grows with the input is broadcast.

Word tokens, for the base score, are runs of non-white-space; their identity is a 64-bit hash.

Cases: null counts as empty, which is one end token; texts are scored whole; repeated rows get equal scores and count as
often as they occur; rows without a training text score everything by chance; a null doc_id is in training; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, U64, Scratch, pick, pieces, span_hashes, utf8, word_spans

DEPTH = 5
#: Bytes of text in a block, about.
BLOCK = 20 << 20
END = 0xFF
LN2 = math.log(2)


# ---------------------------------------------------------------- texts to grams and words


def grams(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all predicted bytes (most recent context byte first, the byte itself last) and offsets by text. A text
    of n bytes has n + 1 codes, the last one for the end."""
    n = len(offs) - 1
    size = np.diff(offs)
    first = depth + offs[:-1] + depth * np.arange(n)  # between texts: the end and depth - 1 more
    x = np.full(depth + offs[-1] + depth * n, END, np.uint8)
    x[np.arange(offs[-1]) + np.repeat(first - offs[:-1], size)] = FOLD[data]
    out = np.empty(offs[-1] + n, np.uint64)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    places = np.arange(len(out)) + np.repeat(first - at[:-1], size + 1)
    codes = np.zeros(len(x) - depth, np.uint64)
    for d in range(1, depth + 1):
        codes |= x[depth - d : len(x) - d].astype(np.uint64) << U64(8 * (depth - d + 1))
    codes |= x[depth:]
    out[:] = codes[places - depth]
    return out, at


def tally(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the sums of their weights."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[new], np.add.reduceat(weights[order], new) if len(new) else np.empty(0, np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[new], np.diff(np.append(new, len(values)))


class _Tally:
    """Sums by key, merged whenever twice as much has come as was left the last time."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, 1 << 19

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > self.limit:
            self.merge()
            self.limit = max(1 << 19, 2 * self.size)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            none = (np.empty(0, np.uint64), np.empty(0, np.int64))
            self.parts = [tally(*(np.concatenate(x) for x in zip(none, *self.parts, strict=True)))]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def _ask(depth: int):
    def ask(table: pa.Table) -> pa.Table:
        """The block's distinct grams (kind 0) and words (kind 1) with training counts."""
        found = (_Tally(), _Tally())
        train = np.asarray(table["train"].combine_chunks())
        data, offs = utf8(table["text"])
        for i, j in pieces(offs):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, first = word_spans(part, at)
            for kind, (values, ends_at) in enumerate((grams(part, at, depth), (span_hashes(FOLD[part], starts, ends), first))):
                mine = np.repeat(train[i:j], np.diff(ends_at))
                for own, weight in ((mine, 1), (~mine, 0)):
                    keys, n = _distinct(values[own])
                    found[kind].add(keys, n * weight)
        out = []
        for kind, x in enumerate(found):
            keys, n = x.merge()
            out.append(pa.table({"kind": pa.array(np.full(len(keys), kind, np.int8)), "key": keys.view(np.int64), "n": pa.array(n, pa.int64())}))
        whole = pa.concat_tables(out)
        return whole.append_column("block", pa.array(np.full(len(whole), table["block"][0].as_py(), np.int64)))

    return ask


# ---------------------------------------------------------------- values on their way back to the blocks

PACKED = "block long, kind byte, size long, keys binary, vals binary, distinct long"
_zstd = pa.Codec("zstd", 1)


def _packed(blocks: np.ndarray, kind: int, keys: np.ndarray, values: np.ndarray, distinct: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its sorted keys as differences, and their values, both compressed. distinct stands in the
    first row alone, to be summed."""
    order = np.argsort(blocks, kind="stable")
    blocks, keys, values = blocks[order], keys[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else np.zeros(1, np.int64)
    cols: list[list] = [[], [], [], [], [], []]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        step = np.diff(keys[a:b], prepend=U64(0))
        row = (int(blocks[a]), kind, b - a, _zstd.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T), asbytes=True), _zstd.compress(np.ascontiguousarray(values[a:b]), asbytes=True), 0 if a else distinct)
        for col, x in zip(cols, row, strict=True):
            col.append(x)
    types = [pa.int64(), pa.int8(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["block", "kind", "size", "keys", "vals", "distinct"])


def _unpacked(model: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    keys, values = [np.empty(0, np.uint64)], [np.empty(0)]
    for k, n, a, b in zip(*(model[c].to_pylist() for c in ("kind", "size", "keys", "vals")), strict=True):
        if k == kind:
            step = np.frombuffer(_zstd.decompress(a, 8 * n), np.uint8).reshape(8, -1).T
            keys.append(np.cumsum(np.ascontiguousarray(step).view(np.uint64).ravel(), dtype=np.uint64))
            values.append(np.frombuffer(_zstd.decompress(b, 8 * n), np.float64))
    return np.concatenate(keys), np.concatenate(values)


# ---------------------------------------------------------------- the tree


_SMALL = 1 << 12
_HALF = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])
_WHOLE = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def _lgamma(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    big = n >= _SMALL
    if big.any():
        x = n[big] + more
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return _lgamma(zeros, _HALF, 0.5) + _lgamma(ones, _HALF, 0.5) - _lgamma(zeros + ones, _WHOLE, 1.0) - math.log(math.pi)


class Subtrees:
    """Nodes of depth `low` to `depth` over sorted distinct grams with counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, low: int = 2):
        self.depth, self.low = depth, low
        self.codes, self.counts, self.parents = {depth: keys}, {depth: n}, {}
        self.rows = {depth: np.arange(len(keys))}
        for d in range(depth - 1, low - 1, -1):
            above = self.codes[d + 1]
            code = ((above >> U64(16)) << U64(8)) | (above & U64(255))
            order = np.argsort(code, kind="stable")
            new = np.concatenate([[True], code[order][1:] != code[order][:-1]])
            place = np.empty(len(code), np.int64)
            place[order] = np.cumsum(new) - 1
            self.codes[d] = code[order][new]
            self.counts[d] = np.add.reduceat(self.counts[d + 1][order], np.flatnonzero(new))
            self.parents[d + 1] = place
            self.rows[d] = place[self.rows[d + 1]]

    def level(self, j: int) -> dict[int, tuple]:
        """For each depth: each code's node of the j-th decision, and the nodes' zeros, ones, log P_e and log P_w."""
        out: dict[int, tuple] = {}
        for d in range(self.depth, self.low - 1, -1):
            code, n = self.codes[d], self.counts[d]
            node = code >> U64(8 - j)
            new = np.concatenate([[True], node[1:] != node[:-1]])
            first = np.flatnonzero(new)
            index = np.cumsum(new) - 1
            bit = ((code >> U64(7 - j)) & U64(1)).astype(np.int64)
            total = np.add.reduceat(n, first)
            ones = np.add.reduceat(n * bit, first)
            pe = log_kt(total - ones, ones)
            pw = pe
            if d < self.depth:
                below_first, below_pw = out[d + 1][5], out[d + 1][4]
                to = index[self.parents[d + 1][below_first]]
                pw = np.logaddexp(pe, np.bincount(to, below_pw, len(first))) - LN2
            out[d] = (index, total, ones, pe, pw, first)
        return out


class Top:
    """Depths 0 and 1, from the sums over the roots of all subtrees: by most recent byte and decision."""

    def __init__(self, byte: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, pw: np.ndarray):
        z, o, below = (np.zeros((256, 256)) for _ in range(3))
        z[byte, node], o[byte, node], below[byte, node] = zeros, ones, pw
        self.beta1, self.one1, w1 = self._mix(z, o, below)
        self.beta0, self.one0, _ = self._mix(z.sum(0), o.sum(0), w1.sum(0))

    @staticmethod
    def _mix(z: np.ndarray, o: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pe = log_kt(z.astype(np.int64), o.astype(np.int64))
        pw = np.logaddexp(pe, below) - LN2
        return np.exp(pe - LN2 - pw), (o + 0.5) / (z + o + 1), pw


def log10_of_grams(keys: np.ndarray, n: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """log10 P(byte | context) of each of the sorted distinct grams."""
    tree = Subtrees(keys, n, depth)
    byte = (keys & U64(255)).astype(np.int64)
    recent = (keys >> U64(8 * depth)).astype(np.int64)
    out = np.zeros(len(keys))
    for j in range(8):
        nodes = tree.level(j)
        bit = (byte >> (7 - j)) & 1 == 1
        of = lambda one: np.where(bit, one, 1 - one)  # noqa: E731, B023
        p = None
        for d in range(depth, 1, -1):
            index, total, ones, pe, pw, _ = nodes[d]
            at = index[tree.rows[d]]
            kt = of(((ones + 0.5) / (total + 1))[at])
            beta = np.exp(pe - LN2 - pw)[at]
            p = kt if p is None else beta * kt + (1 - beta) * p
        node = (1 << j) | (byte >> (8 - j))
        for beta, one in ((top.beta1[recent, node], top.one1[recent, node]), (top.beta0[node], top.one0[node])):
            p = beta * of(one) + (1 - beta) * p
        out += np.log10(p)
    return out


def _by_subtree(batches: Iterable[pa.RecordBatch], depth: int, rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Whole subtrees (two context bytes) of a partition sorted by key, several at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    shift = U64(8 * (depth - 1))
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        roots = np.asarray(table["key"].combine_chunks()).view(np.uint64) >> shift
        other = np.flatnonzero(roots != roots[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, size = rest.to_batches(), 0 if cut == 0 else len(rest)  # a subtree larger than that: look again later
    if held:
        yield pa.Table.from_batches(held)


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.asarray(table["key"].combine_chunks()).view(np.uint64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    n = np.add.reduceat(np.asarray(table["n"].combine_chunks()), np.flatnonzero(new))
    return keys[new], n, np.cumsum(new) - 1


def _roots(depth: int):
    def roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_subtree(batches, depth):
            keys, n, _ = _counted(table)
            tree = Subtrees(keys, n, depth)
            for j in range(8):
                index, total, ones, _, pw, first = tree.level(j)[2]
                code = tree.codes[2][first]
                byte = (code & U64(255)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((code >> U64(16)).astype(np.int32)), pa.array(((1 << j) | (byte >> (8 - j))).astype(np.int32)), pa.array(total - ones), pa.array(ones), pa.array(pw)], ["byte", "node", "zeros", "ones", "pw"])

    return roots


def _lengths(depth: int, top: Top):
    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_subtree(batches, depth):
            keys, n, row = _counted(table)
            value = log10_of_grams(keys, n, depth, top)
            yield from _packed(np.asarray(table["block"].combine_chunks()), 0, keys[row], value[row], 0)

    return lengths


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' training counts over all blocks, from rows sorted by key."""
    for table in _by_subtree(batches, 1):
        keys, n, row = _counted(table)
        yield from _packed(np.asarray(table["block"].combine_chunks()), 1, keys[row], n[row].astype(np.float64), int((n > 0).sum()))


# ---------------------------------------------------------------- scoring


class Lookup:
    """Values by key: a direct-mapped table, and binary search for what collides."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        at = self.table[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]


def _score(depth: int, tokens: int, words: int, ends: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(docs: pa.Table, model: pa.Table) -> pa.Table:
        look = [Lookup(*_unpacked(model, k)) for k in (0, 1)]
        data, offs = utf8(docs["text"])
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        rest = math.log10(tokens + words + 1)
        end = math.log10(ends + 1) - rest
        for i, j in pieces(offs):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, stops, first = word_spans(part, at)
            count = look[1](span_hashes(FOLD[part], starts, stops))
            sums = lambda x, o: np.diff(np.concatenate([[0], np.cumsum(x)])[o])
            out["n_tokens"].append(np.diff(first) + 1)
            out["n_known"].append(sums(count > 0, first).astype(np.int64) + (ends > 0))
            out["base_score"].append(sums(np.log10(count + 1) - rest, first) + end)
            codes, at = grams(part, at, depth)
            out["score"].append(np.add.reduceat(look[0](codes), at[:-1]))
        cols = {k: pa.array(np.concatenate(v)) for k, v in out.items()}
        size = np.diff(offs)
        bits = -np.concatenate(out["score"]) * math.log2(10) / (size + 1)
        return pa.table({"doc_id": docs["doc_id"], "train": docs["train"], **cols, "n_bytes": pa.array(size), "bits_per_byte": pa.array(bits)})

    return score


def ctw_scores(docs: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row of
    docs(doc_id, text); rows whose crc32(doc_id) mod 7 is 2 are held out of training."""
    scratch = Scratch(docs.sparkSession, "ctw")
    texts = pick(docs, "doc_id", "text").withColumn("train", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True)))
    size, ends = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(F.col("train"))).first()
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(size / block)))))
    asked = scratch.table(texts.groupBy("block").applyInArrow(_ask(depth), "kind byte, key long, n long, block long"), "asked", compression="zstd")

    mine = asked.where("kind = 0").select("block", "key", "n").repartition(F.shiftright("key", 8 * (depth - 1))).sortWithinPartitions("key")
    roots = mine.mapInArrow(_roots(depth), "byte int, node int, zeros long, ones long, pw double")
    roots = roots.groupBy("byte", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("pw"))
    top = scratch.table(roots, "roots").toArrow()  # at most 256 x 255 rows
    top = Top(*[top[c].to_numpy() for c in ("byte", "node", "zeros", "ones", "pw")])
    lengths = scratch.table(mine.mapInArrow(_lengths(depth, top), PACKED), "lengths")

    words = asked.where("kind = 1").select("block", "key", "n")
    counts = scratch.table(words.repartition("key").sortWithinPartitions("key").mapInArrow(_counts, PACKED), "counts")
    tokens = asked.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + ends
    distinct = counts.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] + (ends > 0)
    scratch.drop("asked")

    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double"
    model = lengths.unionAll(counts)
    scored = texts.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(_score(depth, tokens, distinct, ends), schema)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", "bits_per_byte")
