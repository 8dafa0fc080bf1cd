"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numbers (shares of character classes, of repeated words, of repeated word triples, word and
sentence lengths), each cut into bins. Cyclic boosting fits, feature by feature in turn, shallow trees over the bins
against the logistic loss; their sum is one lookup table a feature. The pairs of features whose binned residuals gain
most then get tables of their own in the same way. A score is the logistic function of an intercept and the bins' table
entries, added up for whole batches at a time.

The model is fitted on the driver from the features (not the texts) of at most `MAX_TRAIN` labelled rows, those with the
smallest hash of doc_id; features and scores cover every row and whole texts. labels, lang, source and doc_id are never
inputs.

Cases: null and empty texts have all-zero features and a score as any other; labels without a quality, or for documents
that don't exist, are ignored, and of several labels of a document the largest counts; without labels of both classes
every score is the share of label 1 (0.5 without any); repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, Scratch, distinct_by_row, pick, pieces, shingle_hashes, span_hashes, utf8, word_spans

#: Labelled rows that the fit takes at most.
MAX_TRAIN = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6

NAMES = ("log_bytes", "upper", "digit", "mark", "symbol", "space", "line_end", "bar", "high", "word_length", "repeat_next", "unique_words", "unique_triples", "capital_words", "stop_words", "line_length")

_CLASS = np.zeros(256, np.int64)  # 0: letters and all else
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 3
_CLASS[[ord(c) for c in "!#$%&*@^~+=<>[]{}\\/_`"]] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_CLASS[10] = 6
_CLASS[ord("|")] = 7
_CLASS[128:] = 8


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of numbers for each text."""
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(offs).astype(float)
    some = np.maximum(size, 1)
    kinds = _CLASS[data]
    counts = np.bincount(np.repeat(np.arange(n), np.diff(offs)) * 9 + kinds, minlength=9 * n).reshape(n, 9)
    # capitals of the two-byte Latin letters: C3 80 to C3 9E
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
        counts[:, 1] += np.bincount(np.searchsorted(offs, wide, "right") - 1, minlength=n)[:n]
    out[:, 0] = np.log1p(size)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 8] / 2, 1)
    out[:, 1] = counts[:, 1] / letters
    for c in range(2, 9):
        out[:, c] = counts[:, c] / some
    starts, ends, first = word_spans(data, offs)
    words = np.diff(first)
    has = words > 0
    per = np.maximum(words, 1)
    hashes = span_hashes(FOLD[data], starts, ends)
    length = (ends - starts).astype(float)
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[first])
    out[:, 9] = sums(length) / per
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = hashes[1:] == hashes[:-1]
        same[first[:-1][has]] = 0
    out[:, 10] = sums(same) / per
    _, unique = distinct_by_row(hashes, first)
    out[:, 11] = np.where(has, np.diff(unique) / per, 0)
    triples, at = shingle_hashes(hashes, first, 3)
    _, unique = distinct_by_row(triples, at)
    out[:, 12] = np.where(has, np.diff(unique) / np.maximum(np.diff(at), 1), 0)
    initial = data[starts] if len(starts) else np.empty(0, np.uint8)
    out[:, 13] = sums((initial >= 65) & (initial <= 90)) / per
    out[:, 14] = sums(length <= 3) / per
    out[:, 15] = np.log1p(size / (counts[:, 6] + 1))
    return out


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        for i, j in pieces(offs):
            x = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *[pa.array(x[:, c]) for c in range(x.shape[1])]], ["doc_id", *[f"x{c}" for c in range(x.shape[1])]])


# ---------------------------------------------------------------- the model


@dataclass
class Gam:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)  # for each feature, the pair bin of each bin
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for f, g, table in self.pairs:
            total += table[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    return g * g / (h + penalty)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of the tree with at most `leaves` intervals of bins, split greedily by gain."""
    cells = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cells) < leaves:
        best = (1e-9, -1, 0)
        for k, (a, b) in enumerate(cells):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = _gain(cg[m] - cg[a], ch[m] - ch[a]) + _gain(cg[b] - cg[m], ch[b] - ch[m]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                best = max(best, (float(gain.max()), k, int(m[gain.argmax()])))
        if best[1] < 0:
            break
        a, b = cells.pop(best[1])
        cells += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in cells:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best cut of one axis, then the best cut of the other in each half: four rectangles of a grid."""
    best, out = -1.0, np.zeros_like(g)
    for gg, hh, turn in ((g, h, False), (g.T, h.T, True)):
        for m in range(1, len(gg)):
            found, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, m), slice(m, None)):
                step = shallow_tree(gg[rows].sum(0), hh[rows].sum(0), 2)
                gain += float((step * gg[rows].sum(0)).sum())
                found[rows] = step
            if gain > best:
                best, out = gain, found.T if turn else found
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, rate: float = 0.15) -> Gam:
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        return Gam(math.log(share / (1 - share)), [], [])
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))), cuts, [np.zeros(len(c) + 1) for c in cuts])
    b = model.bins(x)
    margin = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)))
            table += step
            margin += step[b[:, f]]
    model.coarse = [np.arange(len(t)) * PAIR_BINS // max(len(t), 1) for t in model.tables]
    c = [model.coarse[f][b[:, f]] for f in range(x.shape[1])]
    grid = lambda v, f, k: np.bincount(c[f] * PAIR_BINS + c[k], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = sorted(((float((pair_tree(gg := grid(g, f, k), grid(h, f, k)) * gg).sum()), f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k, np.zeros((PAIR_BINS, PAIR_BINS))) for _, f, k in gains[:PAIRS]]
    for _ in range(pair_rounds):
        for f, k, table in model.pairs:
            g, h = slopes()
            step = rate * pair_tree(grid(g, f, k), grid(h, f, k))
            table += step
            margin += step[c[f], c[k]]
    return model


# ---------------------------------------------------------------- the operator


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text), learnt from labels(doc_id, quality)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    cols = [f"x{c}" for c in range(len(NAMES))]
    rows = scratch.table(pick(docs, "doc_id", "text").mapInArrow(_features, "doc_id long, " + ", ".join(f"{c} double" for c in cols)), "features")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held)
    train = known.join(rows, "doc_id").orderBy(F.xxhash64("doc_id"), *cols).limit(max_train).select("quality", *cols).toArrow()  # bounded by max_train
    x = np.stack([train[c].to_numpy() for c in cols], 1) if len(train) else np.zeros((0, len(cols)))
    model = fit(x, (train["quality"].to_numpy() > 0).astype(float))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
