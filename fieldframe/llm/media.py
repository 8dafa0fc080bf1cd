"""Copies of images by local descriptors.

1. Corners (Harris measure, local maxima) of each image at every half octave down to the smallest usable size; at each,
   an orientation from the intensity centroid and 256 binary tests turned by it.
2. Images with equal bytes are one class; only its smallest id goes on.
3. Hamming tables: each 32-bit word of a descriptor is a key, and so are two runs of 64 bits and one of 192. Rows of
   (key, image, place of the corner) are sorted by key and read as a stream. All images that share a key meet, as long
   as they are `RARE` at most. In a key that more images share, such as a flat edge or a logo, each image meets the one
   before it at first, so a large family of copies hangs together without its pairs being written out; step 7 does the rest.
4. Two corners that meet say how their images lie to each other (turn, scale, shift). These votes are binned, turn and
   both coordinates each in two overlapping grids, and a pair of images goes on when `MEET` of them agree.
5. Geometric consensus over all corners of such a pair: corners match when they are within `NEAR` of 256 bits and each
   other's nearest (common patches are within `NEAR` of much that is unrelated; ties all count). Two images are linked
   when `VOTES` different corners agree, a similarity fitted to them holds, and the images, shrunk and laid over each
   other by it, correlate.
6. Links give components by distributed large-star and small-star steps; the smallest id of each stays.
7. Of the images that have a key which more than `RARE` share, every two of different components are compared, whatever
   keys they share: a group of images with another group at a time, all corners with all corners. Most pairs end where no
   bin of step 5 gets VOTES matches, by distances that are products of matrices. Its price grows with the square of the
   number of such images.

Steps 3 to 5 and 7 go in rounds (over tables, over pairs by hash, over tiles), so that what lies on disk at a time stays a
few times the descriptors. A copy is missed where all keys of one of the two are rare and fewer than MEET of its corners
share one with the original in one way.

An image is raw 8-bit grey: `image` has height * width bytes.

Cases: images that are null, empty, too small for a corner's surroundings or of a wrong length have no descriptors and
are linked only with equal bytes (null and empty ones with nothing); flat images have no corners; equal measures are all
corners; repeated rows are copies; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, components, joined_components, mix, pick

RADIUS = 7
TESTS = 256
TURNS = 36
NEAR = 48
VOTES = 5
#: Images that may share a key and all meet; votes that let two images be compared.
RARE, MEET = 8, 2
#: Rounds in which the votes are sorted.
ROUNDS = 3
#: Pairs of corners that are compared at a time.
BLOCK = 1 << 16
#: Corners that are compared with each other at a time in the exact pass, and of the largest image there.
COLUMNS, ROWS, LARGE = 3072, 512, 4096
#: Corners of a group of images that is compared with other groups, and how often a round moves each image.
TILE, SPREAD = 1 << 14, 8
#: Side of the shrunk image, and how images have to correlate where they overlap.
SMALL, ALIKE = 40, 0.6
FIT = 2
SHARE = 0.15
_rng = np.random.default_rng(77)
_POINTS = np.clip(_rng.normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS + 2, RADIUS - 2)
_ANGLES = np.arange(TURNS) * (2 * np.pi / TURNS)
_TURN = np.stack([np.stack([np.cos(_ANGLES), -np.sin(_ANGLES)], 1), np.stack([np.sin(_ANGLES), np.cos(_ANGLES)], 1)], 1)
#: For each turn, test and end: row and column.
_PATTERN = np.rint(np.einsum("tij,npj->tnpi", _TURN, _POINTS)).astype(np.int64)
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = _Y**2 + _X**2 <= RADIUS**2


def _blur(x: np.ndarray) -> np.ndarray:
    """1-2-1 in both directions over a stack of images; edges repeat."""
    for axis in (1, 2):
        p = np.pad(x, [(0, 0), (int(axis == 1),) * 2, (int(axis == 2),) * 2], "edge")
        n = x.shape[axis]
        cut = lambda a: p[:, a : a + n] if axis == 1 else p[:, :, a : a + n]  # noqa: E731, B023
        x = (cut(0) + 2 * cut(1) + cut(2)) / 4
    return x


def corners(x: np.ndarray) -> np.ndarray:
    """(image, row, column) of Harris maxima at least RADIUS from the edge."""
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = (_blur(_blur(p)) for p in (gx * gx, gy * gy, gx * gy))
    r = a * b - c * c - 0.05 * (a + b) ** 2
    inner = r[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
    best = np.ones(inner.shape, bool)
    h, w = inner.shape[1:]
    for dy in (-2, -1, 0, 1, 2):
        for dx in (-2, -1, 0, 1, 2):
            if dy or dx:
                best &= inner >= r[:, RADIUS + dy : RADIUS + dy + h, RADIUS + dx : RADIUS + dx + w]
    best &= inner > np.maximum(0.002 * r.max(axis=(1, 2), keepdims=True), 1e-3)
    return np.argwhere(best) + np.array([0, RADIUS, RADIUS])


def describe(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For images of one size: image number, place and scale of each corner (n x 3: row, column in the first scale's
    pixels, scale), orientation in turns, and descriptors (n x 8 uint32)."""
    images, places, turns, words = [], [], [], []
    x = stack.astype(np.float64)
    for s in count():
        factor = 0.7071**s
        if s:
            h, w = int(stack.shape[1] * factor), int(stack.shape[2] * factor)
            if min(h, w) < 2 * RADIUS + 3:
                break
            x = _resize(_blur(stack.astype(np.float64)), h, w)
        if min(x.shape[1:]) < 2 * RADIUS + 3:
            break
        at = corners(x)
        if not len(at):
            continue
        smooth = _blur(x)
        i, r, c = at.T
        patch = smooth[i[:, None, None], r[:, None, None] + _Y, c[:, None, None] + _X] * _DISC
        angle = np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        p = _PATTERN[(-turn) % TURNS]  # rows turn against columns
        v = smooth[i[:, None, None], r[:, None, None] + p[..., 0], c[:, None, None] + p[..., 1]]
        bits = v[..., 0] < v[..., 1]
        words.append(np.packbits(bits, axis=1).view(">u4").astype(np.uint32))
        images.append(i)
        places.append(np.stack([r / factor, c / factor, np.full(len(r), s)], 1))
        turns.append(angle / (2 * np.pi) * 360)
    if not images:
        return np.empty(0, np.int64), np.empty((0, 3)), np.empty(0), np.empty((0, 8), np.uint32)
    return np.concatenate(images), np.concatenate(places), np.concatenate(turns), np.concatenate(words)


def _resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    rows = np.clip((np.arange(h) + 0.5) * x.shape[1] / h - 0.5, 0, x.shape[1] - 1.001)
    cols = np.clip((np.arange(w) + 0.5) * x.shape[2] / w - 0.5, 0, x.shape[2] - 1.001)
    r, c = rows.astype(int), cols.astype(int)
    fr, fc = (rows - r)[None, :, None], (cols - c)[None, None, :]
    top = x[:, r][:, :, c] * (1 - fc) + x[:, r][:, :, c + 1] * fc
    low = x[:, r + 1][:, :, c] * (1 - fc) + x[:, r + 1][:, :, c + 1] * fc
    return top * (1 - fr) + low * fr


#: A corner as it is moved: place and scale, orientation in degrees, descriptor.
CORNER = np.dtype([("place", "<f4", 3), ("turn", "<f4"), ("word", "<u8", 4)])
#: Tables: which 32-bit words of the descriptor make the key, by round.
TABLES = (((0,), (2,), (4,), (6,)), ((1,), (3,), (5,), (7,)), ((0, 1), (4, 5), (0, 1, 2, 3, 4, 5)))


def _keys(words: np.ndarray, tables: tuple = sum(TABLES, ())) -> np.ndarray:
    """Keys of corners (n x tables): hashes of the table and its words."""
    out = np.empty((len(words), len(tables)), np.uint64)
    for k, cols in enumerate(tables):
        x = np.full(len(words), len(cols) * 8 + cols[0] + 1, np.uint64)
        for c in cols:
            x = mix(x * U64(0x9E3779B97F4A7C15) + words[:, c])
        out[:, k] = x
    return out


def _key_rows(tables: tuple):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], []]
            for id_, raw in zip(batch.column("id").to_pylist(), batch.column("corners").to_pylist(), strict=True):
                c = np.frombuffer(raw, CORNER)
                keys, at = np.unique(_keys(np.ascontiguousarray(c["word"]).view(np.uint32), tables), return_index=True)
                c = c[at // len(tables)]
                # half pixels, degrees, scale
                y, x = (np.clip(np.rint(c["place"][:, k] * 2), 0, 0xFFFF).astype(np.int64) for k in (0, 1))
                place = (y << 30) | (x << 14) | (np.rint(c["turn"]).astype(np.int64) % 360 << 5) | c["place"][:, 2].astype(np.int64)
                for col, v in zip(found, (keys.view(np.int64), np.full(len(keys), id_, np.int64), place), strict=True):
                    col.append(v)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in found], ["key", "id", "place"])

    return rows


def _votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How b's image lies to a's by two packed places: scale, turn, and where b's origin comes to lie, packed."""
    (ya, xa, ta, sa), (yb, xb, tb, sb) = ((p >> 30, (p >> 14) & 0xFFFF, (p >> 5) & 0x1FF, p & 0x1F) for p in (a, b))
    turn, scale = (ta - tb) % 360, sb - sa
    z = (xa + 1j * ya) - 0.7071**scale * np.exp(1j * np.radians(turn)) * (xb + 1j * yb)
    x, y = (np.clip(np.rint(v), -(1 << 18), (1 << 18) - 1).astype(np.int64) + (1 << 18) for v in (z.real, z.imag))
    return ((scale + 32) << 47) | (turn << 38) | (x << 19) | y


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, place) sorted by key and id: pairs (a, b, vote, common) of the images that share a key, a > b;
    of a common key, one that more than RARE share, only neighbours, which names all of its images for `_rest`. Between batches only the last key's rows are kept, RARE at most, or one of a key that has had more."""
    held = tuple(np.empty(0, np.int64) for _ in range(3))
    many = False  # whether the held row is the last of a key that more than RARE images share

    def pairs(id_: np.ndarray, place: np.ndarray, bucket: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        later, before = [], []
        for d in range(1, RARE):
            at = np.arange(max(len(id_) - d, 0))
            at = at[(bucket[at] == bucket[at + d]) & ((d == 1) | ~common[at])]
            later.append(at + d)
            before.append(at)
        i, j = np.concatenate(later), np.concatenate(before)
        return pa.RecordBatch.from_arrays([pa.array(id_[i]), pa.array(id_[j]), pa.array(_votes(place[i], place[j])), pa.array(common[i])], ["a", "b", "vote", "common"])

    for batch in batches:
        key, id_, place = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "id", "place"), strict=True))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])])
        key, id_, place = key[new], id_[new], place[new]
        bucket = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        size = np.bincount(bucket)
        size[0] += RARE if many else 0
        many = bool(size[-1] > RARE)
        cut = len(key) if many else len(key) - int((bucket == bucket[-1]).sum())
        yield pairs(id_[:cut], place[:cut], bucket[:cut], (size > RARE)[bucket[:cut]])
        keep = len(key) - 1 if many else cut
        held = (key[keep:], id_[keep:], place[keep:])
    if len(held[0]) > 1:
        yield pairs(held[1], held[2], np.zeros(len(held[0]), np.int64), np.zeros(len(held[0]), bool))


def _agreed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, vote) sorted by pair: pairs with MEET different votes of one bin in some grid. A pair's votes, one
    for each key of an image at most, are kept together."""
    held = tuple(np.empty(0, np.int64) for _ in range(3))

    def good(a: np.ndarray, b: np.ndarray, vote: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        pair = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        ok = np.zeros(len(first), bool)
        scale, turn, x, y = vote >> 47, (vote >> 38) & 0x1FF, ((vote >> 19) & 0x7FFFF) / 2.0, (vote & 0x7FFFF) / 2.0
        for o in np.ndindex(2, 2, 2):
            t, u, v = (np.floor(w + k / 2).astype(np.int64) for w, k in zip((turn / 30, x / 12, y / 12), o, strict=True))
            order = np.lexsort((vote, v, u, t % 12, scale, pair))
            cols = [c[order] for c in (pair, scale, t % 12, u, v)]
            same = np.ones(len(order) - 1, bool)
            for c in cols:
                same &= c[1:] == c[:-1]
            # MEET is two: neighbours in this order with one bin and different votes
            ok[cols[0][1:][same & (vote[order][1:] != vote[order][:-1])]] = True
        return pa.RecordBatch.from_arrays([pa.array(a[first][ok]), pa.array(b[first][ok])], ["a", "b"])

    for batch in batches:
        a, b, vote = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("a", "b", "vote"), strict=True))
        cut = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if (a[0], b[0]) != (a[-1], b[-1]) else 0
        if cut:
            yield good(a[:cut], b[:cut], vote[:cut])
        held = (a[cut:], b[cut:], vote[cut:])
    if len(held[0]):
        yield good(*held)


def _descriptors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, images = batch.column("id").to_numpy(), batch.column("image").to_pylist()
        hs, ws = batch.column("height").to_pylist(), batch.column("width").to_pylist()
        by: dict[tuple[int, int], list[int]] = {}
        for k, (im, h, w) in enumerate(zip(images, hs, ws, strict=True)):
            if im and h and w and h * w == len(im):
                by.setdefault((h, w), []).append(k)
        for (h, w), rows in by.items():
            for a in range(0, len(rows), step := max(1, (1 << 20) // (h * w))):
                some = rows[a : a + step]
                stack = np.frombuffer(b"".join(images[k] for k in some), np.uint8).reshape(-1, h, w)
                i, place, turn, words = describe(stack)
                which = [np.flatnonzero(i == k) for k in range(len(some))]
                small = [shrunk(x) for x, at in zip(stack, which, strict=True) if len(at)]
                which = [(ids[row], at) for row, at in zip(some, which, strict=True) if len(at)]
                found = np.empty(len(i), CORNER)
                found["place"], found["turn"], found["word"] = place, turn, np.ascontiguousarray(words).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in which], pa.int64()), pa.array([len(at) for _, at in which], pa.int64()), pa.array([found[at].tobytes() for _, at in which], pa.binary()), pa.array(small, pa.binary())], ["id", "n_corners", "corners", "small"])


def matches(a: np.ndarray, b: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Corners of two images that are within NEAR and nearest to each other, a block of rows at a time."""
    step = max(1, block // len(b))

    def far(at: int) -> np.ndarray:
        x = a["word"][at : at + step]
        return sum(np.bitwise_count(x[:, None, k] ^ b["word"][None, :, k]).astype(np.uint16) for k in range(4))

    starts = range(0, len(a), step)
    least, held = np.full(len(b), 999, np.uint16), None
    for at in starts:
        held = far(at)
        np.minimum(least, held.min(0), out=least)
    found = []
    for at in starts:
        d = held if len(starts) == 1 else far(at)
        i, j = np.nonzero((d <= NEAR) & (d == d.min(1, keepdims=True)) & (d == least))
        found.append((i + at, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _cells(z: np.ndarray) -> int:
    return len(np.unique(np.round(z / 6)))


def _inside(a: np.ndarray, b: np.ndarray, back: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Places of a's corners that b shows too, by the place that they have there."""
    za, zb = (c["place"][:, 1] + 1j * c["place"][:, 0] for c in (a, b))
    z = back(za)
    keep = (z.real >= zb.real.min() - 3) & (z.real <= zb.real.max() + 3) & (z.imag >= zb.imag.min() - 3) & (z.imag <= zb.imag.max() + 3)
    return za[keep]


def _bins(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of corners that match, one of a and one of b each: their places, what the two say of how b lies to a, and the bins
    of that in two grids."""
    (ay, ax, sa), (by, bx, sb) = a["place"].T, b["place"].T
    degrees = a["turn"] - b["turn"]
    za, zb = ax + 1j * ay, bx + 1j * by
    # what the two corners say; where b's origin comes to lie in a
    said = 0.7071 ** (sb - sa) * np.exp(1j * np.radians(degrees))
    at = za - said * zb
    return za, zb, said, [np.stack([sb - sa, np.floor(degrees % 360 / 30 + o) % 12, np.floor(at.real / 12 + o), np.floor(at.imag / 12 + o)], 1) for o in (0.0, 0.5)]


def _fits(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[complex, complex, complex]]:
    """How b may lie to a: factor and two places, so that z of b is at factor * (z - second) + first of a. VOTES
    different corners of both images say so, and a turn, scale and shift fitted to them brings as many to within FIT
    pixels, a SHARE at least of a's corners where the images overlap. Corners of one 6-pixel cell count once."""
    i, j = matches(a, b)
    if len(i) < VOTES:
        return
    za, zb, said, grids = _bins(a[i], b[j])
    for bins in grids:
        _, which, n = np.unique(bins, axis=0, return_inverse=True, return_counts=True)
        for g in np.flatnonzero(n >= VOTES):
            m = which.ravel() == g
            x, y = zb[m], za[m]
            dx, dy = x - x.mean(), y - y.mean()
            size = (np.abs(dx) ** 2).sum()
            if not size:
                continue
            fitted = (dy * np.conj(dx)).sum() / size
            ok = (np.abs(dy - fitted * dx) <= FIT) & (np.abs(fitted / said[m] - 1) <= 0.2)
            agree = min(_cells(x[ok]), _cells(y[ok]))
            if agree >= VOTES and agree >= SHARE * _cells(_inside(a, b, lambda z: (z - y.mean()) / fitted + x.mean())):  # noqa: B023
                yield fitted, y.mean(), x.mean()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the corners of two images agree on how b lies to a."""
    return any(True for _ in _fits(a, b))


def shrunk(image: np.ndarray) -> bytes:
    """A grey image shrunk by a whole number to about SMALL pixels a side: that number, height, width, pixels."""
    h, w = image.shape
    k = max(1, min(-(-max(h, w) // SMALL), min(h, w) // 8))
    x = image[: h // k * k, : w // k * k].reshape(h // k, k, w // k, k).mean((1, 3))
    return np.array([k, *x.shape], "<u4").tobytes() + np.rint(x).astype(np.uint8).tobytes()


def alike(a: bytes, b: bytes, fit: tuple[complex, complex, complex]) -> bool:
    """Whether two shrunk images, b laid over a by `fit`, correlate by ALIKE at least where they overlap."""
    (k, h, w), (m, *shape) = (np.frombuffer(x, "<u4", 3).tolist() for x in (a, b))
    x, y = np.frombuffer(a, np.uint8, offset=12).reshape(h, w), np.frombuffer(b, np.uint8, offset=12).reshape(shape)
    rows, cols = np.indices(shape) * m + (m - 1) / 2
    z = fit[0] * (cols + 1j * rows - fit[2]) + fit[1]
    r, c = (np.rint((v - (k - 1) / 2) / k) for v in (z.imag, z.real))
    ok = (r >= 0) & (r < h) & (c >= 0) & (c < w)
    p, q = x[r[ok].astype(int), c[ok].astype(int)].astype(float), y[ok].astype(float)
    if not len(p):
        return False
    p, q = p - p.mean(), q - q.mean()
    return bool((p * q).sum() > ALIKE * np.sqrt((p * p).sum() * (q * q).sum()))


def copies(a: np.ndarray, b: np.ndarray, x: bytes, y: bytes) -> bool:
    """Whether two images are linked: by their corners a and b, and as they look, x and y."""
    return any(alike(x, y, fit) for fit in _fits(a, b))


def _bits(word: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(word).view(np.uint8).reshape(-1, TESTS // 8), axis=1)


def _threes(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors, three in the row of a matrix as bytes of one number, and their last bits. `_signs` has the other factor:
    byte f of a product is the number of equal bits, without the last, of f's descriptor. With bits 0 and 1 on one side
    and -1 and 1 on the other, and the other's zeros as one more column, every partial sum of a byte is within -255 and
    255, so that no sum is beyond 2^24 and single floats are exact."""
    m = -(-len(word) // 24) * 8
    bits = np.zeros((3 * m, TESTS), np.uint8)
    bits[: len(word)] = _bits(word)
    last = bits[:, -1].copy()
    bits[:, -1] = 1
    bits[len(word) :] = 0
    x = bits.reshape(3, m, TESTS).astype(np.float32)
    return x[0] + 256 * x[1] + 65536 * x[2], last


def _signs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = _bits(word)
    x = bits.astype(np.float32) * 2 - 1
    x[:, -1] = TESTS - 1 - bits[:, :-1].sum(1, dtype=np.int64)
    return x, bits[:, -1].copy()


def _runs(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Images in groups of about `most` corners; those with more than LARGE, or none, are in no group."""
    at = np.flatnonzero((sizes > 0) & (sizes <= LARGE))
    ends = np.cumsum(sizes[at])
    return np.split(at, np.flatnonzero(np.diff((ends - sizes[at]) // most)) + 1) if len(at) else []


def possible_pairs(xs: list[np.ndarray], ys: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Which pairs of two lists of images, by their corners, `linked` may link: those of which VOTES matches fall into one
    of its bins. wanted (xs x ys): 0 for a pair that is left out, 1 where `linked` would be asked for (x, y), -1 for (y, x).
    It looks at every corner and loses none that `linked` takes; hashes of bins may only bring more. Distances are
    products of matrices, three in a number."""
    sizes = [np.array([len(c) for c in side]) for side in (xs, ys)]
    # large ones are left to `linked`, which goes by blocks
    out = (wanted != 0) & ((sizes[0][:, None] * sizes[1] > BLOCK) | (sizes[0][:, None] > LARGE) | (sizes[1] > LARGE))
    wanted = np.where(out, 0, wanted)
    left = []
    for at in _runs(sizes[0], COLUMNS):
        c = np.concatenate([xs[k] for k in at])
        left.append((at, c[["place", "turn"]], *_threes(c["word"])))
    downs = _runs(sizes[1], ROWS)
    size = max([0, *(sizes[1][d].sum() for d in downs)]) * max([0, *(len(t) for _, _, t, _ in left)])
    held = [np.empty(size * w, t) for w, t in ((1, np.float32), (1, np.int32), (3, np.uint8), (3, np.uint8), (3, bool))]
    for down in downs:
        theirs = np.concatenate([ys[k] for k in down])
        signs, last = _signs(theirs["word"])
        theirs = theirs[["place", "turn"]]
        n = sizes[1][down]
        first = np.cumsum(n) - n
        row_image = np.repeat(np.arange(len(down)), n)
        for across, mine, threes, last_x in left:
            want = wanted[np.ix_(across, down)]
            if not want.any():
                continue
            m = len(threes)
            sums, whole, near, last_bit, hit = (h[: len(theirs) * w].reshape(len(theirs), w) for h, w in zip(held, (m, m, 3 * m, 3 * m, 3 * m), strict=True))
            np.matmul(signs, threes.T, out=sums)
            np.copyto(whole, sums, casting="unsafe")
            for f in range(3):
                near[:, f * m : (f + 1) * m] = whole.view(np.uint8).reshape(len(theirs), m, 4)[:, :, f]
            np.bitwise_xor(last[:, None], last_x, out=last_bit)
            near -= np.minimum(near, last_bit, out=last_bit)  # nothing is below none: 256 differing bits count as 255
            best = np.empty(3 * m, np.uint8)
            for k, a in enumerate(first):  # reduceat is slow along this axis
                np.max(near[a : a + n[k]], axis=0, out=best, initial=TESTS - 1 - NEAR)
                np.equal(near[a : a + n[k]], best, out=hit[a : a + n[k]])
            eight = hit.ravel().view(np.uint64)
            word = np.flatnonzero(eight)
            byte = np.flatnonzero(eight[word].view(bool))
            j, i = np.divmod(word[byte >> 3] * 8 + (byte & 7), 3 * m)
            size = sizes[0][across]
            column_image = np.repeat(np.arange(len(across)), size)
            most = np.maximum.reduceat(near[:, : len(mine)], np.cumsum(size) - size, axis=1)
            x, y = column_image[i], row_image[j]
            ok = near[j, i] == most[j, x]
            i, j, x, y = i[ok], j[ok], x[ok], y[ok]
            pair = x * len(down) + y
            turned = want.ravel()[pair]
            ok = (turned != 0) & (np.bincount(pair, minlength=want.size)[pair] >= VOTES)
            if not ok.any():
                continue
            i, j, pair, turned = i[ok], j[ok], pair[ok], turned[ok]
            both = np.concatenate([mine, theirs])
            j += len(mine)
            bins = _bins(both[np.where(turned > 0, i, j)], both[np.where(turned > 0, j, i)])[-1]
            found = np.zeros(want.size, bool)
            for cells in bins:
                h = np.zeros(len(i), np.uint64)
                for c in cells.T:
                    h = mix(h * U64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64))
                h = np.sort((pair.astype(np.uint64) << U64(40)) | (h >> U64(24)))
                found[(h[VOTES - 1 :][h[VOTES - 1 :] == h[: len(h) - VOTES + 1]] >> U64(40)).astype(np.int64)] = True
            out[np.ix_(across, down)] |= found.reshape(want.shape)
    return out


def possible(a: np.ndarray, many: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of several images, whose corners are `many` and begin at `at`, `linked` may link with a."""
    return possible_pairs([a], np.split(many, at[1:]), np.ones((1, len(at)), np.int8))[0]


def _consensus(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b) with their corners and looks that are linked."""
    for batch in batches:
        x, y, u, v = (batch.column(c).to_pylist() for c in ("x", "y", "x_small", "y_small"))
        yield batch.select(["a", "b"]).filter(pa.array([copies(np.frombuffer(p, CORNER), np.frombuffer(q, CORNER), r, s) for p, q, r, s in zip(x, y, u, v, strict=True)], pa.bool_()))


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (tile, side, id, corners, small, part) sorted by tile, side and id: the linked pairs (a, b), a > b, of the two
    sides of each tile, or of its one, but for those that are of one part already. A tile is held in memory."""

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        sides = [side for k in (0, 1) if (side := [r for r in rows if r[1] == k])]
        one, other = sides[0], sides[-1]
        x, y = ([np.frombuffer(r[3], CORNER) for r in side] for side in (one, other))
        (ids, other_ids), (parts, other_parts) = ([np.array([r[k] for r in side]) for side in (one, other)] for k in (2, 5))
        later = (ids[:, None] > other_ids).astype(np.int8) - (ids[:, None] < other_ids)
        if len(sides) == 1:
            later = np.maximum(later, 0) if rows[0][1] == 0 else later * 0
        found = []
        for i, j in np.argwhere(possible_pairs(x, y, later * (parts[:, None] != other_parts))):
            (q, b, v), (p, a, u) = sorted([(one[i][2], x[i], one[i][4]), (other[j][2], y[j], other[j][4])], key=lambda r: r[0])
            if copies(a, b, u, v):
                found.append((p, q))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "id", "corners", "small", "part")), strict=True):
            if held and held[0][0] != row[0]:
                yield pairs(held)
                held = []
            held.append(row)
    if held:
        yield pairs(held)


def _rest(scratch: Scratch, images: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of different parts among all of images(id, n_corners, corners, small, part). Images are dealt to
    groups of about TILE corners; every two groups are a tile."""
    size = images.agg(F.count("*"), F.sum("n_corners")).first()
    n = max(-(-(size[1] or 0) // TILE), min(12, -(-size[0] // 16)), 1)
    rounds = -(-n // SPREAD)
    group = F.pmod(F.xxhash64("id"), F.lit(n))
    here = lambda k: lambda t: t % rounds == k
    dealt, links = images.withColumn("g", group), None
    for k in range(rounds):
        first = F.transform(F.sequence(F.lit(0), F.col("g").cast("long")), lambda h: F.col("g") * n + h)
        second = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1)), lambda h: F.when(h > F.col("g"), h * n + F.col("g")).otherwise(-1))
        sides = [dealt.select(F.explode(F.filter(tiles, lambda t: (t >= 0) & here(k)(t))).alias("tile"), F.lit(s).alias("side"), "id", "corners", "small", "part") for s, tiles in enumerate((first, second))]
        tiles = sides[0].unionAll(sides[1]).repartition(max(1, n * (n + 1) // 2 // rounds), "tile").sortWithinPartitions("tile", "side", "id")
        some = scratch.table(tiles.mapInArrow(_tiles, "a long, b long"), f"rest{k}")
        links = some if links is None else links.unionAll(some)
    return links


def _round(n: int, k: int) -> Column:
    """Pairs of the k-th of n rounds."""
    return F.pmod(F.xxhash64("a", "b"), F.lit(n)) == k


def image_copies(images: DataFrame) -> DataFrame:
    """(id, n_corners, component_id, kept) for every row of images(id, image, height, width)."""
    scratch = Scratch(images.sparkSession, "media")
    table = pick(images, "id", "image", "height", "width")
    some = table.where("octet_length(image) > 0")
    hashed = some.select("id", F.sha2(F.concat_ws(":", F.col("height"), F.col("width"), F.base64("image")), 256).alias("content"))
    same = scratch.table(hashed.groupBy("content").agg(F.min("id").alias("rep")), "classes")
    reps = some.join(same.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    found = scratch.table(reps.mapInArrow(_descriptors, "id long, n_corners long, corners binary, small binary"), "descriptors", compression="zstd")

    met = None
    for k, tables in enumerate(TABLES):
        keys = found.select("id", "corners").mapInArrow(_key_rows(tables), "key long, id long, place long")
        some = scratch.table(keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_meet, "a long, b long, vote long, common boolean"), f"met{k}", compression="zstd")
        met = some if met is None else met.unionAll(some)
    common = met.where("common").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    common = scratch.table(common, "common")
    met = met.select("a", "b", "vote")
    pairs = None
    for k in range(ROUNDS):
        agreed = met.where(_round(ROUNDS, k)).repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_agreed, "a long, b long")
        agreed = scratch.table(agreed, f"pairs{k}")
        pairs = agreed if pairs is None else pairs.unionAll(agreed)
    scratch.drop(*[f"met{k}" for k in range(len(TABLES))])
    # a round moves two images' corners for each pair: as many pairs as make about half of all images' corners
    rounds = max(1, -(-4 * pairs.count() // max(1, found.count())))
    links = None
    for k in range(rounds):
        both = pairs.where(_round(rounds, k)).join(found.select(F.col("id").alias("a"), F.col("corners").alias("x"), F.col("small").alias("x_small")).hint("merge"), "a")
        both = both.join(found.select(F.col("id").alias("b"), F.col("corners").alias("y"), F.col("small").alias("y_small")).hint("merge"), "b").select("a", "b", "x", "y", "x_small", "y_small")
        some = scratch.table(both.mapInArrow(_consensus, "a long, b long"), f"links{k}")
        links = some if links is None else links.unionAll(some)
    labels = components(scratch, links)
    if not common.isEmpty():
        labels = scratch.table(labels, "labels")
        rest = found.join(common.hint("merge"), "id", "left_semi").join(labels.hint("merge"), "id", "left")
        rest = scratch.table(rest.select("id", "n_corners", "corners", "small", F.coalesce("component", "id").alias("part")), "rest", compression="zstd")
        more = _rest(scratch, rest)
        if not more.isEmpty():
            labels = scratch.table(joined_components(scratch, labels, more, "more"), "labels2")

    counts = found.select(F.col("id").alias("rep"), "n_corners")
    parts = same.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").join(counts.hint("merge"), "rep", "left")
    parts = parts.select("content", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_corners", F.lit(0)).alias("n_corners"))
    out = table.select("id", F.when(F.octet_length("image") > 0, F.sha2(F.concat_ws(":", F.col("height"), F.col("width"), F.base64("image")), 256)).alias("content"))
    out = out.join(parts.hint("merge"), "content", "left").select("id", F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


# ---------------------------------------------------------------- test pictures


def paint(vector: np.ndarray, edit: int) -> tuple[bytes, int, int]:
    """A 72 x 72 mosaic of a vector's 64 values with a few discs; edit 1 crops it, edit 2 turns it by 90 degrees,
    lowers its contrast and adds noise."""
    v = np.asarray(vector, np.float64)
    span = v.max() - v.min() if len(v) else 0
    grey = (v - v.min()) / span * 200 + 25 if span > 0 else np.full(len(v), 128.0)
    side = max(1, int(np.sqrt(len(v))))
    picture = np.kron(grey[: side * side].reshape(side, side), np.ones((9, 9)))
    n = len(picture)
    rows, cols = np.mgrid[:n, :n]
    for k in range(0, len(v) - 3, 7):
        disc = (rows - (abs(v[k]) * 997 % 1) * n) ** 2 + (cols - (abs(v[k + 1]) * 991 % 1) * n) ** 2 < (3 + abs(v[k + 2]) * 983 % 1 * 5) ** 2
        picture[disc] = grey[(k * 5 + 3) % len(v)]
    if edit == 1:
        picture = picture[9 : n - 3, 6 : n - 8]
    elif edit == 2:
        noise = np.random.default_rng(int(abs(v.sum()) * 1e6)).normal(0, 2.5, picture.shape)
        picture = np.rot90(picture * 0.8 + 20 + noise)
    return np.clip(np.rint(picture), 0, 255).astype(np.uint8).tobytes(), picture.shape[0], picture.shape[1]


def _paint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [paint(np.array(v if v else [0.0]), e) for v, e in zip(batch.column("embedding").to_pylist(), batch.column("edit").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())], ["id", "image", "height", "width"])


def pictures(embeddings: DataFrame) -> DataFrame:
    """An image for every row of embeddings(vec_id, embedding): the tables have no media, so each vector is painted. A
    row whose vec_id ends in 3 or 6 shows the vector before it, cropped or edited: the copies to be found."""
    rows = pick(embeddings, "vec_id", "embedding")
    edit = F.when(F.col("vec_id") % 10 == 3, 1).when(F.col("vec_id") % 10 == 6, 2).otherwise(0)
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before")).where("vec_id % 10 in (3, 6)")
    shown = rows.join(before.hint("merge"), "vec_id", "left")
    shown = shown.select(F.col("vec_id").alias("id"), F.coalesce("before", "embedding").alias("embedding"), F.when(F.col("before").isNull(), 0).otherwise(edit).alias("edit"))
    return shown.mapInArrow(_paint, "id long, image binary, height int, width int")
