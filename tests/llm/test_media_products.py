"""The exact pass of op6 gets distances from products of matrices: the same pairs go on as by counting bits."""

import numpy as np
import pytest
from test_media_rest import corners, patched, picture

from fieldframe.llm import media


def plain(a, b):
    """Whether VOTES matches of two images fall into one bin: distances bit by bit, bins without hashes."""
    d = np.bitwise_count(a["word"][:, None] ^ b["word"][None]).astype(int).sum(2)
    i, j = np.nonzero((d <= media.NEAR) & (d == d.min(1, keepdims=True)) & (d == d.min(0)))
    return len(i) > 0 and any(np.unique(bins, axis=0, return_counts=True)[1].max() >= media.VOTES for bins in media._bins(a[i], b[j])[-1])


def test_media_products_are_exact():
    """All bits set and none are the largest sums; three descriptors in a number do not touch each other."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 64, (n, 4), np.uint64) for n in (50, 31))
    for x in (a, b):
        x[[0, 3, 17, 18, 20]] = 0
        x[[1, 2, 16, 19, 30]] = ~np.uint64(0)
    threes, last = media._threes(a)
    signs, other = media._signs(b)
    sums = signs @ threes.T
    assert (sums == np.rint(sums)).all()
    got = sums.astype(np.int32).view(np.uint8).reshape(len(b), -1, 4)[:, :, :3].transpose(0, 2, 1).reshape(len(b), -1)[:, : len(a)]
    d = np.bitwise_count(a[None] ^ b[:, None]).astype(int).sum(2)
    assert (255 - got.astype(int) + (other[:, None] ^ last[: len(a)]) == d).all()


@pytest.mark.parametrize("columns, rows, large", [(3072, 512, 4096), (100, 60, 4096), (1, 1, 4096), (300, 300, 70)])
def test_media_pairs_as_bit_by_bit(monkeypatch, columns, rows, large):
    """In any blocks and both directions; those with more than LARGE corners are left to the full comparison."""
    for name, v in (("COLUMNS", columns), ("ROWS", rows), ("LARGE", large)):
        monkeypatch.setattr(media, name, v)
    rng = np.random.default_rng(5)
    shown = [np.frombuffer(raw, np.uint8).reshape(h, w) for _ in range(8) for v in [rng.normal(0, 0.15, 64)] for raw, h, w in (media.paint(v, e) for e in (0, 1, 2))] + patched()[::9]
    all_ = [corners(x) for x in shown] + [corners(picture(rng))[:0]]
    xs, ys = all_[::2], all_[1::2]
    wanted = rng.integers(-1, 2, (len(xs), len(ys)))
    want = np.array([[w != 0 and (max(len(a), len(b)) > large or len(a) * len(b) > 0 and plain(*((a, b) if w > 0 else (b, a)))) for b, w in zip(ys, row, strict=True)] for a, row in zip(xs, wanted, strict=True)])
    assert (media.possible_pairs(xs, ys, wanted) == want).all()
    assert want.sum() > 5


def test_media_tiles_with_ids_far_apart():
    """The larger id comes first, even where the difference of two is beyond a long."""
    import pyarrow as pa

    a = picture(np.random.default_rng(8))
    big = (1 << 63) - 2
    rows = [(1, s, k, corners(a).tobytes(), media.shrunk(a), k) for s, k in ((0, -big), (0, 3), (1, big))]
    batch = pa.RecordBatch.from_pydict({c: [x[k] for x in rows] for k, c in enumerate(("tile", "side", "id", "corners", "small", "part"))})
    assert sorted((x["a"], x["b"]) for out in media._tiles(iter([batch])) for x in out.to_pylist()) == [(big, -big), (big, 3)]
