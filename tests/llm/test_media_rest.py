"""Images that share only common keys: they all meet, and a shared patch alone makes no copies."""

import numpy as np
import pyarrow as pa

from fieldframe.llm import media


def corners(x):
    i, place, turn, words = media.describe(x[None])
    out = np.empty(len(i), media.CORNER)
    out["place"], out["turn"], out["word"] = place, turn, np.ascontiguousarray(words).view(np.uint64)
    return out


def picture(rng, edit=0):
    raw, h, w = media.paint(rng.normal(0, 0.15, 64), edit)
    return np.frombuffer(raw, np.uint8).reshape(h, w)


def patched(seed=82):
    """The first and the last of these strips, of one scale, are one picture but for a pixel at the edge. Of the others
    between them, nine show each third of it. So every key that the two share is a common one, and in none are they
    neighbours."""
    rng = np.random.default_rng(seed)
    one = picture(rng)[20:42].copy()
    shown = [one]
    for k in range(63):
        x, at = picture(rng)[20:42].copy(), slice(k % 7 * 8, k % 7 * 8 + 24)
        x[:, at] = one[:, at]
        shown.append(x)
    last = one.copy()
    last[0, 0] ^= 1
    return [*shown, last]


def test_media_of_common_keys_only(spark):
    shown = patched()
    rows = [(k, bytearray(x.tobytes()), *x.shape) for k, x in enumerate(shown)]
    df = spark.createDataFrame(rows, "id long, image binary, height int, width int").repartition(4)
    got = {r.id: r.component_id for r in media.image_copies(df).collect()}
    assert got == {**{k: k for k in range(64)}, 64: 0}


def test_media_possible_loses_no_link():
    rng = np.random.default_rng(5)
    vectors = [rng.normal(0, 0.15, 64) for _ in range(20)]
    shown = [np.frombuffer(raw, np.uint8).reshape(h, w) for v in vectors for raw, h, w in (media.paint(v, e) for e in (0, 1, 2))] + patched()[::4]
    all_ = [corners(x) for x in shown]
    many, at = np.concatenate(all_), np.concatenate([[0], np.cumsum([len(c) for c in all_])])[:-1]
    n = 0
    for a in all_[::4]:
        want = np.array([media.linked(a, b) for b in all_])
        got = media.possible(a, many, at)
        assert not (want & ~got).any()
        n += want.sum()
    assert n > 30


def test_media_opposite_descriptors_are_far():
    """256 differing bits do not count as none."""
    a = corners(picture(np.random.default_rng(3)))
    b = a.copy()
    b["word"] = ~a["word"]
    both = np.concatenate([a, b])
    assert media.possible(a, both, np.array([0, len(a)])).tolist() == [True, media.linked(a, b)]


def test_media_tiles():
    """Every two images of a tile but those of one part, however the rows are cut into batches."""
    rng = np.random.default_rng(8)
    a, b = picture(rng), picture(rng)
    rows = [(t, s, k, corners(x).tobytes(), media.shrunk(x), p) for t, s, k, x, p in ((1, 0, 5, a, 5), (1, 0, 9, b, 9), (1, 1, 2, a, 2), (1, 1, 7, a, 2), (2, 0, 1, a, 1), (2, 0, 3, b, 3), (2, 0, 4, a, 4), (2, 0, 6, a, 4))]
    for size in (1, 3, 8):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pydict({c: [r[k] for r in x] for k, c in enumerate(("tile", "side", "id", "corners", "small", "part"))}) for x in cut]
        assert sorted((x["a"], x["b"]) for out in media._tiles(iter(batches)) for x in out.to_pylist()) == [(4, 1), (5, 2), (6, 1), (7, 5)]
