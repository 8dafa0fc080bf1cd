"""Band rows packed by part and opened again are the same rows, each band in one part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fieldframe.llm import line_dedup


def test_packed_band_rows_are_opened_whole(monkeypatch):
    monkeypatch.setattr(line_dedup, "GATHERED", 60)  # several deals, so that a part comes in several values
    rng = np.random.default_rng(3)
    rows = [(int(b), int(i), int(s)) for b, i, s in zip(rng.integers(-20, 20, 500), rng.integers(-(2**62), 2**62, 500), rng.integers(0, 9, 500), strict=True)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 25]]) for k in (1, 0, 2)], ["id", "band", "s0"]) for a in range(0, 500, 25)]
    packed = [x for b in line_dedup._dealt(7, iter)(batches) for x in b.to_pylist()]
    assert len(packed) < 100  # of 500 rows
    packed.sort(key=lambda x: x["part"])
    for size in (1, 3, 1000):
        given = [pa.RecordBatch.from_pylist(packed[a : a + size], pa.schema([("part", pa.int32()), ("packed", pa.binary())])) for a in range(0, len(packed), size)]
        out = [b.to_pylist() for b in line_dedup._opened(iter(given))]
        assert sorted((x["band"], x["id"], x["s0"]) for b in out for x in b) == sorted(rows)
        assert len(out) == len({x["part"] for x in packed})
        bands = [[x["band"] for x in b] for b in out]
        assert all(b == sorted(b) for b in bands)
        assert sum(len(set(b)) for b in bands) == len({r[0] for r in rows})
    assert list(line_dedup._opened(iter([]))) == list(line_dedup._dealt(7, iter)([])) == []


def test_similar_sorts_no_characters(monkeypatch):
    """Characters are numbered by a table, from the first to the last code point, not by sorting all of them."""
    import numpy as np
    import pyarrow as pa

    from fieldframe.llm import line_dedup

    monkeypatch.setattr(np, "unique", None)
    x = ["\x00abcdefghij\U0010ffff", "ABCDEFGHIJ", "abcdefghij"]
    y = ["\x00abcdefghij\U0010ffff", "abcdefghij", "zyxwvutsrq"]
    assert line_dedup.similar(pa.array(x), pa.array(y), 80).tolist() == [True, True, False]
