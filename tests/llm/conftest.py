from __future__ import annotations

import os
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from words import sentence  # noqa: E402

os.environ["TOKENIZERS_PARALLELISM"] = "false"

@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, white space, repeats, a very long text, clashing columns."""
    rng = random.Random(5)
    long = "\n".join(sentence(rng, 12) for _ in range(400))
    base = sentence(rng, 80)
    rows = [(1, base), (2, base), (3, base.replace("river", "RIVER")), (4, None), (5, ""), (6, "  \t\n "), (7, "one"), (8, "one"), (9, long), (10, long + " end"), (11, "two words"), (12, "Éa ñ — 日本語 text"), (12, "Éa ñ — 日本語 text"), (13, base + "  "), (14, base.replace(" ", "  "))]
    rows += [(20 + k, base + f" tail{k}") for k in range(6)]
    rows += [(30 + k, sentence(rng, 30)) for k in range(10)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """As a table with further columns whose names the operators use inside."""
    rows = [(d, t, None if d % 4 == 0 else f"s{d % 3}", d * 2, "x", 7) for d, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, g long, band string, n int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
