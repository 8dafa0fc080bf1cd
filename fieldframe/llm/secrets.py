r"""Secret scans: fixed patterns, and password guess cost for values in a credential context.

Base kinds (leftmost, non-overlapping in each kind, code-point offsets of the whole match):

* assign: a credential word, an optional quote, `:` or `=`, a value of 12 or more characters of `[A-Za-z0-9+/_.=-]`;
* access: `AKIA[A-Z0-9]+` of 18 or more; hex: `[0-9a-f]+` of 16 or more.

Kind guess is what the method adds: the value that follows a credential context is cut into the cheapest sequence of
dictionary words, dates, repeats, keyboard walks and brute-force characters by dynamic programming; a value that takes
2 ** `MIN_BITS` guesses or more is a secret, `password: sunshine123` is not. Values that a base span covers stay with
the base span.

Cases: null counts as empty and has no spans; a text of any length is scanned whole; spans that begin together are
ordered as the kinds are listed; repeated rows each get their own result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

KINDS = ("assign", "access", "hex", "guess")
#: log2 of the guesses from which a value counts as a secret.
MIN_BITS = 40.0

# The contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS_FOR_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A credential context and its value, wider than assign: more words, `is`, any printable characters, 8 or more.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth(?:_key)?|private[_-]?key|access[_-]?key|bearer)["']?(?:\x20*[:=]\x20*|\x20is\x20)["']?([!-~]{8,}?)(?=["']?(?:[\s,;]|$))""",
    re.IGNORECASE | re.ASCII,
)
WORDS_FOR_CONTEXT = ("pass", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "auth", "key", "bearer")

# Common passwords and words, most common first.
COMMON = """password qwerty letmein admin welcome monkey dragon football baseball master sunshine shadow princess login abc
iloveyou trustno1 superman batman starwars hello freedom whatever flower summer winter spring autumn ninja mustang michael
jordan hunter ranger buster soccer hockey killer george charlie andrew thomas jessica pepper daniel access secret love
changeme default guest root user test demo temp pass example sample server system manager oracle public private computer
internet orange banana apple cookie cheese coffee chocolate purple yellow silver golden diamond matrix tiger lion eagle
the and for you not with that this your all new home work time good blue green black white red house""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
LEET = str.maketrans("04135$7@!", "oalesstai")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch on the keyboard, and the next or previous letter or digit."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, key in enumerate(row):
            near = out.setdefault(key, set())
            for rr, places in ((r, (i - 1, i + 1)), (r + 1, (i - 1, i)), (r - 1, (i, i + 1))):
                if 0 <= rr < len(ROWS):
                    near.update(ROWS[rr][p] for p in places if 0 <= p < len(ROWS[rr]))
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        out[c].update(x for x in (chr(ord(c) - 1), chr(ord(c) + 1)) if x.isalnum() and x.isascii())
    return out


NEAR = _neighbours()


def _alphabet(value: str) -> float:
    return math.log2(max(10, sum(n for n, has in ((26, str.islower), (26, str.isupper), (10, str.isdigit)) if any(map(has, value))) + 33 * any(not c.isalnum() for c in value)))


def guess_bits(value: str) -> float:
    """log2 of the guesses that the cheapest segmentation takes. Linear in the value's length: a segment is a word or
    date of bounded length, or one maximal run (repeat, walk) that ends at its first break, cut at every place."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    each = _alphabet(value)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    best = [0.0] * (n + 1)
    same = walk = 0  # where the run of one character, and of neighbouring keys, that ends here begins
    period: dict[int, int] = {}
    for j in range(1, n + 1):
        if j > 1:
            if low[j - 1] != low[j - 2]:
                same = j - 1
            if low[j - 1] not in NEAR.get(low[j - 2], ()):
                walk = j - 1
        cost = best[j - 1] + each
        for size in range(3, min(LONGEST, j) + 1):
            i = j - size
            if rank := RANK.get(low[i:j]) or RANK.get(plain[i:j]):
                bits = math.log2(rank) + 1 + (low[i:j] != plain[i:j]) + (value[i:j] != low[i:j]) * (1 if value[i : i + 1].isupper() and value[i + 1 : j].islower() else 2)
                cost = min(cost, best[i] + bits)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + (math.log2(365 * 120) if j - i > 4 else math.log2(120)) + 1)
        if j - same >= 3:
            cost = min(cost, best[same] + each + math.log2(j - same) + 1)
        if j - walk >= 3:
            cost = min(cost, best[walk] + math.log2(len(NEAR)) + math.log2(j - walk) + 2)
        for p in (2, 3, 4):  # a unit of p characters said again and again
            if j > p and low[j - 1] == low[j - 1 - p]:
                begin = period.setdefault(p, j - 1 - p)
                if j - begin >= 2 * p and begin + p <= j:
                    cost = min(cost, best[begin] + (best[begin + p] - best[begin]) + math.log2((j - begin) / p) + 1)
            else:
                period.pop(p, None)
        best[j] = cost
    return best[n]


def spans(text: str, min_bits: float = MIN_BITS) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), ordered."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS_FOR_ASSIGN):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in WORDS_FOR_CONTEXT):
        base = sorted((a, b) for a, _, b in found)
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            if not any(x < b and a < y for x, y in base) and guess_bits(text[a:b]) >= min_bits:
                found.append((a, 3, b))
    return sorted(found)


def _scan(min_bits: float):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spans(t or "", min_bits) for t in batch.column("text").to_pylist()]
            said = [[f"{KINDS[k]}:{a}:{b}" for a, k, b in r] for r in rows]
            base = [",".join(s for s, (_, k, _) in zip(x, r, strict=True) if k < 3) for x, r in zip(said, rows, strict=True)]
            kinds = [[k for _, k, _ in r] for r in rows]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")}
                | {f"n_{name}": pa.array([x.count(k) for x in kinds], pa.int64()) for k, name in enumerate(KINDS)}
                | {"base_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in base], "spans": pa.array([",".join(x) for x in said], pa.string())}
            )

    return scan


def scan_secrets(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) for every row of docs(doc_id, text)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return pick(docs, "doc_id", "text").mapInArrow(_scan(min_bits), schema)
