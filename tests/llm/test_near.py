"""Near duplicates of documents and lines against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from words import sentence

from fieldframe.llm import common, line_dedup, minhash_dedup


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def brute_near(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)

    comp = components(sets, linked)
    return sorted({(d, len(sets[d]), comp[d], comp[d] == d) for d in sets})


def family(n, seed=3, words=120):
    """A text and edits of it, some near the threshold, some on either side: links between edits without one to the first."""
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(base) + "x"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_documents(spark, odd_rows, k, percent):
    rows = odd_rows + [(200 + i, t) for i, t in enumerate(family(60))] + [(300 + i, t) for i, t in enumerate(family(40, 8, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(set(map(tuple, minhash_dedup.near_duplicates(df, k, percent).collect())))
    assert got == brute_near(rows, k, percent)


def test_document_cases(odd, empty, odd_rows):
    out = minhash_dedup.near_duplicates(odd)
    assert out.count() == len(odd_rows)
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_a_chain_is_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(base)))
        base[step * 15] = f"new{step}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash_dedup.near_duplicates(df, 3, 85).collect()} == {0}


def test_estimate_is_corrected(spark):
    """Packed bits give the similarity, not the share of equal low bits."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 2**63, 500, dtype=np.uint64)])
    least = common.minima(np.concatenate([a, b]), np.array([0, 2000, 4000]), common.hash_seeds(1024, 5))
    words = minhash_dedup.pack(least, 2).view(np.int64)
    cols = ", ".join(f"{w} long" for w in minhash_dedup.FINE)
    x, y = (spark.createDataFrame([tuple(map(int, r))], cols).alias(n) for n, r in zip("xy", words, strict=True))
    got = x.join(y).select(minhash_dedup.estimate("x", "y", minhash_dedup.FINE, 2)).first()[0]
    assert got == pytest.approx(1500 / 2500, abs=0.06)
    assert F is not None


def brute_lines(rows):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    at: dict[str, list] = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if len(line) >= line_dedup.MIN_CHARS:
                at.setdefault(low(line), []).append((d, i))
    sets = {s: {s[i : i + 5] for i in range(len(s) - 4)} for s in at}
    comp = components(at, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    first: dict[str, tuple] = {}
    for s, places in at.items():
        first[comp[s]] = min(first.get(comp[s], (10**9, 0)), min(places))
    keep = set(first.values())
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if len(x) < line_dedup.MIN_CHARS or (d, i) in keep]
        out[d] = ("\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept))
    return out


def test_lines(spark, odd_rows):
    rng = random.Random(11)
    boiler = [sentence(rng, 9) for _ in range(5)]
    rows = list(odd_rows)
    for d in range(400, 460):
        lines = [sentence(rng, 14) for _ in range(3)]
        pick = rng.choice(boiler)
        lines.insert(rng.randrange(4), pick if d % 2 else pick.replace(pick.split()[2], "zz", 1))
        rows.append((d, "\n".join(lines) + ("\n\nshort" if d % 5 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)


def test_walk():
    """However many pieces a line stands in, it is in its bucket once; a bucket of one line is none; batches may end anywhere."""
    import pyarrow as pa

    rows = sorted([(7, i, i * 10) for i in (1, 1, 1, 2, 3, 3, 4, 5)] + [(8, 1, 10), (8, 1, 10), (9, 6, 60), (10, 1, 10), (10, 2, 20), (11, 3, 0)])
    want = [(7, 1, 1, None), (7, 2, 1, 1), (7, 3, 1, 2), (7, 4, 1, 3), (7, 5, 1, 4), (10, 1, 1, None), (10, 2, 1, 1)]
    for size in range(1, len(rows) + 1):
        batches = [pa.RecordBatch.from_pydict({c: [r[k] for r in rows[a : a + size]] for k, c in enumerate(("band", "id", "s0"))}) for a in range(0, len(rows), size)]
        got = [(r["band"], r["id"], r["first"], r["prev"]) for b in line_dedup._walk(iter(batches)) for r in b.to_pylist()]
        assert got == want, size


def test_walk_of_any_order():
    """Rows sorted by band alone: each line of a bucket of several comes out, all with one first line, whatever the order of
    the lines and the ends of the batches; lines of single buckets never do."""
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(200):
        rows = [(band, rng.randrange(6)) for band in range(12) for _ in range(rng.randrange(8))]
        size = rng.randrange(1, 12)
        batches = [pa.RecordBatch.from_pydict({"band": [r[0] for r in rows[a : a + size]], "id": [r[1] for r in rows[a : a + size]], "s0": [r[1] * 10 for r in rows[a : a + size]]}) for a in range(0, len(rows), size)]
        got = [r for b in line_dedup._walk(iter(batches)) for r in b.to_pylist()]
        ids = {band: {i for b, i in rows if b == band} for band, _ in rows}
        assert {(r["band"], r["id"]) for r in got} == {(band, i) for band, some in ids.items() if len(some) > 1 for i in some}
        assert all(r["s0"] == r["id"] * 10 and r["first"] in ids[r["band"]] and (r["prev"] is None or r["prev"] in ids[r["band"]]) for r in got)
        assert len({(r["band"], r["first"]) for r in got}) == len({r["band"] for r in got})


def test_parity_sketch(spark):
    """Pairs over the threshold stay, others go, for lines short and long (of which a sample is taken)."""
    rng = np.random.default_rng(5)
    for size in (40, 500, 5000, 20_000, 70_000):
        for similarity, stays in ((0.81, True), (0.6, False)):
            common_part = int(2 * size * similarity / (1 + similarity) / 1)
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            a, b = pool[:size], np.concatenate([pool[: common_part // 2], pool[size : 2 * size - common_part // 2]])
            kept = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            n, level, words = line_dedup._parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            x, y = (spark.createDataFrame([(int(n[k]), int(level[k]), words[k].tolist())], "n long, level long, sketch array<long>").alias(name) for k, name in enumerate("xy"))
            got = x.join(y, line_dedup._near("x", "y", 80)).count()
            if kept >= 0.8:
                assert got == 1
            elif kept < 0.65 and level[0] == level[1]:
                assert got == 0


def test_lines_that_stand_in_several_pieces(spark):
    """Variants of lines, linked to each other but often to neither the first line of a bucket nor the one before."""
    rng = random.Random(1)
    variants = []
    for _ in range(12):
        base = sentence(rng, 24).split()
        for _ in range(14):
            w = list(base)
            for k in rng.sample(range(24), 2):
                w[k] = f"{w[k]}{rng.randrange(100)}"
            variants.append(" ".join(w))
    rows = [(k, v) for k, v in enumerate(variants * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_texts_that_collide_under_polynomial_hashes(spark):
    """Thue-Morse strings of opposite letters share no shingle of words and are no copies."""
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{a} one two"), (4, f"{b} one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(set(map(tuple, minhash_dedup.near_duplicates(df, 3, 85).collect())))
    assert got == brute_near(rows, 3, 85)
    words = [f"{x}{k}" for k in range(40) for x in (a, b)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    for seed in (0, 1):
        assert len(set(common.span_hashes(data, starts, ends, seed).tolist())) == len(words)
    lines = [(1, a + "xyz" * 900), (2, b + "uvw" * 900), (3, "other")]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    assert {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in line_dedup.dedup_lines(df).collect()} == brute_lines(lines)


def test_hashes_do_not_depend_on_the_place():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdéfß") for _ in range(n)) for n in [*range(1, 40), 3000]]
    data = np.frombuffer(" ".join(words * 3).encode(), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    got = common.span_hashes(data, starts, ends).reshape(3, -1)
    assert (got == got[0]).all()
    assert len(set(got[0].tolist())) == len(set(words))


def test_lines_of_a_doc_id_with_two_texts(spark):
    """Each row loses its own lines."""
    rows = [(12, "shared line of the corpus\nunique line alpha beta"), (12, "unique line gamma delta\nshared line of the corpus"), (13, "shared line of the corpus\nthird unique line here")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lines = sorted(line for r in out for line in r.text.split("\n"))
    assert lines == ["shared line of the corpus", "third unique line here", "unique line alpha beta", "unique line gamma delta"]


def test_similarity_of_lines_is_exact():
    """Characters of any number, also more than fit a word."""
    import pyarrow as pa

    rng = random.Random(8)
    few = ["".join(rng.choice("abcÀ") for _ in range(rng.randrange(5, 60))) for _ in range(300)]
    many = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4200)) for _ in range(2)]
    x = [*few, many[0], many[0], "日本語テキスト", "aaaaaaaaaa", "abcd\nefg"]
    y = [*(f[:-1] + "b" for f in few), many[0][:4000], many[1], "日本語テキスト", "aaaaa", "abcd\nefg"]
    for percent in (80, 95):
        want = []
        for a, b in zip(x, y, strict=True):
            s, t = ({w.lower()[i : i + 5] for i in range(len(w) - 4)} for w in (a, b))
            want.append(100 * len(s & t) >= percent * len(s | t))
        low = [w.replace("À", "a") for w in x], [w.replace("À", "a") for w in y]
        assert line_dedup.similar(pa.array(low[0]), pa.array(low[1]), percent).tolist() == [
            100 * len(s & t) >= percent * len(s | t) for s, t in (({w[i : i + 5] for i in range(len(w) - 4)} for w in pair) for pair in zip(*low, strict=True))
        ]
        got = line_dedup.similar(pa.array(x[300:]), pa.array(y[300:]), percent).tolist()
        assert got == want[300:]


def test_recall_of_lines(spark, sf):
    """At least 99 % of the links between lines of the small documents table are found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r._n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: n for d, (_, _, n) in brute_lines(rows).items()}
    assert sum(got.values()) >= 0.99 * sum(want.values())
    assert sum(got[d] == n for d, n in want.items()) >= 0.99 * len(want)


def test_texts_longer_than_a_piece(spark):
    """One line and one document of more than a piece's bytes."""
    rng = random.Random(4)
    long = sentence(rng, 130_000)
    assert len(long) > common.PIECE
    rows = [(1, "short beginning of it\n" + long), (2, long + "\nshort beginning of it"), (3, long.upper()), (4, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 2), 3: ("", 1), 4: ("word", 0)}
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_line_cases(odd, empty, odd_rows):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(odd_rows)
    assert set(odd.columns) < set(out.columns)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_components(spark):
    """Stars, a long path, a cycle and self-loops."""
    edges = [(1, 2), (2, 2), *[(10, k) for k in range(11, 60)], *[(k, k + 1) for k in range(100, 160)], (200, 201), (201, 202), (202, 200), (7, 160)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.component for r in common.components(common.Scratch(spark, "t"), df).collect()}
    want = {1: 1, 2: 1, **dict.fromkeys(range(10, 60), 10), **dict.fromkeys(range(100, 161), 7), 7: 7, **dict.fromkeys((200, 201, 202), 200)}
    assert found == want
