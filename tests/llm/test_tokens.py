from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from fieldframe.llm import token_files

PATH = P.path("word_bpe_49k.json")


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, x in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["a<|endoftext|>b <|ENDOFTEXT|> x", "can't WON'T it's.", "x\x1cy\x1d z", "a b c\x85d", "é İx ΑΣ Σ.", "12345 3.14, a,b.c ab., ab.", "ＦＵＬＬ ﬁ ½", "​zero﻿width", "word." * 50, "emoji 😀👍🏽 ok"]


def test_round_trip(spark, odd, odd_rows):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(ODD)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")).repartition(3)
    assert sorted(map(tuple, token_files.token_digest(df, PATH).collect())) == sorted(brute(rows))


def test_empty(empty):
    assert token_files.token_digest(empty, PATH).count() == 0


def test_files(spark, odd, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "t"), PATH)
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    last = None
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_column_index and col.has_offset_index
                assert "DELTA_BINARY_PACKED" in col.encodings
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
        assert last is None or not ids or ids[0] >= last
        last = ids[-1] if ids else last
    some = token_files.read_token_files(spark, str(tmp_path / "t")).where("doc_id = 9").select("n_tokens")
    assert "ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 10)
    e = token_files.WordEncoder(PATH)
    texts = [f"word{k} other{k} Ünder Point{'abcdefghij'[k % 10]}. x{k % 3}," for k in range(50)]
    whole = Tokenizer.from_file(PATH)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, offs = e.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids == ids[: offs[1]].tolist()
        assert e.memo.count <= 10 + 6


def test_words_that_share_a_hash(monkeypatch):
    """Words are told apart by a second hash where the first is the same."""
    real = token_files.span_hashes
    monkeypatch.setattr(token_files, "span_hashes", lambda d, a, b, seed=0: real(d, a, b, seed) % np.uint64(3) if seed == 1 else real(d, a, b, seed))
    e = token_files.WordEncoder(PATH)
    t = "one two three four five six, seven eight. nine ten one two 3.5 six,"
    raw = np.frombuffer(t.encode(), np.uint8)
    assert e.encode(raw, np.array([0, len(raw)]))[0].tolist() == Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids


def test_starts_with_several_files_a_task(spark, odd, odd_rows):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        got = sorted(map(tuple, token_files.token_digest(odd.repartition(2), PATH).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == sorted(brute(odd_rows))


def test_files_are_ordered_by_number():
    names = ["part-100000-x-c000.zstd.parquet", "part-99999-x-c000.zstd.parquet", "part-99999-x-c010.zstd.parquet", "part-99999-x-c1000.zstd.parquet"]
    got = sorted(names, key=lambda n: tuple(map(int, token_files.FILE.search(n).groups())))
    assert got == [names[1], names[2], names[3], names[0]]


def test_long_text(spark):
    """Longer than a piece."""
    text = "A river, light under winter. 42 ñandú " * 40_000
    rows = [(1, "x"), (2, text), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, token_files.token_digest(df, PATH).collect())) == brute(rows)
