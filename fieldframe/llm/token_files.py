"""Token ids as Parquet files, and reading them back.

File format: Parquet of (doc_id long, n_tokens int, local_start long, ids list<int>), rows in ascending doc_id order,
part files in that order too. Ids are delta-encoded (data page v2, dictionary off for ids), the doc_id and count
columns too; row groups and pages have set sizes, and the writer adds column and offset indexes, so a reader that wants
counts or a doc_id range touches only those pages. `local_start` is the number of ids before the document in its file;
with one number for each file it gives the place in the whole sequence without a window over all rows.

Documents are range-partitioned by doc_id before they are encoded, so the wide column is never sorted or moved. A word
is encoded by the library once for each Python worker: the pre-tokenizer splits at white space, so a text's ids are its
words' ids in turn, gathered for a piece of text at a time. The memo has a fixed bound.

Cases: null and empty texts have the end id alone; repeated doc_ids stay next to each other, ordered by text; rows with
a null doc_id come first; an empty table gives no rows; texts are encoded whole; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, U64, Scratch, pick, pieces, span_hashes, utf8, word_spans

SCHEMA = "doc_id long, n_tokens int, local_start long, ids array<int>"
END_ID = 1
#: Words that a Python worker remembers.
MEMO = 500_000

#: Files whose starts may be broadcast: under 100 bytes each.
MOST_BROADCAST = 100_000

_tokenizers: dict = {}

#: What a byte is to a run of characters: 0 a letter up to U+00FF or a part of one, 1 any other.
_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = _OTHER[0x80:0xC0] = _OTHER[0xC3] = False


class Memo:
    """Ids by word: an open-addressed table whose rows are a word's 64-bit hash, a second hash to tell a collision, the
    place of its ids in a pool and the last clearing before its use; a row is one line of the processor's cache. It holds
    at most about `most` words; beyond that, words not used since the last clearing go."""

    def __init__(self, most: int):
        self.most, self.age = most, 0
        self.size = 1 << max(10, (2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.rows = np.zeros((self.size, 4), np.uint64)
        self.pool = np.empty(1024, np.int32)
        self.count = self.filled = 0
        self.age += 1

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the place and number of its ids; -1: unknown, -2: another word has its first hash."""
        slot = (h1 & U64(self.size - 1)).astype(np.int64)
        rows = self.rows[slot]
        left = np.flatnonzero((rows[:, 2] != 0) & (rows[:, 0] != h1))
        at = slot[left]
        while len(left):
            at = (at + 1) & (self.size - 1)
            rows[left] = more = self.rows[at]
            slot[left] = at
            again = (more[:, 2] != 0) & (more[:, 0] != h1[left])
            left, at = left[again], at[again]
        self.rows[slot, 3] = self.age
        n = (rows[:, 2] & U64((1 << 24) - 1)).astype(np.int64)
        place = (rows[:, 2] >> U64(25)).astype(np.int64)
        place[rows[:, 1] != h2] = -2
        place[rows[:, 2] == 0] = -1
        return place, n

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, place: np.ndarray, n: np.ndarray) -> None:
        """Words that are not there, each once: n of the ids, from that place, are a word's."""
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(self.filled + len(ids), np.int32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        first = (self.filled + place).astype(np.uint64)
        self.count, self.filled = self.count + len(h1), self.filled + len(ids)
        # bit 24 tells a row with no ids from none
        self._place(np.stack([h1, h2, (first << U64(25)) | U64(1 << 24) | n.astype(np.uint64), np.full(len(h1), self.age, np.uint64)], 1))

    def _place(self, rows: np.ndarray) -> None:
        slot = (rows[:, 0] & U64(self.size - 1)).astype(np.int64)
        while len(rows):
            free = self.rows[slot, 2] == 0
            self.rows[slot[free]] = rows[free]  # of several for one place the last stays
            left = self.rows[slot, 0] != rows[:, 0]
            rows, slot = rows[left], (slot[left] + 1) & (self.size - 1)

    def trim(self) -> None:
        if self.count <= self.most:
            return
        keep = self.rows[(self.rows[:, 2] != 0) & (self.rows[:, 3] == self.age)]
        if len(keep) > self.most // 2:
            keep = keep[:0]
        n, first = (keep[:, 2] & U64((1 << 24) - 1)).astype(np.int64), (keep[:, 2] >> U64(25)).astype(np.int64)
        at = np.cumsum(n) - n
        ids = self.pool[np.arange(n.sum()) + np.repeat(first - at, n)]
        self.clear()
        if len(keep):
            self.add(keep[:, 0], keep[:, 1], ids, at, n)
            self.rows[:, 3] = 0


class WordEncoder:
    """ids of whole texts by way of their words. The library decides every word's ids; what is remembered is only the
    outcome for a run of characters between white space, or for its letters and the last comma or stop apart, which
    the pre-tokenizer splits too."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo = Memo(MEMO)
        vocabulary = self.library.get_vocab()
        #: Which ids end a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.stop = {c: np.array(self.library.encode(chr(c), add_special_tokens=False).ids, np.int32) for c in b",."}

    def _ask(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a row, and for each word the place of its ids there and their number. Words of letters are one pre-token
        each and have one token with a word's end each, so many of them are one text for the library, cut at those tokens.
        Of other ASCII words many are one text too, cut by the tokens' places."""
        place, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, filled = [np.empty(0, np.int32)], 0

        def held(some: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> int:
            place[some], n[some] = filled + cuts[:-1], np.diff(cuts)
            parts.append(ids)
            return filled + len(ids)

        ascii_ = np.array([w.isascii() for w in words], bool)
        at = np.flatnonzero(plain)
        chunks = [at[k : k + 500] for k in range(0, len(at), 500)]
        texts = [b" ".join([words[i] for i in some.tolist()]).decode() for some in chunks]
        left = np.flatnonzero(~plain & ~ascii_).tolist()
        for some, e in zip(chunks, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                left += some.tolist()
                continue
            filled = held(some, ids, np.concatenate([[0], ends]))
        at = np.flatnonzero(~plain & ascii_)
        for k in range(0, len(at), 500):
            some = at[k : k + 500]
            e = self.library.encode(b" ".join([words[i] for i in some.tolist()]).decode(), add_special_tokens=False)
            begins = np.cumsum([0, *(len(words[i]) + 1 for i in some.tolist())])
            filled = held(some, np.array(e.ids, np.int32), np.searchsorted(np.array([a for a, _ in e.offsets]), begins))
        if left:
            alone = [e.ids for e in self.library.encode_batch_fast([words[i].decode() for i in left], add_special_tokens=False)]
            held(np.array(left), np.array([x for ids in alone for x in ids], np.int32), np.cumsum([0, *map(len, alone)]))
        return np.concatenate(parts), place, n

    @staticmethod
    def _plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with letters up to U+00FF as small ones, and which bytes are no such letter. Each has one small
        letter and no other normal form."""
        other = _OTHER[data]
        low = FOLD[data]
        if (data >= 0x80).any():
            after = np.concatenate([[False], data[:-1] == 0xC3])
            tail = (data >= 0x80) & (data < 0xC0)
            other |= tail & (~after | (data == 0x97) | (data == 0xB7))
            low[after & (data < 0x9F) & (data != 0x97)] += 0x20
        return low, other

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and their offsets by text."""
        starts, ends, first = word_spans(data, offs)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offs), np.int64)
        low, other = self._plain(data)
        bad = np.concatenate([[0], np.cumsum(other)])
        last = data[ends - 1]
        cut = ends - (((last == 44) | (last == 46)) & (ends - starts > 1))
        plain = bad[cut] == bad[starts]
        ends, stop = np.where(plain, cut, ends), np.where(plain & (cut < ends), last, 0)
        h1, h2 = self._hashes(low, data, starts, ends, plain)
        self.memo.trim()
        at, n = self.memo.find(h1, h2)
        new = np.flatnonzero(at == -1)
        if len(new):
            some, which = np.unique(h1[new], return_index=True)
            rep = new[which]
            texts = data.tobytes(), low.tobytes()
            words = [texts[p][a:b] for a, b, p in zip(starts[rep].tolist(), ends[rep].tolist(), plain[rep].tolist(), strict=True)]
            self.memo.add(some, h2[rep], *self._ask(words, plain[rep]))
            at[new], n[new] = self.memo.find(h1[new], h2[new])
        pool = self.memo.pool
        odd = np.flatnonzero(at < 0)  # words whose first hash another has
        if len(odd):
            asked, place, n[odd] = self._ask([(low if plain[i] else data)[starts[i] : ends[i]].tobytes() for i in odd], plain[odd])
            at[odd] = self.memo.filled + place
            pool = np.concatenate([pool[: self.memo.filled], asked])
        more = np.zeros(len(n), np.int64)
        for c, ids in self.stop.items():
            more[stop == c] = len(ids)
        offset = np.concatenate([[0], np.cumsum(n + more)])
        out = np.empty(offset[-1], np.int32)
        before = np.cumsum(n) - n
        every = np.arange(n.sum())
        found = pool[every + np.repeat(at - before, n)]
        every += np.repeat(offset[:-1] - before, n)
        out[every] = found
        for c, ids in self.stop.items():
            ends_at = offset[1:][stop == c]
            for k, x in enumerate(ids):
                out[ends_at - len(ids) + k] = x
        return out, offset[first]

    @staticmethod
    def _hashes(low: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each word: of its small letters if it is plain, else of its bytes."""
        out = []
        rest = np.flatnonzero(~plain)
        for seed in (1, 2):
            h = span_hashes(low, starts, ends, seed)
            if len(rest):
                h[rest] = span_hashes(data, starts[rest], ends[rest], seed)
            out.append(h)
        return out[0], out[1]


def _encode(path: str, end_id: int):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizers.get(path) or _tokenizers.setdefault(path, WordEncoder(path))
        start = 0
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for i, j in pieces(offs, 1 << 18):
                ids, at = encoder.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                out = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(np.diff(at), pa.int32()), pa.array(start + at[:-1]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out))], ["doc_id", "n_tokens", "local_start", "ids"])
                start += int(at[-1])

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_group: int = 32 << 20, page: int = 256 << 10) -> None:
    """Encode docs(doc_id, text) to files under `path`; row_group and page are in bytes."""
    ordered = pick(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.block.size": row_group,
        "parquet.page.size": page,
        "parquet.page.write-checksum.enabled": "true",
    }
    encoded.write.options(**options).parquet(path)


#: The numbers of the task and of its file in a part file's name.
FILE = re.compile(r"part-(\d+)-.*?c(\d+)\.")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids in all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    # one row for each file, from the two metadata columns alone
    ends = rows.groupBy("file").agg(F.min("local_start").alias("first"), F.max(F.col("local_start") + F.col("n_tokens")).alias("last"))
    # a task's files, and the tasks, are numbered in doc_id order; a task counts on through its files
    totals = sorted((*map(int, FILE.search(r["file"]).groups()), r["file"], r["first"], r["last"]) for r in ends.collect())
    before, sums = 0, []
    for _, _, file, first, last in totals:
        sums.append((file, before - first))
        before += last - first
    starts = spark.createDataFrame(sums or [("", 0)], "file string, before long")
    # one short row a file; past that many files the ids are merged with it by file
    starts = F.broadcast(starts) if len(sums) <= MOST_BROADCAST else starts.hint("merge")
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offs = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_token_files' rows."""
    return tokens.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token files in the shared folder, read them back and return their digest."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    write_token_files(docs, f"{scratch.root}/ids", tokenizer)
    return digest(read_token_files(spark, f"{scratch.root}/ids"))
