"""The container: a 12-byte header (magic, version, mode, flags, length of metadata), metadata, payload. `register` adds
the data source `records`, which reads a folder of containers as rows and writes rows as containers."""

from __future__ import annotations

import glob
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import binary, values
from .text import Options, read
from .values import RecordError

# The header's magic number, version, modes, the one flag, and metadata lengths.
MAGIC = bytes.fromhex("4c4e4d50")
CONTAINER_VERSION = 1
MODES = {1: "Text", 2: "Binary", 3: "Stream", 4: "Delta", 5: "QuantumSafe", 6: "Embedding", 7: "Spatial"}
CHECKSUM_FLAG = 0x0001
METADATA = {"Stream": 6, "Delta": 10}


def header(data: Column) -> Column:
    """struct<mode, version, flags, metadata_length, error> of container bytes: an expression, it reads 22 bytes."""
    hexed = F.hex(F.substring(data, 1, 22))
    part = lambda a, n: F.conv(F.substring(hexed, 2 * a + 1, 2 * n), 16, 10).cast("long")
    code, flags, size = part(5, 1), part(6, 2), part(8, 4)
    mode = F.lit(None).cast("string")
    for k, name in MODES.items():
        mode = F.when(code == k, name).otherwise(mode)
    error = (
        F.when(F.octet_length(data) < 12, "TruncatedHeader")
        .when(F.substring(hexed, 1, 8) != MAGIC.hex().upper(), "InvalidMagic")
        .when(part(4, 1) != CONTAINER_VERSION, "UnsupportedVersion")
        .when(mode.isNull(), "UnknownMode")
        .when(flags.bitwiseAND(F.lit(~CHECKSUM_FLAG & 0xFFFF)) != 0, "ReservedFlags")
        .when(F.octet_length(data) - 12 < size, "TruncatedMetadata")
        .when(((mode == "Stream") & (size != 6)) | ((mode == "Delta") & (size != 10)), "InvalidMetadataLength")
        .when((mode == "Delta") & ((part(20, 1) > 1) | (part(21, 1) > 1)), "InvalidMetadataValue")
    )
    return F.struct(mode.alias("mode"), part(4, 1).alias("version"), flags.alias("flags"), size.alias("metadata_length"), error.alias("error"))


def stream_metadata(meta: Column) -> Column:
    h = F.hex(meta)
    return F.struct(F.conv(F.substring(h, 1, 8), 16, 10).cast("long").alias("chunk_size"), F.conv(F.substring(h, 9, 2), 16, 10).cast("int").alias("checksum_type"), F.conv(F.substring(h, 11, 2), 16, 10).cast("int").alias("flags"))


def delta_metadata(meta: Column) -> Column:
    h = F.hex(meta)
    return F.struct(F.conv(F.substring(h, 1, 16), 16, 10).cast("long").alias("base_snapshot"), F.conv(F.substring(h, 17, 2), 16, 10).cast("int").alias("algorithm"), F.conv(F.substring(h, 19, 2), 16, 10).cast("int").alias("compression"))


def wrap(payload: bytes, mode: str, metadata: bytes = b"", flags: int = 0) -> bytes:
    if flags & ~CHECKSUM_FLAG:
        raise RecordError("ReservedFlags", hex(flags))
    if mode in METADATA and len(metadata) != METADATA[mode]:
        raise RecordError("InvalidMetadataLength", f"{mode}: {len(metadata)}")
    code = next(k for k, v in MODES.items() if v == mode)
    return MAGIC + struct.pack(">BBHI", CONTAINER_VERSION, code, flags, len(metadata)) + metadata + payload


def unwrap(data: bytes) -> tuple[str, int, bytes, bytes]:
    """mode, flags, metadata, payload."""
    data = bytes(data)
    if len(data) < 12:
        raise RecordError("TruncatedHeader", str(len(data)))
    if data[:4] != MAGIC:
        raise RecordError("InvalidMagic", data[:4].hex())
    version, code, flags, size = struct.unpack(">BBHI", data[4:12])
    if version != CONTAINER_VERSION:
        raise RecordError("UnsupportedVersion", str(version))
    if code not in MODES:
        raise RecordError("UnknownMode", str(code))
    mode, meta = MODES[code], data[12 : 12 + size]
    if flags & ~CHECKSUM_FLAG:
        raise RecordError("ReservedFlags", hex(flags))
    if len(meta) < size:
        raise RecordError("TruncatedMetadata", f"{len(meta)} of {size}")
    if mode in METADATA and size != METADATA[mode]:
        raise RecordError("InvalidMetadataLength", f"{mode}: {size}")
    if mode == "Delta" and max(meta[8:10]) > 1:
        raise RecordError("InvalidMetadataValue", meta[8:10].hex())
    return mode, flags, meta, data[12 + size :]


def decode(data: bytes) -> values.Record:
    mode, _, _, payload = unwrap(data)
    if mode == "Text":
        return read(payload.decode(), Options())
    if mode in ("Binary", "Stream"):
        return binary.read_frame(payload)
    if mode == "Delta":
        return [(fid, "s", op) for fid, op, _ in binary.read_delta(payload)]
    raise RecordError("UnsupportedMode", mode)


def encode(rec: values.Record, mode: str = "Binary", flags: int = 0) -> bytes:
    if mode == "Text":
        return wrap(values.record_text(rec).encode(), mode, flags=flags)
    if mode in ("Binary", "Stream"):
        return wrap(binary.write_frame(rec), mode, struct.pack(">IBB", 4096, 2, 1) if mode == "Stream" else b"", flags)
    raise RecordError("UnsupportedMode", mode)


SCHEMA = f"path string, mode string, flags int, metadata binary, fields {values.FIELD_SCHEMA}, canonical string, error {values.ERROR_SCHEMA}"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Containers of a folder in any file system that Spark reads, decoded."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def one(data: bytes) -> dict:
        mode, flags, meta, _ = unwrap(data)
        rec = decode(data)
        return {"mode": mode, "flags": flags, "metadata": meta, "fields": values.field_rows(rec), "canonical": values.record_text(rec)}

    found = binary._over(files, ["path"], "content", "c", one, f"struct<mode:string,flags:int,metadata:binary,fields:{values.FIELD_SCHEMA},canonical:string>")
    return found.select("path", "c.*", "error")


# ---------------------------------------------------------------- the data source


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Part]:
        path = self.options["path"]
        files = sorted(f for f in glob.glob(os.path.join(path, "**", "*.rec"), recursive=True) if "_attempts" not in f) if os.path.isdir(path) else [path]
        size = int(self.options.get("filesPerPartition", "1000"))
        return [_Part(files[k : k + size]) for k in range(0, len(files), size)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        for path in part.paths:
            with open(path, "rb") as f:
                data = f.read()
            try:
                mode, flags, _, _ = unwrap(data)
                yield path, mode, flags, values.record_text(decode(data)), None
            except RecordError as e:
                yield path, None, None, None, e.row["class"]


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class RecordsWriter(DataSourceWriter):
    """A task writes to a folder of its own attempt; only commit moves the files of the attempts that Spark has accepted
    to the target, so a retried or speculative task leaves no record twice."""

    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "Binary")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = os.path.join(self.path, "_attempts", uuid.uuid4().hex)
        os.makedirs(folder)
        for n, row in enumerate(rows):
            with open(os.path.join(folder, f"{n:08d}.rec"), "wb") as f:
                f.write(encode(read(row["canonical"], Options(normalize=False)), self.mode))
        return _Written(folder)

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for name in sorted(os.listdir(m.folder)) if m else []:
                os.replace(os.path.join(m.folder, name), os.path.join(self.path, f"{os.path.basename(m.folder)}-{name}"))
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(os.path.join(self.path, "_attempts"), ignore_errors=True)


class RecordsSource(DataSource):
    """Paths are those of a mounted file system that all executors share; for others use `load`."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "path string, mode string, flags int, canonical string, error string"

    def reader(self, schema: object) -> RecordsReader:
        return RecordsReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> RecordsWriter:
        return RecordsWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordsSource)
