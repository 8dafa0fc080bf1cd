"""CRC-32 of field values and word checksums of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def show(value: Column) -> Column:
    """Eight upper-case hexadecimal digits."""
    return F.lpad(F.hex(value), 8, "0")


def read(text: Column) -> Column:
    """The number of eight hexadecimal digits with or without 0x before them, else null."""
    bare = F.regexp_replace(text, "^0[xX]", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{8}$"), F.conv(bare, 16, 10).cast("long"))


def field_checksum(fid: Column, hint: Column | None, value: Column) -> Column:
    """Of `fid:hint:value`, or `fid:value` without a hint."""
    parts = [fid.cast("string"), *([hint] if hint is not None else []), value]
    return crc(F.concat_ws(":", *parts))


def xor_words(data: Column) -> Column:
    """Exclusive or of the little-endian 32-bit words, the last one filled up with zeros. An Arrow kernel: words of many
    bytes at a time, where an expression would go through hexadecimal text word by word."""

    @F.arrow_udf("bigint")
    def run(col: pa.Array) -> pa.Array:
        col = col.cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :].tolist()
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        out = []
        for a, b in zip(offs, offs[1:], strict=False):
            whole = b - (b - a) % 4
            words = int(np.bitwise_xor.reduce(np.frombuffer(raw[a:whole].tobytes(), "<u4"), initial=0))
            out.append(words ^ int.from_bytes(raw[whole:b].tobytes(), "little"))
        return pa.array(out, pa.int64(), mask=np.asarray(col.is_null()))

    return run(data)
