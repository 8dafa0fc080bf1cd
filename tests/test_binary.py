"""Frames, nested records, deltas, envelopes, containers."""

from __future__ import annotations

import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fieldframe.sources import binary, container, values
from fieldframe.sources.values import RecordError


def test_golden_frame():
    rec = [(23, "sa", ["admin", "dev"]), (12, "i", 14532), (7, "b", True)]
    assert binary.write_frame(rec).hex() == "040003" + "070003" + "01" + "0c0001" + "c4f100" + "170005" + "02" + "05" + "61646d696e" + "03" + "646576"
    assert binary.read_frame(binary.write_frame(rec)) == values.sort(rec)


@pytest.mark.parametrize(("n", "want"), [(0, "00"), (63, "3f"), (64, "c000"), (-64, "40"), (-65, "bf7f"), (127, "ff00"), (128, "8001"), (-1, "7f"), (2**63 - 1, "ffffffffffffffffff00"), (-(2**63), "8080808080808080807f")])
def test_varint(n, want):
    assert binary.varint(n).hex() == want
    assert binary.Bytes(binary.varint(n)).varint() == n


def test_envelope():
    env = {"timestamp_ms": 1732373147000, "source": "auth-service", "trace_id": "abc-123-xyz", "sequence": 42}
    data = binary.write_envelope(env)
    assert data.hex() == "10000800000193597c6d7811000c617574682d7365727669636512000b6162632d3132332d78797a130008000000000000002a"
    assert binary.read_envelope(data) == env
    with pytest.raises(RecordError):
        binary.read_envelope(data[11:] + data[:11])


def test_xor():
    assert binary.xor_words(b"hello world") == 0x037F2975


def test_xor_column(spark):
    from pyspark.sql import functions as F

    from fieldframe.functions import checksum

    assert spark.range(1).select(checksum.xor_words(F.lit(b"hello world"))).first()[0] == 0x037F2975


NESTED = [(7, "b", True), (12, "i", -5), (50, "r", [(1, "s", "x"), (2, "ra", [[(20, "i", 1)], [(20, "fa", [1.5])]])])]


def test_nested():
    assert binary.read_value("r", binary.Bytes(binary.write_nested(NESTED)[1:])) == NESTED
    with pytest.raises(RecordError):
        binary.write_frame(NESTED)
    with pytest.raises(RecordError):
        binary.write_nested(NESTED, max_depth=2)


@pytest.mark.parametrize(("data", "want"), [("05", "UnsupportedVersion"), ("0400", "UnexpectedEof"), ("04000101", "UnexpectedEof"), ("0400010100ff", "InvalidTypeTag"), ("04007f", "InvalidValue"), ("040000aa", "TrailingData"), ("0400010100030 2".replace(" ", ""), "InvalidValue")])
def test_bad_frames(data, want):
    with pytest.raises(RecordError) as e:
        binary.read_frame(bytes.fromhex(data))
    assert e.value.row["class"] == want


def test_only_and_order():
    data = binary.write_frame([(1, "i", 1), (2, "s", "x")])
    assert binary.read_frame(data, only={2}) == [(2, "s", "x")]
    swapped = bytes.fromhex("040002" + "020001" + "01" + "010001" + "01")
    assert len(binary.read_frame(swapped)) == 2
    with pytest.raises(RecordError):
        binary.read_frame(swapped, sorted_only=True)


def test_hybrid():
    body = struct.pack("<HB", 5, 0x09) + bytes([0]) + binary.varint(2) + struct.pack("<2i", 7, -8)
    assert binary.read_frame(bytes([4, 0]) + binary.varint(1) + body) == [(5, "ia", [7, -8])]


def test_delta_vector_and_stream():
    ops = [(1, "Set", b"\x01\x05"), (9, "Delete", b"")]
    assert binary.read_delta(binary.write_delta(ops)) == ops
    assert binary.read_vector(binary.write_vector([1.0, -2.5])) == [1.0, -2.5]
    assert binary.read_vector_delta(binary.write_vector_delta(3, [(1, 0.5)])) == (3, [(1, 0.5)])
    assert binary.read_stream_frame(binary.write_stream_frame("Chunk", b"hello world")) == ("Chunk", b"hello world", 0x037F2975)


HEAD = container.MAGIC


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"XXXX" + bytes([1, 1, 0, 0, 0, 0, 0, 0]), "InvalidMagic"),
        (HEAD + bytes([255, 1, 0, 0, 0, 0, 0, 0]), "UnsupportedVersion"),
        (HEAD + bytes([1, 255, 0, 0, 0, 0, 0, 0]), "UnknownMode"),
        (HEAD + bytes([1, 1, 0, 2, 0, 0, 0, 0]), "ReservedFlags"),
        (HEAD + bytes([1, 1, 0, 0, 0, 0, 0, 9]), "TruncatedMetadata"),
        (HEAD + bytes([1, 3, 0, 0, 0, 0, 0, 0]), "InvalidMetadataLength"),
        (HEAD + bytes([1, 4, 0, 0, 0, 0, 0, 0]), "InvalidMetadataLength"),
        (HEAD + bytes([1, 4, 0, 0, 0, 0, 0, 10]) + bytes.fromhex("00000000000f4240ff00"), "InvalidMetadataValue"),
        (HEAD + bytes([1, 4, 0, 0, 0, 0, 0, 10]) + bytes.fromhex("00000000000f424001ff"), "InvalidMetadataValue"),
        (HEAD, "TruncatedHeader"),
    ],
)
def test_bad_containers(spark, data, want):
    from pyspark.sql import functions as F

    with pytest.raises(RecordError) as e:
        container.unwrap(data)
    assert e.value.row["class"] == want
    assert spark.createDataFrame([(bytearray(data),)], "d binary").select(container.header(F.col("d"))["error"]).first()[0] == want


@pytest.mark.parametrize("mode", ["Text", "Binary", "Stream"])
def test_containers(mode):
    rec = [(7, "b", True), (12, "s", "x")]
    found = container.decode(container.encode(rec, mode))
    assert values.record_text(found) == values.record_text(rec)


def test_data_source(spark, tmp_path):
    container.register(spark)
    rows = spark.createDataFrame([("F1=a\nF2=5",), ("F3=b",)], "canonical string").coalesce(1)
    rows.write.format("records").option("mode", "Binary").mode("append").save(str(tmp_path / "c"))
    (tmp_path / "c" / "bad.rec").write_bytes(b"XXXXXXXXXXXX")
    found = spark.read.format("records").load(str(tmp_path / "c"))
    assert {(r.canonical, r.error) for r in found.collect()} == {("F1=a\nF2=5", None), ("F3=b", None), (None, "InvalidMagic")}
    loaded = container.load(spark, str(tmp_path / "c")).collect()
    assert {r.canonical for r in loaded} == {"F1=a\nF2=5", "F3=b", None}


@given(st.lists(st.tuples(st.integers(0, 65535), st.one_of(st.tuples(st.just("i"), st.integers(-(2**63), 2**63 - 1)), st.tuples(st.just("s"), st.text(max_size=8)), st.tuples(st.just("fa"), st.lists(st.floats(allow_nan=False), max_size=3)), st.tuples(st.just("ba"), st.lists(st.booleans(), max_size=3)))), max_size=8))
def test_frame_round_trip(xs):
    rec = [(fid, *x) for fid, x in xs]
    assert binary.read_frame(binary.write_frame(rec)) == values.sort(rec)


def test_writer_leaves_only_what_is_committed(tmp_path):
    """Attempts that are not accepted leave nothing, also when another job has failed."""
    w = container.RecordsWriter({"path": str(tmp_path)})
    rows = [{"canonical": f"F1={k}"} for k in range(3)]
    kept, lost = w.write(iter(rows)), w.write(iter(rows))
    assert kept.folder != lost.folder
    assert not list(tmp_path.glob("*.rec"))
    w.commit([kept, None])
    assert len(list(tmp_path.rglob("*.rec"))) == 3
    w.write(iter(rows))
    w.abort([])
    assert len(list(tmp_path.rglob("*.rec"))) == 3


def test_bytes_that_are_no_text_are_error_rows(spark):
    bad = bytes([0x11, 0, 2, 0xC3, 0x28])
    df = spark.createDataFrame([(1, bytearray(bad)), (2, bytearray(binary.write_envelope({"source": "a"})))], "id int, d binary")
    got = {r.id: (r.envelope, r.error) for r in binary.decode_envelope(df, "d", "id").collect()}
    assert got[1][0] is None and got[1][1]["class"] == "InvalidUtf8"
    assert got[2][0].source == "a" and got[2][1] is None


def test_values_that_are_gone_past():
    """A reader of one field ends where a reader of all fields does, for every type."""
    rec = [(1, "i", -5), (2, "f", 1.5), (3, "b", True), (4, "s", "é"), (5, "sa", ["a", ""]), (6, "ia", [1, 300]), (7, "fa", [0.5]), (8, "ba", [True, False]), (9, "v", b"abc")]
    data = binary.write_frame(rec)
    assert len(data) == binary.frame_size(rec)
    for fid, tag, v in rec:
        assert binary.read_frame(data, only={fid}) == [(fid, tag, v)]
    assert binary.read_frame(data, only={99}) == []
    assert binary.supports_nested([1, 6]) and not binary.supports_nested([1, 5])
