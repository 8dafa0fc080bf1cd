"""Spatial bytes, dictionaries, bodies and Kafka records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import records
from fieldframe.sources import binary, dictionary, space, wire
from fieldframe.sources.values import RecordError


@pytest.mark.parametrize(
    ("kind", "value"),
    [("position2d", [1.0, 2.0]), ("position", [1.0, 2.0, 3.0]), ("rotation", [0.5, 0.25, 0.0]), ("velocity", [1.0, 0.0, 0.0]), ("acceleration", [0.0, 0.0, -1.0]), ("box", [0.0] * 6), ("quaternion", [0.0, 0.0, 0.0, 1.0]), ("path", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), ("path", []), ("transform", [float(x) for x in range(9)]), ("state", {"position": [1.0, 2.0, 3.0], "rotation": None, "velocity": None, "acceleration": [0.0, 0.0, 1.0]}), ("position_delta", [1.0, -1.0, 2.0]), ("rotation_delta", [0.0, 0.0, 0.5]), ("delta", ("position", [1.0, 2.0, 3.0])), ("delta", ("state", {"position": None, "rotation": [1.0, 1.0, 1.0], "velocity": None, "acceleration": None}))],
)
def test_space(kind, value):
    assert space.read(space.write(kind, value)) == (kind, value)


def test_space_errors_and_columns(spark):
    for bad in (b"", b"\xff", b"\x02\x00", b"\x0d\x09"):
        with pytest.raises(RecordError):
            space.read(bad)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], "id int, v array<float>")
    data = space.encode_column(df, "position", "v", "id")
    got = {r.id: r for r in space.decode_column(data, "data", "id").collect()}
    assert got[1].value.points == [[1.0, 2.0, 3.0]]
    assert got[2].value is None


YAML = "version: 1\nfields:\n  12:\n    name: user_id\n    type: int\n    importance: 200\n  50:\n    name: status\n    equivalences:\n      F: finished\n      \"o\": open\n"


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.yaml").write_text(YAML)
    d = dictionary.load(spark, str(tmp_path / "d.yaml"))
    assert sorted(map(tuple, d.names.collect())) == [(12, "user_id"), (50, "status")]
    assert list(map(tuple, d.importance.collect())) == [(12, 200)]
    assert sorted(map(tuple, d.equivalences.collect())) == [(50, "F", "finished"), (50, "o", "open")]
    more = dictionary.add(d, importance=spark.createDataFrame([(12, 9), (50, 1)], "fid int, importance int"))
    assert sorted(map(tuple, more.importance.collect())) == [(12, 9), (50, 1)]
    for bad, want in (("fields:\n  1:\n    type: int\n", "ParseError"), ("x: 1\n", "ParseError"), ("fields:\n  1:\n    name: a\n  1:\n    name: b\n", "DuplicateFieldId"), ("fields:\n  1:\n    name: a\n    importance: 300\n", "ParseError"), ("fields:\n  70000:\n    name: a\n", "ParseError"), ("fields:\n  1:\n    name: a\n    type: zebra\n", "InvalidType")):
        with pytest.raises(RecordError) as e:
            dictionary.parse(bad)
        assert e.value.row["class"] == want


def test_bodies(spark):
    frame = binary.write_frame([(7, "b", True)])
    df = spark.createDataFrame([(1, bytearray(frame), "application/x-binary"), (2, bytearray(b"F7:b=1"), "text/plain"), (3, bytearray(b""), "image/png")], "id int, body binary, ct string")
    got = {r.id: r for r in wire.from_body(df, "body", "ct", "id").collect()}
    assert got[1].fields[0].b is got[2].fields[0].b is True
    assert got[3].error["class"] == "UnsupportedContentType"


def test_kafka(spark):
    env = F.struct(F.lit(5).cast("long").alias("timestamp_ms"), F.lit("svc").alias("source"), F.lit("t").alias("trace_id"), F.lit(9).cast("long").alias("sequence"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"))
    df = spark.range(2).select("id", records.record((12, "i", F.col("id"))).alias("rec"), env.alias("env"))
    sent = wire.to_kafka(df, "rec", "env", F.col("id").cast("string"), "id")
    got = wire.from_kafka(sent, "id").orderBy("id").collect()
    assert [(r.id, r.fields[0].i, r.envelope.source, r.envelope.labels) for r in got] == [(0, 0, "svc", {"a": "b"}), (1, 1, "svc", {"a": "b"})]


def test_check_text(spark):
    reg = spark.createDataFrame([(12, "user_id", "Int", "Core", "ACTIVE"), (13, "old", "String", "Core", "DEPRECATED")], "fid int, name string, expected string, range string, status string")
    df = spark.createDataFrame([(1, "F12=1;F13=x;F14=2"), (2, "F12=x"), (3, "F")], "id int, t string")
    got = sorted(map(tuple, wire.check_text(df, "t", reg, "id").collect()), key=repr)
    assert got == [(1, 13, "Deprecated"), (1, 14, "Unknown"), (2, 12, "TypeMismatch"), (3, None, "UnexpectedToken")]
