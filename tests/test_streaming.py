"""Receivers: plain, in batch and in a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldframe.streaming import chunks, messages, receiver


def frame(seq, mode, x, vx=None, ok=True):
    return {"seq": seq, "mode": mode, "x": x, "y": 0.0, "z": 0.0, "vx": vx, "vy": 0.0, "vz": 0.0, "ok": ok}


def test_loss():
    state: dict = {}
    steps = [receiver.receive(state, f) for f in (frame(0, "ABS", 1.0, 1000.0), frame(1, "DELTA", 1.0), frame(4, "DELTA", 1.0), frame(5, "ABS", 9.0), frame(7, "DELTA", 1.0))]
    assert [s["x"] for s in steps[:4]] == [1.0, 2.0, 5.0, 9.0]
    assert [s["predicted"] for s in steps] == [False, False, True, False, False]
    assert steps[4]["error"] == "PacketLoss"


def test_errors_leave_the_state():
    state: dict = {}
    assert receiver.receive(state, frame(0, "DELTA", 1.0))["error"] == "NoAbsoluteState"
    assert receiver.receive(state, frame(0, "ABS", 1.0, ok=False))["error"] == "ChecksumMismatch"
    assert state == {}
    receiver.receive(state, frame(3, "ABS", 1.0))
    assert receiver.receive(state, frame(2, "DELTA", 1.0))["x"] == 2.0
    assert state["last"] == 2
    assert receiver.receive(state, frame(9, "DELTA", 1.0, 1.0), strict_reference=True)["error"] == "PacketLoss"


def test_prediction_limit():
    state: dict = {}
    receiver.receive(state, frame(0, "ABS", 0.0, 1.0))
    found = [receiver.receive(state, frame(seq, "DELTA", 0.0))["error"] for seq in (2, 4, 6, 8)]
    assert found == [None, None, None, "PredictionLimit"]


def test_chunk_machine():
    state: dict = {}
    step = lambda kind, size=0, ok=True: receiver.chunk(state, {"seq": 0, "kind": kind, "size": size, "ok": ok})
    assert step("Chunk")["error"] == "StreamNotStarted"
    assert step("Begin")["event"] == "StreamStarted"
    assert step("Begin")["error"] == "UnexpectedFrame"
    assert step("Chunk", 5)["total"] == 5
    assert step("Chunk", 5, False)["error"] == "ChecksumMismatch"
    assert step("End")["event"] == "StreamComplete"
    assert step("Chunk")["error"] == "StreamAlreadyComplete"
    assert step("Error")["event"] == "StreamError"


def test_reassembly_errors(spark):
    rows = [("a", b"x" * 2500), ("b", b""), ("c", b"y" * 2500)]
    frames = chunks.split(spark.createDataFrame(rows, "k string, p binary"), "p", "k", chunk=1000)
    assert frames.where("k = 'a'").count() == 5
    broken = frames.where("not (k = 'c' and seq = 2)")
    got = {r.k: (r.payload and bytes(r.payload), r.error) for r in chunks.reassemble(broken, "k").collect()}
    assert got == {"a": (b"x" * 2500, None), "b": (b"", None), "c": (None, "MissingChunk")} or got["c"] == (None, "MissingChunk")
    assert got["a"] == (b"x" * 2500, None)


def test_batch_is_stream(spark, tmp_path):
    rows = [(k, s, "ABS" if s % 5 == 0 else "DELTA", 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, True) for k in range(3) for s in range(12) if not (k == 1 and s == 6)]
    df = spark.createDataFrame(rows, "k int, " + receiver.FRAME)
    want = sorted(map(tuple, receiver.run_batch(df, "k", "seq", receiver.receive, receiver.STATE_OUT).collect()), key=repr)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = receiver.run_stream(stream, "k", "seq", receiver.receive, receiver.STATE_OUT)
    q = out.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(tuple, spark.table("frames").collect()), key=repr) == want


def test_messages(spark, sf, tmp_path):
    from fieldframe.plans import tables

    m = tables.msg(spark, sf).withColumns({"ttl_ms": F.lit(5000), "sequence": F.col("event_id")})
    m.coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = messages.deduplicated(messages.with_event_time(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m"))))
    got: dict[str, int] = {}

    def sink(name):
        return lambda batch, number: got.__setitem__(name, got.get(name, 0) + batch.count())

    now = m.agg({"timestamp_ms": "max"}).first()[0]
    q = messages.fan_out(messages.decided(stream, now), {d: sink(d) for d in ("Drop", "SendToLLM", "ProcessLocally")}).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sum(got.values()) == m.count()
    batch = messages.metrics(messages.with_event_time(messages.decided(m, now)), "1 day")
    assert batch.agg({"n": "sum"}).first()[0] == m.count()


def test_windows_in_a_stream(spark, sf):
    from fieldframe.plans import tables

    m = messages.decided(tables.msg(spark, sf).withColumn("ttl_ms", F.lit(5000)), tables.NOW)
    m = messages.with_event_time(m)
    assert messages.sessions(m).agg({"n": "sum"}).first()[0] == m.count()
    assert messages.metrics(m, "1 day", "12 hours").agg({"n": "sum"}).first()[0] == pytest.approx(2 * m.count())
