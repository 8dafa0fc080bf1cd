"""Ordered receivers: spatial frames, chunk streams and handshakes. Each is a plain state machine; `run_batch` runs one
over a table, `run_stream` over a stream, with a state of bounded size for each key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PARTS = ("x", "y", "z")

#: A frame of a spatial stream: mode ABS or DELTA, what it carries, whether its checksum held.
FRAME = "seq long, mode string, x double, y double, z double, vx double, vy double, vz double, ok boolean"
STATE_OUT = "seq long, x double, y double, z double, predicted boolean, error string"


def receive(state: dict, frame: dict, max_predicted: int = 3, predict: bool = True, strict_reference: bool = False) -> dict:
    """One spatial frame. ABS sets the state, DELTA adds to it. After a gap a DELTA is taken upon the predicted position,
    up to max_predicted times, else it is an error and the state stays. strict_reference: nothing predicts here, so
    every DELTA after a gap is an error. Frames that come late are applied, and set the sequence back."""
    out = {"seq": frame["seq"], "x": None, "y": None, "z": None, "predicted": False, "error": None}
    last, position, velocity = state.get("last"), state.get("position"), state.get("velocity")

    def fail(why: str) -> dict:
        return out | {"error": why}

    if frame["ok"] is False:
        return fail("ChecksumMismatch")
    if frame["mode"] == "ABS":
        position = [frame[p] or 0.0 for p in PARTS]
        velocity = None if frame["vx"] is None else [frame["v" + p] for p in PARTS]
        state["predictions"] = 0
    else:
        if last is not None and frame["seq"] > last + 1:
            if not predict or strict_reference or position is None or velocity is None:
                return fail("PacketLoss")
            state["predictions"] = state.get("predictions", 0) + 1
            if state["predictions"] > max_predicted:
                return fail("PredictionLimit")
            position = [p + v * 0.001 * (frame["seq"] - last - 1) for p, v in zip(position, velocity, strict=True)]
            out["predicted"] = True
        if position is None:
            return fail("NoAbsoluteState")
        position = [p + (frame[n] or 0.0) for p, n in zip(position, PARTS, strict=True)]
        velocity = velocity if frame["vx"] is None else [frame["v" + p] for p in PARTS]
    state.update(last=frame["seq"], position=position, velocity=velocity)
    return out | dict(zip(PARTS, position, strict=True))


CHUNK = "seq long, kind string, size long, ok boolean"
CHUNK_OUT = "seq long, event string, total long, error string"


def chunk(state: dict, frame: dict) -> dict:
    """One frame of a chunk stream: idle, streaming, complete or error."""
    now, kind = state.get("now", "idle"), frame["kind"]
    out = {"seq": frame["seq"], "event": None, "total": state.get("total", 0), "error": None}
    if kind == "Error":
        state.update(now="error")
        return out | {"event": "StreamError"}
    if kind == "Begin":
        if now == "streaming":
            return out | {"error": "UnexpectedFrame"}
        state.update(now="streaming", total=0)
        return out | {"event": "StreamStarted", "total": 0}
    if now != "streaming":
        return out | {"error": {"idle": "StreamNotStarted", "complete": "StreamAlreadyComplete"}.get(now, "UnexpectedFrame")}
    if kind == "Chunk":
        if frame["ok"] is False:
            return out | {"error": "ChecksumMismatch"}
        state["total"] = state.get("total", 0) + (frame["size"] or 0)
        return out | {"event": "ChunkReceived", "total": state["total"]}
    state["now"] = "complete"
    return out | {"event": "StreamComplete"}


MESSAGE = "seq long, message string"
MESSAGE_OUT = "seq long, state string, reply string, error string"
#: For each message of a handshake: states it may come in, the state after it, the reply.
HANDSHAKE = {
    "Initiate": (("Initial",), "CapabilitiesSent", "Capabilities"),
    "Capabilities": (("Initial", "CapabilitiesSent"), "CapabilitiesReceived", "CapabilitiesAck"),
    "CapabilitiesAck": (("CapabilitiesSent",), "CapabilitiesReceived", "SelectSchema"),
    "SelectSchema": (("CapabilitiesReceived",), "SchemaSelected", "Ready"),
    "Ready": (("SchemaSelected", "CapabilitiesReceived"), "Ready", "Complete"),
}


def handshake(state: dict, frame: dict) -> dict:
    now, message = state.get("now", "Initial"), frame["message"]
    out = {"seq": frame["seq"], "state": now, "reply": None, "error": None}
    if message == "Error":
        state["now"] = "Failed"
        return out | {"state": "Failed", "reply": "Failed"}
    if message not in HANDSHAKE or now not in HANDSHAKE[message][0]:
        return out | {"error": "InvalidState"}
    state["now"] = HANDSHAKE[message][1]
    return out | {"state": state["now"], "reply": HANDSHAKE[message][2]}


Step = Callable[[dict, dict], dict]


def _frames(pdf: pd.DataFrame, order: str) -> Iterator[dict]:
    pdf = pdf.sort_values(order, kind="stable")
    for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
        yield row


def run_batch(df: DataFrame, key: str, order: str, step: Step, out_schema: str) -> DataFrame:
    """step over each key's rows in order. Rows are sorted by key and order in each partition and read a batch at a time,
    so a task holds one batch and one state, however long a stream is."""
    schema = StructType([df.schema[key], *StructType.fromDDL(out_schema).fields])
    arrow = to_arrow_schema(schema)
    given = [c for c in df.columns if c != key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, begun = {}, None, False
        for batch in batches:
            keys, out = batch.column(key).to_pylist(), []
            for k, row in zip(keys, zip(*[batch.column(c).to_pylist() for c in given], strict=True), strict=True):
                if not begun or k != now:
                    state, now, begun = {}, k, True
                out.append(step(state, dict(zip(given, row, strict=True))))
            cols = [batch.column(key), *[pa.array([r[f.name] for r in out], f.type) for f in list(arrow)[1:]]]
            yield pa.RecordBatch.from_arrays(cols, arrow.names)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


class Machine(StatefulProcessor):
    """step with its state kept as one JSON value for each key."""

    def __init__(self, key: str, order: str, step: Step, names: list[str]):
        self.key, self.order, self.step, self.names = key, order, step, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        pdf = pd.concat(list(rows))
        out = pd.DataFrame([self.step(state, f) for f in _frames(pdf, self.order)], columns=self.names)
        self.state.update((json.dumps(state),))
        out.insert(0, self.key, key[0])
        yield out

    def close(self) -> None:
        pass


def run_stream(df: DataFrame, key: str, order: str, step: Step, out_schema: str) -> DataFrame:
    """The same over a stream; needs the RocksDB state store."""
    names = [c.split()[0] for c in out_schema.split(", ")]
    machine = Machine(key, order, step, names)
    return df.groupBy(key).transformWithStateInPandas(machine, f"{key} {df.schema[key].dataType.simpleString()}, {out_schema}", "Append", "none")
