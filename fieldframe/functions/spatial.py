"""Geometry of struct columns: positions {x, y, z}, rotations {pitch, yaw, roll}, boxes {min, max}, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
TURNS = ("pitch", "yaw", "roll")
# Limits of a valid state.
MAX_COORDINATE, MAX_SPEED, MAX_ACCELERATION = 1000.0, 100.0, 50.0


def position(x: Column, y: Column, z: Column, kind: str = "double") -> Column:
    return F.struct(x.cast(kind).alias("x"), y.cast(kind).alias("y"), z.cast(kind).alias("z"))


def _map(names: tuple[str, ...], f, *cols: Column) -> Column:  # noqa: ANN001
    return F.struct(*[f(*[c[n] for c in cols]).alias(n) for n in names])


def length(v: Column, names: tuple[str, ...] = AXES) -> Column:
    return F.sqrt(sum((v[n] * v[n] for n in names), F.lit(0.0)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[n] - b[n]) * (a[n] - b[n]) for n in AXES), F.lit(0.0)))


def unit(v: Column) -> Column:
    n = length(v)
    return _map(AXES, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n), v)


def boxes_meet(a: Column, b: Column) -> Column:
    """Closed boxes: touching counts. The condition of a theta join."""
    out = F.lit(True)
    for n in AXES:
        out = out & (a["min"][n] <= b["max"][n]) & (a["max"][n] >= b["min"][n])
    return out


def _cell(v: Column, n: str, sizes: tuple[float, float, float]) -> Column:
    return F.floor(v[n] / sizes[AXES.index(n)])


def in_cells(df: DataFrame, box: str, sizes: tuple[float, float, float]) -> DataFrame:
    """A row for each cell that the box touches, cells being of these sizes along the three axes: _x, _y, _z and a hash
    of them, _cell."""
    for n in AXES:
        df = df.withColumn(f"_{n}", F.explode(F.sequence(_cell(F.col(f"{box}.min"), n, sizes), _cell(F.col(f"{box}.max"), n, sizes))))
    return df.withColumn("_cell", F.xxhash64(*[f"_{n}" for n in AXES]))


def boxes_joined(df: DataFrame, box: str, sizes: tuple[float, float, float], where: Column) -> DataFrame:
    """Pairs of rows, aliases a and b, whose boxes meet and for which `where` holds. An equi-join finds those that share
    a cell, and a pair counts in its first shared cell only; the theta condition is checked on that. Cells a few times a
    box's size keep both copies and strangers few. The key is the cell's hash; cells themselves are compared after it, so
    equal hashes of two cells do no harm."""
    cells = in_cells(df, box, sizes)
    on = (F.col("a._cell") == F.col("b._cell")) & where
    for n in AXES:
        first = F.greatest(_cell(F.col(f"a.{box}.min"), n, sizes), _cell(F.col(f"b.{box}.min"), n, sizes))
        on = on & (F.col(f"a._{n}") == first) & (F.col(f"b._{n}") == first)
    return cells.alias("a").join(cells.alias("b"), on & boxes_meet(F.col(f"a.{box}"), F.col(f"b.{box}")))


def transform(p: Column, rotation: Column, translation: Column, scale: Column) -> Column:
    """Scale, turn about z by roll, about y by yaw, about x by pitch, then move."""
    x, y, z = (p[n] * scale[n] for n in AXES)
    s, c = F.sin(rotation["roll"]), F.cos(rotation["roll"])
    x, y = x * c - y * s, x * s + y * c
    s, c = F.sin(rotation["yaw"]), F.cos(rotation["yaw"])
    x, z = x * c + z * s, z * c - x * s
    s, c = F.sin(rotation["pitch"]), F.cos(rotation["pitch"])
    y, z = y * c - z * s, y * s + z * c
    return F.struct((x + translation["x"]).alias("x"), (y + translation["y"]).alias("y"), (z + translation["z"]).alias("z"))


def state_error(pos: Column, velocity: Column | None = None, acceleration: Column | None = None) -> Column:
    """Null for a valid state, else what is wrong first."""
    out = F.when(F.greatest(*[F.abs(pos[n]) for n in AXES]) > MAX_COORDINATE, "PositionOutOfRange")
    if velocity is not None:
        out = out.when(length(velocity) > MAX_SPEED, "SpeedTooHigh")
    if acceleration is not None:
        out = out.when(length(acceleration) > MAX_ACCELERATION, "AccelerationTooHigh")
    return out


def difference(old: Column, new: Column, names: tuple[str, ...] = AXES) -> Column:
    return _map(names, lambda a, b: b - a, old, new)


def moved(old: Column, change: Column, names: tuple[str, ...] = AXES) -> Column:
    """old with the change added; a missing change leaves it as it is."""
    return F.when(change.isNull(), old).otherwise(_map(names, lambda a, d: a + d, old, change))


PARTS = {"position": AXES, "rotation": TURNS, "velocity": AXES, "acceleration": AXES}


def state_delta(old: Column, new: Column) -> Column:
    """Of states struct<position, rotation, velocity, acceleration>, each part null or there: position and rotation as
    differences where both sides have them, else null; velocity and acceleration as the new side has them."""
    part = lambda name: F.when(old[name].isNotNull() & new[name].isNotNull(), difference(old[name], new[name], PARTS[name]))
    return F.struct(*[(part(n) if n in ("position", "rotation") else new[n]).alias(n) for n in PARTS])


def state_moved(old: Column, change: Column) -> Column:
    """The state after state_delta's change: parts that it has not stay as they were."""
    part = lambda name: F.when(old[name].isNull(), old[name]).otherwise(moved(old[name], change[name], PARTS[name]))
    return F.struct(*[(part(n) if n in ("position", "rotation") else F.coalesce(change[n], old[n])).alias(n) for n in PARTS])


def predicted(pos: Column, velocity: Column, seconds: float = 0.001) -> Column:
    return F.when(velocity.isNull(), pos).otherwise(_map(AXES, lambda p, v: p + v * seconds, pos, velocity))


def sender_mode(seq: Column, has_previous: Column, interval: int = 100) -> Column:
    """ABS at every interval-th frame and without a frame before, else DELTA."""
    return F.when((seq % interval == 0) | ~has_previous, "ABS").otherwise("DELTA")
