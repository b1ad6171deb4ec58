"""Code tables, bit fields and number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capability bits, tracking states, mesh labels, sensor models and health, stream order.
CAPABILITIES = {1: "scene-reconstruction", 2: "scene-depth", 4: "camera-frames"}
TRACKING = {0: "unavailable", 1: "limited", 2: "normal"}
MESH_LABELS = {0: "none", 1: "wall", 2: "floor", 3: "ceiling", 4: "table", 5: "seat", 6: "window", 7: "door"}
SENSOR_MODELS = {0x18: "A1", 0x28: "A2", 0x41: "C1"}
SENSOR_HEALTH = {0: "Good", 1: "Warning", 2: "Error"}
STREAMS = {0: "POSE", 1: "LIDAR", 2: "FRAME", 3: "DEPTH", 4: "MESH"}
UNLABELLED = 255


def named(code: Column, names: dict[int, str], fallback: str = "unknown") -> Column:
    """The name of a code, or fallback(code)."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.concat(F.lit(f"{fallback}("), code.cast("string"), F.lit(")")))


def bit_names(bits: Column, names: dict[int, str]) -> Column:
    """Names of the bits that are set, in order of the bits."""
    return F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(b)) > 0, n) for b, n in sorted(names.items()))))


def first_rule(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The reason of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, reason in rules[1:]:
        out = out.when(condition, reason)
    return out.otherwise(F.lit(otherwise))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def on_stride(position: Column, stride: int) -> Column:
    """Every stride-th row, counted from 0."""
    return F.pmod(position, F.lit(stride)) == 0


def evenly_spread(position: Column, rows: Column, most: int) -> Column:
    """Whether position (from 0) is one of `most` places spread evenly over `rows`, both ends included."""
    k, n = F.lit(most - 1), F.greatest(rows - 1, F.lit(1))
    first = F.ceil(position * k / n).cast("long")
    return (rows <= most) | (F.floor(first * n / k).cast("long") == position) & (first <= k)


def micros(timestamp: Column) -> Column:
    """Integer microseconds of a wall-clock column."""
    return F.unix_micros(timestamp.cast("timestamp"))


def session_names(timestamp: Column) -> Column:
    """Names of sessions that start at wall-clock times, in the session's time zone."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH-mm-ss")


def rounded(value: Column | str, places: int) -> Column:
    """Halves away from zero, decided on the double times ten to the places, as SQL engines on doubles do.

    Spark's round decides on the shortest decimal text of the double, and so takes other halves up.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * float(10**places)) / float(10**places)
