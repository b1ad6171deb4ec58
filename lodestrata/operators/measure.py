"""Room dimensions from labelled points: dominant wall direction, wall spans, heights and doors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import turned
from ..sources.tables import checked, stow
from .graph import components
from .ranks import matched, quantiles
from .robust import concentration, height_share, histogram, peaks

YAW_STEP, YAW_BIN = 0.25, 0.02
WALL_LOW, WALL_HIGH, WALL_BIN, WALL_SHARE = -0.45, 0.25, 0.01, 0.04
FLOOR, CEILING, DOOR, LEAST_LABELLED = 2, 3, 7, 500
DOOR_VOXEL, DOOR_LEAST, DOOR_MIN, DOOR_MAX = 0.06, 400, 0.4, 2.5


def yaw_scores(points: DataFrame, keys: list[str], x: str, z: str, step: float = YAW_STEP, width: float = YAW_BIN) -> DataFrame:
    """keys, k, score: how concentrated both axes' histograms are when turned back by k * step degrees, k * step in [0, 90)."""
    turns = points.sparkSession.range(int(round(90 / step))).withColumnRenamed("id", "k")
    a, b = turned(F.col(x), F.col(z), -F.radians(F.col("k") * step))
    both = points.select(*keys, x, z).crossJoin(F.broadcast(turns)).select(*keys, "k", a.alias("a"), b.alias("b"))
    low = both.groupBy(*keys, "k").agg(F.min("a").alias("la"), F.min("b").alias("lb"), F.max("a").alias("ha"), F.max("b").alias("hb"))  # few rows for each key and turn
    placed = both.join(checked(stow(low)), [*keys, "k"])
    bins = lambda v: F.least(F.floor((F.col(v) - F.col(f"l{v}")) / width), F.greatest(F.ceil((F.col(f"h{v}") - F.col(f"l{v}")) / width), F.lit(1)) - 1)
    scores = None
    for v in "ab":  # counts are combined before they are shuffled
        part = placed.groupBy(*keys, "k", bins(v).alias("bin")).agg(F.count("*").alias("n"))
        share = concentration(part, [*keys, "k"])
        scores = share if scores is None else scores.unionByName(share)
    return scores.groupBy(*keys, "k").agg(F.sum("concentration").alias("score"))


def manhattan_yaw(points: DataFrame, keys: list[str], x: str, z: str, step: float = YAW_STEP, width: float = YAW_BIN) -> DataFrame:
    """keys, yaw_deg: the turn of highest score, the first of equals."""
    best = F.max_by("k", F.struct(F.round("score", 12), -F.col("k")))
    scores = yaw_scores(points, keys, x, z, step, width)
    return (scores.groupBy(*keys) if keys else scores.groupBy()).agg(best.alias("k")).select(*keys, (F.col("k") * step).alias("yaw_deg"))


def wall_span(points: DataFrame, keys: list[str], value: str, width: float = WALL_BIN, share: float = WALL_SHARE) -> DataFrame:
    """keys, span: distance between the outermost walls, which are peaks of the histogram."""
    found = peaks(histogram(points, keys, value, width), keys, width, share)
    return found.groupBy(*keys).agg((F.max("centre") - F.min("centre")).alias("span"))


def door_sizes(points: DataFrame, voxel: float = DOOR_VOXEL, least: int = DOOR_LEAST, keys: tuple[str, ...] = (), across: tuple[str, str] = ("x", "z")) -> DataFrame:
    """keys, door (its keys and least voxel), n_points, width, height: groups of 26-connected voxels of x, y, z.

    A door is as wide as its larger span along the two columns across, which may differ from those that place the voxels.
    """
    key = [*keys, "ix", "iy", "iz"]
    held = points.select(*keys, "y", *(F.col(c).alias(f"_{k}") for k, c in enumerate(across)), *(F.floor(F.col(a) / voxel).alias(f"i{a}") for a in "xyz"))
    cells = held.select(*key).distinct()
    ahead = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
    offsets = F.explode(F.array(*(F.struct(*(F.lit(c).alias(f"d{a}") for a, c in zip("xyz", o, strict=True))) for o in ahead)))
    there = cells.withColumn("o", offsets).select(F.struct(*key).alias("a"), *keys, *((F.col(f"i{a}") + F.col("o")[f"d{a}"]).alias(f"i{a}") for a in "xyz"))
    labels = components(there.join(cells, key).select("a", F.struct(*key).alias("b")))
    named = held.withColumn("node", F.struct(*key)).join(labels, "node", "left").withColumn("door", F.coalesce("label", "node"))
    span = lambda a: F.max(a) - F.min(a)
    sizes = named.groupBy(*keys, "door").agg(F.count("*").alias("n_points"), F.greatest(span("_0"), span("_1")).alias("width"), span("y").alias("height"))
    return sizes.where(F.col("n_points") >= least)


def measure_room(points: DataFrame) -> DataFrame:
    """source, name, value_m, seq from points(source, x, y, z, label): yaw, wall spans A and B, floor to ceiling, doors.

    The room's direction is found on the wall band; heights are between the floor's and the ceiling's median where both are
    labelled, else between the 1st and the 99th percentile. Doors follow from seq 4, by position.
    """
    keys, points = ["source"], stow(points)  # read several times
    bands = height_share(points, keys, "y", WALL_LOW, WALL_HIGH)
    yaw = manhattan_yaw(bands, keys, "x", "z")
    a, b = turned(F.col("x"), F.col("z"), -F.radians("yaw_deg"))
    yaw = stow(yaw)
    straight = bands.join(checked(yaw), keys).select("source", a.alias("a"), b.alias("b"))
    spans = [wall_span(straight, keys, axis).select("source", F.lit(f"wall span {axis.upper()}").alias("name"), F.col("span").alias("value_m"), F.lit(i).alias("seq")) for i, axis in ((1, "a"), (2, "b"))]
    marked = points.where(F.col("label").isin(FLOOR, CEILING))
    many = marked.groupBy(*keys, "label").count().where(F.col("count") > LEAST_LABELLED).select(*keys, "label")
    level = matched(quantiles(marked, [*keys, "label"], "y", {"middle": 0.5}), stow(many), [*keys, "label"], "left_semi")
    levels = level.groupBy(*keys).agg(*(F.max(F.when(F.col("label") == code, F.col("middle"))).alias(n) for code, n in ((FLOOR, "low"), (CEILING, "high"))))
    heights = matched(quantiles(points, keys, "y", {"q1": 0.01, "q99": 0.99}), stow(levels), keys, "left")
    height = heights.select("source", F.lit("floor to ceiling").alias("name"), F.coalesce(F.col("high") - F.col("low"), F.col("q99") - F.col("q1")).alias("value_m"), F.lit(3).alias("seq"))
    direction = yaw.select("source", F.lit("yaw").alias("name"), F.col("yaw_deg").alias("value_m"), F.lit(0).alias("seq"))
    out = direction
    for part in (*spans, height, measure_doors(points, yaw)):
        out = out.unionByName(part)
    return out


def measure_doors(points: DataFrame, yaw: DataFrame) -> DataFrame:
    """source, name, value_m, seq: width and height of each door, by position; a source with few door points has none."""
    marked = points.where(F.col("label") == DOOR)
    enough = marked.groupBy("source").count().where(F.col("count") > LEAST_LABELLED).select("source")
    a, b = turned(F.col("x"), F.col("z"), -F.radians("yaw_deg"))
    straight = marked.join(checked(stow(enough)), "source", "left_semi").join(checked(yaw), "source").select("source", "x", "y", "z", a.alias("a"), b.alias("b"))
    doors = door_sizes(straight, keys=("source",), across=("a", "b")).where(F.col("width").between(DOOR_MIN, DOOR_MAX))
    placed = doors.withColumn("seq", (F.row_number().over(Window.partitionBy("source").orderBy("door")) + 3).cast("int"))
    sizes = F.explode(F.array(*(F.struct(F.lit(f"door {n}").alias("name"), F.col(n).alias("value_m")) for n in ("width", "height"))))
    return placed.select("source", "seq", sizes.alias("r")).select("source", "r.name", "r.value_m", "seq")
