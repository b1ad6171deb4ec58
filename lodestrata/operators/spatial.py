"""Operators on points: voxels, nearest neighbours and radius pairs by grid hashing."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checked, stow
from .ranks import matched, quantiles

#: Targets of a cell that isn't halved, and points of a cell that one slice has.
LEAF_TARGETS, SLICE_POINTS = 64, 4096


def cells(axes: list[str], size: float, names: list[str] | None = None) -> list[Column]:
    """Integer cell of each axis."""
    return [F.floor(F.col(a) / size).alias(n) for a, n in zip(axes, names or [f"i{a}" for a in axes], strict=True)]


def occupied(points: DataFrame, axes: list[str], size: float) -> DataFrame:
    """n_cells: exact number of cells that hold a point."""
    return points.select(*cells(axes, size)).distinct().agg(F.count("*").alias("n_cells"))


def height_band(points: DataFrame, y: str, low: float, high: float) -> DataFrame:
    """Points strictly within a band around the median height."""
    middle = quantiles(points, [], y, {"_middle": 0.5})
    h = F.col(y) - F.col("_middle")
    return matched(points, middle, []).where((h > low) & (h < high)).drop("_middle")


def topdown_cells(points: DataFrame, x: str, y: str, z: str, size: float, low: float, high: float) -> DataFrame:
    """n_cells: cells seen from above that hold a point of the height band; 0 for none."""
    return occupied(height_band(points, y, low, high), [x, z], size)


def squared_distance(a: list[str], b: list[str]) -> Column:
    return sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def _around(axes: int) -> Column:
    """The offsets of a cell and those that touch it, one row each."""
    return F.explode(F.array(*(F.struct(*(F.lit(o).alias(f"o{i}") for i, o in enumerate(c))) for c in product((-1, 0, 1), repeat=axes))))


def target_tree(targets: DataFrame, axes: list[str], radius: float) -> list[DataFrame]:
    """Levels of cells about targets: the first of the radius' size, each further one halves those that hold more than LEAF_TARGETS.

    Rows: c0, c1, ... (cell), n, l0.., h0.. (box of its targets), leaf, and in further levels p0, p1, ... (the cell halved).
    Targets at one place count once; cells of one place are leaves.
    """
    count, levels = range(len(axes)), []
    held = targets.select(*(F.col(a).cast("double").alias(f"x{i}") for i, a in enumerate(axes))).distinct()
    held = held.select("*", *(F.floor(F.col(f"x{i}") / radius).alias(f"c{i}") for i in count))
    while True:
        cell = [f"c{i}" for i in count]
        parent = [c for c in held.columns if c[0] == "p"]
        box = [f(f"x{i}").alias(f"{n}{i}") for i in count for f, n in ((F.min, "l"), (F.max, "h"))]
        nodes = held.groupBy(*cell, *parent).agg(F.count("*").alias("n"), *box)
        level = stow(nodes.withColumn("leaf", F.col("n") <= LEAF_TARGETS))
        levels.append(level)
        full = level.where(~F.col("leaf")).select(*cell)
        if full.isEmpty():
            return levels
        size = radius / 2 ** len(levels)
        held = stow(held.join(checked(full), cell, "left_semi").select(*(f"x{i}" for i in count), *(F.col(f"c{i}").alias(f"p{i}") for i in count), *(F.floor(F.col(f"x{i}") / size).alias(f"c{i}") for i in count)))


def nearest(points: DataFrame, key: str, axes: list[str], targets: DataFrame, target_axes: list[str], order: str, columns: list[str], radius: float) -> DataFrame:
    """Left outer: points with the columns of the nearest target nearer than radius, ties by `order`; null where none.

    A point meets the cells around its own. Cells of many targets are halved level by level, and a point goes on with those
    alone that may hold its nearest target: no farther than the farthest corner of another's box. So it meets targets of a few
    small cells, however dense they lie.
    """
    count = range(len(axes))
    cell = [f"c{i}" for i in count]
    levels = target_tree(targets, target_axes, radius)
    gap = sum((F.pow(F.greatest(F.col(f"l{i}") - F.col(f"_p{i}"), F.col(f"_p{i}") - F.col(f"h{i}"), F.lit(0.0)), 2) for i in count), F.lit(0.0))
    span = sum((F.pow(F.greatest(F.abs(F.col(f"_p{i}") - F.col(f"l{i}")), F.abs(F.col(f"_p{i}") - F.col(f"h{i}"))), 2) for i in count), F.lit(0.0))
    own = Window.partitionBy(key)
    place = [f"_p{i}" for i in count]

    def kept(met: DataFrame) -> DataFrame:
        """Cells of each point that may hold its nearest target; the bound has room for rounding."""
        bound = F.least(F.min("_far").over(own), F.lit(radius * radius))
        return met.withColumn("_near", gap).withColumn("_far", span).withColumn("_bound", bound).where(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).drop("_near", "_far", "_bound")

    start = points.select(key, *(F.col(a).cast("double").alias(f"_p{i}") for i, a in enumerate(axes))).withColumn("_o", _around(len(axes)))
    start = start.select(key, *place, *((F.floor(F.col(f"_p{i}") / radius) + F.col("_o")[f"o{i}"]).alias(f"c{i}") for i in count))
    open_ = kept(start.join(checked(levels[0]), cell)).withColumn("_level", F.lit(0))
    fields = [key, *place, "_level", *cell, "leaf", *(f"{n}{i}" for i in count for n in "lh")]
    open_ = open_.select(*fields)
    for number, level in enumerate(levels[1:], 1):
        deeper = open_.where(~F.col("leaf")).select(key, *place, *(F.col(f"c{i}").alias(f"p{i}") for i in count))
        deeper = deeper.join(checked(level), [f"p{i}" for i in count]).withColumn("_level", F.lit(number)).select(*fields)
        open_ = stow(kept(open_.where("leaf").unionByName(deeper)))
    leaves = [level.where("leaf").select(*cell).withColumn("_level", F.lit(number)) for number, level in enumerate(levels)]
    named = targets.select(*(F.col(c).alias(f"_t_{c}") for c in dict.fromkeys([*target_axes, order, *columns])))
    held = None
    for number, leaf in enumerate(leaves):
        at = named.select("*", *(F.floor(F.col(f"_t_{a}").cast("double") / (radius / 2**number)).alias(f"c{i}") for i, a in enumerate(target_axes)))
        part = at.join(checked(leaf), cell) if len(levels) > 1 else at.withColumn("_level", F.lit(number))
        held = part if held is None else held.unionByName(part)
    d = squared_distance(place, [f"_t_{a}" for a in target_axes])
    met = open_.select(key, *place, "_level", *cell).join(held, ["_level", *cell]).withColumn("_d", d).where(F.col("_d") < radius * radius)
    best = met.groupBy(key).agg(F.min_by(F.struct(*(F.col(f"_t_{c}").alias(c) for c in columns)), F.struct("_d", f"_t_{order}")).alias("_best"))
    return points.join(best, key, "left").select(*points.columns, *(F.col("_best")[c].alias(c) for c in columns))


def radius_pairs(points: DataFrame, key: str, axes: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """keys, i, j, d2 for i < j of one group, no farther apart than radius: a self-join on the cells around each point.

    The points of a cell with many are dealt over slices, so that no task has all of its pairs.
    """
    keys, count = keys or [], range(len(axes))
    names = [f"_c{n}" for n in count]
    base = points.select(*keys, F.col(key).alias("i"), *(F.col(a).alias(f"_a{n}") for n, a in enumerate(axes)), *cells(axes, radius, names))
    full = stow(base.groupBy(*keys, *names).agg(F.count("*").alias("_n")).where(F.col("_n") > SLICE_POINTS).withColumn("_slices", F.expr(f"1 + _n div {SLICE_POINTS}")).drop("_n"))
    other = points.select(*keys, F.col(key).alias("j"), *(F.col(a).alias(f"_b{n}") for n, a in enumerate(axes)), *cells(axes, radius, [f"_k{n}" for n in count])).withColumn("_o", _around(len(axes)))
    other = other.select(*keys, "j", *(f"_b{n}" for n in count), *((F.col(f"_k{n}") + F.col("_o")[f"o{n}"]).alias(c) for n, c in enumerate(names)))
    on = [*keys, *names]
    if not full.isEmpty():
        slices = F.coalesce("_slices", F.lit(1).cast("long"))
        base = base.join(checked(full), on, "left").withColumn("_slice", F.pmod(F.xxhash64("i"), slices)).drop("_slices")
        other = other.join(checked(full), on, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("_slices")
        on = [*on, "_slice"]
    d = squared_distance([f"_a{n}" for n in count], [f"_b{n}" for n in count])
    return base.join(other, on).where("i < j").withColumn("d2", d).where(F.col("d2") <= radius * radius).select(*keys, "i", "j", "d2")
