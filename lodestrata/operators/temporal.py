"""Operators on time series: gaps, envelopes, segments, robust slopes, as-of joins and resampling.

Series are told apart by key columns, times are integers (microseconds), and a sequence column breaks ties. As-of joins
work in buckets of time: rows meet within a bucket, and what a bucket needs of others is one row on either side, so a
long series isn't bound to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from ..functions.scalars import evenly_spread
from ..sources.tables import stow
from .ranks import every_number, matched, placed, quantiles

#: Time buckets of a block, over which a bucket's first and last row are carried at once.
BLOCK = 1024


def with_gap(rows: DataFrame, keys: list[str], t: str, *ties: str, name: str = "gap") -> DataFrame:
    """Adds the time since the row before; null for the first."""
    return rows.withColumn(name, F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t, *ties)))


def gap_stats(rows: DataFrame, keys: list[str], t: str, *ties: str) -> DataFrame:
    """keys, n_rows, median_gap, worst_gap, hz: rate by the median gap."""
    gaps = with_gap(rows, keys, t, *ties)
    middle = quantiles(gaps, keys, "gap", {"median_gap": 0.5})
    whole = gaps.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.max("gap").alias("worst_gap"))
    return matched(whole, middle, keys, "left").select(*keys, "n_rows", "median_gap", "worst_gap", (1e6 / F.col("median_gap")).alias("hz"))


def bursts(rows: DataFrame, keys: list[str], t: str, *ties: str, near: float = 0.1, share: float = 0.05) -> DataFrame:
    """keys, near_zero (share of gaps under near times the median), bunched."""
    gaps = with_gap(rows, keys, t, *ties).where("gap is not null")
    middle = quantiles(gaps, keys, "gap", {"middle": 0.5})
    part = matched(gaps, middle, keys).groupBy(*keys).agg(F.avg((F.col("gap") < near * F.col("middle")).cast("double")).alias("near_zero"))
    return part.withColumn("bunched", F.col("near_zero") > share)


def in_order(rows: DataFrame, keys: list[str], t: str, seq: str) -> DataFrame:
    """keys, monotone: whether times never fall in file order."""
    fell = F.col(t) < F.lag(t).over(Window.partitionBy(*keys).orderBy(seq))
    return rows.withColumn("fell", F.coalesce(fell, F.lit(False))).groupBy(*keys).agg((~F.max("fell")).alias("monotone"))


def rates(rows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, n_rows, elapsed_us, hz: rows over elapsed time."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), (F.max(t) - F.min(t)).alias("elapsed_us"))
    return out.withColumn("hz", F.when(F.col("elapsed_us") > 0, F.col("n_rows") * 1e6 / F.col("elapsed_us")))


def envelope(rows: DataFrame, keys: list[str], t: str, delay: str, seq: str, width: int) -> DataFrame:
    """keys, bin, t, delay: in each window of width from the series' first row, the first row of least delay."""
    start = rows.groupBy(*keys).agg(F.min(t).alias("start"))
    binned = rows.join(F.broadcast(start) if not keys else start, keys) if keys else rows.crossJoin(F.broadcast(start))
    least = F.min_by(F.struct(F.col(t).alias("t"), F.col(delay).alias("delay")), F.struct(delay, seq))
    return binned.groupBy(*keys, F.floor((F.col(t) - F.col("start")) / width).alias("bin")).agg(least.alias("row")).select(*keys, "bin", "row.t", "row.delay")


def segments(rows: DataFrame, keys: list[str], t: str, value: str, jump: float, name: str = "segment") -> DataFrame:
    """Adds the number of upward jumps so far: a new segment starts where value rises by more than jump."""
    w = Window.partitionBy(*keys).orderBy(t)
    rose = F.coalesce((F.col(value) - F.lag(value).over(w) > jump).cast("long"), F.lit(0))
    return rows.withColumn("_rose", rose).withColumn(name, F.sum("_rose").over(w)).drop("_rose")


def spread_sample(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each series, evenly spread over its order."""
    found = placed(rows, keys, order, "_k", "_n")
    return found.where(evenly_spread(F.col("_k") - 1, F.col("_n"), most)).drop("_n", "_k")


def theil_sen(rows: DataFrame, keys: list[str], x: str, y: str, most: int = 800) -> DataFrame:
    """keys, n_points, slope, uncertainty, intercept: median slope over all pairs of an even sample of at most `most` points."""
    w = Window.partitionBy(*keys)
    points = spread_sample(rows.select(*keys, x, y), keys, [x, y], most).withColumn("_i", F.row_number().over(w.orderBy(x, y)))
    other = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("_i").alias("_j"))
    pairs = points.join(other, keys) if keys else points.crossJoin(other)
    slopes = pairs.where((F.col("_i") < F.col("_j")) & (F.col("_x") != F.col(x))).withColumn("s", (F.col("_y") - F.col(y)) / (F.col("_x") - F.col(x)))
    part = slopes.groupBy(*keys).agg(F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    fitted = points.join(part, keys) if keys else points.crossJoin(part)
    rest = F.col(y) - F.col("q")[1] * F.col(x)
    out = fitted.groupBy(*keys).agg(F.count("*").alias("n_points"), F.first("q").alias("q"), F.median(rest).alias("intercept"))
    return out.select(*keys, "n_points", F.col("q")[1].alias("slope"), ((F.col("q")[2] - F.col("q")[0]) / 2 / F.sqrt("n_points")).alias("uncertainty"), "intercept")


def clock_segments(rows: DataFrame, keys: list[str], device: str, arrival: str, seq: str, width: int = 500_000, jump: float = 8_000.0, least: int = 12) -> DataFrame:
    """keys, segment, start_us, end_us, n_points, intercept, slope (of the segment) and its uncertainty, first_delay, last_delay, pooled (median over the fitted ones).

    The envelope of arrival delay is cut at resync jumps; a segment of at least `least` points gets a robust line, a
    shorter one its median delay. All segments then use the pooled slope with their own intercepts.
    """
    delays = rows.select(*keys, F.col(device).alias("t"), (F.col(arrival) - F.col(device)).alias("delay"), seq)
    cut = stow(segments(envelope(delays, keys, "t", "delay", seq, width), keys, "t", "delay", jump))
    own = [*keys, "segment"]
    ends = [F.min_by("delay", "t").alias("first_delay"), F.max_by("delay", "t").alias("last_delay")]
    bounds = cut.groupBy(*own).agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count("*").alias("n"), F.median("delay").alias("middle"), *ends)
    local = cut.join(bounds.select(*own, "start_us"), own).withColumn("x", (F.col("t") - F.col("start_us")).cast("double")).withColumn("y", F.col("delay").cast("double"))
    lines = theil_sen(local, own, "x", "y").select(*own, "slope", "intercept", "uncertainty")
    fitted = bounds.join(lines, own, "left")
    good = F.col("n") >= least
    fitted = fitted.select(*own, "start_us", "end_us", F.col("n").alias("n_points"), F.when(good, F.col("intercept")).otherwise(F.col("middle")).alias("intercept"), F.when(good, F.col("slope")).otherwise(0.0).alias("slope"), F.when(good, F.col("uncertainty")).alias("uncertainty"), "first_delay", "last_delay", good.alias("good"))
    pooled = fitted.where("good").groupBy(*keys).agg(F.median("slope").alias("pooled")) if keys else fitted.where("good").agg(F.median("slope").alias("pooled"))
    out = fitted.join(pooled, keys, "left") if keys else fitted.crossJoin(F.broadcast(pooled))
    return out.withColumn("pooled", F.coalesce("pooled", F.lit(0.0))).drop("good")


def _beside(ends: DataFrame, over: list[str], place: str) -> DataFrame:
    """Adds _before and _after: the nearest _last of an earlier place and _first of a later one.

    Both windows grow row by row; one that ends at the last row would be gone through again for each row.
    """
    up, down = (Window.partitionBy(*over).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(place), F.desc(place)))
    return ends.withColumn("_before", F.last("_last", True).over(up)).withColumn("_after", F.last("_first", True).over(down))


def _carried(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _b, _last, _first: the last row before each bucket and the first one after it, within blocks of buckets and then from block to block."""
    blocked = ends.withColumn("_block", F.floor(F.col("_b") / BLOCK))
    blocks = _beside(blocked.groupBy(*keys, "_block").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first")), keys, "_block")
    within = _beside(blocked, [*keys, "_block"], "_b").select(*keys, "_b", "_block", "_before", "_after")
    both = within.join(blocks.select(*keys, "_block", F.col("_before").alias("_far_before"), F.col("_after").alias("_far_after")), [*keys, "_block"])
    return both.select(*keys, "_b", F.coalesce("_before", "_far_before").alias("_last"), F.coalesce("_after", "_far_after").alias("_first"))


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], t: str, right_t: str, columns: list[str], bucket: int, slices: int = 1, parts: int | None = None) -> DataFrame:
    """Adds before and after to left: structs (t, *columns) of the last right row up to t and the first one later, null where none.

    Rows meet within time buckets; across buckets only each one's first and last right row move on. Where a bucket may hold
    very many left rows and few right ones, the left rows are dealt over slices, each of which has all right rows. parts:
    number of parts that the rows are shuffled into.
    """
    names = left.columns
    plain = [F.col(f.name) for f in left.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, BinaryType))]
    slice_ = F.pmod(F.xxhash64(*plain), F.lit(slices)).cast("int") if slices > 1 else F.lit(0)
    rows = left.select(*(F.col(k) for k in keys), F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(F.col(right_t).alias("t"), *columns).alias("v")).schema["v"].dataType).alias("_v"), slice_.alias("_slice"))
    held = right.select(*(F.col(k) for k in keys), F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct(F.col(right_t).alias("t"), *columns).alias("_v"), F.explode(F.array(*map(F.lit, range(slices)))).alias("_slice"))
    both = rows.unionByName(held).withColumn("_b", F.floor(F.col("_t") / bucket))
    if parts:
        both = both.repartition(parts, *keys, "_b", "_slice")
    within = Window.partitionBy(*keys, "_b", "_slice")
    near = both.withColumn("_before", F.last("_v", True).over(within.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.last("_v", True).over(within.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    ends = both.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_last"), F.min(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_first"))
    out = near.join(_carried(ends, keys), [*keys, "_b"])
    return out.select("_row.*", F.coalesce("_before", "_last._v").alias("before"), F.coalesce("_after", "_first._v").alias("after"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], t: str, right_t: str, columns: list[str], bucket: int, clamp: bool = False, slices: int = 1) -> DataFrame:
    """Adds the right columns of the last row up to t; before the first row null, or with clamp that row's."""
    found = neighbours(left, right, keys, t, right_t, columns, bucket, slices)
    value = F.coalesce("before", "after") if clamp else F.col("before")
    return found.withColumn("_v", value).select(*left.columns, F.col("_v")["t"].alias(f"{right_t}_found"), *(F.col("_v")[c].alias(c) for c in columns))


def fraction(t: Column, before: Column, after: Column) -> Column:
    """Place of t between two times, 0 to 1; outside the series it is clamped to the end that is there."""
    return F.when(before.isNull(), 1.0).when(after.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - before) / F.greatest((after - before).cast("double"), F.lit(1e-9)))))


def asof_interpolate(left: DataFrame, right: DataFrame, keys: list[str], t: str, right_t: str, columns: list[str], bucket: int) -> DataFrame:
    """Adds the right columns at t, linear between the rows around it and clamped to the ends."""
    found = neighbours(left, right, keys, t, right_t, columns, bucket)
    u = fraction(F.col(t), F.col("before")["t"], F.col("after")["t"])
    ends = {c: (F.coalesce(F.col("before")[c], F.col("after")[c]), F.coalesce(F.col("after")[c], F.col("before")[c])) for c in columns}
    return found.withColumn("_u", u).select(*left.columns, *((a + (b - a) * F.col("_u")).alias(c) for c, (a, b) in ends.items()))


def grid(rows: DataFrame, keys: list[str], t: str, step: int) -> DataFrame:
    """keys, t: multiples of step within each series."""
    bounds = rows.groupBy(*keys).agg(F.ceil(F.min(t) / step).alias("a"), F.floor(F.max(t) / step).alias("b"))
    every = every_number(bounds.where("a <= b"), F.col("a"), F.col("b"), "k")
    return every.select(*keys, (F.col("k") * step).alias("t"))


def resample(rows: DataFrame, keys: list[str], t: str, columns: list[str], step: int, bucket: int) -> DataFrame:
    """keys, t, columns: the series on the grid, linear between its rows."""
    return asof_interpolate(grid(rows, keys, t, step), rows, keys, "t", t, columns, bucket)


def position_fraction(rows: DataFrame, keys: list[str], order: list[str], name: str = "fraction") -> DataFrame:
    """Adds k/(n-1) for the k-th of a group's n rows; 0 for a single row."""
    w = Window.partitionBy(*keys)
    k, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return rows.withColumn(name, F.when(n > 1, k / (n - 1)).otherwise(0.0))


def plausible_periods(rows: DataFrame, keys: list[str], t: str, low: int, high: int) -> DataFrame:
    """Rows whose time since the row before lies between low and high; the first of each series goes."""
    return with_gap(rows, keys, t, name="period").where((F.col("period") > low) & (F.col("period") < high))


def global_positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the place (from 1) in the whole table's order."""
    return placed(rows, [], order, name)


def latest_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by seq; map-side combined."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")
