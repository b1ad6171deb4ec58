"""Places in an order, and values at places, for groups of any size.

No task holds a group. Places come from sampled ranges: rows are dealt by ranges of their order, counted, and each range
starts where those before it end. Values at places (exact quantiles) come from a search: counts of ranges of distinct values
tell which range holds a place, and that range is cut further until one task can sort what is left of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checked, stow

#: Distinct values of a group that one task may sort, and ranges that a pass of the search cuts the others into.
SORTED_AT_ONCE, CUTS = 500_000, 64
#: Numbers that are made at once.
NUMBERS = 4096
#: Bits of a row's place within its range.
_WITHIN = 33


def matched(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with others on keys, nulls being equal; the keys are those of rows. others is broadcast if it is small."""
    named = others.select(*(F.col(k).alias(f"_other_{k}") for k in keys), *(c for c in others.columns if c not in keys))
    if not keys:
        return rows.crossJoin(F.broadcast(named))  # one row
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return rows.join(checked(named), same, how).drop(*(f"_other_{k}" for k in keys))


def parts_of(rows: DataFrame, each: int = 500_000) -> int:
    """Parts of about `each` rows, but no fewer than shuffles have by default; for tables whose count is cheap, as stored ones."""
    return max(rows.count() // each, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def every_number(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each number from first to last; none of the arrays on the way is longer than a block, or than there are blocks."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - first) / NUMBERS))))
    low = first + F.col("_block") * NUMBERS
    return blocks.withColumn(name, F.explode(F.sequence(low, F.least(low + NUMBERS - 1, last)))).drop("_block")


def placed(rows: DataFrame, keys: list[str], order: list[str], place: str = "place", total: str | None = None) -> DataFrame:
    """Adds each row's place (from 1) in the order of its group, and the group's size as `total`; nulls come first.

    A group spreads over as many ranges as its size asks for, however its rows lie in time. Rows that agree in keys and
    order share a range, in any order among them. The rows are written once, so that all counts are of the same ranges.
    """
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = stow(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", _WITHIN)))
    parts = held.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = [(before - F.col("_first") + 1).alias("_shift"), *([F.sum("_n").over(over).alias(total)] if total else [])]
    found = matched(held, stow(parts.select(*keys, "_range", *starts)), [*keys, "_range"])
    return found.withColumn(place, F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def _between(position: Column, low: Column, high: Column) -> Column:
    """Linear between the values at the places around a position (from 0)."""
    below = F.floor(position)
    return F.when(low == high, low.cast("double")).otherwise((below + 1 - position) * low + (position - below) * high)


def quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """keys and exact quantiles with linear interpolation; null values don't count.

    Equal values are counted first. A group of few distinct values is sorted by one task, a larger one is searched.
    """
    counted = stow(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("_values"), F.sum("_n").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    large = stow(sizes.where(F.col("_values") > SORTED_AT_ONCE))
    if large.isEmpty():
        return _sorted(counted, keys, points)
    found = _searched(matched(counted, large.select(*keys), keys, "left_semi") if keys else counted, large, keys, points)
    return _sorted(matched(counted, large.select(*keys), keys, "left_anti"), keys, points).unionByName(found) if keys else found


def _sorted(counted: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    return counted.groupBy(*keys).agg(*(F.percentile("_v", p, F.col("_n")).alias(n) for n, p in points.items()))


def _searched(counted: DataFrame, large: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """Quantiles of the large groups. A pass counts the ranges that hold a wanted place, each cut at sketched quantiles."""
    wish = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (p * (F.col("_rows") - 1)).alias("position")) for n, p in points.items())))
    wanted = stow(large.select("*", wish.alias("w")).select(*keys, "_rows", "_low", "_high", "w.*"))
    last = F.col("_rows") - 1
    places = wanted.select(*keys, "_low", "_high", F.explode(F.array(F.floor("position"), F.least(F.floor("position") + 1, last))).alias("_k")).distinct()
    open_ = stow(places.withColumn("_base", F.lit(0).cast("long")).withColumn("_values", F.lit(None).cast("long")))
    ends = [*keys, "_low", "_high", "_base"]
    while True:
        inside = matched(counted, open_.select(*ends).distinct(), keys).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        if open_.where(F.coalesce(F.col("_values"), F.lit(SORTED_AT_ONCE + 1)) > SORTED_AT_ONCE).isEmpty():
            break
        cuts = stow(inside.groupBy(*ends).agg(F.percentile_approx("_v", [k / CUTS for k in range(1, CUTS)], 100 * CUTS).alias("_cuts")))
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        pieces = matched(inside, cuts, ends).groupBy(*ends, part.alias("_part")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_values"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        before = F.col("_base") + F.coalesce(F.sum("_n").over(Window.partitionBy(*ends).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pieces = stow(pieces.withColumn("_start", before).drop("_part"))
        holds = (F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_start") + F.col("_n"))
        met = matched(open_.drop("_values"), pieces, ends).where(holds)
        open_ = stow(met.select(*keys, F.col("_from").alias("_low"), F.col("_to").alias("_high"), "_k", F.col("_start").alias("_base"), "_values"))
    start = F.col("_base") + F.coalesce(F.sum("_n").over(Window.partitionBy(*ends).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = inside.withColumn("_start", start)
    holds = (F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_start") + F.col("_n"))
    at = stow(matched(values, open_.select(*ends, "_k"), ends).where(holds).select(*keys, "_k", "_v"))
    for side, k in (("_below", F.floor("position")), ("_above", F.least(F.floor("position") + 1, last))):
        wanted = matched(wanted.withColumn("_k", k), at.withColumnRenamed("_v", side), [*keys, "_k"]).drop("_k")
    return wanted.groupBy(*keys).pivot("name", list(points)).agg(F.first(_between(F.col("position"), F.col("_below"), F.col("_above"))))
