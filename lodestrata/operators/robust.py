"""Exact robust statistics and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stow
from .ranks import every_number, matched, placed, quantiles

#: Rows, or hashes, that are hashed together.
DIGEST_BLOCK = 4096


def mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, middle, sigma: 1.4826 times the median distance from the median."""
    middle = quantiles(rows, keys, value, {"middle": 0.5})
    off = matched(rows, middle, keys).withColumn("_off", F.abs(F.col(value) - F.col("middle")))
    spread = quantiles(off, [*keys, "middle"], "_off", {"_mad": 0.5})
    return spread.select(*keys, "middle", (1.4826 * F.col("_mad")).alias("sigma"))


def histogram(rows: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """keys, bin, n: bins of width from each group's least value, empty ones with 0; the last bin is closed."""
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).withColumn("_bins", F.greatest(F.ceil((F.col("_high") - F.col("_low")) / width), F.lit(1)))
    joined = rows.join(bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))
    counts = joined.groupBy(*keys, F.least(F.floor((F.col(value) - F.col("_low")) / width), F.col("_bins") - 1).alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.select(*keys, "_low", F.col("_bins")).transform(every_number, F.lit(0).cast("long"), F.col("_bins") - 1, "bin").drop("_bins")
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("_low") + F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def peaks(bins: DataFrame, keys: list[str], width: float, share: float) -> DataFrame:
    """keys, peak (from 1, ascending), first_bin, last_bin, mass, centre: runs of bins with at least share of the fullest one's count."""
    w = Window.partitionBy(*keys)
    high = bins.withColumn("_most", F.max("n").over(w)).where((F.col("n") > 0) & (F.col("n") >= share * F.col("_most")))
    runs = high.withColumn("_run", F.col("bin") - F.row_number().over(w.orderBy("bin")))
    centre = F.sum((F.col("low") + width / 2) * F.col("n")) / F.sum("n")
    out = runs.groupBy(*keys, "_run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("n").alias("mass"), centre.alias("centre"))
    return out.withColumn("peak", F.row_number().over(w.orderBy("first_bin"))).drop("_run")


def concentration(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, concentration: sum of squared shares of a histogram."""
    total = bins.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("n")).alias("_nn"))
    return total.select(*keys, (F.col("_nn") / (F.col("_n") * F.col("_n"))).alias("concentration"))


def histogram_2d(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """bx, by, n, log_n of an even grid over the bounding box; only cells that hold a row."""
    b = F.broadcast(rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")))
    place = [F.least(F.floor((F.col(v) - F.col(f"{a}0")) / ((F.col(f"{a}1") - F.col(f"{a}0")) / bins)), F.lit(bins - 1)).alias(f"b{a}") for v, a in ((x, "x"), (y, "y"))]
    return rows.crossJoin(b).groupBy(*place).agg(F.count("*").alias("n")).withColumn("log_n", F.log1p("n"))


def rms(value: str):
    return F.sqrt(F.avg(F.col(value) * F.col(value)))


def class_shares(rows: DataFrame, label: str) -> DataFrame:
    """label, n, percent."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def compare(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """name, value_m, tape_m, error, percent (null where the tape says 0): measurements beside truth of the same name."""
    error = F.col("value_m") - F.col("tape_m")
    return predicted.join(truth, "name").select("name", "value_m", "tape_m", error.alias("error"), F.when(F.col("tape_m") != 0, 100 * error / F.col("tape_m")).alias("percent"))


def agreement(measurements: DataFrame, a: str, b: str, without: str = "yaw") -> DataFrame:
    """name, value_a, value_b, difference: what two sources measured under the same name; of repeats the last by seq counts."""
    last = measurements.where(~F.col("name").contains(without)).groupBy("source", "name").agg(F.max_by("value_m", "seq").alias("value_m"))
    left = last.where(F.col("source") == a).select("name", F.col("value_m").alias("value_a"))
    right = last.where(F.col("source") == b).select("name", F.col("value_m").alias("value_b"))
    return left.join(right, "name").withColumn("difference", F.col("value_a") - F.col("value_b"))


def ordered_digest(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """keys, digest: depends on each row and on their order.

    A hash tree: rows are hashed, the hashes of each DIGEST_BLOCK rows in order are hashed together, and so on with these until
    a group has one; so no task holds more of a group than a block.
    """
    hashed = rows.select(*keys, *order, F.sha2(F.col(text).cast("binary"), 256).alias("_h"))
    held = placed(hashed, keys, [*order, "_h"], "_k", "_n").select(*keys, (F.col("_k") - 1).alias("_k"), "_n", "_h")
    most = held.agg(F.max("_n")).first()[0] or 1
    while True:
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda r: r["_h"])
        held = held.groupBy(*keys, F.floor(F.col("_k") / DIGEST_BLOCK).alias("_k")).agg(F.sha2(F.array_join(hashes, "").cast("binary"), 256).alias("_h"))
        if most <= DIGEST_BLOCK:
            return held.select(*keys, F.col("_h").alias("digest"))
        held, most = stow(held), -(-most // DIGEST_BLOCK)


def height_share(points: DataFrame, keys: list[str], y: str, low: float, high: float) -> DataFrame:
    """Points strictly within a band around their group's median height."""
    middle = quantiles(points, keys, y, {"_middle": 0.5})
    h = F.col(y) - F.col("_middle")
    return matched(points, middle, keys).where((h > low) & (h < high)).drop("_middle")
