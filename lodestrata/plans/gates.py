"""Stage gates: one row for each session with the figures and whether they pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_rule
from ..operators import temporal

#: Nominal rates and tolerances of the gates.
NOMINAL_HZ = {"poses": 60.0, "lidar": 10.0, "frames": 10.0}
LIVE_LOW, LIVE_HIGH, REPLAY_LOW, REPLAY_HIGH, LEAST_ROWS = 0.6, 1.25, 0.6, 1.4, 10
SKEW_WINDOW_S, SKEW_BUDGET_US, LATENCY_SPREAD_US, LAG_SPREAD_US = 43.0, 3_000.0, 2_000.0, 10_000.0
LEAST_REVS, LEAST_MOTION, MOST_TILT, LEAST_CORRELATION = 200, 15.0, 0.5, 0.85


def live_rates(rows: DataFrame, nominal: float) -> DataFrame:
    """session_id, n_rows, hz, passed: rate over elapsed time within tolerance."""
    found = temporal.rates(rows, ["session_id"], "t_arrival_us")
    return found.select("session_id", "n_rows", "hz", F.coalesce(F.col("hz").between(LIVE_LOW * nominal, LIVE_HIGH * nominal), F.lit(False)).alias("passed"))


def replay_timing(rows: DataFrame, nominal: float) -> DataFrame:
    """session_id, n_rows, hz, worst_gap, near_zero, monotone, why_not: null why_not passes."""
    stats = temporal.gap_stats(rows, ["session_id"], "t_arrival_us", "seq")
    burst = temporal.bursts(rows, ["session_id"], "t_arrival_us", "seq")
    order = temporal.in_order(rows, ["session_id"], "t_arrival_us", "seq")
    out = stats.join(burst, "session_id", "left").join(order, "session_id")
    reason = first_rule((F.col("n_rows") < LEAST_ROWS, "few rows"), (~F.col("monotone"), "stamps fall"), (~F.col("hz").between(REPLAY_LOW * nominal, REPLAY_HIGH * nominal), "rate"), (F.coalesce("bunched", F.lit(False)), "bunched"))
    return out.select("session_id", "n_rows", "hz", "worst_gap", "near_zero", "monotone", reason.alias("why_not"))


def lossless(lidar: DataFrame) -> DataFrame:
    """session_id, n_samples, off_grid: samples that don't survive the fixed-point round trip."""
    s = lidar.select("session_id", F.explode("samples").alias("s")).select("session_id", (F.col("s.angle_q6") / 64.0).alias("deg"), (F.col("s.dist_q2") / 4.0).alias("mm"))
    off = (F.abs(F.bround(F.col("deg") * 64) / 64 - F.col("deg")) > 1e-6) | (F.abs(F.bround(F.col("mm") * 4) / 4 - F.col("mm")) > 1e-6)
    return s.groupBy("session_id").agg(F.count("*").alias("n_samples"), F.count_if(off).alias("off_grid"))


def clock_agreement(clock: DataFrame, lags: DataFrame) -> DataFrame:
    """One row over all sessions: spreads of skew, latency floor and lag, and whether each is within its limit; one session alone has no spread and fails."""
    per = clock.groupBy("session_id").agg(F.first("pooled").alias("skew"), F.min("intercept").alias("floor_us"))
    a = per.agg(F.count("*").alias("n_sessions"), ((F.max("skew") - F.min("skew")) * SKEW_WINDOW_S * 1e6).alias("skew_error_us"), (F.max("floor_us") - F.min("floor_us")).alias("latency_spread_us"))
    b = lags.agg(F.count("*").alias("n_lags"), (F.max("lag_us") - F.min("lag_us")).alias("lag_spread_us"))
    return a.crossJoin(b).withColumn("passed", (F.col("n_sessions") >= 2) & (F.col("skew_error_us") <= SKEW_BUDGET_US) & (F.col("latency_spread_us") <= LATENCY_SPREAD_US) & (F.col("n_lags") >= 3) & (F.col("lag_spread_us") <= LAG_SPREAD_US))


def lag_confidence(lags: DataFrame, facts: DataFrame) -> DataFrame:
    """lags with why_not from facts(session_id, n_revs, motion, tilt_ratio): the first rule that fails."""
    reason = first_rule((F.col("n_revs") < LEAST_REVS, "few revolutions"), (F.col("motion") < LEAST_MOTION, "little motion"), (F.col("tilt_ratio") > MOST_TILT, "tilted"), (F.col("correlation") < LEAST_CORRELATION, "weak correlation"))
    return lags.join(facts, "session_id").withColumn("why_not", reason)


def sensor_bench(samples: DataFrame) -> DataFrame:
    """One row: rates, coverage and quality of raw samples(t_us, start, degrees, mm, quality)."""
    valid = F.col("mm") > 0
    elapsed = (F.max("t_us") - F.min("t_us")) / 1e6
    bins = F.count_distinct(F.when(valid, F.pmod(F.col("degrees").cast("int"), F.lit(360))))
    r = F.when(valid, F.col("mm"))
    out = samples.agg(F.count("*").alias("n"), (100 * F.avg(valid.cast("double"))).alias("valid_percent"), (F.count("*") / elapsed).alias("sample_hz"), (F.count_if("start") / elapsed).alias("scan_hz"), bins.alias("bins"), F.min(r).alias("nearest"), F.median(r).alias("middle"), F.max(r).alias("farthest"), F.avg("quality").alias("quality"))
    return out.withColumn("passed", (F.col("scan_hz") >= 2) & (F.col("bins") >= 180))


def top_down(samples: DataFrame, width: int = 73, height: int = 33) -> DataFrame:
    """column, row, n: samples seen from above on a character raster, scaled to the 95th percentile of range."""
    rows = samples.where("mm > 0")
    scale = F.broadcast(rows.agg(F.percentile("mm", 0.95).alias("_far")))
    a = F.radians("degrees")
    c = F.round((width - 1) / 2 * (1 + F.sin(a) * F.col("mm") / F.col("_far"))).cast("int")
    r = F.round((height - 1) / 2 * (1 - F.cos(a) * F.col("mm") / F.col("_far"))).cast("int")
    return rows.crossJoin(scale).select(c.alias("column"), r.alias("row")).where(F.col("column").between(0, width - 1) & F.col("row").between(0, height - 1)).groupBy("column", "row").agg(F.count("*").alias("n"))
