"""Range profiles, sector masks, yaw steps and the lag between two sensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 720
#: Search for the lag: half width and grid of it, and rows that either series needs.
SEARCH_S, RATE_HZ, LEAST_ROWS, LEAST_S = 0.5, 500, 8, 1.0


def angle_bin(degrees: Column, bins: int) -> Column:
    """Bin of an angle, truncated after it is brought into the circle."""
    return F.pmod((degrees / 360.0 * bins).cast("int"), F.lit(bins))


def range_profile(samples: DataFrame, keys: list[str], degrees: str, distance: str, bins: int = BINS) -> DataFrame:
    """keys, bin, mean_range: mean of the valid distances in each bin, null where there is none."""
    means = samples.where(F.col(distance) > 0).groupBy(*keys, angle_bin(F.col(degrees), bins).alias("bin")).agg(F.avg(distance).alias("mean_range"))
    every = samples.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(means, [*keys, "bin"], "left")


def near_share(samples: DataFrame, keys: list[str], degrees: str, distance: str, bins: int, near: float) -> DataFrame:
    """keys, sector, near_share: how often a sector's samples are nearer than near; angles may be negative."""
    sector = F.floor(F.pmod(F.col(degrees), F.lit(360.0)) / 360.0 * bins).cast("int")
    return samples.groupBy(*keys, sector.alias("sector")).agg(F.avg((F.col(distance) < near).cast("double")).alias("near_share"))


def without_near_sectors(samples: DataFrame, keys: list[str], degrees: str, distance: str, bins: int = 72, near: float = 1.0, persist: float = 0.45) -> DataFrame:
    """samples outside the sectors that something near fills persistently, such as whoever carries the sensor."""
    filled = near_share(samples, keys, degrees, distance, bins, near).where(F.col("near_share") >= persist).select(*keys, "sector")
    sector = F.floor(F.pmod(F.col(degrees), F.lit(360.0)) / 360.0 * bins).cast("int")
    return samples.withColumn("sector", sector).join(F.broadcast(filled) if not keys else filled, [*keys, "sector"], "left_anti").drop("sector")


def turns(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bins by which each row's profile has turned: the peak of the circular correlation, for all rows in one transform.

    A gap counts as its profile's mean; a profile of gaps alone, or without contrast, correlates with nothing.
    """
    both = np.stack([before, after])
    known = np.isfinite(both)
    n = np.maximum(known.sum(axis=2, keepdims=True), 1)
    centred = np.where(known, both - np.where(known, both, 0).sum(axis=2, keepdims=True) / n, 0.0)
    length = np.linalg.norm(centred, axis=2, keepdims=True)
    waves = np.fft.rfft(np.divide(centred, length, out=np.zeros_like(centred), where=length > 1e-12), axis=2)
    peak = np.fft.irfft(waves[1] * np.conj(waves[0]), both.shape[2], axis=1).round(12).argmax(axis=1)
    return np.where(peak > both.shape[2] // 2, peak - both.shape[2], peak)


@F.pandas_udf(T.DoubleType())
def yaw_step(before: pd.Series, after: pd.Series) -> pd.Series:
    """Degrees from one profile to the next, in (-180, 180]; null where one is missing."""
    out = pd.Series(np.nan, index=before.index)
    here = np.flatnonzero(before.notna() & after.notna())
    size = before.iloc[here].map(len)
    for n in np.unique(size):  # profiles of one session have one length
        rows = here[(size == n).to_numpy()]
        a, b = (np.array(x.iloc[rows].tolist(), float).reshape(len(rows), n) for x in (before, after))
        out.iloc[rows] = turns(a, b) * 360.0 / n
    return out


def yaw_steps(profiles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order, step_deg between consecutive profiles; profiles has keys, order, bin, mean_range."""
    whole = profiles.groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("mean_range", F.lit(float("nan"))).alias("r")))).alias("p")).select(*keys, order, F.col("p")["r"].alias("p"))
    pairs = whole.withColumn("q", F.lag("p").over(Window.partitionBy(*keys).orderBy(order))).where("q is not null")
    return pairs.select(*keys, order, yaw_step("q", "p").alias("step_deg"))


def lag_of(t_a: np.ndarray, a: np.ndarray, t_b: np.ndarray, b: np.ndarray) -> tuple[float, float, int]:
    """(lag in us, correlation, sign): how late b's stamps are against a's, by cross-correlation on a common grid."""
    if min(len(t_a), len(t_b)) < LEAST_ROWS:
        return 0.0, 0.0, 1
    low, high = max(t_a[0], t_b[0]), min(t_a[-1], t_b[-1])
    if high - low < LEAST_S * 1e6:
        return 0.0, 0.0, 1
    grid = np.arange(low, high, 1e6 / RATE_HZ)
    x, y = (v - v.mean() for v in (np.interp(grid, t_a, a), np.interp(grid, t_b, b)))
    nx, ny = np.linalg.norm(x), np.linalg.norm(y)
    if nx < 1e-12 or ny < 1e-12:
        return 0.0, 0.0, 1
    size = 1 << (2 * len(grid) - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(x / nx, size) * np.conj(np.fft.rfft(y / ny, size)), size)
    reach = min(int(SEARCH_S * RATE_HZ), len(grid) - 1)
    window = np.concatenate([c[size - reach :], c[: reach + 1]])
    sign = 1 if window.max() >= -window.min() else -1
    window = sign * window
    k, shift = int(window.argmax()), 0.0
    if 0 < k < len(window) - 1:
        bend = window[k - 1] - 2 * window[k] + window[k + 1]
        shift = float(np.clip((window[k - 1] - window[k + 1]) / (2 * bend), -1, 1)) if abs(bend) > 1e-15 else 0.0
    return -((k - reach) + shift) / RATE_HZ * 1e6, float(window[k]), sign


def lags(rates: DataFrame, key: str = "session_id") -> DataFrame:
    """key, lag_us, correlation, sign from rates(key, source 'a' or 'b', t, rate), one task for each session's two series."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[group["source"] == s].sort_values("t") for s in "ab")
        lag, correlation, sign = lag_of(a["t"].to_numpy(float), a["rate"].to_numpy(float), b["t"].to_numpy(float), b["rate"].to_numpy(float))
        return pd.DataFrame({key: [group[key].iloc[0]], "lag_us": [lag], "correlation": [correlation], "sign": [sign]})

    return rates.groupBy(key).applyInPandas(one, f"{key} string, lag_us double, correlation double, sign int")


def kept_every(rows: DataFrame, keys: list[str], t: str, interval: int) -> DataFrame:
    """Rows that come at least interval after the last one kept, the first of each series included; streams through a group's batches in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[tuple, int] = {}
        for frame in frames:
            keep = np.zeros(len(frame), bool)
            for i, (key, now) in enumerate(zip(frame[keys].itertuples(index=False, name=None), frame[t], strict=True)):
                if key not in last or now - last[key] >= interval:
                    keep[i], last[key] = True, now
            yield frame[keep]

    return rows.repartition(*keys).sortWithinPartitions(*keys, t).mapInPandas(run, rows.schema)
