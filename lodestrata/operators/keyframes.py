"""Greedy keyframes: a row starts a new one when it has moved or waited enough since the last start."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOVED_M, WAITED_US = 0.25, 1_000_000


def keyframes(rows: DataFrame, keys: list[str], t: str, moved: float = MOVED_M, waited: int = WAITED_US) -> DataFrame:
    """Adds keyframe: whether the row starts one; the first of each series does. rows has x and z.

    Each start depends on the one before, so rows pass in order; only the last start of a series is held, not the series.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[tuple, tuple[int, float, float]] = {}
        for frame in frames:
            starts = []
            for key, now, x, z in zip(frame[keys].itertuples(index=False, name=None), frame[t], frame["x"], frame["z"], strict=True):
                before = last.get(key)
                new = before is None or now - before[0] >= waited or ((x - before[1]) ** 2 + (z - before[2]) ** 2) ** 0.5 >= moved
                if new:
                    last = {key: (now, x, z)}
                starts.append(new)
            yield frame.assign(keyframe=starts)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "keyframe boolean"])
    return rows.repartition(*keys).sortWithinPartitions(*keys, t).mapInPandas(run, schema)


def numbered(rows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Adds idx: the number of the keyframe that a row belongs to, from 0."""
    return rows.withColumn("idx", F.sum(F.col("keyframe").cast("long")).over(Window.partitionBy(*keys).orderBy(t)) - 1)
