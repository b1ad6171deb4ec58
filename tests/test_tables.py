"""Stowed tables go when they are no longer needed; long ranges of numbers are made in blocks."""

import glob

from pyspark.sql import functions as F

from lodestrata.operators import robust, temporal
from lodestrata.operators.ranks import every_number
from lodestrata.sources.tables import _stowed, stow, stowing


def held(spark):
    return len(glob.glob(f"{_stowed(spark).removeprefix('file://')}/**/_SUCCESS", recursive=True))


def test_stowed_tables_go_with_their_block(spark):
    before, outside = held(spark), stow(spark.range(3))
    with stowing(spark):
        a = stow(spark.range(5))
        with stowing(spark):
            assert stow(a.where("id > 1")).count() == 3 and held(spark) == before + 3
        assert held(spark) == before + 2 and a.count() == 5
    assert held(spark) == before + 1 and outside.count() == 3


def test_every_number(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("b", -3, 10_000), ("c", 4095, 4096)], "k string, a long, b long")
    found = every_number(rows, F.col("a"), F.col("b"), "n")
    assert {r.k: (r.n, r.low, r.high) for r in found.groupBy("k").agg(F.count_distinct("n").alias("n"), F.min("n").alias("low"), F.max("n").alias("high")).collect()} == {"a": (1, 0, 0), "b": (10_004, -3, 10_000), "c": (2, 4095, 4096)}
    assert found.count() == 10_007


def test_one_outlier_makes_many_bins_and_no_huge_row(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 300_000.0)], "k string, v double")
    bins = robust.histogram(rows, ["k"], "v", 0.5)
    assert bins.count() == 600_000 and bins.agg(F.sum("n")).first()[0] == 3
    grid = temporal.grid(spark.createDataFrame([("a", 3), ("a", 1_000_003)], "k string, t long"), ["k"], "t", 10)
    assert grid.agg(F.count("*"), F.min("t"), F.max("t")).first() == (100_000, 10, 1_000_000)
