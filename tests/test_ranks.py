"""Places and quantiles of groups that no task may hold, against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ranks, robust, temporal


def plain(values, p):
    x = sorted(values)
    at = (len(x) - 1) * p
    k = int(at)
    return x[k] if k + 1 == len(x) or x[k] == x[min(k + 1, len(x) - 1)] else (k + 1 - at) * x[k] + (at - k) * x[k + 1]


def cases(spark):
    rng = np.random.default_rng(0)
    groups = {"normal": rng.normal(0, 1, 3000), "ties": rng.integers(0, 3, 3000).astype(float), "one value": np.full(500, 2.5), "outlier": np.append(rng.normal(0, 1e-6, 900), [1e300, -1e300]), "steps": np.repeat(np.arange(40.0), rng.integers(1, 300, 40)), "single": np.array([7.0]), None: rng.exponential(1, 1500)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None), ("empty", None)]
    return groups, spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("at_once,cuts", [(100_000, 64), (50, 8), (1, 4)])
def test_quantiles_by_search(spark, monkeypatch, at_once, cuts):
    monkeypatch.setattr(ranks, "SORTED_AT_ONCE", at_once)
    monkeypatch.setattr(ranks, "CUTS", cuts)
    groups, rows = cases(spark)
    points = {"least": 0.0, "p1": 0.01, "half": 0.5, "p95": 0.95, "most": 1.0}
    found = {r.k: r for r in ranks.quantiles(rows, ["k"], "v", points).collect()}
    assert set(found) == set(groups)
    for k, x in groups.items():
        assert [found[k][n] for n in points] == pytest.approx([plain(x, p) for p in points.values()], rel=1e-12), k
    whole = ranks.quantiles(rows, [], "v", points).collect()
    every = np.concatenate(list(groups.values()))
    assert len(whole) == 1 and [whole[0][n] for n in points] == pytest.approx([plain(every, p) for p in points.values()], rel=1e-12)
    none = ranks.quantiles(rows.where("k = 'empty'"), [], "v", points).collect()
    assert [tuple(r) for r in none] == [(None,) * 5] and ranks.quantiles(rows.where("k = 'empty'"), ["k"], "v", points).count() == 0


def test_spread_by_search(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED_AT_ONCE", 100)
    groups, rows = cases(spark)
    found = {r.k: r for r in robust.mad(rows, ["k"], "v").collect()}
    for k, x in groups.items():
        middle = plain(x, 0.5)
        assert (found[k].middle, found[k].sigma) == pytest.approx((middle, 1.4826 * plain(np.abs(x - middle), 0.5)))


def test_a_group_of_ten_million_values(spark):
    n = 10_000_000
    rows = spark.range(0, n, 1, 16).select(F.lit("g").alias("k"), ((F.col("id") * 48271 % n) / 8.0).alias("v"))
    found = ranks.quantiles(rows, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.999}).collect()
    assert [tuple(r) for r in found] == [("g", *(p * (n - 1) / 8 for p in (0.25, 0.5, 0.999)))]


@pytest.mark.parametrize("skew", ["even", "dense", "one key"])
def test_places(spark, skew):
    rng = np.random.default_rng(1)
    n = 20_000
    t = {"even": rng.integers(0, 10**9, n), "dense": np.where(rng.random(n) < 0.95, rng.integers(0, 1000, n), rng.integers(0, 10**12, n)), "one key": rng.integers(0, 10**6, n)}[skew]
    key = np.zeros(n, int) if skew == "one key" else rng.integers(0, 5, n)
    rows = [(int(k) if k else None, int(x), i) for i, (k, x) in enumerate(zip(key, t))]
    found = ranks.placed(spark.createDataFrame(rows, "k int, t long, i long"), ["k"], ["t", "i"], "place", "n").collect()
    want, count = {}, {}
    for k, x, i in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2])):
        count[k] = count.get(k, 0) + 1
        want[i] = count[k]
    assert len(found) == n and {r.i: r.place for r in found} == want and all(r.n == count[r.k] for r in found)
    assert ranks.placed(spark.createDataFrame([], "k int, t long"), ["k"], ["t"]).count() == 0


def test_ranges_are_even_at_any_density(spark):
    rows = spark.range(0, 400_000, 1, 8).select((F.when(F.col("id") % 20 == 0, F.col("id") * 10**7).otherwise(F.col("id") % 997)).alias("t"), "id")
    held = temporal.global_positions(rows, ["t", "id"])
    assert held.agg(F.count_distinct("position").alias("d"), F.min("position").alias("a"), F.max("position").alias("b")).first() == (400_000, 1, 400_000)
    sizes = sorted(r["count"] for r in rows.repartitionByRange(16, "t", "id").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
