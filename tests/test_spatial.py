"""Nearest targets and pairs within a radius where all of them lie in one cell, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import spatial


def clouds(kind, n, m, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1, 1, (n, 3))
    t = {
        "even": rng.uniform(-1, 1, (m, 3)),
        "dense": np.concatenate([rng.normal(0.05, 0.004, (m - 20, 3)), rng.uniform(-1, 1, (20, 3))]),
        "stacked": np.concatenate([np.tile(rng.uniform(0, 0.1, (3, 3)), (m // 3, 1)), rng.uniform(-1, 1, (m - m // 3 * 3, 3))]),
        "line": np.column_stack([np.linspace(0, 0.09, m), np.full(m, 0.01), np.zeros(m)]),
    }[kind]
    if kind != "even":
        p[: n // 2] = t[rng.integers(0, len(t), n // 2)] + rng.normal(0, 0.02, (n // 2, 3))
    return p, t


@pytest.mark.parametrize("kind,leaf", [("even", 64), ("dense", 2), ("dense", 64), ("stacked", 2), ("line", 8)])
def test_nearest(spark, monkeypatch, kind, leaf):
    monkeypatch.setattr(spatial, "LEAF_TARGETS", leaf)
    p, t = clouds(kind, 300, 240)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "i long, x double, y double, z double")
    targets = spark.createDataFrame([(1000 - k, *map(float, x), f"t{k}") for k, x in enumerate(t)], "k long, tx double, ty double, tz double, name string")
    found = {r.i: r.name for r in spatial.nearest(points, "i", ["x", "y", "z"], targets, ["tx", "ty", "tz"], "k", ["name"], 0.1).collect()}
    for i, x in enumerate(p):
        d = (x[0] - t[:, 0]) * (x[0] - t[:, 0]) + (x[1] - t[:, 1]) * (x[1] - t[:, 1]) + (x[2] - t[:, 2]) * (x[2] - t[:, 2])
        near = [(v, 1000 - k) for k, v in enumerate(d) if v < 0.1 * 0.1]
        assert found[i] == (f"t{1000 - min(near)[1]}" if near else None)
    assert len(found) == 300
    none = spatial.nearest(points, "i", ["x", "y", "z"], targets.limit(0), ["tx", "ty", "tz"], "k", ["name"], 0.1)
    assert none.count() == 300 and none.where("name is not null").count() == 0


def test_a_cell_with_many_targets_isnt_searched_whole(spark):
    n = 60_000
    cloud = lambda seed: spark.range(0, n, 1, 8).select(F.col("id").alias(f"k{seed}"), *((F.rand(10 * seed + i) * 0.0999).alias(f"{a}{seed}") for i, a in enumerate("xyz")))
    points, targets = cloud(1), cloud(2)
    found = spatial.nearest(points, "k1", ["x1", "y1", "z1"], targets, ["x2", "y2", "z2"], "k2", ["x2", "y2", "z2"], 0.1)
    d = sum(((F.col(f"{a}1") - F.col(f"{a}2")) * (F.col(f"{a}1") - F.col(f"{a}2")) for a in "xyz"), F.lit(0.0))
    rows = found.where("k1 % 600 = 0").select(d.alias("d"), "x1", "y1", "z1").collect()
    t = np.array([tuple(r) for r in targets.select("x2", "y2", "z2").collect()])
    for r in rows:
        assert r.d == pytest.approx(((t - [r.x1, r.y1, r.z1]) ** 2).sum(axis=1).min())


@pytest.mark.parametrize("slice_", [5, 4096])
def test_radius_pairs(spark, monkeypatch, slice_):
    monkeypatch.setattr(spatial, "SLICE_POINTS", slice_)
    p, _ = clouds("dense", 160, 60, 3)
    rows = [(k % 2, i, *map(float, x)) for k, (i, x) in enumerate(enumerate(p))]
    held = spark.createDataFrame(rows, "s int, i long, x double, y double, z double")
    got = sorted((r.s, r.i, r.j) for r in spatial.radius_pairs(held, "i", ["x", "y", "z"], 0.1, ["s"]).collect())
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and sum((u - v) * (u - v) for u, v in zip(a[2:], b[2:])) <= 0.1 * 0.1)
    assert got == want and len(want) > 100
