import bisect
import math

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.functions.scalars import rounded
from lodestrata.operators import robust, spatial, temporal
from lodestrata.operators.graph import components, reachable

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(st.lists(st.integers(-50, 50), max_size=12), st.lists(st.integers(-50, 50), min_size=1, max_size=12, unique=True), st.integers(1, 40))
def test_neighbours_across_buckets(spark, left, right, bucket):
    l = spark.createDataFrame([("k", i, t) for i, t in enumerate(left)], "key string, id int, t long")
    r = spark.createDataFrame([("k", t, float(t)) for t in right] + [("other", 0, -1.0)], "key string, rt long, v double")
    got = {x.id: (x.before and x.before.v, x.after and x.after.v) for x in temporal.neighbours(l, r, ["key"], "t", "rt", ["v"], bucket).collect()}
    want = {i: (max((float(x) for x in right if x <= t), default=None), min((float(x) for x in right if x > t), default=None)) for i, t in enumerate(left)}
    assert got == want


def test_interpolation_is_clamped(spark):
    path = spark.createDataFrame([("s", 0, 0.0), ("s", 10, 10.0), ("s", 30, 50.0)], "key string, rt long, v double")
    at = spark.createDataFrame([("s", t) for t in (-5, 0, 4, 20, 30, 99)], "key string, t long")
    assert [r.v for r in temporal.asof_interpolate(at, path, ["key"], "t", "rt", ["v"], 7).orderBy("t").collect()] == [0.0, 0.0, 4.0, 30.0, 50.0, 50.0]


@FEW
@given(st.lists(st.tuples(*[st.floats(-1, 1)] * 3), min_size=1, max_size=15), st.lists(st.tuples(*[st.floats(-1, 1)] * 3), min_size=1, max_size=15))
def test_nearest_against_all_pairs(spark, points, targets):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, x double, y double, z double")
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(targets)], "tid int, a double, b double, c double")
    got = {r.id: r.tid for r in spatial.nearest(p, "id", ["x", "y", "z"], t, ["a", "b", "c"], "tid", ["tid"], 0.5).collect()}
    for i, x in enumerate(points):
        near = min(((sum((u - v) * (u - v) for u, v in zip(x, y)), k) for k, y in enumerate(targets)))
        assert got[i] == (near[1] if near[0] < 0.25 else None)


def test_radius_pairs_by_group(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{k % 2}", k, *map(float, rng.uniform(-1, 1, 2))) for k in range(60)]
    got = {(r.i, r.j) for r in spatial.radius_pairs(spark.createDataFrame(rows, "g string, id int, x double, z double"), "id", ["x", "z"], 0.3, ["g"]).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 0.09}


@FEW
@given(st.lists(st.tuples(*[st.floats(-1, 1, allow_subnormal=False)] * 4).filter(lambda q: sum(x * x for x in q) > 0.1), min_size=2, max_size=2), st.floats(0, 1))
def test_slerp_is_a_unit_between_its_ends(spark, qs, u):
    a, b = (G.unit_quaternion(tuple(F.lit(x) for x in q)) for q in qs)
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(G.slerp(a, b, F.lit(u)), "xyzw")), G.norm(G.rotate(a, (F.lit(1.0), F.lit(2.0), F.lit(2.0)))).alias("n")).first()
    assert abs(r.x**2 + r.y**2 + r.z**2 + r.w**2 - 1) < 1e-9 and abs(r.n - 3) < 1e-9
    q = np.array([np.array(x) / np.linalg.norm(x) for x in qs])
    half = math.acos(min(1, abs(float(q[0] @ q[1]))))
    assert abs(math.acos(min(1, abs(float(q[0] @ np.array([r.x, r.y, r.z, r.w]))))) - u * half) < 1e-4


def test_motions_undo_each_other(spark):
    a = tuple(F.lit(x) for x in (1.0, -2.0, 0.7))
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(G.compose(a, G.inverse(a)), "xzy")), G.wrap_angle(F.lit(4.0)).alias("w")).first()
    assert max(abs(r.x), abs(r.z), abs(r.y)) < 1e-12 and abs(r.w - (4 - 2 * math.pi)) < 1e-12
    m = np.array(G.rodrigues((0.3, -0.2, 0.9)))
    assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(G.rodrigues((0, 0, 0)), np.eye(3))


@FEW
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=14))
def test_components(spark, edges):
    parent = list(range(13))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    links = spark.createDataFrame(edges, "a int, b int")
    assert {r.node: r.label for r in components(links).collect()} == {n: root(n) for e in edges for n in e}
    nodes = spark.createDataFrame([(n,) for e in edges for n in e], "node int").distinct()
    seeds = spark.createDataFrame([(edges[0][0],), (99,)], "node int")
    assert {r.node for r in reachable(nodes, links, seeds).collect()} == {n for e in edges for n in e if root(n) == root(edges[0][0])}


def test_peaks_and_histogram(spark):
    rows = [(v,) for v in [0.5] * 10 + [1.5] * 30 + [5.5] * 40 + [10.0]]
    bins = robust.histogram(spark.createDataFrame(rows, "v double"), [], "v", 1.0)
    assert bins.agg(F.sum("n")).first()[0] == 81 and bins.count() == 10
    got = robust.peaks(bins, [], 1.0, 0.2).orderBy("peak").collect()
    assert [(r.first_bin, r.last_bin, r.mass) for r in got] == [(0, 1, 40), (5, 5, 40)]


def test_ordered_digest_sees_order(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "x")], "k string, o int, t string")
    a, b = (r.digest for r in robust.ordered_digest(rows, ["k"], ["o"], "t").orderBy("k").collect())
    assert a != b


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key string, t long, seq long, v double")
    assert temporal.gap_stats(none, ["key"], "t", "seq").count() == 0
    assert temporal.envelope(none, ["key"], "t", "v", "seq", 10).count() == 0
    assert temporal.theil_sen(none, ["key"], "t", "v").count() == 0
    assert robust.mad(none, ["key"], "v").count() == 0
    assert temporal.resample(none, ["key"], "t", ["v"], 10, 100).count() == 0


def test_near_zero_angle_is_blended(spark):
    q = tuple(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(G.slerp(q, q, F.lit(0.3)), "xyzw"))).first()
    assert (r.x, r.y, r.z) == (0, 0, 0) and r.w == pytest.approx(1)


def test_neighbours_over_many_buckets_in_few_steps(spark):
    """Rows of 9,000 buckets, three in four without a right row: right across blocks of buckets, and no window that is gone through again for each row."""
    left = spark.range(9000).select(F.lit("k").alias("key"), (F.col("id") * 10 + 5).alias("t"), "id")
    right = spark.range(9000).where("id % 4 = 1 and (id < 1500 or id > 5000)").select(F.lit("k").alias("key"), (F.col("id") * 10).alias("rt"), F.col("id").alias("v"))
    found = temporal.neighbours(left, right, ["key"], "t", "rt", ["v"], 10)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    held = [i for i in range(9000) if i % 4 == 1 and (i < 1500 or i > 5000)]
    for r in found.collect():
        k = bisect.bisect_right(held, r.id)
        assert (r.before and r.before.v, r.after and r.after.v) == (held[k - 1] if k else None, held[k] if k < len(held) else None)


def test_neighbours_of_one_bucket_are_dealt(spark):
    """Left rows of a single bucket meet the same right rows in slices, and no task has all of them."""
    left = spark.range(20_000).select(F.lit("k").alias("key"), "id", F.array("id").alias("list"))
    right = spark.createDataFrame([("k", 100, 1), ("k", 15_000, 2)], "key string, rt long, v long")
    found = temporal.neighbours(left, right, ["key"], "id", "rt", ["v"], 1_000_000, slices=32)
    rows = found.select("id", F.col("before.v").alias("b"), F.col("after.v").alias("a")).collect()
    assert sorted((r.id, r.b, r.a) for r in rows) == [(i, None if i < 100 else 1 if i < 15_000 else 2, 1 if i < 100 else 2 if i < 15_000 else None) for i in range(20_000)]
    assert "_slice" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_is_that_of_doubles(spark):
    """Halves that a double only nearly is: its product with ten to the places decides, as in DuckDB."""
    values = [s * (k + 0.5) / 8 * d / 1000 + 1.5 for s in (-1, 1) for k in range(4) for d in range(150, 3000, 7)] + [0.0, -0.25, 1e9]
    found = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 6).alias("v")).collect()]
    assert found == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
