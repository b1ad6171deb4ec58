"""Reports, the calibration file, live and replay checks, transforms, frame limits, digests in blocks."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import geometry as G
from lodestrata.operators import fusion, robust
from lodestrata.plans import calibrate, reports
from lodestrata.plans.session import Sessions
from lodestrata.sources import schemas

from . import room


@pytest.fixture(scope="module")
def session(spark):
    poses = [(*r[:5], r[5] + 0.3 * math.sin(r[1] / 20), *r[6:]) for r in room.poses()]  # up and down, so that walls have a height
    tables = {"poses": spark.createDataFrame(poses, schemas.POSES), "lidar": spark.createDataFrame(room.lidar(), schemas.LIDAR)}
    return Sessions(spark, "", room.RVEC, room.TVEC, tables=tables)


def test_transforms():
    m = G.rigid_matrix((0.0, math.pi / 2, 0.0), (1.0, 2.0, 3.0))
    assert np.allclose(m, [[0, 0, 1, 1], [0, 1, 0, 2], [-1, 0, 0, 3], [0, 0, 0, 1]])
    assert G.rigid_text((math.radians(10), 0.0, -math.pi), (0.1, -0.025, 0.0), 0.0015) == "rot [ +10.00   +0.00 -180.00] deg   trans [ +10.0   -2.5   +0.0] cm   dt   +1.5 ms"


def test_nan_mean(spark):
    rows = spark.createDataFrame([("a", 1.0, 5, 9), ("b", math.nan, 2, 3), ("c", 2.0, 1, 1)], "session_id string, thickness_m double, n_voxels long, n_points long")
    assert tuple(reports.combined(rows).first()) == (1.5, 8, 13)
    assert tuple(reports.combined(rows.where("session_id = 'b'")).first()) == (None, 2, 3) and tuple(reports.combined(rows.limit(0)).first()) == (None, 0, 0)


def test_first_frames(spark):
    rows = spark.createDataFrame([(s, k * 7, [k]) for s in "ab" for k in range(5)], "session_id string, seq long, depth_mm array<int>")
    assert sorted((r.session_id, r.seq) for r in fusion.first_frames(rows, 2).collect()) == [(s, k) for s in "ab" for k in (0, 7)]
    assert fusion.first_frames(rows, None).count() == 10 and fusion.first_frames(rows, 0).count() == 0


def test_few_samples_refuse_a_calibration_wherever_they_lie(spark):
    row = lambda s, k, y: (s, 0.01 * (k % 50), 0.0, 0.0, float(y), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)
    kinds = "session_id string, a double, b double, px double, py double, pz double, qx double, qy double, qz double, qw double, vx double, vy double, vz double"
    start = np.zeros((1, 7))
    few = spark.createDataFrame([row("s", k, 0) for k in range(999)], kinds)
    assert calibrate.costs(few, start, 1) == [calibrate.REJECT]
    # 1,000 samples count, though none lies in the band around their median height
    apart = spark.createDataFrame([row("s", k, 5 * (-1) ** k) for k in range(1000)], kinds)
    assert calibrate.costs(apart, start, 1) == [0.0]
    assert calibrate.costs(apart.unionByName(few.withColumn("session_id", F.lit("t"))), start, 2) == [calibrate.REJECT]


def test_calibration_report_and_file(spark, session, folder):
    found = {"rx": room.RVEC[0] + 0.02, "ry": 0.0, "rz": 0.0, "tx": 0.05, "ty": 0.0, "tz": 0.0, "dt_s": 0.001}
    rows = {r.stage: r for r in reports.calibration_report(session, found, f"{folder}/calibration/extrinsic.json").collect()}
    assert rows["before"].mean_plane_rms_m < 0.02 and rows["after"].points > 10_000 and rows["before"].voxels > 100
    assert rows["after"].improved == (rows["after"].mean_plane_rms_m < rows["before"].mean_plane_rms_m) and "+5.0" in rows["after"].transform
    with open(f"{folder}/calibration/extrinsic.json") as f:
        held = json.load(f)
    assert held["tvec_m"] == [0.05, 0.0, 0.0] and held["residual_dt_us"] == 1000.0 and held["sessions"] == ["s1"]
    assert held["before"]["mean_plane_rms_m"] == rows["before"].mean_plane_rms_m and set(held["after"]) == {"mean_plane_rms_m", "voxels", "points"}
    value = reports.write_mounting(spark, f"{folder}/calibration/extrinsic.json", found, -11_200.0, 1, [], {"mean_plane_rms_m": math.nan}, {})
    with open(f"{folder}/calibration/extrinsic.json") as f:
        assert json.load(f) == value and value["before"] == {"mean_plane_rms_m": None} and value["total_lag_us"] == -10_200.0


def test_fusion_report(session):
    r = reports.fusion_report(session).first()
    assert r.n_keyframes > 5 and r.n_edges >= r.n_keyframes - 1 + r.n_loops and 0 < r.walls_after_m < 0.03 and r.moved_median_m <= r.moved_most_m < 0.1
    assert r.thinner == pytest.approx(1 - r.walls_after_m / r.walls_before_m) and r.fewer == pytest.approx(1 - r.cells_after / r.cells_before)


def test_clock_facts(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(7200):
        device = 1_000_000 + int(k * 1e6 / 60)
        t = device - 1_000_000
        rows.append(("s1", k, device, device + int(5_000_000 - 380e-6 * t + 16_300 * (t // 43_000_000) + abs(rng.normal(0, 800)))))
    held = spark.createDataFrame(rows, "session_id string, seq long, t_device_us long, t_arrival_us long")
    s = Sessions(spark, "", tables={"poses": held})
    r = reports.clock_facts(held, s.clock).first()
    assert r.n == 7200 and r.jumps == 2 and abs(r.jump_median_us - 16_300) < 1_000 and abs(r.skew_ppm + 380) < 25
    assert r.skew_large and r.skew_reliable and r.skew_uncertainty_ppm < 30 and 0 < r.latency_p50_us < r.latency_p95_us < 3_000
    assert r.offset_us == s.clock.orderBy(F.desc("start_us")).first().intercept
    short = held.where("seq < 120")
    r = reports.clock_facts(short, Sessions(spark, "", tables={"poses": short}).clock).first()
    assert not r.skew_reliable and r.skew_uncertainty_ppm is None and r.jumps == 0 and r.jump_median_us is None


def test_live_check(spark, session):
    streams = {"poses": session.stream("poses"), "lidar": session.stream("lidar"), "frames": session.stream("poses").where("seq % 6 = 0")}
    rows = {r.stream: r for r in reports.live_check(streams).collect()}
    assert {k: r.why_not for k, r in rows.items()} == {"poses": None, "lidar": None, "frames": None} and 59 < rows["poses"].hz < 61
    why = lambda streams, **kw: {r.stream: r.why_not for r in reports.live_check(streams, **kw).collect()}
    assert why(streams, dropped={"lidar": 3})["lidar"] == "rows were dropped"
    assert why(streams | {"lidar": session.stream("lidar").limit(0)})["lidar"] == "nothing came"
    assert why({"poses": session.stream("poses").where("seq % 3 = 0"), "lidar": session.stream("poses")}) == {"poses": "rate below nominal", "lidar": "arrivals burst"}


def test_replay_check(spark, session):
    whys = lambda s: {r.check: r.why_not for r in reports.replay_check(s).collect()}
    assert whys(session) == dict.fromkeys(("digest", "poses", "lossless", "timing of poses", "timing of lidar"))
    poses = session.stream("poses")
    broken = poses.withColumn("px", F.when(F.col("seq") == 5, float("nan")).otherwise(F.col("px")))
    assert whys(Sessions(spark, "", tables={"poses": broken, "lidar": session.stream("lidar")}))["poses"] == "a pose isn't whole"
    assert whys(Sessions(spark, "", tables={"poses": poses.limit(0), "lidar": session.stream("lidar")}))["poses"] == "no poses"


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_digest_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(robust, "DIGEST_BLOCK", block)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    groups = {"a": [f"t{k}" for k in range(23)], "b": ["x"], "c": [f"t{k}" for k in range(7)]}

    def tree(texts, levels):
        held = [sha(t) for t in texts]
        for _ in range(levels):
            held = [sha("".join(held[i : i + block])) for i in range(0, len(held), block)]
        return held[0]

    levels, n = 1, 23
    while n > block:
        levels, n = levels + 1, -(-n // block)
    rows = spark.createDataFrame([(g, k, t) for g, ts in groups.items() for k, t in enumerate(ts)], "g string, k long, t string").repartition(4)
    found = {r.g: r.digest for r in robust.ordered_digest(rows, ["g"], ["k"], "t").collect()}
    assert found == {g: tree(ts, levels) for g, ts in groups.items()}
    swapped = rows.withColumn("k", F.when(F.col("g") == "a", 22 - F.col("k")).otherwise(F.col("k")))
    other = {r.g: r.digest for r in robust.ordered_digest(swapped, ["g"], ["k"], "t").collect()}
    assert other["a"] != found["a"] and other["b"] == found["b"] and robust.ordered_digest(rows.limit(0), ["g"], ["k"], "t").count() == 0


def test_other_clocks_and_filters(spark, session):
    fixed = lambda poses: poses.groupBy("session_id").agg(F.min("t_device_us").alias("start_us")).select("session_id", "start_us", F.lit(500.0).alias("intercept"), F.lit(0.0).alias("pooled"))
    s = Sessions(spark, "", room.RVEC, room.TVEC, tables=session.tables, fit_clock=fixed, keep_samples=lambda rows: rows.where("angle < 4"))
    assert s.path.agg(F.min("t_us")).first()[0] == room.START + 500 and s.samples.agg(F.max("angle")).first()[0] < 4
    assert s.samples.count() < session.samples.count()
