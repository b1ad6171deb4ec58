"""What a stage says of its sessions: clocks, calibration before and after, fusion before and after, live and replayed streams."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import rigid_text
from ..functions.scalars import first_rule
from ..operators import fusion, robust, temporal
from ..operators.planes import wall_thickness
from ..operators.ranks import quantiles
from ..operators.spatial import occupied
from ..sources.sessions import count_mismatches, write_json
from ..sources.tables import stow
from . import gates
from .session import Sessions

#: Skew that counts as large, and the side of a counted voxel.
LARGE_SKEW_PPM, VOXEL_M = 100.0, 0.05


def nan_mean(value: Column) -> Column:
    """Mean of the numbers among values; null where there are none."""
    return F.avg(F.when(~F.isnan(value), value))


def clock_facts(rows: DataFrame, clock: DataFrame, device: str = "t_device_us", arrival: str = "t_arrival_us") -> DataFrame:
    """One row for each session: skew and how sure it is, jumps, latency above the floor, offset of the last segment.

    The skew is reliable if its uncertainty, that of the segment with most points, is under half of it.
    """
    key = ["session_id"]
    surest = F.max_by("uncertainty", F.when(F.col("uncertainty").isNotNull(), F.col("n_points")))
    facts = clock.groupBy(*key).agg(F.first("pooled").alias("pooled"), (F.count("*") - 1).alias("jumps"), surest.alias("uncertainty"), F.max_by("intercept", "start_us").alias("offset_us"))
    before = clock.select("session_id", (F.col("segment") + 1).alias("segment"), F.col("last_delay").alias("_before"))
    steps = clock.join(before, ["session_id", "segment"]).select("session_id", (F.col("first_delay") - F.col("_before")).alias("step"))
    timed = fusion.device_to_host(rows.select("session_id", device, arrival), clock, device, "_host")
    late = timed.select("session_id", (F.col(arrival) - F.col("_host")).alias("late"))
    span = rows.groupBy(*key).agg(F.count("*").alias("n"), ((F.max(device) - F.min(device)) / 1e6).alias("duration_s"))
    out = span.join(facts, key).join(quantiles(steps, key, "step", {"jump_median_us": 0.5}), key, "left").join(quantiles(late, key, "late", {"latency_p50_us": 0.5, "latency_p95_us": 0.95}), key, "left")
    skew, unsure = 1e6 * F.col("pooled"), 1e6 * F.col("uncertainty")
    return out.select(
        "session_id", "n", "duration_s", skew.alias("skew_ppm"), unsure.alias("skew_uncertainty_ppm"), "jumps", "jump_median_us", "latency_p50_us", "latency_p95_us", "offset_us",
        (F.abs(skew) > LARGE_SKEW_PPM).alias("skew_large"), F.coalesce(unsure < F.abs(skew) / 2, F.lit(False)).alias("skew_reliable"),
    )


def map_figures(points: DataFrame, banded: bool = False) -> DataFrame:
    """session_id, n_points, thickness_m (NaN where a session has too few points for a wall), n_inliers, n_cells, n_voxels.

    banded: walls are sought in the height band alone. A session at a time: each is a few passes over its points.
    """
    spark, held = points.sparkSession, stow(points.select("session_id", "x", "y", "z"))
    names = [r.session_id for r in held.select("session_id").distinct().orderBy("session_id").collect()]
    rows = []
    for name in names:
        own = held.where(F.col("session_id") == name)
        wall = robust.height_share(own, ["session_id"], "y", -1.2, 0.6) if banded else own
        sigma, n = wall_thickness(temporal.global_positions(wall.select("x", "y", "z"), ["x", "y", "z"], "seq").select((F.col("seq") - 1).alias("seq"), "x", "y", "z"))
        rows.append((name, own.count(), math.nan if sigma is None else sigma, n, fusion.sharpness(own).first().n_cells, occupied(own, ["x", "y", "z"], VOXEL_M).first().n_cells))
    return spark.createDataFrame(rows, "session_id string, n_points long, thickness_m double, n_inliers long, n_cells long, n_voxels long")


def combined(figures: DataFrame) -> DataFrame:
    """One row over all sessions: mean_plane_rms_m (of those that have one), voxels, points."""
    return figures.agg(nan_mean(F.col("thickness_m")).alias("mean_plane_rms_m"), F.coalesce(F.sum("n_voxels"), F.lit(0)).alias("voxels"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("points"))


def write_mounting(spark: SparkSession, path: str, found: dict, lag_us: float, yaw_sign: int, sessions: list[str], before: dict, after: dict) -> dict:
    """The calibration's JSON file; found: rx..tz and dt_s. Returns what it holds."""
    rvec, tvec = [found[f"r{a}"] for a in "xyz"], [found[f"t{a}"] for a in "xyz"]
    clean = lambda d: {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in d.items()}
    value = {
        "rvec_rad": rvec, "tvec_m": tvec, "residual_dt_us": 1e6 * found["dt_s"], "total_lag_us": lag_us + 1e6 * found["dt_s"], "yaw_sign": yaw_sign,
        "sessions": sessions, "before": clean(before), "after": clean(after),
    }
    write_json(spark, path, value)
    return value


def calibration_report(recording: Sessions, found: dict, path: str | None = None) -> DataFrame:
    """stage (before, after), text of the transform, and its combined figures; improved says whether the walls got thinner.

    found: row of calibrate.calibrations as a dictionary. With a path the calibration is written there.
    """
    spark = recording.spark
    after = Sessions(spark, recording.root, tuple(found[f"r{a}"] for a in "xyz"), tuple(found[f"t{a}"] for a in "xyz"), 1e6 * found["dt_s"], recording.lag_us, recording.yaw_sign, tables=recording.tables)
    rows = []
    for stage, s in (("before", recording), ("after", after)):
        figures = map_figures(s.lidar_points())
        one = combined(figures).first().asDict()
        rows.append((stage, rigid_text(s.rvec, s.tvec, s.residual_dt_us / 1e6), one))
    if path:
        names = [r.session_id for r in recording.path.select("session_id").distinct().orderBy("session_id").collect()]
        write_mounting(spark, path, found, recording.lag_us, recording.yaw_sign, names, rows[0][2], rows[1][2])
    thin = lambda r: math.inf if r["mean_plane_rms_m"] is None else r["mean_plane_rms_m"]
    improved = thin(rows[1][2]) < thin(rows[0][2])
    return spark.createDataFrame([(s, t, r["mean_plane_rms_m"], r["voxels"], r["points"], improved) for s, t, r in rows], "stage string, transform string, mean_plane_rms_m double, voxels long, points long, improved boolean")


def fusion_report(recording: Sessions) -> DataFrame:
    """One row for each session: walls and cells before and after the pose graph, its size, and how far keyframes moved.

    thinner and fewer are the shares by which walls and cells shrank.
    """
    key = ["session_id"]
    sides = []
    for name, path in (("before", recording.path), ("after", recording.corrected_path)):
        sides.append(map_figures(recording.lidar_points(path), banded=True).select(*key, F.col("thickness_m").alias(f"walls_{name}_m"), F.col("n_cells").alias(f"cells_{name}")))
    graph = recording.edges.groupBy(*key).agg(F.count("*").alias("n_edges"), F.count_if(F.col("weight") != fusion.ODOMETRY_WEIGHT).alias("n_loops"))
    scans = recording.scans.groupBy(*key).agg(F.count("*").alias("n_keyframes"))
    at = fusion.corrected(recording.path, fusion.corrections(recording.scans, recording.edges), recording.yaw_convention).select(*key, "t_us", F.col("px").alias("_x"), F.col("pz").alias("_z"))
    moved = recording.path.join(at, [*key, "t_us"]).select(*key, F.hypot(F.col("px") - F.col("_x"), F.col("pz") - F.col("_z")).alias("moved"))
    shift = quantiles(moved, key, "moved", {"moved_median_m": 0.5, "moved_most_m": 1.0})
    out = reduce(lambda a, b: a.join(b, key), [*sides, scans, graph, shift])
    return out.withColumns({"thinner": 1 - F.col("walls_after_m") / F.col("walls_before_m"), "fewer": 1 - F.col("cells_after") / F.col("cells_before")})


def live_check(streams: dict[str, DataFrame], dropped: dict[str, int] | None = None, needed: tuple[str, ...] = ("poses", "lidar")) -> DataFrame:
    """session_id, stream, n_rows, hz, dropped, why_not of what has come so far: null why_not passes, a session passes with all of them.

    A needed stream without rows fails. Dropped rows are counted by the source (live.dropped_rows) for all sessions.
    """
    held = None
    for name, rows in streams.items():
        own = temporal.rates(rows, ["session_id"], "t_arrival_us").select("session_id", F.lit(name).alias("stream"), "n_rows", "hz")
        held = own if held is None else held.unionByName(own)
    every = held.select("session_id").distinct().crossJoin(F.broadcast(held.sparkSession.createDataFrame([(n,) for n in needed], "stream string")))
    rows = held.join(every, ["session_id", "stream"], "full").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    lost = F.lit(0)
    nominal = F.lit(None).cast("double")
    for name in streams:
        lost = F.when(F.col("stream") == name, (dropped or {}).get(name, 0)).otherwise(lost)
        if name in needed:
            nominal = F.when(F.col("stream") == name, gates.NOMINAL_HZ[name]).otherwise(nominal)
    hz = F.coalesce("hz", F.lit(0.0))
    reason = first_rule((F.col("n_rows") == 0, "nothing came"), (F.col("dropped") > 0, "rows were dropped"), (hz < gates.LIVE_LOW * nominal, "rate below nominal"), (hz > gates.LIVE_HIGH * nominal, "arrivals burst"))
    return rows.withColumn("dropped", lost).select("session_id", "stream", "n_rows", "hz", "dropped", reason.alias("why_not"))


def replay_check(recording: Sessions, manifest_root: str | None = None) -> DataFrame:
    """session_id, check, why_not of stored sessions: digest (twice the same), counts, poses (decoded, whole), lossless, timing of poses and lidar."""
    poses, lidar = recording.stream("poses"), recording.stream("lidar")

    def digest() -> DataFrame:
        union = None
        for k, name in enumerate(("poses", "lidar")):
            rows = recording.stream(name)
            rest = [c for c in rows.columns if c != "session_id"]
            rows = rows.select("session_id", F.lit(k).alias("stream"), "t_arrival_us", "seq", F.to_json(F.struct(*rest)).alias("row"))
            union = rows if union is None else union.unionByName(rows)
        return robust.ordered_digest(union, ["session_id"], ["t_arrival_us", "stream", "seq"], "row")

    first, again = digest(), digest().withColumnRenamed("digest", "other")
    out = [first.join(again, "session_id", "full").select("session_id", F.lit("digest").alias("check"), F.when(~F.col("digest").eqNullSafe(F.col("other")), "not the same twice").alias("why_not"))]
    finite = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in ("px", "py", "pz", "qx", "qy", "qz", "qw")))
    sound = poses.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(~finite).alias("bad"))
    every = lidar.select("session_id").union(poses.select("session_id")).distinct()
    out.append(every.join(sound, "session_id", "left").select("session_id", F.lit("poses").alias("check"), first_rule((F.coalesce("n", F.lit(0)) == 0, "no poses"), (F.col("bad") > 0, "a pose isn't whole")).alias("why_not")))
    out.append(gates.lossless(lidar).select("session_id", F.lit("lossless").alias("check"), F.when(F.col("off_grid") > 0, "samples off the grid").alias("why_not")))
    for name in ("poses", "lidar"):
        out.append(gates.replay_timing(recording.stream(name), gates.NOMINAL_HZ[name]).select("session_id", F.lit(f"timing of {name}").alias("check"), "why_not"))
    if manifest_root:
        wrong = count_mismatches(recording.spark, manifest_root, recording.root).groupBy("session_id").agg(F.concat_ws(", ", F.sort_array(F.collect_list("stream"))).alias("wrong"))
        out.append(every.join(wrong, "session_id", "left").select("session_id", F.lit("counts").alias("check"), F.when(F.col("wrong").isNotNull(), F.concat(F.lit("manifest differs: "), "wrong")).alias("why_not")))
    return reduce(DataFrame.unionByName, out)


