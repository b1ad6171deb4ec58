"""A recorded session from tables to map and measurements: lazily composed DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, mapping, measure, meshes, robust, signal, temporal
from ..sources.sessions import stream_table
from ..sources.tables import checked, stow

#: Host-clock rows carry this where no clock was fitted.
MIN_POINTS = 1000


@dataclass
class Sessions:
    """All sessions below a folder of stream tables; every result has session_id.

    fit_clock takes poses to clock segments (session_id, start_us, intercept, pooled, ...), keep_samples takes range samples
    (session_id, rev, k, angle, range_m, t_sample_us) to those that stay: other fits and filters than the ones here.
    """

    spark: SparkSession
    root: str
    rvec: tuple = (-1.2092, 1.2092, 1.2092)
    tvec: tuple = (0.0, 0.10, 0.0)
    residual_dt_us: float = 0.0
    lag_us: float = 0.0
    yaw_sign: int = 1
    yaw_convention: str = "consistent"
    depth_frames: int | None = None  # of each session, the first so many; all where not said
    tables: dict[str, DataFrame] = field(default_factory=dict)
    fit_clock: Callable[[DataFrame], DataFrame] | None = None
    keep_samples: Callable[[DataFrame], DataFrame] | None = None

    def stream(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else stream_table(self.spark, self.root, name)

    @cached_property
    def clock(self) -> DataFrame:
        """Clock segments, a few rows for each session; computed once and used by every stream."""
        if self.fit_clock:
            return stow(self.fit_clock(self.stream("poses")))
        return stow(temporal.clock_segments(self.stream("poses"), ["session_id"], "t_device_us", "t_arrival_us", "seq"))

    @cached_property
    def path(self) -> DataFrame:
        return stow(fusion.trajectory(self.stream("poses"), self.clock))

    @cached_property
    def samples(self) -> DataFrame:
        """Range samples without whoever carries the sensor; written once, as the map, the scans and the corrected map read them."""
        rows = fusion.revolution_samples(self.stream("lidar"), self.yaw_sign)
        if self.keep_samples:
            return stow(fusion.full_revolutions(self.keep_samples(rows)))
        rows = rows.withColumn("_deg", F.degrees("angle"))
        return stow(fusion.full_revolutions(signal.without_near_sectors(rows, ["session_id"], "_deg", "range_m").drop("_deg")))

    def lidar_points(self, path: DataFrame | None = None) -> DataFrame:
        return fusion.lidar_points(self.samples, path if path is not None else self.path, self.rvec, self.tvec, self.lag_us + self.residual_dt_us)

    @cached_property
    def scans(self) -> DataFrame:
        return stow(fusion.keyframe_scans(self.lidar_points()))

    @cached_property
    def edges(self) -> DataFrame:
        return stow(fusion.odometry_edges(self.scans).unionByName(fusion.loop_edges(self.scans)))

    @cached_property
    def corrected_path(self) -> DataFrame:
        fixes = fusion.corrections(self.scans, self.edges)
        return stow(fusion.corrected(self.path, fixes, self.yaw_convention))

    @cached_property
    def mesh(self) -> DataFrame:
        return meshes.faces(self.stream("mesh"))

    def clouds(self) -> DataFrame:
        """session_id, source, x, y, z of both range sensors on the corrected path."""
        lidar = self.lidar_points(self.corrected_path).select("session_id", F.lit("lidar").alias("source"), "x", "y", "z")
        depth = fusion.depth_points(fusion.first_frames(self.stream("depth"), self.depth_frames), self.corrected_path, self.clock).select("session_id", F.lit("depth").alias("source"), "x", "y", "z")
        return lidar.unionByName(depth)

    def labelled(self) -> DataFrame:
        numbered = stow(self.clouds().withColumn("point", F.monotonically_increasing_id()))
        return meshes.label_points(numbered, "point", self.mesh)

    def measurements(self, session: str) -> DataFrame:
        """source, name, value_m, seq of one session, for sources with enough points."""
        points = self.labelled().where(F.col("session_id") == session)
        enough = points.groupBy("source").count().where(F.col("count") >= MIN_POINTS).select("source")
        return measure.measure_room(points.join(checked(stow(enough)), "source", "left_semi"))

    def occupancy(self, session: str) -> DataFrame:
        """ix, iy, iz, logodds, state of one session's voxels from its corrected range samples."""
        points = self.lidar_points(self.corrected_path).where(F.col("session_id") == session)
        placed = temporal.global_positions(points, ["t_us", "rev", "x", "y", "z"])
        rays = placed.select((F.col("position") - 1).alias("seq"), *(F.col(f"p{a}").alias(f"o{a}") for a in "xyz"), *(F.col(a).alias(f"h{a}") for a in "xyz"))
        return mapping.classified(mapping.fold(mapping.evidence(stow(rays))))

    def lidar_lag(self, spin_up_us: int = 4_000_000) -> DataFrame:
        """session_id, lag_us, correlation, sign: how late range stamps are, from yaw rates of both sensors."""
        raw = self.stream("lidar")
        first = raw.groupBy("session_id").agg(F.min("t_arrival_us").alias("_first"))
        late = raw.join(checked(stow(first)), "session_id").where(F.col("t_arrival_us") >= F.col("_first") + spin_up_us)
        flat = late.select("session_id", "t_arrival_us", F.explode("samples").alias("s")).select("session_id", "t_arrival_us", (F.col("s.angle_q6") / 64.0).alias("deg"), (F.col("s.dist_q2") / 4.0).alias("mm"))
        steps = signal.yaw_steps(signal.range_profile(flat, ["session_id", "t_arrival_us"], "deg", "mm"), ["session_id"], "t_arrival_us")
        timed = temporal.with_gap(steps, ["session_id"], "t_arrival_us").where("gap > 0")
        b = timed.select("session_id", F.lit("b").alias("source"), (F.col("t_arrival_us") - F.col("gap") / 2).cast("long").alias("t"), (F.col("step_deg") * 1e6 / F.col("gap")).alias("rate"))
        a = fusion.yaw_rates(self.path).select("session_id", F.lit("a").alias("source"), F.col("t_us").alias("t"), "rate")
        return signal.lags(a.unionByName(b))


def validation(measured: DataFrame, truth: DataFrame, limit_m: float = 0.03) -> DataFrame:
    """n_joined, worst_m, passed: no joined row is a failure, not a pass."""
    rows = robust.compare(measured, truth)
    return rows.agg(F.count("*").alias("n_joined"), F.max(F.abs("error")).alias("worst_m")).withColumn("passed", (F.col("n_joined") > 0) & F.coalesce(F.col("worst_m") <= limit_m, F.lit(False)))
