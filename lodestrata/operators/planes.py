"""Thickness of a wall: the vertical plane that most points lie on, found among random triples in one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .robust import mad

TRIES, NEAR, LEAN, SEED, LEAST = 200, 0.03, 0.35, 0, 200


def plane_counts(points: DataFrame, planes: list[tuple[float, float, float, float]], near: float) -> DataFrame:
    """plane, inliers: points nearer than near to each plane (nx, ny, nz, offset); all planes in one pass over the points."""
    spark = points.sparkSession
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(planes)], "plane int, a double, b double, c double, d double")
    off = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") - F.col("d"))
    return points.select("x", "y", "z").crossJoin(F.broadcast(table)).groupBy("plane").agg(F.count_if(off < near).alias("inliers"))


def _fit(points: DataFrame, plane: tuple[float, float, float, float], near: float) -> tuple[float, float, float, float]:
    """Least-squares plane of the inliers from their means and covariances, which are sums over all of them."""
    a, b, c, d = plane
    held = points.where(F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") - d) < near)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    r = held.agg(*(F.avg(v).alias(v) for v in "xyz"), *(F.covar_pop(p, q).alias(p + q) for p, q in pairs)).first()
    cov = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
    normal = np.linalg.eigh(cov)[1][:, 0]
    return *(float(v) for v in normal), float(normal @ np.array([r.x, r.y, r.z]))


def wall_thickness(points: DataFrame, tries: int = TRIES, near: float = NEAR, lean: float = LEAN, seed: int = SEED) -> tuple[float | None, int]:
    """(sigma, inliers) of points(seq, x, y, z): robust spread about the best upright plane; (None, 0) for too few points.

    Triples are drawn before anything is counted. Only their points, three each, come to the driver.
    """
    total = points.count()
    if total < LEAST:
        return None, 0
    rng = np.random.default_rng(seed)
    draws = np.array([rng.choice(total, 3, replace=False) for _ in range(tries)])
    spark = points.sparkSession
    wanted = spark.createDataFrame([(int(k),) for k in np.unique(draws)], "seq long")
    at = {r.seq: np.array([r.x, r.y, r.z]) for r in points.join(F.broadcast(wanted), "seq").select("seq", "x", "y", "z").collect()}
    planes = []
    for i, j, k in draws:
        normal = np.cross(at[int(j)] - at[int(i)], at[int(k)] - at[int(i)])
        size = np.linalg.norm(normal)
        if size >= 1e-9 and abs(normal[1] / size) <= lean:
            planes.append((*(normal / size), float(normal @ at[int(i)] / size)))
    if not planes:
        return None, 0
    counts = {r.plane: r.inliers for r in plane_counts(points, planes, near).collect()}
    best, most = None, 0
    for i, plane in enumerate(planes):
        if counts.get(i, 0) > most:
            fitted = _fit(points, plane, near)
            if abs(fitted[1]) <= lean:
                best, most = fitted, counts[i]
    if best is None:
        return None, 0
    a, b, c, d = best
    off = a * F.col("x") + b * F.col("y") + c * F.col("z") - d
    held = points.where(F.abs(off) < near).select(off.alias("off"))
    sigma = mad(held, [], "off").first().sigma
    return float(sigma), int(most)
