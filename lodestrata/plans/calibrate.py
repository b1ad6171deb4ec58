"""Mounting of the range sensor: the transform and time offset under which all sessions' maps are sharpest.

The cost of one candidate is a count of occupied cells seen from above. The driver holds only the corners of the search, seven
numbers each. Every round sends the few candidates of all starts to the strided samples, whose poses are joined already, in one
pass: cells are made distinct before they are counted, and only one number for each candidate comes back.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rodrigues, rotate
from ..functions.scalars import on_stride
from ..sources.tables import BROADCAST_ROWS, stow

VOXEL, LOW, HIGH, LEAST, FAR_T, FAR_DT, REJECT = 0.02, -1.2, 0.6, 1000, 0.40, 0.10, 1e12
MOUNTING = (-1.2092, 1.2092, 1.2092, 0.0, 0.10, 0.0, 0.0)


def enough_samples(samples: DataFrame, n_sessions: int) -> bool:
    """Whether each session has LEAST samples, in whatever height they lie."""
    full = samples.groupBy("session_id").count().where(F.col("count") >= LEAST).count()
    return full == n_sessions


def costs(samples: DataFrame, vectors: np.ndarray, n_sessions: int, enough: bool | None = None) -> list[float]:
    """Cost of each vector (rotation vector, translation, seconds): cells within the height band, none for an empty band.

    Vectors out of bounds are rejected, and all of them if a session has few samples (which enough says, if it is known).
    """
    if not (enough_samples(samples, n_sessions) if enough is None else enough):
        return [REJECT] * len(vectors)
    allowed = [k for k, v in enumerate(vectors) if np.linalg.norm(v[3:6]) <= FAR_T and abs(v[6]) <= FAR_DT]
    rows = [(k, *(float(x) for row in rodrigues(tuple(vectors[k][:3])) for x in row[:2]), *map(float, vectors[k][3:])) for k in allowed]
    found = [REJECT] * len(vectors)
    if not rows:
        return found
    turn = [f"m{i}{j}" for i in range(3) for j in range(2)]
    table = samples.sparkSession.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in [*turn, "t0", "t1", "t2", "dt"]))
    each = samples.crossJoin(F.broadcast(table))  # a handful of candidates
    body = tuple(F.col(f"m{i}0") * F.col("a") + F.col(f"m{i}1") * F.col("b") + F.col(f"t{i}") for i in range(3))
    world = rotate(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")), body)
    placed = each.select("k", "session_id", *((w + F.col(f"p{a}") - F.col(f"v{a}") * F.col("dt")).alias(a) for w, a in zip(world, "xyz", strict=True)))
    middle = placed.groupBy("k", "session_id").agg(F.median("y").alias("middle"))
    h = F.col("y") - F.col("middle")
    small = len(allowed) * n_sessions <= BROADCAST_ROWS  # a number for each candidate and session
    held = placed.join(F.broadcast(middle) if small else middle, ["k", "session_id"]).where((h > LOW) & (h < HIGH))
    cells = held.select("k", "session_id", *(F.floor(F.col(a) / VOXEL).alias(a) for a in "xz")).distinct()
    counts = {r.k: r["count"] for r in cells.groupBy("k").count().collect()}
    for k in allowed:
        found[k] = float(counts.get(k, 0))
    return found


def simplex(start: np.ndarray, rounds: int = 3000, xtol: float = 1e-4, ftol: float = 1.0) -> Generator[np.ndarray, list[float], tuple[np.ndarray, float, float]]:
    """Downhill simplex with steps that suit the dimension: yields the points it wants costs of; returns the best, its cost, the first cost.

    A round asks for all points it may need at once, as a pass over the samples costs more than a few further candidates.
    """
    n = len(start)
    grow, shrink_in, shrink = 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n
    points = np.vstack([start, *(start + np.eye(n)[k] * (0.05 * start[k] if start[k] else 0.01) for k in range(n))])
    values = np.array((yield points))
    first = float(values[0])
    for _ in range(rounds):
        order = values.argsort(kind="stable")
        points, values = points[order], values[order]
        if np.abs(points[1:] - points[0]).max() <= xtol and values[-1] - values[0] <= ftol:
            break
        middle, worst = points[:-1].mean(0), points[-1].copy()
        ways = np.array([middle + f * (middle - worst) for f in (1.0, grow, shrink_in, -shrink_in)])
        mirrored, far, outside, inside = yield ways
        if mirrored < values[0]:
            points[-1], values[-1] = (ways[1], far) if far < mirrored else (ways[0], mirrored)
        elif mirrored < values[-2]:
            points[-1], values[-1] = ways[0], mirrored
        else:
            way, value = (ways[2], outside) if mirrored < values[-1] else (ways[3], inside)
            if value < min(mirrored, values[-1]):
                points[-1], values[-1] = way, value
            else:
                points[1:] = points[0] + shrink * (points[1:] - points[0])
                values[1:] = yield points[1:]
    best = int(values.argmin())
    return points[best], float(values[best]), first


def posed_samples(points: DataFrame, stride: int = 3) -> DataFrame:
    """Every stride-th revolution of points(session_id, rev, t_us, a, b, px..pz, qx..qw), with the sensor's velocity."""
    revs = points.select("session_id", "rev").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy("rev")) - 1).where(on_stride(F.col("_k"), stride)).drop("_k")
    w = Window.partitionBy("session_id").orderBy("t_us")
    dt = F.nullif(F.col("t_us") - F.lag("t_us").over(w), F.lit(0)) / 1e6
    moving = points.join(revs, ["session_id", "rev"], "left_semi")
    return moving.select("*", *(F.coalesce((F.col(f"p{a}") - F.lag(f"p{a}").over(w)) / dt, F.lit(0.0)).alias(f"v{a}") for a in "xyz"))


def calibrations(samples: DataFrame, starts: list[tuple[float, ...]] = [MOUNTING], rounds: int = 3000) -> DataFrame:  # noqa: B006
    """start, cost_before, cost_after, and the seven parameters found from each start; starts share their passes."""
    names = ["rx", "ry", "rz", "tx", "ty", "tz", "dt_s"]
    schema = "start int, cost_before double, cost_after double, " + ", ".join(f"{n} double" for n in names)
    held = stow(samples.select("session_id", "a", "b", *(f"p{a}" for a in "xyz"), "qx", "qy", "qz", "qw", *(f"v{a}" for a in "xyz")))
    n_sessions = held.select("session_id").distinct().count()
    enough = enough_samples(held, n_sessions)
    searches = {k: simplex(np.array(s, float), rounds) for k, s in enumerate(starts)}
    wanted, done = {k: next(s) for k, s in searches.items()}, []
    while wanted:
        asked = list(wanted)
        found = iter(costs(held, np.vstack([wanted[k] for k in asked]), n_sessions, enough))
        for k in asked:
            answers = [next(found) for _ in range(len(wanted[k]))]
            try:
                wanted[k] = searches[k].send(answers)
            except StopIteration as end:
                best, after, before = end.value
                done.append((k, before, after, *map(float, best)))
                del wanted[k]
    return samples.sparkSession.createDataFrame(sorted(done), schema)
