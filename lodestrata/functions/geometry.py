"""Rotations, rigid motions and projections as column expressions.

Vectors and quaternions (x, y, z, w) are tuples of columns, so everything stays inside generated code.
Frames: right-handed, y up, -z forward.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def lerp(a: Column, b: Column, u: Column) -> Column:
    return a + (b - a) * u


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def unit_quaternion(q: Vec) -> Vec:
    n = norm(q)
    return tuple(c / n for c in q)


def quaternion_product(a: Vec, b: Vec) -> Vec:
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def conjugate(q: Vec) -> Vec:
    return -q[0], -q[1], -q[2], q[3]


def slerp(a: Vec, b: Vec, u: Column) -> Vec:
    """Shorter way round; nearly equal rotations are blended linearly; the result is of unit length. For plain columns: each use of a step holds all of it."""
    d = dot(a, b)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
    near = angle < 1e-6
    wa = F.when(near, 1 - u).otherwise(F.sin((1 - u) * angle) / F.sin(angle))
    wb = F.when(near, u).otherwise(F.sin(u * angle) / F.sin(angle)) * sign
    return unit_quaternion(tuple(x * wa + y * wb for x, y in zip(a, b, strict=True)))


def with_slerp(rows: DataFrame, a: Vec, b: Vec, u: Column, names: tuple[str, ...]) -> DataFrame:
    """Adds the rotation between a and b at u, under four names: the shorter way round, of unit length.

    Nearly equal rotations are blended linearly. Each step is a column of its own: steps are used several times, and in one
    expression each use would hold all that it is made of.
    """
    steps = rows.withColumns({f"_a{k}": c for k, c in enumerate(a)} | {f"_b{k}": c for k, c in enumerate(b)} | {"_u": u})
    a, b = (tuple(F.col(f"_{side}{k}") for k in range(4)) for side in "ab")
    steps = steps.withColumn("_dot", dot(a, b)).withColumn("_angle", F.acos(F.least(F.abs("_dot"), F.lit(1.0))))
    steps = steps.withColumn("_near", F.col("_angle") < 1e-6).withColumn("_sine", F.sin("_angle"))
    part = lambda share: F.when(F.col("_near"), share).otherwise(F.sin(share * F.col("_angle")) / F.col("_sine"))
    steps = steps.withColumns({"_wa": part(1 - F.col("_u")), "_wb": part(F.col("_u")) * F.when(F.col("_dot") < 0, -1.0).otherwise(1.0)})
    steps = steps.withColumns({f"_q{k}": a[k] * F.col("_wa") + b[k] * F.col("_wb") for k in range(4)})
    q = tuple(F.col(f"_q{k}") for k in range(4))
    steps = steps.withColumn("_norm", norm(q))
    return steps.select(*rows.columns, *((c / F.col("_norm")).alias(n) for c, n in zip(q, names, strict=True)))


def rotate(q: Vec, v: Vec) -> Vec:
    """v turned by the unit quaternion q."""
    axis = q[:3]
    t = tuple(2 * c for c in cross(axis, v))
    s = cross(axis, t)
    return tuple(v[i] + q[3] * t[i] + s[i] for i in range(3))


def rotation_matrix(q: Vec) -> tuple[Vec, Vec, Vec]:
    """Rows of the matrix of q, which is normalised first."""
    x, y, z, w = unit_quaternion(q)
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def heading(q: Vec) -> Column:
    """Angle about the vertical of the viewing direction."""
    m = rotation_matrix(q)
    return F.atan2(-m[0][2], -m[2][2])


def rodrigues(r: tuple[float, float, float]) -> list[list[float]]:
    """3 x 3 matrix of a rotation vector; plain numbers, for constants of a plan."""
    angle = math.sqrt(sum(c * c for c in r))
    if angle < 1e-12:
        return [[float(i == j) for j in range(3)] for i in range(3)]
    x, y, z = (c / angle for c in r)
    c, s = math.cos(angle), math.sin(angle)
    k = [[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]]
    axis = (x, y, z)
    return [[(c if i == j else 0.0) + s * k[i][j] + (1 - c) * axis[i] * axis[j] for j in range(3)] for i in range(3)]


def rigid_matrix(rvec: tuple[float, ...], tvec: tuple[float, ...]) -> list[list[float]]:
    """4 x 4 matrix of a rotation vector and a translation."""
    return [[*row, float(t)] for row, t in zip(rodrigues(rvec), tvec, strict=True)] + [[0.0, 0.0, 0.0, 1.0]]


def rigid_text(rvec: tuple[float, ...], tvec: tuple[float, ...], dt_s: float = 0.0) -> str:
    """A transform in degrees, centimetres and milliseconds."""
    part = lambda values, width, places: " ".join(f"{v:+{width}.{places}f}" for v in values)
    return f"rot [{part((math.degrees(r) for r in rvec), 7, 2)}] deg   trans [{part((100 * t for t in tvec), 6, 1)}] cm   dt {1000 * dt_s:+6.1f} ms"


def turned(x: Column, z: Column, angle: Column) -> tuple[Column, Column]:
    """Plane rotation of (x, z) by [[c, -s], [s, c]]."""
    c, s = F.cos(angle), F.sin(angle)
    return c * x - s * z, s * x + c * z


Pose2 = tuple[Column, Column, Column]


def compose(a: Pose2, b: Pose2) -> Pose2:
    """Plane motions (x, z, yaw): b within the frame of a."""
    x, z = turned(b[0], b[1], a[2])
    return a[0] + x, a[1] + z, a[2] + b[2]


def inverse(a: Pose2) -> Pose2:
    x, z = turned(a[0], a[1], -a[2])
    return -x, -z, -a[2]


def polar(angle: Column, distance: Column) -> tuple[Column, Column]:
    return distance * F.cos(angle), distance * F.sin(angle)


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Vec:
    """Camera-frame point of a full-resolution pixel; the image's v runs down, the camera looks along -z."""
    return (u - cx) / fx * depth, -(v - cy) / fy * depth, -depth
