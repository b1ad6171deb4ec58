"""Labelled surface meshes: newest chunks, world-frame faces and labels for points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cross, norm
from ..functions.scalars import UNLABELLED
from .spatial import nearest
from .temporal import latest_per_key

LABEL_RADIUS = 0.20


def faces(chunks: DataFrame) -> DataFrame:
    """session_id, anchor_id, face, cx, cy, cz, area, label of the newest chunk of each anchor; faces beyond the labels go.

    Vertices and faces are flat arrays; the 4 x 4 transform is column-major. The newest chunk is taken before anything is
    exploded.
    """
    newest = latest_per_key(chunks, ["session_id", "anchor_id"], "seq")
    n = F.least(F.floor(F.size("faces") / 3), F.size("classification"))
    rows = newest.where(n > 0).withColumn("face", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    rows = rows.select("session_id", "anchor_id", "face", "transform", "vertices", F.get("classification", F.col("face").cast("int")).alias("label"), *((F.get("faces", (F.col("face") * 3 + k).cast("int")) * 3).cast("int").alias(f"v{k}") for k in range(3)))
    m, at = F.col("transform"), lambda k, a: F.get("vertices", F.col(f"v{k}") + a).cast("double")
    corners = [tuple(sum((F.get(m, F.lit(4 * c + r)) * at(k, c) for c in range(3)), F.get(m, F.lit(12 + r))).alias(f"w{k}{r}") for r in range(3)) for k in range(3)]
    world = rows.select("session_id", "anchor_id", "face", "label", *(c for k in corners for c in k))
    p = [tuple(F.col(f"w{k}{r}") for r in range(3)) for k in range(3)]
    edge = [tuple(b - a for a, b in zip(p[0], p[k], strict=True)) for k in (1, 2)]
    centre = [((p[0][r] + p[1][r] + p[2][r]) / 3).alias(f"c{a}") for r, a in enumerate("xyz")]
    return world.select("session_id", "anchor_id", "face", *centre, (norm(cross(*edge)) / 2).alias("area"), "label")


def label_points(points: DataFrame, key: str, mesh: DataFrame, radius: float = LABEL_RADIUS) -> DataFrame:
    """Adds label: that of the nearest face centre nearer than radius, else the code for none."""
    tagged = mesh.withColumn("order", F.struct("anchor_id", "face"))
    return nearest(points, key, ["x", "y", "z"], tagged, ["cx", "cy", "cz"], "order", ["label"], radius).withColumn("label", F.coalesce("label", F.lit(UNLABELLED)))


def area_by_class(mesh: DataFrame) -> DataFrame:
    return mesh.groupBy("label").agg(F.sum("area").alias("area"))
