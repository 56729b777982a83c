"""Rows to draw: points on the surfaces of Gaussians, the outlines of boxes, and segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gaussian as g
from ..functions.vec3 import vec
from ..lineage import bind
from ..schema import EDGE, MEAN, QUAT, SCALE, VOXEL, iso_of, require

# The corners that a box's outline visits, by axis 0 low or 1 high; None lifts the pen. First the lower and the upper face, then the four edges between them.
_PATH = (
    (0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 0), None,
    (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1), (0, 0, 1), None,
    (0, 0, 0), (0, 0, 1), None,
    (1, 0, 0), (1, 0, 1), None,
    (1, 1, 0), (1, 1, 1), None,
    (0, 1, 0), (0, 1, 1), None,
)


def surface_points(gaussians: DataFrame, level: int, iso: float | str | Column = 11.345, tol: float = 1 / 8, rotnorm: bool = False, around: int = 50, down: int = 50) -> DataFrame:
    """gid, i, j, x, y, z: points of each Gaussian's iso surface, *around* angles from 0 to a full turn (i) by *down* from pole to pole (j), ends included.

    Scales have the floor that ``gaussian_bounds`` gives them. A Gaussian that isn't finite has null or NaN points.
    """
    require(gaussians, "gid", *MEAN, *QUAT, *SCALE)
    if around < 2 or down < 2:
        raise ValueError("around and down must be 2 or more")
    floor = tol * 2.0 / 2.0**level
    q = tuple(F.col(c).cast("double") for c in QUAT)
    if rotnorm:
        q = g.unit_quaternion(*q)
    scales = {f"_{c}": F.greatest(F.col(c).cast("double"), F.lit(floor)) for c in SCALE}
    rows = bind(gaussians.select("gid", *MEAN, *QUAT, *SCALE, iso_of(iso).alias("_iso")), dict(zip(("_w", "_x", "_y", "_z"), q, strict=True)) | scales)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(around - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    rows = bind(rows, {"_u": F.col("i") * F.lit(2 * math.pi / (around - 1)), "_v": F.col("j") * F.lit(math.pi / (down - 1))})
    at = g.surface_point(vec(*MEAN), g.rotation(*(F.col(f"_{n}") for n in "wxyz")), vec("_sx", "_sy", "_sz"), F.col("_iso"), F.col("_u"), F.col("_v"))
    return rows.select("gid", "i", "j", *(c.alias(n) for n, c in zip("xyz", at, strict=True)))


def _steps(key: str, corners: list[tuple[Column, Column, Column] | None], rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    points = [F.struct(*(c.cast("double").alias(n) for n, c in zip("xyz", p or (none, none, none), strict=True))) for p in corners]
    return rows.select(key, F.posexplode(F.array(*points)).alias("step", "p")).select(key, "step", "p.*")


def box_wireframe(boxes: DataFrame) -> DataFrame:
    """vid, step (0 to 23), x, y, z: the outline of each box as a path; null coordinates lift the pen."""
    require(boxes, "vid", *sum(VOXEL, ()))
    return _steps("vid", [p and tuple(F.col(VOXEL[side][k]) for k, side in enumerate(p)) for p in _PATH], boxes)


def polylines(edges: DataFrame) -> DataFrame:
    """eid, step (0 to 2), x, y, z: start and end of each segment, and nulls, which lift the pen."""
    require(edges, "eid", *sum(EDGE, ()))
    return _steps("eid", [*(tuple(F.col(c) for c in end) for end in EDGE), None], edges)
