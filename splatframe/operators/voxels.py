"""Gaussian-voxel pairs, for solid and for planar Gaussians."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.gaussian import density_of, power
from ..functions.vec3 import finite, present, sub, vec
from ..lineage import bind, never_null, spread
from ..schema import BOX, CONTACT, COVI, MEAN, NORMAL, VOXEL, box, covi, iso_of, require
from .broadphase import overlap_join


def _limited(pairs: DataFrame, max_pairs: int | None) -> DataFrame:
    return pairs if max_pairs is None else pairs.orderBy("vid", "gid").limit(max_pairs)


def _candidates(voxels: DataFrame, gaussians: DataFrame, used: list[str]) -> DataFrame:
    require(voxels, "vid", *sum(VOXEL, ()))
    require(gaussians, "gid", *used)
    numbers, corners = [c for c in used if c != "gid"], sum(VOXEL, ())
    gaussians = gaussians.where(present(*numbers) & finite(*(F.col(c).cast("double") for c in numbers))).select("gid", *never_null(numbers))
    voxels = voxels.where(present(*corners)).select("vid", *never_null(corners))
    # What the join doesn't look at is one column in it: the JVM's optimising compiler refuses methods with many arguments, and rows are listed in methods that take each column as one.
    more = [c for c in numbers if c not in sum(BOX, ())]
    packed = spread(gaussians.select("gid", *sum(BOX, ()), F.struct(*more).alias("_more")), "gid")
    pairs = overlap_join(packed, BOX, voxels, VOXEL)
    return pairs.select("gid", *sum(BOX, ()), *(F.col("_more")[c].alias(c) for c in more), "vid", *corners)


def voxel_pairs(
    voxels: DataFrame, gaussians: DataFrame, iso: float | str | Column = 11.345, ar_threshold: float = 0.1, p_threshold: float = 0.1, centroids: bool = False, max_pairs: int | None = None, overlaps: bool = False
) -> DataFrame:
    """vid and gid of voxels and bounded Gaussians (``gaussian_bounds``) that meet; with *centroids*, cx, cy, cz and density.

    A pair meets if the voxel holds the Gaussian's box, or a diameter to a contact point pierces one of its faces, or one of
    its edges meets the ellipsoid; voxels are taken for cubes of their x side. Of these pairs those stay whose
    overlap box has an aspect ratio of *ar_threshold* and a least side of *p_threshold* of the voxel. The
    centroid is that box's middle, where the density is taken. *max_pairs* keeps the first in the order of vid and gid. With *overlaps* the box's corners
    ox0 to oz1 follow.
    """
    extra = [iso] if isinstance(iso, str) else []
    need = sorted({*MEAN, *sum(BOX, ()), *sum(CONTACT, ()), *COVI, *extra, *(["opacity"] if centroids else [])})
    if isinstance(iso, Column):
        gaussians, iso = gaussians.withColumn("_iso", iso), "_iso"
        need.append("_iso")
    rows = _candidates(voxels, gaussians, need)
    voxel, own, mean, level = box(VOXEL), box(BOX), vec(*MEAN), iso_of(iso)
    size = F.col("vx1").cast("double") - F.col("vx0").cast("double")
    # The overlap box is bound, so that the filter on it doesn't repeat it at each mention.
    rows = bind(rows, {f"_o{a}": side for a, side in zip("xyz", p.sides(p.overlap_box(own, voxel)), strict=True)})
    sides = vec("_ox", "_oy", "_oz")
    rows = bind(rows, {"_least": F.least(*sides), "_most": F.greatest(*sides)})
    ratio, depth = p.side_ratios(F.col("_least"), F.col("_most"), size)
    rows = rows.where((ratio >= ar_threshold) & (depth >= p_threshold))
    # Each bound step is a compiled method of its own. The JVM's optimising compiler wants it small (8,000 bytes) and with few arguments (some 55 columns),
    # so a step ends the use of as many columns as it can.
    middle = dict(zip(("cx", "cy", "cz"), p.middle(p.overlap_box(own, voxel)), strict=True)) if centroids else {}
    corners = [c.alias(f"o{a}{k}") for k, side in enumerate(p.overlap_box(own, voxel)) for a, c in zip("xyz", side, strict=True)]
    kept = {"_overlap": F.struct(*corners)} if overlaps else {}  # one column to carry, as in ``_candidates``
    rows = bind(rows, {"_inside": p.box_inside(own, voxel), "_size": size} | dict(zip(("_ax", "_ay", "_az"), sub(voxel[0], mean), strict=True)) | middle | kept)
    at, size, contacts = vec("_ax", "_ay", "_az"), F.col("_size"), tuple(vec(*c) for c in CONTACT)
    rows = bind(rows, p.face_parameters(at, size, contacts) | ({"_power": power(sub(vec("cx", "cy", "cz"), mean), covi())} if centroids else {}))
    rows = bind(rows, {"_in": F.col("_inside") | p.face_pierced(at, size, contacts)})
    rows = bind(rows, p.cube_terms(at, size, covi(), level))
    rows = bind(rows, p.cube_slopes(at, size))
    hits = p.cube_edge_hits(size)
    rows = bind(rows, {"_some": F.col("_in") | p.any_of(hits[:6])})
    rows = bind(rows, {"_meets": F.col("_some") | p.any_of(hits[6:])}).where("_meets")
    out = ["vid", "gid"]
    if centroids:
        out += ["cx", "cy", "cz", density_of(F.col("_power"), F.col("opacity").cast("double")).alias("density")]
    if overlaps:
        out.append("_overlap.*")
    return _limited(rows.select(*out), max_pairs)


def planar_voxel_pairs(voxels: DataFrame, gaussians: DataFrame, iso: float | str | Column = 11.345, centroids: bool = False, densities: bool = False, max_pairs: int | None = None) -> DataFrame:
    """vid and gid of voxels that planar Gaussians cut: one of the twelve edges meets the disc.

    With *centroids*, cx, cy, cz: the mean of the points where edges meet it (a shared corner counts once for each edge). With *densities* as well, the density there, for
    opacity 1.
    """
    need = sorted({*MEAN, *NORMAL, *sum(BOX, ()), *COVI, *([iso] if isinstance(iso, str) else [])})
    if isinstance(iso, Column):
        gaussians, iso = gaussians.withColumn("_iso", iso), "_iso"
        need.append("_iso")
    rows = _candidates(voxels, gaussians, need)
    voxel, mean, normal, level = box(VOXEL), vec(*MEAN), vec(*NORMAL), iso_of(iso)
    size = F.col("vx1").cast("double") - F.col("vx0").cast("double")
    rows = rows.where(p.corners_on_both_sides(voxel, mean, normal)).withColumn("_size", size)
    size = F.col("_size")
    rows = rows.withColumns(p.cube_offsets(voxel[0], size, mean))
    rows = rows.withColumns(p.cube_plane_terms(size, normal))
    rows = rows.withColumns(p.cube_plane_parameters())
    rows = bind(rows, p.cube_disc_parameters(voxel[0], size, mean, covi(), level))
    rows = rows.where(p.any_of(met for met, _ in p.cube_points(voxel[0], size, 0)))
    out = ["vid", "gid"]
    if not centroids:
        return _limited(rows.select(*out), max_pairs)
    rows = rows.withColumn("_n", reduce(lambda a, b: a + b, (met.cast("int") for met, _ in p.cube_points(voxel[0], size, 0))))
    sums = [reduce(lambda a, b: a + b, (F.when(met, at).otherwise(0.0) for met, at in p.cube_points(voxel[0], size, k)), F.lit(0.0)) for k in range(3)]
    rows = rows.withColumns({f"c{a}": total / F.col("_n") for a, total in zip("xyz", sums, strict=True)})
    out += ["cx", "cy", "cz"]
    if densities:
        rows = rows.withColumn("_power", power(sub(vec("cx", "cy", "cz"), mean), covi()))
        out.append(density_of(F.col("_power"), F.lit(1.0)).alias("density"))
    return _limited(rows.select(*out), max_pairs)
