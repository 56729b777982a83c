"""Tight axis-aligned bounds of Gaussians: a narrow projection, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gaussian as g
from ..functions.vec3 import finite, vec
from ..lineage import bind
from ..schema import BOX, CONTACT, COVI, MEAN, QUAT, SCALE, iso_of, require


def gaussian_bounds(gaussians: DataFrame, level: int, iso: float | str | Column = 11.345, tol: float = 1 / 8, rotnorm: bool = False, keep_invalid: bool = False) -> DataFrame:
    """*gaussians* with its box, contact points (offsets from the mean) and inverse covariance.

    Scales are floored at *tol* of a voxel, ``2 / 2**level`` (a world of -1 to 1). *iso* is a number, a column or its name.
    With *rotnorm* quaternions are normalised first; without it the volume is taken from the scales alone, so that the box of a
    quaternion that isn't a unit isn't tight. Rows with a result that isn't finite (a zero quaternion, iso under 0, nulls) are left out
    unless *keep_invalid*; then those results are null or NaN. Columns of those names are replaced.
    """
    require(gaussians, *MEAN, *QUAT, *SCALE)
    floor = tol * 2.0 / 2.0**level
    rest = [c for c in gaussians.columns if c not in {*sum(BOX, ()), *sum(CONTACT, ()), *COVI}]
    q = tuple(F.col(c).cast("double") for c in QUAT)
    floored = {f"_{c}": F.greatest(F.col(c).cast("double"), F.lit(floor)) for c in SCALE}
    # Each value is computed once, in steps that are compiled to small methods: the JVM interprets those over 8,000 bytes.
    rows = bind(gaussians.select(*rest), {"_iso": F.when(iso_of(iso) >= 0, iso_of(iso))} | ({"_gb_norm": g.quaternion_norm(*q)} if rotnorm else {}) | floored)
    rows = bind(rows, {f"_{n}": F.try_divide(c, F.col("_gb_norm")) if rotnorm else c for n, c in zip("wxyz", q, strict=True)})
    s, axes = vec("_sx", "_sy", "_sz"), [[f"_gb_m{i}{a}" for a in "xyz"] for i in range(3)]
    scaled = g.scaled_axes(g.rotation(*(F.col(f"_{n}") for n in "wxyz")), s)
    rows = bind(rows, {"_gb_det": s.x * s.y * s.z} | {n: c for names, row in zip(axes, scaled, strict=True) for n, c in zip(names, row, strict=True)})
    rows = bind(rows, dict(zip(COVI, g.gram(tuple(vec(*names) for names in axes)), strict=True)))
    rows = bind(rows, {f"_gb_h{i}": c for i, c in enumerate(g.cofactors(tuple(F.col(n) for n in COVI)))})
    h = tuple(F.col(f"_gb_h{i}") for i in range(6))
    rows = bind(rows, {f"_gb_t{i}": c for i, c in enumerate(g.contact_weights(h, F.col("_gb_det"), F.col("_iso")))})
    contacts = g.contacts_of(tuple(F.col(f"_gb_t{i}") for i in range(3)), h)
    rows = bind(rows, {n: c for names, p in zip(CONTACT, contacts, strict=True) for n, c in zip(names, p, strict=True)})
    rows = bind(rows, {f"_gb_r{a}": F.greatest(*(F.abs(F.col(CONTACT[i][axis])) for i in range(3))) for axis, a in enumerate("xyz")})
    reach, mean = vec("_gb_rx", "_gb_ry", "_gb_rz"), vec(*MEAN)
    rows = bind(rows, {n: m - r for n, m, r in zip(BOX[0], mean, reach, strict=True)} | {n: m + r for n, m, r in zip(BOX[1], mean, reach, strict=True)})
    results = [*BOX[0], *BOX[1], *sum(CONTACT, ()), *COVI]
    if not keep_invalid:
        rows = rows.where(finite(*(F.col(n) for n in results)))
    return rows.select(*rest, *results)
