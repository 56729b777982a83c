"""Anisotropic Gaussians as Column expressions: rotation, inverse covariance, distance, density, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec3 import Vec3, sub

#: The six values of a symmetric 3 x 3 matrix: xx, xy, xz, yy, yz, zz.
Sym3 = tuple[Column, Column, Column, Column, Column, Column]


def unit_quaternion(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """Null components for the zero quaternion."""
    n = quaternion_norm(w, x, y, z)
    return tuple(F.try_divide(v, n) for v in (w, x, y, z))


def quaternion_norm(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(w * w + x * x + y * y + z * z)


def rotation(w: Column, x: Column, y: Column, z: Column) -> tuple[Vec3, Vec3, Vec3]:
    """The rows of a quaternion's rotation matrix."""
    one, two = F.lit(1.0), F.lit(2.0)
    return (
        Vec3(one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y)),
        Vec3(two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x)),
        Vec3(two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y)),
    )


def inverse_covariance(rows: tuple[Vec3, Vec3, Vec3], s: Vec3) -> Sym3:
    """``R diag(1 / s^2) R^T`` of rotation rows and axis scales."""
    return gram(scaled_axes(rows, s))


def scaled_axes(rows: tuple[Vec3, Vec3, Vec3], s: Vec3) -> tuple[Vec3, Vec3, Vec3]:
    """``R diag(1 / s)``, by rows."""
    return tuple(Vec3(*(F.try_divide(r, a) for r, a in zip(row, s, strict=True))) for row in rows)


def gram(m: tuple[Vec3, Vec3, Vec3]) -> Sym3:
    """``M M^T`` of rows."""
    pick = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    return tuple(m[i].x * m[j].x + m[i].y * m[j].y + m[i].z * m[j].z for i, j in pick)


def cofactors(c: Sym3) -> Sym3:
    """Of a symmetric matrix: its inverse times its determinant."""
    xx, xy, xz, yy, yz, zz = c
    return (yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)


def mahalanobis(d: Vec3, c: Sym3) -> Column:
    """The squared distance of offset *d* from the mean, in the metric of *c*."""
    xx, xy, xz, yy, yz, zz = c
    return xx * d.x * d.x + yy * d.y * d.y + zz * d.z * d.z + F.lit(2.0) * (xy * d.x * d.y + xz * d.x * d.z + yz * d.y * d.z)


def power(d: Vec3, c: Sym3) -> Column:
    """The exponent of the density at offset *d*."""
    return F.lit(-0.5) * mahalanobis(d, c)


def density_of(power: Column, opacity: Column) -> Column:
    """``opacity * exp(power)``; 0 where the exponent is positive or under -15."""
    return F.when((power > 0) | (power < -15), F.lit(0.0)).otherwise(opacity * F.exp(power))


def density(d: Vec3, c: Sym3, opacity: Column) -> Column:
    """The density at offset *d*. Where rows are many, bind ``power`` first."""
    return density_of(power(d, c), opacity)


def contact_points(c: Sym3, det_scale: Column, iso: Column) -> tuple[Vec3, Vec3, Vec3]:
    """Offsets from the mean where the iso surface touches the faces of its box (one of each opposite two)."""
    h = cofactors(c)
    return contacts_of(contact_weights(h, det_scale, iso), h)


def contact_weights(h: Sym3, det_scale: Column, iso: Column) -> tuple[Column, Column, Column]:
    """What the rows of the cofactors *h* are multiplied by for the contact points."""
    return tuple(det_scale * F.sqrt(F.try_divide(iso, h[i])) for i in (0, 3, 5))


def contacts_of(weights: tuple[Column, Column, Column], h: Sym3) -> tuple[Vec3, Vec3, Vec3]:
    rows = ((0, 1, 2), (1, 3, 4), (2, 4, 5))
    return tuple(Vec3(*(w * h[i] for i in row)) for w, row in zip(weights, rows, strict=True))


def surface_point(mean: Vec3, rows: tuple[Vec3, Vec3, Vec3], s: Vec3, iso: Column, u: Column, v: Column) -> Vec3:
    """The point of the iso surface at angles *u* (around) and *v* (from the pole)."""
    r = F.sqrt(iso)
    local = Vec3(r * s.x * F.cos(u) * F.sin(v), r * s.y * F.sin(u) * F.sin(v), r * s.z * F.cos(v))
    return Vec3(*(m + row.x * local.x + row.y * local.y + row.z * local.z for m, row in zip(mean, rows, strict=True)))


def offset(point: Vec3, mean: Vec3) -> Vec3:
    return sub(point, mean)
