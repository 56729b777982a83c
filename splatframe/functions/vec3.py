"""Vectors of three Columns."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec3(NamedTuple):
    x: Column
    y: Column
    z: Column


def vec(*names: str | Column) -> Vec3:
    """The vector in three columns, given by name or as Columns; always doubles."""
    return Vec3(*(F.col(n).cast("double") if isinstance(n, str) else n for n in names))


def add(a: Vec3, b: Vec3) -> Vec3:
    return Vec3(*(p + q for p, q in zip(a, b, strict=True)))


def sub(a: Vec3, b: Vec3) -> Vec3:
    return Vec3(*(p - q for p, q in zip(a, b, strict=True)))


def scale(a: Vec3, s: Column | float) -> Vec3:
    return Vec3(*(p * s for p in a))


def dot(a: Vec3, b: Vec3) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vec3, b: Vec3) -> Vec3:
    return Vec3(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def norm(a: Vec3) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec3) -> Vec3:
    """Null components for the zero vector."""
    n = norm(a)
    return Vec3(*(F.try_divide(p, n) for p in a))


def point_at(start: Vec3, end: Vec3, t: Column | float) -> Vec3:
    return add(start, scale(sub(end, start), t))


def project_edge(point: Vec3, start: Vec3, end: Vec3) -> Column:
    """The parameter of the foot of *point* on the line from *start* (0) to *end* (1); null if they are one."""
    d = sub(end, start)
    return F.try_divide(dot(sub(point, start), d), dot(d, d))


def plane_through(a: Vec3, b: Vec3, c: Vec3) -> tuple[Vec3, Column]:
    """Normal n and offset d of the plane of three points: n . p + d = 0."""
    n = cross(sub(b, a), sub(c, a))
    return n, -dot(n, a)


def project_plane(point: Vec3, normal: Vec3, offset: Column) -> Vec3:
    """The foot of *point* on a plane; null components for a zero normal."""
    t = F.try_divide(dot(normal, point) + offset, dot(normal, normal))
    return sub(point, scale(normal, t))


def is_not_above(point: Vec3, start: Vec3, along: Vec3, normal: Vec3) -> Column:
    """Whether *point*, in a plane with *normal*, is on the line from *start* in direction *along* or on its right, seen from where the normal points."""
    return dot(cross(normal, along), sub(point, start)) <= 0


def present(*names: str) -> Column:
    """Whether none of the columns is null."""
    return reduce(lambda p, q: p & q, (F.col(n).isNotNull() for n in names))


def finite(*columns: Column) -> Column:
    """Whether all are numbers: neither null nor NaN nor infinite."""
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return reduce(lambda p, q: p & q, map(ok, columns))
