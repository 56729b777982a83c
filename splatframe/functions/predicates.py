"""Intersection tests as Column expressions.

They are plain arithmetic without lambdas, so that Spark compiles them. The costly ones come in steps: an operator adds the values of one step as columns
before the next step refers to them, so that each is computed once, and binds the last step (``lineage.bind``), so that no filter on it is pushed down. Cheap tests come first, as filters on columns that are there already.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gaussian import Sym3, mahalanobis
from .vec3 import Vec3, add, dot, sub


def boxes_overlap(a: tuple[Vec3, Vec3], b: tuple[Vec3, Vec3]) -> Column:
    """Closed: boxes that touch overlap."""
    (a0, a1), (b0, b1) = a, b
    return (a0.x <= b1.x) & (b0.x <= a1.x) & (a0.y <= b1.y) & (b0.y <= a1.y) & (a0.z <= b1.z) & (b0.z <= a1.z)


def box_inside(inner: tuple[Vec3, Vec3], outer: tuple[Vec3, Vec3]) -> Column:
    """Closed: a box is inside itself."""
    (i0, i1), (o0, o1) = inner, outer
    return (o0.x <= i0.x) & (i1.x <= o1.x) & (o0.y <= i0.y) & (i1.y <= o1.y) & (o0.z <= i0.z) & (i1.z <= o1.z)


def transformed(v: Vec3, c: Sym3) -> Vec3:
    """The symmetric matrix *c* times *v*."""
    xx, xy, xz, yy, yz, zz = c
    return Vec3(xx * v.x + xy * v.y + xz * v.z, xy * v.x + yy * v.y + yz * v.z, xz * v.x + yz * v.y + zz * v.z)


def segment_quadratic(p: Vec3, d: Vec3, c: Sym3, iso: Column) -> tuple[Column, Column, Column]:
    """Coefficients of the distance along ``p + t d``, less iso: a t^2 + b t + c."""
    cd, cp = transformed(d, c), transformed(p, c)
    return dot(d, cd), F.lit(2.0) * dot(p, cd), dot(p, cp) - iso


def solid_hit(a: Column, b: Column, c: Column) -> Column:
    """Whether a segment with this quadratic meets the solid: a tangent misses, and so does a segment that only ends or starts on the surface.

    It enters before 1 and leaves after 0, both roots multiplied by ``2 |a|``; where a is 0 it misses.
    """
    disc = b * b - F.lit(4.0) * a * c
    root, side = F.sqrt(F.greatest(disc, F.lit(0.0))), F.signum(a)
    return (disc > 0) & (side * (-b - root) < F.lit(2.0) * F.abs(a)) & (side * (root - b) > 0)


def chord_middle(a: Column, b: Column, c: Column) -> Column:
    """The parameter of the middle of the part of the segment within the solid, where ``solid_hit``."""
    root = F.sqrt(F.greatest(b * b - F.lit(4.0) * a * c, F.lit(0.0)))
    half, mid = F.try_divide(root, F.lit(2.0) * a), F.try_divide(-b, F.lit(2.0) * a)
    return (F.greatest(mid - half, F.lit(0.0)) + F.least(mid + half, F.lit(1.0))) / 2


#: A parameter that says that a segment misses; hits are from 0 to 1. It isn't null, for Spark compiles what is never null to less.
MISS = -1.0


def cube_edges(p: Vec3, size: Column) -> list[tuple[Vec3, int]]:
    """Starts and axes (0 x, 1 y, 2 z) of a cube's edges: four for each axis in turn."""
    o = F.lit(0.0)
    out = []
    for hi, lo in ((o, o), (o, size), (size, o), (size, size)):
        out += [(Vec3(p.x, p.y + hi, p.z + lo), 0), (Vec3(p.x + hi, p.y, p.z + lo), 1), (Vec3(p.x + hi, p.y + lo, p.z), 2)]
    return out


def along(axis: int, size: Column) -> Vec3:
    return Vec3(*(size if i == axis else F.lit(0.0) for i in range(3)))


def cube_terms(p: Vec3, size: Column, c: Sym3, iso: Column) -> dict[str, Column]:
    """What the tests of a cube's twelve edges share: the matrix times each axis (``_d0x`` ...), and the distance less iso at the corners where edges start (``_k000`` ..., by axis 0 low or 1 high)."""
    out = {}
    for axis in range(3):
        out |= {f"_d{axis}{n}": v for n, v in zip("xyz", transformed(along(axis, size), c), strict=True)}
    at = lambda bits: Vec3(*(p[k] + (size if bit == "1" else F.lit(0.0)) for k, bit in enumerate(bits)))
    for bits in ("000", "001", "010", "011", "100", "101", "110"):
        corner = at(bits)
        out[f"_k{bits}"] = dot(corner, transformed(corner, c)) - iso
    return out


def cube_slopes(p: Vec3, size: Column) -> dict[str, Column]:
    """The linear coefficients along the cube's twelve edges (``_b0_00`` ..., by axis and by low or high on the other two); of columns as ``cube_terms`` has them."""
    out = {}
    for axis, i, j in _EDGES:
        cd, start = Vec3(*(F.col(f"_d{axis}{n}") for n in "xyz")), list(p)
        for k, high in zip((k for k in range(3) if k != axis), (i, j), strict=True):
            start[k] = start[k] + (size if high else F.lit(0.0))
        out[f"_b{axis}_{i}{j}"] = F.lit(2.0) * dot(Vec3(*start), cd)
    return out


def cube_edge_hits(size: Column) -> list[Column]:
    """Whether each of the cube's twelve edges meets the solid ellipsoid; of columns as ``cube_terms`` and ``cube_slopes`` have them."""
    out = []
    for axis, i, j in _EDGES:
        corner = [str(i), str(j)]
        corner.insert(axis, "0")
        out.append(solid_hit(size * F.col(f"_d{axis}{'xyz'[axis]}"), F.col(f"_b{axis}_{i}{j}"), F.col(f"_k{''.join(corner)}")))
    return out


_EDGES = [(axis, i, j) for axis in range(3) for i in (0, 1) for j in (0, 1)]


def face_parameters(p: Vec3, size: Column, contacts: tuple[Vec3, Vec3, Vec3]) -> dict[str, Column]:
    """Where the diameter between a contact point (0) and its opposite (1) meets the planes of the cube's two faces that face its axis (``_f00`` ..., by axis and low or high);
    ``MISS`` if it is parallel to them."""
    out = {}
    for i, q in enumerate(contacts):
        for n, shift in enumerate((F.lit(0.0), size)):
            out[f"_f{i}{n}"] = F.when(q[i] != 0, (q[i] - (p[i] + shift)) / (F.lit(2.0) * q[i])).otherwise(MISS)
    return out


def face_pierced(p: Vec3, size: Column, contacts: tuple[Vec3, Vec3, Vec3]) -> Column:
    """Whether one of these diameters pierces such a face; of columns as ``face_parameters`` has them."""
    hits = []
    for i, q in enumerate(contacts):
        j, k = [n for n in range(3) if n != i]
        for n in (0, 1):
            t = F.col(f"_f{i}{n}")
            f = F.lit(1.0) - F.lit(2.0) * t
            inside = [(p[m] <= f * q[m]) & (f * q[m] <= p[m] + size) for m in (j, k)]
            hits.append((t >= 0) & (t <= 1) & inside[0] & inside[1])
    return any_of(hits)


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def overlap_box(a: tuple[Vec3, Vec3], b: tuple[Vec3, Vec3]) -> tuple[Vec3, Vec3]:
    return Vec3(*map(F.greatest, a[0], b[0])), Vec3(*map(F.least, a[1], b[1]))


def overlap_ratios(box: tuple[Vec3, Vec3], size: Column) -> tuple[Column, Column]:
    """Aspect ratio of the overlap box, and its least side over the voxel's size; 0 where the divisor is tiny."""
    least, most = F.least(*sides(box)), F.greatest(*sides(box))
    return side_ratios(least, most, size)


def sides(box: tuple[Vec3, Vec3]) -> Vec3:
    """Lengths on each axis; 0 where the box ends before it begins."""
    return Vec3(*(F.greatest(hi - lo, F.lit(0.0)) for lo, hi in zip(*box, strict=True)))


def side_ratios(least: Column, most: Column, size: Column) -> tuple[Column, Column]:
    """``overlap_ratios`` of a box with these least and most sides."""
    ratio = lambda n, d: F.when(d <= 1e-6, F.lit(0.0)).otherwise(F.try_divide(n, d))
    return ratio(least, most), ratio(least, size)


def middle(box: tuple[Vec3, Vec3]) -> Vec3:
    return Vec3(*((lo + hi) / 2 for lo, hi in zip(*box, strict=True)))


def plane_parameter(start: Vec3, d: Vec3, mean: Vec3, normal: Vec3) -> Column:
    """Where the line meets the plane; ``MISS`` where it is as good as parallel (neither is normalised)."""
    steep = dot(d, normal)
    return F.when(F.abs(steep) >= 1e-6, dot(sub(mean, start), normal) / steep).otherwise(MISS)


def on_disc(t: Column, start: Vec3, d: Vec3, mean: Vec3, c: Sym3, iso: Column) -> Column:
    """*t*, where the line meets the plane, if that is in the segment (closed) and in the planar Gaussian's disc (rim and all); else ``MISS``."""
    at = add(start, Vec3(t * d.x, t * d.y, t * d.z))
    return F.when((t >= 0) & (t <= 1) & (mahalanobis(sub(at, mean), c) <= iso), t).otherwise(MISS)


def corners_on_both_sides(box: tuple[Vec3, Vec3], mean: Vec3, normal: Vec3) -> Column:
    """Whether the plane has corners above it and corners on or below it: the highest and the lowest corner are so on every axis."""
    ends = [[(side[k] - mean[k]) * normal[k] for side in box] for k in range(3)]
    high, low = (f(*ends[0]) + f(*ends[1]) + f(*ends[2]) for f in (F.greatest, F.least))
    return (high > 0) & (low <= 0)


def cube_offsets(p: Vec3, size: Column, mean: Vec3) -> dict[str, Column]:
    """The cube's low and high ends on each axis, relative to the mean (``_o00`` ..., by axis and 0 or 1)."""
    return {f"_o{k}{n}": p[k] + shift - mean[k] for k in range(3) for n, shift in enumerate((F.lit(0.0), size))}


def cube_plane_terms(size: Column, normal: Vec3) -> dict[str, Column]:
    """How steep the cube's axes meet the plane (``_s0`` ...), and how far below it the corners are where edges start (``_h000`` ..., by axis 0 low or 1 high); of columns as ``cube_offsets`` has them."""
    out = {f"_s{axis}": size * normal[axis] for axis in range(3)}
    for bits in ("000", "001", "010", "011", "100", "101", "110"):
        out[f"_h{bits}"] = -dot(Vec3(*(F.col(f"_o{k}{bit}") for k, bit in enumerate(bits))), normal)
    return out


def cube_plane_parameters() -> dict[str, Column]:
    """Where the cube's twelve edges meet the plane (``_p0_00`` ..., as in ``cube_slopes``), or ``MISS``; of columns as ``cube_plane_terms`` has them."""
    out = {}
    for axis, i, j in _EDGES:
        steep, corner = F.col(f"_s{axis}"), [str(i), str(j)]
        corner.insert(axis, "0")
        out[f"_p{axis}_{i}{j}"] = F.when(F.abs(steep) >= 1e-6, F.col(f"_h{''.join(corner)}") / steep).otherwise(MISS)
    return out


def cube_disc_parameters(p: Vec3, size: Column, mean: Vec3, c: Sym3, iso: Column) -> dict[str, Column]:
    """Where the cube's twelve edges meet the planar Gaussian's disc (``_t0_00`` ...), or ``MISS``; of columns as ``cube_plane_parameters`` and ``cube_offsets`` have them."""
    out = {}
    for axis, i, j in _EDGES:
        t, at = F.col(f"_p{axis}_{i}{j}"), [F.col(f"_o{k}{n}") for k, n in zip((k for k in range(3) if k != axis), (i, j), strict=True)]
        at.insert(axis, p[axis] + t * size - mean[axis])
        out[f"_t{axis}_{i}{j}"] = F.when((t >= 0) & (t <= 1) & (mahalanobis(Vec3(*at), c) <= iso), t).otherwise(MISS)
    return out


def cube_points(p: Vec3, size: Column, k: int) -> list[tuple[Column, Column]]:
    """For each of the twelve edges, in the order of ``cube_edges``, whether it meets the disc, and coordinate *k* of the point where it does."""
    out = []
    for i in (0, 1):
        for j in (0, 1):
            for axis in range(3):
                t, ends = F.col(f"_t{axis}_{i}{j}"), dict(zip((n for n in range(3) if n != axis), (i, j), strict=True))
                out.append((t >= 0, p[k] + t * size if k == axis else p[k] + size if ends[k] else p[k]))
    return out
