"""Gaussian-segment pairs, and the best Gaussian of each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.gaussian import cofactors, density_of, power
from ..functions.vec3 import add, finite, point_at, present, scale, sub, vec
from ..lineage import bind
from ..schema import COVI, EDGE, MEAN, NORMAL, covi, iso_of, require
from .broadphase import overlap_join

_GBOX = (("_g0", "_g1", "_g2"), ("_g3", "_g4", "_g5"))
_EBOX = (("_e0", "_e1", "_e2"), ("_e3", "_e4", "_e5"))


def _reach(iso: Column) -> list[Column]:
    """Half sides of the box of a Gaussian's iso surface, from its inverse covariance; beyond all bounds where that is
    no ellipsoid, so that the pair test alone decides. A little wider than exact, for rounding."""
    c = covi()
    h = cofactors(c)
    det = c[0] * h[0] + c[1] * h[1] + c[2] * h[2]
    solid = (c[0] > 0) & (h[5] > 0) & (det > 0)
    return [F.when(solid, F.sqrt(F.try_divide(F.greatest(iso, F.lit(0.0)) * h[i], det)) * 1.000001 + 1e-9).otherwise(F.lit(1e18)) for i in (0, 3, 5)]


def _candidates(edges: DataFrame, gaussians: DataFrame, used: list[str], iso: Column) -> DataFrame:
    require(edges, "eid", *sum(EDGE, ()))
    require(gaussians, "gid", *used)
    # Filters that say so let Spark leave the handling of nulls out of all that follows.
    gaussians = gaussians.where(present(*used) & finite(*(F.col(c).cast("double") for c in used))).select("gid", *used, iso.alias("_iso")).where(present("_iso") & finite(F.col("_iso")))
    mean, reach = vec(*MEAN), _reach(F.col("_iso"))
    gaussians = bind(gaussians, {n: m - r for n, m, r in zip(_GBOX[0], mean, reach, strict=True)} | {n: m + r for n, m, r in zip(_GBOX[1], mean, reach, strict=True)})
    a, b = vec(*EDGE[0]), vec(*EDGE[1])
    edges = edges.select("eid", *sum(EDGE, ())).where(present(*sum(EDGE, ())) & finite(*a, *b))
    edges = edges.withColumns({n: F.least(x, y) for n, x, y in zip(_EBOX[0], a, b, strict=True)} | {n: F.greatest(x, y) for n, x, y in zip(_EBOX[1], a, b, strict=True)})
    return overlap_join(gaussians, _GBOX, edges, _EBOX).drop(*_GBOX[0], *_GBOX[1], *_EBOX[0], *_EBOX[1])


_FROM, _ALONG = ("_px", "_py", "_pz"), ("_dx", "_dy", "_dz")


def _quadratic(rows: DataFrame) -> DataFrame:
    """*rows* with the segment's start relative to the mean, its direction, and the coefficients ``_a``, ``_b`` and ``_c`` along it."""
    mean = vec(*MEAN)
    a, b = sub(vec(*EDGE[0]), mean), sub(vec(*EDGE[1]), mean)
    rows = bind(rows, dict(zip(_FROM, a, strict=True)) | dict(zip(_ALONG, sub(b, a), strict=True)))
    return bind(rows, dict(zip(("_a", "_b", "_c"), p.segment_quadratic(vec(*_FROM), vec(*_ALONG), covi(), F.col("_iso")), strict=True)))


def _scored(rows: DataFrame, at) -> DataFrame:
    """eid, gid and the density at offset *at*."""
    rows = bind(rows, {"_power": power(at, covi())})
    return rows.select("eid", "gid", density_of(F.col("_power"), F.col("opacity").cast("double")).alias("density"))


def edge_pairs(edges: DataFrame, gaussians: DataFrame, iso: float | str | Column = 11.345, max_pairs: int | None = None) -> DataFrame:
    """eid and gid of segments that meet a Gaussian's solid ellipsoid. A tangent misses, and so does one that only ends on it."""
    rows = _candidates(edges, gaussians, [*MEAN, *COVI], iso_of(iso))
    rows = _quadratic(rows).where(p.solid_hit(F.col("_a"), F.col("_b"), F.col("_c"))).select("eid", "gid")
    return rows if max_pairs is None else rows.orderBy("eid", "gid").limit(max_pairs)


def _best(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """All segments with hit, and gid of the highest density (ties: the least gid), or -1. Partial maxima are taken before the shuffle."""
    best = scored.groupBy("eid").agg(F.min(F.struct((-F.col("density")).alias("d"), F.col("gid").cast("bigint").alias("gid"))).alias("best"))
    best = best.select(F.col("eid").alias("_eid"), F.col("best.gid").alias("_gid"))
    return edges.select("eid").join(best, F.col("eid") == F.col("_eid"), "left").select("eid", F.col("_gid").isNotNull().alias("hit"), F.coalesce("_gid", F.lit(-1).cast("bigint")).alias("gid"))


def edge_best(edges: DataFrame, gaussians: DataFrame, iso: float | str | Column = 11.345) -> DataFrame:
    """eid, hit and gid: the Gaussian that is densest at the middle of its chord. Densities of 0 count."""
    rows = _candidates(edges, gaussians, [*MEAN, *COVI, "opacity"], iso_of(iso))
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    rows = bind(_quadratic(rows).where(p.solid_hit(a, b, c)), {"_t": p.chord_middle(a, b, c)})
    return _best(edges, _scored(rows, add(vec(*_FROM), scale(vec(*_ALONG), F.col("_t")))))


def planar_edge_best(edges: DataFrame, gaussians: DataFrame, iso: float | str | Column = 11.345) -> DataFrame:
    """eid, hit and gid: the planar Gaussian that is densest where the segment meets its disc."""
    rows = _candidates(edges, gaussians, [*MEAN, *NORMAL, *COVI, "opacity"], iso_of(iso))
    start, mean, normal = vec(*EDGE[0]), vec(*MEAN), vec(*NORMAL)
    d = sub(vec(*EDGE[1]), start)
    rows = bind(rows, {"_p": p.plane_parameter(start, d, mean, normal)})
    rows = bind(rows, {"_t": p.on_disc(F.col("_p"), start, d, mean, covi(), F.col("_iso"))}).where("_t >= 0")
    return _best(edges, _scored(rows, sub(point_at(start, vec(*EDGE[1]), F.col("_t")), mean)))
