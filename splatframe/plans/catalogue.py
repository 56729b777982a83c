"""The registered queries, by name, and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec3
from ..operators import bounds, drawing, edges, grids, knn, masks, voxels
from ..schema import BOX, CONTACT, COVI, EDGE, VOXEL
from ..sources import scenes
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
_BOX = [*BOX[0], *BOX[1]]
_CORNERS = [*VOXEL[0], *VOXEL[1]]
_ENDS = [*EDGE[0], *EDGE[1]]
K = 8
#: How many pairs the queries with a limit keep.
FIRST = 1000


def _boxes(**kw) -> Query:
    kw = {"level": scenes.LEVEL, "rotnorm": True} | kw
    return lambda spark, d: bounds.gaussian_bounds(scenes.gaussians_raw(spark, d), **kw).select("gid", *_BOX)


def _voxel_pairs(spark: SparkSession, d: str, **kw) -> DataFrame:
    return voxels.voxel_pairs(scenes.voxels(spark), scenes.gaussians(spark, d), **kw)


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return _voxel_pairs(spark, d, centroids=True).withColumn("density", F.round("density", 6))


def _planar(spark: SparkSession, d: str, **kw) -> DataFrame:
    return voxels.planar_voxel_pairs(scenes.voxels(spark), scenes.gaussians(spark, d), **kw)


def _split(keep) -> Query:
    return lambda spark, d: keep(scenes.voxels(spark), _voxel_pairs(spark, d), "vid").select("vid")


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    points = scenes.embed_points(spark, d)
    return knn.knn_join(points, points.withColumnRenamed("pid", "qid"), 4)


def _rounded(name: str) -> Column:
    """To nine places, without a negative zero."""
    return F.when(F.abs(name) < 5e-10, F.lit(0.0)).otherwise(F.round(name, 9)).alias(name)


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = grids.box_edges(scenes.voxels(spark))
    return grids.edge_mapping(rows, grids.unique_edges(rows))


def _by_iso(spark: SparkSession, d: str) -> DataFrame:
    return scenes.gaussians(spark, d, "iso")


def _places(*names: str, places: int = 6) -> list[Column]:
    """To so many places, without a negative zero."""
    return [(F.round(n, places) + F.lit(0.0)).alias(n) for n in names]


def _match(spark: SparkSession, d: str) -> DataFrame:
    """The mask of all voxels and the length of their lists, of which only the first pairs are kept."""
    grid = scenes.voxels(spark)
    mask, listed = masks.matches(grid, _voxel_pairs(spark, d), "vid", FIRST)
    counts = listed.groupBy(F.col("vid").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    return mask.join(counts, F.col("vid") == F.col("of"), "left").select("vid", "hit", F.coalesce("n", F.lit(0)).alias("n_listed"))


def _surface(spark: SparkSession, d: str) -> DataFrame:
    return drawing.surface_points(scenes.gaussians_raw(spark, d), scenes.LEVEL, rotnorm=True, around=8, down=5).select("gid", "i", "j", *_places("x", "y", "z"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Points against a line and a plane: foot on both, cross product, length, and the side of a line in the plane."""
    at = lambda *v: vec3.Vec3(*(F.lit(float(x)) for x in v))
    point, start, end = vec3.vec("x", "y", "z"), at(-1, 0.25, 0), at(1, 0.5, 0.5)
    a, b = at(0, 0, 0.25), at(1, 0, 0.5)
    normal, offset = vec3.plane_through(a, b, at(0, 1, 0.75))
    foot = vec3.project_plane(point, normal, offset)
    rows = scenes.points(spark, d).select(
        "pid", vec3.project_edge(point, start, end).alias("t"), *(c.alias(n) for n, c in zip(("fx", "fy", "fz"), foot, strict=True)),
        vec3.cross(point, vec3.sub(end, start)).x.alias("cross_x"), vec3.norm(point).alias("length"), vec3.normalize(point).x.alias("unit_x"), vec3.is_not_above(point, a, vec3.sub(b, a), normal).alias("not_above"),
    )
    return rows.select("pid", *_places("t", "fx", "fy", "fz", "cross_x", "length", "unit_x", places=9), "not_above")


QUERIES: dict[str, Query] = {
    "gs_aabb": _boxes(),
    "gs_covi": lambda s, d: scenes.gaussians(s, d).select("gid", *COVI),
    "gs_contact": lambda s, d: scenes.gaussians(s, d).select("gid", *sum(CONTACT, ())),
    "gs_aabb_iso_col": _boxes(iso="iso"),
    "gs_aabb_rotraw": _boxes(rotnorm=False),
    "gs_aabb_floor": _boxes(level=2),
    "voxel_grid": lambda s, d: scenes.voxels(s),
    "box_edges_unique": lambda s, d: scenes.edges(s),
    "box_edges_mapping": _mapping,
    "gs_voxel_raw": lambda s, d: _voxel_pairs(s, d, ar_threshold=0.0, p_threshold=0.0),
    "gs_voxel_pairs": _voxel_pairs,
    "gs_voxel_iso_col": lambda s, d: voxels.voxel_pairs(scenes.voxels(s), _by_iso(s, d), "iso"),
    "gs_voxel_centroids": _centroids,
    "gs_voxel_mask": lambda s, d: masks.hit_mask(scenes.voxels(s), _voxel_pairs(s, d), "vid"),
    "voxel_hits": _split(masks.hits),
    "voxel_misses": _split(masks.misses),
    "hit_count": lambda s, d: masks.hit_count(masks.hit_mask(scenes.voxels(s), _voxel_pairs(s, d), "vid")),
    "overlap_boxes": lambda s, d: _voxel_pairs(s, d, overlaps=True),
    "density_filter": lambda s, d: _centroids(s, d).where("density > 0.001").select("vid", "gid", "density"),
    "density_hist": lambda s, d: masks.density_histogram(_centroids(s, d)),
    "density_max": lambda s, d: _centroids(s, d).agg(F.max("density").alias("max_density")),
    "gs_edge_pairs": lambda s, d: edges.edge_pairs(scenes.edges(s), scenes.gaussians(s, d)),
    "gs_edge_mask": lambda s, d: masks.hit_mask(scenes.edges(s), edges.edge_pairs(scenes.edges(s), scenes.gaussians(s, d)), "eid"),
    "gs_edge_best": lambda s, d: edges.edge_best(scenes.edges(s), scenes.gaussians(s, d)),
    "gs_edge_best_iso_col": lambda s, d: edges.edge_best(scenes.edges(s), bounds.gaussian_bounds(scenes.gaussians_raw(s, d), scenes.LEVEL, "iso", rotnorm=True), "iso"),
    "best_ids": lambda s, d: edges.edge_best(scenes.edges(s), scenes.gaussians(s, d)).where("hit").select("gid").distinct(),
    "pgs_voxel_pairs": _planar,
    "pgs_voxel_centroids": lambda s, d: _planar(s, d, centroids=True, densities=True).select("vid", "gid", *(_rounded(c) for c in ("cx", "cy", "cz")), F.round("density", 6).alias("density")),
    "pgs_edge_best": lambda s, d: edges.planar_edge_best(scenes.edges(s), scenes.gaussians(s, d)),
    "knn": lambda s, d: knn.knn_join(scenes.points(s, d), scenes.queries(s, d), K),
    "knn_exclude_self": lambda s, d: knn.knn_join(scenes.points(s, d), scenes.points(s, d).withColumnRenamed("pid", "qid"), 3, exclude_self=True),
    "knn_embeddings_xyz": _embedded,
    "gs_edge_pairs_iso_col": lambda s, d: edges.edge_pairs(scenes.edges(s), _by_iso(s, d), "iso"),
    "pgs_voxel_iso_col": lambda s, d: voxels.planar_voxel_pairs(scenes.voxels(s), _by_iso(s, d), "iso"),
    "pgs_edge_best_iso_col": lambda s, d: edges.planar_edge_best(scenes.edges(s), _by_iso(s, d), "iso"),
    "gs_voxel_pairs_first": lambda s, d: _voxel_pairs(s, d, max_pairs=FIRST),
    "gs_edge_pairs_first": lambda s, d: edges.edge_pairs(scenes.edges(s), scenes.gaussians(s, d), max_pairs=FIRST),
    "pgs_voxel_pairs_first": lambda s, d: _planar(s, d, max_pairs=FIRST),
    "gs_voxel_match": _match,
    "pgs_voxel_mask": lambda s, d: masks.hit_mask(scenes.voxels(s), _planar(s, d), "vid"),
    "surface_points": _surface,
    "box_wireframe": lambda s, d: drawing.box_wireframe(scenes.voxels(s)),
    "edge_polylines": lambda s, d: drawing.polylines(scenes.edges(s)),
    "vector_helpers": _vectors,
    "neighbor_split": lambda s, d: masks.neighbour_split(scenes.points(s, d), knn.knn_join(scenes.points(s, d), scenes.queries(s, d), K)),
}

_ISO = {"iso": "iso"}
_G = f"WITH {sql.bounds()}"
_P = f"WITH {sql.voxel_pairs()}"
_NAMED = ", ".join(c if c != "by" else "by_ AS by" for c in _ENDS)
_HIT = "(SELECT vid FROM pair)"

ORACLE_SQL: dict[str, str] = {
    "gs_aabb": f"{_G} SELECT gid, {', '.join(_BOX)} FROM gs",
    "gs_covi": f"{_G} SELECT gid, c0, c1, c2, c3, c4, c5 FROM gs",
    "gs_contact": f"{_G} SELECT gid, {', '.join(sum(CONTACT, ()))} FROM gs",
    "gs_aabb_iso_col": f"WITH {sql.bounds(**_ISO)} SELECT gid, {', '.join(_BOX)} FROM gs",
    "gs_aabb_rotraw": f"WITH {sql.bounds(unit=False)} SELECT gid, {', '.join(_BOX)} FROM gs",
    "gs_aabb_floor": f"WITH {sql.bounds(level=2)} SELECT gid, {', '.join(_BOX)} FROM gs",
    "voxel_grid": f"WITH {sql.VOXELS} SELECT vid, {', '.join(_CORNERS)} FROM vox",
    "box_edges_unique": f"WITH {sql.EDGES} SELECT eid, {_NAMED} FROM edge",
    "box_edges_mapping": f"WITH {sql.EDGES} SELECT vid, slot, eid FROM boxed b JOIN edge e ON b.ax = e.ax AND b.ay = e.ay AND b.az = e.az AND b.bx = e.bx AND b.by_ = e.by_ AND b.bz = e.bz",
    "gs_voxel_raw": f"WITH {sql.voxel_pairs(0, 0)} SELECT vid, gid FROM pair",
    "gs_voxel_pairs": f"{_P} SELECT vid, gid FROM pair",
    "gs_voxel_iso_col": f"WITH {sql.voxel_pairs(**_ISO)} SELECT vid, gid FROM pair",
    "gs_voxel_centroids": f"{_P} SELECT vid, gid, cx, cy, cz, round(density, 6) AS density FROM pair",
    "gs_voxel_mask": f"{_P} SELECT vid, vid IN {_HIT} AS hit FROM vox",
    "voxel_hits": f"{_P} SELECT vid FROM vox WHERE vid IN {_HIT}",
    "voxel_misses": f"{_P} SELECT vid FROM vox WHERE vid NOT IN {_HIT}",
    "hit_count": f"{_P} SELECT count(*) FILTER (vid IN {_HIT}) AS n_hits, count(*) AS n_rows FROM vox",
    "overlap_boxes": f"{_P} SELECT vid, gid, ox0, oy0, oz0, ox1, oy1, oz1 FROM pair",
    "density_filter": f"{_P} SELECT vid, gid, round(density, 6) AS density FROM pair WHERE round(density, 6) > 0.001::DOUBLE",
    "density_hist": f"{_P} SELECT CAST(greatest(least(floor(round(density, 6) * 100::DOUBLE), 99), 0) AS BIGINT) AS bin, count(*) AS n_rows FROM pair GROUP BY 1",
    "density_max": f"{_P} SELECT max(round(density, 6)) AS max_density FROM pair",
    "gs_edge_pairs": sql.EDGE_PAIRS,
    "gs_edge_mask": sql.EDGE_MASK,
    "gs_edge_best": sql.EDGE_BEST,
    "gs_edge_best_iso_col": sql.EDGE_BEST.replace("11.345::DOUBLE AS lv", "iso AS lv"),
    "best_ids": f"SELECT DISTINCT gid FROM ({sql.EDGE_BEST}) WHERE hit",
    "pgs_voxel_pairs": f"WITH {sql.planar_voxels()} SELECT vid, gid FROM pair",
    "pgs_voxel_centroids": f"WITH {sql.planar_voxels()} SELECT vid, gid, CASE WHEN abs(cx) < 5e-10 THEN 0::DOUBLE ELSE round(cx, 9) END AS cx, CASE WHEN abs(cy) < 5e-10 THEN 0::DOUBLE ELSE round(cy, 9) END AS cy, CASE WHEN abs(cz) < 5e-10 THEN 0::DOUBLE ELSE round(cz, 9) END AS cz, round({sql.density('(cx - mx)', '(cy - my)', '(cz - mz)', '1')}, 6) AS density FROM pair",
    "pgs_edge_best": sql.PLANAR_EDGE_BEST,
    "knn": sql.nearest(f"{sql.POINTS}, {sql.ASKED}", K),
    "knn_exclude_self": sql.nearest(f"{sql.POINTS}, ask AS (SELECT pid AS qid, x, y, z FROM pts)", 3, 1),
    "knn_embeddings_xyz": sql.nearest(sql.EMBEDDED, 4),
    "gs_edge_pairs_iso_col": sql.EDGE_PAIRS.replace("11.345::DOUBLE AS lv", "iso AS lv"),
    "pgs_voxel_iso_col": f"WITH {sql.planar_voxels(**_ISO)} SELECT vid, gid FROM pair",
    "pgs_edge_best_iso_col": sql.PLANAR_EDGE_BEST.replace("11.345::DOUBLE AS lv", "iso AS lv"),
    "gs_voxel_pairs_first": f"{_P} SELECT vid, gid FROM pair ORDER BY vid, gid LIMIT {FIRST}",
    "gs_edge_pairs_first": f"{sql.EDGE_PAIRS} ORDER BY eid, gid LIMIT {FIRST}",
    "pgs_voxel_pairs_first": f"WITH {sql.planar_voxels()} SELECT vid, gid FROM pair ORDER BY vid, gid LIMIT {FIRST}",
    "gs_voxel_match": f"{_P}, listed AS (SELECT vid, gid FROM pair ORDER BY vid, gid LIMIT {FIRST}) SELECT vid, vid IN {_HIT} AS hit, (SELECT count(*) FROM listed l WHERE l.vid = vox.vid) AS n_listed FROM vox",
    "pgs_voxel_mask": f"WITH {sql.planar_voxels()} SELECT vid, vid IN {_HIT} AS hit FROM vox",
    "surface_points": sql.SURFACE,
    "box_wireframe": sql.OUTLINE,
    "edge_polylines": sql.POLYLINES,
    "vector_helpers": sql.VECTORS,
    "neighbor_split": f"SELECT c_custkey AS pid, c_custkey IN (SELECT pid FROM ({sql.nearest(f'{sql.POINTS}, {sql.ASKED}', K)})) AS is_neighbor FROM customer",
}
