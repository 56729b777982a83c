"""The example scene with its known counts, edge cases, and agreement with a plain numpy specification."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatframe import schema
from splatframe.functions import gaussian, predicates, vec3
from splatframe.operators import bounds, broadphase, edges, grids, knn, masks, voxels
from splatframe.plans import catalogue

RAW = "gid bigint, mx double, my double, mz double, qw double, qx double, qy double, qz double, sx double, sy double, sz double, opacity double, nx double, ny double, nz double"


@pytest.fixture(scope="module")
def scene(spark):
    """One Gaussian in a grid of 8 x 8 x 8 boxes of side 0.5."""
    raw = spark.createDataFrame([(0, 0.5, 0.5, 0.5, 0.5, 0.2, 0.7, 0.3, 0.1, 0.6, 0.5, 0.5, 0.5, -1.5, 2.0)], RAW)
    return bounds.gaussian_bounds(raw, 8, rotnorm=True).cache(), grids.voxel_grid(spark, 8, (-2.0, -2.0, -2.0), 0.5).cache()


def test_bounds_of_the_scene(scene):
    r = scene[0].first()
    assert [r[c] for c in schema.COVI] == pytest.approx([14.66602076, -21.31363309, 21.35335653, 46.06580937, -43.27737408, 46.04594765], abs=1e-7)
    assert [r[c] for c in sum(schema.CONTACT, ())] == pytest.approx([1.59197242, 0.36743836, -0.39291595, 0.39087030, 1.49653667, 1.22529316, -0.41609300, 1.21978303, 1.50329698], abs=1e-7)
    assert [r[c] for c in sum(schema.BOX, ())] == pytest.approx([-1.09197242, -0.99653667, -1.00329698, 2.09197242, 1.99653667, 2.00329698], abs=1e-7)


def test_voxels_of_the_scene(scene):
    g, v = scene
    assert broadphase.overlap_join(g.select("gid", *sum(schema.BOX, ())), schema.BOX, v, schema.VOXEL).count() == 294
    assert voxels.voxel_pairs(v, g, ar_threshold=0.0, p_threshold=0.0).count() == 113
    rows = voxels.voxel_pairs(v, g, centroids=True).orderBy("vid").collect()
    assert len(rows) == 111 and [r.vid for r in rows[:10]] == [147, 148, 149, 150, 155, 156, 157, 158, 159, 165]
    assert sum(r.density for r in rows) == pytest.approx(1.893055, abs=1e-6) and sum(r.density > 0.001 for r in rows) == 46
    first = voxels.voxel_pairs(v, g, max_pairs=3).collect()
    assert sorted(r.vid for r in first) == [147, 148, 149]


def test_edges_of_the_scene(scene):
    g, v = scene
    unique = grids.unique_edges(grids.box_edges(v)).cache()
    assert unique.count() == 1944
    pairs = edges.edge_pairs(unique, g)
    best = edges.edge_best(unique, g).collect()
    assert pairs.count() == 162 == sum(r.hit for r in best) and len(best) == 1944
    assert all((r.gid == -1) != r.hit for r in best)
    planar = edges.planar_edge_best(unique, g).collect()
    assert sum(r.hit for r in planar) == 54 and all((r.gid == -1) != r.hit for r in planar)
    mapping = grids.edge_mapping(grids.box_edges(v), unique)
    assert mapping.count() == 512 * 12 and mapping.select("eid").distinct().count() == 1944


def test_planar_voxels_of_the_scene(scene):
    g, v = scene
    rows = voxels.planar_voxel_pairs(v, g, centroids=True, densities=True).orderBy("vid").collect()
    assert len(rows) == 53 and [r.vid for r in rows[:10]] == [210, 211, 212, 213, 219, 220, 221, 222, 230, 231]
    assert sum(r.density for r in rows) == pytest.approx(9.323041, abs=1e-6)


def test_iso_as_number_column_and_name(spark, scene):
    g, v = scene
    raw = g.withColumn("level", F.lit(11.345))
    want = set(map(tuple, voxels.voxel_pairs(v, g).collect()))
    assert set(map(tuple, voxels.voxel_pairs(v, raw, "level").collect())) == want == set(map(tuple, voxels.voxel_pairs(v, raw, F.col("level")).collect()))
    cut = set(map(tuple, voxels.planar_voxel_pairs(v, g).collect()))
    assert cut == set(map(tuple, voxels.planar_voxel_pairs(v, raw, F.col("level")).collect()))
    narrow = bounds.gaussian_bounds(raw.withColumn("level", F.lit(1.0)), 8, "level", rotnorm=True).first()
    wide = g.first()
    assert (narrow.gx1 - 0.5) * math.sqrt(11.345) == pytest.approx(wide.gx1 - 0.5)


def solid(p, e, c, iso):
    """Whether a segment meets an ellipsoid, in numpy."""
    p, e = np.array(p, float), np.array(e, float)
    m = np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]], float)
    d = e - p
    a, b, k = d @ m @ d, 2 * p @ m @ d, p @ m @ p - iso
    disc = b * b - 4 * a * k
    if a == 0 or disc <= 0:
        return False
    enter, leave = -b / (2 * a) - math.sqrt(disc) / (2 * a), -b / (2 * a) + math.sqrt(disc) / (2 * a)
    return enter < 1 and leave > 0


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 1.0)
SEGMENTS = [
    ((-2, 0, 0), (2, 0, 0)), ((-2, 1, 0), (2, 1, 0)), ((-0.1, 0, 0), (0.1, 0, 0)), ((1, 0, 0), (2, 0, 0)), ((2, 0, 0), (1, 0, 0)), ((0.5, 0, 0), (0.5, 0, 0)), ((3, 0, 0), (3, 0, 0)), ((0.9, 0, 0), (5, 0, 0)), ((0, 0, -9), (0, 0, -1)), ((5, 5, 5), (6, 5, 5)),
]


def test_segment_edge_cases(spark):
    rng = np.random.default_rng(0)
    more = [(tuple(rng.uniform(-2, 2, 3).tolist()), tuple(rng.uniform(-2, 2, 3).tolist())) for _ in range(200)]
    segments = SEGMENTS + more
    df = spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(segments)], "eid bigint, ax double, ay double, az double, bx double, by double, bz double")
    g = spark.createDataFrame([(7, 0.0, 0.0, 0.0, *UNIT, 1.0, 0.0, 0.0, 1.0)], "gid bigint, mx double, my double, mz double, c0 double, c1 double, c2 double, c3 double, c4 double, c5 double, opacity double, nx double, ny double, nz double")
    want = {i for i, (a, b) in enumerate(segments) if solid(a, b, UNIT, 1.0)}
    assert {0, 2, 7} <= want and not want & {1, 3, 4, 5, 6, 8, 9}
    assert {r.eid for r in edges.edge_pairs(df, g, 1.0).collect()} == want
    best = edges.edge_best(df, g, 1.0).collect()
    assert {r.eid for r in best if r.hit} == want and {r.gid for r in best} == {7, -1}
    assert edges.edge_pairs(df, g, 0.0).count() == 0 == edges.edge_pairs(df, g, -1.0).count()
    # The plane z = 0: closed at both ends and at the rim.
    rows = [(0, 0, 0, -1, 0, 0, 1), (1, 1, 0, 0, 1, 0, 5), (2, 1.01, 0, 0, 1.01, 0, 5), (3, -1, 0, 0, 1, 0, 0), (4, 0, 0, 1, 0, 0, 2), (5, 0, 0, 2, 0, 0, 0)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], "eid bigint, ax double, ay double, az double, bx double, by double, bz double")
    assert {r.eid for r in edges.planar_edge_best(df, g, 1.0).collect() if r.hit} == {0, 1, 5}
    assert {r.eid for r in edges.planar_edge_best(df, g, 0.0).collect() if r.hit} == {0, 5}


def test_best_ties_and_zero_density(spark):
    cols = "gid bigint, mx double, my double, mz double, c0 double, c1 double, c2 double, c3 double, c4 double, c5 double, opacity double"
    e = spark.createDataFrame([(0, -2.0, 0.0, 0.0, 2.0, 0.0, 0.0), (1, -2.0, 9.0, 0.0, 2.0, 9.0, 0.0)], "eid bigint, ax double, ay double, az double, bx double, by double, bz double")
    twins = spark.createDataFrame([(5, 0.0, 0.0, 0.0, *UNIT, 0.5), (3, 0.0, 0.0, 0.0, *UNIT, 0.5), (9, 0.0, 0.5, 0.0, *UNIT, 0.5)], cols)
    assert {(r.eid, r.hit, r.gid) for r in edges.edge_best(e, twins, 4.0).collect()} == {(0, True, 3), (1, False, -1)}
    none = spark.createDataFrame([(4, 0.0, 0.0, 0.0, *UNIT, 0.0)], cols)
    assert {(r.eid, r.gid) for r in edges.edge_best(e, none, 4.0).collect()} == {(0, 4), (1, -1)}
    flat = spark.createDataFrame([(4, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5), (5, float("nan"), 0.0, 0.0, *UNIT, 1.0)], cols)  # no ellipsoid; not finite
    assert {(r.eid, r.gid) for r in edges.edge_best(e, flat, 1.0).collect()} == {(0, 4), (1, 4)}


def test_density_is_cut_off(spark):
    d = vec3.vec("x", F.lit(0.0), F.lit(0.0))
    c = tuple(F.lit(v) for v in UNIT)
    rows = spark.createDataFrame([(0.0,), (math.sqrt(30) - 1e-9,), (math.sqrt(30) + 1e-6,)], "x double").select(gaussian.density(d, c, F.lit(0.5)).alias("d")).collect()
    assert rows[0].d == 0.5 and rows[1].d == pytest.approx(0.5 * math.exp(-15)) and rows[2].d == 0


def test_invalid_gaussians(spark):
    rows = [(1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1), (2, 0, 0, 0, 1, 0, 0, 0, 1, 1, 1), (3, None, 0, 0, 1, 0, 0, 0, 1, 1, 1), (4, float("inf"), 0, 0, 1, 0, 0, 0, 1, 1, 1)]
    raw = spark.createDataFrame([(i, *(None if v is None else float(v) for v in r), 1.0, 0.0, 0.0, 1.0) for i, *r in rows], RAW)
    assert [r.gid for r in bounds.gaussian_bounds(raw, 8, rotnorm=True).collect()] == [2]
    assert bounds.gaussian_bounds(raw, 8, rotnorm=True, keep_invalid=True).count() == 4
    assert bounds.gaussian_bounds(raw, 8, -1.0, rotnorm=True).count() == 0
    tiny = raw.where("gid = 2").withColumn("sx", F.lit(1e-9))
    assert bounds.gaussian_bounds(tiny, 1, 1.0).first().gx1 == pytest.approx(1 / 8)
    with pytest.raises(ValueError, match="missing"):
        bounds.gaussian_bounds(raw.drop("sx"), 8)
    with pytest.raises(ValueError, match="number"):
        bounds.gaussian_bounds(raw.withColumn("sx", F.lit("a")), 8)


def test_box_holds_the_surface(spark):
    raw = spark.createDataFrame([(i, 0.1 * i, -0.2, 0.3, 1.0 + i, i - 2.0, 0.5, -0.25 * i, 0.1 + 0.1 * i, 0.3, 0.05, 1.0, 0.0, 0.0, 1.0) for i in range(6)], RAW)
    g = bounds.gaussian_bounds(raw, 12, 2.0, rotnorm=True)
    angles = spark.range(400).select((F.col("id") % 20 * (2 * math.pi / 20)).alias("u"), ((F.col("id") / 20).cast("int") * (math.pi / 19)).alias("v"))
    q = gaussian.unit_quaternion(*(F.col(c) for c in schema.QUAT))
    at = gaussian.surface_point(vec3.vec(*schema.MEAN), gaussian.rotation(*q), vec3.vec(*schema.SCALE), F.lit(2.0), F.col("u"), F.col("v"))
    rows = g.join(angles, how="cross").select("*", *(c.alias(n) for n, c in zip("xyz", at, strict=True)))
    m2 = gaussian.mahalanobis(vec3.sub(vec3.vec("x", "y", "z"), vec3.vec(*schema.MEAN)), schema.covi())
    inside = (F.col("x") <= F.col("gx1") + 1e-9) & (F.col("x") >= F.col("gx0") - 1e-9) & (F.col("z") <= F.col("gz1") + 1e-9) & (F.col("y") >= F.col("gy0") - 1e-9)
    assert rows.where(~inside | (F.abs(m2 - 2) > 1e-6)).count() == 0
    contact = gaussian.mahalanobis(vec3.vec(*schema.CONTACT[1]), schema.covi())
    assert g.where(F.abs(contact - 2) > 1e-6).count() == 0


def test_overlap_join_is_the_nested_loop(spark):
    rng = np.random.default_rng(3)

    def table(n, key, names):
        low = rng.choice([rng.uniform(-3, 3, (n, 3)), rng.integers(-3, 3, (n, 3)).astype(float)])
        side = np.exp(rng.uniform(-9, 2, (n, 1))) * rng.choice([0.0, 0.5, 1.0], (n, 3))
        rows = np.hstack([low, low + side])
        rows[0] = [-1e20, -5, -5, 1e20, 5, 5]
        return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"{key} bigint, " + ", ".join(f"{c} double" for c in sum(names, ()))), rows

    a, x = table(150, "gid", schema.BOX)
    b, y = table(200, "vid", schema.VOXEL)
    got = [(r.gid, r.vid) for r in broadphase.overlap_join(a, schema.BOX, b, schema.VOXEL).collect()]
    want = {(i, j) for i in range(150) for j in range(200) if (x[i, :3] <= y[j, 3:]).all() and (y[j, :3] <= x[i, 3:]).all()}
    assert len(got) == len(set(got)) and set(got) == want
    assert broadphase.overlap_join(a.limit(0), schema.BOX, b, schema.VOXEL).count() == 0


def nearest(points, queries, k):
    out = []
    for q, *at in queries:
        d = sorted((sum((a - b) ** 2 for a, b in zip(at, p, strict=True)), i) for i, *p in points)[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(d)]
    return out


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(i, *map(float, p)) for i, p in enumerate(np.vstack([rng.normal(0, 0.01, (150, 3)), rng.uniform(-5, 5, (100, 3)), np.zeros((40, 3)), [[100, 0, 0]]]))]
    asks = [(i, *map(float, q)) for i, q in enumerate(np.vstack([rng.uniform(-6, 6, (30, 3)), np.zeros((2, 3)), [[1000, -1000, 3], [50, 0, 0]], [pts[7][1:]]]))]
    points, queries = spark.createDataFrame(pts, "pid bigint, x double, y double, z double"), spark.createDataFrame(asks, "qid bigint, x double, y double, z double")
    for k in (1, 5, len(pts)):
        got = sorted((r.qid, r["rank"], r.pid, r.dist_sq) for r in knn.knn_join(points, queries, k).collect())
        want = sorted(nearest(pts, asks, k))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    shifted = sorted((r.qid, r["rank"], r.pid) for r in knn.knn_join(points, queries, 3, exclude_self=True).collect())
    assert shifted == sorted((q, n - 1, p) for q, n, p, _ in nearest(pts, asks, 4) if n > 1)
    own = {(r.qid, r.pid) for r in knn.knn_join(points, points.withColumnRenamed("pid", "qid"), 2, exclude_same_id=True).collect()}
    assert len(own) == 2 * len(pts) and all(q != p for q, p in own)
    split = masks.neighbour_split(points, knn.knn_join(points, queries.limit(1), 4))
    assert split.where("is_neighbor").count() == 4 and split.count() == len(pts)


def test_knn_limits(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "pid bigint, x double, y double, z double")
    asked = one.withColumnRenamed("pid", "qid")
    assert [(r.pid, r.dist_sq) for r in knn.knn_join(one, asked, 1).collect()] == [(1, 0.0)]
    for bad in (lambda: knn.knn_join(one, asked, 0), lambda: knn.knn_join(one, asked, 1, exclude_self=True), lambda: knn.knn_join(one.limit(0), asked, 1)):
        with pytest.raises(ValueError):
            bad()


def test_vectors(spark):
    row = spark.range(1)
    a, b, c = (vec3.Vec3(*(F.lit(float(v)) for v in p)) for p in ((1, 2, 3), (4, 6, 8), (0, 1, 0)))
    zero = vec3.scale(a, 0.0)
    normal, offset = vec3.plane_through(a, b, c)
    foot = vec3.project_plane(vec3.add(a, normal), normal, offset)
    got = row.select(
        vec3.project_edge(vec3.point_at(a, b, 0.25), a, b), vec3.project_edge(a, a, a), vec3.norm(vec3.sub(foot, a)), vec3.is_not_above(c, a, vec3.sub(b, a), normal), vec3.normalize(zero).x, vec3.norm(vec3.normalize(b)), vec3.dot(vec3.cross(a, b), a)
    ).first()
    assert got[0] == pytest.approx(0.25) and got[1] is None and got[2] == pytest.approx(0, abs=1e-12) and not got[3] and got[4] is None and got[5] == pytest.approx(1) and got[6] == pytest.approx(0)


def test_touching_boxes_and_thin_gaussians(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "vid bigint, vx0 double, vy0 double, vz0 double, vx1 double, vy1 double, vz1 double")
    rows = [(1, 0.5, 0.5, 0.5, 0.2, 0.2, 0.2), (2, 0.5, 0.5, 0.5, 0.2, 0.2, 0.001), (3, 2.0, 0.5, 0.5, 1.0, 0.5, 0.5)]
    raw = spark.createDataFrame([(i, *p[:3], 1.0, 0.0, 0.0, 0.0, *p[3:], 1.0, 0.0, 0.0, 1.0) for i, *p in rows], RAW)
    g = bounds.gaussian_bounds(raw, 20, 1.0)
    assert {r.gid for r in voxels.voxel_pairs(v, g, 1.0).collect()} == {1}
    assert {r.gid for r in voxels.voxel_pairs(v, g, 1.0, ar_threshold=0, p_threshold=0).collect()} == {1, 2, 3}
    mask = masks.hit_mask(v, voxels.voxel_pairs(v, g, 1.0), "vid")
    assert tuple(masks.hit_count(mask).first()) == (1, 1)
    assert predicates.cube_edges(vec3.vec("vx0", "vy0", "vz0"), F.lit(1.0))[0][1] == 0


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.0049, 0.01, 0.999, 1.0, 7.0)], "density double")
    assert {(r.bin, r.n_rows) for r in masks.density_histogram(df).collect()} == {(0, 3), (1, 1), (99, 3)}


def test_stream_of_segments(spark, tmp_path):
    from splatframe.streaming import match_batches

    g = spark.createDataFrame([(7, 0.0, 0.0, 0.0, *UNIT, 1.0)], "gid bigint, mx double, my double, mz double, c0 double, c1 double, c2 double, c3 double, c4 double, c5 double, opacity double").cache()
    ddl = "eid bigint, ax double, ay double, az double, bx double, by double, bz double"
    spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(SEGMENTS)], ddl).write.parquet(f"{tmp_path}/in")
    seen = []
    query = match_batches(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), lambda e: edges.edge_pairs(e, g, 1.0), lambda df, n: seen.extend(r.eid for r in df.collect()))
    run = query.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert set(seen) == {0, 2, 7}


def test_above_an_edge_within_its_plane(spark):
    x, z = (vec3.Vec3(*(F.lit(float(v)) for v in p)) for p in ((2, 0, 0), (0, 0, 3)))
    start = vec3.Vec3(*(F.lit(float(v)) for v in (1, 1, 5)))
    rows = spark.createDataFrame([(0.0, 0.5), (9.0, 1.0), (-4.0, 1.5)], "x double, y double")
    got = rows.select(vec3.is_not_above(vec3.Vec3(F.col("x"), F.col("y"), F.lit(5.0)), start, x, z)).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_few_candidates_for_each_overlap(spark):
    rng = np.random.default_rng(2)
    mid, half = rng.uniform(-1, 1, (600, 3)), rng.uniform(0.01, 0.35, (600, 1))
    rows = np.hstack([mid - half, mid + half])
    a = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "gid bigint, " + ", ".join(f"{c} double" for c in sum(schema.BOX, ())))
    v = grids.voxel_grid(spark, 16)
    met = broadphase.candidates(a, schema.BOX, v, schema.VOXEL).count()
    assert met < 2 * broadphase.overlap_join(a, schema.BOX, v, schema.VOXEL).count() < 600 * 4096 / 20


def test_dense_ids_whatever_the_first_key(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b)) for a, b in {(int(x > 40) * 7, int(x)) for x in rng.integers(0, 2000, 1500)}]
    got = grids.dense_ids(spark.createDataFrame(rows, "a double, b double").repartition(5), "id", ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.id)] == sorted(rows) and sorted(r.id for r in got) == list(range(len(rows)))


def test_knn_starts_small_where_points_are_clustered(spark):
    rng = np.random.default_rng(11)
    pts = np.vstack([rng.normal(0, 1e-3, (3000, 3)), rng.uniform(-50, 50, (300, 3))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pid bigint, x double, y double, z double").cache()
    low = pts.min(0).tolist()
    even = (100.0**3 * 4 / 3300) ** (1 / 3) / 2
    size = knn.start_size(points, low, even, 4)
    fill = lambda s: sum(n * n for n in np.unique(np.floor((pts - low) / s), axis=0, return_counts=True)[1].tolist()) / len(pts)
    assert fill(even) > 1000 and fill(size) <= knn.FILL * 4 and size < even / 100
    asks = [(i, *map(float, p)) for i, p in enumerate(pts[::300])]
    got = sorted((r.qid, r["rank"], r.pid) for r in knn.knn_join(points, spark.createDataFrame(asks, "qid bigint, x double, y double, z double"), 3).collect())
    assert got == sorted(w[:3] for w in nearest([(i, *map(float, p)) for i, p in enumerate(pts)], asks, 3))


def test_drawn_rows(spark, scene):
    from splatframe.operators import drawing

    raw = spark.createDataFrame([(0, 0.5, 0.5, 0.5, 0.5, 0.2, 0.7, 0.3, 0.1, 0.6, 0.5, 0.5, 0.5, -1.5, 2.0)], RAW)
    rows = drawing.surface_points(raw, 8, rotnorm=True).collect()
    assert len(rows) == 2500
    box = scene[0].first()
    for a in "xyz":
        values = [r[a] for r in rows]
        assert box[f"g{a}0"] - 1e-9 <= min(values) < box[f"g{a}0"] + 0.05 and box[f"g{a}1"] - 0.05 < max(values) <= box[f"g{a}1"] + 1e-9
    path = drawing.box_wireframe(scene[1].where("vid = 5")).orderBy("step").collect()
    assert len(path) == 24 and sum(r.x is None for r in path) == 6
    drawn = {frozenset([(a.x, a.y, a.z), (b.x, b.y, b.z)]) for a, b in zip(path, path[1:], strict=False) if a.x is not None and b.x is not None}
    assert drawn == {frozenset([(r.ax, r.ay, r.az), (r.bx, r["by"], r.bz)]) for r in grids.box_edges(scene[1].where("vid = 5")).collect()}
    edges_ = grids.box_edges(scene[1].where("vid = 5")).selectExpr("CAST(slot AS bigint) AS eid", "ax", "ay", "az", "bx", "by", "bz")
    assert drawing.polylines(edges_).where("step = 2 and x is null").count() == 12


def test_mask_and_list_from_one_pass(scene):
    g, v = scene
    mask, listed = masks.matches(v, voxels.voxel_pairs(v, g), "vid", 3)
    assert mask.where("hit").count() == 111 and sorted(r.vid for r in listed.collect()) == [147, 148, 149]


#: Queries on pairs of voxels and solid Gaussians.
ON_VOXEL_PAIRS = ["gs_voxel_pairs", "density_filter", "density_hist", "gs_voxel_centroids", "gs_voxel_iso_col", "gs_voxel_pairs_first", "gs_voxel_raw", "hit_count", "overlap_boxes", "voxel_misses"]


@pytest.mark.parametrize("name", ON_VOXEL_PAIRS)
def test_methods_that_the_jvm_compiles(spark, sf_dir, name):
    """Longer ones than 8,000 bytes are interpreted, unless the JVM is told otherwise."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= 8000


def test_gaussians_of_one_file_are_spread(spark):
    """A small file is one partition, and its pairs with broadcast voxels were made by one task."""
    raw = spark.createDataFrame([(i, i / 50 - 1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1, 0.5, 0.0, 0.0, 1.0) for i in range(100)], RAW).coalesce(1)
    pairs = voxels.voxel_pairs(grids.voxel_grid(spark, 8, size=0.25), bounds.gaussian_bounds(raw, 8))
    assert sum(n > 0 for n in pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1


def test_kept_pairs_are_spread(spark):
    raw = spark.createDataFrame([(i, i / 50 - 1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1, 0.5, 0.0, 0.0, 1.0) for i in range(100)], RAW).coalesce(1)
    grid = grids.voxel_grid(spark, 8, size=0.25)
    _, listed = masks.matches(grid, voxels.voxel_pairs(grid, bounds.gaussian_bounds(raw, 8)), "vid")
    assert listed.select(F.spark_partition_id().alias("n")).distinct().count() > 1


@pytest.mark.parametrize(("name", "most"), [("gs_voxel_raw", 8000), ("gs_voxel_iso_col", 8000), ("gs_voxel_centroids", 8000), ("gs_covi", 4000)])
def test_methods_with_few_arguments(spark, sf_dir, name, most):
    """The JVM's optimising compiler refuses methods with many arguments ("unsupported calling sequence"), and those of bounds were as long as the JVM compiles (8,033 bytes on a larger table)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = spark._jvm.PythonSQLUtils.explainString(catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown))) <= most
    assert max(len(a.split(",")) for a in re.findall(r"private void \w+_doConsume_\d+\(([^)]*)\)", shown)) < 50


def test_overlap_boxes_come_with_the_pairs(spark, scene):
    g, v = scene
    corners = [f"o{a}{k}" for k in (0, 1) for a in "xyz"]
    rows = lambda df: sorted(df.select("vid", "gid", *corners).collect())
    made = voxels.voxel_pairs(v, g, overlaps=True)
    assert made.columns == ["vid", "gid", *corners] and rows(made) == rows(masks.overlap_boxes(voxels.voxel_pairs(v, g), v, g))
    twice = g.union(g.withColumn("gx1", F.col("gx1") + 0.25))  # two Gaussians of one gid: a box for each pair, where a join by gid gives more
    assert voxels.voxel_pairs(v, twice, overlaps=True).count() == voxels.voxel_pairs(v, twice).count()
    assert voxels.voxel_pairs(v, g, centroids=True, overlaps=True).columns == ["vid", "gid", "cx", "cy", "cz", "density", *corners]


def test_the_query_of_overlap_boxes_joins_pairs_once(spark, sf_dir):
    plan = catalogue.QUERIES["overlap_boxes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    of_pairs = catalogue.QUERIES["gs_voxel_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == of_pairs.count("Join ")
