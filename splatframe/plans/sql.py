"""SQL of the registered queries: plain nested loops over the same scenes, written apart from the operators."""

from __future__ import annotations

RAW = """raw AS (
  SELECT p_partkey AS gid,
    CAST((p_partkey * 7919) % 2003 AS DOUBLE) / 1000.0::DOUBLE - 1 AS mx, CAST((p_partkey * 104729) % 1999 AS DOUBLE) / 1000.0::DOUBLE - 1 AS my, CAST((p_partkey * 1299709) % 1997 AS DOUBLE) / 1000.0::DOUBLE - 1 AS mz,
    CAST(1 + p_partkey % 7 AS DOUBLE) AS w, CAST(p_partkey % 5 - 2 AS DOUBLE) AS x, CAST(p_partkey % 3 - 1 AS DOUBLE) AS y, CAST(p_partkey % 11 - 5 AS DOUBLE) AS z,
    CAST(1 + p_partkey % 4 AS DOUBLE) / 50.0::DOUBLE AS sx, CAST(1 + p_size % 5 AS DOUBLE) / 50.0::DOUBLE AS sy, CAST(1 + p_partkey % 6 AS DOUBLE) / 50.0::DOUBLE AS sz,
    CAST(1 + p_partkey % 9 AS DOUBLE) / 10.0::DOUBLE AS opacity, CAST(4 + p_partkey % 8 AS DOUBLE) AS iso,
    CAST(p_partkey % 7 - 3 AS DOUBLE) AS nx, CAST(p_partkey % 5 - 2 AS DOUBLE) AS ny, CAST(1 + p_partkey % 4 AS DOUBLE) AS nz
  FROM part)"""


def bounds(level: int = 8, iso: str = "11.345::DOUBLE", unit: bool = True, tol: str = "0.125::DOUBLE") -> str:
    """The CTEs from ``raw`` to ``gs``: boxes, contact points, inverse covariances."""
    q = "w / n AS w, x / n AS x, y / n AS y, z / n AS z" if unit else "w AS w, x AS x, y AS y, z AS z"
    floor = f"({tol} * 2 / {2.0**level}::DOUBLE)"
    return f"""{RAW},
turned AS (SELECT * REPLACE ({q}), greatest(sx, {floor}) AS tx, greatest(sy, {floor}) AS ty, greatest(sz, {floor}) AS tz, {iso} AS lv FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM raw)),
mat AS (SELECT *,
  (1 - 2 * (y * y + z * z)) / tx AS a0, (2 * (x * y - w * z)) / ty AS a1, (2 * (x * z + w * y)) / tz AS a2,
  (2 * (x * y + w * z)) / tx AS b0, (1 - 2 * (x * x + z * z)) / ty AS b1, (2 * (y * z - w * x)) / tz AS b2,
  (2 * (x * z - w * y)) / tx AS d0, (2 * (y * z + w * x)) / ty AS d1, (1 - 2 * (x * x + y * y)) / tz AS d2 FROM turned),
inv AS (SELECT *, a0 * a0 + a1 * a1 + a2 * a2 AS c0, a0 * b0 + a1 * b1 + a2 * b2 AS c1, a0 * d0 + a1 * d1 + a2 * d2 AS c2,
  b0 * b0 + b1 * b1 + b2 * b2 AS c3, b0 * d0 + b1 * d1 + b2 * d2 AS c4, d0 * d0 + d1 * d1 + d2 * d2 AS c5 FROM mat),
cof AS (SELECT *, c3 * c5 - c4 * c4 AS h0, c2 * c4 - c1 * c5 AS h1, c1 * c4 - c2 * c3 AS h2, c0 * c5 - c2 * c2 AS h3, c1 * c2 - c0 * c4 AS h4, c0 * c3 - c1 * c1 AS h5, tx * ty * tz AS det FROM inv),
con AS (SELECT *, det * sqrt(lv / h0) * h0 AS p0x, det * sqrt(lv / h0) * h1 AS p0y, det * sqrt(lv / h0) * h2 AS p0z,
  det * sqrt(lv / h3) * h1 AS p1x, det * sqrt(lv / h3) * h3 AS p1y, det * sqrt(lv / h3) * h4 AS p1z,
  det * sqrt(lv / h5) * h2 AS p2x, det * sqrt(lv / h5) * h4 AS p2y, det * sqrt(lv / h5) * h5 AS p2z FROM cof),
gs AS (SELECT *, mx - greatest(abs(p0x), abs(p1x), abs(p2x)) AS gx0, my - greatest(abs(p0y), abs(p1y), abs(p2y)) AS gy0, mz - greatest(abs(p0z), abs(p1z), abs(p2z)) AS gz0,
  mx + greatest(abs(p0x), abs(p1x), abs(p2x)) AS gx1, my + greatest(abs(p0y), abs(p1y), abs(p2y)) AS gy1, mz + greatest(abs(p0z), abs(p1z), abs(p2z)) AS gz1 FROM con)"""


VOXELS = """vox AS (SELECT id AS vid, -1 + 0.125::DOUBLE * (id % 16) AS vx0, -1 + 0.125::DOUBLE * (id // 16 % 16) AS vy0, -1 + 0.125::DOUBLE * (id // 256) AS vz0,
  -1 + 0.125::DOUBLE * (id % 16 + 1) AS vx1, -1 + 0.125::DOUBLE * (id // 16 % 16 + 1) AS vy1, -1 + 0.125::DOUBLE * (id // 256 + 1) AS vz1 FROM range(4096) t(id))"""


def _slot_ends() -> list[tuple[int, str, str]]:
    """Slot, start and end of a box's edges, in the order that box_edges has."""
    out = []
    for axis in range(3):
        j, k = [n for n in range(3) if n != axis]
        for n in range(4):
            side = {j: n & 1, k: n >> 1}
            ends = [", ".join(f"v{'xyz'[m]}{end if m == axis else side[m]}" for m in range(3)) for end in (0, 1)]
            out.append((4 * axis + n, *ends))
    return out


BOX_EDGES = "boxed AS (" + "\n  UNION ALL ".join(f"SELECT vid, {s} AS slot, {a}, {b} FROM vox" for s, a, b in _slot_ends()).replace(
    "vid, 0 AS slot, vx0, vy0, vz0, vx1, vy0, vz0", "vid, 0 AS slot, vx0 AS ax, vy0 AS ay, vz0 AS az, vx1 AS bx, vy0 AS by_, vz0 AS bz"
) + ")"
EDGES = f"""{VOXELS},
{BOX_EDGES},
edge AS (SELECT row_number() OVER (ORDER BY ax, ay, az, bx, by_, bz) - 1 AS eid, * FROM (SELECT DISTINCT ax, ay, az, bx, by_, bz FROM boxed))"""


def quadratic(p: tuple[str, str, str], d: tuple[str, str, str]) -> tuple[str, str, str]:
    """Coefficients along p + t d, for the segment test."""
    (px, py, pz), (dx, dy, dz) = p, d
    cd = f"(c0 * {dx} + c1 * {dy} + c2 * {dz})", f"(c1 * {dx} + c3 * {dy} + c4 * {dz})", f"(c2 * {dx} + c4 * {dy} + c5 * {dz})"
    cp = f"(c0 * {px} + c1 * {py} + c2 * {pz})", f"(c1 * {px} + c3 * {py} + c4 * {pz})", f"(c2 * {px} + c4 * {py} + c5 * {pz})"
    return (
        f"({dx} * {cd[0]} + {dy} * {cd[1]} + {dz} * {cd[2]})",
        f"(2 * ({px} * {cd[0]} + {py} * {cd[1]} + {pz} * {cd[2]}))",
        f"({px} * {cp[0]} + {py} * {cp[1]} + {pz} * {cp[2]} - lv)",
    )


ENTER = "(-b / (2 * a) - sqrt(greatest(b * b - 4 * a * c, 0)) / (2 * a))"
LEAVE = "(-b / (2 * a) + sqrt(greatest(b * b - 4 * a * c, 0)) / (2 * a))"
SOLID = f"(b * b - 4 * a * c > 0 AND {ENTER} < 1 AND {LEAVE} > 0)"
M2 = "(c0 * {x} * {x} + c3 * {y} * {y} + c5 * {z} * {z} + 2 * (c1 * {x} * {y} + c2 * {x} * {z} + c4 * {y} * {z}))"


def density(x: str, y: str, z: str, opacity: str = "opacity") -> str:
    m2 = M2.format(x=x, y=y, z=z)
    return f"(CASE WHEN -0.5 * {m2} > 0 OR -0.5 * {m2} < -15 THEN 0 ELSE {opacity} * exp(-0.5 * {m2}) END)"


CUBE = []
for _hi, _lo in (("0", "0"), ("0", "vs"), ("vs", "0"), ("vs", "vs")):
    CUBE += [(("{x}", "({y} + " + _hi + ")", "({z} + " + _lo + ")"), 0), (("({x} + " + _hi + ")", "{y}", "({z} + " + _lo + ")"), 1), (("({x} + " + _hi + ")", "({y} + " + _lo + ")", "{z}"), 2)]


def _cube_edge(start: tuple[str, str, str], axis: int, at: tuple[str, str, str]):
    return tuple(s.format(x=at[0], y=at[1], z=at[2]) for s in start), tuple("vs" if i == axis else "0::DOUBLE" for i in range(3))


def _edge_hit(start, axis) -> str:
    s, d = _cube_edge(start, axis, ("rx", "ry", "rz"))
    a, b, c = quadratic(s, d)
    return f"(SELECT {SOLID} FROM (SELECT {a} AS a, {b} AS b, {c} AS c))"


def _faces() -> str:
    tests = []
    for i, ax in enumerate("xyz"):
        j, k = [n for n in "xyz" if n != ax]
        for shift in ("0", "vs"):
            t = f"((p{i}{ax} - (r{ax} + {shift})) / nullif(2 * p{i}{ax}, 0))"
            inside = " AND ".join(f"r{n} <= (1 - 2 * {t}) * p{i}{n} AND (1 - 2 * {t}) * p{i}{n} <= r{n} + vs" for n in (j, k))
            tests.append(f"coalesce({t} >= 0 AND {t} <= 1 AND {inside}, false)")
    return "(" + " OR ".join(tests) + ")"


OVERLAP = "gx0 <= vx1 AND vx0 <= gx1 AND gy0 <= vy1 AND vy0 <= gy1 AND gz0 <= vz1 AND vz0 <= gz1"
_INSIDE = "(vx0 <= gx0 AND gx1 <= vx1 AND vy0 <= gy0 AND gy1 <= vy1 AND vz0 <= gz0 AND gz1 <= vz1)"


def voxel_pairs(ar: float = 0.1, pen: float = 0.1, **kw) -> str:
    """CTEs up to ``pair``: voxel and Gaussian pairs with overlap box and density at its middle."""
    return f"""{bounds(**kw)},
{VOXELS},
near AS MATERIALIZED (SELECT *, vx0 - mx AS rx, vy0 - my AS ry, vz0 - mz AS rz, vx1 - vx0 AS vs,
  greatest(gx0, vx0) AS ox0, greatest(gy0, vy0) AS oy0, greatest(gz0, vz0) AS oz0, least(gx1, vx1) AS ox1, least(gy1, vy1) AS oy1, least(gz1, vz1) AS oz1
  FROM vox JOIN gs ON {OVERLAP}),
thick AS (SELECT *, least(ox1 - ox0, oy1 - oy0, oz1 - oz0) AS lo, greatest(ox1 - ox0, oy1 - oy0, oz1 - oz0) AS hi, (ox0 + ox1) / 2 AS cx, (oy0 + oy1) / 2 AS cy, (oz0 + oz1) / 2 AS cz FROM near),
pair AS (SELECT *, {density("(cx - mx)", "(cy - my)", "(cz - mz)")} AS density FROM thick
  WHERE (CASE WHEN hi <= 1e-6 THEN 0 ELSE lo / hi END) >= {ar} AND (CASE WHEN vs <= 1e-6 THEN 0 ELSE lo / vs END) >= {pen}
  AND ({_INSIDE} OR {_faces()} OR {" OR ".join(_edge_hit(s, a) for s, a in CUBE)}))"""


def _segment_pairs(**kw) -> str:
    """CTEs up to ``met``: edge and Gaussian pairs with the quadratic's coefficients."""
    p = ("(ax - mx)", "(ay - my)", "(az - mz)")
    d = ("((bx - mx) - (ax - mx))", "((by_ - my) - (ay - my))", "((bz - mz) - (az - mz))")
    a, b, c = quadratic(p, d)
    return f"""{bounds(**kw)},
{EDGES},
reached AS (SELECT * FROM gs JOIN edge ON gx0 - 1e-6 <= greatest(ax, bx) AND least(ax, bx) <= gx1 + 1e-6 AND gy0 - 1e-6 <= greatest(ay, by_) AND least(ay, by_) <= gy1 + 1e-6 AND gz0 - 1e-6 <= greatest(az, bz) AND least(az, bz) <= gz1 + 1e-6),
met AS (SELECT * FROM (SELECT *, {a} AS a, {b} AS b, {c} AS c FROM reached) WHERE {SOLID})"""


_T = f"((greatest({ENTER}, 0) + least({LEAVE}, 1)) / 2)"
_BEST = "SELECT e.eid, g.gid IS NOT NULL AS hit, coalesce(g.gid, -1) AS gid FROM edge e LEFT JOIN (SELECT eid, gid FROM scored QUALIFY row_number() OVER (PARTITION BY eid ORDER BY density DESC, gid) = 1) g ON e.eid = g.eid"
EDGE_PAIRS = f"WITH {_segment_pairs()} SELECT eid, gid FROM met"
EDGE_MASK = f"WITH {_segment_pairs()} SELECT eid, eid IN (SELECT eid FROM met) AS hit FROM edge"
_AT = ["((a{0} - m{0}) + ((b{1} - m{0}) - (a{0} - m{0})) * t)".format(n, "y_" if n == "y" else n) for n in "xyz"]
EDGE_BEST = f"WITH {_segment_pairs()}, scored AS (SELECT eid, gid, {density(*_AT)} AS density FROM (SELECT *, {_T} AS t FROM met)) {_BEST}"


def _disc(start: tuple[str, str, str], d: tuple[str, str, str]) -> str:
    """The parameter where a segment meets the disc, or null."""
    steep = f"({d[0]} * nx + {d[1]} * ny + {d[2]} * nz)"
    t = f"(CASE WHEN abs({steep}) >= 1e-6 THEN ((mx - {start[0]}) * nx + (my - {start[1]}) * ny + (mz - {start[2]}) * nz) / {steep} END)"
    at = [f"({s} + tt * {e} - {m})" for s, e, m in zip(start, d, ("mx", "my", "mz"), strict=True)]
    return f"(SELECT CASE WHEN tt >= 0 AND tt <= 1 AND {M2.format(x=at[0], y=at[1], z=at[2])} <= lv THEN tt END FROM (SELECT {t} AS tt))"


_PAT = ["(a{0} + (b{1} - a{0}) * t - m{0})".format(n, "y_" if n == "y" else n) for n in "xyz"]
PLANAR_EDGE_BEST = f"""WITH {bounds()},
{EDGES},
reached AS (SELECT * FROM gs JOIN edge ON gx0 - 1e-6 <= greatest(ax, bx) AND least(ax, bx) <= gx1 + 1e-6 AND gy0 - 1e-6 <= greatest(ay, by_) AND least(ay, by_) <= gy1 + 1e-6 AND gz0 - 1e-6 <= greatest(az, bz) AND least(az, bz) <= gz1 + 1e-6),
scored AS (SELECT eid, gid, {density(*_PAT)} AS density FROM (SELECT *, {_disc(("ax", "ay", "az"), ("(bx - ax)", "(by_ - ay)", "(bz - az)"))} AS t FROM reached) WHERE t IS NOT NULL)
{_BEST}"""


def planar_voxels(**kw) -> str:
    """CTEs up to ``pair``: voxels that planar Gaussians cut, with the mean of the points where edges meet the disc."""
    corner = [f"((v{x} - mx) * nx + (v{y} - my) * ny + (v{z} - mz) * nz)" for z in ("z0", "z1") for y in ("y0", "y1") for x in ("x0", "x1")]
    ts, sums = [], {n: "0::DOUBLE" for n in "xyz"}
    for i, (start, axis) in enumerate(CUBE):
        s, d = _cube_edge(start, axis, ("vx0", "vy0", "vz0"))
        ts.append(f"{_disc(s, d)} AS t{i}")
        for n, a, b in zip("xyz", s, d, strict=True):
            sums[n] = f"({sums[n]} + CASE WHEN t{i} IS NOT NULL THEN {a} + t{i} * {b} ELSE 0 END)"
    count = " + ".join(f"(t{i} IS NOT NULL)::INT" for i in range(12))
    return f"""{bounds(**kw)},
{VOXELS},
near AS (SELECT *, vx1 - vx0 AS vs FROM vox JOIN gs ON {OVERLAP} WHERE greatest({", ".join(corner)}) > 0 AND least({", ".join(corner)}) <= 0),
cuts AS (SELECT *, {count} AS n_met FROM (SELECT *, {", ".join(ts)} FROM near)),
pair AS (SELECT *, {sums["x"]} / n_met AS cx, {sums["y"]} / n_met AS cy, {sums["z"]} / n_met AS cz FROM cuts WHERE n_met > 0)"""


_FULL, _HALF = "6.283185307179586::DOUBLE", "3.141592653589793::DOUBLE"
SURFACE = f"""WITH {bounds()},
angled AS (SELECT *, sqrt(lv) AS r, i * ({_FULL} / 7) AS u, j * ({_HALF} / 4) AS v FROM con, range(8) a(i), range(5) b(j)),
local AS (SELECT *, r * tx * cos(u) * sin(v) AS lx, r * ty * sin(u) * sin(v) AS ly, r * tz * cos(v) AS lz FROM angled)
SELECT gid, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  round(mx + (1 - 2 * (y * y + z * z)) * lx + 2 * (x * y - w * z) * ly + 2 * (x * z + w * y) * lz, 6) + 0 AS x,
  round(my + 2 * (x * y + w * z) * lx + (1 - 2 * (x * x + z * z)) * ly + 2 * (y * z - w * x) * lz, 6) + 0 AS y,
  round(mz + 2 * (x * z - w * y) * lx + 2 * (y * z + w * x) * ly + (1 - 2 * (x * x + y * y)) * lz, 6) + 0 AS z FROM local"""
OUTLINE = f"""WITH {VOXELS},
corner(c, x, y, z) AS (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)),
path AS (SELECT unnest([0, 1, 2, 3, 0, NULL, 4, 5, 6, 7, 4, NULL, 0, 4, NULL, 1, 5, NULL, 2, 6, NULL, 3, 7, NULL]) AS c, CAST(unnest(range(24)) AS INTEGER) AS step)
SELECT vid, step, CASE x WHEN 0 THEN vx0 WHEN 1 THEN vx1 END AS x, CASE y WHEN 0 THEN vy0 WHEN 1 THEN vy1 END AS y, CASE z WHEN 0 THEN vz0 WHEN 1 THEN vz1 END AS z
FROM vox, path LEFT JOIN corner USING (c)"""
POLYLINES = f"""WITH {EDGES}
SELECT eid, 0 AS step, ax AS x, ay AS y, az AS z FROM edge UNION ALL SELECT eid, 1, bx, by_, bz FROM edge UNION ALL SELECT eid, 2, NULL, NULL, NULL FROM edge"""

POINTS = "pts AS (SELECT c_custkey AS pid, CAST((c_custkey * 7919) % 2003 AS DOUBLE) / 1000.0::DOUBLE - 1 AS x, c_acctbal / 10000.0::DOUBLE AS y, CAST(c_nationkey AS DOUBLE) / 25.0::DOUBLE AS z FROM customer)"
ASKED = "ask AS (SELECT s_suppkey AS qid, CAST((s_suppkey * 104729) % 2003 AS DOUBLE) / 1000.0::DOUBLE - 1 AS x, s_acctbal / 10000.0::DOUBLE AS y, CAST(s_nationkey AS DOUBLE) / 25.0::DOUBLE AS z FROM supplier)"
EMBEDDED = "pts AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), ask AS (SELECT pid AS qid, x, y, z FROM pts)"


# The line from (-1, 0.25, 0) to (1, 0.5, 0.5), and the plane through (0, 0, 0.25), (1, 0, 0.5) and (0, 1, 0.75), whose normal is (-0.25, -0.5, 1).
VECTORS = f"""WITH {POINTS},
t AS (SELECT *, ((x + 1) * 2 + (y - 0.25::DOUBLE) * 0.25::DOUBLE + z * 0.5::DOUBLE) / 4.3125::DOUBLE AS t, (-0.25::DOUBLE * x - 0.5::DOUBLE * y + z - 0.25::DOUBLE) / 1.3125::DOUBLE AS h, sqrt(x * x + y * y + z * z) AS n FROM pts),
foot AS (SELECT *, x + 0.25::DOUBLE * h AS fx, y + 0.5::DOUBLE * h AS fy, z - h AS fz FROM t)
SELECT pid, round(t, 9) + 0 AS t, round(fx, 9) + 0 AS fx, round(fy, 9) + 0 AS fy, round(fz, 9) + 0 AS fz, round(y * 0.5::DOUBLE - z * 0.25::DOUBLE, 9) + 0 AS cross_x, round(n, 9) AS length, round(x / n, 9) + 0 AS unit_x,
  x * -0.125::DOUBLE + y * 1.0625::DOUBLE + (z - 0.25::DOUBLE) * 0.5::DOUBLE <= 0 AS not_above FROM foot"""


def nearest(tables: str, k: int, skip: int = 0) -> str:
    return f"""WITH {tables},
d AS (SELECT qid, pid, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS dist_sq FROM ask q, pts p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist_sq, pid) AS n FROM d)
SELECT qid, CAST(n - {skip} AS INTEGER) AS rank, pid, dist_sq FROM r WHERE n > {skip} AND n <= {k + skip}"""
