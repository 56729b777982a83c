"""Exact k-nearest-neighbour join on a grid that coarsens for the queries it hasn't settled.

In a round, points lie in cells of one size, and each open query looks at its cell and the 26 around it. Its k nearest there are
final if the k-th is nearer than the border of that block, beyond which no seen point lies (sides beyond the points' bounding box
don't count). The rest go on with twice the cell size, or four times if most of them do, until a block covers all points. Queries outside the box look from the nearest cell in it.

The first size is the one that holds a few points a cell if they were spread evenly, or, where points are clustered, the largest of smaller ones whose cells are that thinly
filled for the average point. So dense regions are settled while cells are small, and only the queries of sparse ones go on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vec3 import finite
from ..lineage import cut
from ..schema import require

_AXES = ("x", "y", "z")
#: Sizes that are tried first: each a quarter of the one before.
_TRIED = 8
#: A cell may hold so many times the points needed, for the average point.
FILL = 16


def start_size(points: DataFrame, low: list[float], size: float, need: int) -> float:
    """The largest of *size* and smaller ones for which the average point shares its cell with ``FILL * need`` points or fewer."""
    at = lambda a, i: F.floor((F.col(a) - low[i]) / (size * F.pow(F.lit(0.25), F.col("n"))))
    tried = points.select(*_AXES, F.explode(F.sequence(F.lit(0), F.lit(_TRIED - 1))).alias("n")).select("n", *(at(a, i).alias(f"c{a}") for i, a in enumerate(_AXES)))
    shared = tried.groupBy("n", *(f"c{a}" for a in _AXES)).agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("n").agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("shared")).collect()  # a row a size
    thin = [r["n"] for r in shared if r["shared"] <= FILL * need]
    return size * 0.25 ** min(thin, default=_TRIED - 1)


def knn_join(points: DataFrame, queries: DataFrame, k: int = 1, exclude_self: bool = False, exclude_same_id: bool = False) -> DataFrame:
    """qid, rank (from 1), pid, dist_sq (squared distance): the *k* nearest *points* of each query, ties to the least pid.

    *exclude_self* leaves out each query's nearest point, whatever it is; *exclude_same_id* the points with the query's own id.
    Rows with a coordinate that isn't finite take no part. ``ValueError`` if there are fewer points than needed.
    """
    require(points, "pid", *_AXES)
    require(queries, "qid", *_AXES)
    if k < 1:
        raise ValueError("k must be positive")
    numbers = [F.col(a).cast("double") for a in _AXES]
    clean = lambda df, key: df.select(F.col(key), *(c.alias(a) for a, c in zip(_AXES, numbers, strict=True))).where(finite(*(F.col(a) for a in _AXES)))
    points, queries = clean(points, "pid"), clean(queries, "qid")
    stats = points.agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}_{a}") for a in _AXES for n, f in (("lo", F.min), ("hi", F.max)))).first()
    need = k + bool(exclude_self) + bool(exclude_same_id)
    if stats["n"] == 0:
        raise ValueError("there are no points")
    if need > stats["n"]:
        raise ValueError(f"{need} points are needed and there are {stats['n']}")
    # Of points in one place no more than the first ones can count.
    spot = Window.partitionBy(*_AXES).orderBy("pid")
    points = cut(points.withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= need).drop("_n"))

    low, high = [[stats[f"{n}_{a}"] for a in _AXES] for n in ("lo", "hi")]
    sides = [h - lo for lo, h in zip(low, high, strict=True)]
    longest = max(sides)
    wide = [max(s, longest / max(1, stats["n"])) for s in sides]
    size = (math.prod(wide) * need / stats["n"]) ** (1 / 3) / 2 if longest > 0 else 1.0
    size = max(size, longest / (1 << 20)) or 1.0
    if size < longest:
        size = max(start_size(points, low, size, need), longest / (1 << 40))
    open_, done, remaining = queries, None, queries.count()
    best = Window.partitionBy("qid").orderBy("dist_sq", "pid")
    while True:
        last = size >= longest
        cell = lambda c, i, size=size: F.floor((c - low[i]) / size).cast("bigint")
        held = lambda a, i: F.least(F.greatest(F.col(a), F.lit(low[i])), F.lit(high[i]))
        placed = points.select("pid", *(F.col(a).alias(f"p{a}") for a in _AXES), *(cell(F.col(a), i).alias(f"c{a}") for i, a in enumerate(_AXES)))
        asked = open_.withColumns({f"h{a}": cell(held(a, i), i) for i, a in enumerate(_AXES)})
        border = []
        for i, a in enumerate(_AXES):
            # Where the block ends inside the points' box, and how far that is.
            left, right = (F.col(f"h{a}") - 1) * size + low[i], (F.col(f"h{a}") + 2) * size + low[i]
            border.append(F.when(left > low[i], F.col(a) - left))
            border.append(F.when(right <= high[i], right - F.col(a)))
        asked = asked.withColumn("border", F.coalesce(F.least(*border), F.lit(float("inf"))))
        for a in _AXES:
            asked = asked.withColumn(f"h{a}", F.explode(F.sequence(F.col(f"h{a}") - 1, F.col(f"h{a}") + 1)))
        on = (F.col("hx") == F.col("cx")) & (F.col("hy") == F.col("cy")) & (F.col("hz") == F.col("cz"))
        d = [F.col(f"p{a}") - F.col(a) for a in _AXES]
        near = asked.join(placed, on).select("qid", *_AXES, "border", "pid", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("dist_sq"))
        near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= need)
        if last:
            found = near.select("qid", "rank", "pid", "dist_sq")
            done = found if done is None else done.unionByName(found)
            break
        near = cut(near)
        final = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("dist_sq").alias("far"), F.first("border").alias("border"))
        final = final.where((F.col("n") == need) & (F.sqrt("far") * 1.000001 < F.col("border"))).select("qid")
        found = near.join(final, "qid", "left_semi").select("qid", "rank", "pid", "dist_sq")
        done = found if done is None else done.unionByName(found)
        open_ = cut(open_.join(final, "qid", "left_anti"))
        before, remaining = remaining, open_.count()
        if not remaining:
            break
        size *= 2 if remaining < before / 2 else 4
    if exclude_self:
        done = done.where("rank > 1").withColumn("rank", F.col("rank") - 1)
    if exclude_same_id:
        done = done.where("pid <> qid").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return done.select("qid", F.col("rank").cast("int").alias("rank"), "pid", "dist_sq")
