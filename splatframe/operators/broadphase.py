"""The broad phase of spatial joins: boxes that overlap meet in an equi-join on grid cells.

Every box has a level, the power of two that its longest side fits in. Two boxes meet on the finer of their levels, but at most ``FINER`` levels below the
coarser one: each is listed on all levels where it may meet boxes of the other table. So a box has a few cells, and at most ``(2 ** FINER + 1) ** 3`` of them for each level of the other table, and is compared with little
that it doesn't overlap. Cells of the left boxes take in their lower border and those of the right boxes leave out their upper one, so boxes that lie
on a lattice aren't listed in cells that they only touch, and boxes that touch still meet. A pair meets once, in the first
cell that both cover on every axis. So nothing is joined by inequality alone, and
a cell that holds many boxes is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import boxes_overlap
from ..functions.vec3 import Vec3
from ..lineage import bind
from ..schema import box

#: Levels and coordinates are held within these; what lies beyond shares the last cells, where the residual test decides.
LEAST, MOST = -30, 40
_FAR = float(1 << 41)
#: How many levels below its own a box may be listed.
FINER = 2


def _level(b: tuple[Vec3, Vec3]) -> Column:
    side = F.greatest(*(hi - lo for lo, hi in zip(*b, strict=True)))
    side = F.greatest(F.least(side, F.lit(2.0**MOST)), F.lit(2.0**LEAST))
    return F.coalesce(F.ceil(F.log2(side)).cast("int"), F.lit(LEAST))  # never null, and its type says so


def _meeting(a: Column, b: Column) -> Column:
    """The level on which boxes of these two levels meet."""
    return F.greatest(F.least(a, b), F.greatest(a, b) - FINER)


def _held(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(_FAR)), F.lit(-_FAR))


def _cells(lo: Column, hi: Column, size: Column, upper: bool) -> tuple[Column, Column]:
    """First and last cell on an axis, *size* being 1 over a cell's (a power of two, so products are exact and, unlike quotients, never null): with *upper* of ``[lo, hi)``, else of ``[lo, hi]`` and of what ends where it begins."""
    lo, hi = _held(lo) * size, _held(hi) * size
    if upper:
        return F.floor(lo).cast("bigint"), F.greatest(F.floor(lo), F.ceil(hi) - 1).cast("bigint")
    return (F.ceil(lo) - 1).cast("bigint"), F.floor(hi).cast("bigint")


def _listed(df: DataFrame, names, others: DataFrame, tag: str, upper: bool) -> DataFrame:
    """A row of *df* for each level and cell where it may meet rows whose levels are *others*' (one row with an array).

    Own columns start with ``_bp_`` and *tag*: own (level), level, first and cell by axis.
    """
    b = box(names)
    own, levels, at = (f"_bp_{tag}_{n}" for n in ("own", "levels", "level"))
    rows = bind(df, {own: _level(b)}).join(F.broadcast(others.withColumnRenamed("_bp_levels", levels)))  # a row of at most 71 levels
    rows = rows.withColumn(at, F.explode(F.array_distinct(F.transform(levels, lambda n: _meeting(F.col(own), n))))).drop(levels)
    size = F.pow(F.lit(2.0), -F.col(at).cast("double"))
    ends = {}
    for k in range(3):
        ends[f"_bp_{tag}_first{k}"], ends[f"_bp_{tag}_last{k}"] = _cells(b[0][k], b[1][k], size, upper)
    rows = bind(rows, ends)
    for k in range(3):
        rows = rows.withColumn(f"_bp_{tag}_cell{k}", F.explode(F.sequence(f"_bp_{tag}_first{k}", f"_bp_{tag}_last{k}"))).drop(f"_bp_{tag}_last{k}")
    return rows


def candidates(left: DataFrame, left_box, right: DataFrame, right_box) -> DataFrame:
    """The pairs of rows that meet in a cell, each once, whether their boxes overlap or not."""
    level_set = lambda df, names: df.select(_level(box(names)).alias("n")).agg(F.collect_set("n").alias("_bp_levels"))
    a = _listed(left, left_box, level_set(right, right_box), "a", False)
    b = _listed(right, right_box, level_set(left, left_box), "b", True)
    on = (F.col("_bp_a_level") == F.col("_bp_b_level")) & (F.col("_bp_a_level") == _meeting(F.col("_bp_a_own"), F.col("_bp_b_own")))
    for k in range(3):
        cell = F.col(f"_bp_a_cell{k}")
        on &= (cell == F.col(f"_bp_b_cell{k}")) & (cell == F.greatest(f"_bp_a_first{k}", f"_bp_b_first{k}"))
    return a.join(b, on).select(*left.columns, *right.columns)


def overlap_join(left: DataFrame, left_box, right: DataFrame, right_box) -> DataFrame:
    """Pairs of rows whose boxes overlap (closed). Columns must have distinct names; boxes are named as in ``schema``."""
    return candidates(left, left_box, right, right_box).where(boxes_overlap(box(left_box), box(right_box)))
