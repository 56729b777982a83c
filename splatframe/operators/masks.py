"""What surrounds the joins: masks, splits, gathers, counts, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import overlap_box
from ..lineage import cut
from ..schema import BOX, VOXEL, box


def hit_mask(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """*key* of every row, and hit: whether it has a pair."""
    seen = pairs.select(F.col(key).alias("_key")).distinct()
    return rows.select(key).join(seen, F.col(key) == F.col("_key"), "left").select(key, F.col("_key").isNotNull().alias("hit"))


def matches(rows: DataFrame, pairs: DataFrame, key: str, max_pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mask of *rows* and the list of *pairs*, from one pass: pairs are computed once and kept. The list has the first *max_pairs* in the order of *key* and gid; the mask knows all."""
    kept = cut(pairs)
    listed = kept if max_pairs is None else kept.orderBy(key, "gid").limit(max_pairs)
    return hit_mask(rows, kept, key), listed


def hits(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    return rows.join(pairs.select(key).distinct(), key, "left_semi")


def misses(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    return rows.join(pairs.select(key).distinct(), key, "left_anti")


def hit_count(mask: DataFrame) -> DataFrame:
    """One row: n_hits and n_rows of a mask."""
    return mask.agg(F.count_if("hit").alias("n_hits"), F.count(F.lit(1)).alias("n_rows"))


def overlap_boxes(pairs: DataFrame, voxels: DataFrame, gaussians: DataFrame) -> DataFrame:
    """vid, gid and the corners ox0 to oz1 of the boxes where the two of each pair overlap."""
    rows = pairs.select("vid", "gid").join(voxels.select("vid", *sum(VOXEL, ())), "vid").join(gaussians.select("gid", *sum(BOX, ())), "gid")
    low, high = overlap_box(box(BOX), box(VOXEL))
    return rows.select("vid", "gid", *(c.alias(f"o{a}0") for a, c in zip("xyz", low, strict=True)), *(c.alias(f"o{a}1") for a, c in zip("xyz", high, strict=True)))


def density_histogram(rows: DataFrame, bins: int = 100, top: float = 1.0, column: str = "density") -> DataFrame:
    """bin and n_rows: equal bins from 0 to *top*; the last holds what is above, and values under 0 are in the first. Empty bins are left out."""
    if bins < 1 or top <= 0:
        raise ValueError("bins and top must be positive")
    place = F.greatest(F.least(F.floor(F.col(column) * (bins / top)), F.lit(bins - 1)), F.lit(0)).cast("bigint")
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def neighbour_split(points: DataFrame, neighbours: DataFrame) -> DataFrame:
    """pid and is_neighbor of all *points*: whether *neighbours* (with pid) has it."""
    return hit_mask(points, neighbours, "pid").withColumnRenamed("hit", "is_neighbor")
