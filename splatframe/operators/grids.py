"""Voxel grids, box edges, and dense ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import running
from ..schema import EDGE, VOXEL, require


def voxel_grid(spark: SparkSession, n: int, low: Sequence[float] = (-1.0, -1.0, -1.0), size: float = 0.125) -> DataFrame:
    """vid (x fastest, then y, z) and the corners of ``n ** 3`` boxes from *low* on.

    Corners come from lattice numbers, so that neighbours share them to the last bit.
    """
    if n < 1 or size <= 0:
        raise ValueError("n and size must be positive")
    vid = F.col("id")
    place = (vid % n, (vid / n).cast("bigint") % n, (vid / (n * n)).cast("bigint"))
    corner = lambda i, axis: F.lit(float(low[axis])) + F.lit(float(size)) * i.cast("double")
    return spark.range(n**3).select(vid.alias("vid"), *(corner(place[k] + hi, k).alias(VOXEL[hi][k]) for hi in (0, 1) for k in range(3)))


def box_edges(voxels: DataFrame) -> DataFrame:
    """vid, slot (0 to 11: four along x, four along y, four along z) and the ends of each box's edges."""
    require(voxels, "vid", *sum(VOXEL, ()))
    at = lambda hi, k: F.col(VOXEL[hi][k]).cast("double")
    slots = []
    for axis in range(3):
        others = [k for k in range(3) if k != axis]
        for n in range(4):
            side = {others[0]: n & 1, others[1]: n >> 1}
            ends = [[at(end if k == axis else side[k], k) for k in range(3)] for end in (0, 1)]
            slots.append(F.struct(*(c.alias(name) for names, row in zip(EDGE, ends, strict=True) for name, c in zip(names, row, strict=True))))
    return voxels.select("vid", F.posexplode(F.array(*slots)).alias("slot", "e")).select("vid", "slot", "e.*")


def dense_ids(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """*df*, whose rows are distinct in *keys*, with their rank from 0 in the order of *keys*: a running count, in two levels."""
    return running(df, [F.col(k) for k in keys], {name: F.lit(1)})


def unique_edges(edges: DataFrame) -> DataFrame:
    """eid and ends of the distinct edges, numbered in the order of their six coordinates."""
    names = [*EDGE[0], *EDGE[1]]
    return dense_ids(edges.select(*names).distinct(), "eid", names).select("eid", *names)


def edge_mapping(edges: DataFrame, unique: DataFrame) -> DataFrame:
    """vid, slot and eid: which of the unique edges each box's edge is."""
    return edges.join(unique, [*EDGE[0], *EDGE[1]]).select("vid", "slot", "eid")
