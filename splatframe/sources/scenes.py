"""Scenes derived from the driver's tables, and a reader for tables of one's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import spread
from ..operators.bounds import gaussian_bounds
from ..operators.grids import box_edges, unique_edges, voxel_grid
from ..schema import require

#: Level of the scale floor, and voxels along a side of the world from -1 to 1.
LEVEL, SIDE = 8, 16


def read_table(spark: SparkSession, path: str, *numbers: str) -> DataFrame:
    """A Parquet table that has the columns *numbers*, checked before anything is read."""
    df = spark.read.parquet(path)
    require(df, *numbers)
    return df


def _spread(k: Column, factor: int, modulus: int) -> Column:
    return ((k * factor) % modulus).cast("double") / F.lit(1000.0) - F.lit(1.0)


def gaussians_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("gid"),
        _spread(k, 7919, 2003).alias("mx"), _spread(k, 104729, 1999).alias("my"), _spread(k, 1299709, 1997).alias("mz"),
        d(1 + k % 7).alias("qw"), d(k % 5 - 2).alias("qx"), d(k % 3 - 1).alias("qy"), d(k % 11 - 5).alias("qz"),
        (d(1 + k % 4) / F.lit(50.0)).alias("sx"), (d(1 + size % 5) / F.lit(50.0)).alias("sy"), (d(1 + k % 6) / F.lit(50.0)).alias("sz"),
        (d(1 + k % 9) / F.lit(10.0)).alias("opacity"), d(4 + k % 8).alias("iso"),
        d(k % 7 - 3).alias("nx"), d(k % 5 - 2).alias("ny"), d(1 + k % 4).alias("nz"),
    )


def gaussians(spark: SparkSession, sf_dir: str, iso: float | str = 11.345) -> DataFrame:
    """With bounds; spread before, for a million rows are one small file, which one or two tasks would work on."""
    return gaussian_bounds(spread(gaussians_raw(spark, sf_dir), "gid"), LEVEL, iso, rotnorm=True)


def voxels(spark: SparkSession) -> DataFrame:
    return voxel_grid(spark, SIDE, size=2.0 / SIDE)


def edges(spark: SparkSession) -> DataFrame:
    return unique_edges(box_edges(voxels(spark)))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("pid"), _spread(k, 7919, 2003).alias("x"), (F.col("c_acctbal") / F.lit(10000.0)).alias("y"), (F.col("c_nationkey").cast("double") / F.lit(25.0)).alias("z"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("qid"), _spread(k, 104729, 2003).alias("x"), (F.col("s_acctbal") / F.lit(10000.0)).alias("y"), (F.col("s_nationkey").cast("double") / F.lit(25.0)).alias("z"))


def embed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pid"), *(e[i].cast("double").alias(a) for i, a in enumerate("xyz")))
