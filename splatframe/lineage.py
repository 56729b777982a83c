"""Binding columns, sums along an order, and cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made, set as the checkpoint folder, and removed when Python ends; that is for tests
    on one machine, so it raises an error unless the master is local.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="splatframe-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir().rsplit("/", 1)[0]


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def running(rows: DataFrame, order: Sequence[Column], amounts: dict[str, Column]) -> DataFrame:
    """*rows* with, for each name in *amounts*, the sum of that integer amount over all rows before in *order*.

    In two levels, so that no task holds all rows: *rows* are dealt into ranges of *order*, summed by range, and the ranges' sums (a row each,
    as many as shuffle partitions) are added up. Rows that are equal in *order* share a range, so it should end with a column that tells them apart.
    """
    named = {n: f"_run_{k}" for k, n in enumerate(amounts)}
    keys = {f"_run_by_{k}": c for k, c in enumerate(order)}
    by = [F.col(k).asc_nulls_first() for k in keys]
    ranged = rows.select("*", *(c.alias(k) for k, c in keys.items()), *(c.cast("bigint").alias(named[n]) for n, c in amounts.items()))
    ranged = cut(ranged.repartitionByRange(*by).withColumn("_run_part", F.spark_partition_id()))
    per = ranged.groupBy(F.col("_run_part").alias("_run_of")).agg(*(F.sum(named[n]).alias(f"{named[n]}_all") for n in amounts))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_run_of").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("_run_of", *(F.coalesce(F.sum(f"{named[n]}_all").over(earlier), F.lit(0)).alias(f"{named[n]}_first") for n in amounts))
    inside = Window.partitionBy("_run_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"{named[n]}_in": F.coalesce(F.sum(named[n]).over(inside), F.lit(0)) for n in amounts})
    out = out.join(F.broadcast(first), F.col("_run_part") == F.col("_run_of"))  # a row for each range
    return out.select(*(F.col(quoted(c)) for c in rows.columns if c not in amounts), *((F.col(f"{named[n]}_first") + F.col(f"{named[n]}_in")).alias(n) for n in amounts))


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """*df* with new columns that later expressions refer to by value.

    A plain projection would be inlined into filters that Catalyst pushes through it, which multiplies expressions that build on each other; a generator of one row stops
    that, and still is compiled.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def spread(df: DataFrame, key: str) -> DataFrame:
    """*df* in as many partitions as shuffles have, by *key*: for few rows that become many, where a small file is one task and a broadcast join has no shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def never_null(names: Sequence[str]) -> list[Column]:
    """Columns without nulls, as doubles whose type says so: a filter doesn't tell that to what follows a generator, and handling nulls makes compiled methods several times as long."""
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
