"""Two-pass external shuffle: a table in a seeded random order, written as shards of equal row counts.

Pass one scatters the records uniformly into buckets that fit in memory, by a seeded hash of their id
and text, and writes them with their bucket. Pass two brings each bucket together, puts it into a canonical order, applies a seeded Fisher-Yates shuffle, and writes it. The buckets one after
another are the shuffled order; shard *s* of *n* holds positions ``[s * N / n, (s + 1) * N / n)`` of it, so counts differ by one
at most. Where a bucket starts is a running sum over the buckets' counts, which travels with its rows; the driver gets totals only.

Records that are equal in id and text have one hash. Where they are very many, their place in the input scatters them as well; they are alike, so that doesn't
change what a shard holds but for which of them it is. Their hashes, the only thing that is broadcast, are at most ``PART``.

Both passes are functions of seed and data, and pass two reads what pass one wrote: a lost task writes the same bucket again.

Defined results: a null text has size 1. Records with a null id scatter by their text. Equal records are neighbours in the canonical order, so the result doesn't
depend on the order of arrival. An empty table gives empty shards. Other columns are written with their record, whatever their names; only columns
named shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import cut, new_folder, quoted, remove_folder, running, whole_row, write_between

SHARDS = 16
BUCKET_BYTES = 16 << 20
#: Equal records scatter by their place too if there are more of them than this and than one in ``PART`` of all.
EQUAL, PART = 1024, 10_000
SEED = 20


def sizes(text: Column) -> Column:
    """UTF-8 bytes and one more (null: none and one)."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of ``range(n)``: from the end on, each place swaps with one chosen among those up to it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    with_ = rng.integers(0, np.arange(n, 0, -1)).tolist()
    for i, j in zip(range(n - 1, 0, -1), with_, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def write_shards(df: DataFrame, folder: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes *df* (doc_id, text and any others) to *folder* as Parquet under ``shard=``; returns it as read back.

    Added columns: shard and slot (gapless from 0 in each shard).
    """
    if not 1 <= shards:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    kept = df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() not in ("shard", "slot")))
    mark = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1))
    hashed = F.xxhash64(F.lit(seed), "doc_id", mark)
    equal = cut(df.select(hashed.alias("hash"), sizes(F.col("text")).alias("size")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    total, rows = equal.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))

    # Pass one.
    many = equal.where(F.col("n") > max(EQUAL, rows // PART)).select(F.col("hash").alias("many"))
    place = F.when(F.col("many").isNotNull(), F.xxhash64("hash", F.monotonically_increasing_id())).otherwise(F.col("hash"))
    scattered = kept.select(whole_row(kept).alias("row"), hashed.alias("hash"), mark.alias("mark")).join(F.broadcast(many), F.col("hash") == F.col("many"), "left")  # at most PART rows
    scattered = scattered.select(F.pmod(place, F.lit(buckets)).alias("bucket"), "mark", "row")
    between, schema = new_folder(spark, "scattered"), scattered.schema
    write_between(scattered, between)
    scattered = spark.read.schema(schema).parquet(between)

    # Pass two: the first row of each bucket says where it starts.
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = running(counts, [F.col("bucket")], {"first": F.col("n")}).select("bucket", "first")
    both = scattered.unionByName(firsts, allowMissingColumns=True)

    def shuffle(batches):
        held: list[pa.RecordBatch] = []
        bucket = start = None

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            order = fisher_yates(table.num_rows, [seed, bucket])
            at = start + np.arange(table.num_rows)
            shard = ((at + 1) * shards - 1) // max(1, rows)
            slot = at - shard * rows // shards
            for begin in range(0, table.num_rows, 1024):
                part = table.take(pa.array(order[begin : begin + 1024]))
                part = part.append_column("shard", pa.array(shard[begin : begin + 1024], pa.int32())).append_column("slot", pa.array(slot[begin : begin + 1024], pa.int64()))
                yield from part.combine_chunks().to_batches()

        for batch in batches:
            first = batch.column("first")
            heads = np.flatnonzero(first.is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip([-1, *heads.tolist()], [*heads.tolist(), batch.num_rows], strict=True):
                if a >= 0:
                    if held:
                        yield from done()
                    bucket, start = batch.column("bucket")[a].as_py(), first[a].as_py()
                if b > a + 1:
                    held.append(batch.select(["row"]).slice(a + 1, b - a - 1))
        if held:
            yield from done()

    row = schema["row"]
    made = StructType([row, StructField("shard", IntegerType()), StructField("slot", LongType())])
    (
        both.repartition("bucket")
        .sortWithinPartitions("bucket", F.col("first").asc_nulls_last(), "row.doc_id", "mark", "row.text")
        .select("bucket", "first", "row")
        .mapInArrow(shuffle, made)
        .select("row.*", "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(folder)
    )
    remove_folder(spark, between)
    schema = StructType([*row.dataType.fields, *made.fields[1:]])
    return spark.read.schema(schema).parquet(folder).select(*(F.col(quoted(f.name)) for f in schema.fields)) if rows else spark.createDataFrame([], schema)


def shard_documents(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row, as read back from the shards written: doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null)."""
    stored = write_shards(documents.select("doc_id", "text"), new_folder(documents.sparkSession, "shards"), shards, seed=seed)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return stored.select("doc_id", sizes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
