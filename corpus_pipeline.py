"""A training corpus from raw documents: toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splatframe.llm import mixing, packing, simhash, toxicity
from splatframe.llm.common import folders, new_folder, read_table, remove_others


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The model learns from the labels that aren't held out, on *docs*. Rows with a null id are scored and judged like others."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), lambda c: ~toxicity.held_out(c))
    return toxicity.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least id; documents without an id come last."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in the order of shard and position; a source's last one may be taken in part."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: SQL can express none of the stages: each learns, hashes with XXH64, draws, or tokenises.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again. What a stage and those before it wrote is removed once it is written itself."""
    docs, before = read_table(spark, sf_dir, "documents"), folders()
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        remove_others(spark, before, folder)
        docs = spark.read.parquet(folder)
    return docs
