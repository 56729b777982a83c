"""What the operators of this subpackage share: folders for their files, rows with any names, Arrow plumbing; and the library's own lineage functions."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..lineage import cut, quoted, running, shared_folder

__all__ = ["GAP", "WORD", "by_chunk", "by_size", "cut", "folders", "new_folder", "numbered", "quoted", "read_table", "remove_folder", "remove_others", "running", "shared_folder", "stored", "whole_row", "with_field", "write_between"]

#: A word: a run of bytes that are neither space nor tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A run between words.
GAP = r"[\x20\x09-\x0D]*"


class _Made(threading.local):
    """The folders that a thread made and didn't remove."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder, not made yet, for files that executors write for each other."""
    _MADE.paths.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE.paths[-1]


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of ``new_folder`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _MADE.paths:
        _MADE.paths.remove(folder)


def remove_others(spark: SparkSession, before: list[str], keep: str) -> None:
    """Removes the folders that this thread made since *before* (an earlier ``folders``) but *keep*."""
    for folder in [f for f in _MADE.paths if f not in before and f != keep]:
        remove_folder(spark, folder)


def folders() -> list[str]:
    """The folders that this thread made and that are there now."""
    return list(_MADE.paths)


def write_between(df: DataFrame, folder: str) -> None:
    """Writes rows that are soon read again: small row groups, so that a task holds few rows."""
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read from there."""
    folder, schema = new_folder(df.sparkSession, name), df.schema
    write_between(df, folder)
    return df.sparkSession.read.schema(schema).parquet(folder)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of *df* in one struct, so that their names don't meet an operator's own."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def numbered(df: DataFrame) -> DataFrame:
    """*df* with its columns named c0, c1, and so on, for functions that can't take all names; ``toDF`` names them again."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def with_field(df: DataFrame, name: str, kind) -> StructType:
    """The schema of *df* and one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])


def by_chunk(
    make: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1024
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that hands *make* slices of at most *rows* rows, so that what it makes stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                made = make(batch.slice(start, rows))
                if made is not None and made.num_rows:
                    yield made

    return run


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices with at most *most* bytes in a column of strings, counting 256 more a row, besides their first row's, so that what is made of one stays small."""
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 256)
        cuts = np.flatnonzero(np.diff(end // most)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start)
