"""Streams of segments against a fixed set of Gaussians.

The spatial joins keep no state, so on a stream they are stream-static joins: each micro-batch is joined like a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def match_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer, yet to be started, that hands each micro-batch to *operator* and its result, with the batch's number, to *sink*.

    Spark may hand a batch over again after a failure, so *sink* should write by batch number.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: sink(operator(batch), number))
