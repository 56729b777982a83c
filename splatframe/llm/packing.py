"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenised, closed by an end id, and cut into pieces: whole windows first, then
pieces of at most ``PIECE`` ids. The pieces, in the order of a seeded hash, are dealt into groups of about ``GROUP_WINDOWS`` windows and at most ``GROUP_PIECES``
pieces, and each group is packed on its own. Whole windows are sequences as they are. Every other piece is a partial partition into *m* windows with one
of them filled; the two partial partitions of the greatest spread are merged, fullest
windows with emptiest, until one is left, whose windows are nearly equal. Where the fullest exceeds the capacity, *m* rises and the
group is packed again. A partial partition keeps its filled windows only, so a group's memory grows with its pieces, whatever *m* is.

Texts are read and tokenised once, and only piece lengths and checksums go on; groups come from a running sum over the pieces, and sequences are numbered
by one over the groups, both in two levels. Equal pieces are dealt out like others. A lost task repeats only its own group.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are packed one by one; a null doc_id is kept. An
empty table gives no rows. A capacity below 1 raises an error. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import by_size, cut, running
from .tokens import AT_ONCE, encoder, tokenizer_path

CAPACITY, END = 2048, 1
PIECE = 512
GROUP_WINDOWS, GROUP_PIECES = 256, 16384
SEED = 7
TOKENIZER = "word_bpe_49k.json"


def difference(sizes: list[int], m: int) -> np.ndarray:
    """The window (0 to m - 1) of each size, by multiway differencing into *m* windows."""
    n = len(sizes)
    if n == 0 or m == 1:
        return np.zeros(n, np.int64)
    # A partial partition: its spread, a tie-breaking number, the sums of its filled windows less the least of all its windows (ascending), and
    # the first and the last size in each of them. Sizes in a window form a chain.
    after = np.full(n, -1, np.int64)
    heap = [(-s, i, np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        _, _, x, first, last = heapq.heappop(heap)
        _, _, y, y_first, y_last = heapq.heappop(heap)
        both = max(0, len(x) + len(y) - m)  # so many of the least windows of each meet, the others stand alone
        if both:
            after[last[:both]] = y_first[:both][::-1]
            last[:both] = y_last[:both][::-1]
            x[:both] += y[:both][::-1]
        x = np.concatenate([x, y[both:]])
        order = x.argsort(kind="stable")
        x = x[order]
        if len(x) == m:
            x -= x[0]
        heapq.heappush(heap, (-int(x[-1]), node, x, np.concatenate([first, y_first[both:]])[order], np.concatenate([last, y_last[both:]])[order]))
    window = np.zeros(n, np.int64)
    at, number = heap[0][3], np.arange(len(heap[0][3]))
    while len(at):
        window[at] = number
        at, number = after[at], number[after[at] >= 0]
        at = at[at >= 0]
    return window


def pack(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none over *capacity*: differencing with as many windows as that takes."""
    if capacity < 1 or max(sizes, default=0) > capacity:
        raise ValueError("a piece is larger than the capacity")
    total = sum(sizes)
    m = max(1, -(-total // capacity))
    while True:
        window = difference(sizes, m)
        fill = np.bincount(window, sizes, minlength=m)
        over = int(fill.max(initial=0)) - capacity
        if over <= 0:
            return window
        m += max(1, over * m // capacity)


def cut_lengths(n: int, capacity: int, piece: int) -> list[int]:
    """Lengths of the pieces of *n* ids: whole windows, then pieces of at most *piece*."""
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + [piece] * (rest // piece) + ([rest % piece] if rest % piece else [])


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(documents: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, end: int = END, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of the pieces of each text; with *keep_ids* their ids as well."""
    if capacity < 1 or piece < 1:
        raise ValueError("capacity and piece must be positive")
    path, tail = path or tokenizer_path(TOKENIZER), np.array([end], "<u4").tobytes()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids = [], []
        encoded = encoder(path).encode([t or "" for t in batch.column("text").to_pylist()])
        for doc, data in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
            data, at = data + tail, 0
            n = len(data) // 4
            for length in cut_lengths(n, capacity, min(piece, capacity)):
                part = data[4 * at : 4 * (at + length)]
                rows.append((doc, at, length, zlib.crc32(part), n))
                if keep_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int64))
                at += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        if keep_ids:
            names, columns = [*names, "ids"], [*columns, pa.array(ids, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    return documents.select("doc_id", "text").mapInArrow(lambda batches: map(make, by_size(batches, "text", AT_ONCE)), _PIECES + (", ids array<bigint>" if keep_ids else ""))


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        # A canonical order, so that the order of arrival doesn't matter.
        keys = [(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        table = table.sort_by(keys)
        lengths = table.column("length").to_numpy()
        window = np.empty(len(lengths), np.int64)
        whole = lengths == capacity
        window[~whole] = pack(lengths[~whole].tolist(), capacity)
        used, window[~whole] = np.unique(window[~whole], return_inverse=True)
        window[whole] = len(used) + np.arange(whole.sum())
        order = np.argsort(window, kind="stable")
        table, window, lengths = table.take(pa.array(order)), window[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        first = np.r_[True, window[1:] != window[:-1]]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        return table.append_column("window", pa.array(window)).append_column("offset", pa.array(offset))

    return run


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, seed: int = SEED, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """*rows* (as of ``pieces``) with sequence_id and offset, its place there.

    Equal rows (copies of a document with the same id) may fall into one group; its pieces are then packed together.
    """
    names = rows.columns
    rows = cut(rows)
    room = group_windows * capacity
    share = F.col("length") + -(-room // group_pieces)  # of a group, which bounds its ids and its pieces
    order = [F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), *(F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), F.monotonically_increasing_id()]
    dealt = running(rows, order, {"before": share}).withColumn("group", F.floor(F.col("before") / room)).drop("before")
    schema = StructType([*dealt.schema.fields, StructField("window", LongType()), StructField("offset", LongType())])
    packed = cut(dealt.groupBy("group").applyInArrow(_pack_group(capacity), schema))
    counts = packed.groupBy(F.col("group").alias("of")).agg((F.max("window") + 1).alias("windows"))
    out = packed.join(running(counts, [F.col("of")], {"first": F.col("windows")}), F.col("group") == F.col("of"))
    return out.select(*names, (F.col("first") + F.col("window")).cast("bigint").alias("sequence_id"), "offset")


def packed_documents(documents: DataFrame) -> DataFrame:
    """The pieces of every document, packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_pieces(pieces(documents))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """The sequences themselves, of pieces with ids: sequence_id, ids (*capacity* of them, padded), n_ids."""
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    rows = packed.groupBy("sequence_id").agg(ids.alias("ids")).withColumn("n_ids", F.size("ids"))
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad).cast("bigint"), (F.lit(capacity) - F.col("n_ids")).cast("int"))).alias("ids"), "n_ids")
