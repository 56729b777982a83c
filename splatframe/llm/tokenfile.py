"""Token ids in the Arrow stream-file format: batches of fixed-size lists, for zero-copy random access.

Documents in ascending order of doc_id, each closed by an end id, make one stream of ids. It is range-partitioned into files of about ``FILE_BYTES`` of
text, each an Arrow stream whose batches have two fixed-size-list columns of ``LENGTH`` values: ids (uint16, or
uint32 where the vocabulary or the end id needs it) and mask (a bit a value: 1 for an id, 0 for padding in the file's last row). A sequence of a memory-mapped file is a slice, at a
computed place. Beside it stands an index stream: doc_id, start (in the file) and n_tokens of each document.

Files are written under a temporary name and renamed, and hold what their part's rows determine, so a task that is
run again writes the same file. ``pyarrow.fs`` opens them, on any file system that it has.

Defined results: a null or empty text is the end id alone. Null ids come first; rows of one id are in the order of the first 64 characters of their text (null first), then of a
hash of the whole text, and equal rows may be spread over files. An empty table writes no file and reads
back no rows. Other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, cut, new_folder, running
from .tokens import AT_ONCE, encoder, tokenizer_path

LENGTH, END = 2048, 0
#: Sequences of a record batch.
BATCH = 256
#: UTF-8 bytes of text for a file.
FILE_BYTES = 64 << 20
TOKENIZER = "byte_bpe_50k.json"
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _store(uri: str):
    """The file system and path of *uri* (a bare path is local)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class Writer:
    """Writes ids as fixed-size lists, batch by batch, so that it holds one batch at most."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind, self.rest, self.written = length, kind, [], 0
        self.held = 0
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BATCH * self.length:
            flat = np.concatenate(self.rest)
            full = len(flat) // (BATCH * self.length) * BATCH * self.length
            for start in range(0, full, BATCH * self.length):
                self._batch(flat[start : start + BATCH * self.length], BATCH * self.length)
            self.rest, self.held = [flat[full:]], len(flat) - full

    def _batch(self, flat: np.ndarray, size: int) -> None:
        ids, mask = np.zeros(size, self.kind), np.zeros(size, bool)
        ids[: len(flat)], mask[: len(flat)] = flat, True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0, self.kind)
        if len(flat):
            self._batch(flat, -(-len(flat) // self.length) * self.length)
        self.out.close()


def write_token_files(documents: DataFrame, folder: str, length: int = LENGTH, end: int = END, path: str | None = None, wide: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes *documents* (doc_id, text) to files in *folder*; returns a row per file: part, file, n_docs, n_tokens.

    *wide*: 32-bit ids, even if all fit in 16 bits.
    """
    if length < 1 or not 0 <= end < 1 << 32:
        raise ValueError("length must be positive, and end an unsigned 32-bit integer")
    path = path or tokenizer_path(TOKENIZER)
    tail = np.array([end], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        store = files = writer = None
        part = TaskContext.get().partitionId()
        name = f"{TaskContext.get().taskAttemptId()}"
        docs = tokens = 0
        for some in by_size(batches, "text", AT_ONCE):
            if writer is None:
                kind = np.dtype("<u4" if wide or max(end, encoder(path).largest) >= 1 << 16 else "<u2")
                store, top = _store(folder)
                store.create_dir(top, recursive=True)
                files = [f"{top}/part-{part:06d}.{kind_}" for kind_ in ("tokens", "index")]
                sinks = [store.open_output_stream(f"{f}.{name}.tmp") for f in files]
                writer, index = Writer(sinks[0], length, kind), pa.ipc.new_stream(sinks[1], _INDEX)
            rows = []
            encoded = encoder(path).encode([t or "" for t in some.column("text").to_pylist()])
            for doc, data in zip(some.column("doc_id").to_pylist(), encoded, strict=True):
                ids = np.frombuffer(data + tail, "<u4")
                writer.add(ids.astype(kind))
                rows.append((doc, tokens, len(ids)))
                tokens += len(ids)
            docs += len(rows)
            index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_INDEX))
        if writer is not None:
            writer.close()
            index.close()
            for f, sink in zip(files, sinks, strict=True):
                sink.close()
                store.move(f"{f}.{name}.tmp", f)
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [f"{folder}/part-{part:06d}"], "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = {"doc_id": F.col("doc_id"), "head": F.substring("text", 1, 64), "mark": F.xxhash64("text"), "rid": F.monotonically_increasing_id()}
    rows = documents.select("text", *(c.alias(n) for n, c in order.items())).repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    return cut(rows.select("doc_id", "text").mapInArrow(write, "part int, file string, n_docs bigint, n_tokens bigint"))


def sequence(path: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence *row* of a local token file: the ids are a view of the mapped file, the mask is unpacked from a view of its bits."""
    with pa.memory_map(path) as source:
        for batch in pa.ipc.open_stream(source):
            if row < batch.num_rows:
                n = batch.schema.field("ids").type.list_size
                ids, mask = (batch.column(c).values.slice((batch.column(c).offset + row) * n, n) for c in ("ids", "mask"))
                return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)
            row -= batch.num_rows
    raise IndexError("no such sequence")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files themselves: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    *files*: as ``write_token_files`` returns; their token counts give each file's first place.
    """
    placed = running(files, [F.col("part")], {"first": F.col("n_tokens")}).select("part", "file", "first")

    def read(batches):
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, top = _store(file)
                with store.open_input_stream(f"{top}.tokens") as tokens, store.open_input_stream(f"{top}.index") as index:
                    yield from _documents(pa.ipc.open_stream(tokens), pa.ipc.open_stream(index), first)

    # A task for each file, for files are large.
    count = max(1, files.count())
    return placed.repartitionById(count, F.pmod("part", F.lit(count))).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _documents(tokens, index, first: int):
    """The index's documents, cut from the stream of ids; holds a batch and what is left of the one before."""
    held, rest = [], 0

    def more() -> None:
        nonlocal rest
        batch = tokens.read_next_batch()
        ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
        mask = batch.column("mask").values
        if mask.true_count < len(mask):
            ids = ids[mask.to_numpy(zero_copy_only=False)]
        held.append(ids)
        rest += len(ids)

    def take(n: int) -> int:
        """The checksum of the next *n* ids, as 32-bit integers."""
        nonlocal rest
        while rest < n:
            more()
        crc = 0
        while n:
            some = held[0][:n]
            crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
            held[0] = held[0][len(some) :]
            if not len(held[0]):
                held.pop(0)
            n, rest = n - len(some), rest - len(some)
        return crc

    for batch in index:
        counts = batch.column("n_tokens").to_pylist()
        crcs = [take(n) for n in counts]
        starts = first + batch.column("start").to_numpy()
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": pa.array(starts), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64())})


def token_ids(documents: DataFrame) -> DataFrame:
    """Every document's ids written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    files = write_token_files(documents, new_folder(documents.sparkSession, "tokens"))
    return read_token_files(files)
