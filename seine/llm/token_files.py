"""Token ids in Arrow stream files of fixed-size-list batches: zero-copy random access to equal-length sequences and masks.

A file holds the concatenated ids of its documents, cut into sequences of `length` ids; the last sequence is filled up
with zeros, and a mask tells ids from filling. Both columns are fixed-size lists, so sequence i of a mapped file is a
slice of one buffer. Every batch but the last has `batch` sequences, so an id's batch follows from its position.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lookup, new_path
from .tokens import WordEncoder, shared

LENGTH, BATCH = 2048, 256


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes ids as sequences into one file, which appears under its name only when closed."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.fs, self.path = _at(uri)
        context = TaskContext.get()
        self.temporary = f"{self.path}.{context.taskAttemptId() if context else 0}"
        self.length, self.batch, self.dtype = length, batch, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(item, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.written = 0

    def add(self, ids: bytes) -> int:
        """Append ids; returns their start in the file."""
        start = self.written + self.held_bytes // self.dtype.itemsize
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.length * self.batch * self.dtype.itemsize:
            self._flush(False)
        return start

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = self.length * self.batch
        at = 0
        while len(ids) - at >= whole:
            self._write(ids[at : at + whole], whole)
            at += whole
        rest = ids[at:]
        if last and len(rest):
            self._write(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.held, self.held_bytes = ([rest.tobytes()], rest.nbytes) if len(rest) else ([], 0)

    def _write(self, ids: np.ndarray, room: int) -> None:
        full = np.zeros(room, self.dtype)
        full[: len(ids)] = ids
        mask = np.zeros(room, bool)
        mask[: len(ids)] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.written += len(ids)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        self.fs.move(self.temporary, self.path)

    def abort(self) -> None:
        """Delete what is written; the file does not appear."""
        self.out.close()
        self.fs.delete_file(self.temporary)


class SequenceFile:
    """A written file, mapped into memory where the file system allows it."""

    def __init__(self, uri: str):
        fs, path = _at(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i: its ids, without a copy, and its mask."""
        batch = self.reader.get_batch(i // self.batch)
        row = i % self.batch
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length]
        return ids, batch.column("mask")[row].values

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids from start on. Whole sequences between are skipped; a span within one batch is not copied."""
        per = self.length * self.batch
        parts = []
        while count > 0:
            column = self.reader.get_batch(start // per).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = column[start % per : start % per + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.source.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, str]:
    """Encode every whole text (null: empty), append end_id, and write all ids in ascending order of key (null first).

    Returns the index (key, n_tokens, file, local start in it, start among all ids; a row a document) and the folder.
    Each task writes the file of its range of keys; its name is decided by the range, and a task that is run again
    replaces it by the same ids. Rows of one key may spread over ranges. Rows of one key stand in the order of a hash of
    their text, and repeated rows are documents like any other; other columns of docs may have any names. A text of any length is
    encoded whole, in a task that holds one batch of texts. An empty table makes no file and an empty index.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("spread")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_first(), F.col("hash"), F.col("spread")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(WordEncoder, tokenizer)
        part = TaskContext.get().partitionId()
        file = f"{folder}/part-{part:06d}.arrow"
        writer, end = None, np.array([end_id], encoder.dtype).tobytes()
        try:
            for batch in batches:
                writer = writer or SequenceWriter(file, encoder.dtype, length)
                ids, sizes = encoder.encode_batch(batch.column("text"))
                starts, counts, at = [], [], 0
                for n in sizes.tolist():
                    starts.append(writer.add(ids[at : at + n].tobytes() + end))
                    counts.append(n + 1)
                    at += n
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.string()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["key", "part", "file", "local", "n_tokens"])
        except BaseException:  # also where the task is killed
            if writer:
                writer.abort()
            raise
        if writer:
            writer.close()

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    index = cut(ordered.mapInArrow(run, f"key {kind.simpleString()}, part int, file string, local long, n_tokens long"), "token-index")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")), "token-offsets")
    placed = lookup(index, offsets, ["part"], "inner")
    return placed.select("key", "part", "file", "local", (F.col("base") + F.col("local")).alias("start"), "n_tokens"), folder


def read_back(index: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) read from the files that an index names.

    ids_crc32: unsigned CRC-32 of a document's ids as little-endian unsigned 32-bit integers.
    """
    kind = index.schema["key"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for batch in batches:
            sums, counts = [], []
            for file, local, n in zip(batch.column("file").to_pylist(), batch.column("local").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if file != name:
                    if opened:
                        opened.close()
                    opened, name = SequenceFile(file), file
                ids = opened.ids(local, n)
                counts.append(len(ids))
                sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4").data))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return index.select("key", "file", "local", "start", "n_tokens").mapInArrow(run, f"key {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")
