"""Large files read in parts: byte ranges of one file go to many tasks, and lines keep their numbers.

A line belongs to the range in which it begins. Every range is read twice: once to count its lines and to see whether
they are UTF-8, which gives each range the number of its first line, and once for the lines themselves. So no line is
shuffled, and a task holds one block of a range and a batch of lines, whatever the size of the file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.predicates import binary_content
from .files import as_uri
from .written import dealt_by_task, shared_out, written

#: Bytes of a range, and of a block that a task holds. A longer line is held as a whole.
RANGE, BLOCK, HEAD = 8 << 20, 1 << 20, 512
#: Lines that a task gives out at a time, unless a block has more.
BATCH_LINES = 10_000


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, part, start, stop) of the byte ranges of files (path, length); an empty file has one, of no bytes."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    return files.select("path", "length", F.posexplode(starts).alias("part", "start")).select("path", "part", "start", F.least("length", F.col("start") + size).alias("stop"))


class Opened:
    """The file that was opened last: consecutive ranges are mostly of one file, which is opened once for them."""

    def __init__(self, fs: pafs.FileSystem):
        self.fs, self.path, self.file = fs, None, None

    def blocks(self, path: str, start: int, stop: int, size: int = BLOCK) -> Iterator[bytes]:
        if path != self.path:
            self.close()
            self.file, self.path = self.fs.open_input_file(path), path
        return blocks_of(self.file, start, stop, size)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None


def blocks(fs: pafs.FileSystem, path: str, start: int, stop: int, size: int = BLOCK) -> Iterator[bytes]:
    """blocks_of() a file that is opened for this range alone."""
    with fs.open_input_file(path) as f:
        yield from blocks_of(f, start, stop, size)


def blocks_of(f: pa.NativeFile, start: int, stop: int, size: int = BLOCK) -> Iterator[bytes]:
    """The lines of a file that begin from start on and before stop, whole, some at a time."""
    at = max(start - 1, 0)
    # a short range needs no more than its bytes and the rest of its last line
    size = min(size, stop - at + 2 * HEAD)
    f.seek(at)
    held = b""
    if start:
        # the line that goes on over the start is the range's before; a line feed just before the start ends it
        while (end := held.find(b"\n")) < 0:
            at += len(held)
            held = f.read(size)
            if not held or at >= stop:
                return
        held, at = held[end + 1 :], at + end + 1
    # held: what has been read and not yet given out; it begins at `at`, where a line does
    while at < stop:
        more = f.read(size)
        held += more
        # of the lines that begin before stop, those that end in what is held
        last = held.rfind(b"\n") if len(held) <= stop - at else held.find(b"\n", stop - at - 1)
        if last < 0 and len(held) > stop - at and more:
            continue
        end = last + 1 if last >= 0 else 0 if more else len(held)
        if not more and len(held) <= stop - at:
            end = len(held)
        if end:
            yield held[:end]
            held, at = held[end:], at + end
        elif not more:
            return


def counted(parts: DataFrame, root: str) -> DataFrame:
    """ranges() plus lines (how many begin there), bad (some are not UTF-8, or cannot be read) and head (the file's first bytes, of part 0). Written."""
    uri = as_uri(root)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opened(pafs.FileSystem.from_uri(uri)[0])
        for batch in batches:
            rows = []
            for path, part, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "start", "stop")), strict=True):
                lines, bad, head = 0, False, None
                try:
                    for block in opened.blocks(path, start, stop):
                        if head is None and part == 0:
                            head = block[:HEAD]
                        lines += block.count(b"\n") + (not block.endswith(b"\n"))
                        block.decode()
                except (OSError, UnicodeDecodeError):
                    bad = True
                rows.append((path, part, start, stop, lines, bad, head))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=["path", "part", "start", "stop", "lines", "bad", "head"])

    dealt = dealt_by_task(shared_out(parts, ["path", "part"], F.col("stop") - F.col("start"), open_cost=1))
    return written(dealt.select("path", "part", "start", "stop").mapInArrow(count, "path string, part int, start long, stop long, lines long, bad boolean, head binary"))


def file_states(parts: DataFrame) -> DataFrame:
    """(path, success, is_binary) of counted() files: a file with a bad range fails as a whole, unless its first bytes look binary."""
    by_file = parts.groupBy("path").agg(F.max("bad").alias("bad"), F.max(F.when(F.col("part") == 0, F.col("head"))).alias("head"))
    binary = F.coalesce(binary_content(F.col("head")), F.lit(False))
    return by_file.select("path", (binary | ~F.col("bad")).alias("success"), binary.alias("is_binary"))


def lines_of_parts(parts: DataFrame, root: str) -> DataFrame:
    """(path, line_number, line) of counted() ranges, as functions.text.lines_of parts a whole text."""
    uri = as_uri(root)
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opened(pafs.FileSystem.from_uri(uri)[0])
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["path", "line_number", "line"])
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for path, start, stop, number in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "first")), strict=True):
                for block in opened.blocks(path, start, stop):
                    lines = [x.removesuffix("\r") for x in block.decode().removesuffix("\n").split("\n")]
                    for c, own in zip(held, ([path] * len(lines), range(number + 1, number + 1 + len(lines)), lines), strict=True):
                        c.extend(own)
                    number += len(lines)
                    size += len(block)
                    # lines of short ranges go out together
                    if size >= BLOCK or len(held[0]) >= BATCH_LINES:
                        yield taken()
                        size = 0
        if held[0]:
            yield taken()

    dealt = dealt_by_task(shared_out(numbered, ["path", "part"], F.col("stop") - F.col("start"), open_cost=1))
    return dealt.select("path", "start", "stop", "first").mapInArrow(read, "path string, line_number int, line string")
