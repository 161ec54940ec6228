"""What the operators of this subpackage share: written tables, ordered tables, size-checked lookups, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A lookup side of at most so many rows and bytes may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20

#: The ASCII white space that parts words: tab, line feed, vertical tab, form feed, carriage return, space.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session in local mode may lack the setting; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="seine-")
    return _local_roots[app]


_noted: list[list[str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/seine/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that operators make within the block, in order, for delete()."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted.remove(paths)


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables and files that operators of this application have written in the shared folder. Results that are not yet written or read need them."""
    delete(spark, [f"{shared_root(spark)}/seine/{spark.sparkContext.applicationId}"])


def cut(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: later stages start from files that outlive any executor."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def may_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int | None = None) -> bool:
    """Whether the written table small is within both bounds. Its bytes are those of its rows as JSON, which is more than they take in a broadcast; they are summed only if there are few rows."""
    if small.count() > max_rows:
        return False
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return size <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join big to the written table small on null-safe equality of the columns `on`.

    small is measured first. Up to max_rows and BROADCAST_BYTES it is broadcast; beyond that both sides are shuffled, and
    adaptive execution splits what a hot key of big makes large. small has one row for each key.
    """
    renamed = small.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in small.columns])
    renamed = F.broadcast(renamed) if may_broadcast(small, max_rows) else renamed.hint("merge")
    match = F.lit(True)
    for c in on:
        match = match & big[c].eqNullSafe(renamed[f"__r_{c}"])
    return big.join(renamed, match, how).drop(*[f"__r_{c}" for c in on])


def ordered_table(df: DataFrame, order: Sequence[Column], tag: str) -> DataFrame:
    """Write df in the order given, over files of about equal size, and read it with the place of each row.

    Adds _split (the file's number; files ascend in the order) and _pos (the row's place in its file). A file is a
    range of the order, and the range partitioner sees all columns of the order, so no key's rows need to share a file
    as long as the order ends in columns that tell rows apart.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    # a task writes one file, whatever the session says: places are counted within files
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    split = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return back.select("*", split.alias("_split"), F.col("_metadata.row_index").alias("_pos"))


def bases(table: DataFrame, by: Sequence[str], total: Column, tag: str) -> DataFrame:
    """For each file and group of an ordered table: `first` (its first _pos) and `base` (the total of the group in earlier files)."""
    parts = table.groupBy("_split", *by).agg(F.min("_pos").alias("first"), total.cast("long").alias("part"))
    before = Window.partitionBy(*by).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts, f"{tag}-parts")
    return cut(parts.select("_split", *by, "first", F.coalesce(F.sum("part").over(before), F.lit(0)).cast("long").alias("base")), f"{tag}-bases")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is. lower() does the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_words(text: Column) -> Column:
    """The words of a text between ASCII white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def unit(key: Column) -> Column:
    """A number in (0, 1) that only the string key decides: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[Column]:
    """The columns (key, _text_key) that name a row for joins within one operator: its id, and a hash of its text.

    Rows that agree in both are repeated rows; they always get the same result.
    """
    return [F.col(key), F.xxhash64(F.col(text), F.octet_length(text)).alias("_text_key")]


def text_key(text: Column) -> Column:
    """16 bytes that name a text: the start of its SHA-256. Null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def copy_groups(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(_key, _first, _copies) of the texts that more than one row of (key, _key) holds: their least key, their rows. Written; it combines before it shuffles, so a text that a third of all rows hold is no hot key."""
    groups = rows.groupBy("_key").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    return cut(groups.filter("_copies > 1"), "copies")


def one_of_each(rows: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, _key, ...) with each text once, that of its least key. Rows that agree in key and text all stay: a consumer skips what it has seen, as their order is the same."""
    known = lookup(rows, groups, ["_key"])
    return known.filter(F.col("_copies").isNull() | F.col(key).eqNullSafe(F.col("_first"))).drop("_first")
