"""Text columns of tables as sources of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, dealt out evenly if it has fewer partitions than there are cores.

    A small file in one row group is one task otherwise. Tables of more partitions stay as they are, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def as_files(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """(path, text): each row's text as a file. A null text is an empty file."""
    return rows.select(path.cast("string").alias("path"), F.coalesce(text, F.lit("")).alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_number from 1, line, previous): previous is the raw line before, null for the first.

    The line before comes from the file's own array, so no window and no shuffle is needed.
    """
    whole = files.select("path", lines_of(F.col("text")).alias("_lines"))
    rows = F.transform(F.col("_lines"), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line"), F.get(F.col("_lines"), i - 1).alias("previous")))
    return whole.select("path", F.inline(rows))
