"""Exact token counts of every prefix by dynamic programming; see tokens.PrefixCounter.

A text's table holds the count of each of its prefixes. Its last entry is the text's count; truncation and budget
questions are answered from it, without encoding anything again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PrefixCounter, longest_prefix, shared


def token_counts(docs: DataFrame, model: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_chars) of every whole text; null counts as empty, with no tokens.

    fit_chars: the code points of the longest prefix of at most `limit` tokens. Both counts are read from the text's
    prefix table. A narrow step: rows stay where they are, and a task holds the table of one text at a time. Repeated
    rows each get their row, null keys stay, other columns of docs may have any names, and an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(PrefixCounter, model)
        for batch in batches:
            counts, fits = [], []
            for value in batch.column("text"):
                table = counter.table(value.as_py())
                n = int(table[-1]) if len(table) else 0
                counts.append(n)
                fits.append(len(table) if n <= limit else longest_prefix(table, limit))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())], names=["key", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("key", key)


def prefix_tables(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts): for every text the exact token count of each of its prefixes, by code points; for storing.

    With it, SQL answers later questions: element_at(counts, k) is the count of the first k code points.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(PrefixCounter, model)
        for batch in batches:
            # a table has 4 bytes a code point, so rows go out one by one
            for i in range(batch.num_rows):
                table = counter.table(batch.column("text")[i].as_py())
                counts = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table.astype("i4")))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), counts], names=["key", "counts"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, counts array<int>").withColumnRenamed("key", key)
