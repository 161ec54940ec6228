"""Sharding by rendezvous hashing over weighted shards. Native: DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bases, lookup, ordered_table, unit


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a record key: the shard whose exponential race ends first.

    Shard s draws -ln(u) / weight with u decided by (key, s) alone. A new shard takes only the records whose race it
    wins; all others stay. A null key counts as the string "null". Shards with a weight of 0 or less get nothing.
    """
    name = F.coalesce(key.cast("string"), F.lit("null"))
    races = [F.struct((-F.ln(unit(F.concat(name, F.lit(f":{s}")))) / F.lit(float(w))).alias("t"), F.lit(int(s)).alias("s")) for s, w in sorted(weights.items()) if w > 0]
    if not races:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*races))["s"]


def even(shards: int) -> dict[int, float]:
    return dict.fromkeys(range(shards), 1.0)


def shard(docs: DataFrame, shards: Mapping[int, float] | int, key: str = "doc_id") -> DataFrame:
    """docs with a column `shard`: a narrow projection, no shuffle. A column `shard` of docs is replaced.

    Rows of one key share their shard, whatever their text; null keys share one. An empty table stays empty."""
    weights = even(shards) if isinstance(shards, int) else shards
    return docs.withColumn("shard", rendezvous(F.col(key), weights))


def slots(rows: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """rows (narrow, with `shard`; other columns of any names) plus `slot`: 0, 1, 2 ... within each shard by key (nulls
    first), then ties. A column `slot` of rows is replaced.

    The rows are written once in the order (shard, key, ties) as range-partitioned files; a slot is the row's place in
    its file plus what earlier files hold of the shard. No window runs over a shard. Rows that agree in all of these
    columns may stand in either order; a number for each row spreads them over files. Empty rows: empty result.
    """
    packed = rows.select(F.struct(*[c for c in rows.columns if c != "slot"]).alias("__row"), F.col("shard"), F.col(key).alias("_key"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)])
    packed = packed.withColumn("_spread", F.monotonically_increasing_id())
    table = ordered_table(packed, [F.col("shard"), F.col("_key").asc_nulls_first(), *[F.col(f"_tie{i}").asc_nulls_first() for i in range(len(ties))], F.col("_spread")], "slots")
    start = bases(table, ["shard"], F.count(F.lit(1)), "slots")
    placed = lookup(table, start, ["_split", "shard"], "inner")
    return placed.select("__row.*", (F.col("base") + F.col("_pos") - F.col("first")).cast("long").alias("slot"))
