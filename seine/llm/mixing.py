"""Mixing sources to target weights by Efraimidis-Spirakis sampling within each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bases, blank_words, cut, lookup, ordered_table, unit


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) plus `target`: each source's share of `share` times all sizes.

    Sources in code point order, null last, have the weights in turn. No target exceeds cap times its source's size;
    what that frees goes to the others by weight, until none is above. In closed form: in the order of size by weight,
    sources are full as long as the level that the rest would share lies above them. The table has a row a source, so
    its windows are small whatever the corpus.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything) * F.lit(share),
            "full": F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(cap),
            "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    own = (F.col("total") - F.col("full")) / F.col("rest")
    rows = rows.withColumn("own", F.when(own * F.col("weight") < F.col("source_size") * F.lit(cap), own))
    level = F.first("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    most = F.col("source_size") * F.lit(cap)
    return rows.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(most, F.col("level") * F.col("weight")), most).alias("target"))


def quality_weight(text: Column) -> Column:
    """A document's weight in the sampling, from its whole text: the squared share of characters that are no symbols, times
    the root of the share of different words among its words; 0.01 at least.

    So symbol soup and repetition weigh little, and prose less the longer it is, as its words repeat. Null and empty texts,
    and texts without words, weigh 0.01.
    """
    whole, words = F.coalesce(text, F.lit("")), blank_words(text)
    kept = F.char_length(F.translate(whole, "#*$%&|<>", "")) / F.greatest(F.char_length(whole), F.lit(1))
    varied = F.sqrt(F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(0.0)))
    return F.greatest(kept * kept * varied, F.lit(0.01))


def mix(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", ties: Sequence[str] = ()) -> DataFrame:
    """What the mix takes of each row of (doc_id, source, size, weight, and any more columns, of any names).

    Adds source_size, target and taken, in place of columns of these names, and drops weight. A source's target is met by
    complete epochs, each of all its rows, then by a fraction of one more: rows in the order of their exponential keys
    -ln(u) / weight, where u is decided by seed and doc_id, as long as the words before them are below what is left; the
    row that crosses that mark gives only the words up to it. So taken sums to the target, rounded down. Rows of size 0
    or null take 0; null ids and sources are values like any other; an empty table gives an empty one. Reruns agree:
    rows of one id are ordered by size, then by the columns `ties`; rows that agree in all of these may change places.

    The order is that of range-partitioned files over (source, key), so a source of any size spreads over many; the
    words before a row are those of earlier files plus those before it in its own file.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    own = [c for c in rows.columns if c not in ("weight", "source_size", "target", "taken")]
    size = F.coalesce("size", F.lit(0)).cast("long")
    made = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": size, "_key": -F.ln(unit(name)) / F.col("weight")} | {f"_tie{i}": F.col(t) for i, t in enumerate(ties)}
    keyed = rows.select(F.struct(*[size.alias(c) if c == "size" else F.col(c) for c in own]).alias("__row"), *[c.alias(n) for n, c in made.items()])
    keyed = cut(keyed.withColumn("_spread", F.monotonically_increasing_id()), "mix-keys")
    totals = keyed.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = cut(source_targets(totals, weights, share, cap), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("size"), *[F.col(f"_tie{i}").asc_nulls_first() for i in range(len(ties))], F.col("_spread")]
    table = ordered_table(keyed, order, "mix")
    start = bases(table, ["source"], F.sum("size"), "mix")
    inside = Window.partitionBy("_split", "source").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = lookup(lookup(table, start, ["_split", "source"], "inner"), targets, ["source"], "inner")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("base") - F.col("_inside")))
    return placed.select("__row.*", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))
