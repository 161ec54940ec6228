"""Benchmark decontamination with a positional inverted index. Native: DataFrame functions only.

The index holds postings (term, document, position) of the training words that are among the rarest of some test
window. A window's two rarest terms give two posting lists; each list, less the term's offset in the window, is a list
of places where the window could start. The lists are intersected, and the words around the rarest term, which its
postings carry, settle what is left. The two terms near each other, in any order, are a proximity match. The training
texts themselves are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, keyed, lookup, may_broadcast

#: What parts words after lower-casing: ASCII that is neither digit nor lower-case letter.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
_GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A vocabulary or list of windows of at most so many rows may be broadcast, if its bytes allow it as well.
BROADCAST_WINDOWS = 200_000


def terms(text: Column) -> Column:
    """The lower-case words of a text in order; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS), lambda w: w != "")


def n_terms(text: Column) -> Column:
    """size(terms(text)), without lower-casing."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _GAPS_ANY_CASE), lambda w: w != "")).cast("long")


def test_windows(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, words, items): the distinct windows of `width` words; an item of fewer words, but not none, is one window.

    items holds null once if an item without an id has the window.
    """
    split = benchmark.select(F.col(item).alias("item"), terms(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    words = split.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, width))).alias("words"))
    named = F.array_sort(F.collect_set("item"))  # collect_set drops null
    nameless = F.bool_or(F.col("item").isNull())
    items = F.when(nameless, F.concat(named, F.array(F.lit(None).cast(words.schema["item"].dataType)))).otherwise(named)
    return words.groupBy("words").agg(items.alias("items")).withColumn("window", F.xxhash64("words")).select("window", "words", "items")


@dataclass(frozen=True)
class PositionalIndex:
    """postings: doc key columns, term, pos (from 0), around (words from pos - width + 1 to pos + width - 1, for lead terms).
    anchors: for each window and rank 1 (rarest) or 2, the term and its offset. counts: (term, n) of test terms in training."""

    postings: DataFrame
    anchors: DataFrame
    counts: DataFrame
    windows: DataFrame
    width: int


def _small(df: DataFrame) -> DataFrame:
    """The written table df, broadcast if its rows and bytes allow it, else joined by a shuffle."""
    return F.broadcast(df) if may_broadcast(df, BROADCAST_WINDOWS) else df.hint("merge")


def build_index(docs: DataFrame, windows: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> PositionalIndex:
    """Two passes over the documents: one counts the test vocabulary in them, one stores the postings of the rarest terms."""
    windows = cut(windows, "windows")
    vocabulary = cut(windows.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    words = docs.select(F.explode(terms(F.col(text))).alias("term"))
    found = words.join(_small(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(vocabulary.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "term-counts")
    placed = windows.select("window", F.posexplode("words").alias("off", "term")).join(counts, "term")
    rarest = Window.partitionBy("window").orderBy("n", "off")
    anchors = cut(placed.withColumn("rank", F.row_number().over(rarest)).filter("rank <= 2").select("window", "rank", "term", "off"), "anchors")
    wanted = cut(anchors.groupBy("term").agg(F.min("rank").alias("lead")), "anchor-terms")
    split = docs.select(F.col(key), keyed(docs, key, text)[1], terms(F.col(text)).alias("w"))
    placed = split.select(key, "_text_key", "w", F.posexplode("w").alias("pos", "term")).join(_small(wanted), "term")
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    around = F.when(F.col("lead") == 1, F.slice("w", first + 1, F.col("pos") - first + width))
    postings = cut(placed.select(key, "_text_key", "term", "pos", around.alias("around")), "postings")
    return PositionalIndex(postings, anchors, counts, windows, width)


def phrase_matches(index: PositionalIndex, key: str = "doc_id") -> DataFrame:
    """(doc key columns, window, start, length, items): every place where a document has all words of a window in order."""
    lead = index.anchors.filter("rank = 1").join(index.windows, "window").select("window", "term", "off", "words", "items")
    second = index.anchors.filter("rank = 2").select("window", "term", F.col("off").alias("off2"))
    size = F.size("words")
    before = F.col("pos") - F.greatest(F.col("pos") - (index.width - 1), F.lit(0))  # words that `around` has before the term
    starts = index.postings.filter("around is not null").join(_small(cut(lead, "leads")), "term").filter((F.col("pos") >= F.col("off")) & (before >= F.col("off")))
    starts = starts.select(key, "_text_key", "window", (F.col("pos") - F.col("off")).alias("start"), size.alias("length"), "words", "items", F.slice("around", F.greatest(before - F.col("off") + 1, F.lit(1)), size).alias("there"))
    others = index.postings.join(_small(cut(second, "seconds")), "term").filter("pos >= off2").select(F.col(key).alias("_k"), F.col("_text_key").alias("_t"), F.col("window").alias("_w"), (F.col("pos") - F.col("off2")).alias("_s")).distinct()
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_text_key").eqNullSafe(F.col("_t")) & (F.col("window") == F.col("_w")) & (F.col("start") == F.col("_s"))
    # the lists are intersected; the words around settle what is left
    both = starts.filter("length > 1").join(others, same, "left_semi").unionByName(starts.filter("length = 1"))
    return both.filter("there = words").select(key, "_text_key", "window", "start", "length", "items").distinct()


def proximity_matches(index: PositionalIndex, slop: int, key: str = "doc_id") -> DataFrame:
    """(doc key columns, window, distance): documents in which the two rarest terms of a window of two words or more
    stand within their distance in the window plus `slop` words, in any order.

    Positions are bucketed by the span allowed, so a join compares neighbouring buckets only.
    """
    one = index.anchors.filter("rank = 1").select("window", F.col("term"), F.col("off"))
    two = index.anchors.filter("rank = 2").select("window", F.col("term"), F.col("off").alias("off2"))
    span = index.width + slop
    a = index.postings.select(key, "_text_key", "term", "pos").join(_small(one), "term").withColumn("cell", F.explode(F.array(*[F.floor(F.col("pos") / span) + d for d in (-1, 0, 1)])))
    b = index.postings.select(F.col(key).alias("_k"), F.col("_text_key").alias("_t"), "term", F.col("pos").alias("pos2")).join(_small(two), "term").withColumn("_c", F.floor(F.col("pos2") / span)).withColumnRenamed("window", "_w").drop("term")
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_text_key").eqNullSafe(F.col("_t")) & (F.col("window") == F.col("_w")) & (F.col("cell") == F.col("_c"))
    near = a.drop("term").join(b, same).withColumn("distance", F.abs(F.col("pos") - F.col("pos2")))
    near = near.filter((F.col("distance") > 0) & (F.col("distance") <= F.abs(F.col("off") - F.col("off2")) + slop))
    return near.groupBy(key, "_text_key", "window").agg(F.min("distance").alias("distance"))


def near_items(index: PositionalIndex, slop: int, key: str = "doc_id") -> DataFrame:
    """(doc key columns, n_near): how many items have a window whose two rarest terms stand near each other in a document; see proximity_matches. Items without an id count as one."""
    near = proximity_matches(index, slop, key).join(_small(index.windows.select("window", "items")), "window")
    return near.select(key, "_text_key", F.explode("items").alias("item")).distinct().groupBy(key, "_text_key").agg(F.count(F.lit(1)).cast("long").alias("n_near"))


def hits(index: PositionalIndex, key: str = "doc_id") -> DataFrame:
    """One row for each contaminated document: key, _text_key, n_hit (words inside any occurrence), n_items, items (sorted, as strings).

    All items without an id count as one in n_items; items does not hold it.
    """
    found = phrase_matches(index, key)
    reach = Window.partitionBy(key, "_text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy(key, "_text_key", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    fresh = spans.withColumn("new", F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(reach), F.lit(0))))
    covered = fresh.groupBy(key, "_text_key").agg(F.sum(F.greatest(F.col("new"), F.lit(0))).cast("long").alias("n_hit"))
    ids = found.select(key, "_text_key", F.explode(F.col("items").cast("array<string>")).alias("item")).distinct()
    items = ids.groupBy(key, "_text_key").agg(F.count(F.lit(1)).cast("long").alias("n_items"), F.array_sort(F.collect_set("item")).alias("items"))
    joined = covered.alias("c").join(items.alias("i"), F.col(f"c.{key}").eqNullSafe(F.col(f"i.{key}")) & (F.col("c._text_key") == F.col("i._text_key")))
    return joined.select(f"c.{key}", "c._text_key", "n_hit", "n_items", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", slop: int = 5) -> DataFrame:
    """Per document row: key, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items by proximity, see near_items).

    Null and empty texts have no words and no hits. Repeated rows each get their row. Without items nothing is hit.
    A benchmark row whose id is null hits like any other: all such rows are one item in n_items, and add nothing to items_sha256.
    """
    index = build_index(docs, test_windows(benchmark, width), width, key, text)
    found, near = cut(hits(index, key), "hits"), cut(near_items(index, slop, key), "near")
    rows = lookup(docs.select(*keyed(docs, key, text), n_terms(F.col(text)).alias("n_words")), found, [key, "_text_key"])
    rows = lookup(rows, near, [key, "_text_key"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(key, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark window.

    Null and empty texts stay. Repeated rows share their verdict. Benchmark rows without an id count like any other, and
    those without words have no window. Columns of docs may have any names. Empty tables: nothing is taken.
    """
    found = cut(hits(build_index(docs, test_windows(benchmark, width), width, key, text), key).select(key, "_text_key"), "hits")
    marked = found.select(F.col(key).alias("__k"), F.col("_text_key").alias("__t"))
    return docs.join(_small(marked), docs[key].eqNullSafe(F.col("__k")) & (keyed(docs, key, text)[1] == F.col("__t")), "left_anti")
