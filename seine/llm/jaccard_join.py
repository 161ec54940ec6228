"""Similarity join on word n-gram sets by chosen paths.

Each distinct n-gram set is a record with a MinHash signature, a list of sampled tokens that two records share at each
coordinate with a probability equal to their Jaccard similarity. A run splits the records along coordinates drawn for
each node of a tree: records with the same token at the drawn coordinate go to the same child. Nodes of few records are
leaves and compared by brute force. Larger nodes are split on, to any depth, unless their records are so alike that
splitting would not save comparisons: such nodes are compared in cells of bounded size. Runs are repeated until the
expected share of pairs at the threshold that have met reaches the target recall.

A pair may meet in several leaves. It belongs to the smallest leaf that both have in common, which each leaf can tell
from its records' lists of leaves; so links are counted once without a list of pairs. Leaves return a link count for
each record and a spanning forest, never all pairs. Compared pairs are settled by the exact Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, cut, keyed, lookup

#: Coordinates of a signature; records of a leaf.
COORDINATES, LEAF = 64, 128
#: From level TOP on nodes of so many leaves are compared, as each level costs a few jobs whatever its size.
DEEP_LEAF = 8
#: Draws at a node of the first TOP levels; below, every other node draws twice, so that levels hardly add rows.
BRANCH, TOP = 2, 6
#: A node of this average similarity or more is compared as it is: each draw brings together again that share of its pairs,
#: so two draws leave no fewer comparisons, in more rows. It is estimated from so many of the node's records; the
#: estimate decides where pairs are compared, never whether.
DENSE, SAMPLE = 0.5, 64
#: No path draws more coordinates than this. What is left there is compared in cells.
DEPTH = 48
#: Records of a block of a node that is compared in cells: BLOCK, and more where the node has over 16 blocks, up to
#: MOST_BLOCK, but at most so many that their n-gram sets have BLOCK_BYTES on average.
BLOCK, MOST_BLOCK, BLOCK_BYTES = 256, 1024, 32 << 20
#: Nodes that hold more than one in so many rows are hot; so there are no more of them than this.
HOT_NODES = 20_000
#: Grams of a batch that are signed at once, more or less: a slice stays in the processor's cache.
SLICE = 1 << 16
#: Rows of a cell whose signatures are compared with all others at once.
SLAB = 256
#: A pair is settled exactly if its signatures agree in this share of coordinates less than the threshold, at least:
#: four standard deviations at a similarity of 0.8.
MARGIN = 0.2
#: The expected share of links at the threshold itself that are found, in a tree without end.
RECALL = 0.985

_MULTIPLIERS = np.array([int.from_bytes(hashlib.blake2b(b"seine%d" % i, digest_size=8).digest(), "little") | 1 for i in range(COORDINATES)], np.uint64)


def meeting_chance(similarity: float, levels: int = 200) -> float:
    """The chance that a pair of this similarity shares a leaf of one run which `levels` draws lead to."""
    p = 1.0
    for level in range(levels, 0, -1):
        q = similarity * p
        twice = 1 - (1 - q) ** BRANCH
        p = twice if level <= TOP else (q + twice) / 2
    return p


def expected_recall(similarity: float, runs: int, levels: int = 200) -> float:
    """The expected share of pairs of this similarity that meet in a leaf and pass the signature test.

    Runs draw from the same coordinates, so the number that the pair agrees in is fixed first.
    """
    least = math.ceil((similarity - MARGIN) * COORDINATES)
    agree = ((a / COORDINATES, math.comb(COORDINATES, a) * similarity**a * (1 - similarity) ** (COORDINATES - a)) for a in range(least, COORDINATES + 1))
    return sum(p * (1 - (1 - meeting_chance(share, levels)) ** runs) for share, p in agree)


def runs_needed(similarity: float, recall: float) -> int:
    """Runs by which pairs at the similarity are expected to meet, even where the tree never ends; for other pairs it is more."""
    for runs in range(1, COORDINATES // BRANCH + 1):
        if expected_recall(similarity, runs) >= recall:
            return runs
    raise ValueError(f"a recall of {recall} at {similarity} needs more than {COORDINATES} coordinates")


def with_ngrams(rows: DataFrame, n: int, text: str) -> DataFrame:
    """rows with `grams` in place of the text: 64-bit hashes of its runs of n words.

    Words stand between ASCII white space; case and marks count. A text of fewer words, but not none, is one run of all
    its words. The word array is made in a projection of its own, once a row.
    """
    kept = [c for c in rows.columns if c != text]
    w = F.col("__w")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    grams = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < n, F.array(F.xxhash64(w))).otherwise(runs)
    return rows.select(*kept, blank_words(F.col(text)).alias("__w")).select(*kept, grams.alias("grams"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()


def signatures(docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _text_key, record, size, sig) of every row: a 128-bit digest of its n-gram set, the set's size, its signature.

    Null and empty texts have no set: record and sig are null.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("grams"))
            values = values.view(np.uint64) if len(values) else np.zeros(0, np.uint64)
            records, sizes = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                one = np.unique(values[a:b])
                sizes.append(len(one))
                records.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None)
            sig = np.zeros((batch.num_rows, COORDINATES), np.int32)
            full = np.flatnonzero(offsets[1:] > offsets[:-1])
            for rows in np.split(full, np.flatnonzero(np.diff(offsets[:-1][full] // SLICE)) + 1):
                if len(rows):
                    a, b = offsets[rows[0]], offsets[rows[-1] + 1]
                    part, starts = values[a:b], offsets[:-1][rows] - a
                    for t in range(COORDINATES):
                        sig[rows, t] = (np.minimum.reduceat(part * _MULTIPLIERS[t], starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_text_key"), pa.array(records, pa.binary()), pa.array(sizes, pa.int64()), lists], names=[key, "_text_key", "record", "size", "sig"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    rows = with_ngrams(docs.select(F.col(key), F.col(text), keyed(docs, key, text)[1]), n, text)
    return rows.mapInArrow(run, f"{key} {kind}, _text_key long, record binary, size long, sig array<int>")


def with_sizes(level: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of level whose node is in sizes, with its columns.

    No hot node is shuffled: those that hold more than one in HOT_NODES rows are at most HOT_NODES, and are broadcast. The
    others are joined by a shuffle that brings together no more rows of one node than that.
    """
    most = max(LEAF, level.count() // HOT_NODES)
    hot = sizes.filter(F.col("n") > most)
    fields = [c for c in sizes.columns if c != "node"]
    marked = level.join(F.broadcast(hot), "node", "left")
    rest = marked.filter("n is null").drop(*fields).join(sizes.filter(F.col("n") <= most), "node")
    return marked.filter("n is not null").unionByName(rest)


def density(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(node, density) of nodes (record, node, used, n): the average similarity of about SAMPLE of their records, from the
    coordinates that the path has not drawn. Null for fewer than two records or no such coordinate."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for used, values in zip(batch.column("used").to_pylist(), batch.column("sigs"), strict=True):
                sig = values.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
                free = [c for c in range(COORDINATES) if not used >> c & 1]
                sig, n = sig[:, free], len(sig)
                pairs = n * (n - 1) * len(free)
                found.append((int((sig[:, None, :] == sig[None, :, :]).sum()) - n * len(free)) / pairs if pairs else None)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.float64())], names=["node", "density"])

    picked = rows.filter(F.pmod(F.xxhash64("record", "node", F.lit("pick")), F.col("n")) < SAMPLE).select("record", "node", "used")
    sampled = picked.join(records.select("record", "sig"), "record").groupBy("node").agg(F.first("used").alias("used"), F.collect_list("sig").alias("sigs"))
    return sampled.mapInArrow(run, "node long, density double")


def _draws(depth: int) -> Column:
    """The coordinates that a node draws: one or two that its path has not drawn."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.pmod(F.xxhash64(F.col("node"), i), F.lit(COORDINATES)).cast("int"))
    free = F.array_distinct(F.filter(tries, lambda c: F.call_function("shiftright", F.col("used"), c) % 2 == 0))
    return F.slice(free, F.lit(1), F.lit(BRANCH) if depth < TOP else F.when(F.pmod("node", F.lit(2)) == 0, 1).otherwise(BRANCH))


def leaves(records: DataFrame, runs: int) -> DataFrame:
    """(record, leaf, n, block): the leaves of two records or more that the records (record, size, sig) reach in all runs,
    with their sizes and the records of a block in them."""
    order = sorted(range(COORDINATES), key=lambda i: hashlib.blake2b(b"root%d" % i).digest())
    roots = [(r, order[(r * BRANCH + b) % COORDINATES]) for r in range(runs) for b in range(BRANCH)]
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    first = F.array(*[F.struct(F.xxhash64(F.lit(r), F.lit(c), F.get("sig", F.lit(c))).alias("node"), bit(F.lit(c)).alias("used")) for r, c in roots])
    level = records.select("record", "size", F.inline(first))
    found: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        level = cut(level, f"level{depth}")
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("grams")).filter("n > 1")
        sized = cut(with_sizes(level, cut(sizes, f"sizes{depth}")), f"sized{depth}")
        few = LEAF if depth < TOP else LEAF * DEEP_LEAF
        found.append(sized.filter(F.col("n") <= few))
        wide = sized.filter(F.col("n") > few)
        if wide.isEmpty():
            break
        if depth == DEPTH:
            found.append(wide)
            break
        known = cut(wide.groupBy("node").agg(F.first("n").alias("n")).join(density(wide, records), "node", "left"), f"density{depth}")
        judged = cut(with_sizes(wide.drop("n"), known), f"judged{depth}").withColumn("_draws", _draws(depth))
        stays = F.coalesce(F.col("density") >= DENSE, F.lit(True)) | (F.size("_draws") == 0)
        found.append(judged.filter(stays).drop("density", "_draws"))
        drawn = judged.filter(~stays).select("record", "size", "node", "used", F.explode("_draws").alias("c"))
        level = drawn.join(records.select("record", "sig"), "record").select("record", "size", F.xxhash64("node", "c", F.get("sig", F.col("c"))).alias("node"), (F.col("used").bitwiseOR(bit(F.col("c")))).alias("used"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    fits = F.greatest(F.lit(16.0), F.lit(float(BLOCK_BYTES)) / (8 * F.col("grams")))
    block = F.least(F.greatest(F.lit(float(BLOCK)), F.least(F.col("n") / 16, F.lit(float(MOST_BLOCK)))), fits).cast("int")
    return whole.select("record", F.col("node").alias("leaf"), "n", F.when(F.col("n") <= LEAF, F.col("n").cast("int")).otherwise(block).alias("block"))


def cells(members: DataFrame) -> DataFrame:
    """Rows (record, leaf, n, block, ...) spread over cells of bounded size: adds side, low, high.

    A leaf of n records has ceil(n / block) blocks; each pair of blocks is a cell, and a record is in the cells of its
    block. side: 0 if the record's block is the cell's lower one, 1 else.
    """
    rows = members.withColumn("_blocks", F.ceil(F.col("n") / F.col("block")).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("record", "leaf"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("*", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"), (F.col("_own") > F.col("_other")).cast("int").alias("side")).drop("_blocks", "_own", "_other")


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the integer columns `keys`, from sorted batches, each as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        marks = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(marks, marks[1:], strict=False):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _owned(cell: pa.RecordBatch) -> np.ndarray:
    """Which pairs of a cell belong to its leaf: those without a smaller leaf in common, and across the two blocks."""
    n = cell.num_rows
    leaf, low, high = (cell.column(c)[0].as_py() for c in ("leaf", "low", "high"))
    values, offsets = _lists(cell.column("leaves"))
    rows = np.repeat(np.arange(n), np.diff(offsets))
    smaller = values < leaf
    pairs = np.ones((n, n), bool)
    if smaller.any():
        names, place = np.unique(values[smaller], return_inverse=True)
        rows = rows[smaller]
        for a in range(0, len(names), 2048):
            part = (place >= a) & (place < a + 2048)
            hot = np.zeros((n, min(2048, len(names) - a)), np.float32)
            hot[rows[part], place[part] - a] = 1
            pairs &= hot @ hot.T == 0
    if low != high:
        side = cell.column("side").to_numpy(zero_copy_only=False)
        pairs &= side[:, None] != side[None, :]
    return np.triu(pairs, 1)


def _likely(cell: pa.RecordBatch, least: float, similarity: float) -> np.ndarray:
    """Which pairs agree in a share `least` of their signatures and have sizes that allow the similarity."""
    n = cell.num_rows
    sig = _lists(cell.column("sig"))[0].reshape(n, COORDINATES)
    same = np.zeros((n, n), np.uint8)
    by_coordinate = np.ascontiguousarray(sig.T)
    for a in range(0, n, SLAB):
        for one in by_coordinate:
            same[a : a + SLAB] += one[a : a + SLAB, None] == one[None, :]
    size = cell.column("size").to_numpy(zero_copy_only=False)
    return (same >= least * COORDINATES) & (np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :]) - 1e-9)


def _overlaps(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """The sizes of all intersections in a cell: products of 0/1 matrices over the grams that two sets or more share."""
    n = len(sets)
    names, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count[place] > 1
    number = np.cumsum(count > 1) - 1
    rows, place = rows[shared], number[place[shared]]
    out = np.zeros((n, n), np.float32)  # exact up to 2 ** 24
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        i, j = np.searchsorted(place, [a, a + columns])
        block = np.zeros((n, columns), np.float32)
        block[rows[i:j], place[i:j] - a] = 1
        out += block @ block.T
    return out


def _forest(pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each row with a link, the smallest row of its component in the cell."""
    parent = list(range(len(pairs)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in np.flatnonzero(pairs[i]).tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    for i in range(len(pairs)):
        if top(i) != i:
            yield i, top(i)


_CELL = ["leaf", "low", "high"]


def _to_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL)


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """The (record, leaf, low, high, side) of cells that take part in a likely pair of their leaf."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _grouped(batches, _CELL):
            if cell.num_rows > 1:
                pairs = _likely(cell, similarity - MARGIN, similarity)
                if pairs.any():
                    pairs &= _owned(cell)
                    kept = np.flatnonzero(pairs.any(0) | pairs.any(1))
                    if len(kept):
                        yield cell.take(pa.array(kept)).select(["record", *_CELL, "side"])

    return _to_cells(rows).mapInArrow(run, "record binary, leaf long, low int, high int, side int")


def settle(rows: DataFrame, similarity: float) -> DataFrame:
    """(record, links, to): for records of cells, the documents they are linked to there; and forest edges (record, to)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _grouped(batches, _CELL):
            if cell.num_rows < 2:
                continue
            values, offsets = _lists(cell.column("grams"))
            sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            size = np.array([len(s) for s in sets], float)
            common = _overlaps(sets)
            pairs = (common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9) & _owned(cell)
            if not pairs.any():
                continue
            docs = cell.column("docs").to_numpy(zero_copy_only=False)
            links = pairs @ docs + pairs.T @ docs
            records = cell.column("record").to_pylist()
            kept = np.flatnonzero(links)
            edges = list(_forest(pairs))
            out = [(records[i], int(links[i]), None) for i in kept] + [(records[i], 0, records[j]) for i, j in edges]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["record", "links", "to"])

    return _to_cells(rows).mapInArrow(run, "record binary, links long, to binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root being the smallest node of its component.

    Large-star and small-star steps in turn, each from a written table, until the edges stay the same. The minima are
    written as well: then the joins with them start from plain exchanges, whose hot nodes adaptive execution can split.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large-star")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), "small-star")
        after = mark(edges)
        if after == before:
            break
        before = after
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return edges.select(F.inline(ends)).groupBy("node").agg(F.min("root").alias("root"))


def classes(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, _text_key, class_id, n_links, record, root (the class's name, where it has links).

    n_links: the other rows whose n-gram set has at least the similarity to this row's, equal sets included. class_id:
    the smallest key among rows linked to it by a chain of links (nulls aside). Null and empty texts are linked to
    nothing. Repeated rows count as copies. Texts of any length are whole sets; other columns of docs may have any names.
    An empty table gives an empty one.
    """
    signed = cut(signatures(docs, n, key, text), "signed")
    records = cut(
        signed.filter("record is not null").groupBy("record").agg(F.count(F.lit(1)).alias("docs"), F.min(key).alias("first"), F.min(F.struct(key, "_text_key")).alias("row"), F.min("size").alias("size"), F.min("sig").alias("sig")),
        "records",
    )
    found = cut(leaves(records.select("record", "size", "sig"), runs_needed(similarity, recall)), "leaves")
    lists = found.groupBy("record").agg(F.collect_list(F.struct("leaf", "n", "block")).alias("all"))
    rows = lists.join(records.select("record", "size", "sig"), "record").withColumn("leaves", F.transform("all", lambda x: x["leaf"]))
    members = rows.select("record", "size", "sig", "leaves", F.inline("all"))
    likely = cut(candidates(cells(members), similarity), "candidates")
    needed = cut(likely.select("record").distinct().join(records.select("record", "row", "docs"), "record").select("record", "docs", F.col(f"row.{key}").alias(key), "row._text_key"), "needed")
    named = docs.select(F.col(key), F.col(text), keyed(docs, key, text)[1])
    picked = lookup(named, needed, [key, "_text_key"], "inner").select("record", "docs", text)
    sets = with_ngrams(picked, n, text).groupBy("record").agg(F.any_value("grams").alias("grams"), F.any_value("docs").alias("docs"))
    full = likely.join(sets.join(lists.select("record", F.transform("all", lambda x: x["leaf"]).alias("leaves")), "record"), "record")
    settled = cut(settle(full, similarity), "settled")
    links = settled.filter("links > 0").groupBy("record").agg(F.sum("links").alias("links"))
    roots = components(settled.filter("to is not null").select(F.col("record").alias("a"), F.col("to").alias("b")))
    grouped = records.select("record", "docs", "first").join(links, "record", "left").join(roots, F.col("record") == F.col("node"), "left")
    grouped = grouped.select("record", "first", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "record").alias("root")).filter("n_links > 0")
    grouped = cut(grouped, "grouped")
    ids = cut(grouped.groupBy("root").agg(F.min("first").alias("class_id")), "class-ids")
    table = cut(grouped.join(ids, "root").select("record", "root", "class_id", "n_links"), "classes")
    joined = lookup(signed.select(key, "_text_key", "record"), table, ["record"])
    return joined.select(key, "_text_key", F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "record", "root")


def dedupe(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the one of the smallest key (null last), then the smallest text hash; of
    repeated rows one stays, the first as JSON if they differ in other columns. Rows without words stay."""
    marked = cut(classes(docs, n, similarity, recall, key, text), "classes")
    linked = marked.filter("n_links > 0")
    place = F.struct(F.col(key).isNull().alias("last"), F.col(key), F.col("_text_key"))
    best = cut(linked.groupBy("root").agg(F.min(place).alias("best")), "best")
    gone = linked.select("root", place.alias("place")).distinct().join(best, "root").filter("place != best").select(F.col(f"place.{key}").alias(key), F.col("place._text_key"))
    gone = cut(gone.distinct(), "gone").withColumn("_gone", F.lit(True))
    twice = marked.filter("record is not null").groupBy(key, "_text_key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    packed = docs.select(F.struct("*").alias("__row"), F.col(key), keyed(docs, key, text)[1])
    kept = lookup(packed, cut(gone, "gone"), [key, "_text_key"]).filter("_gone is null").drop("_gone")
    kept = lookup(kept, cut(twice, "repeated"), [key, "_text_key"])
    one = kept.filter("m > 1").groupBy(key, "_text_key").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return kept.filter("m is null").select("__row.*").unionByName(one.select("__row.*"))
