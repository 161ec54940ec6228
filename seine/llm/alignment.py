"""Two tokenizers over the same texts, aligned by a sweep over the ends of their tokens.

The ends of A's and B's tokens are united, dealt out by document and sorted by offset; a state machine reads them in
this order and closes a group wherever both end. They travel in blocks of consecutive tokens: an end follows from the
ids, so a block is its first end and its ids. The machine holds the tokens of the open group and the two blocks that
overlap, whatever the length of the document, besides the document's table of linked id pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copy_groups, cut, may_broadcast, one_of_each, text_key
from .tokens import TwinEncoder, twins

#: Tokens of a block, bytes of text that an encoding step holds, and bounds of the table of pairs in a broadcast.
BLOCK, TEXT_BYTES, PAIR_ROWS, PAIR_BYTES = 4096, 4 << 20, 1_000_000, 128 << 20

_EVENTS = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("first_end", pa.int64()), ("side", pa.int8()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())])
_SWEPT = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64()))])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.int8(): "byte", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `most` bytes of a column, or of one row."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > most and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def end_events(texts: DataFrame, a: str, b: str) -> DataFrame:
    """Blocks of the token ends of texts (_key, _copies, text) by both tokenizers; none of texts that have no tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = twins(a, b)
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                rows = []
                for key, copies, both in zip(part.column("_key").to_pylist(), part.column("_copies").to_pylist(), encoder.encode_batch(part.column("text")), strict=True):
                    for side, ids in enumerate(both or ()):
                        ends = np.cumsum((encoder.a_sizes, encoder.b_sizes)[side][ids])
                        for at in range(0, len(ids), BLOCK):
                            own = ids[at : at + BLOCK]
                            rows.append((key, copies, int(ends[at]), side, at // BLOCK, len(own), codec.compress(own.tobytes(), asbytes=True)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EVENTS, strict=True)], schema=_EVENTS)

    return texts.select("_key", F.coalesce("_copies", F.lit(1)).cast("long").alias("_copies"), "text").mapInArrow(run, _ddl(_EVENTS))


class Sweep:
    """The state machine over the ends of one document."""

    def __init__(self, encoder: TwinEncoder):
        self.sizes = (encoder.a_sizes, encoder.b_sizes)
        # what an id adds to the groups' text: followed by a comma, or by the mark behind the last of its side
        self.shown = [f"{i}{mark}".encode() for side, last in zip(self.sizes, "|;", strict=True) for i in range(len(side)) for mark in ("," + last)]
        self.offset = 2 * len(encoder.a_sizes)
        self.start(b"", 0)

    def start(self, key: bytes, copies: int) -> None:
        self.key, self.copies = key, copies
        self.next = [0, 0]
        self.base = [0, 0]
        self.ids = [np.zeros(0, np.uint16)] * 2
        self.ends = [np.zeros(0, np.int64)] * 2
        self.n = [0, 0]
        self.n_groups = self.n_links = 0
        self.digest = hashlib.sha256()
        self.codes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def block(self, side: int, number: int, ids: np.ndarray) -> None:
        """Take the next block of a side; one that is known, as rows may repeat, is skipped."""
        if number < self.next[side]:
            return
        self.next[side] += 1
        ends = self.base[side] + np.cumsum(self.sizes[side][ids])
        self.base[side] = int(ends[-1])
        self.ids[side] = np.concatenate([self.ids[side], ids]) if len(self.ids[side]) else ids
        self.ends[side] = np.concatenate([self.ends[side], ends]) if len(self.ends[side]) else ends
        a, b = self.ends
        if not len(a) or not len(b):
            return
        # where A ends and B does as well
        at = np.searchsorted(b, a)
        shared = a[np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)]
        if len(shared):
            self._close(int(shared[-1]))

    def _close(self, end: int) -> None:
        """Emit all groups that end at `end` or before; nothing overlaps that end."""
        k = [int(np.searchsorted(e, end, "right")) for e in self.ends]
        (a_ids, b_ids), (a, b) = (x[:n] for x, n in zip(self.ids, k, strict=True)), (x[:n] for x, n in zip(self.ends, k, strict=True))
        self.ids, self.ends = ([x[n:] for x, n in zip(xs, k, strict=True)] for xs in (self.ids, self.ends))
        # between two neighbouring ends lies one token of either side: a link
        last_a, last_b = b[np.searchsorted(b, a)] == a, a[np.searchsorted(a, b)] == b
        spots = np.sort(np.concatenate([a, b[~last_b]]), kind="stable")
        codes = a_ids[np.searchsorted(a, spots)].astype(np.uint32) << 16 | b_ids[np.searchsorted(b, spots)]
        codes, counts = np.unique(codes, return_counts=True)
        if len(self.codes):
            both, place = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            codes, counts = both, np.bincount(place, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        self.codes, self.counts = codes, counts
        self.n_links += len(spots)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (group_a, group_b))
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + before_b[group_a]] = 2 * a_ids.astype(np.int64) + last_a
        shown[np.arange(len(b)) + before_a[group_b + 1]] = 2 * b_ids.astype(np.int64) + last_b + self.offset
        text = b"".join(map(self.shown.__getitem__, shown.tolist()))[:-1]
        self.digest.update(b";" + text if self.n_groups else text)
        self.n_groups += groups
        self.n = [self.n[0] + len(a), self.n[1] + len(b)]

    def row(self) -> tuple:
        if len(self.ids[0]) or len(self.ids[1]):
            raise RuntimeError("both tokenizers end where the text does: blocks of a document are missing")
        links = self.codes.view(np.int32).astype(np.int64) << 32 | self.counts
        return self.key, self.copies, *self.n, self.n_groups, self.n_links, self.digest.hexdigest(), links


def swept(events: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each text: counts, the digest of its groups, and links: id pair (A in the upper 16 bits of an int, B in the lower) times 2^32, plus how often it is linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, codec, rows, held = Sweep(twins(a, b)), pa.Codec("zstd"), [], 0
        for batch in batches:
            for key, copies, side, number, n, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "copies", "side", "block", "n", "ids")), strict=True):
                if key != machine.key:
                    if machine.key:
                        rows.append(machine.row())
                        held += len(rows[-1][-1])
                    machine.start(key, copies)
                    if held > 1_000_000:
                        yield _rows(rows)
                        rows, held = [], 0
                machine.block(side, number, np.frombuffer(codec.decompress(ids, decompressed_size=2 * n), "<u2"))
        if machine.key:
            rows.append(machine.row())
        if rows:
            yield _rows(rows)

    return events.repartition("key").sortWithinPartitions("key", "first_end", "side", "block").mapInArrow(run, _ddl(_SWEPT))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[-1]])]).astype(np.int32)), pa.array(np.concatenate(columns[-1])))
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns[:-1], _SWEPT, strict=False)), links], schema=_SWEPT)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, docs, best) of the id pairs that swept rows link: the documents that do, and whether no other pair of its A id has more. Written. An A id has no more pairs than B has ids."""
    pairs = links.select("copies", F.explode("links").alias("link")).groupBy(F.shiftright("link", 32).cast("int").alias("pair")).agg(F.sum("copies").alias("docs"))
    pairs = cut(pairs.withColumn("a", F.shiftrightunsigned("pair", 16)), "pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return cut(pairs.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-counts")


def align(docs: DataFrame, a: str, b: str, max_pairs: int = PAIR_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents (doc_id, text).

    a: a byte-level BPE file of the tokenizers library; b: a sentencepiece BPE model. A text is encoded once, whatever the
    number of its copies, which all count as documents. Null and empty texts, and those whose tokens' bytes do not join to
    a space and the text, have zeros and an empty digest. Repeated rows each get their row, null ids stay, other columns
    may have any names, and an empty table gives an empty one. The table of pairs is broadcast up to max_pairs rows and
    PAIR_BYTES; beyond, links and pairs are joined by a shuffle.
    """
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    groups = copy_groups(keyed.select("doc_id", "_key"))
    texts = one_of_each(keyed.filter("text != ''"), groups)
    links = cut(swept(end_events(texts, a, b), a, b), "links", "zstd")
    counts = pair_counts(links)
    counts = F.broadcast(counts) if may_broadcast(counts, max_pairs, PAIR_BYTES) else counts.hint("merge")
    each = links.select("key", F.explode("links").alias("link")).select("key", F.shiftright("link", 32).cast("int").alias("pair"), F.col("link").bitwiseAND(0xFFFFFFFF).alias("n"))
    sums = each.join(counts, "pair").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    found = links.drop("links", "copies").join(sums, "key")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(found, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
