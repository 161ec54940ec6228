"""Removal of byte strings that occur anywhere else in a corpus, by suffix sorting in blocks; see suffixes.repeated.

Only suffixes that may be tied over the whole length are sorted. Each window of `length` bytes has an anchor: a string of
half its length that the window's own bytes choose, so equal windows choose equal anchors at equal places. Windows whose
anchor occurs once in the corpus are unique; this drops most of them, and the others are the suffixes of buckets, one
for each anchor string. A task sorts one block of buckets at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copy_groups, cut, lookup, one_of_each, text_key
from .suffixes import repeated

#: Bytes of a repeated string, of text that a step looks at, and of contexts that a task sorts or sends at a time.
LENGTH, CHUNK, BLOCK_BYTES = 200, 1 << 20, 8 << 20
#: An anchor is hot if it occurs so often in one batch, or in batches that hold it twice in all. Hot buckets are dealt out by windows.
HOT_IN_BATCH, HOT = 32, 2048
#: Anchors that a batch holds before it sends them.
HELD_ANCHORS = 500_000

_FACTOR = 0x9E3779B97F4A7C15
_MARK_ALL = 1 << 30


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    before, after = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


class Anchors:
    """The anchors of byte strings: in each window of `length` bytes the string of half its length with the least hash, the first of several."""

    def __init__(self, length: int, chunk: int = CHUNK):
        self.length, self.size = length, length // 2
        self.width = length - self.size + 1
        self.chunk = chunk
        n = chunk + length + 1
        self.up, self.down = _powers(_FACTOR, n), _powers(pow(_FACTOR, -1, 1 << 64), n)
        # the low bits of a hash make room for its place, so that the least of them tells where it is
        self.low = np.uint64((1 << n.bit_length()) - 1)
        self.place = np.arange(n, dtype=np.uint64)

    def _hashes(self, part: np.ndarray) -> np.ndarray:
        """A number for each string of the anchor's size that only its bytes decide."""
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.down[: len(part)], out=sums[1:])
        h = (sums[self.size :] - sums[: -self.size]) * self.up[: len(part) - self.size + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, hash, first window) of each anchor, ascending; its windows end before the next one's first. A long string is looked at in bounded parts."""
        data = np.frombuffer(raw, np.uint8)
        found = []
        for start in range(0, len(data) - self.length + 1, self.chunk):
            h = self._hashes(data[start : start + self.chunk + self.length - 1])
            at = (_least(h & ~self.low | self.place[: len(h)], self.width) & self.low).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            at = at[first]
            found.append((at + start, h[at].view(np.int64), first + start))
        if len(found) == 1:
            return found[0]
        at, grams, first = (np.concatenate(x) for x in zip(*found, strict=True))
        new = np.concatenate([[True], at[1:] != at[:-1]])
        return at[new], grams[new], first[new]


def _short(key: bytes) -> int:
    """The first eight bytes of a text's key as a long; _tid in SQL."""
    return int.from_bytes(key[:8], "big", signed=True)


def _tid():
    return F.conv(F.hex(F.substring("_key", 1, 8)), 16, -10).cast("long")


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(gram, n, tid, pos) of all anchors of texts (_key, raw). n: 0 for an anchor's place; below 0 for one that is known
    to be repeated and hot, whose gram is a random number, so that it loads no task; above 0, and without a place, how
    often a gram occurs in a batch that holds it twice or more, negative if it is hot there (then below -_MARK_ALL too)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        held, seen, count = [], set(), 0
        for batch in batches:
            for key, raw in zip(batch.column("_key").to_pylist(), batch.column("raw"), strict=True):
                if key in seen:
                    continue  # a repeated row
                seen.add(key)
                at, grams, _ = anchors.of(raw.as_py())
                held.append((_short(key), at, grams))
                count += len(at)
                if count >= HELD_ANCHORS:
                    yield _sent(held)
                    held, seen, count = [], set(), 0
        if held:
            yield _sent(held)

    return texts.select("_key", "raw").mapInArrow(run, "gram long, n int, tid long, pos int")


def _sent(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(a) for _, a, _ in held]
    tid = np.repeat(np.array([t for t, _, _ in held], np.int64), sizes)
    pos, gram = np.concatenate([a for _, a, _ in held]), np.concatenate([g for _, _, g in held])
    grams, place, counts = np.unique(gram, return_inverse=True, return_counts=True)
    hot = counts[place] >= HOT_IN_BATCH
    several = np.flatnonzero(counts > 1)
    n = np.where(hot, -1, 0)
    gram = np.where(hot, tid * 31 + pos, gram)
    stats = counts[several]
    none = np.zeros(len(several), np.int64)
    columns = (np.concatenate([grams[several], gram]), np.concatenate([np.where(stats >= HOT_IN_BATCH, -_MARK_ALL - np.minimum(stats, 1 << 20), stats), n]).astype(np.int32), np.concatenate([none, tid]), np.concatenate([none, pos]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "n", "tid", "pos"])


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(tid, spot): the places of anchors that occur twice or more, spot = 2 * pos + 1 if the gram is hot, else 2 * pos."""

    def settle(gram, n, tid, pos) -> tuple[np.ndarray, np.ndarray]:
        """Whole groups of one gram each."""
        known = n == -1
        place = n == 0
        place[1:] &= ~((gram[1:] == gram[:-1]) & (tid[1:] == tid[:-1]) & (pos[1:] == pos[:-1]) & (n[:-1] == 0))  # a repeated row
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        group = np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]]))
        stats = np.where(n > 0, n, 0)
        total = np.add.reduceat(stats, first)
        marked = np.maximum.reduceat((n <= -_MARK_ALL).astype(np.int8), first) > 0
        live = (total > 0) | marked | (np.add.reduceat(place.astype(np.int64), first) > 1)
        hot = marked | (total >= HOT)
        keep = known | (place & live[group])
        return tid[keep], 2 * pos[keep].astype(np.int64) + (hot[group] | known)[keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            columns = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            # the last gram may go on in the next batch
            end = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            rest = [c[end:] for c in columns]
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in settle(*(c[:end] for c in columns))], names=["tid", "spot"])
        if len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in settle(*rest)], names=["tid", "spot"])

    return rows.repartition("gram").sortWithinPartitions("gram", "n", "tid", "pos").mapInArrow(run, "tid long, spot long")


@dataclass
class Context:
    """The windows of one anchor: `windows` of them from `start` on."""

    key: bytes
    start: int
    windows: int
    body: bytes
    several: bool = False


def contexts_of(key: bytes, raw: bytes, spots: np.ndarray, anchors: Anchors) -> Iterator[tuple[int, bool, Context]]:
    """(gram, hot, context) of the repeated anchors of a text. spots: of repeated_anchors(), for this text among others."""
    at, grams, first = anchors.of(raw)
    spots = np.sort(spots)
    place = np.minimum(np.searchsorted(spots, 2 * at), len(spots) - 1)
    live = spots[place] >> 1 == at
    hot = spots[place] & 1 == 1
    stop = np.append(first[1:], len(raw) - anchors.length + 1)
    for i in np.flatnonzero(live).tolist():
        a, b = int(first[i]), int(stop[i])
        yield int(grams[i]), bool(hot[i]), Context(key, a, b - a, raw[a : b - 1 + anchors.length])


_ROWS = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("key", pa.binary()), ("start", pa.int64()), ("windows", pa.int32()), ("body", pa.binary())])
#: Kinds of rows: a context; the name of a window of a hot bucket; windows that are known to be repeated. _SEVERAL is added to a context or name that stands for more than one.
_CONTEXT, _NAME, _DONE, _SEVERAL = 0, 1, 2, 4


def context_rows(candidates: DataFrame, length: int) -> DataFrame:
    """Rows for the tasks that sort: a context goes to its anchor's bucket, unless the anchor is hot; then each of its windows goes by its name of 16 bytes. Equal contexts, and equal names, of a batch are sent once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        held, size = [], 0
        for batch in batches:
            for key, text, spots in zip(batch.column("_key"), batch.column("text"), batch.column("spots"), strict=True):
                for found in contexts_of(key.as_py(), text.as_py().encode(), spots.values.to_numpy(), anchors):
                    held.append(found)
                    size += len(found[2].body) + 100
                    if size >= BLOCK_BYTES:
                        yield from _packed(_reduced(held, length))
                        held, size = [], 0
        if held:
            yield from _packed(_reduced(held, length))

    return candidates.mapInArrow(run, "bucket long, kind byte, key binary, start long, windows int, body binary")


def _reduced(held: list[tuple[int, bool, Context]], length: int) -> Iterator[tuple]:
    once: dict[tuple[int, bytes], Context] = {}
    hot: dict[tuple[int, bytes], Context] = {}
    done: list[tuple[bytes, int, int]] = []
    for gram, is_hot, c in held:
        first = (hot if is_hot else once).setdefault((gram, c.body), c)
        if first is not c:
            done.append((c.key, c.start, c.windows))
            if not first.several:
                first.several = True
                done.append((first.key, first.start, first.windows))
    for (gram, _), c in once.items():
        yield gram, _CONTEXT + _SEVERAL * c.several, c.key, c.start, c.windows, c.body
    names: dict[bytes, list] = {}
    for c in hot.values():
        for k in range(c.windows):
            name = hashlib.blake2b(c.body[k : k + length], digest_size=16).digest()
            known = names.get(name)
            if known is None:
                names[name] = [c.key, c.start + k, c.several]
                continue
            if not known[2]:
                known[2] = True
                done.append((known[0], known[1], 1))
            if not c.several:
                done.append((c.key, c.start + k, 1))
    for name, (key, start, several) in names.items():
        yield _short(name), _NAME + _SEVERAL * several, key, start, 1, name
    for key, start, windows in done:
        yield _short(key) + 31 * start, _DONE, key, start, windows, b""


def _packed(rows: Iterable[tuple], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(((r[0] + (1 << 63)) % (1 << 64) - (1 << 63), *r[1:]))
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROWS, strict=True)], schema=_ROWS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROWS, strict=True)], schema=_ROWS)


def repeated_windows(rows: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, run): runs of windows that occur twice or more; run = start * 2^20 + number of windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= block_bytes:
                    yield from _runs(held, length)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[5]) + 60
        if held:
            yield from _runs(held, length)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key binary, run long")


def _runs(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """The repeated windows of a block of whole buckets."""
    out: list[tuple[bytes, int]] = []

    def add(row: tuple, start: int, windows: int) -> None:
        if not row[1] & _SEVERAL:  # places of the others are done
            out.append((row[2], start << 20 | windows))

    distinct: dict[tuple[int, int, bytes], tuple] = {}
    several: set[tuple[int, int, bytes]] = set()
    for row in rows:
        bucket, kind, _, start, windows, body = row
        if kind == _DONE:
            add(row, start, windows)
            continue
        at = (bucket, kind & ~_SEVERAL, body)
        first = distinct.setdefault(at, row)
        if first is not row:
            if at not in several or first[1] & _SEVERAL:
                add(first, first[3], first[4])
            add(row, start, windows)
            several.add(at)
        elif kind & _SEVERAL:
            several.add(at)
    # equal contexts are one from here on; what is left to find are windows that different contexts of a bucket share
    sharing: dict[int, list] = {}
    for at, row in distinct.items():
        if at[1] == _CONTEXT:
            sharing.setdefault(at[0], []).append((at, row))
    groups = [(n, g) for n, g in enumerate(sharing.values()) if len(g) > 1]
    for part in _parts(groups):
        contexts = [row for _, _, row in part]
        found = repeated([r[5] for r in contexts], np.array([r[4] for r in contexts]), np.array([n for n, _, _ in part]), length)
        for (_, at, row), flags in zip(part, found, strict=True):
            if at in several or not flags.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                add(row, row[3] + a, b - a)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([r for _, r in out], pa.int64())], names=["key", "run"])


def _parts(groups: list[tuple[int, list]], most: int = BLOCK_BYTES) -> Iterator[list]:
    """Whole buckets, as many as stay within the bytes of a block."""
    part, size = [], 0
    for n, group in groups:
        if part and size >= most:
            yield part
            part, size = [], 0
        part += [(n, at, row) for at, row in group]
        size += sum(len(row[5]) for _, row in group)
    if part:
        yield part


def removal(raw: bytes, runs: np.ndarray, length: int) -> tuple[int, int, list[bytes]]:
    """(bytes removed, spans removed, parts kept) of a text. runs: of repeated_windows()."""
    start = np.sort(runs)
    stop = np.maximum.accumulate((start >> 20) + (start & (1 << 20) - 1) + length - 1)
    start >>= 20
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    start, stop = start[new], stop[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stop) - 1]])]
    kept = [raw[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(raw)], strict=True)]
    return int((stop - start).sum()), len(start), kept


def deduplicate(docs: DataFrame, length: int = LENGTH, texts_too: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents (doc_id, text), each byte gone that a string of
    `length` bytes covers which also starts anywhere else in the table; texts_too adds the bytes that are left (kept).

    length: a multiple of 8, 16 or more. Strings are judged on the input; matches lie within one text's UTF-8 bytes, may
    overlap, and the other one may lie in the same text. A text that other rows have as well goes as a whole if it is long
    enough, and only one of them is sorted. Null counts as empty; null ids and repeated rows each get their row; repeated
    rows are copies of each other. Other columns may have any names, and an empty table gives an empty one.
    """
    if length < 16 or length % 8:
        raise ValueError("length: a multiple of 8, from 16 on")
    whole = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    groups = copy_groups(keyed.select("doc_id", "_key"))
    texts = one_of_each(keyed.filter(F.octet_length("text") >= length), groups)
    spots = repeated_anchors(anchor_rows(texts.select("_key", F.col("text").cast("binary").alias("raw")), length))
    spots = spots.groupBy(F.col("tid").alias("_tid")).agg(F.collect_list("spot").alias("spots"))  # of one text
    candidates = texts.select("_key", "text", _tid().alias("_tid")).join(spots, "_tid").dropDuplicates(["_tid", "_key"]).select("_key", "text", "spots")
    candidates = cut(candidates, "candidates", "zstd")
    runs = repeated_windows(context_rows(candidates, length), length)
    runs = runs.groupBy(F.col("key").alias("_key")).agg(F.collect_list("run").alias("runs"))  # of one text

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text"), batch.column("runs"), strict=True):
                gone, spans, kept = removal(text.as_py().encode(), own.values.to_numpy(), length)
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                out.append((gone, spans, digest.hexdigest(), b"".join(kept) if texts_too else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("_key"), *columns], names=["_key", "_removed", "_spans", "_sha", "_kept"])

    parts = candidates.select("_key", "text").join(runs, "_key").mapInArrow(judge, "_key binary, _removed long, _spans long, _sha string, _kept binary")
    rows = docs.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("_whole"), *([whole.cast("binary").alias("_text")] if texts_too else []))
    rows = rows.withColumn("_key", F.substring(F.unhex("_whole"), 1, 16))
    rows = lookup(rows, groups, ["_key"]).join(parts, "_key", "left")
    copied = F.col("_copies").isNotNull() & (F.col("n_bytes") >= length)
    pick = lambda all_, some, none: F.when(copied, all_).when(F.col("_removed").isNotNull(), some).otherwise(none)
    columns = [
        pick(F.col("n_bytes"), F.col("_removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("_sha"), F.col("_whole")).alias("kept_sha256"),
    ]
    return rows.select("doc_id", "n_bytes", *columns, *([pick(F.lit(b""), F.col("_kept"), F.col("_text")).alias("kept")] if texts_too else []))
