"""Staged files of repositories, from their folders alone: the entries of the index against the tree of the last commit.

Both are tables with a row for each path, read repository by repository and compared by a join. Index files of versions
2 to 4, loose and packed objects, deltas, packed and detached references are read; no process is started.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import as_uri

_KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
_ROWS = "repo string, rel_path string, id string, mode int, stage int"
#: Bits of an index entry's flags: it has more flags; it is a place holder for a file that is to be added.
_EXTENDED, _INTENT = 0x4000, 0x2000
_PIECE = 1 << 16


def index_entries(raw: bytes) -> Iterator[tuple[str, str, int, int]]:
    """(path, object, mode, stage) of an index file; place holders of files that are to be added are left out."""
    if raw[:4] != b"DIRC" or not 2 <= (version := int.from_bytes(raw[4:8], "big")) <= 4:
        raise ValueError("not an index file of version 2, 3 or 4")
    at, name = 12, b""
    for _ in range(int.from_bytes(raw[8:12], "big")):
        start = at
        mode, oid, flags = int.from_bytes(raw[at + 24 : at + 28], "big"), raw[at + 40 : at + 60], int.from_bytes(raw[at + 60 : at + 62], "big")
        at += 62
        more = 0
        if version >= 3 and flags & _EXTENDED:
            more = int.from_bytes(raw[at : at + 2], "big")
            at += 2
        if version == 4:
            # a name is the one before, less so many bytes, and what follows
            less, at = _offset(raw, at)
            end = raw.index(0, at)
            name = name[: len(name) - less] + raw[at:end]
            at = end + 1
        else:
            end = raw.index(0, at)
            name = raw[at:end]
            at = start + (end - start + 8) // 8 * 8
        if not more & _INTENT:
            yield name.decode("utf-8", "surrogateescape"), oid.hex(), mode, flags >> 12 & 3


def _offset(raw: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, each but the last one counted up by one; and the place behind it."""
    value = raw[at] & 0x7F
    while raw[at] & 0x80:
        at += 1
        value = (value + 1 << 7) | (raw[at] & 0x7F)
    return value, at + 1


def patched(base: bytes, delta: bytes) -> bytes:
    """A base with a delta applied: parts of the base and new bytes."""

    def size(at: int) -> int:
        while delta[at] & 0x80:
            at += 1
        return at + 1

    at, out = size(size(0)), bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            fields = [0, 0]
            for bit in range(7):
                if op >> bit & 1:
                    fields[bit // 4] |= delta[at] << 8 * (bit % 4)
                    at += 1
            start, n = fields
            out += base[start : start + (n or 0x10000)]
        else:
            out += delta[at : at + op]
            at += op
    return bytes(out)


class Objects:
    """The objects of a repository."""

    def __init__(self, fs: pafs.FileSystem, git: str):
        self.fs, self.git = fs, git
        self.packs: list[tuple[str, bytes]] | None = None

    def file(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.git}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def head(self) -> str | None:
        """The last commit; none in a repository without one."""
        at = (self.file("HEAD") or b"").decode().strip()
        if not at.startswith("ref: "):
            return at or None
        name = at[5:]
        if own := self.file(name):
            return own.decode().strip()
        packed = (self.file("packed-refs") or b"").decode().splitlines()
        return next((line.split(" ", 1)[0] for line in packed if line.endswith(f" {name}")), None)

    def read(self, oid: str) -> tuple[str, bytes]:
        """(kind, content) of an object."""
        if raw := self.file(f"objects/{oid[:2]}/{oid[2:]}"):
            head, _, body = zlib.decompress(raw).partition(b"\0")
            return head.split(b" ")[0].decode(), body
        if self.packs is None:
            found = self.fs.get_file_info(pafs.FileSelector(f"{self.git}/objects/pack", allow_not_found=True))
            self.packs = [(f.path[:-4] + ".pack", self.file(f"objects/pack/{f.base_name}")) for f in found if f.path.endswith(".idx")]
        for pack, idx in self.packs:
            place = _place(idx, bytes.fromhex(oid))
            if place is not None:
                return self._packed(pack, place)
        raise ValueError(f"{self.git}: no object {oid}")

    def _packed(self, pack: str, place: int) -> tuple[str, bytes]:
        deltas = []
        with self.fs.open_input_file(pack) as f:
            while True:
                f.seek(place)
                head = f.read(64)
                kind, at = head[0] >> 4 & 7, 0
                while head[at] & 0x80:
                    at += 1
                at += 1
                base: int | str | None = None
                if kind == 6:
                    back, at = _offset(head, at)
                    base = place - back
                elif kind == 7:
                    base, at = head[at : at + 20].hex(), at + 20
                f.seek(place + at)
                inflate, body = zlib.decompressobj(), b""
                while not inflate.eof:
                    body += inflate.decompress(f.read(_PIECE))
                if base is None:
                    name = _KINDS[kind]
                    break
                deltas.append(body)
                if isinstance(base, str):
                    name, body = self.read(base)
                    break
                place = base
        for delta in reversed(deltas):
            body = patched(body, delta)
        return name, body

    def files(self, tree: str) -> Iterator[tuple[str, str, int]]:
        """(path, object, mode) of all that a tree holds but trees."""
        left = [("", tree)]
        while left:
            above, oid = left.pop()
            body, at = self.read(oid)[1], 0
            while at < len(body):
                space, end = body.index(b" ", at), body.index(0, at)
                mode, name = int(body[at:space], 8), above + body[space + 1 : end].decode("utf-8", "surrogateescape")
                own, at = body[end + 1 : end + 21].hex(), end + 21
                if mode == 0o40000:
                    left.append((f"{name}/", own))
                else:
                    yield name, own, mode


def _place(idx: bytes, oid: bytes) -> int | None:
    """Where a pack holds an object, by its index of version 2."""
    if idx[:8] != b"\xfftOc\0\0\0\2":
        raise ValueError("not a pack index of version 2")
    count = lambda k: int.from_bytes(idx[8 + 4 * k : 12 + 4 * k], "big")
    n, low, high = count(255), count(oid[0] - 1) if oid[0] else 0, count(oid[0])
    names = 8 + 1024
    while low < high:
        middle = (low + high) // 2
        found = idx[names + 20 * middle : names + 20 * middle + 20]
        if found == oid:
            at = names + 24 * n + 4 * middle
            place = int.from_bytes(idx[at : at + 4], "big")
            if place >> 31:
                at = names + 28 * n + 8 * (place & 0x7FFFFFFF)
                place = int.from_bytes(idx[at : at + 8], "big")
            return place
        low, high = (middle + 1, high) if found < oid else (low, middle)
    return None


def _listed(repos: DataFrame, committed: bool) -> DataFrame:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo in batch.column("path").to_pylist():
                fs, top = pafs.FileSystem.from_uri(as_uri(repo))
                objects = Objects(fs, f"{top}/.git")
                if committed:
                    head = objects.head()
                    tree = objects.read(head)[1].split(b"\n", 1)[0][5:].decode() if head else None
                    rows = ((*f, 0) for f in objects.files(tree)) if tree else ()
                else:
                    rows = index_entries(objects.file("index") or b"DIRC\0\0\0\2\0\0\0\0")
                held = []
                for row in rows:
                    held.append((repo, *row))
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return repos.select("path").mapInArrow(read, _ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
    rows = [(repo, path.encode("utf-8", "surrogateescape").decode(errors="replace"), *rest) for repo, path, *rest in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["repo", "rel_path", "id", "mode", "stage"])


def staged_files(repos: DataFrame) -> DataFrame:
    """(repo, rel_path, change) of the repositories (path): what the next commit would add (A), change (M: content or mode) or delete (D), and paths with an unsettled merge (U)."""
    index = _listed(repos, False)
    settled = index.filter("stage = 0").select("repo", "rel_path", F.struct("id", "mode").alias("now"))
    head = _listed(repos, True).select("repo", "rel_path", F.struct("id", "mode").alias("before"))
    merging = index.filter("stage > 0").select("repo", "rel_path").distinct()
    both = settled.join(head, ["repo", "rel_path"], "full_outer").filter(~F.col("now").eqNullSafe(F.col("before")))
    change = F.when(F.col("before").isNull(), "A").when(F.col("now").isNull(), "D").otherwise("M")
    return both.join(merging, ["repo", "rel_path"], "left_anti").select("repo", "rel_path", change.alias("change")).unionByName(merging.withColumn("change", F.lit("U")))


def staged_paths(repos: DataFrame) -> DataFrame:
    """(path) of staged files that are there to be read, for Scanner.scan_paths."""
    return staged_files(repos).filter("change != 'D'").select(F.concat("repo", F.lit("/"), "rel_path").alias("path"))
