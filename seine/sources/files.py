"""Files and path lists as sources."""

from __future__ import annotations

import os
import re
import stat
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import BINARY_EXTENSIONS, FILTERED_DIRECTORIES, IGNORED_PATHS, binary_content, binary_extension, in_filtered_directory, matches_glob, too_large
from .written import dealt_by_task, shared_folder, shared_out, written


LISTING = "path string, rel_path string, length long, modified timestamp"
_WALKED = f"{LISTING}, kind string, message string"
#: Names of ignore files in any folder; later ones outrank earlier ones. Below the root of a repository also the exclude file.
IGNORE_FILES = (".gitignore", ".ignore")
EXCLUDE_FILE = ".git/info/exclude"
#: Where folder_tree keeps files that are not yet committed; no walk looks into it.
STAGING = ".seine-staging"


class Walker:
    """Lists folders as ignore files and directory names allow; made anew in every task.

    Ignore files of a folder hold for what is below it; the deepest outranks the others, and its last fitting line
    decides. What an ignored folder holds cannot be taken back. Ignore files of the root's own parents count up to the
    repository that holds it, and `rules` (lines of a global ignore file) rank last.
    """

    def __init__(self, uri: str, ignore_files: bool = True, follow_symlinks: bool = False, rules: Sequence[str] = (), directories: Sequence[str] = ()):
        self.fs, self.top = pafs.FileSystem.from_uri(uri)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self.ignore_files, self.follow, self.directories = ignore_files, follow_symlinks, frozenset(directories)
        self.base = self._repository() if ignore_files else self.top
        self.common = [(drop, re.compile(x), only) for drop, x, only in entry_rules(rules)]
        self.known: dict[str, list] = {}
        self.ranked: tuple[str | None, list] = (None, [])

    def _exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pafs.FileType.NotFound

    def _repository(self) -> str:
        """The root, or the folder above it that holds .git."""
        folder = self.top
        while True:
            try:
                if self._exists(f"{folder}/.git"):
                    return folder
            except OSError:
                return self.top
            above = folder.rsplit("/", 1)[0]
            if not above or above == folder:
                return self.top
            folder = above

    def _rules(self, folder: str) -> list[tuple[bool, re.Pattern, bool]]:
        if folder not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            lines: list[str] = []
            for name in ([EXCLUDE_FILE] if folder == self.base else []) + list(IGNORE_FILES):
                try:
                    with self.fs.open_input_stream(f"{folder}/{name}") as f:
                        lines += f.read().decode(errors="replace").splitlines()
                except OSError:
                    pass
            self.known[folder] = [(drop, re.compile(x), only) for drop, x, only in entry_rules(lines)]
        return self.known[folder]

    def _ranked(self, folder: str) -> list[tuple[int, tuple[bool, re.Pattern, bool]]]:
        """The rules that count for a folder's entries, the strongest first, each with where the part of a path begins that it is about."""
        if self.ranked[0] != folder:
            out, above = [], folder
            while len(above) >= len(self.base):
                out += [(len(above) + 1, rule) for rule in reversed(self._rules(above))]
                if above == self.base:
                    break
                above = above.rsplit("/", 1)[0]
            self.ranked = folder, out + [(len(self.base) + 1, rule) for rule in reversed(self.common)]
        return self.ranked[1]

    def ignored(self, path: str, is_folder: bool) -> bool:
        """Whether an entry of a folder that is not ignored is."""
        if not self.ignore_files:
            return False
        return next((drop for at, (drop, regex, only) in self._ranked(path.rsplit("/", 1)[0]) if (is_folder or not only) and regex.match(path, at)), False)

    def _found(self, folder: str) -> Iterator[tuple[str, bool, int, int | None]]:
        """(path, is a folder, length, modified in microseconds) of a folder's entries; a local folder is never held as a whole."""
        if not self.local:
            for f in self.fs.get_file_info(pafs.FileSelector(folder)):
                if f.type in (pafs.FileType.File, pafs.FileType.Directory):
                    yield f.path, f.type == pafs.FileType.Directory, f.size, f.mtime_ns and f.mtime_ns // 1000
            return
        with os.scandir(folder) as found:
            for f in found:
                try:
                    known = f.stat()
                    link = f.is_symlink()
                except OSError:
                    continue
                is_folder = stat.S_ISDIR(known.st_mode)
                if not is_folder and not stat.S_ISREG(known.st_mode):
                    continue
                if link:
                    real = os.path.realpath(f.path)
                    if not self.follow or (is_folder and f"{os.path.realpath(folder)}/".startswith(f"{real}/")):
                        continue  # a link to a folder above would go on for ever
                yield f.path, is_folder, None if is_folder else known.st_size, known.st_mtime_ns // 1000

    def entries(self, folder: str) -> Iterator[tuple]:
        """Rows of _WALKED: a folder's files and folders, or what kept it from being listed."""
        try:
            for path, is_folder, length, modified in self._found(folder):
                name = path.rsplit("/", 1)[1]
                if not (is_folder and (name in self.directories or name == STAGING)) and not self.ignored(path, is_folder):
                    yield path, path[len(self.top) :].lstrip("/"), length, modified, "folder" if is_folder else "file", None
        except OSError as e:
            yield folder, folder[len(self.top) :].lstrip("/"), None, None, "error", f"Walk error: {folder}: {e.strerror or e}"


def _table(rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "rel_path", "length", "modified", "kind", "message"])


def as_uri(root: str) -> str:
    return root if "://" in root else f"file://{os.path.abspath(root)}"


#: Entries that a task lists before it hands back the folders that are left: in the first round, and later.
FIRST_ENTRIES, ENTRIES = 64, 4096
#: Rows of a listing that a task gives out at a time, and in a file of it.
LISTED, LISTED_FILE = 10_000, 200_000


def walk_all(spark: SparkSession, root: str, entries: int = ENTRIES, **rules) -> DataFrame:
    """Rows of files, folders and errors below a root: path, rel_path, length, modified, kind, message. rules: see Walker.

    Spark's own file sources leave out names that start with a dot or an underscore, so folders are listed by Arrow. The
    walk goes in rounds: folders are dealt out, a task goes down from those it has until it has listed so many entries,
    and hands back what is left; the next round deals these out anew, whatever the tree's shape. Each round is written, so
    a listing is made once however often it is read. A task holds some entries of a folder (of a folder that is not on a
    local file system, all) and the folders it has not yet listed. The walk runs when this is called. No content but that of ignore files is read.
    """
    uri = as_uri(root)

    def lister(most: int):
        def some(batches):
            walker, listed = Walker(uri, **rules), 0
            for batch in batches:
                held = batch.column("path").to_pylist()[::-1]
                while held and listed < most:
                    entries = walker.entries(held.pop())
                    listed += 1
                    while rows := list(islice(entries, LISTED)):
                        listed += len(rows)
                        held += [r[0] for r in rows if r[4] == "folder"]
                        yield _table(rows)
                if held:
                    yield _table([(f, f[len(walker.top) :].lstrip("/"), None, None, "open", None) for f in held])

        return some

    tasks = 4 * spark.sparkContext.defaultParallelism
    folder, paths = shared_folder(spark), []
    left = spark.createDataFrame([(pafs.FileSystem.from_uri(uri)[1],)], "path string")
    while True:
        paths.append(f"{folder}/{len(paths)}")
        rows = written(left.mapInArrow(lister(entries if len(paths) > 1 else min(entries, FIRST_ENTRIES)), _WALKED), paths[-1], LISTED_FILE)
        left = rows.filter("kind = 'open'").select("path")
        n = left.count()
        if not n:
            return spark.read.schema(rows.schema).parquet(*paths).filter("kind != 'open'")
        left = left.repartition(min(n, tasks))


def walk(spark: SparkSession, root: str, **rules) -> DataFrame:
    """(path, rel_path, length, modified) of all regular files below a root, hidden ones included."""
    return walk_all(spark, root, **rules).filter("kind = 'file'").drop("kind", "message")


def with_content(files: DataFrame, root: str, batch_bytes: int = 32 << 20) -> DataFrame:
    """files plus content, read where the listing says; null for a file that cannot be read. Batches stay below a bound, but for single files beyond it."""
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"
    names = files.columns

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            start, held, size = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with fs.open_input_stream(path) as f:
                        held.append(f.read())
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= batch_bytes or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*names, "content"])
                    start, held, size = i + 1, [], 0

    return files.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def write_files(rows: DataFrame, root: str) -> None:
    """Write each row (rel_path, content: binary) as a file below a root. A file gets its name once it is whole; a task that is run again writes the same files. folder_tree.write_tree writes all files or none."""
    uri = as_uri(root)

    def write(batches):
        fs, top = pafs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder = f"{top}/{name}".rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder) if len(made) < 100_000 else made.clear()
                beside = f"{top}/{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(beside) as f:
                    f.write(content)
                fs.move(beside, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("rel_path")], names=["rel_path"])

    rows.select("rel_path", "content").mapInArrow(write, "rel_path string").write.format("noop").mode("overwrite").save()


def entry_rules(lines: Iterable[str]) -> list[tuple[bool, str, bool]]:
    """(ignored, expression, folders only) for each rule of an ignore file; the expression fits an entry's whole path below the file's folder; later rules win."""
    out = []
    for line in lines:
        rule = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
        if not rule or rule.startswith("#"):
            continue
        keep, rule = (True, rule[1:]) if rule.startswith("!") else (False, rule)
        only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
        if not rule:
            continue
        anchored, at = "/" in rule, 0
        rule = rule.lstrip("/")
        body = ""
        while at < len(rule):
            rest = rule[at:]
            if rest.startswith("**/") and (at == 0 or rule[at - 1] == "/"):
                body, at = body + "(?:.*/)?", at + 3
            elif rest == "**" and at and rule[at - 1] == "/":
                body, at = body + ".+", at + 2
            elif rest[0] == "*":
                body, at = body + "[^/]*", at + 1
            elif rest[0] == "?":
                body, at = body + "[^/]", at + 1
            elif rest[0] == "[" and "]" in rest[2:]:
                end = rest.index("]", 2)
                inside = rest[1:end].replace("\\", "\\\\").replace("[", "\\[")
                body, at = body + f"(?!/)[{'^' + inside[1:] if inside[0] == '!' else inside}]", at + end + 1
            elif rest[0] == "\\" and len(rest) > 1:
                body, at = body + re.escape(rest[1]), at + 2
            else:
                body, at = body + re.escape(rest[0]), at + 1
        out.append((not keep, rf"(?s){'' if anchored else '(?:.*/)?'}{body}\Z", only_dirs))
    return out


def ignore_rules(lines: Iterable[str]) -> list[tuple[bool, str]]:
    """(ignored, expression) for each rule, for the paths of files below the ignore file's folder, in the engine's dialect."""
    return [(drop, rf"\A{x[:-2]}{'/.*' if only else '(?:/.*)?'}\z") for drop, x, only in entry_rules(lines)]


def ignored_by_rules(rel_path: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    ignored = F.lit(False)
    for drop, regex in rules:
        ignored = F.when(F.rlike(rel_path, F.lit(regex)), F.lit(drop)).otherwise(ignored)
    return ignored


def scannable(files: DataFrame, ignore: Sequence[str] = IGNORED_PATHS, directories: Sequence[str] = FILTERED_DIRECTORIES, extensions: Sequence[str] = BINARY_EXTENSIONS, most_mib: int = 10, include_binary: bool = False, rules: Sequence[tuple[bool, str]] = ()) -> DataFrame:
    """files of a listing, less those that directory names or ignore rules leave out, with is_ignored, is_large and is_binary (by extension).

    Those three stay as flags: such files count as scanned, without findings. All three follow from the listing alone.
    """
    kept = files.filter(~in_filtered_directory(F.col("rel_path"), directories)) if directories else files
    if rules:
        kept = kept.filter(~ignored_by_rules(F.col("rel_path"), rules))
    binary = F.lit(False) if include_binary else binary_extension(F.col("rel_path"), extensions)
    return kept.withColumns({"is_ignored": matches_glob(F.col("rel_path"), ignore), "is_large": too_large(F.col("length"), most_mib), "is_binary": binary})


def skipped() -> Column:
    """Whether a flagged file is not read."""
    return F.col("is_ignored") | F.col("is_large") | F.col("is_binary")


def dealt_by_bytes(files: DataFrame) -> DataFrame:
    """Listed files dealt out to tasks of about equal bytes, consecutive paths together; see shared_out()."""
    return dealt_by_task(shared_out(files, ["rel_path", "path"], F.coalesce("length", F.lit(0))))


def decoded(files: DataFrame, root: str, include_binary: bool = False, balanced: bool = False) -> DataFrame:
    """Flagged files plus text and success. Only files without a flag are read; invalid UTF-8, or a file that cannot be read, makes no text and no success.

    Read files whose first bytes look binary are flagged as well. balanced: files are dealt out by their bytes first.
    """
    skip = skipped()
    none = F.lit(None).cast("string")
    unread = files.filter(skip).withColumns({"text": none, "success": F.lit(True)})
    read = files.filter(~skip)
    read = with_content(dealt_by_bytes(read) if balanced else read, root)
    looks = F.lit(False) if include_binary else F.coalesce(binary_content(F.col("content")), F.lit(False))
    read = read.withColumn("is_binary", looks).withColumn("text", F.when(~F.col("is_binary"), F.try_validate_utf8(F.col("content").cast("string"))))
    return unread.unionByName(read.withColumn("success", F.col("is_binary") | F.col("text").isNotNull()).drop("content"))


def fast_count(files: DataFrame, most_mib: int = 10, directories: Sequence[str] = FILTERED_DIRECTORIES) -> DataFrame:
    """One row, files: an estimate from the listing alone; directory names are not held against a file's own name."""
    parts = F.split("rel_path", "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return files.filter(~F.arrays_overlap(above, F.array(*[F.lit(d) for d in directories])) & ~too_large(F.col("length"), most_mib)).agg(F.count(F.lit(1)).alias("files"))


def listed(paths: DataFrame, root: str) -> DataFrame:
    """The listing's columns of an explicit list of paths (path) below a root, without a walk; paths that are no files are left out."""
    uri = as_uri(root)

    def look(batches):
        fs, top = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            found = (f for f in fs.get_file_info(batch.column("path").to_pylist()) if f.type == pafs.FileType.File)
            yield _table([(f.path, f.path[len(top) :].lstrip("/") if f.path.startswith(top) else f.path, f.size, f.mtime_ns // 1000, "file", None) for f in found])

    return paths.select("path").distinct().mapInArrow(look, _WALKED).drop("kind", "message")


def from_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files of an explicit list of paths (path), such as staged files; no binary test applies to them."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")


# Directories whose entry in an ignore file is checked, with what they are.
ANALYZED_DIRECTORIES = (
    ("target", "Rust build directory"),
    ("node_modules", "Node.js dependencies"),
    ("dist", "Build output directory"),
    ("build", "Build output directory"),
    ("__pycache__", "Python cache directory"),
    ("venv", "Python virtual environment"),
    (".venv", "Python virtual environment"),
    ("vendor", "Go dependencies"),
)


def directory_analysis(spark: SparkSession, present: DataFrame, rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(dir, description, status) of known directories that are present (name): properly_ignored if the ignore file's
    lines (line) hold the name, with or without a slash; else needs_gitignore. by: columns of both that tell repositories apart."""
    by = list(by)
    known = F.broadcast(spark.createDataFrame([*ANALYZED_DIRECTORIES], "name string, description string"))
    bare = rules.select(*by, F.trim("line").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#")).select(*by, F.regexp_replace("line", "/$", "").alias("name"), F.lit(True).alias("_ignored")).distinct()
    joined = present.select(*by, "name").distinct().join(known, "name").join(bare, [*by, "name"], "left")
    return joined.select(*by, F.concat("name", F.lit("/")).alias("dir"), "description", F.when(F.col("_ignored"), "properly_ignored").otherwise("needs_gitignore").alias("status"))
