"""Which lines and files a scan looks at."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import extension, trim

# Directory names that are never scanned, by group.
FILTERED_DIRECTORIES = (
    "target",
    "node_modules", "dist", "build", ".next", ".nuxt",
    "__pycache__", ".pytest_cache", "venv", ".venv", "env", ".env",
    "vendor",
    "out",
    "cache", ".cache", "tmp", ".tmp", "temp", ".temp",
    ".git", ".svn", ".hg",
    ".vscode", ".idea", ".vs",
    "coverage", ".nyc_output",
)

# Extensions of binary files.
BINARY_EXTENSIONS = tuple(
    "png jpg jpeg gif bmp ico webp tiff tif avif heic heif dng raw nef cr2 arw orf rw2 "
    "pdf doc docx xls xlsx ppt pptx odt ods odp indd "
    "zip tar gz bz2 xz 7z rar dmg iso ace cab lzh arj br zst lz4 lzo lzma "
    "exe dll so dylib bin app deb rpm o obj lib a pdb exp ilk "
    "mp3 wav ogg flac aac mp4 avi mkv mov wmv webm mp2 m4a wma amr "
    "ttf otf woff woff2 eot "
    "gpg pgp p12 pfx der crt keystore "
    "db sqlite sqlite3 mdb sst ldb wal snap dat sas7bdat sas7bcat "
    "dwg dxf skp 3ds max blend fbx "
    "gcno gcda gcov wasm webc img vhd vmdk qcow2 "
    "pyc pyo class jar war ear swf fla nxt com bat cmd "
    "bas pic b mcw ind dsk z gdiff srt zeno cba parquet avro orc pak rpak toast data".split()
)

# Path globs that are ignored by default.
IGNORED_PATHS = ("tests/*", "testdata/*", "__tests__/*", "test/*", "*_test.rs", "test_*.rs", "test_*.py", "*_test.py", "*.test.ts", "*.test.js", "*.spec.ts", "*.spec.js")

# Markers of lines to ignore, and of test code.
IGNORED_SUBSTRINGS = ("# TEST_SECRET:", "DEMO_KEY_", "FAKE_")
TEST_ATTRIBUTES = ("#[*test]", "#[bench]", "#[cfg(test)]", "def test_*", "class Test*", "@pytest.*", "it(*", "test(*", "describe(*")
TEST_MODULES = ("mod tests {", "mod test {", "class Test", "describe(", "__tests__")

#: Directives in comments. The last one also covers the line after it.
IGNORE_COMMENTS = ("scan:ignore", "scan:ignore-line", "scan:ignore-next")
IGNORE_NEXT = "scan:ignore-next"

MIB = 1 << 20


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(line: Column, parts: Iterable[str]) -> Column:
    return any_of(line.contains(p) for p in parts)


def contains_one(line: Column, parts: Iterable[str]) -> Column:
    """The same for long lists, as a search in a constant array."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(line, p))


def one_star(text: Column, glob: str) -> Column:
    """With exactly one star: what stands before it starts the text and what stands behind ends it (they may overlap). Else equality."""
    if glob.count("*") != 1:
        return text == glob
    head, tail = glob.split("*")
    return text.startswith(head) & text.endswith(tail)


def marker_texts(attributes: Iterable[str], modules: Iterable[str]) -> list[str] | None:
    """Texts one of which every line with a marker holds; None if a marker has no text."""
    parts = [max(g.split("*"), key=len) if g.count("*") == 1 else g for g in attributes] + list(modules)
    return list(dict.fromkeys(parts)) if all(parts) else None


def test_line(line: Column, attributes: Iterable[str] = TEST_ATTRIBUTES, modules: Iterable[str] = TEST_MODULES) -> Column:
    """Whether the trimmed line matches an attribute's glob or holds a module's marker. Lines are trimmed only where they hold a marker's text."""
    attributes, modules = list(attributes), list(modules)
    texts = marker_texts(attributes, modules)
    bare = trim(line)
    full = any_of(one_star(bare, g) for g in attributes) | contains_any(bare, modules)
    return full if texts is None else contains_one(line, texts) & full


def ignored_next(previous: Column, directive: str = IGNORE_NEXT) -> Column:
    """Whether the line before holds the directive; the first line has none before it."""
    return F.coalesce(previous.contains(directive), F.lit(False))


def glob_regex(glob: str) -> str:
    """A glob over whole paths as a regular expression: stars and question marks also stand for slashes; **/ may be empty."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_regex(x)[6:-2] for x in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def matches_glob(path: Column, globs: Iterable[str]) -> Column:
    return any_of(F.rlike(path, F.lit(glob_regex(g))) for g in globs)


def in_filtered_directory(path: Column, names: Iterable[str] = FILTERED_DIRECTORIES) -> Column:
    """Whether a component of a path below the root is one of the names; the last one, a file's own name, counts as well."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def binary_extension(path: Column, extensions: Iterable[str] = BINARY_EXTENSIONS) -> Column:
    return F.coalesce(extension(path).isin(list(extensions)), F.lit(False))


def binary_content(content: Column) -> Column:
    """From the first 512 bytes: a zero byte without a UTF-16 or UTF-32 mark before it, or the mark of a PDF."""
    head = F.hex(F.substring(content, 1, 512))
    marked = F.rlike(head, F.lit("^(?:EFBBBF|FFFE|FEFF|0000FEFF)"))
    return ~marked & (F.rlike(head, F.lit("^(?:..)*?00")) | head.startswith("25504446"))


def too_large(length: Column, most_mib: int = 10) -> Column:
    return F.floor(length / MIB) > most_mib


def streamed(length: Column, whole_mib: int = 5) -> Column:
    """Files that are read line by line: no test blocks and no directive for the next line apply to them."""
    return F.floor(length / MIB) > whole_mib
