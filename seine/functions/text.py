"""Small scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming removes: Unicode white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def lines_of(text: Column) -> Column:
    """The lines of a text: cut at line feeds, less one carriage return at each end, and no empty last line."""
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda s: F.when(s.endswith("\r"), F.substring(s, F.lit(1), F.char_length(s) - 1)).otherwise(s))


def indent(line: Column) -> Column:
    """Bytes of leading white space."""
    return F.octet_length(line) - F.octet_length(F.ltrim(line, F.lit(_SPACE)))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def csv_quoted(text: Column) -> Column:
    """A trimmed text between quotes, its quotes doubled."""
    return F.concat(F.lit('"'), F.replace(trim(text), F.lit('"'), F.lit('""')), F.lit('"'))


def section_id(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("-")))


def extension(path: Column) -> Column:
    """What follows the last dot of the last component, in lower case; null without one. A leading dot starts no extension."""
    found = F.regexp_extract(path, r"(?s)[^/]\.([^./]*)\z", 1)
    return F.when(F.rlike(path, F.lit(r"(?s)[^/]\.[^./]*\z")), F.lower(found))


def immutable_version(version: Column) -> Column:
    """Tags like v1, full or short commit hashes, and numbers with a dot."""
    return F.rlike(version, F.lit(r"\Av[0-9]")) | F.rlike(version, F.lit(r"\A[0-9a-fA-F]{7,40}\z")) | (F.rlike(version, F.lit(r"\A[0-9]")) & version.contains("."))


def repo_name(url: Column) -> Column:
    """The last segment of a repository URL, less trailing slashes and .git endings."""
    bare = F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), r"(?:\.git)+\z", "")
    return F.element_at(F.split(bare, "/"), -1)


def scan_time(ms: Column) -> Column:
    """Under ten seconds in milliseconds; else seconds, with minutes before them from one minute on."""
    seconds = F.format_string("%d.%03ds", F.floor(ms / 1000) % 60, ms % 1000)
    minutes = F.floor(ms / 60000)
    return F.when(ms < 10_000, F.concat(ms.cast("string"), F.lit("ms"))).when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), seconds)).otherwise(seconds)


def shown_path(path: Column) -> Column:
    """The last 37 bytes after three dots, for paths of more than 40 bytes."""
    raw = path.cast("binary")
    return F.when(F.octet_length(path) > 40, F.concat(F.lit("..."), F.substring(raw, F.octet_length(path) - 36, F.lit(37)).cast("string"))).otherwise(path)


def workers(cores: Column, percent: Column, most: Column) -> Column:
    """A percentage of the cores, one at least, and at most `most` if that is above 0."""
    share = F.greatest(F.lit(1), F.floor(cores * percent / 100))
    return F.when(most > 0, F.least(share, most)).otherwise(share).cast("int")


def adapted_workers(items: Column, most: Column, least: int = 1) -> Column:
    """Workers for so many items: two, half, three quarters or all of `most`. least=0 keeps a result of 0."""
    n = F.when(items <= 10, F.least(F.lit(2), most)).when(items <= 50, F.floor(most / 2)).when(items <= 100, F.floor(most * 3 / 4)).otherwise(most)
    return F.greatest(F.lit(least), n).cast("int")


def hook_workers(commands: Column, most: Column) -> Column:
    return F.least(adapted_workers(commands, most), commands, F.lit(8)).cast("int")


def commit_message(raw: Column) -> Column:
    """The lines that do not start with #, joined and trimmed."""
    return trim(F.array_join(F.filter(lines_of(raw), lambda s: ~s.startswith("#")), "\n"))


_COMMIT = r"(?s)\A([A-Za-z][A-Za-z0-9_-]*)(?:\(([^()\n]+)\))?(!)?: *(\S[^\n]*)(?:\z|\n)"


def commit_type(message: Column) -> Column:
    """The type of a conventional commit message; null if it is none."""
    return F.when(F.rlike(message, F.lit(_COMMIT)), F.lower(F.regexp_extract(message, _COMMIT, 1)))


def commit_scope(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, _COMMIT, 2), F.lit(""))
