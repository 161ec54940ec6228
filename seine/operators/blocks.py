"""Test-code blocks in a file's lines, as a fold: a sequential walk, since a start inside a block is not looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import indent, trim
from .predicates import TEST_ATTRIBUTES, TEST_MODULES, contains_one, marker_texts, test_line

_RANGES = "array<struct<start_line:int,end_line:int>>"
_STATE = f"struct<at:int,level:int,open:array<struct<start:int,level:int,seen:boolean>>,found:{_RANGES}>"


def _count(line: Column, character: str) -> Column:
    return F.char_length(line) - F.char_length(F.translate(line, character, ""))


def _nothing(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def brace_blocks(lines: Column, starts: Sequence[str], modules: Sequence[str]) -> Column:
    """Zero-based half-open ranges of blocks that end on the line where the braces opened from their start on are closed again; braces count wherever they stand. A start whose braces never close makes none.

    The state holds the line's number, the brace level, the starts that are not closed, each with the level before it and
    whether a brace was opened since, and the ranges found. A start closes where the level is its own again. Then it
    takes the place of whatever began after it; an earlier one that is still open may do the same to it later.
    """

    def step(state: Column, line: Column) -> Column:
        opened = _count(line, "{")
        level = state["level"] + opened - _count(line, "}")
        begun = F.when(test_line(line, starts, modules), F.concat(state["open"], F.array(F.struct(state["at"].alias("start"), state["level"].alias("level"), F.lit(False).alias("seen"))))).otherwise(state["open"])
        begun = F.when(opened > 0, F.transform(begun, lambda s: F.struct(s["start"].alias("start"), s["level"].alias("level"), F.lit(True).alias("seen")))).otherwise(begun)
        closed = F.get(F.filter(begun, lambda s: s["seen"] & (s["level"] == level)), F.lit(0))["start"]
        before = F.filter(state["found"], lambda r: r["start_line"] < closed)
        found = F.concat(before, F.array(F.struct(closed.alias("start_line"), (state["at"] + 1).alias("end_line"))))
        ends = closed.isNotNull()
        next_ = F.struct((state["at"] + 1).alias("at"), level.alias("level"), F.when(ends, F.filter(begun, lambda s: s["start"] < closed)).otherwise(begun).alias("open"), F.when(ends, found).otherwise(state["found"]).alias("found"))
        # nothing is open and nothing begins: only the level may change
        idle = (F.size(state["open"]) == 0) & (F.size(begun) == 0)
        return F.when(idle, F.struct((state["at"] + 1).alias("at"), level.alias("level"), state["open"].alias("open"), state["found"].alias("found"))).otherwise(next_).cast(_STATE)

    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"), _nothing("array<struct<start:int,level:int,seen:boolean>>").alias("open"), _nothing(_RANGES).alias("found")).cast(_STATE)
    return F.aggregate(lines, none, step, lambda s: s["found"])


def indented_blocks(lines: Column, starts: Sequence[str], modules: Sequence[str]) -> Column:
    """Ranges of blocks that end before the next line that is not blank and not further indented than their start, or with the file."""
    kind = f"struct<at:int,start:int,depth:int,found:{_RANGES}>"

    def step(state: Column, line: Column) -> Column:
        depth = indent(line)
        ends = state["start"].isNotNull() & (trim(line) != "") & (depth <= state["depth"])
        found = F.when(ends, F.concat(state["found"], F.array(F.struct(state["start"].alias("start_line"), state["at"].alias("end_line"))))).otherwise(state["found"])
        begins = (ends | state["start"].isNull()) & test_line(line, starts, modules)
        start = F.when(begins, state["at"]).when(~ends, state["start"])
        return F.struct((state["at"] + 1).alias("at"), start.alias("start"), F.when(begins, depth).otherwise(state["depth"]).alias("depth"), found.alias("found")).cast(kind)

    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("depth"), _nothing(_RANGES).alias("found")).cast(kind)
    last = lambda s: F.when(s["start"].isNotNull(), F.concat(s["found"], F.array(F.struct(s["start"].alias("start_line"), s["at"].alias("end_line"))))).otherwise(s["found"])
    return F.aggregate(lines, none, step, last)


def test_blocks(lines: Column, path: Column, text: Column, attributes: Sequence[str] = TEST_ATTRIBUTES, modules: Sequence[str] = TEST_MODULES) -> Column:
    """array<struct<start_line, end_line>> of a file's lines. Only files that hold a marker's text are walked."""
    attributes, modules = list(attributes), list(modules)
    texts = marker_texts(attributes, modules)
    marked = F.lit(True) if texts is None else contains_one(text, texts)
    python = F.coalesce(path.endswith(".py"), F.lit(False))
    found = F.when(marked & python, indented_blocks(lines, attributes, modules)).when(marked, brace_blocks(lines, attributes, modules))
    return F.coalesce(found, _nothing(_RANGES))
