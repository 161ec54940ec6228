"""Test blocks and the directive for the next line over streams of lines, with a state for each file that has not ended.

A start may lie batches before its end, so lines behind an open start wait in the state until it closes, which drops
them, or the file ends, which lets them through: a start whose braces never close makes no block. Only lines that may
hold a match wait.

Files are put into a fixed number of groups by a hash of their paths, and a group keeps the states of its files
together: what a stateful call costs beside its lines is paid once a group and micro-batch, not once a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import indent, trim
from ..operators.matcher import gate_all
from ..operators.predicates import test_line
from ..plans.scan import Scanner

_OUT = "path string, line_number int, line string, previous string"
_FACTS = ("starts", "blank", "depth", "opened", "closed", "wanted")
#: Groups of files with one state; a stream that goes on from a checkpoint needs the number that it began with.
GROUPS = 512


class BlockState:
    """What the walk through one file knows: the last line, the brace level, starts that are open, and lines that wait."""

    def __init__(self, python: bool, saved: list | None = None):
        self.python = python
        self.n, self.last, self.level, self.open, self.held = saved or (0, None, 0, [], [])

    def saved(self) -> list:
        return [self.n, self.last, self.level, self.open, self.held]

    def take(self, number: int, line: str, starts: bool, blank: bool, depth: int, opened: int, closed: int, wanted: bool) -> list[tuple]:
        """The next line; returns lines that are now known to stand outside blocks."""
        if self.python:
            # [start, indentation]; the line that ends a block is outside it and may start one
            if self.open and not blank and depth <= self.open[0][1]:
                self.open, self.held = [], []
            if not self.open and starts:
                self.open = [[number, depth]]
            keep = not self.open
        else:
            # [start, level before it, whether a brace was opened since]
            if starts:
                self.open.append([number, self.level, False])
            self.level += opened - closed
            if opened:
                self.open = [[s, at, True] for s, at, _ in self.open]
            keep = True
            done = next((s for s, at, seen in self.open if seen and at == self.level), None)
            if done is not None:
                self.open = [o for o in self.open if o[0] < done]
                self.held = [h for h in self.held if h[0] < done]
                keep = False
        out = []
        if keep and wanted:
            self.held.append([number, line, self.last])
        if not self.open:
            out, self.held = [tuple(h) for h in self.held], []
        self.n, self.last = number, line
        return out

    def end(self) -> list[tuple]:
        return [] if self.python and self.open else [tuple(h) for h in self.held]


def lines_outside_blocks(lines: DataFrame, scanner: Scanner, groups: int = GROUPS) -> DataFrame:
    """(path, line_number, line, previous) of a stream of lines (path, line_number, line) that stand outside test blocks and may hold a match.

    A row whose line is null ends its file: its line_number is behind the last. Lines of a file come in order over the
    micro-batches; within one they may be mixed. State is kept for files that have not ended. A task holds the lines of
    a micro-batch of one of so many groups of files, and the states of its files.
    """
    c = scanner.config
    line = F.coalesce("line", F.lit(""))
    count = lambda ch: F.char_length(line) - F.char_length(F.translate(line, ch, ""))
    facts = {
        "starts": test_line(line, c.test_attributes, c.test_modules), "blank": trim(line) == "", "depth": indent(line), "opened": count("{"), "closed": count("}"), "wanted": gate_all(line, scanner.patterns),
    }
    rows = lines.select(F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int").alias("_group"), "path", "line_number", "line", *[facts[f].alias(f) for f in _FACTS])

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {}
        known: dict[str, BlockState] = {}
        found: list[tuple] = []
        batch = pd.concat(frames).sort_values(["path", "line_number"])
        for path, number, line, *own in zip(*(batch[x].tolist() for x in ("path", "line_number", "line", *_FACTS)), strict=True):
            file = known.get(path)
            if file is None:
                file = known[path] = BlockState(path.endswith(".py"), saved.pop(path, None))
            if line is None:
                found += ((path, *f) for f in file.end())
                known[path] = BlockState(file.python)
            elif number > file.n:  # a batch that is delivered again changes nothing
                found += ((path, *f) for f in file.take(number, line, *own))
        saved |= {path: file.saved() for path, file in known.items() if file.n}
        if saved:
            state.update((json.dumps(saved),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["path", "line_number", "line", "previous"]).astype({"line_number": "int32"})

    return rows.groupBy("_group").applyInPandasWithState(walk, _OUT, "saved string", "append", GroupStateTimeout.NoTimeout)


def scan_files_stream(lines: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Findings in a stream of lines, by the rules of a scan of whole files; see lines_outside_blocks()."""
    scanner = scanner or Scanner()
    return scanner.outside_findings(lines_outside_blocks(lines, scanner))
