"""Chat formatting by incremental black-box rendering.

A template is a function from the turns so far to a string. It is rendered on successive prefixes of a conversation,
and consecutive outputs are compared: what the longer output adds is the new turn's span. A template that changes text
it has already put out is detected and its conversations are marked.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

#: The control strings of the built-in template.
BEGIN, END, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\])")


def escape(text: str) -> str:
    """Put a backslash behind the first character of every control string, and of every one escaped before."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    """escape(), and no line feed is left: the first one in a turn ends its role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def local(render: Render) -> Render:
    """Declares that what a turn adds to the template's output depends on the first turn and the turn before it only.

    Only the template's author can know this: no number of rendered prefixes shows what a template does later.
    """
    render.local = True
    return render


@local
def render_inst(turns: list[Turn]) -> str:
    """The built-in template: <s>role, line feed, text</s>; the text of users stands between [INST] and [/INST]."""
    return "".join(f"{BEGIN}{escape_role(role)}\n" + (f"{ASK}{escape(text)}{ASKED}" if role == "user" else escape(text)) + END for role, text in turns)


_TURN = re.compile(re.escape(BEGIN) + r"(.*?)\n(.*?)" + re.escape(END), re.S)


def parse_inst(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn in the output of render_inst; start and end bound the escaped text.

    Control strings are never left whole in a text, so the first END closes its turn.
    """
    for m in _TURN.finditer(formatted):
        role, start, end = unescape_role(m[1]), m.start(2), m.end(2)
        if role == "user" and formatted.startswith(ASK, start):
            start, end = start + len(ASK), end - len(ASKED)
        yield role, unescape(formatted[start:end]), start, end


@dataclass(frozen=True)
class Piece:
    """What one turn added to the output, its start there, and whether the output before it was changed."""

    text: str
    start: int
    rewrites: bool


class Incremental:
    """Renders a conversation turn by turn; one law holds for conversations of every length.

    Every prefix is rendered whole and compared with the output before. For a template declared local() a turn's piece is
    what it adds to the rendering of the first turn and the turn before it, which bounds the work of a turn; whole
    outputs are then rendered and compared with the pieces at 1, 2, 4, 8, ... turns and at the end, so all of it takes
    twice the turns. Pieces are given out once a whole output has confirmed them. Where one does not, or a turn does not
    add to its neighbours' rendering, the pieces since the last whole output that agreed are found anew by whole
    prefixes, and so are all later ones: a declaration that does not hold costs time, and no result. What a declared
    template changes and takes back between two whole outputs, unseen by the neighbours, is not marked; rewrites_history()
    renders every prefix of any template.
    """

    def __init__(self, render: Render):
        self.render = render
        self.turns: list[Turn] = []
        self.near = getattr(render, "local", False)
        self.out = ""  # the last whole output; of a declared template while that holds, it is rendered anew when needed
        self.held: list[Piece] = []
        self.length = self.settled = 0
        self.digest = hashlib.sha256()

    def add(self, turn: Turn) -> list[Piece]:
        """Take the next turn. Pieces of turns that are now settled, in order; of this one as well unless `near`."""
        self.turns.append(turn)
        if not self.near:
            return [self._whole(len(self.turns))]
        text = self._added()
        if text is None:
            return self._anew()
        self.held.append(Piece(text, self.length, False))
        self.length += len(text)
        n = len(self.turns)
        return self._settle() if n & (n - 1) == 0 else []

    def end(self) -> list[Piece]:
        """The pieces that are left at the end of the conversation."""
        return self._settle() if self.held else []

    def _added(self) -> str | None:
        """What the last turn adds to the rendering of the first turn and the turn before it; none if it does not just add."""
        ends = self.turns[:1] if len(self.turns) == 2 else [self.turns[0], self.turns[-2]] if len(self.turns) > 2 else []
        before = self.render(list(ends)) if ends else ""
        after = self.render([*ends, self.turns[-1]])
        return after[len(before) :] if after.startswith(before) else None

    def _settle(self) -> list[Piece]:
        digest = self.digest.copy()
        for p in self.held:
            digest.update(_raw(p.text))
        if hashlib.sha256(_raw(self.render(list(self.turns)))).digest() != digest.digest():
            return self._anew()
        self.digest, self.settled, settled, self.held = digest, len(self.turns), self.held, []
        return settled

    def _anew(self) -> list[Piece]:
        """Whole prefixes from the last whole output that agreed."""
        self.near = False
        known = self.turns[: self.settled]
        self.held, self.out = [], self.render(known) if known else ""
        return [self._whole(n) for n in range(len(known) + 1, len(self.turns) + 1)]

    def _whole(self, n: int) -> Piece:
        now = self.render(self.turns[:n])
        same = now.startswith(self.out)
        at = len(self.out) if same else _common(now, self.out)
        self.out = now
        return Piece(now[at:], at, not same)


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _common(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def rewrites_history(render: Render, turns: Iterable[Turn]) -> bool:
    """Whether a template changes earlier output anywhere in a conversation; every prefix is rendered."""
    steps = Incremental(lambda prefix: render(prefix))  # declares nothing
    return any(p.rewrites for t in turns for p in steps.add(t))


def in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their conversation together and its turns in order (ties: role, then text), null role or text as empty.

    The turns of one conversation meet in one task, as its output is one sequence; they pass through it as a stream, and
    the task holds one conversation, which its whole outputs need.
    """
    known = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return known.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


Row = tuple


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[Row], schema: pa.Schema, text: int | None = None, most: int = 2000, chars: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of at most `most` rows, closed as soon as the column number `text` has `chars` characters."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[text]) if text is not None else 0
        if len(held) >= most or size >= chars:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _pieces(turns: Iterable[Row], render: Render, learn: str) -> Iterator[Row]:
    """(conv, turn, place, role, piece, start, loss, rewrites) of ordered (conv, turn, role, text)."""
    current, steps = None, None
    waiting: deque[tuple] = deque()

    def settled(pieces: list[Piece]) -> Iterator[Row]:
        for p in pieces:
            conv, turn, place, role = waiting.popleft()
            yield conv, turn, place, role, p.text, p.start, role == learn, p.rewrites

    place = 0
    for conv, turn, role, text in turns:
        if steps is None or conv != current:
            if steps is not None:
                yield from settled(steps.end())
            current, steps, place = conv, Incremental(render), 0
        waiting.append((conv, turn, place, role))
        place += 1
        yield from settled(steps.add((role, text)))
    if steps is not None:
        yield from settled(steps.end())


def _digests(pieces: Iterable[Row]) -> Iterator[Row]:
    """The columns of digest() from ordered (conv, piece, loss, rewrites)."""
    state = None
    for conv, piece, loss, rewrites in pieces:
        if state is None or conv != state[0]:
            if state is not None:
                yield _done(state)
            state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
        for role, text, _, _ in parse_inst(piece):
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if loss:
                state[3] += len(text)
                state[4].update(text.encode())
        state[5] += len(piece)
        state[6] |= rewrites
    if state is not None:
        yield _done(state)


def _done(s: list) -> Row:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]


def _schema(kind: T.DataType, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv", kind), *T._parse_datatype_string(columns).fields])


_PIECES = "place long, role string, piece string, start long, loss boolean, rewrites boolean"
_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def format_turns(rows: DataFrame, render: Render = render_inst, learn: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conv, turn, place (from 0), role, piece (the text that the turn adds), start (its place in
    the conversation's output, in code points), loss (role = learn), rewrites (see Incremental).

    Joining the pieces of a conversation by place gives its formatted text, unless a turn has `rewrites`: then the
    template went back behind the turn's start, and pieces before it no longer stand as they are.

    Null role or text counts as empty; rows without a conversation are one conversation of their own; rows without a
    turn come first; repeated rows are turns like any other. Other columns of rows may have any names. Texts of any
    length stay whole. An empty table gives an empty one.
    """
    kind = rows.schema[conv].dataType
    ordered = in_order(rows, conv, turn, role, text)
    schema = T.StructType([T.StructField("conv", kind), T.StructField("turn", rows.schema[turn].dataType), *T._parse_datatype_string(_PIECES).fields])
    return ordered.mapInArrow(lambda batches: _batches(_pieces(_rows(batches), render, learn), to_arrow_schema(schema), 4), schema)


def digest(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from the pieces of the built-in template: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, rewrites.

    The pieces stream through in order; a piece holds whole turns.
    """
    schema = _schema(pieces.schema["conv"].dataType, _DIGEST)
    ordered = pieces.select("conv", "place", "piece", "loss", "rewrites").repartition("conv").sortWithinPartitions("conv", "place").drop("place")
    return ordered.mapInArrow(lambda batches: _batches(_digests(_rows(batches)), to_arrow_schema(schema)), schema)


def format_and_digest(rows: DataFrame, learn: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """digest(format_turns(rows)) with the built-in template in one pass: pieces are read back where they are made, so
    texts are shuffled once."""
    schema = _schema(rows.schema[conv].dataType, _DIGEST)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(_rows(batches), render_inst, learn)
        return _batches(_digests((p[0], p[4], p[6], p[7]) for p in pieces), to_arrow_schema(schema))

    return in_order(rows, conv, turn, role, text).mapInArrow(run, schema)
