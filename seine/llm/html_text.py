"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut at block-level tags into blocks of running text. A block's features are its own word count and link
density, those of the blocks before and after it, whether it is a heading or in the page's marked main part, and how
surely a name beside the text holds it. The tree is fitted on labelled_pages; another table of the same form may be given.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled_pages
from .markup import events

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is no text of the page.
HIDDEN = frozenset("script style noscript template head title svg math iframe object audio video canvas select textarea button".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE_TAGS = frozenset("nav aside footer form menu dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Words in class names, ids and roles of parts beside the text, and words that stand on such parts as on the text
#: itself. A name counts if it has one of them as a part.
BESIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer gdpr menu modal nav navbar navigation newsletter notice pagination popup promo promotion replies reply sidebar signup sponsor sponsored subscribe toc".split()
)
UNSURE_NAMES = frozenset("banner masthead overlay related share sharing skip social teaser toolbar topbar widget".split())
#: Names of layout classes, which say what a page has, not what they hold.
LAYOUT = frozenset("has with without no is page layout".split())

#: The start tags that leave a head open. Any other ends it, as does text.
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript noframes template".split())
#: Elements of a head whose content, tags and all, is no text of the page.
OPAQUE = frozenset("noscript template".split())
#: Block-level tags that may stand in a select or break a line in any element; none ends an element that was left open.
WITHIN = frozenset("br hr option legend".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "beside", "heading")


@dataclass
class Block:
    text: str
    words: int
    links: float
    in_main: bool
    beside: int  # 0: no name, 1: an unsure one, 2: a sure one
    heading: bool
    label: str | None = None


def _named(attrs: Sequence[tuple[str, str | None]]) -> int:
    found = 0
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.lower().split():
                parts = re.split(r"[-_]+", name)
                if parts[0] not in LAYOUT:
                    if not BESIDE_NAMES.isdisjoint(parts):
                        return 2
                    found = found or int(not UNSURE_NAMES.isdisjoint(parts))
    return found


class _Blocks:
    """Cuts a page into blocks. Open elements are kept with what they mean; unclosed ones end with what holds them.

    A head may lack its end tag. Hidden elements are counted from 1 in their order: those that end with what holds them
    are put in `unclosed`. A parser that is given their numbers ends them at the next block-level tag, as otherwise they
    would hide all that follows.

    Open elements are counted by name, so that no tag makes the parser go through elements that stay open: the time is in
    proportion to the page, however deep its elements.
    """

    def __init__(self, ended: frozenset[int] = frozenset()) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, int, str | None]] = []  # tag, hidden, in main, beside, label; each with what holds it
        self.count: Counter[str] = Counter()  # open elements by tag
        self.ended_at: list[int] = []  # places of open elements that `ended` names
        self.numbers: list[int] = []  # beside each open element its number if it is hidden by itself, or 0
        self.ended, self.unclosed, self.hidden = ended, set(), 0
        self.parts: list[str] = []
        self.link_words = self.in_link = 0
        self.heading = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.end_head(tag == "body")
        if tag in BLOCK:
            self.flush()
            if self.ended and tag not in WITHIN:
                if self.ended_at:
                    self.cut(self.ended_at[0])
            # a line break ends nothing, and a rule ends a paragraph only
            if self.open and self.open[-1][0] in (("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag not in VOID else ("p",) if tag == "hr" else ()):
                self.cut(len(self.open) - 1)
        if tag in VOID:
            return
        if tag == "a":
            self.in_link = 1
        if tag in BLOCK or tag in HIDDEN:
            _, hidden, main, beside, label = self.open[-1] if self.open else ("", False, False, 0, None)
            if tag in ASIDE_TAGS or (tag == "header" and not main):
                beside = 2
            elif tag not in ("body", "html"):
                beside = max(beside, _named(attrs))
            label = next((v for k, v in attrs if k == "data-label"), label)
            self.hidden += tag in HIDDEN
            self.numbers.append(self.hidden if tag in HIDDEN else 0)
            if self.numbers[-1] in self.ended:
                self.ended_at.append(len(self.open))
            self.open.append((tag, hidden or tag in HIDDEN, main or tag in MAIN_TAGS or ("role", "main") in attrs, beside, label))
            self.count[tag] += 1
            self.heading = len(tag) == 2 and tag[0] == "h" and tag != "hr"

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag in BLOCK:
            self.flush()
        if not self.count[tag]:
            return
        at = self.last(tag)
        self.unclosed.update(n for n in self.numbers[at + 1 :] if n)
        self.cut(at)
        self.in_link = self.in_link and tag not in BLOCK

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag; what is looked at is about to be ended."""
        return next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)

    def cut(self, at: int) -> None:
        self.count.subtract(t for t, *_ in self.open[at:])
        del self.open[at:], self.numbers[at:]
        while self.ended_at and self.ended_at[-1] >= at:
            self.ended_at.pop()

    def end_head(self, whatever: bool = False) -> None:
        """End an open head, unless one of its elements holds what comes; `whatever`: even then."""
        while self.count["head"] and (whatever or not any(self.count[t] for t in OPAQUE)):
            self.cut(self.last("head"))

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.end_head()
        if self.open and self.open[-1][1]:
            return
        self.parts.append(data)
        if self.in_link:
            self.link_words += len(data.split())

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            _, _, main, beside, label = self.open[-1] if self.open else ("", False, False, 0, None)
            self.blocks.append(Block(" ".join(words), len(words), min(1.0, self.link_words / len(words)), main, beside, self.heading, label))
        self.parts, self.link_words = [], 0


def blocks(html: str) -> list[Block]:
    found = list(events(html))

    def parsed(ended: frozenset[int] = frozenset()) -> _Blocks:
        parser = _Blocks(ended)
        for kind, value, attributes in found:
            if kind == "text":
                parser.handle_data(value)
            elif kind == "end":
                parser.handle_endtag(value)
            else:
                parser.handle_starttag(value, attributes)
                if kind == "empty" and value in HIDDEN and value not in VOID:
                    parser.handle_endtag(value)
        parser.flush()
        return parser

    parser = parsed()
    unclosed = parser.unclosed.union(n for n in parser.numbers if n)
    return parsed(frozenset(unclosed)).blocks if unclosed else parser.blocks


def features(page: Sequence[Block]) -> list[tuple[float, ...]]:
    """A row for each block, in the order of FEATURES; beyond the ends of the page stand blocks of no words."""
    sizes = [(0, 0.0), *((b.words, b.links) for b in page), (0, 0.0)]
    return [(float(b.words), b.links, *map(float, sizes[i]), *map(float, sizes[i + 2]), float(b.in_main), float(b.beside), float(b.heading)) for i, b in enumerate(page)]


Tree = tuple  # (feature, threshold, tree if <=, tree if >) or (share of text,)


def grow(rows: Sequence[tuple[float, ...]], labels: Sequence[bool], depth: int = 10, least: int = 3) -> Tree:
    """A decision tree by Gini impurity. Ties go to the first feature and the lowest threshold, so it is always the same."""
    share = sum(labels) / len(labels)
    best = None
    if depth and 0 < share < 1:
        whole = len(rows) * share * (1 - share)
        for f in range(len(rows[0])):
            order = sorted(range(len(rows)), key=lambda i: rows[i][f])
            left = 0
            for k in range(1, len(order)):
                left += labels[order[k - 1]]
                low, high = rows[order[k - 1]][f], rows[order[k]][f]
                if low == high or k < least or len(order) - k < least:
                    continue
                a, b = left / k, (sum(labels) - left) / (len(order) - k)
                gain = whole - k * a * (1 - a) - (len(order) - k) * b * (1 - b)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, (low + high) / 2)
    if best is None or best[0] <= 1e-9:
        return (share,)
    _, f, at = best
    side = [r[f] <= at for r in rows]
    parts = [([r for r, s in zip(rows, side, strict=True) if s is want], [y for y, s in zip(labels, side, strict=True) if s is want]) for want in (True, False)]
    return (f, at, *(grow(r, y, depth - 1, least) for r, y in parts))


def is_text(tree: Tree, row: tuple[float, ...]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def labelled_rows(pages: Iterable[str]) -> tuple[list[tuple[float, ...]], list[bool]]:
    rows, labels = [], []
    for page in pages:
        found = blocks(page)
        for row, block in zip(features(found), found, strict=True):
            if block.label is not None:
                rows.append(row)
                labels.append(block.label == "1")
    return rows, labels


@cache
def _own_tree() -> Tree:
    return grow(*labelled_rows(labelled_pages.pages()))


def fit(pages: Iterable[str] | None = None) -> Tree:
    """The tree of a labelled table; the module's own table by default. It sees a bounded table only, whatever the corpus."""
    return _own_tree() if pages is None else grow(*labelled_rows(pages))


def main_text(html: str, tree: Tree) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, row in zip(page, features(page), strict=True) if is_text(tree, row))


def extract(pages: DataFrame, tree: Tree | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row; null or empty html has an empty text. A narrow step.

    Nulls in key and url stay; repeated rows each get their row; other columns of pages may have any names and are left
    out. Pages of any length are read whole, in time in proportion to it. An empty table gives an empty one.
    """
    tree = tree or fit()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), tree) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"key {kinds[key]}, url {kinds[url]}, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
