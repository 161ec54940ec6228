"""One pass over HTML markup that takes any string, in time in proportion to its length.

Tags, comments and declarations are read as browsers read them. What never ends is cut off: a tag without its `>` ends
before the next `<`, a quote without its partner at the next white space or `>`, and a comment or a script without its
end reaches to the end of the page. Each search that fails is remembered, so none is made twice in vain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Elements whose content holds no tags: text up to their own end tag.
RAW = frozenset(("script", "style"))

_SPACE = " \t\n\r\f"
_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
_ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*")
_GAP = re.compile(r"[\s/]*")
_VALUE = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")

Attributes = list[tuple[str, str | None]]
#: ("text", text, None), ("start" or "empty", tag, attributes) or ("end", tag, None)
Event = tuple[str, str, Attributes | None]


class _Page:
    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.missing: set[str] = set()  # quotes that do not occur any more
        self.plain = False  # a tag ran to the end of the page: from there on, tags end at the next < or >

    def _quoted(self, at: int, quote: str) -> int:
        """The place of the closing quote; below 0 if there is none."""
        if quote in self.missing:
            return -1
        end = self.html.find(quote, at)
        if end < 0:
            self.missing.add(quote)
        return end

    def tag_end(self, at: int, attributes: Attributes | None) -> tuple[int, bool] | None:
        """(place behind the tag's >, whether a / stands before it) of a tag whose name ends at `at`; none if it does not end. Attributes are put in the list."""
        html, n = self.html, len(self.html)
        while at <= self.last:
            gap = _GAP.match(html, at)
            at = gap.end()
            if at > self.last:
                break
            if html[at] == ">":
                return at + 1, gap[0].endswith("/")
            if self.plain and html[at] == "<":
                return None
            name = _ATTRIBUTE.match(html, at)
            at = name.end() if name else at + 1
            value = None
            if is_ := _VALUE.match(html, at):
                at = is_.end()
                quote = html[at : at + 1]
                end = self._quoted(at + 1, quote) if quote in ("'", '"') and not self.plain else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0].strip("'\""), bare.end()
            if name and attributes is not None:
                attributes.append((name[0].lower(), value if value is None else unescape(value)))
        if at <= n:
            self.plain = True
        return None


def events(html: str) -> Iterator[Event]:
    """Text and tags of a page, in order. Character references are decoded, but in raw elements; an empty page has none."""
    page, at, n = _Page(html), 0, len(html)
    while at < n:
        start = html.find("<", at)
        start = n if start < 0 else start
        if start > at:
            yield "text", unescape(html[at:start]), None
        if start == n:
            return
        after = html[start + 1 : start + 2]
        if after.isascii() and after.isalpha():
            name = _NAME.match(html, start + 1)
            attributes: Attributes = []
            found = page.tag_end(name.end(), attributes)
            if found is None:
                at = _cut(html, start)
                continue
            at, empty = found
            tag = name[0].lower()
            yield "empty" if empty else "start", tag, attributes
            if tag in RAW and not empty:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "text", html[at:stop], None
                at = stop
        elif after == "/":
            name = _NAME.match(html, start + 2)
            if name:
                found = page.tag_end(name.end(), None)
                at = found[0] if found else _cut(html, start)
                if found:
                    yield "end", name[0].lower(), None
            else:
                at = _past(page, start)
        elif html.startswith("<!--", start):
            # <!--> and <!---> are whole comments
            short = next((k for k in (5, 6) if html.startswith("<!--" + "-" * (k - 5) + ">", start)), 0)
            end = None if short else _COMMENT_END.search(html, start + 4)
            at = start + short if short else end.end() if end else n
        elif after in ("!", "?"):
            at = _past(page, start)
        else:
            yield "text", "<", None
            at = start + 1


def _cut(html: str, start: int) -> int:
    """Where a tag that does not end is cut off."""
    at = html.find("<", start + 1)
    return len(html) if at < 0 else at


def _past(page: _Page, start: int) -> int:
    """Behind the > that ends a declaration; without one it is cut off as a tag is."""
    return page.html.find(">", start) + 1 if page.last > start else _cut(page.html, start)
