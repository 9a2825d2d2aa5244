"""A page as flat arrays over the standard-library HTML parser.

Used inside Python tasks only, to pull raw fields out of landed board
pages; dates, splits, maps and filters are JVM expressions. Elements are
numbered in document order and an element's subtree is a range of numbers, so
"the first matching element inside" is a binary search in the sorted list of
matches. Nothing recurses: a page of any depth is read in linear time.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from dataclasses import dataclass
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
RAW_TEXT = {"script", "style"}


@dataclass(frozen=True)
class Sel:
    """A kind of element: one of ``tags`` (any if empty) whose attribute
    ``attr`` equals ``value`` or is matched by the pattern ``like``. Of a class
    attribute the whole text and each single name are tried."""

    tags: tuple[str, ...] = ()
    attr: str | None = None
    value: str | None = None
    like: str | None = None

    def matches(self, tag: str, attrs: dict) -> bool:
        if self.tags and tag not in self.tags:
            return False
        if self.attr is None:
            return True
        have = attrs.get(self.attr)
        if have is None:
            return False
        options = [have, *have.split()] if self.attr == "class" else [have]
        if self.value is not None:
            return self.value in options
        return any(re.search(self.like, o) for o in options)


class Page(HTMLParser):
    """``tags``, ``attrs``, ``parents`` and subtree ``ends`` by element number;
    element 0 is the document. ``texts`` are the pieces of visible text, and
    ``spans`` gives the range of pieces of each element."""

    def __init__(self, markup: str | None):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parents, self.ends, self.spans = ["#document"], [{}], [-1], [0], [[0, 0]]
        self.texts: list[str] = []
        self._script_text: dict[int, list[str]] = {}
        self._open, self._count, self._found = [0], {}, {}
        self.feed(markup or "")
        self.close()
        self._shut(0)

    # -- parsing
    def _begin(self, tag, attrs) -> int:
        self.tags.append(tag)
        self.attrs.append({k: v if v is not None else "" for k, v in attrs})
        self.parents.append(self._open[-1])
        self.ends.append(len(self.tags))
        self.spans.append([len(self.texts), len(self.texts)])
        return len(self.tags) - 1

    def _shut(self, depth: int) -> None:
        for e in self._open[depth:]:
            self.ends[e] = len(self.tags)
            self.spans[e][1] = len(self.texts)
            if e:
                self._count[self.tags[e]] -= 1
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        e = self._begin(tag, attrs)
        if tag not in VOID:
            self._open.append(e)
            self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs)

    def handle_endtag(self, tag):
        if self._count.get(tag):  # an end without a start is ignored at once
            depth = len(self._open) - 1
            while self.tags[self._open[depth]] != tag:
                depth -= 1
            self._shut(depth)

    def handle_data(self, data):
        inner = self._open[-1]
        if self.tags[inner] == "script":
            self._script_text.setdefault(inner, []).append(data)
        elif self.tags[inner] not in RAW_TEXT:
            self.texts.append(data)

    # -- asking
    @property
    def scripts(self) -> list[tuple[dict, str]]:
        """Attributes and text of each script that has text."""
        return [(self.attrs[e], "".join(parts)) for e, parts in self._script_text.items()]

    def all(self, sel: Sel) -> list[int]:
        """Numbers of the elements of a kind, in document order."""
        if sel not in self._found:
            self._found[sel] = [e for e in range(1, len(self.tags)) if sel.matches(self.tags[e], self.attrs[e])]
        return self._found[sel]

    def first(self, sel: Sel, inside: int = 0) -> int | None:
        """The first element of a kind below ``inside``."""
        found = self.all(sel)
        k = bisect_right(found, inside)
        return found[k] if k < len(found) and found[k] < self.ends[inside] else None

    def text(self, element: int = 0, sep: str = "") -> str:
        """The trimmed, non-empty pieces of text of an element."""
        a, b = self.spans[element]
        return sep.join(p for p in map(str.strip, self.texts[a:b]) if p)


def page_text(markup: str | None, sep: str = " ") -> str:
    """Entity-decoded, tag-free text (whitespace-trimmed pieces joined by ``sep``)."""
    return Page(_html.unescape(markup or "")).text(0, sep)


def html_text_column():
    """Column function: entity-decoded, tag-free text.

    Rows travel pickled, a hundred at a time: an Arrow batch takes 10,000 rows
    by default, and a task's Python would hold the pages and texts of them all.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return F.udf(page_text, T.StringType(), useArrow=False)
