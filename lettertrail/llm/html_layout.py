"""Visible text of web pages, laid out as a browser would show it.

A page is read once into a tree of elements: void elements have no content, and an opening tag closes what it can't
stand in (a block closes an open paragraph, a list item the item before it, cells and rows their predecessors); an end
tag closes what is still open inside its element. The tree is then rendered: elements that aren't shown are left out
(formulas, labels of drawings, options and text fields are shown, embedded pages and media with their fallbacks aren't),
white space is folded except in preformatted text, blocks stand on lines of their own, paragraphs and headings between
empty lines, list items get markers and indentation, and the cells of a table column are padded to one width.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import limit_batches

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object canvas audio video datalist".split())
UNDRAWN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset(["annotation", "annotation-xml"])}
RAW = frozenset("script style textarea title noscript iframe".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup hr legend li main nav section summary tr caption".split()
)
# No blocks, but they stand on lines of their own.
LINES = BLOCK | frozenset("option optgroup text textarea".split())
# What an opening tag closes, and where looking for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = frozenset("table td th caption button".split())

_MARK = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_FOLD = re.compile(r"[ \t\n\r\f]+")


def _hides(name: str, attributes: str) -> bool:
    if name in HIDDEN:
        return True
    if not attributes or attributes.isspace():
        return False
    found = {key.lower(): value.strip("\"'") for key, value in _ATTRIBUTE.findall(attributes)}
    return "hidden" in found or bool(_UNSEEN.search(unescape(found.get("style", ""))))


def tree(page: str) -> list:
    """Nested [name, shown, children] lists; children are such lists or strings."""
    root = ["html", True, []]
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # depths of the open elements of each name, so that no tag looks through the stack
    lowered = None

    def last(names) -> int:
        return max((places[name][-1] for name in names if places.get(name)), default=0)

    def cut(depth: int) -> None:
        for gone in reversed(stack[depth:]):
            places[gone[0]].pop()
        del stack[depth:]

    def push(node: list) -> None:
        places.setdefault(node[0], []).append(len(stack))
        stack.append(node)

    for mark in iter(lambda: _MARK.search(page, at), None):
        if mark.start() > at:
            stack[-1][2].append(unescape(page[at : mark.start()]))
        at = mark.end()
        name = (mark[2] or "").lower()
        if not name:
            continue
        if mark[1]:
            if places.get(name):
                cut(places[name][-1])
            continue
        if name in CLOSES:
            closed, stop = CLOSES[name]
            barrier = last(stop)
            above = [deep[i] for deep in map(places.get, closed) if deep and (i := bisect_right(deep, barrier)) < len(deep)]
            if above:
                cut(min(above))
        if name in BLOCK and places.get("p") and places["p"][-1] > last(SCOPE):
            cut(places["p"][-1])
        node = [name, not _hides(name, mark[3]), []]
        if any(name in names and places.get(within) for within, names in UNDRAWN.items()):
            node[1] = False
        stack[-1][2].append(node)
        if name in RAW:
            lowered = lowered or page.lower()
            end = lowered.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            if end >= 0 and len(lowered) != len(page):  # lower case changed the length somewhere: look again
                again = re.compile(f"</{name}", re.I).search(page, mark.end())
                at = again.start() if again else len(page)
            if name == "textarea":
                node[2].append(re.sub("^\\r?\\n", "", unescape(page[mark.end() : at])))
            push(node)
        elif name not in VOID and not mark[3].endswith("/"):
            push(node)
    if at < len(page):
        stack[-1][2].append(unescape(page[at:]))
    return root


class _Page:
    """Lines written so far, and how many line ends stand before the next text."""

    def __init__(self):
        self.lines, self.line, self.breaks, self.blank = [], "", 0, False

    def text(self, value: str, kept: bool) -> None:
        if kept:
            first, *rest = value.split("\n")
            self.put(first)
            for part in rest:
                self.lines.append(self.line)
                self.line = part
            return
        value = _FOLD.sub(" ", value)
        if value.startswith(" ") and self.line and not self.breaks:
            self.blank = True
        if value.strip(" "):
            self.put(value.strip(" "))
            self.blank = value.endswith(" ")

    def put(self, value: str) -> None:
        if self.breaks:
            if self.line:
                self.lines.append(self.line.rstrip(" "))
            if self.lines:  # a line break just before a block ends the line that the block would end too
                self.lines += [""] * (self.breaks - 1)
            self.line, self.breaks, self.blank = "", 0, False
        self.line += (" " if self.blank and self.line else "") + value
        self.blank = False

    def whole(self, lines: list[str]) -> None:
        """Lines that are drawn already, empty ones included."""
        for i, line in enumerate(lines):
            if i:
                self.lines.append(self.line.rstrip(" "))
                self.line = line
            else:
                self.put(line)

    def end(self, breaks: int) -> None:
        if self.line or self.lines:
            self.breaks = max(self.breaks, breaks)

    def done(self) -> list[str]:
        return [*self.lines, self.line.rstrip(" ")] if self.line or self.lines else []


def _within(node: list, kept: bool) -> list[str]:
    page = _Page()
    _draw(node[2], page, kept)
    return page.done()


def _holders(table: list) -> set[int]:
    """Which elements of a table, nested tables aside, have cells below them, by id()."""
    above, held, todo = {id(table): None}, set(), [table]
    while todo:
        node = todo.pop()
        for child in node[2]:
            if isinstance(child, str) or not child[1] or child[0] in ("table", "caption"):
                continue
            if child[0] in ("td", "th"):
                up = node
                while up is not None and id(up) not in held:
                    held.add(id(up))
                    up = above[id(up)]
            else:
                above[id(child)] = node
                todo.append(child)
    return held


def _table(node: list) -> list[str]:
    """What isn't in a cell or caption stands before the table; cells without a row make one of those next to each other."""
    held, rows, strays, captions = _holders(node), [], [], []
    row, todo = None, [iter(node[2])]
    depth = 0  # of the open row in todo
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            if len(todo) < depth:
                row, depth = None, 0
            continue
        if isinstance(child, str):
            strays.append(child)
        elif not child[1]:
            continue
        elif child[0] in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
            row.append(_within(child, False) or [""])
        elif child[0] in ("tr", "thead", "tbody", "tfoot") or id(child) in held:
            todo.append(iter(child[2]))
            if child[0] == "tr":
                row, depth = [], len(todo)
                rows.append(row)
            elif not depth and child[0] in ("thead", "tbody", "tfoot"):
                row = None
        elif child[0] == "caption":
            captions.append(child)
        else:
            strays.append(child)
    out = _within(["div", True, strays], False) + _within(["div", True, captions], False)
    width = [max(len(line) for row in rows if i < len(row) for line in row[i]) for i in range(max(map(len, rows), default=0))]
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            cells = [(cell[k] if k < len(cell) else "").ljust(width[i]) for i, cell in enumerate(row)]
            out.append("  ".join(cells).rstrip(" "))
    return out


def _draw(children: list, page: _Page, kept: bool) -> None:
    """Render children in order; a stack of its own instead of recursion, as pages nest to any depth."""
    todo = [iter(children)]
    after: list[int] = [0]
    modes = [kept]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            modes.pop()
            page.end(after.pop())
            continue
        if isinstance(child, str):
            page.text(child, modes[-1])
            continue
        name, shown, inner = child
        if not shown:
            continue
        gap = 2 if name in SPACED else 1 if name in LINES else 0
        if name == "br":
            page.lines.append(page.line.rstrip(" ")) if not page.breaks else page.put("")
            page.line, page.blank = "", False
            continue
        page.end(gap)
        lines = None
        if name == "table":
            lines = _table(child)
        elif name in ("ul", "ol"):
            lines, number = [], 1
            for item in inner:
                if isinstance(item, str) or not item[1]:
                    lines += [item.strip()] if isinstance(item, str) and item.strip() else []
                    continue
                if item[0] != "li":
                    lines += _within(["div", True, [item]], False)
                    continue
                mark = f"{number}. " if name == "ol" else "- "
                number += 1
                body = _within(item, False) or [""]
                lines.append((mark + body[0]).rstrip(" "))
                lines += [" " * len(mark) + line if line else "" for line in body[1:]]
        if lines is not None:
            page.whole(lines)
            page.end(gap)
            continue
        todo.append(iter(inner))
        modes.append(modes[-1] or name in ("pre", "textarea"))
        after.append(gap)


def visible_text(page: str) -> str:
    """All visible text of a page."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # a call for each list in a list, without a frame in C
    return "\n".join(_within(tree(page), False)).strip("\n")


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text): the visible text of each input row; null stays null, an empty page gives the empty text.

    Broken markup never fails: whatever isn't a tag is text. Repeated rows give repeated results, null ids stay, other
    columns are not read, an empty table gives an empty result.
    """
    limit_batches(pages.sparkSession)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)  # lists and tables may be nested to any depth
        for batch in stream:
            texts = [None if page is None else visible_text(page) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    rows = pages.select(pages[page_id].alias("page_id"), pages[html].cast("string").alias("html"))
    return rows.mapInArrow(batches, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string")
