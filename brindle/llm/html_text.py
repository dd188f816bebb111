"""Visible text of HTML pages by layout.

A tokenizer of one pass feeds a tree builder that closes what HTML lets authors
leave open (``CLOSES``), opens the row groups and rows that they leave out, and ends nothing
outside the cell it stands in. Rendering walks the tree without recursion: white space collapses
except in ``pre``; blocks begin on a new line and paragraphs after a blank one; list
items get marks and indents; table cells stand in aligned columns, by
``colspan`` and ``rowspan``. Formulas are their characters in order, labels of drawings are words of the
line. Nothing is shown of ``HIDDEN`` elements, of ``FOREIGN_HIDDEN`` ones in drawings and formulas, and of those
that ``hidden`` or ``display:none`` takes away; ``visibility`` is inherited, so that a visible element shows
within a hidden one.

Limits that lose no text: tables nested deeper than ``TABLES_MOST`` are blocks, indents deepen for ``INDENT_MOST``
levels, and a table whose columns would take more than ``BLANKS_MOST`` blanks keeps two between cells.

Defined results: null and empty pages have an empty text; anything is accepted as
HTML; repeated rows get equal texts; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that show nothing, have no content, or begin a line.
HIDDEN = frozenset("head title script style template noscript meta link base iframe object canvas audio video datalist rp".split())
#: Of svg and math only these show nothing.
FOREIGN_HIDDEN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside body center details dialog div dd dl dt fieldset figcaption figure footer form header html legend li main nav optgroup option search section summary caption foreignobject".split())
SPACED = frozenset("blockquote h1 h2 h3 h4 h5 h6 hr p pre table ul ol menu".split())
ROW_GROUPS = frozenset("thead tbody tfoot".split())
#: An opening tag on the left ends open elements on the right, as far up as the elements in the third place.
_P_ENDERS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul li dd dt"
CLOSES = {
    **{tag: ((frozenset(["p"]), frozenset(["td", "th", "table", "caption", "button", "li", "dd", "dt", "div"])),) for tag in _P_ENDERS.split()},
    "tr": ((frozenset(["caption", "colgroup"]), frozenset(["table"])), (frozenset(["tr"]), frozenset(["table"]))),
    "td": ((frozenset(["td", "th"]), frozenset(["tr", "table"])),),
    "th": ((frozenset(["td", "th"]), frozenset(["tr", "table"])),),
    **{tag: ((ROW_GROUPS | {"caption", "colgroup"}, frozenset(["table"])),) for tag in ROW_GROUPS},
    "option": ((frozenset(["option"]), frozenset(["select", "optgroup"])),),
    "optgroup": ((frozenset(["optgroup"]), frozenset(["select"])),),
}
CLOSES["li"] += ((frozenset(["li"]), frozenset(["ul", "ol", "menu", "table", "td", "th"])),)
CLOSES["dd"] += ((frozenset(["dd", "dt"]), frozenset(["dl", "table", "td", "th"])),)
CLOSES["dt"] += ((frozenset(["dd", "dt"]), frozenset(["dl", "table", "td", "th"])),)

#: What may stand in a head; anything else ends it.
HEAD_CONTENT = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())

#: Roots of foreign content, elements in it whose content is HTML again, and HTML elements that end it.
FOREIGN = frozenset(["svg", "math"])
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

#: Elements whose content is text up to their end tag; in those of the second kind references are read.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset(["title", "textarea"])
#: Parts of a table, which outside of one are not elements.
TABLE_PARTS = ROW_GROUPS | {"tr", "td", "th", "caption", "col", "colgroup"}

#: Widest span of a cell; nesting of tables that is laid out; levels that deepen the indent; blanks in one table.
SPAN_MOST, TABLES_MOST, INDENT_MOST, BLANKS_MOST = 1000, 64, 256, 1 << 24

_SPACES = re.compile(r"[ \t\n\r\f]+")
#: A declaration of a style, as far as the next ";" outside of quotes and parentheses; comments.
_DECLARATION = re.compile(r"""(?:[^;"'(]|"[^"]*"?|'[^']*'?|\([^)]*\)?)+""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)


def _declared(style: str) -> dict[str, str]:
    """The declarations, of which the last of a name counts unless one is important."""
    values: dict[str, tuple[bool, str]] = {}
    for declaration in _DECLARATION.findall(_COMMENT.sub("", style)):
        name, _, value = declaration.partition(":")
        name, (value, bang, _) = name.strip().lower(), value.lower().partition("!")
        if bool(bang) >= values.get(name, (False, ""))[0]:
            values[name] = bool(bang), value.strip()
    return {name: value for name, (_, value) in values.items()}


class Node:
    """An element; ``shown`` tells whether it is laid out, ``visible`` is None where its parent's visibility holds."""

    __slots__ = ("tag", "attrs", "foreign", "children", "shown", "visible")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False) -> None:
        self.tag, self.attrs, self.foreign = tag, attrs, foreign
        self.children: list[Node | str] = []
        style = _declared(attrs["style"]) if attrs.get("style") else {}
        taken = "hidden" in attrs or (tag == "input" and attrs.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in attrs)
        self.shown = tag not in HIDDEN and not (foreign and tag in FOREIGN_HIDDEN) and style.get("display", "none" if taken else "") != "none"
        said = style.get("visibility", "")
        self.visible = False if said in ("hidden", "collapse") else True if said == "visible" else None


#: The pieces of a tag: its name, an attribute's name, an unquoted value, and what stands between attributes.
_TAG_NAME = re.compile(r"[^ \t\n\r\f/>]+")
_BETWEEN = re.compile(r"[ \t\n\r\f/]*")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\r\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
_UNQUOTED = re.compile(r"[^ \t\n\r\f>]*")
_COMMENT_END = re.compile(r"--!?>")


@lru_cache(16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[ \\t\\n\\r\\f/>])", re.IGNORECASE)


class TreeBuilder:
    """Builds the tree; ``root`` has it. Each character is read once: what has no end reaches to the end of the page."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of open elements by tag, so that closing doesn't walk a deep stack

    def feed(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            sign = html.find("<", at)
            after = html[sign + 1 : sign + 3] if sign >= 0 else ""
            while sign >= 0 and not (after[:1].isascii() and after[:1].isalpha() or after[:1] in ("!", "?") or (after[:1] == "/" and len(after) > 1)):
                sign = html.find("<", sign + 1)
                after = html[sign + 1 : sign + 3] if sign >= 0 else ""
            if sign != at:
                self.handle_data(unescape(html[at : sign if sign >= 0 else end]))
                if sign < 0:
                    return
            if after[0].isalpha():
                at = self._start(html, sign)
            elif after[0] == "/" and after[1].isascii() and after[1].isalpha():
                name = _TAG_NAME.match(html, sign + 2)
                at = self._attributes(html, name.end(), {})[0]
                if at <= end:
                    self.handle_endtag(name[0].lower())
            elif html.startswith("<!--", sign):
                short = next((s for s in ("<!-->", "<!--->") if html.startswith(s, sign)), None)
                found = None if short else _COMMENT_END.search(html, sign + 4)
                at = sign + len(short) if short else found.end() if found else end
            elif html.startswith("<![CDATA[", sign) and self.open[-1].foreign:
                stop = html.find("]]>", sign)
                self.handle_data(html[sign + 9 : stop if stop >= 0 else end])
                at = stop + 3 if stop >= 0 else end
            else:
                stop = html.find(">", sign)
                at = stop + 1 if stop >= 0 else end

    def _attributes(self, html: str, at: int, into: dict[str, str]) -> tuple[int, bool]:
        """Read to behind the tag's end; past the end of the page if it has none. Also whether the tag ends itself."""
        end = len(html)
        while True:
            between = _BETWEEN.match(html, at)
            at = between.end()
            if at >= end:
                return end + 1, False
            if html[at] == ">":
                return at + 1, between[0].endswith("/")
            name = _ATTRIBUTE.match(html, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    stop = html.find(quote, at + 1)
                    if stop < 0:
                        return end + 1, False
                    value, at = html[at + 1 : stop], stop + 1
                else:
                    found = _UNQUOTED.match(html, at)
                    value, at = found[0], found.end()
            into.setdefault(name[0].lower(), unescape(value) if "&" in value else value)

    def _start(self, html: str, at: int) -> int:
        name, attrs = _TAG_NAME.match(html, at + 1), {}
        tag = name[0].lower()
        at, ended = self._attributes(html, name.end(), attrs)
        if at > len(html):
            return at
        self.handle_starttag(tag, attrs, ended)
        if self.open[-1].foreign or self.open[-1].tag != tag:
            return at
        if tag == "plaintext":
            self.handle_data(html[at:])
            return len(html)
        if tag in RAW or tag in RAW_WITH_REFERENCES:
            found = _raw_end(tag).search(html, at)
            stop = found.start() if found else len(html)
            text = html[at:stop]
            if text:
                self.open[-1].children.append(unescape(text) if tag in RAW_WITH_REFERENCES else text)
            return stop
        return at

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _pop(self) -> None:
        self.places[self.open.pop().tag].pop()

    def _last(self, tags: frozenset[str]) -> int:
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)

    def _close(self, tags: frozenset[str], barrier: frozenset[str]) -> None:
        at = self._last(tags)
        if at and at >= self._last(barrier):
            while len(self.open) > at:
                self._pop()

    def _end_head(self) -> None:
        if self.open[-1].tag == "head":
            self._pop()

    def _in_foreign(self) -> bool:
        return self.open[-1].foreign and self.open[-1].tag not in HTML_AGAIN

    def _open_row(self, tag: str) -> None:
        """The row group and the row that a part of a table stands in, if the author left them out."""
        top = max((self.places[part][-1], part) for part in ("table", "tr", *ROW_GROUPS) if self.places.get(part))[1]
        for part in ([] if top == "tr" else ["tr"]) if tag != "tr" else []:
            if top == "table":
                self._enter("tbody")
            self._enter(part)
        if tag == "tr" and top == "table":
            self._enter("tbody")

    def _enter(self, tag: str) -> None:
        node = Node(tag, {})
        self.open[-1].children.append(node)
        self._push(node)

    def handle_starttag(self, tag: str, attrs: dict[str, str], ended: bool = False) -> None:
        if tag in ENDS_FOREIGN:
            while self._in_foreign():
                self._pop()
        if tag not in HEAD_CONTENT:
            self._end_head()
        is_foreign = tag in FOREIGN or self._in_foreign()
        if tag in TABLE_PARTS and not is_foreign:
            if not self.places.get("table"):
                return
            for tags, barrier in CLOSES.get(tag, ()):
                self._close(tags, barrier)
            if tag in ("td", "th", "tr"):
                self._open_row(tag)
        else:
            for tags, barrier in CLOSES.get(tag, ()):
                self._close(tags, barrier)
        node = Node("img" if tag == "image" and not is_foreign else tag, attrs, is_foreign)
        self.open[-1].children.append(node)
        if tag not in VOID and not (ended and node.foreign):
            self._push(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._end_head()
            self.open[-1].children.append(Node("br", {}))
        elif tag not in VOID:
            inside = frozenset() if tag in ("table", "tr", "td", "th", "html", "body") or tag in ROW_GROUPS else frozenset(["td", "th", "caption"])
            self._close(frozenset([tag]), inside)

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._end_head()
        self.open[-1].children.append(data)


class Page:
    """Lines so far; blank lines and spaces wait until something follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.prefix: list[str] = []
        self.mark: str | None = None

    def end_line(self, spaced: bool = False) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            mark = self.mark or ""
            indent = "".join(self.prefix[:INDENT_MOST])
            self.lines.append(((indent[: -len(mark)] + mark) if mark else indent) + "".join(self.line))
            self.mark, self.line = None, []
        self.space = False
        self.blank = self.blank or spaced

    def words(self, text: str) -> None:
        parts = _SPACES.split(text)
        for n, part in enumerate(parts):
            if n:
                self.space = True
            if part:
                if self.space and self.line:
                    self.line.append(" ")
                self.line.append(part)
                self.space = False

    def as_is(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for line in rest:
            if not self.line or not any(self.line):
                self.line = [""]
            self.end_line()
            self.line.append(line)

    def done(self) -> list[str]:
        self.end_line()
        lines = [line.rstrip() for line in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "")
    return min(max(int(value), 1), SPAN_MOST) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _rows(table: Node, visible: bool) -> tuple[list[list[tuple[Node, bool]]], list[tuple[Node, bool]]]:
    """Rows of cells, and what a table holds besides (captions, misplaced content), each with the visibility that it inherits."""
    rows: list[list[tuple[Node, bool]]] = []
    others: list[tuple[Node, bool]] = []

    def inherited(node: Node, before: bool) -> bool:
        return before if node.visible is None else node.visible

    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                others.append((_wrapped([child]), visible))
        elif not child.shown:
            continue
        elif child.tag in ROW_GROUPS or child.tag == "tr":
            of_group = inherited(child, visible)
            for row in [child] if child.tag == "tr" else child.children:
                if isinstance(row, str):
                    if row.strip():
                        others.append((_wrapped([row]), of_group))
                elif row.tag == "tr" and row.shown:
                    of_row = inherited(row, of_group)
                    cells = [c for c in row.children if (c.strip() if isinstance(c, str) else c.shown)]
                    rows.append([(c, inherited(c, of_row)) if not isinstance(c, str) and c.tag in ("td", "th") else (_wrapped([c]), of_row) for c in cells])
                elif row.shown:
                    others.append((_wrapped([row]), of_group))
        elif child.tag not in ("colgroup", "col"):
            others.append((_wrapped([child]), visible))
    return rows, others


def _wrapped(children: list) -> Node:
    node = Node("div", {})
    node.children = children
    return node


#: A piece of a page that is laid out on its own: an element, the number of tables around it, and the visibility that it inherits.
Piece = tuple[Node, int, bool]
#: Layouts ask for the lines of pieces and go on when they get them, so that nesting needs no recursion.
Layout = Iterator  # of Piece, sent list[str], returns list[str]


def _table_lines(rows: list[list[tuple[Node, bool]]], depth: int) -> Layout:
    placed: list[list[tuple[int, list[str]]]] = []
    below: list[tuple[int, int, int]] = []  # columns that cells of earlier rows take: first, end, rows left
    widths: dict[int, int] = {}
    for row in rows:
        column, cells, taken, n = 0, [], below, 0
        below = [(first, end, left - 1) for first, end, left in taken if left > 1]
        for cell, visible in row:
            while n < len(taken) and taken[n][0] <= column:
                column = max(column, taken[n][1])
                n += 1
            lines = yield cell, depth + 1, visible
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
            cells.append((column, lines))
            if wide == 1:
                widths[column] = max(widths.get(column, 0), *[len(line) for line in lines], 0)
            if high > 1:
                below.append((column, column + wide, high - 1))
            column += wide
        below.sort()
        placed.append(cells)
    columns = sorted(widths)
    upto = list(accumulate((widths[c] for c in columns), initial=0))

    def begins(column: int) -> int:
        return 2 * column + upto[bisect_left(columns, column)]

    aligned = sum(begins(cells[-1][0]) * max(len(lines) for _, lines in cells) for cells in placed if cells) <= BLANKS_MOST
    out = []
    for cells in placed:
        for n in range(max((len(lines) for _, lines in cells), default=0)):
            line, at = [], 0
            for column, lines in cells:
                if n < len(lines) and lines[n]:
                    blanks = max(begins(column) - at if aligned else 0, 2 if at else 0)
                    line += [" " * blanks, lines[n]]
                    at += blanks + len(lines[n])
            out.append("".join(line))
    return out


def _lines(root: Node, depth: int, visible: bool) -> Layout:
    """The lines of an element's content."""
    page = Page()
    todo: list = [iter(root.children)]
    ends: list = [None]
    seen: list[bool] = [visible]
    numbers: list[int | None] = []
    pre = 1 if root.tag == "pre" else 0
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            seen.pop()
            end = ends.pop()
            if end:
                if end == "text":
                    page.space = True
                    continue
                if end == "pre":
                    pre -= 1
                if end in ("ul", "ol", "menu"):
                    numbers.pop()
                page.end_line(end in SPACED and not (end in ("ul", "ol", "menu") and numbers))
                if end in ("li", "blockquote", "dd"):
                    page.prefix.pop()
                    if end == "li":
                        page.mark = None
            continue
        if isinstance(child, str):
            if seen[-1]:
                page.as_is(child) if pre else page.words(child)
            continue
        tag = child.tag
        if not child.shown:
            continue
        now = seen[-1] if child.visible is None else child.visible
        if tag == "br":
            if not page.line:
                page.line.append("")
            page.end_line()
            continue
        if tag == "hr":
            page.end_line(True)
            continue
        if tag == "img":
            if now:
                page.words(" " + child.attrs.get("alt", "") + " ")
            continue
        if tag == "input":
            if now and (child.attrs.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search"):
                page.words(" " + child.attrs.get("value", "") + " ")
            continue
        if tag == "table" and not child.foreign and depth < TABLES_MOST:
            page.end_line(True)
            rows, others = _rows(child, now)
            lines = []
            for other, its in others:
                lines += yield other, depth + 1, its
            lines += yield from _table_lines(rows, depth)
            for line in lines:
                page.line.append(line)
                page.end_line()
            page.end_line(True)
            continue
        block = tag in BLOCKS or tag in SPACED or tag in ("tr", "td", "th") or tag in ROW_GROUPS
        if block:
            page.end_line(tag in SPACED and not (tag in ("ul", "ol", "menu") and numbers))
        if tag in ("ul", "ol", "menu"):
            start = child.attrs.get("start", "")
            numbers.append((int(start) if re.fullmatch(r"[0-9]{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "li":
            mark = "- "
            if numbers and numbers[-1] is not None:
                mark = f"{numbers[-1]}. "
                numbers[-1] += 1
            page.prefix.append(" " * len(mark))
            page.mark = mark
        elif tag in ("blockquote", "dd"):
            page.prefix.append("  ")
        elif tag == "pre":
            pre += 1
        label = tag == "text" and child.foreign
        if tag == "textarea" or label:
            page.space = True
        todo.append(iter(child.children))
        ends.append(tag if block or label else None)
        seen.append(now)
    return page.done()


def layout(root: Node) -> list[str]:
    """The lines of a page."""
    running, answer = [_lines(root, 0, True)], None
    while True:
        try:
            piece = running[-1].send(answer)
            running.append(_lines(*piece))
            answer = None
        except StopIteration as done:
            running.pop()
            answer = done.value
            if not running:
                return answer


def visible_text(html: str | None) -> str:
    """The page as text."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html.replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join(layout(builder.root))


@F.arrow_udf(T.StringType())
def text_of(pages: pa.Array) -> pa.Array:
    """The visible text of each page."""
    return pa.array([visible_text(h) for h in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """The pages with a column of visible text (an equally named one is replaced)."""
    return pages.withColumn(into, text_of(F.col(html)))
