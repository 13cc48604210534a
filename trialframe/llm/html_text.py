"""Visible text of HTML pages, laid out: a tree builder with implied tags, then a renderer over the tree.

Tree: tags of broken pages are completed as browsers do in the common cases (a block ends an open paragraph, a
list item, table row or cell ends the one before, end tags close what is open inside them but never leave a
table cell, void elements hold nothing). Scripts, styles and other raw elements are read up to their end tag.

Visibility: the head, scripts, styles, templates, `hidden`, `display:none`, `<noscript>`, media fallbacks,
what inherits `visibility:hidden` (an element inside may be visible again), closed `<details>` (but their summary), closed dialogs and the unchosen options of a menu
do not show. Formulas (`<math>`) show without their annotations; of drawings (`<svg>`) the texts show, without
title, desc, metadata and what is only defined (defs, symbol, mask and the like).

Layout: white space collapses but in `<pre>`; blocks start lines, paragraphs, headings, lists and tables are
set off by a blank line; list items carry a bullet or their number (`start`, `value`, `reversed`) and are indented by depth; the
cells of a table stand in a grid with its row and column spans and are padded to the width of their column, wide
characters counted twice. A cell that would overlap one from above moves right. A table whose padding would outgrow
its text many times is written without padding, so the output stays in proportion to the page.

Pages are independent rows, parsed in Arrow batches without recursion, so depth and length of a page are not
limited, and neither are its open quotes and brackets: a tag that no `>` outside quotes ends, ends at the next `>`,
and quotes count no more in the rest of that page. Defined cases: a null or empty page has the empty text; a page without tags is its own text; rows that
repeat give repeated rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset(
    "audio canvas datalist embed head iframe noembed noframes noscript object script style template title video".split()
)
#: What formulas and drawings do not show; of a drawing only its texts show.
UNDRAWN = frozenset(
    "annotation annotation-xml clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split()
)
FOREIGN = frozenset(("math", "svg"))
DRAWN_TEXT = frozenset(("foreignobject", "text"))
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr menu".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main"
    " nav optgroup option search section select summary tr caption thead tbody tfoot".split()
)
ENDS_PARAGRAPH = (BLOCK | {"td", "th"}) - {"option", "optgroup", "select", "body", "html"}
#: What an element's start closes, and the ancestors that this does not reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements that end an open formula or drawing, and where HTML goes on inside one.
BREAKOUT = (BLOCK - {"form", "option", "optgroup", "select", "html"}) | frozenset("b br code em i img span strong".split())
INTEGRATION = frozenset("annotation-xml desc foreignobject mi mn mo ms mtext table td th caption".split())
HEAD = frozenset("html head base link meta noscript script style template title".split())
FENCE = frozenset(("table", "td", "th", "caption"))
BUTTON = FENCE | {"button"}
_TABLE = frozenset(("table",))
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())

#: A quoted value, whatever its length; one whose closing quote is missing ends with its tag.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+')"""
_START = re.compile(r"<[a-zA-Z!?]|</[a-zA-Z]")
_HEAD = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(rf"{_HEAD}((?:[^>=]++|{_VALUE}|=)*+)>", re.S)
_PLAIN = re.compile(rf"{_HEAD}([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_STYLE = re.compile(r"(?<![-\w])(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: Tables inside tables that are laid out as such, and lists inside lists that are indented; deeper ones are plain blocks.
DEPTH = 32
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BLANKS = " \t\n\r\f"


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] or ""
        found.setdefault(m[1].lower(), unescape(value.strip("\"'")))
    return found


def tree(html: str) -> Node:
    """The element tree of a page; children are nodes and strings."""
    root = Node("html", {})
    open_: list[Node] = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag

    def close(to: int) -> None:
        for node in open_[to:]:
            places[node.tag].pop()
        del open_[to:]

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def find(wanted, fence) -> int:
        """Place of the innermost wanted open element that no fence hides, or 0."""
        k = innermost(wanted)
        return k if k > innermost(fence - wanted) else 0

    def outermost(wanted, fence) -> int:
        """The same for the outermost one."""
        low = innermost(fence)
        return min((places[t][bisect_right(places[t], low)] for t in wanted if places[t] and places[t][-1] > low), default=0)

    def text(s: str) -> None:
        if s:
            if places["head"] and s.strip(_BLANKS):
                close(places["head"][0])
            open_[-1].children.append(unescape(s) if "&" in s else s)

    at, lowered, token = 0, None, _TOKEN
    while True:
        start = _START.search(html, at)
        m = token.match(html, start.start()) if start else None
        if start and not m and token is _TOKEN:
            token = _PLAIN
            m = token.match(html, start.start())
        text(html[at : m.start()] if m else html[at:])
        if not m:
            return root
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                open_[-1].children.append(Node("br", {}))
            elif tag == "p" and not find({"p"}, FENCE):
                open_[-1].children.append(Node("p", {}))
            elif k := find({tag}, _TABLE if tag in TABLE_PARTS else FENCE):
                close(k)
            continue
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        attributes = _attributes(source) if (source := m[3] or "").strip() else {}
        if tag not in HEAD and places["head"]:
            close(places["head"][0])
        if tag in BREAKOUT and (k := find(FOREIGN, INTEGRATION)):
            close(k)
        if tag in ENDS_PARAGRAPH and (k := find({"p"}, BUTTON)):
            close(k)
        if tag in IMPLIED and (k := outermost(*IMPLIED[tag])):
            close(k)
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag in VOID or (source.endswith("/") and (tag in FOREIGN or find(FOREIGN, INTEGRATION))):
            continue
        if tag in RAW:
            lowered = html.lower() if lowered is None else lowered
            if len(lowered) != len(html):  # a character whose lower case is longer
                lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
            end = lowered.find(f"</{tag}", at)
            body = html[at : end if end >= 0 else len(html)]
            if tag in ("textarea", "xmp"):
                node.children.append(unescape(body) if tag == "textarea" else body)
            stop = html.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else len(html)
            continue
        places[tag].append(len(open_))
        open_.append(node)


def _styles(node: Node) -> dict[str, str]:
    """Display and visibility of an element's own style; the last one counts."""
    source = node.attributes.get("style")
    return {k.lower(): v.lower() for k, v in _STYLE.findall(source)} if source else {}


def _chosen(menu: Node) -> set[int]:
    """The options of a menu that show: the selected ones, or the first."""
    options = [x for x in menu.children if isinstance(x, Node) and x.tag == "option"]
    return {id(x) for x in options if "selected" in x.attributes} or {id(x) for x in options[:1]}


def _gone(node: Node, display: str | None) -> bool:
    """Whether an element takes no place at all."""
    return node.tag in UNSEEN or "hidden" in node.attributes or display == "none" or (
        node.tag == "dialog" and "open" not in node.attributes)


class Canvas:
    """Lines of laid-out text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.margin = 0
        self.blank = False
        self.indent = ""
        self.marker = ""

    def write(self, s: str, kept: bool) -> None:
        if kept:
            first, *more = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in more:
                self.end_line()
                self._put(x)
            return
        inner = s.strip(_BLANKS)
        if not inner:
            self.blank = self.blank or bool(s)
            return
        if s[0] in _BLANKS:
            self.blank = True
        inner = _SPACE.sub(" ", inner)
        self._put(" " + inner if self.blank and self.line else inner)
        self.blank = s[-1] in _BLANKS

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.margin > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.margin = 0
            if self.marker:
                self.line.append(self.marker)
                self.marker = ""
            else:
                self.line.append(self.indent)
        self.line.append(s)

    def end_line(self) -> None:
        if self.line or self.lines:
            self.lines.append("".join(self.line).rstrip(_BLANKS))
        self.line, self.blank = [], False

    def block(self, margin: int) -> None:
        if self.line:
            self.end_line()
        self.blank = False
        self.margin = max(self.margin, margin)

    def text(self) -> str:
        self.block(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines).replace("\xa0", " ")


def _width(s: str) -> int:
    """Columns that a text takes on a page of fixed pitch."""
    return len(s) if s.isascii() else sum(0 if combining(c) else 1 + (east_asian_width(c) in "WF") for c in s)


def _whole(source: str | None, default: int) -> int:
    return int(source) if source and re.fullmatch(r"-?\d{1,9}", source) else default


class Cell:
    __slots__ = ("columns", "down", "end", "lines", "row", "start")

    def __init__(self, text: str, columns: int, down: int):
        self.lines, self.columns, self.down = text.split("\n"), columns, down


class Table:
    """Rows of rendered cells."""

    #: Padding allowed for each character of a table, places looked at for each cell, and what any table may have.
    PADDING, PLACES, FREE = 16, 64, 1 << 16

    def __init__(self):
        self.rows: list[list[Cell]] = []
        self.groups: list[int] = []  # rows at which a group begins; no cell reaches beyond its group

    def _placed(self) -> bool:
        """Give every cell its columns; false if that takes too many steps."""
        held: list[Cell] = []  # from rows above, by column
        ends = sorted({*self.groups, len(self.rows)})
        left = self.FREE + self.PLACES * sum(map(len, self.rows))
        for k, row in enumerate(self.rows):
            limit = ends[bisect_right(ends, k)]
            held = [c for c in held if c.row + c.down > k]
            left -= len(held)
            if left < 0:
                return False
            at, h = 0, 0
            for cell in row:
                while h < len(held) and held[h].start < at + cell.columns:
                    at, h = max(at, held[h].end), h + 1
                cell.row, cell.start, cell.end = k, at, at + cell.columns
                cell.down = min(cell.down or limit - k, limit - k)  # zero reaches to the end of the group
                at = cell.end
            held = sorted([*held, *[c for c in row if c.down > 1]], key=lambda c: c.start)
        return True

    def lines(self) -> list[str]:
        cells = [c for row in self.rows for c in row]
        own = sum(len(x) for c in cells for x in c.lines)
        if not self._placed():
            return self._plain()
        # Only columns in which a cell starts are told apart.
        edges = sorted({c.start for c in cells})
        for c in cells:
            c.start, c.end = bisect_right(edges, c.start) - 1, bisect_right(edges, c.end - 1)
        if sum(c.end - c.start for c in cells) > self.FREE + self.PLACES * len(cells):
            return self._plain()
        width = [0] * len(edges)
        for c in sorted(cells, key=lambda c: c.end - c.start):
            room = sum(width[c.start : c.end]) + 3 * (c.end - c.start - 1)
            width[c.end - 1] += max(max(map(_width, c.lines)) - room, 0)
        height = [max((len(c.lines) if c.down == 1 else 1 for c in row), default=0) for row in self.rows]
        for c in cells:
            if c.down > 1:
                last = c.row + c.down - 1
                height[last] += max(len(c.lines) - sum(height[c.row : last + 1]), 0)
        if sum(height) * (sum(width) + 3 * len(width)) > self.FREE + self.PADDING * own:
            return self._plain()
        top = [0]
        for x in height:
            top.append(top[-1] + x)
        grid: list[list[tuple[int, str]]] = [[] for _ in range(top[-1])]
        for c in cells:
            for k, x in enumerate(c.lines):
                if x:
                    grid[top[c.row] + k].append((c.start, x))
        left = [0]  # where each column begins
        for x in width:
            left.append(left[-1] + x + 3)
        starts: list[list[int]] = [[] for _ in self.rows]
        for c in cells:
            for k in range(c.row, c.row + c.down):
                starts[k].append(c.start)
        out = []
        for k, bounds in enumerate(map(sorted, starts)):
            for parts in grid[top[k] : top[k + 1]]:
                text, at, texts = [], 0, dict(parts)
                last = max(texts, default=-1)
                for column in [b for b in bounds if b <= last]:
                    if column:
                        text.append(" " * (left[column] - 3 - at) + " | ")
                        at = left[column]
                    x = texts.get(column, "")
                    text.append(x)
                    at += _width(x)
                out.append("".join(text))
        return [x for x in out if x]

    def _plain(self) -> list[str]:
        """The lines of the cells of each row, without padding."""
        out = []
        for row in self.rows:
            for k in range(max((len(c.lines) for c in row), default=0)):
                out.append(" | ".join(c.lines[k] for c in row if k < len(c.lines) and c.lines[k]))
        return [x for x in out if x]


def render(root: Node) -> str:
    """The visible text of a tree."""
    canvas = Canvas()
    canvases: list[Canvas] = []
    tables: list[Table | None] = []
    lists: list[list] = []  # [ordered, next number, step, indent outside]
    menus: dict[int, set[int]] = {}
    shows = [True]  # the inherited visibility of the open elements
    kept = 0
    foreign: list[bool] = []  # of the open formulas, drawings and their texts: whether strings show
    todo: list[tuple] = [("open", root, root)]
    while todo:
        step = todo.pop()
        if isinstance(step, str):
            if shows[-1] and (not foreign or foreign[-1]):
                canvas.write(step, kept > 0)
            continue
        kind, node, parent = step
        tag = node.tag
        if kind == "open":
            style = _styles(node)
            if _gone(node, style.get("display")) or (foreign and tag in UNDRAWN):
                continue
            if tag == "option":
                if id(parent) not in menus:
                    menus[id(parent)] = _chosen(parent)
                if id(node) not in menus[id(parent)]:
                    continue
            if tag == "br":
                if shows[-1]:
                    canvas.end_line()
                continue
            seen = style.get("visibility", "inherit")
            shows.append(seen in ("visible", "initial") or (seen not in ("hidden", "collapse") and shows[-1]))
            if tag in FOREIGN or (foreign and tag in DRAWN_TEXT):
                foreign.append(tag != "svg")
                canvas.blank = canvas.blank or tag in DRAWN_TEXT  # labels stand apart
            if tag in BLOCK:
                canvas.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag in ("ul", "ol", "menu"):
                back = tag == "ol" and "reversed" in node.attributes
                items = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) if back else 1
                lists.append([tag == "ol", _whole(node.attributes.get("start"), items), -1 if back else 1, canvas.indent])
                canvas.indent = (canvas.indent + "  ")[: 2 * DEPTH]
            elif tag == "li":
                level = lists[-1] if lists else [False, 1, 1]
                level[1] = _whole(node.attributes.get("value"), level[1])
                canvas.marker = canvas.indent[2:] + (f"{level[1]}. " if level[0] else "- ")
                level[1] += level[2]
            elif tag in ("pre", "textarea"):
                kept += 1
            elif tag == "table":
                tables.append(Table() if len(tables) < DEPTH else None)
            elif tag in ("thead", "tbody", "tfoot") and tables and tables[-1]:
                tables[-1].groups.append(len(tables[-1].rows))
            elif tag == "tr" and tables and tables[-1]:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables and not tables[-1]:
                canvas.blank = True
            elif tag in ("td", "th") and tables:
                canvases.append(canvas)
                canvas = Canvas()
            todo.append(("close", node, parent))
            closed = tag == "details" and "open" not in node.attributes
            shown = [x for x in node.children if not closed or (isinstance(x, Node) and x.tag == "summary")]
            todo += [x if isinstance(x, str) else ("open", x, node) for x in reversed(shown)]
            continue
        shows.pop()
        if tag in ("td", "th") and tables and tables[-1]:
            columns = min(max(_whole(node.attributes.get("colspan"), 1), 1), 1000)
            down = min(max(_whole(node.attributes.get("rowspan"), 1), 0), 65534)
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append(Cell(canvas.text(), columns, down))
            canvas = canvases.pop()
        elif tag in FOREIGN or (foreign and tag in DRAWN_TEXT):
            foreign.pop()
            canvas.blank = canvas.blank or tag in DRAWN_TEXT
        elif tag == "table":
            canvas.block(2)
            table = tables.pop()
            for line in table.lines() if table else ():
                canvas.write(line, True)
                canvas.block(0)
        elif tag in ("ul", "ol", "menu"):
            canvas.indent = lists.pop()[3]
        elif tag in ("pre", "textarea"):
            kept -= 1
        elif tag == "li":
            canvas.marker = ""
        if tag in BLOCK:
            canvas.block(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
    return canvas.text()


def visible_text(html: str | None) -> str:
    """The visible text of a page."""
    return render(tree(html)) if html else ""


def extracted(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the markup column replaced by the column `out`; an input column of that name gives way."""
    rows = pages if html == out else pages.drop(out)
    kept = [c for c in rows.columns if c != html]
    at = rows.columns.index(html)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([visible_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != at], found], names=[*kept, out])

    return rows.mapInArrow(run, schema)
