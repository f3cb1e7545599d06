"""Layout-aware text of HTML pages.

A tolerant tokenizer feeds a tree builder that supplies omitted tags and moves stray content
of tables before them; the visible text is emitted with block spacing, list markers and table
cells padded to the width of their columns.  ``display: none`` and ``hidden`` remove an element with
all below it; ``visibility`` is inherited and may be set back.  Pictures and drawings have no text.
"""

from __future__ import annotations

import heapq
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_name, table

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link datalist iframe object svg audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre section table ul menu footer header nav".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption legend optgroup option summary".split())
#: A start tag ends an open one of these, up to the boundary elements.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption html body template".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template head".split())
IN_TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
KEPT_IN_TABLE = TABLE_PARTS | {"script", "style", "template"}
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
#: The greatest spans of a cell in the HTML standard.
COLSPAN, ROWSPAN = 1000, 65534
#: Blanks fill a column up to this width and a line up to this place; what is longer stands two blanks further on.
COLUMN_WIDTH, LINE_WIDTH = 80, 400
#: Blanks before a line at most, however deep its list or quotation is; and tables inside tables that are aligned, deeper ones are blocks.
INDENT_WIDTH, NESTED = 80, 16
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        #: Places of each tag among the open elements, so that no tag is searched for in all of them.
        self.at: dict[str, list[int]] = {}

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags; 0, the root's, for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _cut(self, place: int) -> None:
        """Closes the open elements from ``place`` on."""
        for node in self.open[place:]:
            self.at[node.tag].pop()
        del self.open[place:]

    def _end(self, tags, stop) -> None:
        """Closes the innermost open element among ``tags`` unless a ``stop`` element lies inside it."""
        found = self._last(tags)
        if found and found > self._last(stop - tags):
            self._cut(found)

    def _parent(self, tag: str | None) -> tuple[Node, int]:
        """Where a new node goes: under the innermost open element or, for what a table cannot hold there, before that table."""
        here = self.open[-1]
        if here.tag in IN_TABLE and tag not in KEPT_IN_TABLE:
            place = self._last({"table"})
            if place:
                above = self.open[place - 1]
                return above, next(i for i in range(len(above.kids) - 1, -1, -1) if above.kids[i] is self.open[place])
        return here, len(here.kids)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag in CLOSES_P:
            self._end({"p"}, SCOPE)
        if tag in IMPLIED_END:
            ends, stop = IMPLIED_END[tag]
            before = None
            while before != len(self.open):
                before = len(self.open)
                self._end(ends, stop)
        if tag in TABLE_PARTS and self.at.get("table"):
            inside = self._last(IN_TABLE)
            if inside > self._last({"td", "th", "caption"}):
                self._cut(inside + 1)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        node = self._push(tag, dict(attrs))
        if tag in VOID:
            self._cut(len(self.open) - 1)
        return node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and self.at.get("svg", self.at.get("math")):
            self._cut(len(self.open) - 1)

    def _push(self, tag, attrs):
        node = Node(tag, attrs)
        parent, place = self._parent(tag)
        parent.kids.insert(place, node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)
        return node

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.open[-1].kids.append(Node("br", {}))
            return
        found = self._last({tag})
        walls = () if tag in TABLE_PARTS or tag == "table" else ("td", "th", "table")
        if found and found >= self._last(walls):
            self._cut(found)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        parent, place = self._parent(None) if data.strip() else (self.open[-1], len(self.open[-1].kids))
        parent.kids.insert(place, data)


def hidden(node: Node) -> bool:
    """Neither the element nor anything below it is laid out."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "input" and (a.get("type") or "").lower() == "hidden":
        return True
    display = DISPLAY.findall(a["style"]) if a.get("style") else ()
    return display[-1].lower() == "none" if display else "hidden" in a


def visible(node: Node, above: bool) -> bool:
    """Whether the element's own text shows, by its ``visibility`` or else that of the element above."""
    found = VISIBILITY.findall(node.attrs["style"]) if node.attrs.get("style") else ()
    return found[-1].lower() not in ("hidden", "collapse") if found and found[-1].lower() != "inherit" else above


class Flow:
    """Lines under construction: pending blank lines, collapsed white space, indentation and a marker for the next line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = 0
        self.marker = None
        self.blank = False
        self.space = False

    def text(self, data: str, keep: bool) -> None:
        if keep:
            parts = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self._flush(True)
                if part:
                    self.line.append(part)
            return
        body = SPACE.sub(" ", data)
        if body == " " or not body:
            self.space = self.space or bool(body and self.line)
            return
        if body[0] == " ":
            self.space = True
            body = body[1:]
        if self.space and self.line:
            self.line.append(" ")
        self.space = body[-1:] == " "
        self.line.append(body.rstrip(" "))

    def _flush(self, even_empty: bool = False) -> None:
        self.space = False
        line = "".join(self.line).rstrip(" ")
        self.line = []
        if not line and not even_empty:
            return
        self._put(line)

    def _put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = " " * min(self.indent, INDENT_WIDTH)
        if self.marker is not None:
            lead, self.marker = self.marker, None
        self.lines.append((lead + line).rstrip(" ") if line else "")

    def brk(self, even_empty: bool = False) -> None:
        self._flush(even_empty)

    def gap(self) -> None:
        self._flush()
        if self.marker is None:
            self.blank = True

    def block(self, lines: list[str]) -> None:
        self._flush()
        for line in lines:
            self._put(line)

    def result(self) -> list[str]:
        self._flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _table_rows(node: Node) -> tuple[list[Node], list[Node]]:
    rows, captions, todo = [], [], [k for k in node.kids][::-1]
    while todo:
        k = todo.pop()
        if isinstance(k, str) or hidden(k):
            continue
        if k.tag == "tr":
            rows.append(k)
        elif k.tag == "caption":
            captions.append(k)
        elif k.tag in ("thead", "tbody", "tfoot"):
            todo += k.kids[::-1]
    return rows, captions


def _span(cell: Node, name: str, most: int) -> int:
    n = cell.attrs.get(name) or ""
    if not (n.isascii() and n.isdecimal()):
        return 1
    n = int(n[:9])
    return most if n == 0 and name == "rowspan" else min(max(n, 1), most)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def _aligned(node: Node, show: bool, done: dict) -> list[str]:
    """Caption lines, then one line group for each row: cells padded to their column's width, two blanks apart.

    Cells stand in their columns, spans of columns and rows counted; columns without text take no room.
    """
    rows, captions = _table_rows(node)
    out = [line for c in captions for line in layout(c, visible(c, show), done)]
    grid: list[list[tuple[int, list[str]]]] = []
    # cells that reach down: (row after their last, first column, end), and the columns they hold as joined ranges; those that reach
    # the table's end are joined once for all
    held: list[tuple[int, int, int]] = []
    lasting: list[tuple[int, int]] = []
    taken: list[tuple[int, int]] = []
    widths: dict[int, int] = {}
    for row, r in enumerate(rows):
        if held and held[0][0] <= row:
            while held and held[0][0] <= row:
                heapq.heappop(held)
            taken = _joined([*lasting, *((a, e) for _, a, e in held)])
        cells, col, nxt, fresh, down = [], 0, 0, [], []
        for c in r.kids:
            if isinstance(c, str) or hidden(c) or c.tag not in ("td", "th"):
                continue
            wide, tall = _span(c, "colspan", COLSPAN), _span(c, "rowspan", ROWSPAN)
            while nxt < len(taken) and taken[nxt][0] <= col:
                col, nxt = max(col, taken[nxt][1]), nxt + 1
            lines = layout(c, visible(c, visible(r, show)), done)
            if lines:
                cells.append((col, lines))
                widths[col] = max(widths.get(col, 0), min(COLUMN_WIDTH, max(map(len, lines))))
            if tall > 1:
                fresh.append((col, col + wide))
                if row + tall < len(rows):
                    heapq.heappush(held, (row + tall, col, col + wide))
                else:
                    down.append((col, col + wide))
            col += wide
        if fresh:
            taken = _joined(taken + fresh)
        if down:
            lasting = _joined(lasting + down)
        grid.append(cells)
    place, at = {}, 0
    for col in sorted(widths):
        place[col] = at
        at += widths[col] + 2
    for cells in grid:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for col, lines in cells:
                if k < len(lines) and lines[k]:
                    # a cell wider than its column pushes the next ones on
                    line = line.ljust(max(min(place[col], LINE_WIDTH), len(line) + 2 if line else 0)) + lines[k]
            out.append(line)
    return out


def layout(root: Node, show: bool, done: dict) -> list[str]:
    """Lines of the visible text under ``root``; ``done`` holds the lines of the tables below it."""
    flow = Flow()
    todo: list = [("in", k, False, show) for k in root.kids[::-1]]
    counters: list[list] = []
    while todo:
        what, node, pre, show = todo.pop()
        if what == "out":
            tag = node.tag
            if tag in ("ul", "ol", "menu"):
                counters.pop()
                flow.gap() if not counters else flow.brk()
            elif tag == "li":
                flow.brk()
                flow.indent, flow.marker = flow.indent - node.attrs["\0width"], None
            elif tag in ("dd", "blockquote"):
                flow.brk()
                flow.indent -= 2
                if tag == "blockquote":
                    flow.gap()
            elif tag in SPACED:
                flow.gap()
            else:
                flow.brk()
            continue
        if isinstance(node, str):
            if show:
                flow.text(node, pre)
            continue
        if hidden(node):
            continue
        tag, show = node.tag, visible(node, show)
        if tag == "br":
            flow.brk(True)
            continue
        if tag == "hr":
            flow.gap()
            if show:
                flow.block(["---"])
            flow.gap()
            continue
        if tag == "img" or tag == "input":
            continue
        if tag == "table" and id(node) in done:
            flow.gap()
            flow.block(done[id(node)])
            flow.gap()
            continue
        if tag in BLOCK:
            if tag in ("ul", "ol", "menu"):
                flow.gap() if not counters else flow.brk()
                first = node.attrs.get("start") or "1"
                counters.append([tag == "ol", int(first) if first.isascii() and first.isdecimal() and len(first) < 9 else 1])
            elif tag == "li":
                flow.brk()
                mark = "- "
                if counters and counters[-1][0]:
                    mark = f"{counters[-1][1]}. "
                    counters[-1][1] += 1
                flow.marker = " " * min(flow.indent, INDENT_WIDTH) + mark if show else None
                flow.indent += len(mark)
                node.attrs["\0width"] = len(mark)
            elif tag in ("dd", "blockquote"):
                flow.gap() if tag == "blockquote" else flow.brk()
                flow.indent += 2
            elif tag in SPACED:
                flow.gap()
            else:
                flow.brk()
            todo.append(("out", node, pre, show))
        inner = pre or tag in ("pre", "textarea")
        todo += [("in", k, inner, show) for k in node.kids[::-1]]
    return flow.result()


def _tables(root: Node) -> list[tuple[Node, bool]]:
    """All tables that are aligned, outer ones before inner ones, and whether their own text shows; those in ``NESTED`` tables are not."""
    out, todo = [], [(root, True, 0)]
    while todo:
        node, show, depth = todo.pop()
        show = visible(node, show)
        if node.tag == "table":
            if depth < NESTED:
                out.append((node, show))
            depth += 1
        todo += [(k, show, depth) for k in node.kids if not isinstance(k, str) and not hidden(k)]
    return out


def render(html: str | None) -> str:
    """Visible text of a page; null and empty pages give an empty text."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    done: dict[int, list[str]] = {}
    for node, show in reversed(_tables(builder.root)):
        done[id(node)] = _aligned(node, show, done)
    return "\n".join(layout(builder.root, True, done))


def html_text(html):
    @F.pandas_udf(T.StringType())
    def run(pages):
        import pandas as pd

        return pd.Series([render(p) for p in pages], dtype=object)

    return run(html)


def extract_pages(pages: DataFrame, html: str = "html", out: str = "page_text") -> DataFrame:
    """All rows and columns of ``pages`` plus the visible text in column ``out``, which must be new.

    Null and empty pages give an empty text; pages of any length and depth are read whole, in time that grows with
    their length; repeated rows get equal texts; an empty table gives an empty result.
    """
    return pages.withColumn(new_name(pages, out), html_text(F.col(html)))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; nulls, empty and long pages, repeats and empty tables as ``extract_pages`` says."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
