"""Layout-aware rendering of HTML to plain text.

A page becomes a tree (implied end tags, raw-text elements, stray tags tolerated, text between table rows moved before
the table) and the tree is rendered: white space collapses as in a browser, blocks start lines, paragraphs and headings
keep a blank line, list items get bullets or numbers and an indent by depth, preformatted text stays as it is, table
cells stand in aligned columns. What a browser would not show (scripts, styles, templates, the head, elements that are
hidden by attribute or inline style) is left out; all other text is emitted. Nothing recurses, so depth has no limit, and
no part of a page is read again for each tag, so that time grows with the length of the page whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"[=>\"']")
VALUE_SPACE, UNQUOTED = re.compile(r"\s*"), re.compile(r"[^\s>]*")
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Fixed values of HTML: elements without content, with raw text, never shown, and those that start a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript title iframe noembed noframes object datalist link meta base param audio video canvas".split())
#: What may stand in an open head; anything else, and text, closes it.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote dl figure pre table".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
LISTS = {"ul", "ol", "menu", "dir"}
#: Opening the key ends an open element of the value, looked for no farther than the fence.
ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
FENCE = {"table", "td", "th", "caption", "html", "template"}
TABLE_ONLY = {"table", "tbody", "thead", "tfoot", "tr"}
#: Columns are padded up to this width; longer cells push theirs. So many columns are aligned, and so many blanks may stand
#: before a cell; tables nested deeper than this are rendered as blocks, and lists are indented up to so many blanks.
MOST_PAD, MOST_COLUMNS, MOST_BLANKS, MOST_NESTED, MOST_INDENT = 40, 100, 200, 8, 120


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    if not raw.strip(" \t\n\r\f/"):
        return {}
    return {m[1].lower(): unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in ATTRIBUTE.finditer(raw)}


class Tags:
    """Where the tags of a page end. Quotes count only straight after "="; elsewhere a quote is part of a name or of an unquoted
    value. A "<" whose tag never ends is text; every "=" that such a tag has passed is remembered, as another tag that
    comes by there does not end either."""

    def __init__(self, html: str):
        self.html, self.dead = html, set()
        self.marks = {c: [] for c in "=>\"'"}
        for m in MARKS.finditer(html):
            self.marks[m[0]].append(m.start())
        self.stops = sorted(self.marks["="] + self.marks[">"])

    @staticmethod
    def _next(places: list[int], at: int) -> int:
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def end(self, at: int) -> int:
        """The place of the ">" that ends the tag whose name ends at ``at``, or -1."""
        html, passed = self.html, []
        while True:
            at = self._next(self.stops, at)
            if at < 0 or at in self.dead:
                break
            if html[at] == ">":
                return at
            passed.append(at)
            at = VALUE_SPACE.match(html, at + 1).end()
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote:
                at = self._next(self.marks[quote], at + 1) + 1
                if not at:
                    break
            else:
                at = UNQUOTED.match(html, at).end()
        self.dead.update(passed)
        return -1


class Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def deepest(self, tags: set[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def end(self, tags: set[str], fence: set[str]) -> None:
        """Close the innermost of ``tags``, and all within, unless a ``fence`` stands inside it."""
        k = self.deepest(tags)
        if k and (len(tags) == 1 and not fence or self.deepest(fence - tags) < k):
            while len(self.stack) > k:
                self.pop()


def build_tree(html: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    opened, tags = Open(root), Tags(html)
    stack, end = opened.stack, opened.end

    def text(part: str) -> None:
        if not part:
            return
        if stack[-1].tag == "head" and part.strip():
            opened.pop()
        if stack[-1].tag in TABLE_ONLY and part.strip():
            k = opened.deepest({"table"})
            if k:
                stack[k - 1].kids.insert(-1, part)  # an open table is the last of its parent
                return
        stack[-1].kids.append(part)

    at, done, n = 0, 0, len(html)
    while (at := html.find("<", at)) >= 0:
        m = NAME.match(html, at)
        close = tags.end(m.end()) if m else -1
        skip = None if m else COMMENT.match(html, at)
        if close < 0 and skip is None:
            at += 1
            continue
        text(unescape(html[done:at]))
        done = at = close + 1 if m else skip.end()
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif tag not in ("html", "body"):
                end({tag}, FENCE - {tag} if tag not in TABLE_ONLY else {"table"} - {tag})
            continue
        attrs = attributes(html[m.end() : close])
        if tag in ("html", "body"):
            root.attrs = {**attrs, **root.attrs}
            if tag == "body":
                end({"head"}, {"template"})
            continue
        if tag == "head" and len(stack) > 1:
            continue
        if tag in CLOSES_P:
            end({"p"}, FENCE | {"button"})
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].kids.append(row)
            opened.push(row)
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            opened.pop()
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : close.start() if close else n]
            node.kids.append(unescape(body) if tag in ("textarea", "title") else body)
            done = at = close.end() if close else n
        elif tag not in VOID:
            opened.push(node)
    text(unescape(html[done:]))
    return root


class Flow:
    """Lines as they grow."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.spaced = 0, True
        self.mark, self.indent = "", 0

    def add(self, text: str, keep: bool = False) -> None:
        if not keep:
            text = SPACE.sub(" ", text)
            if self.spaced:
                text = text.lstrip(" ")
        if not text:
            return
        if not self.now:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0
            self.now.append(" " * (min(self.indent, MOST_INDENT) - len(self.mark)) + self.mark)
            self.mark = ""
        self.now.append(text)
        self.spaced = not keep and text.endswith(" ")

    def line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.spaced = True

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines)


def width(text: str) -> int:
    """Columns that a text takes in a fixed-width font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def aligned(rows: list[dict[int, list[str]]]) -> list[str]:
    """Rows of cells (lines by column) as lines with aligned columns."""
    wide: dict[int, int] = {}
    for row in rows:
        for k, cell in row.items():
            wide[k] = max([wide.get(k, 0), *(w for w in map(width, cell) if w <= MOST_PAD)])
    columns = sorted(wide)  # where no cell begins nothing is padded
    before = [0]
    for k in columns:
        before.append(before[-1] + wide[k] + 2)
    start = dict(zip(columns, before))
    out = []
    for row in rows:
        for i in range(max(map(len, row.values()), default=0)):
            parts, at = [], 0  # `at` is where the next column begins
            for k, cell in row.items():
                line = cell[i] if i < len(cell) else ""
                parts += [" " * min(start[k] - at, MOST_BLANKS), line, " " * (wide[k] - width(line) + 2)]
                at = start[k] + wide[k] + 2
            out.append("".join(parts).rstrip())
    return out


def _number(value: str | None, low: int, high: int, default: int) -> int:
    value = (value or "").strip()
    return min(max(int(value), low), high) if re.fullmatch(r"-?[0-9]{1,9}", value) else default


class Table:
    """Cells as they are met; a cell that spans rows leaves its place empty below. No row reaches over more columns than the
    widest row has cells, or MOST_COLUMNS; further cells follow without regard to spans."""

    def __init__(self, node: Node):
        count = lambda row: sum(not isinstance(k, str) and k.tag in ("td", "th") for k in row.kids)
        parts = [k for k in node.kids if not isinstance(k, str)]
        parts += [k for part in parts if part.tag in ("tbody", "thead", "tfoot") for k in part.kids if not isinstance(k, str)]
        self.columns = min(max([1, *(count(k) for k in parts if k.tag == "tr")]), MOST_COLUMNS)
        self.rows: list[dict[int, list[str]]] = []
        self.spans, self.at = [0] * self.columns, 0

    def open_row(self) -> None:
        self.rows.append({})
        self.spans, self.at = [max(0, n - 1) for n in self.spans], 0

    def cell(self, lines: list[str], attrs: dict[str, str]) -> None:
        while self.at < self.columns - 1 and self.spans[self.at]:
            self.at += 1
        self.rows[-1][self.at] = lines
        span = _number(attrs.get("colspan"), 1, 1000, 1)
        if self.at < self.columns:
            span = min(span, self.columns - self.at)
            down = _number(attrs.get("rowspan"), 1, 65534, 1)
            self.spans[self.at : self.at + span] = [down] * span
        else:
            span = 1
        self.at += span


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or "hidden" in a or ("style" in a and HIDING.search(a["style"]) is not None) or (node.tag == "input" and a.get("type", "").lower() == "hidden")


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, tables, lists, pre = [Flow()], [], [], 0
    todo: list[tuple[str, Node | str]] = [("open", root)]
    while todo:
        what, node = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if pre:
                for i, part in enumerate(node.split("\n")):
                    if i:
                        if not flow.now:
                            flow.lines.append("")
                        flow.line()
                    flow.add(part, keep=True)
            else:
                flow.add(node)
            continue
        tag = node.tag
        if what == "open":
            if hidden(node):
                continue
            if tag == "br":
                if not flow.now and flow.lines and flow.gap < 2:
                    flow.gap += 1
                flow.line()
                continue
            if tag == "hr":
                flow.block(1)
                flow.add("---")
            elif tag in ("td", "th") and tables and tables[-1]:
                if not tables[-1].rows:
                    tables[-1].open_row()
                flows.append(Flow())
                lists.append(None)
            elif tag == "tr" and tables and tables[-1]:
                tables[-1].open_row()
            elif tag == "table":
                flow.block(2)
                tables.append(Table(node) if len(tables) < MOST_NESTED else None)
            elif tag in BLOCK:
                flow.block(2 if tag in SPACED or (tag in LISTS and not any(lists[-1:])) else 1)
            if tag in LISTS:
                lists.append([_number(node.attrs.get("start"), -(10**9), 10**9, 1) if tag == "ol" else None, flow.indent])
                flow.indent += 2
            elif tag == "li":
                number = lists[-1][0] if lists and lists[-1] else None
                if number is None:
                    flow.mark = "- "
                else:
                    lists[-1][0] = number + 1
                    flow.mark = f"{number}. "
                flow.indent = (lists[-1][1] if lists and lists[-1] else 0) + max(2, len(flow.mark))
            elif tag in ("blockquote", "dd"):
                flow.indent += 2
            pre += tag in ("pre", "textarea", "xmp")
            todo.append(("close", node))
            todo.extend(("open", kid) for kid in reversed(node.kids))
            continue
        pre -= tag in ("pre", "textarea", "xmp")
        if tag in ("td", "th") and tables and tables[-1]:
            lists.pop()
            tables[-1].cell(flows.pop().text().split("\n"), node.attrs)
        elif tag == "table":
            table = tables.pop()
            for line in aligned(table.rows) if table else ():
                flow.add(line or " ", keep=True)
                flow.line()
            flow.block(2)
        elif tag in LISTS:
            flow.block(1)
            flow.indent = lists.pop()[1]
            flow.mark = ""
            if not any(lists[-1:]):
                flow.block(2)
        elif tag in ("blockquote", "dd"):
            flow.block(1)
            flow.indent -= 2
            flow.block(2 if tag in SPACED else 1)
        elif tag == "li":
            flow.block(1)
            flow.mark = ""
        elif tag in BLOCK and tag != "tr":
            flow.block(2 if tag in SPACED else 1)
    return flows[0].text()


def extract(html: str | None) -> str:
    return render(build_tree(html)) if html else ""


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html column and with `text`, the rendered visible text.

    Null or empty html gives an empty text. Pages of any length are rendered whole. Equal rows get equal texts; an empty
    table gives an empty result. A column of ``pages`` that is called text already is replaced."""
    keep = [c for c in pages.columns if c.lower() not in (html.lower(), "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(html), F.lit("")).alias("text"))
    return map_text(source, run, source.schema)
