"""HTML to text by layout: a tree with implied tags, visibility rules, and a renderer.

The markup becomes a tree: void elements close themselves, paragraphs, list items,
table parts and the like are closed by what cannot stand inside them. What is not
shown is left out. The renderer then writes blocks on lines of their own with the
spacing of their margins, list items with bullets or numbers, preformatted text as
it stands, and tables with cells aligned in columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset(
    "head script style template title noscript iframe object embed canvas svg audio video datalist "
    "param source track area map noframes noembed".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote center details summary dd dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p "
    "pre search section table caption ul tr thead tbody tfoot optgroup option xmp listing".split()
)
#: Blocks with a margin above and below, that is, a blank line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu dir xmp listing".split())
#: Opening one of these closes an open one of those, up to the nearest barrier.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
ENDS_PARAGRAPH = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "legend"}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A declaration of a style: what stands in quotes or brackets is part of its value.
DECLARATION = re.compile(r"(?:^|;)\s*([\w-]+)\s*:((?:[^;\"'()]|\"[^\"]*\"|'[^']*'|\((?:[^()\"']|\"[^\"]*\"|'[^']*')*\))*)")
#: Fixed values of the HTML standard: kinds of inputs that show no text of theirs.
TEXTLESS = frozenset("hidden password checkbox radio color range file".split())
BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.children = name, attrs, []


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTR.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


class Tree:
    """Builds the tree; ``open`` is the stack of open elements."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]

    def close(self, names: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``names`` inside the nearest barrier."""
        cut = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in barriers:
                break
            if self.open[i].name in names:
                cut = i
        if cut is not None:
            del self.open[cut:]

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body") and any(n.name == name for n in self.open):
            return
        if name not in HEAD_ONLY and name != "head" and self.open[-1].name == "head":
            self.open.pop()
        if name in ENDS_PARAGRAPH:
            self.close({"p"}, SCOPE | {"button"})
        if name in CLOSES:
            self.close(*CLOSES[name])
        if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.open[-1].name):
            self.open.pop()
        if name in ("td", "th") and self.open[-1].name in ("table", "thead", "tbody", "tfoot"):
            self.start("tr", {})
        node = Node(name, attrs)
        self.open[-1].children.append(node)
        if name not in VOID:
            self.open.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
            return
        if name == "p" and not any(n.name == "p" for n in self.open):
            self.start("p", {})
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == name:
                del self.open[i:]
                return
            if self.open[i].name in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                return

    def text(self, text: str) -> None:
        if self.open[-1].name == "head" and text.strip():
            self.open.pop()
        self.open[-1].children.append(text)


def parse(html: str) -> Node:
    tree, at = Tree(), 0
    last = html.rfind(">") + 1  # no tag ends beyond
    while True:
        m = TOKEN.search(html, at, last) or (TOKEN.search(html, at) if "<!--" in html[last:] else None)
        if not m:
            tree.text(unescape(html[at:]))
            return tree.root
        if m.start() > at:
            tree.text(unescape(html[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            tree.text(m["cdata"])
        elif m["name"] is not None:
            name = m["name"].lower()
            if m["end"]:
                tree.end(name)
                continue
            tree.start(name, attributes(m["attrs"]) if m["attrs"] else {})
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                inside = html[at : stop.start()] if stop else html[at:]
                tree.open[-1].children.append(unescape(inside) if name in ("title", "textarea") else inside)
                tree.open.pop()
                at = stop.end() if stop else len(html)


def declared(node: Node, name: str) -> str:
    """The value that the element's own style gives a property, in lower case: the last one, or the last
    important one."""
    value, important = "", False
    for m in DECLARATION.finditer(node.attrs.get("style", "")):
        if m[1].lower() == name:
            given, mark, _ = m[2].strip().lower().partition("!")
            if mark or not important:
                value, important = given.strip(), bool(mark)
    return value


def shown(node: Node) -> bool:
    if node.name in HIDDEN:
        return False
    a = node.attrs
    if node.name == "dialog" and "open" not in a:
        return False
    if not a:
        return True
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return False
    return "style" not in a or declared(node, "display") != "none"


def settle(root: Node) -> None:
    """Take out what elements do not show while they stay: text that visibility hides, which
    an element inside may turn on again, and all but the summary of closed details."""
    todo = [(root, True)]
    while todo:
        node, visible = todo.pop()
        if "style" in node.attrs and (given := declared(node, "visibility")):
            visible = given not in ("hidden", "collapse") if given != "inherit" else visible
        if not visible:
            if node.name in ("img", "input", "select", "textarea"):
                node.attrs = {**node.attrs, "hidden": ""}
            node.children = [c for c in node.children if isinstance(c, Node)]
        if node.name == "details" and "open" not in node.attrs:
            node.children = [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
        todo += [(c, visible) for c in node.children if isinstance(c, Node)]


def label_of(field: Node) -> str:
    """What an image or an input shows in place of contents."""
    if field.name == "img":
        return field.attrs.get("alt", "")
    kind = field.attrs.get("type", "").strip().lower()
    if kind in TEXTLESS:
        return ""
    return field.attrs.get("alt" if kind == "image" else "value", "")


def width_of(text: str) -> int:
    """Columns that a text takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


class Page:
    """Lines written so far, the line being written, and the spacing owed."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.blank = False

    def inline(self, text: str) -> None:
        """Text with white space collapsed, also across elements."""
        parts = BLANK.split(text)
        for i, part in enumerate(parts):
            if i:
                self.blank = bool(self.line)
            if part:
                if self.blank and self.line:
                    self.line.append(" ")
                self.line.append(part)
                self.blank = False

    def flush(self) -> None:
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.blank = False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append(line)

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = max(self.gap, int(spaced))


PARTS = frozenset("tr td th thead tbody tfoot".split())


def holds_parts(node: Node) -> bool:
    """Whether rows or cells of the table around ``node`` hang below it, as below a form."""
    todo = [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node) and shown(child):
                if child.name in PARTS:
                    return True
                if child.name != "table":
                    todo.append(child)
    return False


def parts_of(table: Node) -> tuple[list[tuple[int, list[Node]]], list[Node | str]]:
    """Rows, as their section and cells, and what stands between rows and cells."""
    rows: list[tuple[int, list[Node]]] = []
    loose: list[Node | str] = []
    sections = 0

    def walk(node: Node, section: int, row: list[Node] | None) -> None:
        nonlocal sections
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    loose.append(child)
            elif not shown(child) or child.name in ("colgroup", "col"):
                continue
            elif child.name in ("td", "th"):
                if row is None:
                    row = []
                    rows.append((section, row))
                row.append(child)
            elif child.name == "tr":
                cells: list[Node] = []
                rows.append((section, cells))
                walk(child, section, cells)
            elif child.name in ("thead", "tbody", "tfoot"):
                sections += 1
                walk(child, sections, None)
            elif child.name not in ("table", "caption") and holds_parts(child):
                walk(child, section, row)
            else:
                loose.append(child)

    walk(table, 0, None)
    return rows, loose


def span_of(cell: Node, name: str = "colspan", most: int = 1000) -> int:
    text = cell.attrs.get(name, "1").strip()
    return min(int(text[:9]), most) if text.isascii() and text.isdigit() else 1


def lay_table(table: Node, page: Page) -> None:
    """Caption, loose contents, then rows with cells padded to their columns."""
    grid: list[list[tuple[int, list[str]]]] = []
    rows, loose = parts_of(table)
    for child in loose:
        render(child, page)
    #: Rows that cells from above still take, by column; they end with their section.
    taken: dict[int, int] = {}
    last = None
    for section, row in rows:
        if section != last:
            taken, last = {}, section
        taken = {column: n - 1 for column, n in taken.items() if n > 1}
        cells, at, below = [], 0, {}
        for cell in row:
            while at in taken:
                at += 1
            cells.append((at, lines_of(cell)))
            # A rowspan of 0 goes on to the end of the section.
            deep = span_of(cell, "rowspan", 65534) or 65535
            wide = max(span_of(cell), 1)
            if deep > 1:
                below.update(dict.fromkeys(range(at, at + wide), deep))
            at += wide
        taken |= below
        grid.append(cells)
    page.flush()
    widths: dict[int, int] = {}
    for cells in grid:
        # The last cell of a row needs no padding, so it widens no column.
        for at, lines in cells[:-1]:
            widths[at] = max(widths.get(at, 0), *map(width_of, lines), 0)
    starts: dict[int, int] = {}
    left = 0
    for at in sorted({at for cells in grid for at, _ in cells}):
        starts[at] = left
        left += widths.get(at, 0) + 2
    for cells in grid:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            out, used = "", 0
            for at, lines in cells:
                if k < len(lines) and lines[k]:
                    pad = max(starts[at] - used, 2 if out else 0)
                    out += " " * pad + lines[k]
                    used += pad + width_of(lines[k])
            page.put(out)


def lines_of(node: Node) -> list[str]:
    """The contents of ``node`` laid out on a page of their own."""
    inner = Page()
    for child in node.children:
        render(child, inner)
    inner.flush()
    return inner.lines


def list_items(node: Node, page: Page) -> None:
    numbered = node.name == "ol"
    start = node.attrs.get("start", "1").strip()
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, Node) and child.name == "li":
            if not shown(child):
                continue
            value = child.attrs.get("value", "").strip()
            if re.fullmatch(r"-?[0-9]{1,9}", value):
                number = int(value)
            mark = f"{number}. " if numbered else "- "
            number += 1
            page.flush()
            indented(lines_of(child), mark, page)
        else:
            render(child, page)


def indented(lines: list[str], mark: str, page: Page) -> None:
    for i, line in enumerate(lines):
        lead = mark if i == 0 else " " * len(mark)
        page.put(lead + line if line else "")


def render(node: Node | str, page: Page) -> None:
    if isinstance(node, str):
        page.inline(node)
        return
    if not shown(node):
        return
    name = node.name
    if name == "br":
        if page.line:
            page.flush()
        else:
            page.put("")
        return
    if name in ("img", "input"):
        page.inline(label_of(node))
        return
    if name == "select":
        page.inline(chosen(node))
        return
    if name == "textarea":
        first, *more = flat(node).removeprefix("\n").removesuffix("\n").split("\n")
        page.inline(first)
        for line in more:
            page.flush()
            page.inline(line)
        return
    if name not in BLOCK:
        if name in ("td", "th"):
            page.inline(" ")
        for child in node.children:
            render(child, page)
        return
    spaced = name in SPACED
    page.block(spaced)
    if name in ("ul", "ol", "menu", "dir"):
        list_items(node, page)
    elif name == "table":
        lay_table(node, page)
    elif name in ("pre", "xmp", "listing"):
        text = flat(node)
        for line in text.removeprefix("\n").removesuffix("\n").split("\n"):
            page.put(line.rstrip())
    elif name in ("blockquote", "dd"):
        indented(lines_of(node), "  ", page)
    elif name == "li":
        indented(lines_of(node), "- ", page)
    elif name != "hr":
        for child in node.children:
            render(child, page)
    page.block(spaced)


def chosen(select: Node) -> str:
    """What a closed list shows: its options marked as selected, of which the last counts
    unless several may be; without any the first option."""
    options, every, todo = [], [], [select]
    while todo:
        at = todo.pop()
        if at.name == "option":
            every.append(at)
            if "selected" in at.attrs:
                options.append(at)
            continue
        todo += [c for c in reversed(at.children) if isinstance(c, Node) and shown(c)]
    if not options and "multiple" not in select.attrs:
        options = every[:1]
    texts = []
    for option in options if "multiple" in select.attrs else options[-1:]:
        out: list[str] = []
        inner: list[Node | str] = [option]
        while inner:
            part = inner.pop()
            if isinstance(part, str):
                out.append(part)
            elif shown(part):
                inner += reversed(part.children)
        texts.append("".join(out))
    return " ".join(texts)


def flat(node: Node) -> str:
    """Text of a preformatted element as it stands."""
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif child.name == "select" and shown(child):
            out.append(chosen(child))
        elif shown(child):
            out.append("\n" if child.name == "br" else flat(child))
    return "".join(out)


def title_of(node: Node) -> str | None:
    todo = [node]
    while todo:
        at = todo.pop()
        if at.name == "title":
            return BLANK.sub(" ", "".join(c for c in at.children if isinstance(c, str))).strip()
        todo.extend(c for c in reversed(at.children) if isinstance(c, Node) and c.name in ("html", "head", "title"))
    return None


#: Deeper elements are treated as if they stood at this depth, so that markup of any
#: nesting renders.
DEPTH = 200


def flatten(root: Node) -> None:
    """Lift what is nested deeper than ``DEPTH`` without recursion; its text stays."""
    level = [root]
    for _ in range(DEPTH):
        level = [c for n in level for c in n.children if isinstance(c, Node)]
        if not level:
            return
    for node in level:
        if node.name == "select":
            continue
        out, todo = [], list(reversed(node.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                out.append(child)
            elif child.name in ("br", "img", "input", "select", "textarea"):
                out.append(child)
            elif shown(child):
                around = "\n" if child.name in BLOCK else ""
                todo += [around, *reversed(child.children), around]
        node.children = out


def extract(html: str | None) -> tuple[str | None, str]:
    """Title and visible text of a page."""
    if not html:
        return None, ""
    root = parse(html.replace("\r\n", "\n").replace("\r", "\n"))
    settle(root)
    flatten(root)
    page = Page()
    for child in root.children:
        render(child, page)
    page.flush()
    lines = [line.rstrip() for line in page.lines]
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return title_of(root), "\n".join(lines)


def visible_text(pages: DataFrame, html_col: str = "html", to: str = "page") -> DataFrame:
    """Add ``to``: struct of ``title`` (NULL without one) and ``text``.

    NULL and empty pages give an empty text. Text of any length and markup of any
    nesting or brokenness renders; beyond 200 levels only text and line breaks are
    kept. All other columns stay; rows are independent of each other.
    """
    kind = pa.struct([("title", pa.string()), ("text", pa.string())])

    @F.arrow_udf("struct<title: string, text: string>")
    def lay_out(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [extract(html) for html in batch.to_pylist()]
            yield pa.array([{"title": t, "text": x} for t, x in rows], type=kind)

    return pages.withColumn(to, lay_out(html_col))
