"""Operator 6, HTML extraction: a tree with implied tags, rendered with its layout.

One regular expression cuts a page into tags, comments and text. A tree builder
closes what HTML lets one leave open (p, li, dt, dd, tr, td, th, option, thead,
tbody, tfoot and whatever an ending parent contains), knows void elements, and takes the
content of raw-text elements as it stands. Cells without a row get one, forms in a table hold nothing, and what else lies in a table but in no cell or caption is
taken out of it and put before it, as browsers do. The renderer leaves out what a browser
doesn't show (head, script, style, template, noscript, titles and definitions of drawings, fallbacks of media, closed dialogs, all but the
summary of closed details, hidden inputs, the attribute hidden, display:none) and what is invisible (visibility:hidden or
collapse, until a descendant says visible). Styles are those of the attribute style and of rules in style elements whose
selector is made of a name, classes and an id; later rules win over earlier ones, the attribute over rules. All other text is emitted: blocks
begin new lines, paragraphs and headings have an empty line around them, list items
have a mark (start, value, reversed and type count) and indent, pre and textarea keep their lines, images give their alternative text, and the cells of a table's
columns are padded to align (by display width; colspan and rowspan count).

Parsing a page needs a stack machine, so it runs in Arrow batches, one call for a
batch; pages need no shuffle.

Defined cases. A null page gives null, an empty one "". Unclosed and unknown tags,
stray end tags, unfinished comments and tags, very long pages and nesting of any depth are accepted (the tree is
walked without recursion, inner tables before outer ones). Repeated rows give repeated results; page_id may be null or of any type. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in "script style textarea title xmp iframe noembed noframes".split()}
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist audio video canvas desc defs metadata symbol".split())
IN_TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav option optgroup search section select summary tr caption thead tbody tfoot".split())
# a start tag of the key ends open elements of the first set, looking no further out than the second
CELLS, ROWS = frozenset(("td", "th")), frozenset(("tr", "td", "th"))
ENDS = {
    "li": (frozenset(("li",)), frozenset("ul ol menu".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (ROWS, frozenset(("table",))),
    "tbody": (ROWS | {"thead", "tbody", "tfoot", "caption", "colgroup"}, frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
IN_P = BLOCK - {"html", "body", "option", "optgroup", "select", "tr", "caption", "thead", "tbody", "tfoot", "legend"}
IN_HEAD = frozenset("title base link meta style script template noscript".split())
SCOPE = frozenset("table td th caption button html".split())
SPACE = re.compile(r"[ \t\n\f\r]+")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][a-z0-9_-]+)*)\Z", re.I)


class Node:
    __slots__ = ("name", "attributes", "children", "shown", "visible", "lines")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []
        self.shown, self.visible, self.lines = True, True, []

    def get(self, wanted: str) -> str | None:
        if wanted not in self.attributes.lower():
            return None
        for n, a, b, c in ATTRIBUTE.findall(self.attributes):
            if n.lower() == wanted:
                return html.unescape(a or b or c)
        return None


def parse(page: str) -> Node:
    root = Node("#root")
    stack = [root]

    def close(names: frozenset, stop: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in stop:
                return
            if stack[i].name in names:
                del stack[i:]
                # an ended row may itself lie in one more element of the names
                return close(names, stop)

    def place(child) -> None:
        """Appends to the open element; in a table's structure, before the table in its parent."""
        if stack[-1].name not in IN_TABLE or (isinstance(child, str) and not child.strip()):
            return stack[-1].children.append(child)
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == "table":
                around = owner[id(stack[i])].children
                for k in range(len(around) - 1, -1, -1):
                    if around[k] is stack[i]:
                        return around.insert(k, child)
        stack[-1].children.append(child)

    def structure() -> None:
        """Before a part of a table: back to the table, section or row that it lies in, unless a cell or caption is open."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in IN_TABLE:
                del stack[i + 1 :]
                return
            if stack[i].name in ("td", "th", "caption"):
                return

    owner: dict[int, Node] = {}  # what holds each open table
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            if stack[-1].name == "head" and token.strip():
                del stack[-1]
            place(html.unescape(token) if "&" in token else token)
            continue
        if token[1] in "!?":
            continue
        name = NAME.match(token)[1].lower()
        if token[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in SCOPE and name not in SCOPE and name not in ("body", "tr", "tbody", "thead", "tfoot"):
                    break
            else:
                if name == "p":
                    stack[-1].children.append(Node("p"))
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            del stack[-1]
        if name in ENDS:
            close(*ENDS[name])
        if name in IN_P:
            close(frozenset(("p",)), SCOPE)
        if name == "a":
            close(frozenset(("a",)), SCOPE)
        node = Node(name, token[len(name) + 1 : -1])
        if name in TABLE_PARTS:
            structure()
            if name in CELLS and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
            stack[-1].children.append(node)
        elif stack[-1].name in IN_TABLE and name in ("script", "style", "template", "form"):
            stack[-1].children.append(node)
            if name == "form":
                continue
        else:
            if name == "table":
                for i in range(len(stack) - 1, 0, -1):  # a table in a table's structure ends it
                    if stack[i].name in ("td", "th", "caption"):
                        break
                    if stack[i].name == "table" and stack[-1].name in IN_TABLE:
                        del stack[i:]
                        break
            place(node)
            if name == "table":
                owner[id(node)] = stack[-1]
        if name in RAW:
            end = RAW[name].search(page, at)
            body = page[at : end.start() if end else size]
            at = end.end() if end else size
            if body:
                node.children.append(html.unescape(body) if name in ("title", "textarea") and "&" in body else body)
        elif name not in VOID and not (token.endswith("/>") and name in ("svg", "math", "path")):
            stack.append(node)
    return root


def rules(root: Node) -> list[tuple[str, frozenset, str, dict[str, str]]]:
    """(name, classes, id, styles) of the page's simple rules that hide or show."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name == "style":
            text = re.sub(r"/\*.*?\*/", "", "".join(c for c in node.children if isinstance(c, str)), flags=re.S)
            text = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})", "", text)  # rules for some media only don't count
            for selectors, body in RULE.findall(text):
                if styles := {k.lower(): v.lower() for k, v in STYLE.findall(body)}:
                    for one in selectors.split(","):
                        if (m := SELECTOR.match(one.strip())) and one.strip():
                            parts = re.findall(r"[.#][^.#]+", m[2])
                            out.append(((m[1] or "").lower().strip("*"), frozenset(x[1:] for x in parts if x[0] == "."), next((x[1:] for x in parts if x[0] == "#"), ""), styles))
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def annotate(root: Node) -> list[Node]:
    """Sets which nodes are shown and visible; gives the tables that are shown, outer ones first."""
    sheet, tables, todo = rules(root), [], [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, str):
                continue
            a = child.attributes
            styles: dict[str, str] = {}
            if sheet:
                classes, own = (frozenset((child.get("class") or "").split()), child.get("id") or "") if a else (frozenset(), "")
                for name, wanted, number, s in sheet:
                    if (not name or name == child.name) and wanted <= classes and (not number or number == own):
                        styles.update(s)
            gone = False
            if a:
                low = a.lower()
                if "hidden" in low and child.get("hidden") is not None and "display" not in styles:
                    gone = True
                if child.name == "input" and (child.get("type") or "").lower() == "hidden":
                    gone = True
                if "style" in low:
                    styles.update({k.lower(): v.lower() for k, v in STYLE.findall(child.get("style") or "")})
            if child.name == "dialog" and child.get("open") is None:
                gone = True
            child.shown = not (gone or child.name in UNSEEN or styles.get("display") == "none")
            v = styles.get("visibility", "inherit")
            child.visible = node.visible if v not in ("hidden", "collapse", "visible", "initial") else v in ("visible", "initial")
        if node.name == "details" and node.get("open") is None:
            first = next((c for c in node.children if not isinstance(c, str) and c.name == "summary"), None)
            node.children = [first] if first is not None else []
        if node.name == "table":
            tables.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and c.shown]
    return tables


def width(s: str) -> int:
    """Columns that a text takes on a display."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def count(node: Node, name: str, default: int) -> int:
    v = (node.get(name) or "").strip()
    return int(v) if v.lstrip("-").isascii() and v.lstrip("-").isdigit() and len(v) < 10 else default


def marked(number: int, kind: str) -> str:
    """The mark of a list item by the list's type."""
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, k = divmod(number - 1, 26)
            out = chr(ord(kind) + k) + out
        return out + ". "
    if kind in ("i", "I") and 0 < number < 4000:
        out = ""
        for v, r in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out += r * (number // v)
            number %= v
        return (out if kind == "i" else out.upper()) + ". "
    return f"{number}. "


class Writer:
    """Lines of text; ``gap`` is how many line ends are due before the next text."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space, self.indent, self.mark = [], "", 0, False, 0, ""

    def want(self, gap: int) -> None:
        self.space = False
        if self.line or self.lines:
            self.gap = max(self.gap, gap)

    def flush(self) -> None:
        if self.gap:
            if self.line:
                self.lines.append(self.line.rstrip())
                self.line = ""
            self.lines += [""] * (self.gap - 1)
            self.gap = 0

    def lead(self) -> None:
        self.flush()
        if not self.line:
            self.line = " " * (max(self.indent - len(self.mark), 0)) + self.mark
            self.mark, self.space = "", False

    def text(self, s: str) -> None:
        body = SPACE.sub(" ", s)
        if body == " " or not body:
            self.space = self.space or bool(body and self.line and not self.gap)
            return
        if body[0] == " ":
            self.space = self.space or bool(self.line and not self.gap)
            body = body[1:]
        begun = bool(self.line) and not self.gap
        self.lead()
        if self.space and begun:
            self.line += " "
        self.space = body[-1] == " "
        self.line += body[:-1] if self.space else body

    def verbatim(self, s: str) -> None:
        rows = s.replace("\r\n", "\n").split("\n")
        self.lead()
        self.line += rows[0]
        for r in rows[1:]:
            self.lines.append(self.line.rstrip())
            self.line = " " * self.indent + r
        self.space = False

    def end(self) -> str:
        if self.line:
            self.lines.append(self.line.rstrip())
        return "\n".join(self.lines).strip("\n")


def rows_of(table: Node) -> list[list[Node]]:
    """Rows of cells of a table, but not of tables within it."""
    out, todo = [], [iter(table.children)]
    while todo:
        for child in todo[-1]:
            if isinstance(child, str) or not child.shown:
                continue
            if child.name == "tr":
                out.append([c for c in child.children if not isinstance(c, str) and c.name in CELLS and c.shown])
            elif child.name in ("thead", "tbody", "tfoot"):
                todo.append(iter(child.children))
                break
        else:
            todo.pop()
    return out


def table_text(table: Node) -> list[str]:
    grid: list[list[tuple[int, list[str], int]]] = []
    taken: dict[int, int] = {}  # columns that a cell from above takes, and for how many more rows
    for row in rows_of(table):
        cells, at, new = [], 0, {}
        for c in row:
            while taken.get(at, 0):
                at += 1
            across, down = min(max(1, count(c, "colspan", 1)), 1000), count(c, "rowspan", 1)
            cells.append((at, render(c).split("\n"), across))
            if down != 1:
                new.update({k: (down if down > 0 else 1 << 30) for k in range(at, at + across)})
            at += across
        taken = {k: n - 1 for k, n in {**taken, **new}.items() if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for row in grid:
        for at, lines, across in row:
            if across == 1:
                widths[at] = max(widths.get(at, 0), max(map(width, lines)))
    columns = sorted({k for row in grid for at, _, across in row for k in range(at, at + across) if across == 1 or k in widths})
    start, x = {}, 0
    for k in columns:
        start[k] = x
        x += widths.get(k, 0) + 2
    place = lambda at: start.get(at, min((start[k] for k in columns if k >= at), default=x))
    out = []
    for row in grid:
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            line = ""
            for at, lines, _ in row:
                part = lines[i] if i < len(lines) else ""
                if part:
                    line += " " * max(place(at) - width(line), 2 if line else 0) + part
            out.append(line.rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of an annotated node whose inner tables have their lines."""
    w = Writer()
    todo: list = [(root, iter(root.children), None)]
    lists: list = []
    pre = 0
    while todo:
        node, children, after = todo[-1]
        for child in children:
            if isinstance(child, str):
                if not node.visible:
                    continue
                if pre:
                    w.verbatim(child)
                else:
                    w.text(child)
                continue
            if not child.shown:
                continue
            name = child.name
            if name == "br":
                w.lead()
                w.lines.append(w.line.rstrip())
                w.line, w.space = "", False
                continue
            if name == "hr":
                w.want(2)
                continue
            if name == "wbr":
                continue
            if name == "img":
                if child.visible and (alt := child.get("alt")):
                    w.text(alt)
                continue
            if name == "input":
                if child.visible and (value := child.get("value")):
                    w.text(f" {value} ")
                continue
            if name == "table":
                w.want(2)
                if any(child.lines):
                    w.verbatim("\n".join(child.lines))
                w.want(2)
                continue
            done = None
            if name in ("ul", "ol", "menu"):
                w.want(1 if lists else 2)
                back = name == "ol" and child.get("reversed") is not None
                items = sum(1 for c in child.children if not isinstance(c, str) and c.name == "li" and c.shown) if back else 1
                lists.append([name, count(child, "start", items) if name == "ol" else 1, -1 if back else 1, child.get("type") or ""])
                w.indent += 2
                done = ("list", 1 if len(lists) > 1 else 2)
            elif name == "li":
                w.want(1)
                if lists and lists[-1][0] == "ol":
                    number = count(child, "value", lists[-1][1])
                    w.mark = marked(number, lists[-1][3])
                    lists[-1][1] = number + lists[-1][2]
                else:
                    w.mark = "- "
                if not child.visible:
                    w.mark = ""
                done = ("item", 1)
            elif name in ("pre", "textarea", "xmp"):
                w.want(2 if name == "pre" else 1)
                pre += 1
                done = ("pre", 2 if name == "pre" else 1)
            elif name in ("dd", "blockquote"):
                w.want(2 if name == "blockquote" else 1)
                w.indent += 2
                done = ("indent", 2 if name == "blockquote" else 1)
            elif name in BLOCK:
                w.want(2 if name in SPACED else 1)
                done = ("block", 2 if name in SPACED else 1)
            elif name in ("td", "th", "text"):
                w.text(" ")
            todo.append((child, iter(child.children), done))
            break
        else:
            todo.pop()
            if after:
                kind, gap = after
                if kind == "list":
                    lists.pop()
                    w.indent -= 2
                elif kind == "pre":
                    pre -= 1
                elif kind == "indent":
                    w.indent -= 2
                elif kind == "item":
                    w.mark = ""
                w.want(gap)
    return w.end()


def text_of(root: Node) -> str:
    """The text of a page: inner tables are laid out before those that hold them."""
    for table in reversed(annotate(root)):
        captions = [render(c) for c in table.children if not isinstance(c, str) and c.name == "caption" and c.shown]
        table.lines = [line for c in captions if c for line in c.split("\n")] + table_text(table)
    return render(root)


def extract(page: str | None) -> str | None:
    return None if page is None else text_of(parse(page))


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of ``pages`` (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([extract(x) for x in part.column("html").to_pylist()], pa.string())], ["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("html")).mapInArrow(run, f"page_id {kind}, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(read(spark, sf_dir, "pages"))
