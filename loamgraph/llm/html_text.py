"""HTML to text by layout-aware rendering.

A tokenizer feeds a tree builder that supplies implied tags (ends of p, li, dt, dd, option, cells, rows and row groups; table parts that are left
out), drops end tags that fit nothing, and treats void and raw-text elements as such. Visibility rules then hide what a browser hides: the
head, scripts, styles, templates, comments, replaced content, ``hidden``, closed ``details`` and ``dialog``, and
``display: none`` or ``visibility: hidden`` from style attributes and from simple selectors (tag, .class, #id) of style elements, in media queries only if they
are for screens; the last declaration wins. All other text is rendered: white space collapses outside ``pre``, blocks begin new lines, paragraphs, headings,
lists and tables are set off by blank lines, list items are marked and indented, table cells are aligned in columns, cells that span rows or columns too.

Columns are as wide as their widest cell. Only where that would make a table's text more than ``GROWTH`` times its own, padding included, are cells of more than
``WRAP`` characters broken into lines of that width, between words where there are any; the columns stay aligned. Neither open elements nor tables in tables are
limited, and nothing recurses.

Defined results: null or empty html gives empty text; text without any tag is rendered as it is, white space collapsed; unclosed comments and raw text
run to the end; rows that repeat an id are rendered each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.words import slices

#: A table's padded text may be this many times its own (and 4,000 characters); beyond, long cells are wrapped.
GROWTH, WRAP = 8, 60
#: Cells that begin beyond this many columns are taken to span one.
MAX_COLUMNS = 10_000

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre search section table ul".split()
)
HIDDEN = frozenset("head script style template iframe noembed noframes object audio video canvas datalist title desc defs metadata meta link base param source track area".split())
LISTS = frozenset("ul ol menu dir".split())
ROW_GROUPS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>]|["'])*?)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPACES = re.compile(r"[ \t\n\r\f]+")
CSS_TOKEN = re.compile(r"[{};]|[^{};]+")
NO_SCREEN = re.compile(r"\s*(?:only\s+)?(?:print|speech|aural|braille|embossed|tty|projection|handheld)\b|\s*not\s+(?:screen|all)\b", re.I)
DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)")
NOT_VISIBLE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")
RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for name, a, b, c in ATTRIBUTE.findall(text):
            out.setdefault(name.lower(), unescape(a or b or c))
    return out


#: Elements that a start tag closes, and those that keep it from doing so.
P, LI, TR, TABLE, CAPTION, HEAD, BODY, OPTION, OPTGROUP, SELECT, NONE = (
    frozenset(x.split()) for x in ("p", "li", "tr", "table", "caption", "head", "body", "option", "optgroup", "select", "")
)
TERMS, ROW_BARRIER = frozenset(("dt", "dd")), TR | TABLE
TABLE_AND_CELLS = frozenset(CELLS) | TABLE
P_BARRIER = TABLE_AND_CELLS | {"caption", "button", "template", "object"}
LI_BARRIER = TABLE_AND_CELLS | set(LISTS)
TERMS_BARRIER = TABLE_AND_CELLS | {"dl"}
OPTION_BARRIER = SELECT | OPTGROUP | {"datalist"}
TABLE_PARTS = frozenset(ROW_GROUPS) | {"caption", "colgroup"}


class TreeBuilder:
    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.css: list[str] = []

    def last(self, tags: frozenset) -> int:
        """Place of the nearest open element of ``tags``, 0 if none is open."""
        return max((at[-1] for at in map(self.places.get, tags) if at), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, size: int) -> None:
        """Close what is open beyond ``size`` elements."""
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()

    def close_to(self, tags: frozenset, barrier: frozenset) -> None:
        """Close the nearest open element of ``tags`` unless one of ``barrier`` is nearer."""
        at = self.last(tags)
        if at and at >= self.last(barrier):
            self.cut(at)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        if tag in ENDS_P:
            self.close_to(P, P_BARRIER)
        if tag == "li":
            self.close_to(LI, LI_BARRIER)
        elif tag in ("dt", "dd"):
            self.close_to(TERMS, TERMS_BARRIER)
        elif tag == "option":
            self.close_to(OPTION, OPTION_BARRIER)
        elif tag == "optgroup":
            self.close_to(OPTGROUP, SELECT)
        elif tag in CELLS:
            self.close_to(CELLS, ROW_BARRIER)
            if self.last(TABLE) > self.last(TR):
                self.start("tr", {})
        elif tag == "tr":
            self.close_to(TR, TABLE)
            self.close_to(CAPTION, TABLE)
        elif tag in ROW_GROUPS or tag in ("caption", "colgroup"):
            self.close_to(TABLE_PARTS, TABLE)
        elif tag == "body" or (tag in BLOCK and tag != "html" and self.open[-1].tag == "head"):
            self.close_to(HEAD, BODY)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "p" and self.last(P) <= self.last(TABLE_AND_CELLS):
            self.open[-1].children.append(Node("p"))
        elif tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag not in ("html", "body"):
            self.close_to(frozenset((tag,)), TABLE_AND_CELLS if tag not in ("table", "tr") and tag not in CELLS and tag not in ROW_GROUPS else NONE)

    def feed(self, html: str) -> Node:
        at, size = 0, len(html)
        while at < size:
            m = TOKEN.match(html, at)
            at = m.end()
            name = m[2]
            if name:
                tag = name.lower()
                if m[1]:
                    self.end(tag)
                    continue
                attrs = m[3]
                self.start(tag, attributes(attrs))
                if tag in RAW:
                    stop = None if tag == "plaintext" else RAW_END[tag].search(html, at)
                    to = stop.start() if stop else size
                    text = html[at:to]
                    if tag == "style":
                        self.css.append(text)
                    elif tag == "textarea":
                        self.open[-1].children.append(unescape(text.removeprefix("\n")))
                    elif tag in ("plaintext", "xmp"):
                        self.open[-1].children.append(text)
                    self.cut(len(self.open) - 1)
                    if stop:
                        close = html.find(">", to)
                        at = size if close < 0 else close + 1
                    else:
                        at = size
            else:
                c = html[m.start()]
                if c != "<":
                    text = m[0]
                    self.open[-1].children.append(unescape(text) if "&" in text else text)
                elif m.end() - m.start() == 1:
                    self.open[-1].children.append("<")
        return self.root


def css_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen. At-rules nest; what a media query for other devices holds is left out."""
    open_: list[tuple[bool, str]] = []  # (holds here, selectors; empty in a group of rules)
    head, body = [], []
    for token in CSS_TOKEN.findall(re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)):
        inside = bool(open_ and open_[-1][1])
        if token == "{":
            name = "".join(head).strip()
            holds = not open_ or open_[-1][0]
            if name.startswith("@"):
                word, _, rest = name[1:].partition(" ")
                group = word.lower() in ("media", "supports", "layer", "container", "scope")
                holds &= group and not (word.lower() == "media" and all(NO_SCREEN.match(q) for q in rest.split(",")))
                name = "" if group else "@"
            open_.append((holds, name))
            head, body = [], []
        elif token == "}":
            if open_:
                holds, name = open_.pop()
                if holds and name not in ("", "@"):
                    yield name, "".join(body)
            head, body = [], []
        elif inside:
            body.append(token)
        elif token == ";":
            head = []
        else:
            head.append(token)
    if open_ and open_[-1][0] and open_[-1][1] not in ("", "@"):
        yield open_[-1][1], "".join(body)


class Styles:
    """Simple selectors of style elements that hide or show."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, str] = {}
        for sheet in sheets:
            if "display" not in sheet and "visibility" not in sheet:
                continue
            for selectors, body in css_rules(sheet):
                body = body.lower()
                if DISPLAY.search(body) or NOT_VISIBLE.search(body):
                    for s in selectors.split(","):
                        s = s.strip()
                        if re.fullmatch(r"[.#]?[\w-]+", s):
                            self.rules[s if s[0] in ".#" else s.lower()] = self.rules.get(s if s[0] in ".#" else s.lower(), "") + ";" + body

    def of(self, node: Node) -> str:
        out = node.attrs.get("style", "").lower() if node.attrs else ""
        if self.rules:
            keys = [node.tag, *("." + c for c in node.attrs.get("class", "").split()), "#" + node.attrs.get("id", "")]
            out = ";".join([self.rules[k] for k in keys if k in self.rules] + [out])
        return out


class Page:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.indent = 0
        self.marker = ""
        self.space = False  # white space owed before the next word

    def text(self, s: str) -> None:
        lead = s[0] in " \t\n\r\f"
        words = SPACES.sub(" ", s).strip(" ")
        if not words:
            self.space = self.space or bool(self.now)
            return
        if self.now and (self.space or lead):
            self.now.append(" ")
        self.now.append(words)
        self.space = s[-1] in " \t\n\r\f"

    def literal(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        self.now.append(first)
        for line in rest:
            self.line(keep=True)
            self.now.append(line)

    def line(self, keep: bool = False) -> None:
        """End the line; an empty one counts only if ``keep``."""
        text = "".join(self.now)
        self.now, self.space = [], False
        if not text and not keep:
            return
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        if self.marker:
            text = " " * max(0, self.indent - len(self.marker)) + self.marker + text
            self.marker = ""
        elif text:
            text = " " * self.indent + text
        self.lines.append(text.rstrip())

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def result(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def shown(node: Node, styles: Styles, visible: bool) -> tuple[bool, bool]:
    """(rendered at all, visible)."""
    if node.tag in HIDDEN or (node.attrs and ("hidden" in node.attrs or (node.tag == "input"))):
        return False, False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False, False
    if node.attrs or styles.rules:
        style = styles.of(node)
        if style:
            if (DISPLAY.findall(style) or [""])[-1] == "none":
                return False, False
            for m in NOT_VISIBLE.finditer(style):
                visible = m[1] == "visible"
    return True, visible


def render(root: Node, styles: Styles, visible: bool = True) -> str:
    """Text of a tree. Cells and captions are rendered by themselves: what asks for one waits on a stack of its own."""
    waiting, answer = [rendering(root, styles, visible)], None
    while waiting:
        try:
            asked = waiting[-1].send(answer)
            waiting.append(rendering(asked[0], styles, asked[1]))
            answer = None
        except StopIteration as done:
            waiting.pop()
            answer = done.value
    return answer


def rendering(root: Node, styles: Styles, visible: bool) -> Generator[tuple[Node, bool], str, str]:
    page = Page()
    lists: list[list] = []  # [ordered, next number]
    stack: list[tuple] = [("node", root, visible, False)]
    while stack:
        step = stack.pop()
        if step[0] == "do":
            step[1]()
            continue
        _, node, visible, pre = step
        if isinstance(node, str):
            if visible and node:
                page.literal(node) if pre else page.text(node)
            continue
        tag = node.tag
        ok, visible = shown(node, styles, visible)
        if not ok:
            continue
        if tag == "br":
            page.line(keep=True)
            continue
        if tag == "wbr":
            continue
        if tag == "table":
            page.block(1)
            for line in (yield from table_lines(node, styles, visible)):
                page.now.append(line)
                page.line(keep=True)
            page.block(1)
            continue
        block = tag in BLOCK or tag in CELLS or tag in ROW_GROUPS or tag in ("tr", "caption")
        gap = 1 if tag in SPACED else 0
        if tag in LISTS and lists:
            gap = 0
        if block:
            page.block(gap)
        after = []
        if tag in LISTS:
            start = node.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            after.append(lists.pop)
        elif tag == "li":
            inside = lists[-1] if lists else [False, 1]
            mark = f"{inside[1]}. " if inside[0] else "- "
            inside[1] += 1
            width = len(mark)
            page.indent += width
            page.marker = mark

            def leave(width=width):
                page.line()
                page.indent -= width
                page.marker = ""

            after.append(leave)
        elif tag in ("dd", "blockquote"):
            page.indent += 4

            def leave():
                page.line()
                page.indent -= 4

            after.append(leave)
        elif tag == "hr":
            continue
        elif tag == "q":
            page.now.append('"') if not page.space or not page.now else page.now.extend([" ", '"'])
            page.space = False
            after.append(lambda: page.now.append('"'))
        elif tag == "details" and "open" not in node.attrs:
            node = Node(tag)
            node.children = [c for c in step[1].children if not isinstance(c, str) and c.tag == "summary"][:1]
        pre = pre or tag in ("pre", "textarea", "xmp", "plaintext", "listing")
        if block:
            after.append(lambda gap=gap: page.block(gap))
        for act in reversed(after):
            stack.append(("do", act))
        if tag == "pre" and node.children and isinstance(node.children[0], str):
            node.children[0] = node.children[0].removeprefix("\n")
        stack.extend(("node", c, visible, pre) for c in reversed(node.children))
    return page.result()


@dataclass
class Cell:
    lines: list[str]
    across: int = 1
    down: int = 1  # 0: to the end of the row group
    column: int = 0


def span_of(cell: Node, name: str, most: int, least: int) -> int:
    text = cell.attrs.get(name, "1").strip()
    return min(max(least, int(text)), most) if re.fullmatch(r"\d{1,9}", text) else 1


def table_lines(table: Node, styles: Styles, visible: bool) -> Generator[tuple[Node, bool], str, list[str]]:
    captions: list[str] = []
    groups: list[list[list[Cell]]] = [[]]  # rows by row group: cells don't span beyond theirs
    stray: list[str] = []
    todo: list[tuple] = [(c, visible) for c in reversed(table.children)]
    while todo:
        node, seen = todo.pop()
        if node is None:
            groups.append([])
            continue
        if isinstance(node, str):
            if seen and node.strip():
                stray.append(SPACES.sub(" ", node).strip())
            continue
        ok, seen = shown(node, styles, seen)
        if not ok:
            continue
        if node.tag in ROW_GROUPS or node.tag in ("form", "colgroup"):
            edge = [(None, False)] if node.tag in ROW_GROUPS else []
            todo += [*edge, *((c, seen) for c in reversed(node.children)), *edge]
        elif node.tag == "tr":
            row = []
            for cell in node.children:
                if isinstance(cell, str):
                    if seen and cell.strip():
                        row.append(Cell([SPACES.sub(" ", cell).strip()]))
                    continue
                text = yield wrap(cell), seen
                if cell.tag in CELLS and shown(cell, styles, seen)[0]:
                    row.append(Cell(text.split("\n"), span_of(cell, "colspan", 1000, 1), span_of(cell, "rowspan", 65534, 0)))
                elif text:
                    row.append(Cell(text.split("\n")))
            groups[-1].append(row)
        else:
            text = yield wrap(node), seen
            (captions if node.tag == "caption" else stray).extend(text.split("\n") if text else [])
    rows: list[list[Cell]] = []
    for group in groups:
        place(group)
        rows += group
    widths = column_widths(rows)
    height = sum(max((len(c.lines) for c in row), default=0) for row in rows)
    if height * (sum(widths) + 2 * len(widths)) > 4000 + GROWTH * sum(len(x) for row in rows for c in row for x in c.lines):
        for row in rows:
            for cell in row:
                cell.lines = [x for line in cell.lines for x in broken(line)]
        widths = column_widths(rows)
    out = stray + captions
    begins = [0, *accumulate(w + 2 for w in widths)]
    for row in rows:
        for k in range(max((len(c.lines) for c in row), default=0)):
            line = ""
            for cell in row:
                if k < len(cell.lines) and cell.lines[k]:
                    line = line.ljust(begins[cell.column]) + cell.lines[k]
            if line.strip():
                out.append(line.rstrip())
    return out


def place(group: list[list[Cell]]) -> None:
    """Columns of a row group's cells: each goes to the next column that no cell from above reaches into."""
    busy: dict[int, int] = {}  # column: rows it is still taken
    for row in group:
        column = 0
        taken = {c: n - 1 for c, n in busy.items() if n > 1}
        for cell in row:
            while column in busy:
                column += 1
            cell.column = column
            if column > MAX_COLUMNS:
                cell.across = 1
            if cell.down != 1:
                for c in range(column, column + cell.across):
                    taken[c] = max(taken.get(c, 0), (cell.down or len(group)) - 1)
            column += cell.across
        busy = taken


def column_widths(rows: list[list[Cell]]) -> list[int]:
    """Of the widest cell; what a cell over several columns needs beyond theirs goes to its last."""
    widths = [0] * max((c.column + c.across for row in rows for c in row), default=0)
    wide = []
    for row in rows:
        for cell in row:
            if cell.across > 1:
                wide.append(cell)
            else:
                widths[cell.column] = max(widths[cell.column], max(map(len, cell.lines)))
    for cell in sorted(wide, key=lambda c: c.across):
        own = slice(cell.column, cell.column + cell.across)
        lacks = max(map(len, cell.lines)) - sum(widths[own]) - 2 * (cell.across - 1)
        if lacks > 0:
            widths[cell.column + cell.across - 1] += lacks
    return widths


def broken(line: str) -> list[str]:
    """Lines of ``WRAP`` characters at most, broken at spaces, else anywhere."""
    if len(line) <= WRAP:
        return [line]
    out, now = [], line[: len(line) - len(line.lstrip(" "))][: WRAP // 2]
    for word in line.split():
        if now.strip() and len(now) + 1 + len(word) > WRAP:
            out.append(now)
            now = ""
        now = f"{now} {word}" if now.strip() else now + word
        while len(now) > WRAP:
            out.append(now[:WRAP])
            now = now[WRAP:]
    return [*out, now] if now.strip() else out


def wrap(node: Node) -> Node:
    root = Node("#root")
    root.children = [node]
    return root


def html_to_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    root = builder.feed(html)
    return render(root, Styles(builder.css))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, htmls in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(htmls)), pa.array(map(html_to_text, htmls), pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
