"""HTML to text by layout (operator 4): a tree with implied tags, visibility rules, block rendering.

All visible text is emitted: paragraphs and headings stand between blank lines, other blocks on
lines of their own, list items behind their marker, table rows with cells padded to columns. Hidden
are elements without a rendering, with the attribute hidden, with display:none, and with
visibility:hidden where no element inside is visible again; declarations are taken from style
attributes and from style elements with plain selectors (tag, .class, #id, tag.class, tag#id) that
stand outside @-blocks.

A column of a table is padded to its widest cell, but to no more than twice the mean width and
WIDE characters, and a table whose padding would outweigh its text by far is not padded: output
stays in proportion to the page.

Defined cases: a null or empty page renders as the empty text; unclosed tags, comments and quotes
end with the page; unknown tags are inline; a page of any length and nesting of any depth is handled
whole, without recursion and in linear time; repeated rows each get a result; null page_ids are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from minnow.llm.cluster import ship

# Fixed values of the HTML standard: element groups.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist map area base link meta param source track col colgroup rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary caption thead tbody tfoot tr td th".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt option optgroup caption thead tbody tfoot tr td th legend".split()) | {"li", "dd", "dt"}
#: A start tag closes these open elements, up to the scope given.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table td th caption button object template html".split())

TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?\Z", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    children: list[Node | str] = field(default_factory=list)

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


#: Widths that a column may have beyond twice the mean; characters of padding that one of text may cost.
WIDE, MOST_PADDING = 24, 8


class Rules:
    """What a page's style elements say of display and visibility, by plain selector; later rules win."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str, str], dict[str, str]] = {}

    def add(self, sheet: str) -> None:
        """Rules of a sheet; those within @-blocks hold for some media only and are left out."""
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
        open_, at = [], 0  # type: list[str], int
        for m in re.finditer("[{}]", sheet):
            inside, at = sheet[at : m.start()], m.end()
            if m[0] == "{":
                open_.append(inside.rpartition(";")[2].strip())
            elif open_:
                selectors = open_.pop()
                if not any(x.startswith("@") for x in (*open_, selectors)) and (says := {k.lower(): v.lower() for k, v in DECLARATION.findall(inside)}):
                    for x in selectors.split(","):
                        if (found := SELECTOR.match(x.strip())) and found[0]:
                            self.known.setdefault(((found[1] or "").lower(), found[2] or "", found[3] or ""), {}).update(says)

    def of(self, node: Node) -> dict[str, str]:
        """Declarations for an element: by tag, class and id, then its own style."""
        says: dict[str, str] = {}
        if self.known:
            for kind, names in (("", [""]), (".", (node.get("class") or "").split()), ("#", [node.get("id") or ""])):
                for name in names:
                    for tag in ("", node.tag):
                        if tag or kind:
                            says |= self.known.get((tag, kind, name), {})
        if node.attrs and (style := node.get("style")):
            says |= {k.lower(): v.lower() for k, v in DECLARATION.findall(style)}
        return says


def build(page: str) -> tuple[Node, Rules]:
    """The tree of a page and the rules of its style elements; end tags that the page leaves out are implied."""
    root, rules = Node("#root", ""), Rules()
    stack = [root]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    at, n = 0, len(page)

    def cut(k: int) -> None:
        """Close the open elements from the k-th on."""
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    def push(x: Node) -> None:
        places[x.tag].append(len(stack))
        stack.append(x)

    def last(names: frozenset[str] | set[str]) -> int:
        """Place of the innermost open element of names, 0 without one."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close(names: frozenset[str] | set[str], until: frozenset[str] | set[str]) -> None:
        """Close the outermost open element of names that stands within the innermost one of until."""
        scope = last(until - names)
        inside = [p[i] for x in names if (p := places.get(x)) and (i := bisect_right(p, scope)) < len(p)]
        if inside:
            cut(min(inside))

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not places["p"]:
                stack[-1].children.append(Node("p", ""))
            elif name == "br":
                stack[-1].children.append(Node("br", ""))
            else:
                names = HEADINGS if name in HEADINGS else {name}
                scope = {"table"} if name in IMPLIED_END else SCOPES - names
                if (k := last(names)) > last(scope):
                    cut(k)
            continue
        if name in IMPLIED_END:
            close(*IMPLIED_END[name])
        if name in CLOSES_P:
            close({"p"}, SCOPES)
        if name in HEADINGS and stack[-1].tag in HEADINGS:
            cut(len(stack) - 1)
        if name == "body":
            close({"head"}, {"body"})
        if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack[-1].children.append(row := Node("tr", ""))
            push(row)
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in VOID or name in RAW and m[3].rstrip().endswith("/") and name not in ("script", "style", "textarea", "title"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            inside = page[at : end.start() if end else n]
            at = end.end() if end else n
            if name == "textarea":
                node.children.append(html.unescape(inside))
            elif name == "style":
                rules.add(inside)
            continue
        push(node)
    return root, rules


def shown(node: Node, says: dict[str, str]) -> bool:
    """Whether an element has a rendering at all."""
    if node.tag in UNSEEN or says.get("display") == "none":
        return False
    return not node.attrs or node.attrs == "/" or node.get("hidden") is None and node.tag != "input"


class Frame:
    """Lines of one flow of text: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.lead: list[str] = []  # indents of open lists and quotes
        self.marker = ""

    def add(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.put(first)
            for x in rest:
                self.flush(True)
                self.put(x)
            return
        text = SPACE.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self.put(text)

    def put(self, text: str) -> None:
        self.line += text

    def flush(self, force: bool = False) -> None:
        text = self.line.rstrip(" ")
        self.line = ""
        if text or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = "".join(self.lead)
            if self.marker and text:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append((lead + text).rstrip(" "))

    def space(self) -> None:
        self.flush()
        self.gap = True

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


@dataclass(slots=True)
class Cell:
    lines: list[str]
    columns: int = 1
    rows: int = 1


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """The cells of each row with their first column; cells that reach down from rows above keep their columns."""
    out, taken = [], {}  # type: list[list[tuple[int, Cell]]], dict[int, tuple[int, int]]
    for r, row in enumerate(rows):
        taken = {c: (end, width) for c, (end, width) in taken.items() if end > r}
        line, at = [], 0
        for cell in row:
            while at in taken:
                at += taken[at][1]
            line.append((at, cell))
            if cell.rows > 1:
                taken[at] = (r + cell.rows, cell.columns)
            at += cell.columns
        out.append(line)
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table: the cells of a column start at one place, unless one before them is far too wide."""
    grid = placed(rows)
    widths: defaultdict[int, list[int]] = defaultdict(list)
    for row in grid:
        for at, cell in row:
            if cell.lines:
                widths[at].append(max(map(len, cell.lines)) if cell.columns == 1 else 0)
    start, left = {}, 0
    for at in sorted(widths):
        start[at] = left
        left += min(max(widths[at]), 2 * sum(widths[at]) // len(widths[at]) + WIDE) + 2
    cells = [(start[at], x) for row in grid for at, cell in row for x in cell.lines]
    padded = sum(max((start[at] for at, cell in row if i < len(cell.lines)), default=0) for row in grid for i in range(max((len(c.lines) for _, c in row), default=0)))
    if padded > MOST_PADDING * sum(len(x) + 2 for _, x in cells) + 1000:
        start = dict.fromkeys(start, 0)
    out = []
    for row in grid:
        for i in range(max((len(c.lines) for _, c in row), default=0)):
            line = ""
            for at, cell in row:
                if i < len(cell.lines) and cell.lines[i]:
                    line = line.ljust(start[at] if len(line) + 2 <= start[at] or not line else len(line) + 2) + cell.lines[i]
            out.append(line.rstrip())
    return out


def number(node: Node, name: str, default: int) -> int:
    try:
        return int(node.get(name) or default)
    except ValueError:
        return default


def render(page: str | None) -> str:
    """The visible text of a page."""
    root, rules = build(page or "")
    frames, tables = [Frame()], []  # type: list[Frame], list[list[list[Cell]]]
    counters: list[int | None] = []
    pre = 0
    work: list[tuple[bool, Node | str, bool]] = [(True, root, True)]
    while work:
        opening, x, seen = work.pop()
        f = frames[-1]
        if isinstance(x, str):
            if seen:
                f.add(x, pre > 0)
            continue
        tag = x.tag
        if opening:
            if tag == "br":
                if seen:
                    f.flush(True)
                continue
            says = rules.of(x)
            if not shown(x, says):
                continue
            if "visibility" in says and says["visibility"] != "inherit":
                seen = says["visibility"] not in ("hidden", "collapse")
            if tag in SPACED and not (tag in ("ul", "ol") and counters):
                f.space()
            elif tag in BLOCK and tag not in ("td", "th"):
                f.flush()
            if tag == "hr":
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                counters.append(number(x, "start", 1) if tag == "ol" else None)
                f.lead.append("")
            elif tag == "li":
                count = counters[-1] if counters else None
                if count is not None:
                    count = number(x, "value", count)
                    counters[-1] = count + 1
                f.marker = "- " if count is None else f"{count}. "
                f.lead.append(" " * len(f.marker))
            elif tag in ("blockquote", "dd"):
                f.lead.append("  ")
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                frames.append(Frame())
            work.append((False, x, seen))
            if tag == "details" and x.get("open") is None:
                kids = [k for k in x.children if isinstance(k, Node) and k.tag == "summary"]
            else:
                kids = x.children
            work.extend((True, k, seen) for k in reversed(kids))
            continue
        if tag in ("td", "th") and tables:
            span = lambda name, most: min(max(number(x, name, 1), 1), most)  # noqa: E731, B023
            tables[-1][-1].append(Cell(frames.pop().done(), span("colspan", 1000), span("rowspan", 65534)))
            continue
        if tag == "table":
            f.space()
            for line in aligned(tables.pop()):
                f.put(line)
                f.flush(True)
            f.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            f.flush()
            counters.pop()
            f.lead.pop()
            f.gap = f.gap or not counters
        elif tag == "li":
            f.flush()
            f.lead.pop()
            f.marker = ""
        elif tag in ("blockquote", "dd"):
            f.flush()
            f.lead.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        if tag in SPACED and tag not in ("ul", "ol"):
            f.space()
        elif tag in BLOCK:
            f.flush()
    return "\n".join(frames[0].done())


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of each page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + bool(x) for x in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    schema = T.StructType([pages.schema["page_id"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_lines", T.LongType())])
    return pages.select("page_id", "html").mapInArrow(run, schema)
