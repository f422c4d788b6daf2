"""Operator 1: HTML to text as it would be laid out.

A tokenizer feeds a tree builder that knows void elements, implied end tags (p, li, dt and dd, option, table parts, head)
and stray end tags. Elements that are never shown, hidden by attribute or by inline style are kept out of the tree. The
renderer walks the tree without recursion: blocks are apart, paragraphs by an empty line, list items get bullets or
numbers by depth, pre keeps its blanks, and cells of a table are padded so that columns line up; in rows where a cell
has several lines the cells are blocks. What stands in a table but in no cell comes before it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import plus, table, tune

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist title noframes noembed".split())
# Never shown inside these.
UNSEEN_IN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient".split()), "math": frozenset(("annotation", "annotation-xml"))}
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside details div dd dt fieldset figcaption footer form header hgroup hr legend li main menu nav section summary tbody thead tfoot tr caption center dir textarea select optgroup option".split())
ENDS_P = SPACED | frozenset("address article aside details div dl fieldset figcaption footer form header hgroup hr main menu nav section summary center dir".split())
# An opening tag ends these open elements, looking no further up than the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
PARTS = frozenset("tr td th tbody thead tfoot caption colgroup".split())
#: Blanks that lining up columns may add for each character of the cells, and columns or rows that a cell spans at most.
PADDING, MOST_SPAN = 4, 100
#: Tables inside cells, laid out in columns so deep; in deeper ones each cell is a block of its own.
DEEP = 32
# An end tag does not reach past these.
SCOPE = {"td", "th", "table", "caption"}
_TOKEN = re.compile(r"<!--(?:>|->)|<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPANS = re.compile(r"\b(colspan|rowspan)\s*=\s*[\"']?\s*(\d{1,4})", re.I)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "kids", "start", "parts", "veiled", "spans")

    def __init__(self, tag: str, kids: list | None = None, veiled: bool = False):
        self.tag, self.kids, self.start, self.veiled = tag, kids or [], 1, veiled
        self.spans: dict[str, int] = {}
        #: are there parts of the table around it inside?
        self.parts = False


def _visibility(attrs: str) -> tuple[bool, bool | None]:
    """(is the element with all that is in it hidden, is its own text: None is as around it)."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low and "visibility" not in low:
        return False, None
    got = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
    style = got.get("style", "")
    seen = _VISIBILITY.findall(style)
    gone = "hidden" in got or got.get("type", "").lower() == "hidden" or bool(_HIDDEN.search(style))
    return gone, seen[-1].lower() != "visible" if seen else None


def parse(source: str) -> Node:
    """The tree of what can be seen. Never fails: what is no tag is text, and open elements end with the text."""
    root = Node("html")
    stack: list[tuple[str, Node | None]] = [("html", root)]
    dark = 0  # open elements that are not shown
    opened: Counter[str] = Counter()
    at, n = 0, len(source)

    def close(to: int) -> None:
        nonlocal dark
        while len(stack) > to:
            tag, node = stack.pop()
            opened[tag] -= 1
            dark -= node is None

    for_text = lambda a, b: stack[-1][1].kids.append(html.unescape(source[a:b])) if b > a and not dark and not stack[-1][1].veiled else None
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            for_text(at, n)
            break
        for_text(at, m.start())
        at = m.end()
        if end := m[1]:
            end = end.lower()
            if end in ("html", "body"):
                continue
            if end == "br":
                end = ""
                if not dark:
                    stack[-1][1].kids.append(Node("br"))
            for i in range(len(stack) - 1, 0, -1) if opened[end] > 0 else ():
                tag = stack[i][0]
                if tag == end:
                    close(i)
                    break
                if tag in SCOPE and end not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") or tag == "table" and end != "table":
                    break
        elif tag := m[2]:
            tag, attrs = tag.lower(), m[3]
            if tag in ENDS_P and opened["p"] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
            if tag in ENDS and any(opened[t] > 0 for t in ENDS[tag][0]):
                ends, stop = ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in stop:
                        close(i + 1 if any(t in ends for t, _ in stack[i + 1 :]) and tag in ("tr", "td", "th", "tbody", "thead", "tfoot") else len(stack))
                        break
                    if stack[i][0] in ends and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot"):
                        close(i)
                        break
            elif tag in BLOCK and opened["head"] > 0:
                close(next(i for i, (t, _) in enumerate(stack) if t == "head"))
            if tag == "html" or tag == "body" and opened["body"] > 0:
                continue
            foreign = "svg" if opened["svg"] > 0 else "math" if opened["math"] > 0 else ""
            gone, veiled = _visibility(attrs) if attrs else (False, None)
            unseen = dark or tag in UNSEEN or foreign and tag in UNSEEN_IN[foreign] or gone
            node = None if unseen else Node("svg text" if foreign == "svg" and tag == "text" else tag, None, stack[-1][1].veiled if veiled is None else veiled)
            if node is not None:
                if tag == "ol" and (s := re.search(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", attrs)):
                    node.start = int(s[1])
                if tag in ("td", "th") and "span" in attrs.lower():
                    node.spans = {k.lower(): min(max(int(n), 1), MOST_SPAN) for k, n in _SPANS.findall(attrs)}
                if tag in ("img", "optgroup") and not node.veiled and (alt := next((x[1] or x[2] or x[3] for x in _ATTR.findall(attrs) if x[0].lower() == ("alt" if tag == "img" else "label")), "")):
                    node.kids.append(html.unescape(alt))
                if tag in PARTS:
                    for t, above in reversed(stack):
                        if t == "table" or above.parts:
                            break
                        above.parts = True
                stack[-1][1].kids.append(node)
            if tag in VOID or attrs.endswith("/") and (foreign or tag not in BLOCK and tag not in UNSEEN):
                continue
            if tag in RAW:
                # up to its end tag all is text
                close_at = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                stop = close_at.start() if close_at else n
                if node is not None and not node.veiled:
                    node.kids.append(html.unescape(re.sub(r"\A\r?\n", "", source[at:stop])) if tag == "textarea" else source[at:stop])
                at = stop
            stack.append((tag, node))
            opened[tag] += 1
            dark += node is None
    return root


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Page:
    """Lines as they come; a gap is how many line ends must stand before the next text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap = 0
        self.blank = False
        self.mark = ""
        self.indent = ""

    def block(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.blank = False

    def put(self, text: str) -> None:
        if self.gap or not self.out:
            self.out.append(("\n" * self.gap if self.out else "") + (self.mark or self.indent))
            self.mark, self.gap, self.blank = "", 0, False
        elif self.blank:
            self.out.append(" ")
            self.blank = False
        self.out.append(text)

    def flow(self, text: str) -> None:
        words = _BLANKS.sub(" ", text)
        core = words.strip(" ")
        if not core:
            self.blank = self.blank or bool(words) and not self.gap and bool(self.out)
            return
        if words[0] == " " and not self.gap and self.out:
            self.blank = True
        self.put(core)
        self.blank = words[-1] == " "

    def text(self) -> str:
        """Lines have no blanks at their ends; the text has no empty lines at its ends."""
        return "\n".join(line.rstrip() for line in "".join(self.out).split("\n")).strip("\n")


def _table(node: Node) -> tuple[list, list[Node], list[list[Node]]]:
    """What stands before a table (text and elements in it that are in no cell), its captions, and its rows of cells."""
    before: list = []
    captions: list[Node] = []
    rows: list[list[Node]] = []
    todo = list(reversed(node.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                before.append(x)
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag in ("td", "th"):
            if not rows:
                rows.append([])
            rows[-1].append(x)
        elif x.tag in PARTS or x.parts:
            if x.tag == "tr":
                rows.append([])
            elif x.tag in BLOCK and x.tag not in PARTS:
                todo.append(Node("div"))
                before.append(Node("div"))
            todo += reversed(x.kids)
        else:
            before.append(x)
    return before, captions, [r for r in rows if r]


def _span(node: Node, name: str) -> int:
    return node.spans.get(name, 1)


def _grid(rows: list[list[Node]]) -> list[list[int]]:
    """The first column of each cell: cells that span columns or rows push those behind and below them aside."""
    out, held = [], {}
    for r in rows:
        at, mine = 0, []
        ahead = {c: n - 1 for c, n in held.items() if n > 1}
        for cell in r:
            while held.get(at, 0) > 0:
                at += 1
            mine.append(at)
            for c in range(at, at + _span(cell, "colspan")):
                if _span(cell, "rowspan") > 1:
                    ahead[c] = _span(cell, "rowspan") - 1
            at += _span(cell, "colspan")
        out.append(mine)
        held = ahead
    return out


def _widths(cells: list[list[tuple[int, int, int]]], most: int | None) -> dict[int, int]:
    """Width of each column from (column, columns, width) of the cells in it alone; wider cells than most don't count."""
    wide: dict[int, int] = {}
    for r in cells:
        for at, n, w in r:
            if n == 1 and (most is None or w <= most):
                wide[at] = max(wide.get(at, 0), w)
    return wide


def _padded(r: list[tuple[int, int, int]], wide: dict[int, int]) -> list[tuple[int, int]]:
    """(blanks before, blanks behind) each cell of a row: columns are two blanks apart, and a cell that no width holds
    moves what is behind it."""
    out, at = [], 0
    for c, n, w in r:
        lead = sum(wide.get(k, 0) + 2 for k in range(at, c)) if c > at else 0
        room = sum(wide.get(k, 0) for k in range(c, c + n)) + 2 * (n - 1)
        out.append((lead, max(0, room - w)))
        at = c + n
    return out


def _columns(page: _Page, rows: list[list[list[str]]], places: list[list[int]], spans: list[list[int]]) -> None:
    """Puts rows of cells, each the lines of one: columns line up, but the cells of a row with longer ones are blocks.

    Lining up may add PADDING characters for each one of the cells. Where whole widths would take more, as in a table
    with one very wide cell and very many short ones, wide cells stand out of line: the greatest width that fits in is
    used."""
    flat = [all(len(c) == 1 for c in r) for r in rows]
    cells = [[(at, n, _width(c[0])) for c, at, n in zip(r, p, s, strict=True)] if one else [] for r, p, s, one in zip(rows, places, spans, flat, strict=True)]
    held = sum(w + 1 for r in cells for _, _, w in r)
    for most in (None, 160, 80, 40, 20, 10, 5, 0):
        wide = _widths(cells, most)
        pads = [_padded(r, wide) for r in cells]
        if sum(a + b for p in pads for a, b in p) <= PADDING * held:
            break
    else:
        pads = [[(0, 0)] * len(r) for r in cells]
    for r, one, p in zip(rows, flat, pads, strict=True):
        lines = ["  ".join(" " * a + c + " " * b for (c,), (a, b) in zip(r, p, strict=True)).rstrip()] if one else None
        for c in [lines] if one else r:
            for line in c:
                if line:
                    page.put(line)
                    page.block(1)
                elif not one and len(c) > 1:
                    page.gap += 1


def render(root: Node) -> str:
    """The tree as text. Lines have no blanks at their ends; the text has no empty lines at its ends."""
    page = _Page()
    lists: list[list] = []  # [is it ordered, next number]
    pre = 0
    outer: list[tuple] = []  # what is left for a cell: page, lists and pre around it
    todo: list = [(0, root)]
    while todo:
        ends, x = todo.pop()
        if ends == 2:
            captions, rows = x
            page.block(2)
            if len(outer) >= DEEP or all(len(r) == 1 for r in rows):
                todo.append((1, Node("table")))
                todo += [(0, Node("div", c.kids)) for r in reversed(rows) for c in reversed(r)]
            else:
                done: list[list[str]] = []
                todo.append((3, (rows, done)))
                for c in (c for r in reversed(rows) for c in reversed(r)):
                    todo.append((5, done))
                    todo += [(0, k) for k in reversed(c.kids)]
                    todo.append((4, None))
            todo += [(0, c) for c in reversed(captions)]
            continue
        if ends == 3:
            rows, cells = x[0], iter(x[1])
            _columns(page, [[next(cells) for _ in r] for r in rows], _grid(rows), [[_span(c, "colspan") for c in r] for r in rows])
            page.block(2)
            continue
        if ends == 4:
            outer.append((page, lists, pre))
            page, lists, pre = _Page(), [], 0
            continue
        if ends == 5:
            x.append(page.text().split("\n"))
            page, lists, pre = outer.pop()
            continue
        if isinstance(x, str):
            if not pre:
                page.flow(x)
                continue
            for i, line in enumerate(x.replace("\r\n", "\n").split("\n")):
                if i:
                    page.gap += 1
                if line:
                    page.put(line)
            continue
        tag = x.tag
        space = 2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1
        if ends:
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                page.indent = "  " * len(lists)
                space = 1 if lists else 2
            elif tag in ("pre", "textarea"):
                pre -= 1
            elif tag == "li":
                page.mark = ""
            page.block(space)
            continue
        if tag == "br":
            page.gap += 1
            page.blank = False
            continue
        if tag == "table":
            before, *rest = _table(x)
            todo.append((2, rest))
            todo += [(0, k) for k in reversed(before)]
            continue
        if tag in BLOCK:
            page.block(space)
            todo.append((1, x))
            if tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", x.start])
                page.indent = "  " * len(lists)
            elif tag == "li":
                now = lists[-1] if lists else [False, 1]
                page.mark = "  " * max(len(lists) - 1, 0) + (f"{now[1]}. " if now[0] else "- ")
                now[1] += 1
            elif tag in ("pre", "textarea"):
                pre += 1
        elif tag in ("td", "th", "svg text"):
            page.flow(" ")
        todo += [(0, k) for k in reversed(x.kids)]
    return page.text()


def text_of(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract(df: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """df with the visible text of each page. Null and empty pages have an empty text; a column of that name is replaced,
    others stay; repeated rows come out alike; an empty table stays empty."""
    df = df.drop(text)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_of(x) for x in b.column(html_column).to_pylist()], pa.string())], [*b.schema.names, text])

    return df.mapInArrow(run, plus(df.schema, f"{text} string"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
