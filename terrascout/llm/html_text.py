"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder with implied tags; elements are laid out as they
close: blocks on lines of their own with blank lines where margins would be, list
items with markers and hanging indents, table cells padded to their column.  No
recursion, so depth is bounded by memory only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm.common import map_batches

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
NEVER = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blank lines around; other blocks only begin a new line.
SPACED = HEADINGS | frozenset("p ul ol dl pre blockquote table figure fieldset xmp menu dir".split())
BLOCK = SPACED | frozenset("""address article aside body center dd details dialog div dt figcaption footer form header
hgroup hr html legend li main nav optgroup option search section summary caption""".split())
CLOSES_P = BLOCK - frozenset("option optgroup legend caption html body".split())
TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption colgroup".split())
INDENT = 64  # columns; what is nested deeper isn't indented further, so that text grows with its page
ALIGNED = 16  # tables inside each other; cells of deeper ones are lines of their own

SCOPE = frozenset("table td th caption html template object button".split())


class Flow:
    """Lines of text under construction in one column of layout."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0           # blank lines due before the next line
        self.space = False     # white space is due before the next word
        self.indent: list[int] = [0]  # columns, one more entry for each open list item or quote
        self.marker = ""

    def text(self, text: str, verbatim: bool) -> None:
        if verbatim:
            for i, piece in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if i:
                    self.flush(force=True)
                if piece:
                    self.line.append(piece)
            return
        words = BLANKS.sub(" ", text)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words.rstrip(" ") if self.space else words)

    def flush(self, force: bool = False) -> None:
        """End the line; an empty one counts only if forced (br, pre)."""
        self.space = False
        if not self.line and not force:
            return
        self.put("".join(self.line))
        self.line = []

    def put(self, line: str) -> None:
        hang = " " * self.indent[-1]
        if self.marker:
            hang = hang[:max(0, len(hang) - len(self.marker))] + self.marker
            self.marker = ""
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append((hang + line).rstrip())

    def deepen(self, columns: int) -> None:
        self.indent.append(min(INDENT, self.indent[-1] + columns))

    def block(self, margin: int) -> None:
        self.flush()
        self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


@dataclass
class Table:
    caption: list[str] = field(default_factory=list)
    rows: list[list[tuple[list[str], int]]] = field(default_factory=list)

    def lines(self) -> list[str]:
        """Cells padded to the width of their column and two spaces apart; a spanning cell takes the columns it spans."""
        places = [list(accumulate((c[1] for c in row[:-1]), initial=0)) for row in self.rows]
        # Only a cell's last column is ever widened; columns in which none ends have no width and take no work.
        ends = sorted({i + c[1] - 1 for at, row in zip(places, self.rows) for i, c in zip(at, row)})
        width, sums = [0] * len(ends), [0] * (len(ends) + 1)

        def widen(k: int, by: int) -> None:
            width[k] += by
            k += 1
            while k <= len(ends):
                sums[k] += by
                k += k & -k

        def before(column: int) -> int:
            """Width of all columns before one, from a tree of partial sums."""
            k, total = bisect_left(ends, column), 0
            while k:
                total += sums[k]
                k -= k & -k
            return total

        for span in (False, True):
            for at, row in zip(places, self.rows):
                for i, (lines, n) in zip(at, row):
                    if (n > 1) == span:
                        wide = max(map(len, lines), default=0) - (before(i + n) - before(i)) - 2 * (n - 1)
                        if wide > 0:
                            widen(bisect_left(ends, i + n - 1), wide)
        starts = list(accumulate((w + 2 * (w > 0) for w in width), initial=0))
        out = list(self.caption)
        for at, row in zip(places, self.rows):
            for k in range(max((len(c[0]) for c in row), default=0)):
                line = ""
                for i, (lines, _) in zip(at, row):
                    if k < len(lines) and lines[k]:
                        line = line.ljust(starts[bisect_left(ends, i)]) + lines[k]
                out.append(line.rstrip())
        return out


@dataclass
class Element:
    name: str
    hidden: bool
    verbatim: bool
    flow: Flow | None = None      # of a cell or caption: its own column
    table: Table | None = None
    row: list | None = None
    span: int = 1
    indent: int = 0
    count: int | None = None      # next number of an ordered list


class Page:
    def __init__(self) -> None:
        self.flow = Flow()
        self.open: list[Element] = []
        self.flows: list[Flow] = []
        self.tables: list[Table] = []
        self.names: dict[str, int] = {}  # open elements by name

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1].hidden

    def has(self, *names: str) -> bool:
        return any(self.names.get(n) for n in names)

    def in_scope(self, names: frozenset | set, stop: frozenset) -> bool:
        if not self.has(*names):
            return False
        for e in reversed(self.open):
            if e.name in names:
                return True
            if e.name in stop:
                return False
        return False

    def push(self, name: str, attrs: dict[str, str]) -> None:
        up = self.open[-1] if self.open else None
        style = attrs.get("style", "").replace(" ", "").lower()
        hidden = (bool(up and up.hidden) or name in NEVER or "hidden" in attrs or "display:none" in style
                  or "visibility:hidden" in style or name == "dialog" and "open" not in attrs
                  or bool(up and up.name == "details" and up.span == 0 and name != "summary"))
        e = Element(name, hidden, bool(up and up.verbatim) or name in ("pre", "textarea", "xmp"))
        self.open.append(e)
        self.names[name] = self.names.get(name, 0) + 1
        if name == "details":
            e.span = int("open" in attrs)  # 0: only its summary shows
        if hidden:
            return
        if name in ("td", "th", "caption"):
            if len(self.tables) > ALIGNED:
                self.flow.block(0)
                return
            e.flow = Flow()
            self.flows.append(self.flow)
            self.flow = e.flow
            value = attrs.get("colspan", "1")
            e.span = min(1000, max(1, int(value))) if value.isdecimal() and len(value) < 9 else 1
            return
        if name == "table":
            e.table = Table()
            self.tables.append(e.table)
            self.flow.block(1)
        elif name == "tr":
            e.row = []
        elif name in ("ul", "ol", "menu", "dir"):
            nested = self.has("li")
            self.flow.block(0 if nested else 1)
            if name == "ol":
                value = attrs.get("start", "1")
                e.count = int(value) if re.fullmatch(r"-?\d{1,9}", value) else 1
        elif name == "li":
            self.flow.block(0)
            marker = "- "
            for above in reversed(self.open[:-1]):
                if above.name == "ol":
                    marker, above.count = f"{above.count}. ", (above.count or 0) + 1
                if above.name in ("ol", "ul", "menu", "dir"):
                    break
            self.flow.deepen(len(marker))
            self.flow.marker = marker
            e.indent = 1
        elif name in ("blockquote", "dd"):
            self.flow.block(1 if name == "blockquote" else 0)
            self.flow.deepen(2)
            e.indent = 1
        elif name in BLOCK:
            self.flow.block(1 if name in SPACED else 0)

    def pop(self) -> None:
        e = self.open.pop()
        self.names[e.name] -= 1
        if e.hidden:
            return
        if e.flow is not None:
            lines = e.flow.done()
            self.flow = self.flows.pop()
            if e.name == "caption":
                if self.tables:
                    self.tables[-1].caption += lines
            else:
                row = next((x.row for x in reversed(self.open) if x.row is not None), None)
                if row is not None:
                    row.append((lines, e.span))
        elif e.row is not None:
            if e.row and self.tables:
                self.tables[-1].rows.append(e.row)
        elif e.table is not None:
            self.tables.pop()
            self.flow.block(1)
            for line in e.table.lines():
                self.flow.put(line)
            self.flow.gap = 1
        elif e.name in BLOCK:
            nested = e.name in ("ul", "ol", "menu", "dir") and self.has("li")
            self.flow.block(1 if e.name in SPACED and not nested else 0)
            if e.indent:
                self.flow.indent.pop()
                self.flow.marker = ""

    def pop_to(self, names: frozenset | set) -> None:
        while self.open:
            name = self.open[-1].name
            self.pop()
            if name in names:
                return

    def clear_to(self, names: frozenset | set) -> None:
        """Close what is open above the nearest element of ``names``."""
        while self.open and self.open[-1].name not in names:
            self.pop()

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body", "head") and self.has(name):
            return
        if self.has("head") and name not in ("head", "title", "meta", "link", "base", "script", "style", "template", "noscript"):
            self.pop_to({"head"})  # the body begins
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            if not self.tables or not self.has("table"):
                return  # parts of a table outside of one are ignored
            if name in ("td", "th"):
                self.clear_to({"tr", "tbody", "thead", "tfoot", "table"})
                if self.open and self.open[-1].name == "table":
                    self.push("tbody", {})
                if self.open and self.open[-1].name != "tr":
                    self.push("tr", {})
            elif name == "tr":
                self.clear_to({"tbody", "thead", "tfoot", "table"})
                if self.open and self.open[-1].name == "table":
                    self.push("tbody", {})
            else:
                self.clear_to({"table"})
            if name != "col":
                self.push(name, attrs)
            return
        if name in CLOSES_P and self.in_scope({"p"}, SCOPE):
            self.pop_to({"p"})
        if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
            self.pop()
        elif name == "li" and self.in_scope({"li"}, SCOPE | {"ul", "ol", "menu", "dir"}):
            self.pop_to({"li"})
        elif name in ("dt", "dd") and self.in_scope({"dt", "dd"}, SCOPE | {"dl"}):
            self.pop_to({"dt", "dd"})
        elif name in ("option", "optgroup") and self.in_scope({"option"}, SCOPE | {"select"}):
            self.pop_to({"option"})
        if name == "br":
            if not self.hidden():
                self.flow.flush(force=True)
        elif name == "hr":
            if not self.hidden():
                self.flow.block(1)
        elif name == "img":
            return
        elif name not in VOID:
            self.push(name, attrs)

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", {})
        if name in ("html", "body"):
            return None  # what follows still belongs to the body
        if name in HEADINGS:
            names = HEADINGS
        elif name == "p" and not self.in_scope({"p"}, SCOPE):
            if not self.hidden():
                self.flow.block(1)  # an end without a start is an empty paragraph
            return None
        else:
            names = {name}
        if name in TABLE_PARTS or name == "table":
            stop = frozenset({"table"} - {name})
        elif name in BLOCK or name in VOID:
            stop = SCOPE - {name}
        else:
            stop = (SCOPE | BLOCK) - {name}  # an inline end tag doesn't close blocks
        if self.in_scope(names, stop):
            self.pop_to(names)
        return None

    def text(self, text: str) -> None:
        if self.has("head") and self.open and self.open[-1].name == "head" and not text.isspace():
            self.pop_to({"head"})
        if self.hidden() or (self.open and self.open[-1].name == "details" and self.open[-1].span == 0):
            return
        # Text between the parts of a table goes before the table: its own column isn't open.
        self.flow.text(unescape(text) if "&" in text else text, bool(self.open) and self.open[-1].verbatim)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def render(html: str | None) -> str:
    """All visible text; '' for NULL, empty or wholly hidden pages."""
    html = (html or "").replace("\0", "")
    page, at = Page(), 0
    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at:m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            page.end(name)
            continue
        page.start(name, attributes(m["attrs"]) if m["attrs"] else {})
        if name in RAW:
            stop = RAW[name].search(html, at)
            until = stop.start() if stop else len(html)
            if name in ("textarea", "xmp") and until > at:
                page.text(html[at:until].removeprefix("\n"))
            at = until
        elif name in ("pre", "listing") and html[at:at + 1] == "\n":
            at += 1  # a line break right after <pre> is not part of it
    while page.open:
        page.pop()
    return "\n".join(page.flow.done())


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines) for every row.

    NULL or empty HTML gives an empty text with 0 lines; repeated rows are rendered one by
    one; ids may be NULL; other columns are not read.  Memory holds one batch of pages; a very
    long or deeply nested page gives a text in proportion, as indents end at ``INDENT``
    columns and tables inside more than ``ALIGNED`` others become lines.
    """
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(h) for h in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
             pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
            names=["page_id", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_batches(rows, each, f"page_id {kind}, text string, n_chars long, n_lines long")
