"""HTML extraction: a tree with implied tags, visibility rules, and rendering that keeps the layout."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.llm.base import sliced

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset("head script style template noscript iframe object canvas audio video select datalist rp noframes".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div section article aside header footer main nav address form li dt dd tr caption "
    "figcaption details summary legend center option thead tbody tfoot".split()
)
#: A start tag ends these open elements, looked for no farther out than the bounds.
IMPLIED_END: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Any other start tag, and any text, ends an open head.
IN_HEAD = frozenset("base link meta title noscript noframes style script template".split())
#: A start tag ends whatever else is open in the innermost of these: misplaced elements, a column group.
ROW_GROUPS = frozenset("thead tbody tfoot".split())
TABLE_CONTEXT = dict.fromkeys(ROW_GROUPS, frozenset(["table"])) | {"tr": ROW_GROUPS | {"table"}}
#: Elements with rules of their own inside, those in them that hold HTML again, and the start tags that end them.
FOREIGN = frozenset(["svg", "math"])
NOT_FOREIGN = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: What a drawing or formula does not show, and what stands apart in it.
UNDRAWN = frozenset(
    "desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split()
)
APART = frozenset("text foreignobject mtr mtd".split())
_FOREIGN = re.compile(r"<(?:svg|math)\b", re.IGNORECASE)
#: An end tag or an implied end does not reach out of these.
SCOPES = frozenset("table td th caption html template".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|</[^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")
#: The widest and tallest cell, and inputs that show their value as a label.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
LABELLED = frozenset("submit reset button".split())
_SPACES = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Element:
    name: str
    hidden: bool = False
    start: int | None = None  # of an ordered list, or the number that a list item asks for
    backwards: bool = False
    silent: bool | None = None  # takes its place without its text; None: as what it stands in
    columns: int = 1
    rows: int = 1
    label: str = ""
    apart: bool = False
    children: list[Element | str] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return found


def _number(value: str | None) -> int | None:
    m = _NUMBER.match(value or "")
    return int(m[1]) if m else None


def _element(name: str, source: str) -> Element:
    out = Element(name, name in HIDDEN or name == "dialog")
    if source and not source.isspace():
        have = _attributes(source)
        style = {k.lower(): v.lower() for k, v in _STYLE.findall(have.get("style", ""))}  # the last one holds
        unseen = style.get("display") == "none" or (name == "tr" and style.get("visibility") == "collapse")
        closed = name in HIDDEN or (name == "dialog" and "open" not in have)
        out.hidden = closed or unseen or "hidden" in have or have.get("aria-hidden", "").lower() == "true"
        if "visibility" in style and style["visibility"] != "inherit":
            out.silent = style["visibility"] in ("hidden", "collapse")
        if name == "ol":
            out.start, out.backwards = _number(have.get("start")), "reversed" in have
        elif name == "li":
            out.start = _number(have.get("value"))
        elif name in ("td", "th"):
            columns, rows = _number(have.get("colspan")), _number(have.get("rowspan"))
            out.columns = min(max(1 if columns is None else columns, 1), MOST_COLUMNS)
            # nought rows: down to the end of the group
            out.rows = MOST_ROWS if rows == 0 else min(max(1 if rows is None else rows, 1), MOST_ROWS)
        elif name == "input" and have.get("type", "").lower() in LABELLED:
            out.label = have.get("value", "")
    return out


def build(source: str) -> Element:
    """The tree of a page. Never fails: what is not a tag is text, and open elements end with their parents."""
    root = Element("#root")
    stack = [root]
    at = 0

    def close(names: frozenset[str], bounds: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in bounds:
                return

    has_foreign = _FOREIGN.search(source) is not None

    def foreign() -> int:
        """Where the drawing or formula is open whose rules hold, or 0."""
        for i in range(len(stack) - 1 if has_foreign else 0, 0, -1):
            if stack[i].name in FOREIGN:
                return i
            if stack[i].name in NOT_FOREIGN:
                break
        return 0

    def text(value: str) -> None:
        if value:
            if stack[-1].name == "head" and value.strip(" \t\n\r\f"):
                stack.pop()
            if not stack[-1].silent:
                stack[-1].children.append(html.unescape(value) if "&" in value else value)

    pos = 0
    while m := _TOKEN.search(source, pos):
        text(source[at : m.start()])
        at = pos = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            if name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].children.append(Element("p"))
            bounds = SCOPES - {"td", "th", "caption"} if name in TABLE_CONTEXT else SCOPES
            close(frozenset([name]), frozenset() if name in SCOPES else bounds)
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            stack.pop()
        if name in BREAKOUT and (outer := foreign()):
            del stack[outer:]
        if name == "form" and (stack[-1].name in ("table", "tr") or stack[-1].name in ROW_GROUPS):
            continue  # between rows or cells it holds nothing: they belong to the table
        if name in PARAGRAPHS or name in BLOCKS:
            close(frozenset(["p"]), SCOPES | {"button"})  # a block ends an open paragraph
        if name in IMPLIED_END:
            ended, bounds = IMPLIED_END[name]
            if name == "tr" or name in ("thead", "tbody", "tfoot"):
                for _ in range(3 if name != "tr" else 2):  # cell, row and group of rows
                    close(ended | ({"tr", "td", "th"} if name != "tr" else frozenset()), bounds)
            else:
                close(ended, bounds)
        if name in TABLE_CONTEXT:
            context = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in TABLE_CONTEXT[name]), len(stack))
            del stack[context + 1 :]
        if name in ("td", "th") and stack[-1].name == "colgroup":
            stack.pop()
        if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            row = Element("tr", silent=stack[-1].silent)
            stack[-1].children.append(row)
            stack.append(row)
        made = _element(name, m[3])
        if made.silent is None:
            made.silent = stack[-1].silent
        if made.label and not made.silent:
            made.children.append(made.label)
        stack[-1].children.append(made)
        inside = foreign() > 0
        if inside:
            made.hidden, made.apart = made.hidden or name in UNDRAWN, name in APART
        if m[4] and (inside or name in FOREIGN):
            continue  # only here does the slash end the element
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, pos)
            stop = end.start() if end else len(source)
            if name not in HIDDEN and name != "title" and not made.silent:
                made.children.append(html.unescape(source[pos:stop]))
            at = pos = end.end() if end else len(source)
        elif name not in VOID:
            stack.append(made)
    text(source[at:])
    return root


class _Lines:
    """Output of blocks: lines, with at most one empty line between paragraphs."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap = False

    def add(self, text: str) -> None:
        self.words.append(text)

    def end_line(self) -> None:
        line = _SPACES.sub(" ", "".join(self.words)).strip(" ")
        self.words = []
        if line:
            self._put(line)

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def put(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            if line or not self.gap:
                self._put(line)

    def paragraph(self) -> None:
        self.end_line()
        self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _rows(group: Element) -> Iterator[tuple[Element, Element]]:
    """(row, the group of rows it stands in)"""
    for child in group.children:
        if isinstance(child, Element) and not child.hidden:
            if child.name == "tr":
                yield child, group
            elif child.name in ROW_GROUPS:
                yield from _rows(child)


def _outside_rows(group: Element, out: _Lines) -> None:
    for child in group.children:
        if isinstance(child, str):
            out.add(child)
        elif child.name in ROW_GROUPS or child.name == "colgroup":
            if not child.hidden:
                _outside_rows(child, out)
        elif child.name not in ("tr", "col"):
            _render(child, out)
            out.end_line()


def _placed(rows: list[tuple[Element, Element]]) -> list[list[tuple[int, int, str]]]:
    """Per row its cells as (first column, column behind the last, text): a cell takes the next column that no cell
    from above reaches into, and none reaches out of its group of rows."""
    out = []
    until: dict[int, int] = {}  # column -> first row that is free again
    inside = None
    for r, (row, group) in enumerate(rows):
        if group is not inside:
            until, inside = {}, group
        column, cells = 0, []
        for cell in row.children:
            if isinstance(cell, Element) and not cell.hidden:
                while until.get(column, 0) > r:
                    column += 1
                cells.append((column, column + cell.columns, " ".join(x for x in lines_of(cell) if x)))
                if cell.rows > 1:
                    until.update(dict.fromkeys(range(column, column + cell.columns), r + cell.rows))
                column += cell.columns
        out.append(cells)
    return out


def _table(table: Element, out: _Lines) -> None:
    """Cells of a row in one line, the columns aligned; what stands outside of rows comes first. A cell over several
    columns or rows has its text where it begins."""
    _outside_rows(table, out)
    out.end_line()
    rows = list(_rows(table))
    loose = [" ".join(x for x in lines_of(Element("tr", children=[c for c in row.children if isinstance(c, str)])) if x) for row, _ in rows]
    placed = _placed(rows)
    # columns in which no cell begins take no room
    begun = sorted({first for cells in placed for first, _, _ in cells})
    grid = [[(bisect_left(begun, a), bisect_left(begun, b), text) for a, b, text in cells] for cells in placed]
    widths = [0] * len(begun)
    wide = []
    for cells in grid:
        for a, b, text in cells:
            if b - a == 1:
                widths[a] = max(widths[a], len(text))
            else:
                wide.append((b - a, a, b, len(text)))
    for n, a, b, length in sorted(wide):
        widths[b - 1] += max(0, length - sum(widths[a:b]) - 2 * (n - 1))
    begins = [0, *accumulate(w + 2 for w in widths)]
    lines = []
    for cells, extra in zip(grid, loose):
        parts: list[str] = []
        at = 0
        for a, _, text in cells:
            parts += [" " * (begins[a] - at), text]
            at = begins[a] + len(text)
        lines.append(("".join(parts) + ("  " * bool(cells) + extra if extra else "")).rstrip())
    out.put([x for x in lines if x])


def _list(node: Element, out: _Lines) -> None:
    step = -1 if node.backwards else 1
    number = node.start
    if number is None:
        number = sum(isinstance(c, Element) and c.name == "li" and not c.hidden for c in node.children) if node.backwards else 1
    for child in node.children:
        if isinstance(child, str):
            out.add(child)
        elif child.name == "li" and not child.hidden:
            out.end_line()
            if child.start is not None:
                number = child.start
            mark = f"{number}. " if node.name == "ol" else "- "
            number += step
            own = [x for x in lines_of(child) if x]
            out.put([(mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(own)])
        else:
            _render(child, out)


def _render(node: Element, out: _Lines) -> None:
    if node.hidden:
        return
    name = node.name
    if name == "br":
        out.end_line()
        return
    if node.apart:
        out.add(" ")
    if name in PARAGRAPHS:
        out.paragraph()
    elif name in BLOCKS:
        out.end_line()
    if name == "table":
        _table(node, out)
    elif name in ("ul", "ol"):
        _list(node, out)
    elif name == "pre":
        out.put("".join(_flat(node)).strip("\n").split("\n"))
    else:
        for child in node.children:
            if isinstance(child, str):
                out.add(child)
            else:
                _render(child, out)
    if name in ("td", "th") or node.apart:
        out.add(" ")
    if name in PARAGRAPHS:
        out.paragraph()
    elif name in BLOCKS:
        out.end_line()


def _flat(node: Element) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.name == "br":
            yield "\n"
        elif not child.hidden:
            yield from _flat(child)


def lines_of(node: Element) -> list[str]:
    out = _Lines()
    for child in node.children:
        if isinstance(child, str):
            out.add(child)
        else:
            _render(child, out)
    return out.done()


#: Nested deeper than this, elements are not opened as levels of their own; their text stays.
MOST_LEVELS = 200


def _flatten(node: Element) -> None:
    """Lifts what is nested too deep for recursion into its ancestor at the last level."""
    todo = [(node, 0)]
    while todo:
        x, depth = todo.pop()
        if depth == MOST_LEVELS:
            flat: list[Element | str] = []
            inner = [*reversed(x.children)]
            while inner:
                c = inner.pop()
                if isinstance(c, str):
                    flat.append(c)
                elif not c.hidden:
                    flat.append(Element("br"))
                    inner.extend(reversed(c.children))
            x.children = flat
        else:
            todo += [(c, depth + 1) for c in x.children if isinstance(c, Element)]


def visible_text(source: str) -> str:
    """All visible text of a page: one line per block, an empty line around paragraphs, headings, lists and
    tables, marks before list items, cells of a table aligned in columns."""
    root = build(source)
    _flatten(root)
    return "\n".join(lines_of(root)).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, visible ``text``, ``n_chars`` and ``n_lines`` of every page.

    One pass without shuffle. A null or empty page has an empty text; null ids and addresses are kept; repeated
    rows stay repeated; further columns are left out. Broken markup is read as browsers do as far as tags imply
    each other; a page is never dropped.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            found = [visible_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string").select(
        "page_id",
        "url",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
    )
