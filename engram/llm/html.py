"""Layout-aware text of HTML pages.

A tokenizer of one pattern feeds a tree builder that knows void elements, implied end tags (paragraphs, list and
definition items, options, table parts), raw-text elements and stray end tags. The renderer walks the tree by the
rules of visibility (head, scripts, styles, templates, ``hidden``, ``display:none``, ``visibility:hidden``, closed details) and emits
all visible text: blocks on lines of their own, a blank line around those with margins, list items with
marks and indents, preformatted text as it is, and tables with their cells in aligned columns.

Every page is read whole, in time linear in its length (but for elements nested over ``DEPTH`` deep, which count as
siblings at that depth, as in browsers). Cells are padded to ``PAD`` characters at most; longer ones are whole and shift what follows.

Defined results: a null page has a null text; an empty one, or one without visible text, an empty text; broken
markup is read as browsers would, an unclosed comment or quote runs to the end; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, spread_out, table

DEPTH, PAD, MAX_SPAN = 200, 40, 1000
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)>?""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
# Element names of the HTML standard, by how they are read and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
UNSEEN = frozenset("head title script style template iframe noembed noframes datalist object audio video canvas meta link param source track".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr fieldset".split())
BLOCK = MARGIN | frozenset(
    "html body div section article aside nav header footer main address hgroup details summary dialog li dt dd form legend "
    "center figcaption search caption tr td th thead tbody tfoot optgroup option".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre search section table ul li dt dd".split()
)
#: A start tag ends these open elements, looking outwards up to the given bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
WALLS = frozenset("table td th caption button object template".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title head html".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(raw: str) -> dict:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    root = Node("#root", {})
    stack = [root]

    def end_until(i: int):
        del stack[i:]

    def implied(tag: str):
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    end_until(i)
                    break
                if stack[i].tag in WALLS:
                    break
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            found = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    found = i
                elif stack[i].tag in WALLS and tag in ("li", "dt", "dd"):
                    break
            if found is not None:
                end_until(found)

    at, size = 0, len(page)
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            _add_text(stack, page[at : m.start()])
        at = m.end()
        if m[2]:
            tag, raw = m[2].lower(), m[3]
            if stack[-1].tag == "head" and tag not in HEAD_ONLY:
                stack.pop()
            implied(tag)
            node = Node(tag, attributes(raw) if raw and not raw.isspace() else {})
            stack[-1].kids.append(node)
            if tag in VOID:
                continue
            if tag in RAW or tag in RCDATA:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                text = page[at : close.start() if close else size]
                at = close.end() if close else size
                if text:
                    node.kids.append(unescape(text) if tag in RCDATA else text)
                continue
            if tag == "plaintext":
                node.kids.append(page[at:])
                return root
            if len(stack) < DEPTH and not (raw.endswith("/") and tag in ("svg", "path", "circle", "rect", "line", "use", "g")):
                stack.append(node)
        elif m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    end_until(i)
                    break
                if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html"):
                    break  # an end tag inside a cell ends nothing outside of it
        if at >= size:
            break
    if at < size:
        _add_text(stack, page[at:])
    return root


def _add_text(stack: list[Node], text: str):
    if stack[-1].tag == "head" and not text.isspace():
        stack.pop()
    stack[-1].kids.append(unescape(text) if "&" in text else text)


def hidden(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or not a:
        return node.tag in UNSEEN or node.tag == "dialog"
    style = a.get("style", "").lower().replace(" ", "")
    return "hidden" in a or "display:none" in style or (node.tag == "dialog" and "open" not in a)


def shown(node: Node, seen: bool) -> bool:
    """Inherited visibility, which a descendant can turn on again."""
    if not node.attrs or "style" not in node.attrs:
        return seen
    style = node.attrs["style"].lower().replace(" ", "")
    if "visibility:hidden" in style or "visibility:collapse" in style:
        return False
    return True if "visibility:visible" in style else seen


class Lines:
    """Output lines; text collapses white space, breaks come before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the open line
        self.space = False
        self.gap = False  # a blank line goes before the next text

    def text(self, s: str):
        words = _SPACE.sub(" ", s)
        if words == " " or not words:
            self.space |= bool(words) and bool(self.parts)
            return
        if not self.parts:
            words = words.lstrip(" ")
        elif self.space and words[0] != " ":
            self.parts.append(" ")
        self.space = words[-1] == " "
        self._open()
        self.parts.append(words.rstrip(" "))
        if words[0] == " " and len(self.parts) > 1 and self.parts[-2][-1:] == " ":
            self.parts[-1] = self.parts[-1].lstrip(" ")

    def _open(self):
        if self.gap and self.lines and not self.parts:
            self.lines.append("")
        if not self.parts:
            self.gap = False

    def end(self):
        if self.parts:
            self.lines.append("".join(self.parts))
            self.parts = []
        self.space = False

    def margin(self):
        self.end()
        self.gap = bool(self.lines)

    def forced(self):
        if self.parts:
            self.end()
        elif self.lines:
            self.gap = True

    def whole(self, lines: list[str]):
        """Lines as they are."""
        self.end()
        if lines:
            self._open()
            self.lines.extend(lines)


def render(node: Node, seen: bool = True) -> list[str]:
    out = Lines()
    _render_kids(node, out, seen)
    out.end()
    return out.lines


def _render_kids(node: Node, out: Lines, seen: bool):
    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                out.text(kid)
        elif not hidden(kid):
            _render(kid, out, shown(kid, seen))


def _render(node: Node, out: Lines, seen: bool):
    tag = node.tag
    if tag == "br":
        out.forced()
    elif tag == "pre" or tag == "textarea" or tag == "xmp":
        out.margin()
        if lines := _preformatted(node, seen):
            out.whole(lines)
        out.margin()
    elif tag == "table":
        out.margin()
        out.whole(_table(node, seen))
        out.margin()
    elif tag in ("ul", "ol", "menu", "dl"):
        out.margin()
        out.whole(_list(node, seen))
        out.margin()
    elif tag == "blockquote":
        out.margin()
        out.whole(["> " + x if x else ">" for x in render(node, seen)])
        out.margin()
    elif tag == "details" and "open" not in node.attrs:
        out.end()
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag == "summary" and not hidden(kid):
                _render(kid, out, shown(kid, seen))
                break
        out.end()
    elif tag == "select":
        _select(node, out, seen)
    elif tag == "q":
        if seen:
            out.text('"')
        _render_kids(node, out, seen)
        if seen:
            out.text('"')
    elif tag in ("li", "dt", "dd"):  # outside of a list
        out.end()
        out.whole(_item(node, "- " if tag == "li" else "", seen))
        out.end()
    elif tag in BLOCK:
        margin = tag in MARGIN
        out.margin() if margin else out.end()
        _render_kids(node, out, seen)
        out.margin() if margin else out.end()
    else:
        _render_kids(node, out, seen)


def _preformatted(node: Node, seen: bool) -> list[str]:
    parts: list[str] = []

    def walk(n: Node, seen: bool):
        for kid in n.kids:
            if isinstance(kid, str):
                if seen:
                    parts.append(kid)
            elif kid.tag == "br":
                parts.append("\n")
            elif not hidden(kid):
                walk(kid, shown(kid, seen))

    walk(node, seen)
    text = "".join(parts).replace("\r\n", "\n").replace("\r", "\n")
    text = text[1:] if text.startswith("\n") else text
    lines = [x.rstrip(" \t") for x in text.split("\n")]
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _select(node: Node, out: Lines, seen: bool):
    """The chosen options, else the first; all of a multiple choice."""
    options, todo = [], [(k, seen) for k in reversed(node.kids) if isinstance(k, Node)]
    while todo:
        k, s = todo.pop()
        if not hidden(k):
            s = shown(k, s)
            if k.tag == "option":
                options.append((k, s))
            else:
                todo.extend((x, s) for x in reversed(k.kids) if isinstance(x, Node))
    if "multiple" not in node.attrs:
        options = [o for o in options if "selected" in o[0].attrs][-1:] or options[:1]
    for o, s in options:
        _render_kids(o, out, s)
        out.space = True


def _item(node: Node, mark: str, seen: bool) -> list[str]:
    lines = render(node, seen)
    pad = " " * len(mark)
    return [(mark if i == 0 else pad) + x if x or i == 0 else "" for i, x in enumerate(lines)]


def _list(node: Node, seen: bool) -> list[str]:
    lines: list[str] = []
    n = _int(node.attrs.get("start"), 1)
    loose = Lines()

    def flush():
        loose.end()
        lines.extend(loose.lines)
        loose.lines = []

    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                loose.text(kid)
            continue
        if hidden(kid):
            continue
        s = shown(kid, seen)
        flush()
        if kid.tag == "li":
            mark = "- "
            if node.tag == "ol":
                n = _int(kid.attrs.get("value"), n)
                mark, n = f"{n}. ", n + 1
            lines += _item(kid, mark, s)
        elif kid.tag == "dd":
            lines += _item(kid, "  ", s)
        elif kid.tag in ("ul", "ol", "menu", "dl"):
            lines += ["  " + x if x else x for x in _list(kid, s)]
        else:
            _render(kid, loose, s)
            flush()
    flush()
    return lines


def _int(s: str | None, default: int) -> int:
    try:
        return int(s) if s is not None else default
    except ValueError:
        return default


def _rows(node: Node, seen: bool, captions: list, rows: list, loose: Lines):
    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                loose.text(kid)
        elif not hidden(kid):
            s = shown(kid, seen)
            if kid.tag == "tr":
                rows.append((kid, s))
            elif kid.tag in ("thead", "tbody", "tfoot"):
                _rows(kid, s, captions, rows, loose)
            elif kid.tag in ("td", "th"):
                row = Node("tr", {})
                row.kids.append(kid)
                rows.append((row, s))
            elif kid.tag == "caption":
                captions += render(kid, s)
            elif kid.tag not in ("col", "colgroup"):
                _render(kid, loose, s)


def _table(node: Node, seen: bool) -> list[str]:
    lines: list[str] = []
    rows: list = []
    loose = Lines()
    _rows(node, seen, lines, rows, loose)
    loose.end()
    grid: list[list[tuple[int, list[str], int]]] = []  # (first column, lines, columns)
    busy: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row, s in rows:
        cells, col, covers = [], 0, {}
        for kid in row.kids:
            if isinstance(kid, str):
                if s:
                    loose.text(kid)
                continue
            if hidden(kid):
                continue
            while busy.get(col, 0):
                col += 1
            span = max(1, min(MAX_SPAN, _int(kid.attrs.get("colspan"), 1)))
            down = max(1, min(65534, _int(kid.attrs.get("rowspan"), 1)))
            cells.append((col, render(kid, shown(kid, s)) if kid.tag in ("td", "th") else _lone(kid, shown(kid, s)), span))
            if down > 1:
                covers.update({c: down for c in range(col, col + span)})
            col += span
        busy = {c: n - 1 for c, n in busy.items() if n > 1} | {c: n - 1 for c, n in covers.items()}
        grid.append(cells)
    loose.end()
    width: dict[int, int] = {}
    for cells in grid:
        for col, text, span in cells:
            if span == 1:
                width[col] = max(width.get(col, 0), min(PAD, max(map(len, text), default=0)))
    start, at = {}, 0
    for c in range(max((col + span for cells in grid for col, _, span in cells), default=0)):
        start[c] = at
        if width.get(c):
            at += width[c] + 2
    for cells in grid:
        for i in range(max((len(text) for _, text, _ in cells), default=0)):
            line = ""
            for col, text, _ in cells:
                if i < len(text) and text[i]:
                    line = line.ljust(start[col]) if len(line) <= start[col] or not line else line + "  "
                    line += text[i]
            lines.append(line.rstrip(" "))
    return loose.lines + lines


def _lone(node: Node, seen: bool) -> list[str]:
    out = Lines()
    _render(node, out, seen)
    out.end()
    return out.lines


def html_text(page: str | None) -> str | None:
    return None if page is None else "\n".join(render(parse(page)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text."""
    bound_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(html_text, b.column(1).to_pylist()), pa.string(), size=b.num_rows)], ["page_id", "text"])

    return spread_out(pages.select("page_id", "html")).mapInArrow(run, f"page_id {kind}, text string")


def op6_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
