"""Layout-aware text of HTML pages.

A single pass cuts a page into tags and text; a tree builder with implied tags (paragraphs, list items, table parts, options)
opens and closes elements; visibility rules skip what a browser doesn't show; the layout then writes all visible text:
blocks on lines of their own, a blank line around paragraphs and headings, list items with their marks and indent, table
rows with aligned cells, preformatted text as it is.

Elements are closed as the text goes by, so memory follows the open elements and the text of the tables among them. Work is linear
in the page: where a tag ends is worked out once for each quote, open elements are found by their names, and tables are aligned up
to a width. One scan, no shuffle; pages are read whole.

SVG and MathML follow the rules of foreign content: an element with a trailing slash is closed at once, an HTML tag that can't be
there ends it. Of SVG the `text` elements, each on a line of its own, and the HTML of `foreignObject` are shown; of MathML all text
but annotations, phantoms and later alternatives. Text that only a `use` element would draw is not followed.

Defined cases: a null or empty page has an empty text. Text after an unclosed script or style is hidden, as in a browser, and
so is a dialog that isn't open; what a click on the page itself unfolds (closed details, the options of a select) counts as visible. A quote
without an end is an ordinary character, and a tag without an end is text. Cells stand in the columns that their `colspan` and
`rowspan` and those of cells before them leave; they are padded to their column's width up to `WIDEST`; tables of more than `COLUMNS`
columns are written without alignment, a table within a cell on one line. Lists deeper than `DEEPEST` aren't indented further. A
null id is carried through, equal rows give equal rows, other columns are not read.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_slice

#: Columns are aligned up to this width; a longer cell sticks out.
WIDEST = 40
COLUMNS = 64
DEEPEST = 32

_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

# Kinds of elements as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noframes noembed rp".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure fieldset hr".split())
LINES = frozenset("html body div section article aside nav header footer main address form li dt dd tr caption legend details summary figcaption option optgroup center search hgroup dialog".split())
LISTS = frozenset(("ul", "ol", "menu"))
CELLS = frozenset(("td", "th"))
#: An element's start closes these, if one is open within the nearest boundary.
CLOSES = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))),
    "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))), "tr": (("tr",), frozenset(("table",))),
    "thead": (("thead", "tbody", "tfoot", "caption"), frozenset(("table",))), "tbody": (("thead", "tbody", "tfoot", "caption"), frozenset(("table",))), "tfoot": (("thead", "tbody", "tfoot", "caption"), frozenset(("table",))),
    "option": (("option",), frozenset(("select",))), "optgroup": (("option", "optgroup"), frozenset(("select",))), "rt": (("rt", "rp"), frozenset(("ruby",))), "rp": (("rt", "rp"), frozenset(("ruby",))), "body": (("head",), frozenset(("html",))),
}
#: By the language of foreign content: elements that aren't shown, and those that hold HTML again.
UNSHOWN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter style script".split()),
    "math": frozenset("annotation annotation-xml mphantom style script".split()),
}
HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
#: HTML elements whose start ends foreign content.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_SCOPE = frozenset(("td", "th", "table", "caption", "button", "annotation-xml")).union(*HOLDS_HTML.values())
_NEVER_IN_HEAD = (PARAGRAPHS | LINES) - {"html"}


class _Frame:
    """Lines under way: of the page, or of one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.space = False
        self.mark = ""  # of the list item whose text is still to come
        self.indent = 0

    def text(self, text: str) -> None:
        part = _BLANK.sub(" ", text)
        if part[0] == " ":
            self.space = True
            part = part[1:]
        if part:
            if self.space and self.parts:
                self.parts.append(" ")
            self.space = part[-1] == " "
            self.parts.append(part[:-1] if self.space else part)

    def raw(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.flush(keep=True)
            self.parts.append(line)

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.parts)
        self.parts, self.space = [], False
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append("  " * min(self.indent, DEEPEST) + self.mark + line)
            if self.mark:
                self.mark = ""

    def block(self, apart: bool) -> None:
        self.flush()
        self.gap = self.gap or apart


class _Element:
    __slots__ = ("tag", "hidden", "number", "rows", "frame", "pre", "indent", "mark", "own", "inner", "mute", "line", "span")

    def __init__(self, tag: str, hidden: bool, pre: bool):
        self.tag, self.hidden, self.pre = tag, hidden, pre
        self.number = 0
        self.rows: list[list[tuple[str, int, int]]] | None = None  # of a table: text, columns and rows of each cell
        self.span = (1, 1)
        self.frame: _Frame | None = None
        self.indent = 0
        self.mark = ""
        self.own = self.inner = ""  # svg or math, where the element itself and what is in it are foreign
        self.mute = self.line = False  # within svg but not within its text; on lines of its own


class Layout:
    """Builds the tree of one page and writes its text."""

    def __init__(self) -> None:
        self.page = _Frame()
        self.frames = [self.page]
        self.open: list[_Element] = []
        self.count: dict[str, int] = {}
        self.places: dict[str, list[int]] = {}  # of the open elements of a name, outermost first

    def _top(self) -> tuple[bool, bool]:
        return (self.open[-1].hidden, self.open[-1].pre) if self.open else (False, False)

    def _close_upto(self, k: int) -> None:
        while len(self.open) > k:
            self._close(self.open.pop())

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _nearest(self, tags, within) -> int:
        """Place of the innermost open element of these names, if none of `within` is open inside it; else -1."""
        k = self._last(tags)
        return k if k >= 0 and k >= self._last(within) else -1

    def _push(self, e: _Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.open))
        self.open.append(e)
        self.count[e.tag] = self.count.get(e.tag, 0) + 1

    def start(self, tag: str, attributes: str) -> None:
        inner = self.open[-1].inner if self.open else ""
        if inner and (tag in BREAKS_OUT or tag == "font" and any(m[1].lower() in ("color", "face", "size") for m in _ATTRIBUTE.finditer(attributes))):
            k = len(self.open)
            while k and self.open[k - 1].inner:
                k -= 1
            self._close_upto(k)
        elif inner or tag == "svg" or tag == "math":
            return self._foreign(tag, attributes, inner or tag)
        rule = CLOSES.get(tag)
        if rule and any(self.count.get(t) for t in rule[0]):
            k = self._nearest(*rule)
            if k >= 0:
                self._close_upto(k)
        if tag in _NEVER_IN_HEAD:
            if self.count.get("head") and (k := self._nearest(("head",), ())) >= 0:
                self._close_upto(k)
            if self.count.get("p") and (k := self._nearest(("p",), _SCOPE)) >= 0:
                self._close_upto(k)
        if tag in CELLS and self.count.get("table") and self._nearest(("tr",), ("table",)) < 0:
            self.start("tr", "")
        hidden, pre = self._top()
        frame = self.frames[-1]
        if not hidden:
            if tag == "br":
                frame.flush(keep=True)
            elif tag in PARAGRAPHS:
                frame.block(not (tag in LISTS and self._in_list()))
            elif tag in LINES:
                frame.block(False)
        if tag in VOID:
            if tag == "hr" and not hidden:
                frame.gap = True
            return None
        if not hidden:
            hidden = tag in HIDDEN or bool(attributes) and self._unseen(attributes) or tag == "dialog" and not any(m[1].lower() == "open" for m in _ATTRIBUTE.finditer(attributes))
        e = _Element(tag, hidden, pre or tag in ("pre", "textarea"))
        e.mute = bool(self.open) and self.open[-1].mute
        self._push(e)
        if hidden:
            return None
        e.indent = frame.indent
        if tag == "table":
            e.rows = []
        elif tag == "tr" and (table := self._table()):
            table.rows.append([])
        elif tag in CELLS and (table := self._table()):
            if not table.rows:
                table.rows.append([])
            e.frame = _Frame()
            e.span = (max(1, self._number(attributes, "colspan", 1)), self._number(attributes, "rowspan", 1))
            self.frames.append(e.frame)
        elif tag in LISTS:
            e.number = self._number(attributes, "start", 1) - 1 if tag == "ol" else 0
            if self._depth() > 1:
                frame.indent += 1
        elif tag == "li":
            k = self._nearest(LISTS, ())
            parent = self.open[k] if k >= 0 else None
            if parent is not None and parent.tag == "ol":
                parent.number = self._number(attributes, "value", parent.number + 1)
                frame.mark = f"{parent.number}. "
            else:
                frame.mark = "- "
        elif tag == "dd" or tag == "blockquote":
            frame.indent += 1
        return None

    def _foreign(self, tag: str, attributes: str, own: str) -> None:
        if self.open and self.open[-1].tag == "head":
            self._close_upto(len(self.open) - 1)
        hidden, pre = self._top()
        parent = self.open[-1] if self.open else None
        e = _Element(tag, hidden or tag in UNSHOWN[own] or self._unseen(attributes, foreign=True), pre)
        e.own = e.inner = own
        e.mute = tag == "svg" or parent is not None and parent.mute
        if parent is not None and parent.own == "math" and parent.tag in ("semantics", "maction"):
            parent.number += 1
            e.hidden = e.hidden or parent.number > 1
        if tag in HOLDS_HTML[own] or tag == "annotation-xml" and re.search(r"text/html|application/xhtml\+xml", attributes, re.I):
            e.inner = ""
        if own == "svg" and tag in ("text", "foreignobject"):
            e.mute, e.line = False, True
        elif tag == "math":
            e.line = any(m[1].lower() == "display" and (m[2] or "").strip("\"'").lower() == "block" for m in _ATTRIBUTE.finditer(attributes))
        if e.line and not e.hidden:
            self.frames[-1].block(False)
        self._push(e)
        if self._ends_itself(attributes):
            self._close_upto(len(self.open) - 1)

    @staticmethod
    def _ends_itself(attributes: str) -> bool:
        """Whether a tag ends in a slash that is no part of an unquoted value."""
        if not attributes.endswith("/"):
            return False
        rest = attributes[:-1]
        at = 1 + max(map(rest.rfind, " \t\n\r\f\"'"))
        return "=" not in rest[at:] and not rest[:at].rstrip().endswith("=")

    def _depth(self) -> int:
        return sum(self.count.get(t, 0) for t in LISTS)

    def _in_list(self) -> bool:
        return self._depth() > 0

    def _table(self) -> _Element | None:
        k = self._nearest(("table",), ())
        return self.open[k] if k >= 0 and self.open[k].rows is not None else None

    @staticmethod
    def _unseen(attributes: str, foreign: bool = False) -> bool:
        for m in _ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            if name == "hidden" or name == "style" and m[2] and _UNSEEN.search(m[2]):
                return True
            if foreign and name in ("display", "visibility") and m[2] and _UNSEEN.match(f"{name}:" + m[2].strip("\"'")):
                return True
        return False

    @staticmethod
    def _number(attributes: str, name: str, otherwise: int) -> int:
        for m in _ATTRIBUTE.finditer(attributes or ""):
            if m[1].lower() == name and m[2] and re.fullmatch(r"-?[0-9]{1,9}", m[2].strip("\"'")):
                return int(m[2].strip("\"'"))
        return otherwise

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        if not self.count.get(tag):
            if tag == "p":
                self.start("p", "")
                self._close_upto(len(self.open) - 1)
            return None
        k = self._nearest((tag,), () if tag in _SCOPE or tag in ("body", "html", "tr", "thead", "tbody", "tfoot") else ("td", "th"))
        if k >= 0:
            self._close_upto(k)
        return None

    def _close(self, e: _Element) -> None:
        self.count[e.tag] -= 1
        self.places[e.tag].pop()
        if e.hidden:
            return
        if e.own:
            if e.line:
                self.frames[-1].block(False)
            return
        if e.frame is not None:
            e.frame.flush()
            self.frames.remove(e.frame) if self.frames[-1] is not e.frame else self.frames.pop()
            table = self._table()
            cell = " ".join(filter(None, map(str.strip, e.frame.lines)))
            if table is not None:
                table.rows[-1].append((cell, *e.span))
            return
        frame = self.frames[-1]
        if e.tag in PARAGRAPHS:
            frame.block(not (e.tag in LISTS and self._in_list()))
        elif e.tag in LINES:
            frame.block(False)
        if e.tag == "table":
            self._rows(frame, e.rows or [])
        if e.tag == "li" and frame.mark:
            frame.mark = ""
        frame.indent = e.indent

    def _rows(self, frame: _Frame, rows: list[list[tuple[str, int, int]]]) -> None:
        if not any(text for row in rows for text, _, _ in row):
            return
        if len(self.frames) > 1:  # within a cell
            frame.text(" " + " ".join(text for row in rows for text, _, _ in row if text) + " ")
            return
        frame.gap = True
        for line in aligned(rows):
            frame.parts.append(line)
            frame.flush()
        frame.gap = True

    def text(self, text: str, literal: bool = False) -> None:
        hidden, pre = self._top()
        if hidden or not text or self.open and self.open[-1].mute:
            return
        if "&" in text and not literal:
            text = html.unescape(text)
        frame = self.frames[-1]
        if pre:
            frame.raw(text)
        elif text:
            frame.text(text)

    def finish(self) -> str:
        self._close_upto(0)
        self.page.flush()
        out = "\n".join(line.rstrip() for line in self.page.lines)
        return re.sub(r"\n{3,}", "\n\n", out).strip("\n")


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]] | None:
    """First column, column behind and text of each cell; nothing if there are more than COLUMNS columns."""
    out, taken = [], {}  # by column: rows, this one included, that a cell from above still covers
    for row in rows:
        cells, at = [], 0
        for text, columns, height in row:
            while taken.get(at, 0) > 0:
                at += 1
            if at + columns > COLUMNS:
                return None
            cells.append((at, at + columns, text))
            for c in range(at, at + columns):
                taken[c] = max(taken.get(c, 0), height if height > 0 else 1 << 20)
            at += columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        out.append(cells)
    return out


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """The lines of a table: cells side by side under those of their column, empty rows left out."""
    placed = _placed(rows)
    if placed is None:
        return [" | ".join(text for text, _, _ in row).rstrip() for row in rows if any(text for text, _, _ in row)]
    used = sorted({first for row in placed for first, _, _ in row})  # columns where no cell begins take no room
    index = {c: k for k, c in enumerate(used)}
    widths = [0] * len(used)
    lines = []
    for row in placed:
        for k, (first, behind, text) in enumerate(row):
            last = bisect.bisect_left(used, behind)
            row[k] = (index[first], last, text)
            if last - index[first] == 1:
                widths[index[first]] = max(widths[index[first]], min(len(text), WIDEST))
    for row in placed:
        if any(text for _, _, text in row):
            fields, at = [], 0
            for first, behind, text in row:
                fields += [" " * w for w in widths[at:first]]
                fields.append(text.ljust(sum(widths[first:behind]) + 3 * (behind - first - 1)))
                at = behind
            lines.append(" | ".join(fields).rstrip())
    return lines


class _Next:
    """Where a character of a class comes next; a position between the last question and its answer costs nothing."""

    def __init__(self, pattern: str, page: str):
        self.search, self.page, self.low, self.high = re.compile(pattern).search, page, 0, -1

    def __call__(self, at: int) -> int:
        if not self.low <= at <= self.high:
            m = self.search(self.page, at)
            self.low, self.high = at, m.start() if m else len(self.page)
        return self.high


class _Tags:
    """Where tags end: at the first > outside quotes. What follows a quote is worked out once."""

    def __init__(self, page: str):
        self.page, self.special, self.name = page, _Next("[>\"']", page), _Next(r"[\s/>]", page)
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.known: dict[int, int] = {}

    def end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at `at`, or -1."""
        path, page = [], self.page
        while True:
            k = self.special(at)
            if k in self.known:
                found = self.known[k]
                break
            if k == len(page) or page[k] == ">":
                found = k if k < len(page) else -1
                break
            path.append(k)
            at = page.find(page[k], k + 1) + 1 if k < self.last[page[k]] else k + 1
        self.known.update(dict.fromkeys(path, found))
        return found


_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_TAG = re.compile("<(/?)[a-zA-Z]")


def render(page: str | None) -> str:
    """All visible text of a page."""
    page = page or ""
    layout, tags, at, size = Layout(), _Tags(page), 0, len(page)

    def find(what: str, begin: int) -> int:
        k = page.find(what, begin)
        return size if k < 0 else k

    while at < size:
        if page[at] != "<":
            stop = find("<", at)
            layout.text(page[at:stop])
            at = stop
            continue
        if page.startswith("<![CDATA[", at) and layout.open and layout.open[-1].own:
            stop = find("]]>", at + 9)
            layout.text(page[at + 9 : stop], literal=True)
            at = stop + 3
            continue
        if page.startswith("<!--", at):
            at = find("-->", at + 4) + 3
            continue
        if page.startswith(("<!", "<?"), at):
            at = find(">", at + 2) + 1
            continue
        m = _TAG.match(page, at)
        behind = tags.name(m.end()) if m else 0
        stop = tags.end(behind) if m else -1
        if stop < 0:
            layout.text("<")
            at += 1
            continue
        tag, at = page[m.end() - 1 : behind].lower(), stop + 1
        if m[1]:
            layout.end(tag)
            continue
        layout.start(tag, page[behind:stop])
        if tag in RAW and not layout.open[-1].own:
            close = _RAW_END[tag].search(page, at)
            stop = close.start() if close else size
            if tag == "textarea":
                layout.text(page[at:stop])
            at = stop
    return layout.finish()


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, n_chars and text of each page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(p) for p in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(texts, pa.string())], ["page_id", "n_chars", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("h"))
    return per_slice(rows, "h", work, "page_id long, n_chars long, text string")
