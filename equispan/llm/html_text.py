"""Layout-aware text of web pages.

One forward scan, in which each `<` is decided once, feeds a tree builder that supplies what markup leaves out: a paragraph ends before a block, an item before the next item, a cell before the next cell or row, raw ends and unclosed tags at the page's end.
The renderer walks the tree and writes all visible text: blocks on lines of their own, paragraphs, headings, lists and
tables set off by an empty line, items behind `- ` or their number, table cells aligned by column.

Not visible: head, which ends before text and tags that it can't hold, script, style, template, noscript and other carriers;
what svg and math don't draw (title, desc, metadata, defs, symbol, annotations); elements with `hidden`, with `display:none` or
`visibility:hidden` in their style or, for simple selectors (tag, .class, #id), in the page's style sheet, outside of at-rules
or for `screen` or `all` media; closed `details` but for their summary; comments, of which an unfinished one ends with the page.  A visible element inside a `visibility:hidden` one shows again.

Null and empty pages give an empty text.  Elements nested deeper than 200 are set beside each other, and a cell longer
than 60 signs does not widen its column; text is never dropped.  A quote that is never closed is a part of its value, and a tag
that is never closed is text up to the page's end.  The time follows the page's length, however broken it is.  Repeated rows are rendered each on its own; extra columns
pass through, one named `extracted` is replaced.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEPTH, WIDEST = 200, 60
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
UNSEEN = set("head script style template noscript iframe object audio video canvas datalist title meta link".split())
#: What an svg or math element holds beside its labels.
UNDRAWN = {"svg": set("title desc metadata defs symbol style script".split()), "math": {"annotation", "annotation-xml"}}
#: What a head may hold; any other tag and text that is not blank end it.
HEAD = set("base basefont bgsound link meta title style script noscript template noframes html head".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
             "table ul".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir fieldset".split())
#: An opening tag ends the open elements on the right, up to the nearest of the borders.
_CELLS, _ROWS = {"td", "th", "caption"}, {"thead", "tbody", "tfoot"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": (_CELLS, {"table"}), "th": (_CELLS, {"table"}), "tr": (_CELLS | {"tr"}, {"table"}),
        **{t: (_CELLS | {"tr"} | _ROWS, {"table"}) for t in _ROWS}, "option": ({"option"}, {"select"}),
        "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set())}
#: Elements whose content is text up to their end tag; in those of ESCAPED references count.
RAW, ESCAPED = {"script", "style", "xmp", "iframe", "noembed", "noframes"}, {"title", "textarea"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW | ESCAPED}
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_GAP = re.compile(r"[\s/]*+")
#: A name and perhaps its value; what follows `=` may be a quote that is never closed.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_COMMENT_END = re.compile("--!?>")
#: Numbers beyond all code points, and many zeros before a number: only short ones can be converted.
_HUGE = re.compile("&#(?:0*+[0-9]{8,}+;?|0{9,}+)")
_BORDERS = {"table", "td", "th", "caption", "button", "object", "html", "body"}


class Node:
    __slots__ = ("tag", "attrs", "children", "drawings")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, drawings: frozenset[str] = frozenset()):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.drawings = drawings | {tag} if tag in UNDRAWN else drawings  # svg or math, if it is or stands in such


class Builder:
    """Builds the tree; `sheet` collects the text of style elements."""

    def __init__(self):
        self.root = Node("#page")
        self.open = [self.root]
        self.sheet: list[str] = []

    def _end(self, tags: set[str], borders: set[str]) -> None:
        """Close the outermost open element of these tags on this side of the nearest border."""
        at = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in borders:
                break
            if self.open[k].tag in tags:
                at = k
        if at is not None:
            del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCKS:
            self._end({"p"}, _BORDERS)
            if tag not in ("html", "head") and any(n.tag == "head" for n in self.open):
                self._end({"head"}, set())
        elif tag not in HEAD and self.open[-1].tag == "head":
            del self.open[-1]
        around = self.open[-1].drawings
        node = Node(tag, {k: v or "" for k, v in attrs}, around)
        if any(tag in UNDRAWN[x] for x in around):
            node.attrs["hidden"] = ""
        elif tag == "text" and "svg" in around:
            node.attrs["#label"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        # A slash closes void elements and those of svg and math only; browsers take `<div/>` as `<div>`.
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and not self.open[-1].children and self.open[-1].drawings:
            del self.open[-1]

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p"))
        elif tag not in ("html", "body"):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    break
                if self.open[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                    break

    def handle_data(self, data):
        if self.open[-1].tag == "style":
            self.sheet.append(data)
        elif self.open[-1].tag == "head" and data.strip():
            del self.open[-1]
        self.open[-1].children.append(data)


def _text(data: str) -> str:
    """Text with its character references replaced."""
    if "&#" in data:
        data = _HUGE.sub(lambda m: "\ufffd" if m[0].strip("&#0") else "&#0", data)
    return unescape(data) if "&" in data else data


def scan(page: str, builder: Builder) -> None:
    """Hand a page's tags and texts to a builder."""
    text: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        data = _text("".join(text))
        text.clear()
        if data:
            builder.handle_data(data)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        text.append(page[at:start])
        if page.startswith("<!--", start):
            # `<!-->` and `<!--->` are whole comments.
            empty = next((x for x in ("<!-->", "<!--->") if page.startswith(x, start)), "")
            end = _COMMENT_END.search(page, start + 4) if not empty else None
            at = start + len(empty) if empty else end.end() if end else n
            continue
        name = _NAME.match(page, start + 1) or page.startswith("/", start + 1) and _NAME.match(page, start + 2)
        if name and page[start + 1] != "/":
            attrs, at = {}, name.end()
            while (at := _GAP.match(page, at).end()) < n and page[at] != ">":
                found = _ATTRIBUTE.match(page, at)
                at = found.end()
                attrs.setdefault(found[1].lower(), _text(found[2] or found[3] or found[4] or ""))
            if at == n:
                text.append(page[start:])
                break
            flush()
            tag, closed, at = name[0].lower(), page[at - 1] == "/", at + 1
            (builder.handle_startendtag if closed else builder.handle_starttag)(tag, list(attrs.items()))
            node = builder.open[-1] if builder.open[-1].tag == tag else builder.open[-1].children[-1]
            if tag in RAW and not (closed and node.drawings) or tag in ESCAPED and not node.drawings:
                end = _RAW_END[tag].search(page, at)
                stop = end.start() if end else n
                body = _text(page[at:stop]) if tag in ESCAPED else page[at:stop]
                if node is builder.open[-1]:
                    builder.handle_data(body)
                else:  # too deep to be opened
                    node.children.append(body)
                at = stop
        elif name or page.startswith(("<!", "<?", "</"), start):
            end = page.find(">", start)
            if end < 0:
                text.append(page[start:])
                break
            at = end + 1
            if name:
                flush()
                builder.handle_endtag(name[0].lower())
        else:
            text.append("<")
            at = start + 1
    flush()


def hidden_selectors(sheet: str) -> tuple[set[str], set[str]]:
    """Simple selectors under which a style sheet sets display:none, and visibility:hidden."""
    none, unseen = set(), set()
    plain, *commented = sheet.split("/*")
    sheet = plain + "".join(part.partition("*/")[2] for part in commented)
    open_: list[tuple[bool, set[str]]] = []  # whether the rules inside count, and the selectors
    parts = re.split("([{};])", sheet)
    for words, sign in zip(parts[::2], [*parts[1::2], "}"], strict=True):
        words, live = words.strip(), not open_ or open_[-1][0]
        if sign == "{":
            if words.startswith("@"):
                media = words.lower().removeprefix("@media").split(",") if words.lower().startswith("@media") else []
                open_.append((live and any(x.split() in (["screen"], ["all"], ["only", "screen"]) for x in media), set()))
            else:
                open_.append((live, {x.strip() for x in words.split(",") if re.fullmatch(r"[.#]?[\w-]+", x.strip())}))
            continue
        rule = re.sub(r"\s", "", words.lower())
        if open_ and live and rule.startswith(("display:none", "visibility:hidden")):
            (none if rule.startswith("display") else unseen).update(open_[-1][1])
        if sign == "}" and open_:
            open_.pop()
    return none, unseen


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text, with pending spaces, line ends and empty lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def text(self, data: str) -> None:
        parts = data.split()
        if not parts:
            self.space = self.space or bool(data)
            return
        if (self.space or data[0].isspace()) and self.now:
            self.now.append(" ")
        self.now.append(" ".join(parts))
        self.space = data[-1].isspace()

    def exact(self, data: str) -> None:
        first, *rest = data.split("\n")
        self.now.append(first)
        for line in rest:
            self.add("".join(self.now).rstrip())
            self.now = [line]

    def add(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def end(self) -> None:
        line = "".join(self.now).rstrip()
        if line:
            self.add(line)
        self.now, self.space = [], False

    def spaced(self) -> None:
        self.end()
        self.gap = True

    def put(self, lines: list[str], first: str = "", rest: str = "") -> None:
        for k, line in enumerate(lines):
            self.add(((rest if k else first) + line).rstrip())


class Renderer:
    def __init__(self, sheet: str):
        self.none, self.unseen = hidden_selectors(sheet)

    def shown(self, node: Node, visible: bool) -> bool | None:
        """Whether an element's own text shows; None if nothing inside it can."""
        a = node.attrs
        if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type") == "hidden":
            return None
        style = re.sub(r"\s", "", a.get("style", "").lower())
        names = {node.tag, "#" + a.get("id", ""), *("." + c for c in a.get("class", "").split())}
        if "display:none" in style or names & self.none and "display:" not in style:
            return None
        if "visibility:" in style:
            return "visibility:hidden" not in style and "visibility:collapse" not in style
        return False if names & self.unseen else visible

    def children(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if visible:
                    (flow.exact if pre else flow.text)(child)
            else:
                self.element(child, flow, visible, pre)

    def inner(self, node: Node, visible: bool, pre: bool) -> list[str]:
        flow = Flow()
        self.children(node, flow, visible, pre)
        flow.end()
        return flow.lines

    def element(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        visible = self.shown(node, visible)
        if visible is None:
            return
        tag = node.tag
        if tag == "br":
            if not flow.now and flow.lines and not flow.gap:
                flow.add("")
            flow.end()
            return
        if tag == "wbr":
            return
        block = tag in BLOCKS or tag in ("tr", "caption")
        if block:
            (flow.spaced if tag in SPACED else flow.end)()
        if tag in ("ul", "ol", "menu", "dir"):
            self.list(node, flow, visible, pre)
        elif tag == "table":
            self.table(node, flow, visible, pre)
        elif tag == "blockquote":
            flow.put(self.inner(node, visible, pre), "> ", "> ")
        elif tag == "dd":
            flow.put(self.inner(node, visible, pre), "  ", "  ")
        elif tag == "details" and "open" not in node.attrs:
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    self.element(child, flow, visible, pre)
                    break
        elif tag in ("td", "th") or "#label" in node.attrs:  # a cell outside of a table, a label of a drawing
            flow.space = True
            self.children(node, flow, visible, pre)
            flow.space = True
        else:
            self.children(node, flow, visible, pre or tag in ("pre", "textarea"))
        if block:
            (flow.spaced if tag in SPACED else flow.end)()

    def list(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                own = self.shown(child, visible)
                if own is None:
                    continue
                flow.end()
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                lines = self.inner(child, own, pre)
                flow.put(lines, mark, " " * len(mark))
            elif isinstance(child, Node):
                self.element(child, flow, visible, pre)
            elif visible:
                flow.text(child)
        flow.end()

    def table(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        rows: list[list[tuple[list[str], int]]] = []
        loose = Flow()  # captions and what stands in no cell

        def walk(at: Node, seen: bool) -> None:
            for child in at.children:
                if isinstance(child, str):
                    if seen:
                        loose.text(child)
                    continue
                own = self.shown(child, seen)
                if own is None:
                    continue
                if child.tag in _ROWS:
                    walk(child, own)
                elif child.tag == "tr":
                    rows.append([])
                    walk(child, own)
                elif child.tag in ("td", "th"):
                    if not rows:
                        rows.append([])
                    span = child.attrs.get("colspan", "")
                    rows[-1].append((self.inner(child, own, pre), min(int(span), 100) if re.fullmatch(r"[1-9]\d{0,5}", span) else 1))
                else:
                    self.element(child, loose, seen, pre)

        walk(node, visible)
        loose.end()
        flow.put(loose.lines)
        widths: dict[int, int] = {}
        for row in rows:
            at = 0
            for lines, span in row:
                if span == 1:
                    wide = max((width(x) for x in lines), default=0)
                    widths[at] = max(widths.get(at, 0), wide if wide <= WIDEST else 0)
                at += span
        for row in rows:
            for k in range(max((len(lines) for lines, _ in row), default=0)):
                out, at = [], 0
                for lines, span in row:
                    cell = lines[k] if k < len(lines) else ""
                    room = sum(widths.get(at + j, 0) for j in range(span)) + 3 * (span - 1)
                    out.append(cell + " " * (room - width(cell)))
                    at += span
                flow.add(" | ".join(out).rstrip())


def extract(html: str | None) -> str:
    """The visible text of a page."""
    builder = Builder()
    scan(html or "", builder)
    flow = Flow()
    Renderer("\n".join(builder.sheet)).children(builder.root, flow, True, False)
    flow.end()
    return "\n".join(flow.lines)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their visible text as `extracted`."""
    pages = pages.drop("extracted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "extracted"])
    return pages.mapInArrow(run, T.StructType([*pages.schema, T.StructField("extracted", T.StringType())]))
