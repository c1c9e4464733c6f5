"""HTML to text as it would be laid out: a tree with implied tags, visibility rules, blocks, lists and aligned tables.

Building and rendering use stacks of their own, so that nesting of any depth is fine.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_runs

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
DECLARATION = re.compile(r"<[!?]")
OUTSIDE = re.compile(r"[^>\"']+")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
STYLE = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist meta link base param source track area dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table ul caption tr td th thead tbody tfoot option optgroup".split())
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul".split())
#: tag → (open tags that it ends, tags beyond which it ends none)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
}
SCOPE = frozenset("table td th caption html body template".split())
#: tag → tags within it that are not drawn
UNDRAWN = {"svg": frozenset("title desc defs metadata symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
#: An attribute that no page can have: the element has lines of its own.
LINE = "\0line"
TABLE_PARTS = frozenset("td th tr tbody thead tfoot caption".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


class Open:
    """The open tags, and where in the stack each kind stands, so that no look-up walks the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.where = [root], {root.tag: [0]}

    def __contains__(self, tag: str) -> bool:
        return bool(self.where.get(tag))

    def last(self, tags) -> int:
        """The place of the innermost open tag among tags; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def pop(self) -> None:
        self.where[self.stack.pop().tag].pop()

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.pop()

    def close(self, tags, beyond) -> None:
        """Ends the outermost open tag among `tags` that stands within the nearest of `beyond`, and all in it."""
        bound, found = self.last(beyond), []
        for t in tags:
            places = self.where.get(t)
            if places:
                k = bisect_right(places, bound)
                if k < len(places):
                    found.append(places[k])
        if found:
            self.cut(min(found))

    def end(self, tag: str, beyond) -> None:
        """Ends the innermost open tag of that kind, unless one of `beyond` stands within it."""
        at = self.last((tag,))
        if at and at > self.last(beyond):
            self.cut(at)


class Tokens:
    """Tags of a source in order, comments and declarations as tags without a name. A tag ends at the first > outside of quotes; without one its < is text.

    Scans that found no end are kept as ranges outside of quotes: a later scan that comes into one has none either, so that
    each place is read a few times at most.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.starts: list[int] = []  # of ranges without an end, in order; lasts: where each ends
        self.lasts: list[int] = []
        self.failed, self.last = 0, source.rfind(">")  # behind the name of the last tag that had no end: one that begins in the name has none either

    def dead(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and at < self.lasts[k]

    def end(self, at: int) -> int:
        """The place of the tag's >, from behind its name on; -1 if there is none."""
        source, n, ranges = self.source, len(self.source), []
        while at < n:
            if self.dead(at):
                break
            found = OUTSIDE.match(source, at)
            last = found.end() if found else at
            # a range that was read before may begin within this one
            ranges.append((at, max(last, at + 1)))
            at = last
            if at >= n:
                break
            if source[at] == ">":
                return at
            close = source.find(source[at], at + 1)
            if close < 0:
                break
            at = close + 1
        for start, last in ranges:
            k = bisect_right(self.starts, start)
            self.starts.insert(k, start)
            self.lasts.insert(k, last)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the first at or after a place."""
        source, n = self.source, len(self.source)
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                close = source.find("-->", at + 4)
                return at, close + 3 if close >= 0 else n, "", "", ""
            if source[at + 1 : at + 2] in ("!", "?"):
                close = source.find(">", at)
                return at, close + 1 if close >= 0 else n, "", "", ""
            if at > self.last:
                found = DECLARATION.search(source, at)
                if not found:
                    return None
                at = found.start()
                continue
            if (at >= self.failed or source[at + 1] == "/") and (found := NAME.match(source, at)):
                if (close := self.end(found.end())) >= 0:
                    return at, close + 1, found[1], found[2], source[found.end() : close]
                self.failed = found.end()
            at += 1
        return None


def tree(source: str) -> Node:
    """The document's tree. Missing end tags, and the row that a cell needs, are implied; a stray end tag is ignored, but that of p or br."""
    root = Node("html", {})
    open_ = Open(root)
    at, n, tokens = 0, len(source), Tokens(source)
    while at < n:
        found = tokens.next(at)
        text = source[at : found[0] if found else n]
        if text:
            open_.stack[-1].children.append(html.unescape(text))
        if not found:
            break
        _, at, slash, name, inside = found
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag == "br":
                open_.push("br", {})
            elif tag == "p" and "p" not in open_:
                open_.push("p", {})
                open_.pop()
            elif tag not in ("html", "body"):
                open_.end(tag, ("table",) if tag in TABLE_PARTS else () if tag == "table" else SCOPE - {tag})
            continue
        if tag in ("html", "body"):
            root.attrs.update({k: v for k, v in attributes(inside).items() if k not in root.attrs})
            if tag == "body":
                open_.close({"head"}, ())
            continue
        if tag in CLOSES_P:
            open_.close(("p",), SCOPE)
        if tag in ENDS:
            open_.close(*ENDS[tag])
            if tag in ("td", "th") and open_.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                open_.push("tr", {})
        attrs = attributes(inside) if inside.strip(" /\n\t") else {}
        inner = open_.last(UNDRAWN)
        foreign = tag if tag in UNDRAWN else open_.stack[inner].tag if inner else ""
        if foreign and tag in UNDRAWN[foreign]:
            attrs["hidden"] = ""
        elif foreign == "svg" and tag == "text":
            attrs[LINE] = ""
        open_.push(tag, attrs)
        if foreign and tag not in VOID and inside.endswith("/"):
            open_.pop()
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            close = source.find(">", end.end()) if end else -1
            raw = source[at : end.start() if close >= 0 else n]
            if raw:
                open_.stack[-1].children.append(html.unescape(re.sub(r"\A\r?\n", "", raw)) if tag == "textarea" else raw)
            open_.pop()
            at = close + 1 if close >= 0 else n
    return root


def visible(node: Node, shown: bool) -> bool | None:
    """None if the element and all in it are left out; else whether its own text shows. A visible child of a hidden parent shows."""
    if node.tag in HIDDEN and not (node.tag == "dialog" and "open" in node.attrs) or "hidden" in node.attrs:
        return None
    style = {k.lower(): v.lower() for k, v in STYLE.findall(node.attrs.get("style", ""))}
    if style.get("display") == "none":
        return None
    return {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), shown)


class Flow:
    """Lines of one block context: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.indents, self.marker = 0, [], ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for line in rest:
                self.line(keep=True)
                self.parts.append(line)
            return
        s = re.sub(r"[ \t\n\r\f]+", " ", s)
        if s.startswith(" ") and (not self.parts or self.parts[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.parts.append(s)

    def line(self, keep: bool = False) -> None:
        """Ends the line; an empty one counts only with keep."""
        text = "".join(self.parts).rstrip(" ")
        self.parts = []
        if not text and not (keep and not self.gap):
            return
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        indent = "".join(self.indents)
        if self.marker:
            indent, self.marker = indent[: len(indent) - len(self.marker)] + self.marker, ""
        self.lines.append((indent + text).rstrip(" "))

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def span_of(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value) else 1


class Table:
    """Cells on a grid; a cell stands at the first column that no cell of the rows above reaches into."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int]]] = []
        self.held: list[int] = []  # by column, rows below the present that a cell above still covers
        self.covered: list[bool] = []

    def row(self) -> None:
        self.rows.append([])
        self.covered, self.held = [h > 0 for h in self.held], [max(0, h - 1) for h in self.held]
        self.at = 0

    def skip(self) -> None:
        while self.at < len(self.covered) and self.covered[self.at]:
            self.rows[-1].append(([], 1))
            self.at += 1

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        """rows: 0 for all that follow."""
        if not self.rows:
            self.row()
        self.skip()
        self.rows[-1].append((lines, columns))
        end = self.at + columns
        self.held += [0] * (end - len(self.held))
        self.held[self.at : end] = [(rows - 1) if rows else 10**6] * columns
        self.at = end

    def lines(self) -> list[str]:
        """Each cell's lines padded to its columns' width, two spaces between columns; columns that no cell tells apart are one."""
        edges = set()
        for row in self.rows:
            at = 0
            for _, span in row:
                at += span
                edges.add(at)
        place = {edge: k for k, edge in enumerate(sorted(edges | {0}))}
        rows = []
        for row in self.rows:
            at = 0
            rows.append([])
            for lines, span in row:
                rows[-1].append((lines, place[at + span] - place[at]))
                at += span
        widths: list[int] = []
        for wide in (False, True):
            for row in rows:
                at = 0
                for lines, span in row:
                    widths += [0] * (at + span - len(widths))
                    most = max(map(len, lines), default=0)
                    if span == 1:
                        widths[at] = max(widths[at], most)
                    elif wide:
                        widths[at + span - 1] += max(0, most - sum(widths[at : at + span]) - 2 * (span - 1))
                    at += span
        out = []
        for row in rows:
            for k in range(max((len(lines) for lines, _ in row), default=0)):
                at, parts = 0, []
                for lines, span in row:
                    parts.append((lines[k] if k < len(lines) else "").ljust(sum(widths[at : at + span]) + 2 * (span - 1)))
                    at += span
                out.append("  ".join(parts).rstrip(" "))
        return out


def rendered(source: str | None) -> str:
    """All visible text of a page, laid out; empty for null and empty pages."""
    if not source:
        return ""
    flows, tables, lists = [Flow()], [], []
    todo: list[tuple[object, bool, bool, bool]] = [(tree(source), False, False, True)]
    while todo:
        node, leaving, pre, shown = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if shown:
                flow.text(node, pre)
            continue
        tag = node.tag
        if not leaving:
            own = visible(node, shown)
            if own is None:
                continue
            shown = own
            if tag == "br":
                flow.line(keep=True)
                continue
            if LINE in node.attrs or tag in BLOCKS and tag not in TABLE_PARTS:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    marker, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
                flow.indents.append(" " * len(marker))
                flow.marker = marker if shown else ""
            elif tag in ("blockquote", "dd"):
                flow.indents.append("  ")
            elif tag == "hr":
                if shown:
                    flow.parts.append("---")
                flow.block(True)
                continue
            elif tag == "table":
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th", "caption"):
                flows.append(Flow())
            elif tag == "q" and shown:
                flow.text('"', False)
            elif tag == "optgroup" and shown and node.attrs.get("label"):
                flow.text(node.attrs["label"], False)
                flow.block(False)
            todo.append((node, True, pre, shown))
            inside = pre or tag in ("pre", "listing", "plaintext", "xmp", "textarea")
            todo += [(c, False, inside, shown) for c in reversed(node.children)]
            continue
        if tag in ("td", "th", "caption"):
            cell = flows.pop().done()
            if tag != "caption" and tables:
                tables[-1].cell(cell, max(1, span_of(node, "colspan", 1000)), span_of(node, "rowspan", 65_534))
            else:
                flows[-1].block(False)
                for line in cell:
                    flows[-1].parts.append(line)
                    flows[-1].line()
            continue
        if tag == "table" and tables:
            flow.line()
            for line in tables.pop().lines():
                flow.parts.append(line)
                flow.line(keep=True)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            flow.line()
            flow.marker = ""
            flow.indents.pop()
        elif tag in ("blockquote", "dd"):
            flow.line()
            flow.indents.pop()
        elif tag == "q" and shown:
            flow.text('"', False)
        if LINE in node.attrs or tag in BLOCKS and tag not in TABLE_PARTS:
            flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return "\n".join(flows[0].done())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, text, n_lines. Null and empty pages have an empty text and no lines; repeated rows are rendered each, and an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sources in text_runs(batch.column(1), 4_000_000):
                texts = [rendered(h) for h in sources]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_lines long")
