"""Layout-aware text of HTML pages (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import slices
from .common import query, ship_package, table

# Element names and their roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("script style head title template iframe noembed noframes datalist audio video canvas object".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table hr figure fieldset menu xmp".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup "
    "option section summary search caption tr td th thead tbody tfoot textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre search section summary table ul li dd dt xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends open elements of the second set, unless one of the third stands between.
IMPLIED = [
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    (frozenset("dt dd".split()), frozenset("dt dd".split()), frozenset("dl table td th".split())),
    (frozenset(["option"]), frozenset(["option"]), frozenset("select datalist optgroup".split())),
    (frozenset(["optgroup"]), frozenset("option optgroup".split()), frozenset(["select"])),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset("tr table".split())),
    (frozenset(["tr"]), frozenset("td th tr caption colgroup".split()), frozenset("table tbody thead tfoot".split())),
    (frozenset("tbody thead tfoot".split()), frozenset("td th tr tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    (frozenset(["button"]), frozenset(["button"]), frozenset("table td th".split())),
]
_IMPLIED = {tag: (ends, walls) for tags, ends, walls in IMPLIED for tag in tags}
WALLS = frozenset("table td th caption button object html body".split())
_TABLE_WALLS = {"table": frozenset()} | {tag: frozenset(["table"]) for tag in "tr td th thead tbody tfoot caption".split()}
#: Open elements beyond this depth do not nest further, unless they are hidden or stand in a hidden one.
DEEPEST = 150
#: Cells are padded to their column's width up to here, so one long cell does not widen every row.
WIDEST_PAD = 60
WIDEST_SPAN = 1000

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)|[!?/][^>]*>)""", re.S)
_STOP = re.compile(r""">|=[ \t\n\r\f]*+["']""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DECLARATION = re.compile(r"""(?:[^;"'(\\]++|"[^"]*+"?|'[^']*+'?|\([^)]*+\)?|\\.?)++""", re.S)
_RULE = re.compile(r"([^{}@;]++)\{([^{}]*+)\}")
_SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9]*+|\*)?(?:([.#])([\w-]++))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def declarations(style: str) -> dict[str, tuple[bool, str]]:
    """``display`` and ``visibility`` of a style, each with whether it is important; of repeated ones the last counts."""
    out: dict[str, tuple[bool, str]] = {}
    if "display" in style.lower() or "visibility" in style.lower():
        for part in _DECLARATION.findall(re.sub(r"/\*.*?(?:\*/|\Z)", " ", style, flags=re.S)):
            name, colon, value = part.partition(":")
            name, value = name.strip().lower(), value.strip().lower()
            important = value.endswith("important") and value.removesuffix("important").rstrip().endswith("!")
            if important:
                value = value.removesuffix("important").rstrip().removesuffix("!").rstrip()
            if colon and name in ("display", "visibility") and re.fullmatch(r"[a-z-]+(?: [a-z-]+)*", value):
                if important or not out.get(name, (False, ""))[0]:
                    out[name] = (important, value)
    return out


class Sheet:
    """Rules of a page's style elements for one element name, class or id; other selectors and at-rules are left out."""

    def __init__(self):
        self.rules: dict[tuple[str, str], list[tuple[int, int, str, dict]]] = {}
        self.count = 0

    def add(self, text: str) -> None:
        text = re.sub(r"/\*.*?(?:\*/|\Z)", " ", text, flags=re.S)
        text = re.sub(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\}?)", " ", text)
        for selectors, style in _RULE.findall(text):
            declared = declarations(style)
            for selector in selectors.split(",") if declared else ():
                found = _SELECTOR.fullmatch(selector.strip())
                if found and selector.strip():
                    tag, sign, name = found.groups()
                    weight = {"#": 100, ".": 10}.get(sign, 0) + (tag not in (None, "*"))
                    self.count += 1
                    self.rules.setdefault((sign or "", name or (tag or "").lower()), []).append((weight, self.count, (tag or "*").lower(), declared))

    def declared(self, node: Node) -> dict[str, str]:
        keys = [("", node.tag), ("", "*"), ("#", node.attributes.get("id", "")), *((".", c) for c in node.attributes.get("class", "").split())]
        best: dict[str, tuple] = {}
        layers = [rule for key in keys for rule in self.rules.get(key, ()) if rule[2] in ("*", node.tag)]
        layers.append((1000, 0, "*", declarations(node.attributes.get("style", ""))))
        for weight, order, _, declared in layers:
            for name, (important, value) in declared.items():
                best[name] = max(best.get(name, (False, -1, 0, "")), (important, weight, order, value))
        return {name: found[3] for name, found in best.items()}


def settle(root: Node, sheet: Sheet) -> None:
    """Mark what is not displayed, and take the text out of what is displayed but not visible."""
    todo = [(root, False)]
    while todo:
        node, unseen = todo.pop()
        declared = sheet.declared(node)
        display, visibility = declared.get("display"), declared.get("visibility", "inherit")
        if display == "none":
            node.attributes["hidden"] = ""
        elif display is not None:
            node.attributes.pop("hidden", None)
        if display is not None:
            node.attributes.pop("style", None)
        if visibility not in ("inherit", "unset"):
            unseen = visibility in ("hidden", "collapse")
        if unseen:
            node.children = [c for c in node.children if isinstance(c, Node)]
        todo += [(c, unseen) for c in node.children if isinstance(c, Node)]


class Ends:
    """Where the tags of a page end: at the first ``>`` outside quoted values, however long these are.

    A quote only opens a value behind ``=``; a stray one has no effect on where a tag ends. Quotes at which an earlier search failed are remembered, as is the last place of each sign, so
    damaged pages are not searched again and again.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = {sign: html.rfind(sign) for sign in ">\"'"}
        self.failed: set[int] = set()
        self.open_until = -1

    def find(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes start at ``at``; -1 if there is none."""
        if at <= self.open_until:
            return -1
        opened = []
        while at <= self.last[">"]:
            at = _STOP.search(self.html, at).end() - 1
            if self.html[at] == ">":
                return at
            opened.append(at)
            if at in self.failed or at >= self.last[self.html[at]]:
                break
            at = self.html.find(self.html[at], at + 1) + 1
        self.failed.update(opened)
        if opened:
            self.open_until = opened[0]
        return -1


def parse(html: str) -> Node:
    """Element tree of a page; start and end tags that authors leave out are implied."""
    root = Node("html", {})
    stack = [root]
    sheet, styled = Sheet(), False
    beyond: dict[str, list[int]] = {}  # places of the open elements beyond DEEPEST, by name

    dark = 0  # place of the first hidden open element

    def push(node: Node) -> None:
        nonlocal dark
        if len(stack) >= DEEPEST:
            beyond.setdefault(node.tag, []).append(len(stack))
        dark = dark or (0 if visible(node) else len(stack))
        stack.append(node)

    def cut(at: int) -> None:
        nonlocal dark
        for node in stack[max(at, DEEPEST) :]:
            beyond[node.tag].pop()
        dark = dark if dark < at else 0
        del stack[at:]

    def close(ends: frozenset, walls: frozenset) -> bool:
        if len(stack) > DEEPEST:  # by name, as elements that stand in a hidden one may be many
            last = max((places[-1] for tag in ends if (places := beyond.get(tag))), default=0)
            wall = max((places[-1] for tag in walls if (places := beyond.get(tag))), default=0)
            if last and last >= wall:
                cut(last)
                return True
            if wall:
                return False
        for at in range(min(len(stack), DEEPEST) - 1, 0, -1):
            if stack[at].tag in ends:
                cut(at)
                return True
            if stack[at].tag in walls:
                break
        return False

    at, end = 0, len(html)
    ends_of = Ends(html)
    while at < end:
        found = _TAG.search(html, at)
        if found is None or found.start() > at:
            text = html[at : found.start() if found else end]
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if found is None:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        stop = ends_of.find(at)
        if stop < 0:
            if at > ends_of.last[">"]:  # no tag ends behind here, only a comment may follow
                at = html.find("<!--", found.start())
                text = html[found.start() : at if at >= 0 else end]
                stack[-1].children.append(unescape(text) if "&" in text else text)
                at = at if at >= 0 else end
            else:
                at = html.index(">", at) + 1
            continue
        inside, at = html[at:stop], stop + 1
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p":
                if not close(frozenset(["p"]), WALLS):
                    stack[-1].children.append(Node("p", {}))
            elif tag in HEADINGS:
                close(HEADINGS, WALLS)
            elif tag not in ("html", "body"):
                close(frozenset([tag]), _TABLE_WALLS.get(tag, WALLS - {tag} if tag in BLOCK else BLOCK))
            continue
        if tag in ("html", "body"):
            close(frozenset(["head"]), frozenset())
            continue
        attributes = attributes_of(inside) if inside.strip(" \t\n\r\f/") else {}
        if stack[-1].tag == "head" and tag in BLOCK:
            cut(len(stack) - 1)
        if tag in CLOSES_P:
            close(frozenset(["p"]), WALLS)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            cut(len(stack) - 1)
        if tag in _IMPLIED:
            ends, walls = _IMPLIED[tag]
            while close(ends, walls):
                pass
        node = Node(tag, attributes)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            push(row)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = end if tag == "plaintext" else -1
            if stop < 0:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(html, at)
                stop, following = (closing.start(), closing.end()) if closing else (end, end)
            else:
                following = end
            text = html[at:stop]
            if tag == "style":
                sheet.add(text)
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = following
        elif tag not in VOID and (len(stack) < DEEPEST or dark or not visible(node) or "visibility" in attributes.get("style", "").lower()):
            push(node)
        styled = styled or "style" in attributes
    if styled or sheet.rules:
        settle(root, sheet)
    return root


def visible(node: Node) -> bool:
    attributes = node.attributes
    if node.tag in UNSEEN or "hidden" in attributes or (node.tag == "dialog" and "open" not in attributes):
        return False
    if node.tag == "input":
        return False
    return not ("style" in attributes and declarations(attributes["style"]).get("display", (False, ""))[1] == "none")


class Page:
    """Lines of a block under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.mark = ""
        self.indent = ""

    def write(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.inline.append(first)
            for line in rest:
                self.end_line(True)
                self.inline.append(line)
            return
        text = _SPACE.sub(" ", text)
        if text != " " or self.inline:
            if text.startswith(" ") and (not self.inline or self.inline[-1].endswith(" ")):
                text = text[1:]
            if text:
                self.inline.append(text)

    def end_line(self, always: bool = False) -> None:
        text = "".join(self.inline).replace("\xa0", " ").rstrip()
        self.inline = []
        if text or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.lines.append((self.indent + self.mark + text).rstrip() if text or self.mark else "")
            self.mark = " " * len(self.mark) if self.mark.strip() else self.mark

    def block(self, lines: list[str]) -> None:
        """Finished lines of an inner block."""
        for line in lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.lines.append((self.indent + self.mark + line).rstrip())
            self.mark = " " * len(self.mark) if self.mark.strip() else self.mark


def layout(node: Node, page: Page, keep: bool = False, depth: int = 0) -> None:
    """Write a node's visible content: blocks on lines of their own, spaced blocks behind a blank line."""
    number = _whole(node.attributes.get("start"), 1) if node.tag == "ol" else 0
    closed = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if not closed:
                page.write(child, keep)
            continue
        tag = child.tag
        if not visible(child) or (closed and tag != "summary"):
            continue
        if tag == "br":
            page.end_line(True)
        elif tag == "wbr":
            continue
        elif tag == "table":
            page.end_line()
            page.gap = 1
            page.block(table_lines(child, depth))
            page.gap = 1
        elif tag in BLOCK:
            page.end_line()
            nested = tag in ("ul", "ol", "menu") and depth > 0
            page.gap = page.gap or int(tag in SPACED and not nested)
            if tag == "hr":
                page.block(["-" * 8])
            elif tag == "li":
                number = _whole(child.attributes.get("value"), number)
                inner = Page()
                inner.mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                layout(child, inner, keep, depth + 1)
                inner.end_line()
                page.block(inner.lines)
            elif tag in ("dd", "blockquote"):
                inner = Page()
                layout(child, inner, keep, depth)
                inner.end_line()
                page.block([("    " + line).rstrip() for line in inner.lines])
            else:
                layout(child, page, keep or tag in ("pre", "textarea", "xmp"), depth)
            page.end_line()
            page.gap = page.gap or int(tag in SPACED and not nested)
        else:
            layout(child, page, keep, depth)


def _whole(text: str | None, default: int) -> int:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,9}", text.strip()) else default


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _holders(node: Node) -> Iterator[Node]:
    """What may hold content outside cells: the table, its sections at any depth and their rows."""
    yield node
    for child in node.children:
        if isinstance(child, Node) and child.tag in ("tr", "thead", "tbody", "tfoot", "colgroup") and visible(child):
            yield from (child,) if child.tag == "tr" else _holders(child)


def _parted(node: Node) -> tuple[list[Node], list[Node | str]]:
    """Cells of a row, also those inside a form or another element there, and the content outside of them."""
    cells, others = [], []
    for child in node.children:
        if isinstance(child, str):
            others.append(child)
        elif child.tag in ("td", "th"):
            cells.append(child)
        elif child.tag in ("table", "details") or not visible(child):
            others.append(child)
        else:
            inner, rest = _parted(child)
            if inner:
                cells += inner
                part = Node(child.tag, child.attributes)
                part.children = rest
                others.append(part)
            else:
                others.append(child)
    return cells, others


def table_lines(table_node: Node, depth: int) -> list[str]:
    """Captions and stray content, then the rows with columns aligned; spans take the columns they cover."""
    out = Page()
    stray = Node("div", {})
    for holder in _holders(table_node):
        content = _parted(holder)[1] if holder.tag == "tr" else [
            c for c in holder.children if isinstance(c, str) or c.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup")]
        stray.children += [c for c in content if not isinstance(c, str) or c.strip()]
    layout(stray, out, False, depth)
    out.end_line()
    grid: list[list[tuple[int, int, list[str]]]] = []
    covered: dict[int, int] = {}
    for row in _rows(table_node):
        cells, column = [], 0
        taken = {c for c, left in covered.items() if left > 0}
        covered = {c: left - 1 for c, left in covered.items() if left > 1}
        for cell in _parted(row)[0]:
            if not visible(cell):
                continue
            while column in taken:
                column += 1
            wide = min(max(_whole(cell.attributes.get("colspan"), 1), 1), WIDEST_SPAN)
            tall = min(max(_whole(cell.attributes.get("rowspan"), 1), 1), WIDEST_SPAN)
            inner = Page()
            layout(cell, inner, False, depth)
            inner.end_line()
            cells.append((column, wide, inner.lines))
            if tall > 1:
                covered |= {c: tall - 1 for c in range(column, column + wide)}
            column += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, wide, lines in cells:
            if wide == 1:
                widths[column] = max(widths.get(column, 0), min(max(map(len, lines), default=0), WIDEST_PAD))
    at, start = 0, {}
    for column in range(max(widths, default=-1) + 2):
        start[column] = at
        at += widths[column] + 2 if column in widths else 0
    for cells in grid:
        for line in range(max((len(lines) for _, _, lines in cells), default=0)):
            text = ""
            for column, _, lines in cells:
                if line < len(lines) and lines[line]:
                    left = min(start.get(column, at), len(text) + WIDEST_PAD * WIDEST_SPAN)
                    text = text.ljust(left) if len(text) <= left or not text else text + "  "
                    text += lines[line]
            out.lines.append(text.rstrip())
    return out.lines


def render(html: str) -> str:
    page = Page()
    layout(parse(html), page)
    page.end_line()
    while page.lines and not page.lines[0]:
        page.lines.pop(0)
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return "\n".join(page.lines)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "html"):
            texts = [None if html is None else render(html) for html in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every row of ``pages(page_id, html)``, row by row without a shuffle.

    A null page has null text, an empty one and one without visible text has empty text. Markup of any
    kind is accepted; elements nested deeper than ``DEEPEST`` are read as siblings. Whether an element is
    shown follows its attributes, its own style and the page's rules for single names, classes and ids.
    Pages of any length are read whole, one at a time; rows with equal or null page_id are judged alone.
    """
    ship_package(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(_rendered, f"page_id {kind}, text string")


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("page_id", F.length("text").alias("n_chars"), F.when(F.col("text").isNotNull(), lines).alias("n_lines"), F.md5("text").alias("text_md5"))
