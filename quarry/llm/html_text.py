"""HTML extraction by layout-aware rendering (operator 2).

A page is cut into tags and texts, built into a tree with the tags that HTML implies
(paragraphs end where a block begins, list items, table rows and cells where the next one
does, head and body where they must), and rendered: everything visible comes out, hidden
elements do not. Blocks stand on lines of their own, paragraphs and headings between blank
lines, list items behind bullets or numbers with their nesting indented, table cells in
aligned columns, preformatted text (also that of textarea, xmp and plaintext) as it is. Of a
select every option comes out, on a line of its own; of svg the texts that are drawn, each on a
line (those of definitions where they are defined); of math what is shown, children of a
fraction and cells with a blank between. Not visible are the head, script, style, template,
datalist, a closed dialog or details, and what stands in for content that browsers show
otherwise (noscript, noembed, noframes, iframe, object, audio, video, canvas).

Neither step recurses, so depth is bounded by memory alone, and both take time in
proportion to the page: open elements are found by name, not by walking up. So is the text: beyond ``LEAD``
blanks a line in lists and quotes is not indented but led by the number of its level; cells
of over ``WIDE`` characters do not widen their column, and a table row that would need far more
blanks than it has cells and lines stands unaligned, its cells two blanks apart.

Visibility is that of elements, of the hidden attribute and of style attributes (a display there goes before
hidden). Style sheets are not read: what only a rule of theirs hides is written out. Of form fields the
labels of buttons and the texts that are filled in come out, none of passwords.

Defined results: a null or empty page, or one without visible text, gives an empty text; a very
long page is rendered whole;
unclosed tags end with the page, an unfinished tag at its end is dropped; repeated rows are
rendered each; an empty table gives an empty result; other columns pass through and ``text`` gives
way where it exists.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, free_name

# The element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas datalist title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre listing xmp plaintext table ul ol dl figure hr".split())
BLOCKS = SPACED | frozenset("html body address article aside caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option search section summary thead tbody tfoot tr".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script template noscript".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("html body caption legend option optgroup thead tbody tfoot tr".split())
LISTS = frozenset("ul ol menu dir".split())
PREFORMATTED = frozenset("pre listing textarea xmp plaintext".split())
#: Start tags of these end an open svg or math, unless they stand where it may hold HTML.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Of the children of these, the first is shown, or all with a blank between.
ONE_SHOWN = frozenset("semantics maction".split())
APART = frozenset("mfrac munder mover munderover mtr".split())
#: A start tag ends open elements of these names, unless one of the barrier comes first.
IMPLIED_END = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
}
SCOPE = frozenset("td th caption table button object html".split())
#: End tags of these close whatever is open inside.
CLOSES_ALL = HIDDEN | frozenset("select button svg math".split())
SOLID = SCOPE | BLOCKS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blanks that a line in lists and quotes is indented by at most.
LEAD = 24
#: Kinds of form fields whose value is not shown as text.
NO_TEXT = frozenset("hidden checkbox radio password file image range color".split())
#: Characters of a cell that widens its column; row spans that are kept track of at once.
WIDE, MOST_SPANS = 40, 64
#: Blanks that aligning a row may cost: so many, and so many for each of its cells and lines.
FREE_BLANKS, BLANKS = 96, 32

# A quote begins a string only after '='; elsewhere it is part of a name or value.
_name = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_equals = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+"
_bare = r"""[^ \t\n\r\f"'>][^ \t\n\r\f>]*+"""
_tag = re.compile(rf"""<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{_name}(?:{_equals}(?:"[^"]*+"|'[^']*+'|{_bare})?+)?+)*+)>""")
_attribute = re.compile(rf"""({_name})(?:{_equals}(?:"([^"]*+)"|'([^']*+)'|({_bare}))?+)?+""")
_display = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_comment_end = re.compile(r"--!?>")
_visibility = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_space = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: its tag, attributes that matter here, and children (texts are strings)."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    @property
    def hidden(self) -> bool:
        a = self.attributes
        shown = _display.findall(a["style"]) if "style" in a else []
        if self.tag in HIDDEN or (self.tag == "dialog" and "open" not in a):
            return True
        return shown[-1].lower() == "none" if shown else "hidden" in a

    @property
    def seen(self) -> bool | None:
        """Whether its own text can be seen, which what is inside may change; None if that is as around it."""
        found = _visibility.findall(self.attributes.get("style", ""))
        return found[-1].lower() == "visible" if found else None


def tokens(page: str, foreign: Callable[[], bool] = bool) -> Iterator[tuple[str, str, str]]:
    """("text", it, ""), ("raw", text as it is, ""), ("start", tag, attributes) and ("end", tag, "") of a page.

    ``foreign``: whether the place reached is inside svg or math, where CDATA sections are text.
    """
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        follows = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            early = next((x for x in (">", "->") if page.startswith(x, lt + 4)), None)  # an empty comment
            end = None if early else _comment_end.search(page, lt + 4)
            at = lt + 4 + len(early) if early else end.end() if end else n
            continue
        if page.startswith("<![CDATA[", lt) and foreign():
            end = page.find("]]>", lt + 9)
            yield "raw", page[lt + 9 : n if end < 0 else end], ""
            at = n if end < 0 else end + 3
            continue
        if follows == "!" or follows == "?":
            end = page.find(">", lt + 2)
            at = n if end < 0 else end + 1
            continue
        if not (follows.isascii() and follows.isalpha()) and not (follows == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            yield "text", "<", ""
            at = lt + 1
            continue
        m = _tag.match(page, lt)
        if m is None:  # quotes that do not close: the tag ends at the next bracket
            end = page.find(">", lt)
            if end < 0:
                return
            name = re.match(r"</?([^\s/>]*)", page[lt : lt + 64])[1]
            yield ("end" if follows == "/" else "start"), name.lower(), ""
            at = end + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, m[3]
        if tag in RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at) if tag != "plaintext" else None
            end = stop.start() if stop else n
            if end > at:
                yield "text", page[at:end], ""
            at = end


def attributes(raw: str, every: bool = False) -> dict[str, str]:
    """Attributes as a dict; empty without work if none can matter (``every``: whatever they are)."""
    low = raw.lower()
    if not every and not any(x in low for x in ("hidden", "style", "open", "start", "value", "span", "reversed", "type")):
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _attribute.finditer(raw)}


def tree(page: str) -> Node:
    """The page's tree, with implied tags."""
    root = Node("html", {})
    body: Node | None = None
    open_: list[Node] = [root]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, and of some classes
    classes = {"*solid": SOLID, "*foreign": frozenset(["svg", "math"]), "*html": BREAKS_OUT | HOLDS_HTML}

    def named(tag: str) -> Iterator[list[int]]:
        yield places[tag]
        for name, tags in classes.items():
            if tag in tags:
                yield places[name]

    def enter(node: Node) -> None:
        for x in named(node.tag):
            x.append(len(open_))
        open_.append(node)

    def leave(i: int) -> None:
        while len(open_) > i:
            for x in named(open_.pop().tag):
                x.pop()

    def last(tags: frozenset[str]) -> int:
        """The innermost open element of these tags; 0 if there is none."""
        return max((places[x][-1] for x in tags if places[x]), default=0)

    def close(names: frozenset[str], barrier: frozenset[str]) -> None:
        at = last(names)
        if at and at >= (places["*solid"][-1] if barrier is SOLID and places["*solid"] else last(barrier)):
            leave(at)

    def push(tag: str, given: dict[str, str]) -> Node:
        node = Node(tag, given)
        open_[-1].children.append(node)
        enter(node)
        return node

    def foreign_here() -> bool:
        inside = places["*foreign"]
        return bool(inside) and not (places["*html"] and places["*html"][-1] > inside[-1])

    paragraph = frozenset(["p"])
    for kind, x, raw in tokens(page, foreign_here):
        if kind == "raw":
            open_[-1].children.append(x)
            continue
        if kind == "text":
            if len(open_) == 1 and not x.isspace():
                body = body or push("body", {})
                if open_[-1] is not body:
                    enter(body)
            elif open_[-1].tag == "head" and not x.isspace():
                leave(1)
                body = body or push("body", {})
                if open_[-1] is not body:
                    enter(body)
            open_[-1].children.append(x if open_[-1].tag in RAW and open_[-1].tag not in ("title", "textarea") else unescape(x))
            continue
        if kind == "end":
            if x == "p" and not places["p"]:
                open_[-1].children.append(Node("p", {}))
            elif x == "br":
                open_[-1].children.append(Node("br", {}))
            elif x in ("html", "body"):
                continue  # what follows still belongs to the body
            elif x in CLOSES_ALL:
                close(frozenset([x]), frozenset())
            elif x in ("td", "th", "li", "tr", "dt", "dd") or x in BLOCKS:
                close(frozenset([x]), frozenset(["table"]) if x not in ("table", "thead", "tbody", "tfoot") else frozenset())
            else:
                close(frozenset([x]), SOLID)
            continue
        foreign = bool(places["*foreign"])
        given = attributes(raw, foreign or x in ("option", "optgroup")) if raw else {}
        if foreign and (x in BREAKS_OUT or (x == "font" and given.keys() & {"color", "face", "size"})):
            around = places["*foreign"][-1]
            if not places["*html"] or places["*html"][-1] < around:
                leave(around)
                foreign = bool(places["*foreign"])
        if places["svg"] and given.get("display") == "none":
            given["hidden"] = ""
        if places["svg"] and "visibility" in given:
            given["style"] = f"{given.get('style', '')};visibility:{given['visibility']}"
        if x == "html":
            root.attributes.update(given)
            continue
        if x == "head":
            if body is None and len(open_) == 1:
                push("head", given)
            continue
        if x == "body":
            if body is None:
                leave(1)
                body = push("body", given)
            else:
                body.attributes.update(given)
            continue
        if open_[-1].tag == "head" and x not in HEAD_ONLY:
            leave(1)
        if len(open_) == 1:
            if body is None and x in HEAD_ONLY:
                push("head", {})
            elif body is None:
                body = push("body", {})
            else:
                enter(body)
        if x in ENDS_PARAGRAPH:
            close(paragraph, SCOPE)
        if x in IMPLIED_END:
            close(*IMPLIED_END[x])
        if x in HEADINGS and open_[-1].tag in HEADINGS:
            leave(len(open_) - 1)
        if x in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push("tr", {})
        node = Node(x, given)
        open_[-1].children.append(node)
        if x not in VOID and not (raw.endswith("/") and (x in ("svg", "math") or foreign and x not in BLOCKS)):
            enter(node)
    return root


class Writer:
    """Lines of a block flow: collapses blanks, keeps at most one blank line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank is due before the next text
        self.gap = 0  # line ends that are due: 1 a new line, 2 a blank line
        self.leads = [""]  # of the open lists and quotes; a level's number where the blanks would be too many
        self.mark = ""  # a bullet that waits for the item's first text

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in rest:
                self._end_line()
                self._put(x)
            return
        s = s.replace("\xa0", " ") if s.isspace() else s
        words = _space.sub(" ", s)
        if words == " " or not words:
            self.blank = self.blank or bool(words)
            return
        if words[0] == " ":
            self.blank, words = True, words[1:]
        trailing = words[-1:] == " "
        self._put(words[:-1] if trailing else words)
        self.blank = trailing

    def _put(self, s: str) -> None:
        if not s:
            return
        self._break()
        if not self.line:
            lead = self.leads[-1]
            if self.mark:
                lead = lead + self.mark if lead.strip() else lead[: len(lead) - len(self.mark)] + self.mark
                self.mark = ""
            self.line.append(lead)
        elif self.blank:
            self.line.append(" ")
        self.blank = False
        self.line.append(s)

    def indent(self, n: int) -> None:
        lead = self.leads[-1]
        numbered = lead.strip() or len(lead) + n > LEAD
        self.leads.append(f"{len(self.leads)} " if numbered else lead + " " * n)

    def _end_line(self) -> None:
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.blank = [], False

    def _break(self) -> None:
        if self.gap:
            if self.line:
                self._end_line()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def block(self, gap: int) -> None:
        if self.line or self.lines:
            self.gap = max(self.gap, gap)
        self.blank = False

    def newline(self) -> None:
        self._break()
        if self.line or self.lines:
            self._end_line()

    def rows(self, lines: list[str]) -> None:
        for x in lines:
            self.block(1 if x else 2)
            self._put(x)

    def done(self) -> str:
        if self.line:
            self._end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Table rows of (text, columns spanned, rows spanned) as lines: columns start at the same place, two blanks apart."""
    placed: list[list[tuple[int, str]]] = []
    width: dict[int, int] = {}
    wide: list[tuple[int, int, int]] = []  # cells over several columns: first, end, characters
    busy: list[tuple[int, int, int]] = []  # columns that cells of earlier rows reach down to: first, end, last row
    for n, row in enumerate(rows):
        busy = sorted(x for x in busy if x[2] >= n)[-MOST_SPANS:]
        at, spans, taken = 0, [], iter(busy)
        ahead = next(taken, None)
        here: list[tuple[int, str]] = []
        for text, columns, down in row:
            while ahead and ahead[0] <= at:
                at, ahead = max(at, ahead[1]), next(taken, None)
            here.append((at, text))
            widest = max(map(len, text.split("\n")))
            width.setdefault(at, 0)
            if widest <= WIDE:
                if columns == 1:
                    width[at] = max(width[at], widest)
                else:
                    wide.append((at, at + columns, widest))
            if down > 1:
                spans.append((at, at + columns, n + down - 1))
            at += columns
        busy += spans
        placed.append(here)
    starts = sorted(width)
    before: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    for first, end, n in wide:
        before[bisect_left(starts, end)].append((bisect_left(starts, first), n))
    offset = [0]
    for i, x in enumerate(starts):
        offset.append(max([offset[-1] + width[x] + 2, *(offset[a] + n + 2 for a, n in before[i + 1])]))
    out = []
    for here in placed:
        lines: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for at, text in here:
            for i, piece in enumerate(text.split("\n")):
                if piece:
                    lines[i].append((offset[bisect_left(starts, at)], piece))
        blanks = sum(parts[-1][0] - sum(len(x) for _, x in parts[:-1]) for parts in lines.values())
        free = blanks <= FREE_BLANKS + BLANKS * (len(here) + len(lines))
        for i in range(max(lines, default=-1) + 1):
            line = ""
            for start, piece in lines[i]:
                line = line.ljust(max(start if free else 0, len(line) + 2 if line else 0)) + piece
            out.append(line)
    return out


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,6}", value) else default


def render(root: Node) -> str:
    """All visible text of a tree."""
    out = Writer()
    writers: list[Writer] = []  # of the flows around open table cells
    tables: list[list[list[tuple[str, int, int]]]] = []
    lists: list[list] = []  # of open lists: next number or None for bullets, and the step
    seen = [True]
    pre = 0
    drawn: list[bool] = []  # in svg: whether text is drawn here
    work: list[tuple[Node | str, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            if seen[-1] and (not drawn or drawn[-1]):
                out.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden or (drawn and tag in ("desc", "metadata")):
                continue
            if tag == "br":
                out.newline()
                continue
            if tag == "input" and node.attributes.get("type", "").lower() not in NO_TEXT and seen[-1] and (not drawn or drawn[-1]):
                out.text(node.attributes.get("value", ""), False)
            if tag == "wbr" or tag == "input":
                continue
            work.append((node, True))
            if node.seen is not None:
                seen.append(node.seen)
            if tag == "table":
                out.block(2)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1]:
                writers.append(out)
                out = Writer()
            elif tag in BLOCKS:
                out.block(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
            elif tag in ("select", "textarea", "mtr") or (drawn and (tag in ("text", "foreignobject") or (tag == "tspan" and node.attributes.keys() & {"x", "y"}))):
                out.block(1)
            if tag == "svg":
                drawn.append(False)
            elif drawn and tag in ("text", "foreignobject"):
                drawn.append(True)
            if tag in LISTS:
                back = tag == "ol" and "reversed" in node.attributes
                first = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) if back else 1
                lists.append([_number(node.attributes.get("start"), first) if tag == "ol" else None, -1 if back else 1])
            elif tag == "li":
                here = lists[-1] if lists else [None, 1]
                here[0] = _number(node.attributes.get("value"), here[0]) if here[0] is not None else None
                mark = "- " if here[0] is None else f"{here[0]}. "
                if here[0] is not None:
                    here[0] += here[1]
                out.indent(len(mark))
                out.mark = mark
            elif tag in ("blockquote", "dd"):
                out.indent(2)
            elif tag in PREFORMATTED:
                pre += 1
            children = node.children
            if tag in ("option", "optgroup") and (label := node.attributes.get("label")):
                children = [label] if tag == "option" else [label, *children]
            elif tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str):
                children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
            elif tag in ONE_SHOWN:
                children = [x for x in children if isinstance(x, Node)][:1]
            elif tag in APART:
                children = [y for x in children for y in (x, " ")]
            if tag == "details" and "open" not in node.attributes:
                children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
            work.extend((x, False) for x in reversed(children))
            continue
        pre -= tag in PREFORMATTED
        if node.seen is not None:
            seen.pop()
        if tag == "svg" or (drawn and tag in ("text", "foreignobject")):
            drawn.pop()
        if tag in ("td", "th") and tables and tables[-1] and writers:
            text, out = out.done(), writers.pop()
            down = _number(node.attributes.get("rowspan"), 1)
            tables[-1][-1].append((text, max(1, min(_number(node.attributes.get("colspan"), 1), 1000)), down if down > 0 else 1 << 30))
        elif tag == "table":
            out.rows(aligned(tables.pop()))
            out.block(2)
        elif tag in LISTS:
            lists.pop()
            out.block(1 if lists else 2)
        elif tag == "li":
            out.leads.pop()
            out.mark = ""
            out.block(1)
        elif tag in ("blockquote", "dd"):
            out.leads.pop()
            out.block(2 if tag == "blockquote" else 1)
        elif tag == "tr" and tables:
            pass
        elif tag in BLOCKS:
            out.block(2 if tag in SPACED else 1)
        elif tag in ("select", "textarea", "mtr") or (drawn and tag in ("text", "foreignobject")):
            out.block(1)
    return out.done()


def extract(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text. One pass, no shuffle."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x) for x in batch], dtype=object)

    return pages.select("*", run(column(pages, html)).alias(free_name(pages, "text")))
