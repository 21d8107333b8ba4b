import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarry.llm.html_text import extract, extract_text
from quarry.llm.queries import QUERIES

CASES = [
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ("<ul><li>one<li>two<ul><li>x<li>y</ul><li>three</ul>after", "- one\n- two\n  - x\n  - y\n- three\n\nafter"),
    ("<ol start=3><li>a</li><li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>watermelon<td>12</table>z", "Name        Qty\napple       3\nwatermelon  12\n\nz"),
    ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b<br>c</table>", "wide cell\na  b\n   c"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
    ("a<span hidden>no</span>b <i style='display: none'>x</i> c", "ab c"),
    ("<pre>x\n  y</pre>k", "x\n  y\n\nk"),
    ("<title>t</title>hello <b>w</b>orld<script>if(a<b){}</script>!", "hello world!"),
    ("x &lt; y &amp;amp; &copy z", "x < y &amp; © z"),
    ("<details><summary>s</summary>hid</details>q", "s\nq"),
    ("<details open><summary>s</summary>seen</details>q", "s\nseen\nq"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("x<!-- c -->y<!-- open", "xy"),
    ("5 < 6 and <3", "5 < 6 and <3"),
    ("<a href='x>y'>l</a><a href='open", "l"),
    ("<td>lone</td>", "lone"),
    ("</p></div></li>a", "a"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<template>no</template><noscript>no</noscript>yes", "yes"),
    ("<h1>A</h1><h2>B</h2>c<hr>d", "A\n\nB\n\nc\n\nd"),
    ("", ""),
    (None, ""),
    ("   \n ", ""),
    ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_rendering(html, text):
    assert extract(html) == text


SHOWN = [
    ("a<select><option>Red<option selected>Blue</select>b", "a\nRed\nBlue\nb"),
    ("<select><optgroup label=Warm><option>Red</option><option label=Pink>p</option></optgroup></select>", "Warm\nRed\nPink"),
    ("<select hidden><option>no</select><datalist><option>no</datalist>yes", "yes"),
    ("a<textarea>\nx  &amp;\n <b>y</b></textarea>b", "a\nx  &\n <b>y</b>\nb"),
    ("<p>k<xmp>if (a<b)\n  &amp; <i>c</i></xmp>d", "k\n\nif (a<b)\n  &amp; <i>c</i>\n\nd"),
    ("<p>k<xmp>open <b>to the end", "k\n\nopen <b>to the end"),
    ("<p>k<plaintext>a <b>c</b></plaintext> d", "k\n\na <b>c</b></plaintext> d"),
    ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>.", "so x=1 2 ."),
    ("<math><semantics><mi>y</mi><annotation>\\upsilon</annotation></semantics></math>", "y"),
    ("<math><mspace/><mi>x</mi></math><p>after", "x\n\nafter"),
    ("a<svg viewBox='0 0 9 9'><title>no</title><desc>no</desc>no<path d='M0'/><text x=1>Label <tspan>one</tspan></text><g><text>two</text></g></svg>b", "a\nLabel one\ntwo\nb"),
    ("<svg><text><tspan x=0>up</tspan><tspan x=0>down</tspan></text></svg>", "up\ndown"),
    ("<svg><text display=none>no</text><desc/><text>yes</text></svg>", "yes"),
    ("<svg><foreignObject><div>in<p>side</div></foreignObject></svg>out", "in\n\nside\n\nout"),
    ("<svg><circle><p>never closed</p>seen", "never closed\n\nseen"),
    ("<svg><style>no</style>not supported</svg><script>no</script><template>no</template><video>no</video>yes", "yes"),
]


@pytest.mark.parametrize("html, text", SHOWN)
def test_what_browsers_show_comes_out(html, text):
    assert extract(html) == text


STRAY_QUOTES = [
    ('<li><a href="x"">Alpha text</a> visible <li><a href="y"">Beta</a>', "- Alpha text visible\n- Beta"),
    ("<p title=don't>First paragraph.</p><p>It's here.</p>", "First paragraph.\n\nIt's here."),
    ('<p "a>b</p>"c', 'b\n\n"c'),
    ('<p title = "x>y" id=\'a>b\'>c</p title="x>y">d', "c\n\nd"),
    ("<p title=>a</p>b", "a\n\nb"),
    ('<p title="x"hidden>no</p><p title=a"hidden">yes</p>', "yes"),
    ("<p id=1 title=it's style='display:none'>no</p>it's", "it's"),
]


@pytest.mark.parametrize("html, text", STRAY_QUOTES)
def test_a_stray_quote_opens_no_string(html, text):
    assert extract(html) == text


CLOSED = [
    ("<select><option>one</select>after", "one\nafter"),
    ("<form><select><option>1<option>2</select><p>Paragraph</p></form><h1>Title</h1>", "1\n2\n\nParagraph\n\nTitle"),
    ("<datalist><option>no</datalist>yes", "yes"),
    ("<object><p>no</object>yes", "yes"),
    ("<noscript><p>no<ul><li>no</noscript>yes", "yes"),
    ("<noscript><table><tr><td>no</noscript>yes", "yes"),
    ("<template><option>no<div>no</template>yes", "yes"),
    ("<video><p>no</video><p>yes", "yes"),
    ("<button><p>one</button>two", "one\n\ntwo"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>on", "yes\non"),
    ("<svg><g visibility=hidden><text>no</text><text visibility=visible>yes</text></g></svg>", "yes"),
    ("<pre>\nx\n\ny</pre>", "x\n\ny"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"),
    ("<table><tr><td rowspan=2>A<td>B1<tr><td>B2<tr><td>C<td>D</table>", "A  B1\n   B2\nC  D"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td rowspan=2 colspan=2>x<td>y<tr><td>z</table>", "x  y\n   z"),
    ("<table><tr><td>" + "long " * 20 + "<td>b<tr><td>c<td>d</table>", "long " * 20 + " b\nc  d"),
]


@pytest.mark.parametrize("html, text", CLOSED)
def test_nothing_after_an_open_element_is_lost(html, text):
    assert extract(html) == text


HOSTILE = {
    "spans": "<li><table>" + "<span>" * 60_000 + "</li>" * 60_000 + "end",
    "drawn": "<svg><foreignObject>" + "<g>" * 60_000 + "<br>" * 60_000 + "end",
    "wide": "<table>" + f"<tr><td>{'w' * 20_000}<td>b" + "<tr><td>a<td>b" * 60_000 + "</table>end",
    "lines": "<table><tr>" + "<td>a" * 60_000 + "<td>" + "x<br>" * 60_000 + "</table>end",
    "columns": "<table>" + "<tr><td colspan=1000>a<td>b" * 30_000 + "</table>end",
    "rows": "<table>" + "<tr><td rowspan=9999>a" * 40_000 + "</table>end",
    "deep": "<div>" * 100_000 + "</p>" * 50_000 + "end",
    "quotes": "<a b='" * 50_000 + "end",
    "formats": "<b><p></b>" * 60_000 + "end",
    "nested quotes": "<blockquote>" * 3_000 + "<p>x" * 30_000 + "<p>end",
    "nested lists": "<ul><li>a" * 20_000 + "end",
    "nested numbers": "<ol start=99999><li>a" * 20_000 + "<p>b" * 20_000 + "<p>end",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages(name):
    page = HOSTILE[name]
    began = time.perf_counter()
    text = extract(page)
    assert time.perf_counter() - began < 20
    assert len(text) <= 10 * len(page)
    assert text.rstrip().endswith("end") or name == "quotes"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<!-->b-->c", "ab-->c"),
        ("a<!--->b", "ab"),
        ("<!-- x --!>d<!-- y -->e", "de"),
        ("a<!-- never closed", "a"),
        ("<svg><text><![CDATA[ b < c ]]></text></svg>", "b < c"),
        ("x<![CDATA[ y ]]>z", "xz"),
        ("<math><mtext><![CDATA[q]]>r</mtext></math>", "r"),
        ("<span hidden style='display:block'>v</span>", "v"),
        ("<span style='display:block;display: NONE'>v</span>w", "w"),
        ("<p hidden>v</p>w", "w"),
        ("<input type=submit value=Send><input value='a  b'><input type=password value=p><input type=checkbox value=c>", "Senda b"),
        ("<style>.x{display:none}</style><p class=x>shown", "shown"),
    ],
)
def test_browsers_rules(page, text):
    assert extract(page) == text


def test_deep_levels_are_numbered():
    page = "<ul><li>" * 30 + "x<p>y"
    assert extract(page).split("\n")[-1] == "30 y" and extract("<ul><li>" * 3 + "x") == "    - x"


def made(rnd, depth=0):
    """A random page part as HTML (with optional end tags left out at random) and the lines a plain renderer gives for it."""

    def end(tag):
        return f"</{tag}>" if rnd.random() < 0.5 else ""

    def said():
        return " ".join(rnd.choice(["alpha", "b", "céd", "long-word", "x1"]) for _ in range(rnd.randint(1, 5)))

    kind = rnd.choice(["p", "div", "h2", "list", "table", "div"] if depth < 3 else ["p", "div", "h2"])
    if kind in ("p", "h2"):
        x = said()
        return f"<{kind}>{x}" + (end("p") if kind == "p" else "</h2>"), [*GAP, x, *GAP]
    if kind == "div":
        x = said()
        inner = [made(rnd, depth + 1) for _ in range(rnd.randint(0, 2))]
        return f"<div>{x}" + "".join(h for h, _ in inner) + "</div>", [x, *(y for _, ls in inner for y in ls)]
    if kind == "list":
        tag, html, lines = rnd.choice(["ul", "ol"]), "", []
        for i in range(rnd.randint(1, 4)):
            x, mark = said(), "- " if tag == "ul" else f"{i + 1}. "
            html += f"<li>{x}" + end("li")
            lines.append(mark + x)
        return f"<{tag}>{html}</{tag}>", [*GAP, *lines, *GAP]
    columns, rows = rnd.randint(1, 4), rnd.randint(1, 4)
    cells = [[said() for _ in range(columns)] for _ in range(rows)]
    widths = [max(len(r[c]) for r in cells) for c in range(columns)]
    html = "".join("<tr>" + "".join(f"<td>{x}" + end("td") for x in r) + end("tr") for r in cells)
    return f"<table>{html}</table>", [*GAP, *("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in cells), *GAP]


GAP = [""]


@pytest.mark.parametrize("seed", range(40))
def test_layout_is_that_of_a_plain_renderer(seed):
    rnd = random.Random(seed)
    parts = [made(rnd) for _ in range(6)]
    lines: list[str] = []
    for x in (x for _, ls in parts for x in ls):
        if x or (lines and lines[-1]):
            lines.append(x)
    while lines and not lines[-1]:
        lines.pop()
    assert extract("".join(h for h, _ in parts)) == "\n".join(lines)


class Words(HTMLParser):
    """Visible words by the standard library's parser."""

    BREAKS = frozenset("p br div li h1 article footer nav ul body".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        self.found += [" "] * (tag in self.BREAKS)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")
        self.found += [" "] * (tag in self.BREAKS)

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def test_query_loses_no_word(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = QUERIES["op2_html_extraction"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        p = Words()
        p.feed(pages[r["page_id"]])
        p.close()
        assert [w for w in r["text"].split() if w != "-"] == [w for w in "".join(p.found).split() if w != "-"]
        assert r["n_chars"] == len(r["text"])


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None)], "page_id long, html string").withColumn("text", F.lit("mine"))
    got = extract_text(df)
    assert got.columns == ["page_id", "html", "text", "text_"]
    assert sorted(r["text_"] for r in got.collect()) == ["", "a", "a"]
    assert extract_text(df.limit(0)).count() == 0
