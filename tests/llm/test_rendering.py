from __future__ import annotations

import pytest

from ledgerflow.llm.rendering import build_tree, extract_text, render


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain", "plain"), ("a \n\t b", "a b"),
    ("<p>One<p>Two <b>bold</b>  text<br>next", "One\n\nTwo bold text\nnext"),
    ("<div>a</div><div>b<div>c</div></div>d", "a\nb\nc\nd"),
    ("<h1>H</h1>x<h2>I</h2>", "H\n\nx\n\nI"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<ul><li>one<br>two</ul>after", "- one\n  two\n\nafter"),
    ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    ("x<blockquote>q<p>r</blockquote>y", "x\n\n  q\n\n  r\n\ny"),
    ("<pre>a\n  b   c\n</pre>x", "a\n  b   c\n\nx"),
    ("1 &lt; 2 &amp;&nbsp;3 &copy &#65;", "1 < 2 &\xa03 © A"),
    ("a < b and c<d>e", "a < b and ce"),
    ("<p>cut <b>off", "cut off"), ("text <a href='x", "text"), ("x<!-- never closed", "x"),
    ("<script>var a='<p>no</p>';</script>yes<style>p{}</style><template>no</template><noscript>no</noscript>", "yes"),
    ("<head><title>no</title></head>yes", "yes"), ("<title>no</title><p>yes", "yes"),
    ("<p hidden>no<p>yes<span style='DISPLAY : none'>no</span><i style='visibility:hidden'>no</i>", "yes"),
    ("<style>.ad, p.x{display:none} #q{visibility:hidden} /* .y{display:none} */</style>"
     "<div class='big ad'>no</div><p class=x>no<p class=y>yes<div id=q>no</div><div class=x>too</div>", "yes\n\ntoo"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<select><option>1<option>2</select>", "1\n2"), ("<q>said</q>", "“said”"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td>Fig<td>12</table>after",
     "Name       Qty\nApple pie  3\nFig        12\n\nafter"),
    ("<table><caption>C</caption><td>x</table>", "C\nx"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
    ("<table><tr><td rowspan=2>tall<td>1<tr><td>2</table>", "tall  1\n      2"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tfoot><tr><td>f</tfoot><thead><tr><td>h</thead><tbody><tr><td>b</table>", "h\nb\nf"),
    ("<table><tr><td><table><tr><td>in<td>side</table><td>out</table>", "in  side  out"),
    ("<table><tr style='display:none'><td>no<tr><td hidden>no<td>yes</table>", "yes"),
    ("<p>x<table><td>1</table>y</p>z", "x\n\n1\n\ny\n\nz"),
    ("<p><b>a<br><p>b</b>c", "a\n\nbc"),
    ("a<hr>b", "a\n\nb"), ("<ul></ul><table></table>x", "x"),
])
def test_layout(html, text):
    assert render(html) == text


def test_all_text_of_a_table_is_kept():
    html = "<table>loose<tr>odd<td>cell</td>more</tr><p>para</p></table>"
    assert all(w in render(html) for w in ("loose", "odd", "cell", "more", "para"))


def test_deep_and_long_pages():
    assert render("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert render("<ul><li>" * 3000 + "x").endswith("x")
    text = render("<p>word " * 50_000)
    assert text.count("word") == 50_000
    assert render("<" * 20_000).startswith("<<<")


def test_implied_tags():
    row = build_tree("<table><td>a<td>b").children[0].children[0].children[0].children[0]
    assert row.tag == "tr" and [c.tag for c in row.children] == ["td", "td"]


def test_long_cells_do_not_widen_the_others():
    rows = [f"row{i}<td>value{i}" for i in range(200)]
    page = "<table>" + "".join(f"<tr><td>{r}" for r in rows) + f"<tr><td>{'x ' * 25_000}<td>end</table>"
    text = render(page)
    assert len(text) < 2 * len(page)
    assert text.split("\n")[:2] == ["row0    value0", "row1    value1"]
    assert text.split("\n")[-1] == "x " * 25_000 + " end"
    wide = "<table><tr>" + "".join(f"<td>{'y' * 100}" for _ in range(50)) + "<tr><td>a<td colspan=48><td>b" * 100 + "</table>"
    assert max(map(len, render(wide).split("\n")[1:])) == 401
    assert render("<table><tr><td colspan=2>abc</table>") == "abc"
    assert render(f"<table><tr><td>{'z' * 500}<tr><td>a</table>") == "z" * 500 + "\na"


def test_rows(spark):
    rows = [(1, "<p>a"), (2, None), (3, ""), (1, "<p>a"), (None, "b<br>c")]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 as text", "'x' as n_chars")
    got = sorted((tuple(r) for r in extract_text(df).collect()), key=repr)
    assert got == sorted([(1, "a", 1, 1), (2, "", 0, 0), (3, "", 0, 0), (1, "a", 1, 1), (None, "b\nc", 3, 2)], key=repr)
    assert extract_text(df.limit(0)).count() == 0


def test_visible_words_of_real_pages_are_all_there(spark):
    """Every word between tags outside scripts, styles and the head is in the rendered text."""
    import re
    from html import unescape

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<(script|style)\b.*?</\1>|<!--.*?-->|<title>.*?</title>", " ", r["html"] or "")
        want = unescape(re.sub(r"(?s)<[^>]*(>|\Z)", "\0", body)).replace("\0", " ").split()
        got = set(re.sub(r"(?m)^[\s-]*- ", " ", render(r["html"])).split())
        joined = render(r["html"])
        assert all(w in got or w in joined for w in want)


@pytest.mark.parametrize(("html", "text"), [
    ("<style>@media print { .content { display:none } }</style><p class=content>yes", "yes"),
    ("<style>@media (max-width:600px){.a{display:none}} @media screen and (min-width:50em){.b{display:none}}</style>"
     "<p class=a>yes<p class=b>no", "yes"),
    ("<style media=print>p{display:none}</style><p>yes", "yes"),
    ("<style>@media print{p{color:red} @supports (x:y){.a{display:none}}} .b{display:none}</style><p class=a>yes<p class=b>no", "yes"),
    ("<style>.a{display:none} .a{display:block}</style><p class=a>yes", "yes"),
    ("<style>p.a{display:block} .a{display:none}</style><p class=a>yes<div class=a>no</div>", "yes"),
    ("<style>.a{display:none} .open .a{display:block} div>.b{display:none}</style><div class=open><i><b class=a>yes</b></i></div>"
     "<p class=a>no<p><span class=b>too</span><div><b class=b>no</b></div>", "yes\n\ntoo"),
    ("<style>.a{display:none!important} #x{display:block}</style><p class=a id=x>no<p>yes", "yes"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>yes", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<style>.a:hover{display:none} .b{visibility:hidden} .b{visibility:visible}</style><p class=a>yes<p class=b>too", "yes\n\ntoo"),
    ("a<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><g>no<text x=1>one</text><text>two<tspan>!</tspan></text></g></svg>b",
     "a one two! b"),
    ("<p>area <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation>no</annotation></semantics></math> ok", "area a=2 ok"),
    ("<svg><path d='M0'><p>cut off", "cut off"),
])
def test_text_that_a_screen_shows(html, text):
    assert render(html) == text
