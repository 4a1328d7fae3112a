"""Conversion of single documents: structure, escapes, recovery, and the other output formats."""

import pytest

from quillspan.operators.dom import events, parse, parse_attributes
from quillspan.operators.entities import decode
from quillspan.operators.markdown import to_markdown
from quillspan.operators.options import minimal, options
from quillspan.operators.plain import extract, to_safe_html, to_text, wrap_text
from quillspan.operators.prepare import class_marks, head_metadata, prepare, yaml_scalar
from quillspan.operators.splitter import Split, split_markdown


def md(html, **given):
    o = options(**given)
    return to_markdown(prepare(parse(html), o), o)


CASES = [
    ("<h1>A</h1><p>b</p>", "# A\n\nb"),
    ("<p>a <b>b</b> <i>c</i> <del>d</del></p>", "a **b** *c* ~~d~~"),
    ("<p><b></b>x", "x"),
    ("<p>a<b> b </b>c", "a **b** c"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<ol><li>a<ol><li>b</ol></ol>", "1. a\n   1. b"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
    ("<pre><code class='language-js'>a\n  b</code></pre>", "```js\na\n  b\n```"),
    ("<pre>a ``` b</pre>", "````\na ``` b\n````"),
    ("<p>x <code>a`b</code></p>", "x ``a`b``"),
    ("<a href='/x' title='T'>a</a>", '[a](/x "T")'),
    ("<a href='https://a.example'>https://a.example</a>", "<https://a.example>"),
    ("<a>plain</a>", "plain"),
    ("<img src='a b.png' alt='x'>", "![x](<a b.png>)"),
    ("<img src='data:image/png;base64,xx' alt='x'>", ""),
    ("<table><tr><th align=right>a<th>b<tr><td>1<td>2|3</table>", "| a | b |\n| ---: | --- |\n| 1 | 2\\|3 |"),
    ("<table><tr><td>a<td>b<tr><td>1<td>2<td>3</table>", "| a | b |\n| --- | --- |\n| 1 | 2 3 |"),
    ("<p>a<br>b", "a  \nb"),
    ("a<hr>b", "a\n\n---\n\nb"),
    ("<p>1. x</p><p># y</p><p>- z</p>", "1\\. x\n\n\\# y\n\n\\- z"),
    ("<p>a*b_c[d]</p>", "a\\*b\\_c\\[d]"),
    ("<script>x</script><style>y</style><noscript>z</noscript>a", "a"),
    ("<q>a</q> <sub>b</sub> <kbd>c</kbd>", '"a" <sub>b</sub> `c`'),
    ("<figure><img src=a alt=b><figcaption>c</figcaption></figure>", "![b](a)\n\n*c*"),
    ("<p>a<p>b", "a\n\nb"),
    ("<h3># of items ##</h3><p>#17 open</p><p>one - two</p>", "### # of items \\##\n\n#17 open\n\none - two"),
    ("<p>---</p>", "\\---"),
    ("<p>&amp;copy; &emsp; &amp;emsp;", "\\&copy; &emsp; &emsp;"),
    ("<li><b>sum<br></b><p>More", "- **sum  \n  **\n\n  More"),
    ("<p><b><i>left </i></b>right</p>", "***left*** right"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"),
    ("<a href=/one rel=x href=/two>go</a>", "[go](/one)"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "expected"), CASES)
def test_markdown(html, expected):
    assert md(html) == expected


def test_implied_end_tags_and_nesting():
    assert md("<p><b>T<br><p>X") == "**T  \n**\n\nX"
    assert md("<a href=/1>a<a href=/2>b</a>") == "[a](/1) [b](/2)"
    assert md("</div><p>a</span>b</p>") == "ab"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert md(deep) == "x"


def test_references():
    assert decode("&amp;&copy &#x41;&#0;&#150;&emsp;&nope;") == "&© A�–&emsp;&nope;"
    assert decode("?a=1&copy=2", attribute=True) == "?a=1&copy=2"
    assert parse_attributes(' A="1" a=2 b c=\'x y\' d=z') == {"a": "1", "b": "", "c": "x y", "d": "z"}


def test_clean_rules():
    assert md('<a href="#x">a</a>', clean=frozenset({"empty_links"})) == "[a](#x)"
    assert md('<a href="javascript:x">a</a>', clean=frozenset({"empty_links"})) == "a"
    assert md('<h2>One two</h2><a href="#one-two">a</a> <a href="#gone">b</a>', clean=frozenset({"fragments"})) == "## One two\n\n[a](#one-two) b"
    assert md('<a href="/x?utm_source=a&b=1">x</a>', clean=frozenset({"urls"})) == "[x](/x?b=1)"
    with pytest.raises(ValueError, match="unknown"):
        options(cleaned=True)


def test_filters_and_main_content():
    html = "<nav>n</nav><main><h1>A</h1><p class=ad>x</p><p style='display: none'>h</p></main><footer>f</footer>"
    assert md(html, isolate_main=True, exclude=(".ad",)) == "# A"
    assert md(html, include=("nav",)) == "n"
    assert md("<header><h1>S</h1></header><h2>T</h2><p>a</p><footer>f</footer>", isolate_main=True) == "## T\n\na"
    o = minimal()
    page = "<head><title>T: x</title><meta name=description content='d e'></head><body><nav>n</nav><h1>H</h1><p>a</p></body>"
    root = parse(page)
    assert head_metadata(root) == {"title": "T: x", "description": "d e"}
    assert to_markdown(prepare(root, o), o) == "# H\n\na"
    assert class_marks("font-normal md:font-bold italic sm:hidden") == ("***", "***", True)
    assert yaml_scalar("a: b") == '"a: b"' and yaml_scalar("plain") == "plain" and yaml_scalar("12") == '"12"'


def test_class_marks_on_blocks():
    assert md('a<p class="font-bold italic">b</p>c', tailwind=True) == "a\n\n***b***\n\nc"


def test_wrap():
    assert md("<p>aaa bbb ccc ddd", wrap_width=7) == "aaa bbb\nccc ddd"
    assert wrap_text("aaa bbb ccc", 7) == "aaa bbb\nccc"


def test_text_and_safe_html():
    assert to_text(parse("<h1>A</h1><p>b <q>c</q><br>d<table><tr><td>1<td>2</table>"), options()) == 'A\n\nb "c"\nd\n\n1\t2'
    safe = to_safe_html(parse("<h2 onclick=x>A b</h2><b>c</b><script>x</script><a href='javascript:x'>d</a><a href=/y class=z>e &amp; f</a>"), options(origin="https://a.example"))
    assert safe == '<h2 id="a-b">A b</h2><strong>c</strong>d<a href="https://a.example/y">e &amp; f</a>'


def test_extract_and_events():
    got = extract(parse("<p class='a b'>x <i>y</i></p><p>z"), ("p.a", "i", "[class~=b]"))
    assert [(s, t, x) for s, t, x, _ in got] == [("i", "i", "y"), ("p.a", "p", "x y"), ("[class~=b]", "p", "x y")]
    kinds = [e[1] for e in events("<p>a<b>c</b></p>")]
    assert kinds == [0, 2, 0, 2, 1, 1]


def test_splitter():
    text = "# T\n\nintro\n\n## A\n\n" + "word " * 300 + "\n\n## B\n\n```py\nx = 1\n```\n"
    chunks = split_markdown(text, Split(size=400, overlap=50))
    assert all(len(c[1]) <= 400 for c in chunks)
    assert chunks[-1][2] == {"h1": "T", "h2": "B"} and chunks[-1][3] == "py"
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert split_markdown("", Split()) == [] and split_markdown(None, Split()) == []
    with pytest.raises(ValueError, match="overlap"):
        Split(size=10, overlap=10)
