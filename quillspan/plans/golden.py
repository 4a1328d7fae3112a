"""Hand-worked cases of the kernel: for each operator, inputs and the results that its rules give.

Each operator is a query over its inputs; the SQL that checks it is the literal table of results.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.convert import convert, html_events, split_texts
from quillspan.operators.dom import Node
from quillspan.operators.incremental import Converter
from quillspan.operators.markdown import plain_heading
from quillspan.operators.options import Options, Override, minimal, options
from quillspan.operators.plain import wrap_text
from quillspan.operators.prepare import Plugin
from quillspan.operators.selectors import matcher
from quillspan.operators.splitter import Split

QUERIES: dict[str, Callable] = {}
INPUTS: list[str] = []  # of all cases
ORACLE: dict[str, str] = {}


def _text(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def literal_table(rows: list[tuple], columns: str) -> str:
    """SQL of a table of texts and integers."""
    values = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _text(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS t({columns})"


def golden(name: str, cases: list[tuple[str, str]], output: str = "markdown", o: Options = Options(), hooks: tuple = ()) -> None:
    """A query ``name`` that converts the first of each case; its SQL has the second."""
    inputs = [(n, html) for n, (html, _) in enumerate(cases)]
    INPUTS.extend(html for html, _ in cases)

    def run(spark, d) -> DataFrame:
        df = spark.createDataFrame(inputs, "n int, html string")
        return convert(df, ["n"], outputs=(output,), o=o, hooks=hooks).withColumnRenamed(output, "result")

    QUERIES[name] = run
    ORACLE[name] = literal_table([(n, want) for n, (_, want) in enumerate(cases)], "n, result")


def _several(name: str, *parts: tuple) -> None:
    """A query of several option sets: each part is (cases, output, options)."""
    runs, sql = [], []
    for k, (cases, output, o) in enumerate(parts):
        golden(f"{name}__{k}", cases, output, o)
        runs.append(QUERIES.pop(f"{name}__{k}"))
        sql.append(f"SELECT {k} AS part, n, result FROM ({ORACLE.pop(f'{name}__{k}')})")

    def run(spark, d) -> DataFrame:
        out = None
        for k, one in enumerate(runs):
            df = one(spark, d).select(F.lit(k).alias("part"), "n", "result")
            out = df if out is None else out.union(df)
        return out

    QUERIES[name] = run
    ORACLE[name] = " UNION ALL ".join(sql)


# the parser --------------------------------------------------------------------

golden("html_p01_tokens", [("<p>1 < 2 and 3<4 <b>x</b>", "1 < 2 and 3<4 **x**"), ("<P CLASS=a>Hi</P >there", "Hi\n\nthere"), ("plain words", "plain words")])
golden("html_p02_white_space", [("<p>a \t\n\f b</p>", "a b"), ("<pre>a  b\n c</pre>", "```\na  b\n c\n```"), ("x  y", "x  y")])
golden("html_p03_text_nodes", [("<div>  <p>  one</p>  <p>two  </p> </div>", "one\n\ntwo"), ("  <b> x</b>", "**x**"), ("<p>a<span> </span>b</p>", "a b")])
golden("html_p04_references_in_text", [("&lt;tag&gt; &eacute;&copy &#8364;&#x41;", "\\<tag> é© €A"), ("&#128;&#0;&#xD800;", "€��"), ("&unknown; &emsp;|", "&unknown; &emsp;|")])
golden("html_p05_references_in_attributes", [('<a href="/?a=1&copy=2&amp;b">x</a>', "[x](/?a=1&copy=2&b)"), ('<a href="/&copy;">x</a>', "[x](/©)")])
golden("html_p06_ampersand_kept", [("<p>&amp;lt; and &amp;nothing</p>", "\\&lt; and &nothing"), ("<pre>&amp;lt;</pre>", "```\n&lt;\n```")])
golden("html_p07_attributes", [("<a HREF=/x TITLE='a b' href=/y>t</a>", '[t](/x "a b")'), ("<a href = \"/q\" disabled>t</a>", "[t](/q)"), ("<a href=''>t</a>", "[t]()")])
golden("html_p08_comments", [("a<!-- x -- > y -->b", "ab"), ("a<!-->b", "ab"), ("a<!--->b", "ab"), ("a<!-- x --!>b", "ab"), ("<!DOCTYPE html>a", "a"), ("a<?php x ?>b", "ab")])
_several("html_p09_cdata", ([("a<![CDATA[ <b>x</b> ]]>c", "ac")], "markdown", Options()), ([("a <![CDATA[<i>raw</i>]]> c", "a [\\<i>raw\\</i>] c")], "markdown", options(overrides={"#cdata-section": ("[", "]")})))
golden("html_p10_scripts", [("a<script>if (x < '</b>') y</script>b", "ab"), ("a<script><!-- <script> </script> --></script>b", "ab"), ("a<script>never closed <p>b", "a")])
golden("html_p11_raw_text", [("<style>p > a {}</style>x", "x"), ("<textarea>a <b>b</textarea>", "a \\<b>b"), ("<noscript><p>no</p></noscript>yes", "yes"), ("<iframe>in</iframe>out", "out")])
golden("html_p12_void", [("a<br>b<br/>c", "a  \nb  \nc"), ("<img src=/i.png alt=i>t", "![i](/i.png)t"), ("<p>a<wbr>b</p>", "ab")])
golden("html_p13_implied_p", [("<p>one<p>two", "one\n\ntwo"), ("<p>one<div>two</div>", "one\n\ntwo"), ("<p>one<ul><li>two</ul>", "one\n\n- two")])
golden("html_p14_implied_items", [("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c")])
golden("html_p15_implied_cells", [("<table><tr><th>A<th>B<tr><td>1<td>2</table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"), ("<table><thead><tr><th>A<tbody><tr><td>1</table>", "| A |\n| --- |\n| 1 |")])
golden("html_p16_nested_anchor", [("<p><a href=/1>one <a href=/2>two</a></p>", "[one](/1) [two](/2)")])
golden("html_p17_headings", [("<h2>one<h3>two</h3>", "## one\n\n### two"), ("<h1>a</h1><h2>b", "# a\n\n## b")])
golden("html_p18_options", [("<select><option>a<option>b</select>", "ab"), ("<select><optgroup><option>a<optgroup><option>b</select>c", "abc")], "markdown")
golden("html_p19_head", [("<head><title>t</title><p>body</p>", "body"), ("<html><head><meta charset=x>text<body>more", "textmore")])
golden("html_p20_end_tags", [("<p>a</b>b</p>", "ab"), ("<div><b>x</div>y", "**x**\n\ny"), ("a</p>b", "ab")])
golden("html_p21_template", [("a<template><p>x</p></template>b", "ab"), ("<template><script>1</script></template>z", "z")])
golden("html_p22_depth", [("<pre>" + "<i>" * 600 + "x" + "</i>" * 595 + "y</pre>z", "```\nxy\n```\n\nz"), ("<div>" * 700 + "deep" + "</div>" * 700 + "top", "deep\n\ntop")])
golden("html_p23_empty_links", [('<a href=/x title="T t"></a>', "[T t](/x)"), ('<a href=/x aria-label=L></a>', "[L](/x)"), ("<a href=/x></a>", "[](/x)")])
golden("html_p24_end_of_input", [("<p>a<b>b", "a**b**"), ("<p>a<b class=", "a"), ("a<", "a<"), ("", "")])


def html_p25_events(spark, d) -> DataFrame:
    """The event relation of two documents."""
    df = spark.createDataFrame([(1, "<p id=a>x<br>y</p>"), (2, "t<b></b>")], "k int, html string")
    return html_events(df, "k").select("k", "seq", F.col("ev").cast("int").alias("ev"), "node_id", "parent_id", "tag", F.col("attrs")["id"].alias("id"), "text")


QUERIES["html_p25_events"] = html_p25_events
ORACLE["html_p25_events"] = literal_table(
    [
        (1, 0, 0, 0, -1, "p", "a", None), (1, 1, 2, 1, 0, None, None, "x"), (1, 2, 0, 2, 0, "br", None, None), (1, 3, 1, 2, -1, "br", None, None),
        (1, 4, 2, 3, 0, None, None, "y"), (1, 5, 1, 0, -1, "p", None, None), (2, 0, 2, 0, -1, None, None, "t"), (2, 1, 0, 1, -1, "b", None, None), (2, 2, 1, 1, -1, "b", None, None),
    ],
    "k, seq, ev, node_id, parent_id, tag, id, text",
)

# tags of the Markdown renderer ---------------------------------------------------

golden("md_m01_headings", [("<h1>A</h1><h6>B</h6>", "# A\n\n###### B"), ("<a href=/x><h2>A</h2></a>", "[<h2>A</h2>](/x)"), ("<h2>C#</h2>", "## C\\#"), ("<h3></h3>x", "x")])
golden("md_m02_strong", [("<b>a</b> <strong>b</strong>", "**a** **b**"), ("<b>a<strong>b</strong></b>", "**ab**")])
golden("md_m03_em", [("<i>a</i> <em>b</em>", "*a* *b*"), ("<em>a <b>b</b></em>", "*a **b***")])
golden("md_m04_del", [("<del>a</del> <s>b</s> <strike>c</strike>", "~~a~~ ~~b~~ ~~c~~")])
golden("md_m05_kept_tags", [("H<sub>2</sub>O x<sup>2</sup>", "H<sub>2</sub>O x<sup>2</sup>"), ("<ins>a</ins><u>b</u><mark>c</mark>", "<ins>a</ins><u>b</u><mark>c</mark>")])
golden("md_m06_code", [("<code>a</code>", "`a`"), ("<code>a`b</code>", "``a`b``"), ("<code>`a</code>", "`` `a ``"), ("<table><tr><td><code>a|b</code></table>", "| `a\\|b` |\n| --- |"), ("<code>a<code>b</code></code>", "`ab`")])
golden("md_m07_kbd", [("<kbd>Esc</kbd> <samp>out</samp> <var>x</var>", "`Esc` `out` `x`")])
golden("md_m08_pre", [("<pre><code class=language-py>a = 1\n</code></pre>", "```py\na = 1\n```"), ("<pre>```\n</pre>", "````\n```\n````"), ("<pre> </pre>x", "x"), ("<table><tr><td><pre>a\nb</pre></table>", "| <pre>a<br>b</pre> |\n| --- |")])
golden("md_m09_language", [('<pre><code class="hl language-c++ x">a</code></pre>', "```c++\na\n```"), ('<pre><code class="py">a</code></pre>', "```\na\n```"), ("<pre class=language-sh>a</pre>", "```sh\na\n```")])
golden("md_m10_blockquote", [("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"), ("<blockquote>a<blockquote>b</blockquote></blockquote>", "> a\n>\n> > b"), ("<blockquote> </blockquote>x", "x"), ("<ul><li>a<blockquote>b</blockquote></ul>", "- a\n\n  > b")])
golden("md_m11_lists", [("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"), ("<ul><li>a<ol><li>b</ol></ul>", "- a\n  1. b"), ("<table><tr><td><ul><li>a</ul></table>", "| <ul><li>a</li></ul> |\n| --- |"), ("<ol start=9999999999><li>a</ol>", "1. a")])
golden("md_m12_empty_item", [("<ul><li>a<ul><li></li></ul></li></ul>", "- a\n\n  -"), ("<ul><li></li><li>b</li></ul>", "-\n- b"), ("<p>a</p><ul><li></ul>", "a\n\n-")])
golden("md_m13_links", [("<a href=/x>t</a>", "[t](/x)"), ('<a href="https://e.org/a">https://e.org/a</a>', "<https://e.org/a>"), ("<a>t</a>", "t"), ('<a href="mailto:a@e.org">mailto:a@e.org</a>', "<mailto:a@e.org>"), ('<a href=/x title="a">t</a>', '[t](/x "a")')])
golden("md_m14_destinations", [('<a href="/a b">t</a>', "[t](</a b>)"), ('<a href="/a(b)">t</a>', "[t](</a(b)>)"), ('<a href="/x" title=\'say "hi"\'>t</a>', '[t](/x "say \\"hi\\"")'), ('<img src=/i alt="a*b_[c]~`&lt;&amp;">', "![a\\*b\\_\\[c\\]\\~\\`\\<\\&](/i)")])
golden("md_m15_images", [('<img src=/i.png alt="an i" title=T>', '![an i](/i.png "T")'), ('<img src="data:image/png;base64,x" alt=a>b', "b"), ("<img src=/i.png>", "![](/i.png)")])
golden("md_m16_tables", [("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", "| a |\n| --- |\n| b |"), ("<table><tbody><tr><td>a</table>x", "| a |\n| --- |\n\nx"), ("<table><tr><td><table><tr><td>a</td></tr></table></td></tr></table>", "| <table><tr><td>a</td></tr></table> |\n| --- |"), ("<table></table>x", "x")])
golden("md_m17_alignment", [("<table><tr><th align=left>a<th align=center>b<th align=right>c<th>d</table>", "| a | b | c | d |\n| :--- | :---: | ---: | --- |")])
golden("md_m18_cells", [("<table><tr><th colspan=2>a<th>b<tr><td>1<td>2<td>3<td>4</table>", "| a |  | b |\n| --- | --- | --- |\n| 1 | 2 | 3 4 |"), ("<table><tr><td>a|b</table>", "| a\\|b |\n| --- |")])
golden("md_m19_caption", [("<table><caption>Cap</caption><tr><td>a</table>", "Cap\n\n| a |\n| --- |"), ("<ul><li>x<table><caption>Cap</caption><tr><td>a</table></ul>", "- x\n\n  Cap\n\n  | a |\n  | --- |")])
golden("md_m20_br", [("a<br>b", "a  \nb"), ("<h2>a<br>b</h2>", "## a<br>b"), ("<pre>a<br>b</pre>", "```\na\nb\n```"), ("<table><tr><td>a<br>b</table>", "| a<br>b |\n| --- |"), ("<blockquote>a<br>b</blockquote>", "> a  \n> b")])
golden("md_m21_hr", [("a<hr>b", "a\n\n---\n\nb"), ("<ul><li><hr></ul>", "- ***"), ("<table><tr><td>a<hr>b</table>", "| a<hr>b |\n| --- |")])
golden("md_m22_blocks", [("<div>a</div><section>b</section><article>c</article>", "a\n\nb\n\nc"), ("<header>a</header><main>b</main><nav>c</nav>", "a\n\nb\n\nc"), ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b")])
golden("md_m23_inline", [("<span>a</span><small>b</small><abbr>c</abbr><time>d</time>", "abcd"), ("<ruby>a<rt>b</rt></ruby><label>c</label><button>d</button>", "abcd")])
golden("md_m24_quotes", [("<q>a</q> <cite>b</cite> <dfn>c</dfn>", '"a" *b* **c**')])
golden("md_m25_kept_blocks", [("<details><summary>S</summary>a < b</details>", "<details><summary>S</summary>\n\na &lt; b</details>"), ("<address>a</address>", "<address>a</address>"), ("<dl><dt>a<dd>b</dl>", "<dl><dt>a</dt>\n<dd>b</dd>\n</dl>"), ('<details><a href="/x?a=1&amp;b" title=t>a[b]</a></details>', '<details><a href="/x?a=1&amp;b" title="t">a&#91;b&#93;</a></details>')])
golden("md_m26_figcaption", [("<figure><img src=/i alt=a><figcaption>Cap</figcaption></figure>", "![a](/i)\n\n*Cap*"), ("<figure>a<figcaption> </figcaption></figure>", "a"), ("<figure><figcaption><em>a</em> b</figcaption></figure>", "*a b*")])
golden("md_m27_center", [("<center>a</center>", "a"), ("<table><tr><td><table><tr><td><center>a</center></td></tr></table></td></tr></table>", "| <table><tr><td><center>a</center></td></tr></table> |\n| --- |")])
golden("md_m28_silent", [("<title>t</title><script>s</script><style>c</style>x<noscript>n</noscript><datalist><option>o</datalist>", "x"), ("<noembed>a</noembed><noframes>b</noframes>c", "c")])
golden("md_m29_passing", [("<form><fieldset><legend>a</legend><select><option>b</select></fieldset></form>", "ab"), ("<svg>a</svg><video>b</video><footer>c</footer><aside>d</aside>", "abcd"), ("<map>a<area>b</map><dialog>c</dialog>", "abc")])
golden("md_m30_unknown", [("<my-tag>a</my-tag><x:y>b</x:y>", "ab")])

# text of the Markdown renderer ------------------------------------------------------

golden("md_t01_escapes", [("a*b_c~d`e[f\\g", "a\\*b\\_c\\~d\\`e\\[f\\\\g"), ("<p># a</p><p>- b</p><p>1. c</p><p>+ d</p><p>> e</p>", "\\# a\n\n\\- b\n\n1\\. c\n\n\\+ d\n\n\\> e"), ("<a href=/x>a]b</a>", "[a\\]b](/x)"), ("&lt;b> &lt;3", "\\<b> <3")])
golden("md_t02_plain_text", [("nothing to escape: a.b, c!", "nothing to escape: a.b, c!"), ("a - b + c # d", "a - b + c # d")])
golden("md_t03_raw_html_text", [("<address>a & b < c</address>", "<address>a &amp; b &lt; c</address>"), ("<table><tr><td><dl><dt>a|b</dl></table>", "| <dl><dt>a&#124;b</dt></dl> |\n| --- |"), ("<a href=/x><address>[a]</address></a>", "[<address>&#91;a&#93;</address>](/x)")])
golden("md_t04_pre_in_cells", [("<table><tr><td><pre><code>a|b\n&lt;c></code></pre></table>", "| <pre><code>a&#124;b<br>&lt;c&gt;</code></pre> |\n| --- |")])
golden("md_t05_block_spacing", [("<div>a<p>b</p></div><div><div>c</div></div>", "a\n\nb\n\nc"), ("<ul><li><div>a</div></ul><p>b</p>", "- a\n\nb"), ("<h2><p>a</p></h2>b", "## a\n\nb"), ("<p>a</p>\n\n\n<p>b</p>", "a\n\nb")])
golden("md_t06_inline_spacing", [("<a href=/1>a</a><a href=/2>b</a>", "[a](/1) [b](/2)"), ("<code>a</code><code>b</code>", "`a` `b`"), ("<b>a</b>, b", "**a**, b"), ("a<b> b</b>c", "a **b**c")])
golden("md_t07_empty_pairs", [("a<b></b>b", "ab"), ("a <i> </i> b", "a b"), ("<del></del><code></code>x", "x")])
golden("md_t08_edges", [("<p>a </p> <p> b</p>", "a\n\nb"), ("<p><b>a </b>b</p>", "**a** b"), ("<p>a <br> b</p>", "a  \nb")])
golden("md_t09_continuation", [("<blockquote><ul><li>a<br>b</ul></blockquote>", "> - a  \n>   b"), ("<ol><li>a<ul><li>b<br>c</ul></ol>", "1. a\n   - b  \n     c")])
golden("md_t10_open_prefix", [("<ul><li>a<pre>x</pre></ul>", "- a\n\n  ```\n  x\n  ```"), ("<blockquote><h2>a</h2><ul><li>b</ul></blockquote>", "> ## a\n>\n> - b"), ("<ul><li><h3>a</h3>b</ul>", "- ### a\n\n  b")])
golden("md_t11_wrap", [("<p>aaa bbb ccc</p>", "aaa bbb\nccc"), ("<p>abcdefghijkl mn</p>", "abcdefghijkl\nmn"), ("<blockquote>aaa bbb</blockquote>", "> aaa\n> bbb"), ("<ul><li>aaa bbb</ul>", "- aaa\n  bbb"), ("<h2>aaa bbb ccc</h2>", "## aaa bbb ccc"), ("<pre>aaa bbb ccc</pre>", "```\naaa bbb ccc\n```")], o=options(wrap_width=7))
golden("md_t12_no_marks_in_pre", [("<pre><b>a</b> <i>b</i> <a href=/x>c</a></pre>", "```\na b c\n```"), ("<pre><code>a <strong>b</strong></code></pre>", "```\na b\n```")])
golden("md_t13_final_trim", [(" \u0085 a \n", "a"), ("\x1ca", "\x1ca"), ("a ", "a ")])

# other formats ------------------------------------------------------------------------

golden("text_f01_text", [("<h1>A</h1><p>b <b>c</b></p>", "A\n\nb c"), ("a<br>b", "a\nb"), ("<img src=/i alt=pic> <img src=/j title=t> <img src=/k>", "pic t /k"), ("<pre>a  b</pre>", "a  b"), ("<script>x</script>y", "y")], "text")
golden("text_f02_spacing", [("<ul><li>a<li>b</ul><p>c</p>", "a\nb\n\nc"), ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", "a\tb\nc\td"), ("<dl><dt>a<dd>b</dl>", "a\nb"), ("<ul><li>a<ul><li>b</ul></ul>", "a\nb")], "text")
golden("text_f03_wrap", [("<p>aaa bbb ccc</p>", "aaa bbb\nccc"), ("<p>äöü äöü x</p>", "äöü äöü\nx")], "text", options(wrap_width=7))
golden("text_f04_figcaption", [("<figure><img src=/i alt=a><figcaption>Cap</figcaption></figure>b", "a\n\nCap\n\nb"), ("<figure>a<figcaption> </figcaption></figure>b", "a\n\nb")], "text")
golden("text_f05_q", [("say <q>a</q>", 'say "a"'), ("say <q> </q>x", "say x")], "text")
golden("safe_f06_html", [("<b>a</b><i>b</i><s>c</s><div onclick=x>d</div><script>e</script>", "<strong>a</strong><em>b</em><del>c</del>d"), ("<p style=x>a &amp; b</p>", "<p>a &amp; b</p>")], "safe_html")
golden("safe_f07_heading_ids", [("<h2 id=x>Héllo, World 2</h2>", '<h2 id="hllo-world-2">Héllo, World 2</h2>'), ("<h3>!</h3>", "<h3>!</h3>")], "safe_html")
golden("safe_f08_attributes", [("<ol start=3><li>a</li></ol>", '<ol start="3"><li>a</li></ol>'), ('<code class="x language-js">a</code>', '<code class="language-js">a</code>'), ("<table><tr><th align=right colspan=2 width=9>a</th></tr></table>", '<table><tr><th colspan="2" align="right">a</th></tr></table>')], "safe_html")
golden("safe_f09_urls", [('<a href="javascript:x">a</a>', "a"), ('<a href="java\tscript:x">a</a>', "a"), ('<a href="tel:1">a</a>', '<a href="tel:1">a</a>'), ('<img src="ftp://e.org/x" alt=a>b', "b"), ('<a href="/x">a</a>', '<a href="/x">a</a>')], "safe_html")

# urls, filters, metadata -----------------------------------------------------------------

_several(
    "url_u01_resolve",
    ([("<a href=../b?c#d>x</a>", "[x](https://e.org/docs/b?c#d)"), ("<a href=/b/./c/../d>x</a>", "[x](https://e.org/b/d)"), ("<a href=//h/x>x</a>", "[x](https://h/x)"), ("<a href=#f>x</a>", "[x](#f)"), ("<a href=b>x</a>", "[x](https://e.org/docs/a/b)"), ("<a href=ftp://h>x</a>", "[x](ftp://h)")], "markdown", options(origin="https://e.org/docs/a/page")),
    ([("<a href=/b>x</a>", "[x](/base/b)")], "markdown", options(origin="/base")),
)
golden("filter_q02_exclude", [("<nav>a</nav><div class=ad>b<p>c</p></div><p id=keep>d</p>", "d"), ("<p>x</p>", "x")], o=options(exclude=("nav", ".ad")))
golden("filter_q03_hidden", [("<p hidden>a</p><p style='display: none'>b</p><p style=visibility:hidden>c</p><p hidden=until-found>d</p>", "d"), ("<p style=position:fixed>a</p>b", "b")], o=options(exclude=("nav",)))
_several("filter_q04_include", ([("<p>a</p><main><p>b <i>c</i></p></main>d", "b *c*")], "markdown", options(include=("main",))), ([("<div class=x>a<p>b</p></div>c", "a")], "markdown", options(include=(".x",), process_children=False)))
golden("filter_q05_isolate_main", [("<p>a</p><main><p>b</p></main><p>c</p>", "b"), ("<header><h1>s</h1></header>x<h2>t</h2><p>b</p><footer>f</footer>", "## t\n\nb"), ("<p>a</p>", "a")], o=options(isolate_main=True))
golden("filter_q06_classes", [("<span class=font-bold>a</span> <span class=italic>b</span> <span class=line-through>c</span>", "**a** *b* ~~c~~"), ("<p class='hidden md:block'>a</p><p class=absolute>b</p>", "a"), ("<span class='font-bold md:font-normal'>a</span>", "a"), ("<span class='underline italic font-semibold'>a</span>", "***~~a~~***")], o=options(tailwind=True))
_several(
    "meta_q07_frontmatter",
    ([("<head><title>A: b</title><meta name=description content=d><meta property=og:title content='o t'></head>x", '---\ntitle: "A: b"\nmeta:\n  description: d\n  "og:title": "o t"\n---\n\nx'), ("<p>x</p>", "x")], "markdown", options(frontmatter=True)),
    ([("<head><title>T</title></head>x", "---\ntitle: T\nlayout: doc\n---\n\nx")], "markdown", options(frontmatter=True, additional_fields={"layout": "doc", "title": "no"})),
)
golden("meta_q08_yaml", [(f"<head><title>{x}</title></head>", f"---\ntitle: {y}\n---") for x, y in (("plain", "plain"), ("a b", '"a b"'), ("yes", '"yes"'), ("12", '"12"'), ("2024-01-02", '"2024-01-02"'), ("a\\b:c", '"a\\\\b:c"'), ("[x]", '"[x]"'))], o=options(frontmatter=True))
_several(
    "tags_q10_overrides",
    ([("a <mark>b</mark>", "a ==b=="), ("<x-note>c</x-note>d", "!c!\n\nd"), ("<x-b>e</x-b>", "**e**"), ("f<x-void>g", "f[v]g")], "markdown",
     options(overrides={"mark": Override("==", "==", inline=True), "x-note": Override("!", "!", spacing=(2, 2)), "x-b": "strong", "x-void": Override("[v]", self_closing=True, inline=True)})),
)
golden("preset_q12_minimal", [("<head><title>T</title></head><nav>n</nav><main><h1>H</h1><p>a <a href='#'>b</a></p><form>f</form></main><footer>g</footer>", "---\ntitle: T\n---\n\n# H\n\na b"), ("<h1>A</h1><img src=/i><p class=hidden>x</p>", "# A")], o=minimal())

# clean rules ------------------------------------------------------------------------------

golden("clean_c01_urls", [("<a href='/x?utm_source=a&b=1&fbclid=c#d'>t</a>", "[t](/x?b=1#d)"), ("<a href='/x?utm_a=1'>t</a>", "[t](/x)"), ("<a href='/x#y?utm_a=1'>t</a>", "[t](/x#y?utm_a=1)")], o=options(clean=frozenset({"urls"})))
golden("clean_c02_fragments", [("<h2>My part</h2><a href=#my-part>a</a> <a href=#gone>b</a>", "## My part\n\n[a](#my-part) b"), ("<pre>[a](#x)</pre>", "```\n[a](#x)\n```")], o=options(clean=frozenset({"fragments"})))
golden("clean_c03_empty_links", [("<a href='#'>a</a> <a href='javascript:x'>b</a> <a href=/c>c</a>", "a b [c](/c)")], o=options(clean=frozenset({"empty_links"})))
golden("clean_c04_empty_link_text", [("a <a href=/x></a>b <a href=/y>c</a>", "a b [c](/y)")], o=options(clean=frozenset({"empty_link_text"})))
golden("clean_c05_empty_images", [("<img src=/i>a<img src=/j alt=b>", "a![b](/j)")], o=options(clean=frozenset({"empty_images"})))
golden("clean_c06_redundant_links", [("<a href='https://e.org/'>https://e.org/</a> <a href=/x>y</a>", "https://e.org/ [y](/x)")], o=options(clean=frozenset({"redundant_links"})))
golden("clean_c07_heading_links", [("<h2><a href=#a>A</a></h2><p><a href=#a>b</a>", "## A\n\n[b](#a)")], o=options(clean=frozenset({"self_link_headings"})))
golden("clean_c08_order", [("<h2><a href=#x></a>T<a href=#t>#</a></h2><a href=#t>t</a> <a href=#u>u</a>", "## T\\#\n\n[t](#t) u")], o=options(clean=True))


# the splitter --------------------------------------------------------------------------------


def split_case(name: str, cases: list[tuple[str, list[tuple[str, str | None, int, int]]]], split: Split) -> None:
    """A query over Markdown texts; the results of each are (content, code, first line, last line)."""
    inputs = [(n, md) for n, (md, _) in enumerate(cases)]

    def run(spark, d) -> DataFrame:
        out = split_texts(spark.createDataFrame(inputs, "n int, md string"), ["n"], "md", split)
        return out.select("n", "chunk_no", "content", F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"), "code", "line_from", "line_to")

    rows = [(n, k, *x) for n, (_, chunks) in enumerate(cases) for k, x in enumerate(chunks)]
    QUERIES[name] = run
    ORACLE[name] = literal_table(rows, "n, chunk_no, content, headers, code, line_from, line_to")


_DOC = "# T\n\nintro\n\n## A\n\none\n\n## B\n\ntwo"
split_case("split_k02_markdown", [(_DOC, [("intro\n\n\none", "h1=T;h2=A", None, 1, 7), ("two", "h1=T;h2=B", None, 9, 11)]), ("---\ntitle: x\n---\nbody", [("body", "", None, 4, 4)])], Split())
split_case("split_k03_sections", [("## A\na\n\n---\n\nb\n\n## A2\nc", [("a", "h2=A", None, 1, 2), ("b", "h2=A", None, 6, 6), ("c", "h2=A2", None, 8, 9)])], Split())
split_case("split_k04_hierarchy", [("## A\na\n### B\nb\n## C\nc", [("a\nb", "h2=A;h3=B", None, 1, 4), ("c", "h2=C", None, 5, 6)])], Split())
split_case("split_k05_size", [("aaaa bbbb\n\ncccc dddd", [("aaaa bbbb", "", None, 1, 1), ("cccc dddd", "", None, 3, 3)]), ("abcdefghijklmnop qr", [("abcdefghijklmnop", "", None, 1, 1), ("qr", "", None, 1, 1)])], Split(size=12, overlap=0))
split_case("split_k06_overlap", [("aa bb cc dd ee", [("aa bb cc", "", None, 1, 1), ("cc dd ee", "", None, 1, 1)])], Split(size=9, overlap=4))
split_case("split_k07_length", [("a b c d e f", [("a b", "", None, 1, 1), ("c d", "", None, 1, 1), ("e f", "", None, 1, 1)])], Split(size=2, overlap=0, length=lambda s: len(s.split())))
split_case("split_k08_code", [("x\n\n```py\na b c d\ne\n```\n\ny", [("x", "", None, 1, 1), ("```py\na b c d\ne\n```", "", "py", 3, 6), ("y", "", None, 8, 8)])], Split(size=8, overlap=0))
split_case("split_k09_headers", [("## A\n\na\n\n### B\nb", [("## A\n\na\n\n### B\nb", "h2=A;h3=B", None, 1, 6)])], Split(strip_headers=False))
split_case("split_k10_lines", [("\n\nfirst\n\n## A\nx\n## B\n\n\ny\n", [("first\n\nx", "h2=A", None, 3, 6), ("y", "h2=B", None, 7, 10)])], Split())
split_case("split_k11_language", [("```js\na\n```\n\n```py\nb\n```", [("```js\na\n```\n\n```py\nb\n```", "", "js", 1, 7)])], Split())
split_case("split_k12_each_line", [("## A\na\n\nb", [("a", "h2=A", None, 1, 4), ("b", "h2=A", None, 1, 4)])], Split(each_line=True))


def split_k01_html(spark, d) -> DataFrame:
    """HTML to chunks."""
    df = spark.createDataFrame([(0, "<h2>A</h2><p>one</p><h2>B</h2><pre><code class=language-c>x</code></pre>")], "n int, html string")
    out = convert(df, ["n"], outputs=("chunks",)).select("n", F.explode("chunks").alias("c"))
    return out.select("n", "c.chunk_no", "c.content", F.col("c.headers")["h2"].alias("h2"), "c.code", "c.line_from", "c.line_to")


QUERIES["split_k01_html"] = split_k01_html
ORACLE["split_k01_html"] = literal_table([(0, 0, "one", "A", None, 1, 3), (0, 1, "```c\nx\n```", "B", "c", 5, 9)], "n, chunk_no, content, h2, code, line_from, line_to")


def split_k13_validation(spark, d) -> DataFrame:
    """Whether option sets of the splitter are taken."""

    def taken(**given) -> bool:
        try:
            Split(**given)
        except ValueError:
            return False
        return True

    sets = [{}, {"size": 10, "overlap": 10}, {"size": 0, "overlap": 0}, {"levels": (1, 6)}, {"levels": (0,)}, {"levels": (7,)}, {"overlap": -1}]
    return spark.createDataFrame([(n, taken(**x)) for n, x in enumerate(sets)], "n int, taken boolean")


QUERIES["split_k13_validation"] = split_k13_validation
ORACLE["split_k13_validation"] = "SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, true), (4, false), (5, false), (6, false)) AS t(n, taken)"


# hooks, extraction, limits -----------------------------------------------------------------------


class _Marks(Plugin):
    """Skips ``aside``, names links, brackets notes, and shouts in strong text."""

    def process_attributes(self, n: Node) -> None:
        if n.tag == "a":
            n.attrs.setdefault("title", "link")

    def skip(self, n: Node) -> bool:
        return n.tag == "aside"

    def enter(self, n: Node) -> str | None:
        return "[" if n.tag == "p" and n.attrs.get("class") == "note" else None

    def exit(self, n: Node) -> str | None:
        return "]" if n.tag == "p" and n.attrs.get("class") == "note" else None

    def text(self, s: str, parent: Node) -> str | None:
        return s.upper() if parent.tag == "b" else None if parent.tag == "small" else s

    def end(self, root: Node) -> None:
        last = Node("p", {}, root)
        last.kids.append("end")
        root.kids.append(last)


golden("hooks_q11", [("<p class=note>a <b>b</b></p><aside>x</aside><small>gone</small><a href=/x>c</a>", '[a **B**]\n\n[c](/x "link")\n\nend')], hooks=(_Marks(),))
golden("limit_q13_max_text", [("<p>one</p><p>two</p>", "one"), ("<p>a</p>", "a")], o=options(max_text=12))


def _kernel_rows(name: str, rows: list[tuple], columns: str, schema: str, make: Callable[[], list[tuple]]) -> None:
    """A query whose rows a function of the kernel makes; its SQL is the literal table."""
    QUERIES[name] = lambda spark, d: spark.createDataFrame(make(), schema)
    ORACLE[name] = literal_table(rows, columns)


def extract_q09(spark, d) -> DataFrame:
    """Every element of every selector, in the order of their ends."""
    df = spark.createDataFrame([(0, "<div class='a b'><p id=x>one <b>two</b></p></div><p>three")], "n int, html string")
    out = convert(df, ["n"], outputs=("extracted",), selectors=("p", ".b, b", "[id=x]")).select("n", F.posexplode("extracted").alias("k", "e"))
    return out.select("n", "k", "e.selector", "e.tag", "e.text")


QUERIES["extract_q09"] = extract_q09
ORACLE["extract_q09"] = literal_table(
    [(0, 0, ".b, b", "b", "two"), (0, 1, "p", "p", "one two"), (0, 2, "[id=x]", "p", "one two"), (0, 3, ".b, b", "div", "one two"), (0, 4, "p", "p", "three")], "n, k, selector, tag, text"
)
_kernel_rows(
    "text_u08_plain_headings", [(0, "bold and code"), (1, "a link"), (2, "a * b"), (3, "x y")], "n, result", "n int, result string",
    lambda: [(n, plain_heading(x)) for n, x in enumerate(["**bold** and `code`", "a [link](/x)", "a \\* b", "x<sub></sub> ~~y~~"])],
)
_kernel_rows(
    "text_t11_wrap", [(0, "aaa bbb\nccc"), (1, "abcdefghijk\nx"), (2, "a\n\nb")], "n, result", "n int, result string",
    lambda: [(n, wrap_text(x, 7)) for n, x in enumerate(["aaa bbb ccc", "abcdefghijk x", "a\n\nb"])],
)
_kernel_rows(
    "select_q01", [(0, 1), (1, 1), (2, 0), (3, 1), (4, 1), (5, 0), (6, 1), (7, 1), (8, 0)], "n, hit", "n int, hit int",
    lambda: [
        (n, int(matcher((s,))(Node("a", {"class": "x y", "id": "i", "href": "/docs/a.html", "lang": "en-US", "rel": "no follow"}, None))))
        for n, s in enumerate(["a.x#i", "[href^='/docs']", "[href$=pdf]", "[rel~=follow]", "[lang|=en]", "b, .z", "b, .y", "[href*=cs]", "a[title]"])
    ],
)

# streams ------------------------------------------------------------------------------------------------


def _pieces(html: str | bytes, size: int, output: str = "markdown", o: Options = Options()) -> list[str]:
    c = Converter(output, o)
    return [*(c.process(html[i : i + size]) for i in range(0, len(html), size)), c.finish()]


_kernel_rows(
    "stream_w01_deltas", [(0, "one"), (1, ""), (2, "\n\ntwo"), (3, "\n\n- a"), (4, "\n- b"), (5, "")], "n, result", "n int, result string",
    lambda: list(enumerate((lambda c: [*map(c.process, ["<p>one</p><p>", "two", "</p><ul><li>", "a<li>b", "</ul>"]), c.finish()])(Converter()))),
)
_kernel_rows(
    "stream_w02_residue", [(n, "a **b** [c](/d)") for n in range(4)], "n, result", "n int, result string",
    lambda: [(n, "".join(_pieces("<p>a <b>b</b> <a href='/d'>c</a><!-- x > y --><scr" + "ipt>z</script>", size))) for n, size in enumerate((1, 2, 5, 100))],
)
_kernel_rows(
    "stream_w03_characters", [(0, "é😀あ"), (1, "é😀あ"), (2, "a�")], "n, result", "n int, result string",
    lambda: [(0, "".join(_pieces("é😀あ".encode(), 1))), (1, "".join(_pieces("é😀あ", 1))), (2, "".join(_pieces("a\ud83d", 1)))],
)
_kernel_rows(
    "stream_w04_held", [(0, ""), (1, ""), (2, "x"), (3, ""), (4, " **y**"), (5, "")], "n, result", "n int, result string",
    lambda: list(enumerate((lambda c: [*map(c.process, ["<p>", "x ", "<b>", "y", "</b> "]), c.finish()])(Converter()))),
)
_kernel_rows(
    "stream_w06_barrier", [(0, ""), (1, ""), (2, "[a](#t) b\n\n## T")], "n, result", "n int, result string",
    lambda: list(enumerate(_pieces("<a href=#t>a</a> <a href=#u>b</a><h2>T</h2>", 30, o=options(clean=frozenset({"fragments"}))))),
)
_kernel_rows(
    "stream_w07_discarded", [(0, 1), (1, 1)], "n, small", "n int, small int",
    lambda: [(n, int(_state_size(x) < 3000)) for n, x in enumerate(["<script>" + "var x;" * 20_000, "a<!--" + " comment" * 20_000])],
)
_kernel_rows(
    "stream_w08_callbacks", [(0, "title=T b=x,y")], "n, result", "n int, result string", lambda: [(0, _called())],
)
_kernel_rows(
    "stream_w09_formats", [(0, "a\nb\n\nc"), (1, "<p>a <strong>b</strong></p>")], "n, result", "n int, result string",
    lambda: [(0, "".join(_pieces("<p>a<br>b</p><p>c", 3, "text"))), (1, "".join(_pieces("<p>a <b>b</b></p>", 2, "safe_html")))],
)


def _state_size(html: str) -> int:
    c = Converter()
    for i in range(0, len(html), 500):
        c.process(html[i : i + 500])
    return len(pickle.dumps(c))


def _called() -> str:
    said: list[str] = []
    c = Converter(selectors=("b",), on_end=lambda meta, found: said.append(f"title={meta['title']} b={','.join(x[2] for x in found)}"))
    c.process("<head><title>T</title></head><b>x</b>")
    c.process("<b>y</b>")
    c.finish()
    return " ".join(said)
