"""Problems 3 and 4: main text, furniture, residue."""

import datetime as dt
import re
import sys
from collections import Counter

import pytest

from quillspan.llm import main_text, residue
from quillspan.llm.folding import pattern_form
from quillspan.llm.furniture import PATTERNS, _any, is_furniture, kind_of, normal
from quillspan.llm.page_text import Page

PROSE = "The output buffer keeps the order of the source on slow connections, and the crawler opens a new section after the first pass."
PAGE = f"""<html><head><title>T</title></head><body>
<nav><a href="/">Home</a> · <a href="/x">Guides</a></nav>
<div class="x1"><h1>One title</h1><p>Written by the Abc documentation team</p><p>{PROSE}<p>{PROSE} Twice.
<table><tr><th>a<th>b<tr><td>1<td>2</table><pre><code>x = {{{{ y }}}}
z</code></pre><p>Note: the examples are short.</p></div>
<div class="main content"><h3>More articles from Abc</h3><li><a href="/1">The crawler Abc</a></li><li><a href="/2">The buffer Abc</a></li></div>
<div id="f"><p>© 2024 Abc. All rights reserved.</p><p>Terms · Privacy notice</p></div>"""
MARKDOWN = f"""[Home](/) · [Guides](/x)

# One title

Written by the Abc documentation team

{PROSE[:60]}
{PROSE[60:]}

{PROSE} Twice.

| a | b |
| --- | --- |
| 1 | 2 |

```
x = {{{{ y }}}}
z
```

Note: the examples are short.

### More articles from Abc

- [The crawler Abc](/1)
- [The buffer Abc](/2)

© 2024 Abc. All rights reserved.

Terms · Privacy notice"""
PAGES = "page_id long, url string, origin string, title string, html string, fetched_at timestamp, lines int, main int"


def _pages(spark, rows):
    return spark.createDataFrame([(i, f"https://s{i}.example/", None, t, h, dt.datetime(2025, 1, 1), 0, 0) for i, t, h in rows], PAGES)


def test_main_subtree():
    page = Page(PAGE)
    inside = page.main()
    texts = [b[0] for b in page.blocks if b[1] in inside]
    assert texts[0] == "One title" and texts[-1] == "Note: the examples are short." and "x = {{ y }}" in texts
    assert [b[0] for b in page.blocks if b[1] not in inside][0] == "Home · Guides"
    for odd in ("", "plain", "<p>unclosed <b>x", "<div><div></div></div>", "<body></body>", "</p></div>"):
        Page(odd).main()


def test_main_text_lines(spark):
    chunk = "chunk_id long, page_id long, content string, rest int, lines int"
    rows = [(1, 1, MARKDOWN, 0, 0), (1, 1, MARKDOWN, 0, 0), (2, 2, "# T\n\nWritten by the Abc editors\n\ntext", 0, 0), (3, None, "x", 0, 0), (4, 9, "y", 0, 0), (5, 1, None, 0, 0)]
    chunks = spark.createDataFrame(rows, chunk)
    pages = _pages(spark, [(1, "T", PAGE), (2, "T", ""), (3, None, None)])
    got = {r.chunk_id: r.lines for r in main_text.boilerplate_lines(chunks, pages).collect()}
    lines = MARKDOWN.split("\n")
    want = [i + 1 for i, x in enumerate(lines) if x.startswith(("[Home", "Written by", "### More", "- [", "©", "Terms"))]
    assert got == {1: want, 2: [3]}
    kept = {r.chunk_id: r.content for r in main_text.keep_main_text(chunks, pages).collect()}
    assert len(kept) == 5 and "©" not in kept[1] and kept[5] is None and kept[4] == "y"
    assert main_text.boilerplate_lines(chunks.limit(0), pages).count() == 0


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("Published by the Abc editors", "byline"), ("Pub​lished by the Abc editors", "byline"), ("12 MIN READ, last touched in 2023", "reading"),
        ("Cette page décrit la version 3 de Abc.", "version"), ("広告：Abcでは", "promotion"), ("Время чтения: 5 минут", "reading"),
        ("Note: translations of this text are made by volunteers.", "translation"), ("Note: the second run is slower than the first.", None), ("The examples in this section need Abc release 3 or later.", None), (PROSE, None),
    ],
)
def test_furniture(line, kind):
    assert is_furniture(line) == (kind is not None) and kind_of(line) == kind


RESIDUE = {
    "{{ title }} | Abc": "", "Abc": "<h1>Abc</h1><p>Hello {{user.first_name}}, welcome back.", "A1": "<p>Please enable scripts in your browser and reload the page.</p>",
    "A2": "<h1>404</h1><p>The page you requested could not be found.</p><p>Reference 1a2b3c4d</p>", "A3": "<h1>A3</h1><p>Lorem ipsum dolor sit amet consectetur adipiscing elit sed.</p>",
    "A4": "<h1>A4</h1><p>Your text goes here. Replace this paragraph with your own words.</p>", "A5": "<p>Die angeforderte Seite existiert nicht oder wurde verschoben.",
}
REAL = {
    "B1": f"<h1>B1</h1><p>{PROSE} <code>{{{{ x }}}}</code></p>", "B2": f'<h1>B2</h1><p>"Page not found" {PROSE}</p><pre>HTTP/1.1 404 Not Found</pre>',
    "B3": f"<noscript>This site requires JavaScript.</noscript><h1>B3</h1><p>{PROSE}</p>", "B4": "", "100% of (all) [x] <y>": f"<p>{PROSE}</p>",
}


def test_residue(spark):
    rows = [(i, t, h) for i, (t, h) in enumerate([*RESIDUE.items(), *REAL.items(), (None, None)])]
    df = _pages(spark, rows + rows[:1])
    got = sorted(r.page_id for r in residue.residue_pages(df).collect())
    assert got == list(range(len(RESIDUE)))
    assert residue.residue_pages(df.limit(0)).count() == 0
    assert residue.without_residue(df).count() == len(REAL) + 1


def test_slots_and_page_templates(spark):
    slots = [(i, f"P{i}", f"<h1>P{i}</h1><p>{PROSE} Version {v} of Abc was released last week.</p>") for i, v in enumerate(["[[version]]", "((version))", "{{version}}"])]
    unseen = "<h1>Gone fishing</h1><p>The lights are out in this house tonight.</p>"
    pages = _pages(spark, slots + [(10 + i, f"Title {i}", unseen) for i in range(4)] + [(20, "One", f"<h1>One</h1><p>{PROSE}</p>"), (21, "Two", "<h1>Two</h1><p>((once))-only remark here</p>")])
    got = {r.page_id: r.reason for r in residue.residue_pages(pages).collect()}
    assert got == {0: "slot", 1: "slot", 2: "slot", **{10 + i: "template" for i in range(4)}}


def test_sentences_of_templates_and_names(spark):
    """A page made of sentences of whole-page templates, and one name that stands in several templates."""
    a, b = "<p>The lights are out in this house tonight.</p>", "<p>Knock twice and leave a note.</p>"
    rows = [(i, f"Title {i}", a) for i in range(3)] + [(10 + i, f"Name {i}", b) for i in range(3)]
    rows += [(20, "Both", f"<div>{a}{b}</div>"), (21, "Own", f"<p>Knock twice and leave a note.</p><p>{PROSE}</p>")]
    rows += [(30, "{{ owner.name }}", f"<p>{PROSE}</p>"), (31, "Contact", f"<p>{PROSE} Write to {{{{owner.name}}}} today.</p>"), (32, "a plain {{ once }} thing", f"<p>{PROSE} More.</p>")]
    got = {r.page_id: r.reason for r in residue.residue_pages(_pages(spark, rows)).collect()}
    want = {20: "sentence", 30: "slot", 31: "slot", 32: "syntax"}
    assert {k: v for k, v in got.items() if k >= 20} == want and all(got[k] == "template" for k in (0, 1, 2, 10, 11, 12))
    assert {r.reason: r.n_pages for r in residue.reasons(residue.residue_pages(_pages(spark, rows))).collect()} == {"template": 6, "sentence": 1, "slot": 2, "syntax": 1}


def test_slots_that_other_records_fill(spark):
    """Marks, defaults and blanks where the other records of the template hold real values."""
    filled = ["sales", "our small team", "Anna"]
    broken = {
        0: ("A0", "Contact [[heading]] to learn more."), 1: ("Abc - %name%", ""), 2: ("A2", "バージョン((version))が先週公開されました。"),
        3: ("A3", "Dear ((first)) of ((firm)), welcome to the overview."), 4: ("A4", "The editor of this guide is , who wrote it."),
        5: ("A5", "This manual was made by your company name here in spring."),
    }
    rows = [(i, t, f"<h1>{t}</h1><p>{PROSE} {h}</p>" if h else "") for i, (t, h) in broken.items()]
    for i, v in enumerate(filled):
        text = f"Contact {v} to learn more. バージョン{i}が先週公開されました。 Dear {v} of Xy{i}, welcome to the overview."
        text += f" The editor of this guide is {v}, who wrote it. This manual was made by {v} in spring."
        rows.append((10 + i, f"Abc - Name{i}", f"<h1>B{i}</h1><p>{PROSE} {text}</p>"))
    # nothing else stands in their place, or code does
    rows += [(20, "C0", f"<h1>C0</h1><p>{PROSE} Links such as [[wiki]] stay as they were typed.</p>"), (21, "C1", f"<h1>C1</h1><p>{PROSE} The editor of this guide is <code>x</code>, who wrote it.</p>")]
    got = {r.page_id: r.reason for r in residue.residue_pages(_pages(spark, rows)).collect()}
    assert got == dict.fromkeys(broken, "slot")


def test_every_mark_of_a_page_is_compared(spark):
    words = [a + b for a in "abcdefghij" for b in "klmnopqr"]
    many = " ".join(f"The {w} entry keeps [[heading]] as it was typed." for w in words)
    rows = [(i, f"P{i}", f"<h1>P{i}</h1><p>{PROSE} {many if not i else ''} The last entry reads [[{v}]] for all.</p>") for i, v in enumerate(["Alpha", "Beta"])]
    assert {(r.page_id, r.reason) for r in residue.residue_pages(_pages(spark, rows)).collect()} == {(0, "slot"), (1, "slot")}


def test_long_page_templates(spark):
    """A long text on several sites is a template under unrelated titles, a republished article under its own isn't."""
    closed = " ".join(f"Our shop rests during {w} and every drawer stays shut." for w in "spring summer autumn winter january february march april may june july august".split())
    rows = [(i, t, f"<h1>Gone fishing</h1><p>{closed}</p>") for i, t in enumerate(["Install Xyz", "Vocabulary files", "Buffers"])]
    rows += [(10 + i, f"The output buffer | Site{i}", f"<h1>The output buffer</h1><p>{PROSE * 6}</p>") for i in range(3)]
    assert len(closed) > 600 and {(r.page_id, r.reason) for r in residue.residue_pages(_pages(spark, rows)).collect()} == {(i, "template") for i in range(3)}


def test_a_page_is_brought_to_one_form_at_once():
    """Folding and matching forms run over the lines of a page together, not line by line."""
    lines = "".join(f"<p>Der {n}. Satz – über Größe {n}</p>" for n in range(300))
    calls: Counter = Counter()
    sys.setprofile(lambda frame, event, _: calls.update([frame.f_code.co_name] if event == "call" else ()))
    try:
        residue._scan_page("Größe", f"<h1>Größe</h1>{lines}")
    finally:
        sys.setprofile(None)
    assert calls["_scan_page"] == 1 and calls["fold"] + calls["normal"] + calls["match_form"] + calls["skeleton"] < 10
    page = Page(PAGE + "<p>Ｐublished\u200b by the Abc editors</p><p>[Written](/x) by the Abc team</p><p>Переводы этой страницы делают добровольцы</p><p>A: no answers yet</p>")
    shown = [(b[0], form, worded) for b, form, worded in zip(page.blocks, page.forms, page.furniture, strict=True) if form is not None]
    assert len(shown) == len([b for b in page.blocks if b[2] != "pre"]) > 10
    assert all(form == normal(x) and worded == is_furniture(x) for x, form, worded in shown) and [x[2] for x in shown[-4:]] == [True] * 4


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("a < b <p>x<y", ["a < b"]), ("<p>a</p", []), ('<a title="<!-- x -->">k</a>z', ['">kz']), ("<<!-- x -->y", ["<y"]), ("<!-->text-->u", ["u"]), ("<script>x", []),
        ("<SCRIPT src=x>1<2</ScRiPt>u<style-x>q</style>v", ["uv"]), ("</ x>a</>b<?php x ?>c<!d [<!e f>]>g", ["abc]>g"]), ("a<b", []), ("< p>x<br/>y", ["< p>x", "y"]), ('<p a="1>2">x', ['2">x']),
    ],
)
def test_odd_tokens(html, texts):
    assert [b[0] for b in Page(html).blocks] == texts


def test_patterns_that_are_looked_for_faster():
    """The forms that begin with a class of characters, and the patterns by first character, find what the plain ones find."""
    text = "A bC Dé’s x1a2b3 deadbeef 12ab34 1234567 zabc123 éAb\nA.  B…c! d。e？！ f\n. g ٣abcdef1 abcdef٣ Xy-9Z"
    assert residue._COINED.sub("N", text) == re.sub(r"\b[A-Z][\w’-]*", "N", text)
    assert residue._masked(text) == re.sub(r"\d+", "0", re.sub(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", "0", text))
    cut = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*")
    assert list(residue._lines(residue._apart(text))) == [s for x in text.split("\n") for s in cut.split(x) if s]
    whole = re.compile(pattern_form("|".join(x for p in PATTERNS.values() for x in p)))
    lines = [normal(x) for x in (*MARKDOWN.split("\n"), "12 min read", "about 3 min read", "By A · 3", "подписаться на новости", "¿Le ha sido útil?", "## More posts by X", "Xのほかの記事", "other", "", "©")]
    assert [_any(x) for x in lines] == [bool(whole.match(x)) for x in lines]
