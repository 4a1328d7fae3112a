"""Core queries against their SQL on the smallest tables, and operators on small fixtures."""

import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import negotiation, url_columns
from quillspan.functions.convert import convert, convert_one
from quillspan.operators import corpus, urls
from quillspan.operators.options import Options
from quillspan.operators.incremental import Converter
from quillspan.plans import core_queries, crawl_queries
from quillspan.plans.core_queries import ORACLE, QUERIES
from quillspan.plans.golden import INPUTS
from quillspan.streaming import convert_stream

QUERIES = QUERIES | crawl_queries.QUERIES
ORACLE = ORACLE | crawl_queries.ORACLE

DATA = "/root/testdata/sf0.001"
SLOW = {"sitemap_roundtrip", "chrome_shingles", "stream_windows", "bfs_depth"}


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE[name]).df())


def test_stream_equals_batch(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    parts = core_queries._streamed(spark, DATA)
    streamed = {r.doc_id: (r.text, r.complete) for r in convert_stream.joined_parts(parts).collect()}
    batch = {r.page_id: (r.markdown, True) for r in QUERIES["to_markdown"](spark, DATA).collect()}
    assert streamed == batch and parts.where("NOT complete").count() > len(batch)


@pytest.mark.parametrize(("output", "o"), [("markdown", Options()), ("text", Options(wrap_width=30)), ("safe_html", Options()), ("markdown", Options(exclude=("nav",), wrap_width=25))])
def test_incremental_equals_batch_for_every_cut(output, o):
    rnd = random.Random(3)
    documents = [*INPUTS, "<ul><li>a<li>b <b>c</b></ul><ol start=4><li>d<ul><li>e</ul></ol><nav>n<p>m</nav>tail", "<p>é \U0001f600 &amp;lt; x</p>" * 5]
    for html in documents:
        want = convert_one(html, (output,), o)[0]
        for size in (1, 2, 5, rnd.randint(3, 40)):
            c, got = Converter(output, o), ""
            for i in range(0, len(html), size):
                got += c.process(html[i : i + size])
            assert got + c.finish() == want
        raw = html.encode("utf-8", "replace")
        c = Converter(output, o)
        parts = [c.process(raw[i : i + 3]) for i in range(0, len(raw), 3)]
        assert "".join(parts) + c.finish() == want


def test_incremental_puts_out_early_and_keeps_little():
    c = Converter()
    got = [c.process(f"<div><p>Paragraph {i} of <b>many</b>.</p></div><script>{'x' * 500}</script><!-- {'y' * 500} -->") for i in range(200)]
    assert sum(map(bool, got)) > 190 and len(pickle.dumps(c)) < 3000
    said = []
    whole = Converter(o=Options(frontmatter=True), selectors=("b",), on_end=lambda m, e: said.append((m, [x[2] for x in e])))
    assert whole.process("<head><title>T</title></head><b>x</b>") == "" and whole.finish().startswith("---") and said == [({"title": "T"}, ["x"])]
    c = Converter()
    assert c.process("a\ud83d") + c.process("\ude00b") + c.finish() == "a\U0001f600b"


def test_stream_windows_come_from_the_stream(spark, duck, monkeypatch):
    assert rows(QUERIES["stream_windows"](spark, DATA).toPandas()) == rows(duck.sql(ORACLE["stream_windows"]).df())
    counts = convert_stream.windowed_counts
    monkeypatch.setattr(convert_stream, "windowed_counts", lambda events, *a: counts(events.where("false"), *a))
    assert QUERIES["stream_windows"](spark, DATA).count() == 0


def test_convert_handles_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "<p>a" * 5000, "z")], "id int, html string, markdown_ string")
    got = {r.id: r.markdown for r in convert(df, ["id", "markdown_"]).collect()}
    assert got[1] is None and got[2] == "" and got[3].count("a") == 5000
    assert convert(df.limit(0), ["id"]).count() == 0
    assert convert_one("<p>a</p><p>b", ("markdown", "truncated"), Options(max_text=9)) == ("a", True)


def test_resolve():
    assert urls.resolve("../b?x#y", "https://a.example/d/e/f") == "https://a.example/d/b?x#y"
    assert urls.resolve("./b", "https://a.example") == "https://a.example/b"
    assert urls.resolve("#x", "https://a.example") == "#x"
    assert urls.resolve("//b.example/x", "") == "https://b.example/x"
    assert urls.is_safe_url("java\nscript:x") is False and urls.is_empty_href("#")


def test_column_twins(spark):
    given = ["/p?utm_x=1&a=2#f", "/p#x?utm_x=1", "/p?fbclid=1", "", "/p"]
    df = spark.createDataFrame([(g,) for g in given], "u string")
    assert [r[0] for r in df.select(url_columns.strip_tracking(F.col("u"))).collect()] == [urls.strip_tracking(g) for g in given]
    one = df.limit(1).select(
        url_columns.starting_url(F.lit("https://a.example/docs/x*/y")),
        negotiation.negotiate(F.lit(None).cast("string"), F.lit(None).cast("string")),
        url_columns.safe_segment(F.lit("con")),
    ).first()
    assert tuple(one) == ("https://a.example/docs/", "html", "~con")


def test_walk_and_chrome(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    roots = spark.createDataFrame([("r",)], "url string")
    assert {(r.url, r.depth) for r in corpus.walk_links(edges, roots, 3).collect()} == {("r", 0), ("a", 1), ("b", 2), ("c", 3)}
    menu = " ".join(f"m{i}" for i in range(20))
    docs = [("s", i, f"{menu} own{i} text{i}") for i in range(4)] + [("s", 9, menu), ("t", 1, menu)]
    df = spark.createDataFrame(docs, "site string, id int, text string")
    got = {(r.site, r.id): r.text for r in corpus.strip_chrome(df, "site", "id", "text").collect()}
    assert got["s", 0] == "own0 text0" and got["s", 9] == menu and got["t", 1] == menu


def test_sitemaps_of_any_depth(spark):
    from quillspan.sources import crawl

    files = [(f"m{i}", f"<sitemapindex><sitemap><loc>m{i + 1}</loc></sitemap><sitemap><loc>m0</loc></sitemap></sitemapindex>") for i in range(7)]
    files += [("m7", "<urlset><url><loc>https://a.example/deep</loc></url></urlset>")]
    start = spark.createDataFrame([("r", "m0")], "root string, address string")
    got = crawl.expand_sitemaps(start, spark.createDataFrame(files, "address string, xml string")).collect()
    assert [tuple(r) for r in got] == [("r", "https://a.example/deep")]


def test_hooks_vary_and_artifacts(spark):
    from quillspan.operators.dom import prune

    def no_ads(root):
        prune(root, lambda n: "ad" in n.attrs.get("class", ""))

    df = spark.createDataFrame([(1, "<p>a<p class=ad>b")], "id int, html string")
    assert convert(df, ["id"], hooks=(no_ads,)).first().markdown == "a"
    v = df.select(
        negotiation.merged_vary(F.lit("Accept, cookie"), ["accept", "Sec-Fetch-Dest"]),
        negotiation.merged_vary(F.lit("*"), ["Accept"]),
        negotiation.merged_vary(F.lit(None).cast("string"), ["Accept"]),
    ).first()
    assert tuple(v) == ("Accept, cookie, Sec-Fetch-Dest", "*", "Accept")
    schema = "site string, place int, title string, url string, description string, keywords string, author string, content string"
    pages = spark.createDataFrame([("s", 1, "T", "u", "d" * 120, None, "", "---\ntitle: old\nlang: en\n---\n\n# T\n\nBody"), ("s", 2, None, "v", None, None, None, None)], schema)
    text = corpus.llms_full(pages, "site").first().llms_full
    assert "---\nlang: en\ntitle: T\nurl: u\n" in text and "\n---\n\nBody\n" in text and "old" not in text
    names = spark.createDataFrame([("s", "Name", "")], "site string, site_name string, site_description string")
    index = corpus.llms_index(pages, names, "site").first().llms_txt
    assert index == f"# Name\n\nCanonical Origin: s\n\n## Pages\n\n- [T](u): {'d' * 100}...\n- [](v)\n"
