"""Queries of crawl planning, serving and the ways in and out, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.convert import convert, register
from quillspan.functions.sites import host_of, registrable_domain, site_of, site_sql
from quillspan.functions.url_columns import url_path
from quillspan.operators import corpus, crawling
from quillspan.plans.golden import literal_table
from quillspan.plans.tables import materialize, scratch, table
from quillspan.sources import crawl

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_SITE = site_sql("origin", "url")
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _given(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_META = [
    (0, "https://e.example/a/b", "<head><title> </title><meta property='og:title' content='Og'><meta name=description content=D><meta property=og:description content=E></head>x", "Og", "D", None, None, ""),
    (1, "https://e.example/a/b?x=1", "<meta name=keywords content='k, l'><meta name=author content=' A '><p>no title", "/a/b", None, "k, l", "A", ""),
    (2, "https://e.example/a/b", "<title>T</title><a href='c?utm_source=z&b=2&a=1#f'>x</a><a href=/c>y</a><a href='/c/'>z</a><a href='https://other.example/q'>o</a><a href='//e.example/d'>d</a><a href=''>e</a>", "T", None, None, None, "https://e.example/a/c?a=1&b=2 https://e.example/c https://e.example/d"),
    (3, "https://e.example", "<meta property=og:description content=first><meta name=description content=second><svg><title>later</title></svg>", "later", "first", None, None, ""),
]


@query(literal_table([(n, *want) for n, _, _, *want in _META], "n, title, description, keywords, author, links"))
def crawl_page_metadata(spark, d):
    """What pages say about themselves, and their links to their own origin."""
    out = crawling.page_metadata(_given(spark, [x[:3] for x in _META], "n int, url string, html string"), ["n"])
    return out.withColumn("links", F.array_join("links", " "))


@query(
    f"""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), {_PATH}) AS title, len(regexp_extract_all(html, '<a href="[^"]+"')) > 0 AS has_links
    FROM pages WHERE html IS NOT NULL AND NOT contains(regexp_extract(html, '<title>([^<]*)</title>', 1), '&')"""
)
def crawl_page_titles(spark, d):
    """Titles of all pages, whatever else they say."""
    p = table(spark, d, "pages").where("html IS NOT NULL").where(~F.regexp_extract("html", "<title>([^<]*)</title>", 1).contains("&"))
    out = crawling.page_metadata(p, ["page_id", "html"], domains=("example",))
    return out.select("page_id", "title", F.col("html").rlike('<a href="[^"]+"').alias("has_links"))


_HOSTS = ["www.e.co.uk", "co.uk", "a.b.example.com", "x.user.github.io", "10.0.0.1", "localhost", "a.gov.au.", "E.Com"]
_DOMAINS = ["e.co.uk", "co.uk", "example.com", "user.github.io", "10.0.0.1", "localhost", "a.gov.au", "e.com"]


@query(literal_table(list(zip(_HOSTS, _DOMAINS, strict=True)), "host, domain"))
def registrable_domains(spark, d):
    """The registrable domain by public suffixes."""
    return _given(spark, [(x,) for x in _HOSTS], "host string").select("host", registrable_domain(F.col("host")).alias("domain"))


_SAME = [
    ("https://a.example/x", "https://a.example/y", True), ("https://a.example/x", "https://b.example/y", False),
    ("https://a.example/x", "http://a.example/y", False), ("https://a.example", "https://a.example:444/", False), ("https://a.example", "https://a.example", True),
]


@query("SELECT * FROM (VALUES ('https://a.example/x', 'https://a.example/y'), ('https://a.example', 'https://a.example')) AS t(src, dst)")
def links_same_origin(spark, d):
    return crawling.same_site_links(_given(spark, [x[:2] for x in _SAME], "src string, dst string"), "src", "dst")


@query("SELECT * FROM (VALUES ('https://a.e.co.uk/x', 'http://b.e.co.uk/y')) AS t(src, dst)")
def links_same_domain(spark, d):
    rows = [("https://a.e.co.uk/x", "http://b.e.co.uk/y"), ("https://a.e.co.uk/x", "https://f.co.uk/y")]
    return crawling.same_site_links(_given(spark, rows, "src string, dst string"), "src", "dst", ("e.co.uk",))


_GLOBS = [
    (0, "https://e.example/docs/a/b", "https://e.example/docs/**", False, True), (1, "https://e.example/docs", "https://e.example/docs/**", False, True),
    (2, "https://e.example/docs/a/b", "https://e.example/docs/*", False, False), (3, "https://e.example/fields/a/b", "https://e.example/fields*", False, True),
    (4, "https://e.example/fieldset", "https://e.example/fields*", False, False), (5, "https://sub.e.example/docs/a", "https://e.example/docs/*", False, False),
    (6, "https://sub.e.example/docs/a", "https://e.example/docs/*", True, True), (7, "https://o.example/x", "https://e.example/", False, True),
    (8, "https://e.example/v1/x", "https://e.example/v?/x", False, True), (9, "https://e.example/b/x", "e.example/[ab]/x", False, True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, {str(x).lower()})" for n, *_, x in _GLOBS) + ") AS t(n, matches)")
def url_pattern_matches(spark, d):
    """Urls against url patterns with globs."""
    out = None
    for n, url, pattern, subs, _ in _GLOBS:
        one = _given(spark, [(n, url)], "n int, url string").select("n", crawling.matches_pattern(F.col("url"), pattern, subs).alias("matches"))
        out = one if out is None else out.union(one)
    return out


_HOST = "regexp_extract(url, '^(https://[^/?#]*)', 1)"
_AFTER = "regexp_extract(url, '^https://[^/?#]*(.*)$', 1)"


@query(
    f"""SELECT url FROM pages WHERE {_HOST} IN (SELECT DISTINCT {_HOST} FROM pages WHERE {_HOST} <> '' ORDER BY 1 LIMIT 2)
      AND regexp_matches({_AFTER}, '^/guides(/|$)') AND NOT regexp_matches({_AFTER}, '^/guides/[^/]*a[^/]*$')"""
)
def sitemap_filter(spark, d):
    """Urls of a crawl of two sites that a pattern takes and no exclusion does."""
    urls = table(spark, d, "pages").select("url")
    hosts = [r[0] for r in urls.select(F.regexp_extract("url", "^(https://[^/?#]*)", 1).alias("h")).where("h <> ''").distinct().orderBy("h").limit(2).collect()]
    return crawling.filter_urls(urls, [f"{h}/guides/**" for h in hosts], ["/guides/*a*"])


@query(
    f"""WITH s AS (SELECT DISTINCT {site_sql("origin", "origin")} AS site, robots FROM sites), named AS (
      SELECT site, list_transform(regexp_extract_all(coalesce(robots, ''), '(?i)Sitemap:[ \\t]*([^\\r\\n]*)', 1), lambda x: trim(x)) AS l FROM s WHERE site IS NOT NULL),
    every_ AS (SELECT site, l || list_filter([site || '/sitemap.xml', site || '/sitemap_index.xml', site || '/sitemaps.xml', site || '/sitemap-index.xml'], lambda x: NOT list_contains(l, x)) AS a FROM named)
    SELECT site, unnest(a) AS address, unnest(range(len(a)))::INT AS rank FROM every_"""
)
def sitemap_candidates(spark, d):
    """Where each site's sitemaps may be, in the order in which they are tried."""
    s = table(spark, d, "sites").select(site_of(F.col("origin"), F.col("origin")).alias("site"), "robots").distinct()
    return crawling.sitemap_candidates(s, "site", "robots")


_CANDIDATES = [("s", "s/1", 0), ("s", "s/2", 1), ("s", "s/3", 2), ("t", "t/1", 0)]
_LOADED = [("s/2", "s/a"), ("s/2", "s/b"), ("s/3", "s/b"), ("s/3", "s/c"), ("t/9", "t/x")]


@query("SELECT * FROM (VALUES (false, 's', 's/a'), (false, 's', 's/b'), (true, 's', 's/a'), (true, 's', 's/b'), (true, 's', 's/c')) AS t(merged, site, url)")
def sitemap_choice(spark, d):
    """The first sitemap that yields urls, or all that were named explicitly."""
    c, f = _given(spark, _CANDIDATES, "site string, address string, rank int"), _given(spark, _LOADED, "address string, url string")
    one, every = crawling.sitemap_urls(c, f, "site"), crawling.sitemap_urls(c, f, "site", merge=True)
    return one.select(F.lit(False).alias("merged"), "*").union(every.select(F.lit(True), "*"))


@query(f"SELECT site, page_id FROM (SELECT {_SITE} AS site, page_id, row_number() OVER (PARTITION BY {_SITE} ORDER BY fetched_at, page_id) AS n FROM pages WHERE {_SITE} IS NOT NULL) WHERE n <= 7")
def max_pages(spark, d):
    """The first seven pages of each site."""
    p = table(spark, d, "pages").select(site_of(F.col("origin"), F.col("url")).alias("site"), "page_id", "fetched_at").where("site IS NOT NULL")
    return crawling.limit_pages(p, "site", ["fetched_at", "page_id"], 7).select("site", "page_id")


_SERVED = [(0, "text/html; charset=utf-8", "<p>a <b>b"), (1, "Text/Markdown", "# *as is*"), (2, "application/pdf", "%PDF"), (3, None, "x"), (4, "application/xhtml+xml", "<h1>c</h1>")]


@query(literal_table([(0, "a **b**"), (1, "# *as is*"), (4, "# c")], "n, markdown"))
def markdown_passthrough(spark, d):
    return crawling.passed_through(_given(spark, _SERVED, "n int, content_type string, body string"), "content_type", "body", ["n"])


@query(
    f"""SELECT page_id, CASE WHEN lower(h) IN ('con', 'aux') THEN '~' || h ELSE h END || '/' || CASE WHEN len(s) = 0 THEN 'index' ELSE array_to_string(s, '/') END || '.md' AS file_path, 'md/' || CASE WHEN p = '/' THEN 'index' ELSE regexp_replace(regexp_replace(p, '^/', ''), '/$', '') END || '.md' AS listed
    FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '[^\\w-]', '-', 'g') AS h, {_PATH} AS p,
      list_transform(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\\w-]', '-', 'g')) AS s FROM pages)"""
)
def markdown_file_paths(spark, d):
    """Files of a crawl over several hosts, and the paths of a plain list of Markdown files."""
    return table(spark, d, "pages").select("page_id", crawl.file_path(F.col("url"), by_host=True).alias("file_path"), crawl.file_list_path(url_path(F.col("url"))).alias("listed"))


@query(literal_table([(0, "## S\n\none\n\ntwo\n\n- [a](/a): says\n- [b](/b)\n\n"), (1, "## T\n\n"), (2, "n1\n\nn2\n\n"), (3, "alone\n\n")], "n, result"))
def index_sections(spark, d):
    made = [crawling.section("S", ["one", "two"], [("a", "/a", "says"), ("b", "/b", "")]), crawling.section("T"), crawling.notes(["n1", "n2"]), crawling.notes("alone")]
    return _given(spark, list(enumerate(made)), "n int, result string")


@query(
    f"""SELECT site, md5('# Site' || chr(10) || chr(10) || 'Canonical Origin: ' || site || chr(10) || chr(10) || '## More' || chr(10) || chr(10) || '- [x](/x)' || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10)
      || string_agg('- [' || coalesce(title, '') || '](' || url || ')' || chr(10), '' ORDER BY page_id) || chr(10) || 'End.' || chr(10) || chr(10)) AS digest
    FROM (SELECT *, {_SITE} AS site FROM pages) WHERE site IS NOT NULL GROUP BY site"""
)
def llms_txt_with_sections(spark, d):
    """Site indexes with a section before the list of pages and notes after it."""
    p = table(spark, d, "pages").select(site_of(F.col("origin"), F.col("url")).alias("site"), F.col("page_id").alias("place"), "title", "url", F.lit(None).cast("string").alias("description")).where("site IS NOT NULL")
    names = p.limit(0).select("site", F.col("title").alias("site_name"), F.col("title").alias("site_description"))
    out = corpus.llms_index(p, names, "site", sections=crawling.section("More", links=[("x", "/x", "")]), notes=crawling.notes("End."))
    return out.select("site", F.md5("llms_txt").alias("digest"))


@query(literal_table([(0, "a=1 b=3 exclude=x,y"), (1, "llms.txt markdown"), (2, "llms.txt llms-full.txt markdown"), (3, "error"), (4, "error")], "n, result"))
def crawl_options(spark, d):
    """Layers of options and the choice of artifacts."""

    def shown(f) -> str:
        try:
            return " ".join(f())
        except ValueError:
            return "error"

    merged = crawling.merged_options({"a": 1, "b": 2, "exclude": ["x"]}, {"b": 3, "a": None, "exclude": ["y"]})
    made = [
        " ".join(f"{k}={','.join(v) if isinstance(v, list) else v}" for k, v in sorted(merged.items())),
        shown(lambda: crawling.artifacts(["markdown", "llms.txt", "markdown"])), shown(lambda: crawling.artifacts(None)),
        shown(lambda: crawling.artifacts(["pdf"])), shown(lambda: crawling.artifacts("markdown")),
    ]
    return _given(spark, list(enumerate(made)), "n int, result string")


@query("SELECT page_id, title || '!' AS title FROM pages WHERE page_id % 2 = 0 AND title IS NOT NULL")
def crawl_hooks(spark, d):
    """Two hooks of one point, in order: one that skips rows and one that changes them."""
    hooks = {"crawl:url": [lambda p: p.where("page_id % 2 = 0"), lambda p: p.where("title IS NOT NULL")], "crawl:page": [lambda p: p.withColumn("title", F.concat("title", F.lit("!")))]}
    p = table(spark, d, "pages").select("page_id", "title")
    return crawling.with_hooks(crawling.with_hooks(p, "crawl:url", hooks), "crawl:page", hooks)


_FILES = {"index.html": "<title>Home</title><p>a", "docs/one.html": "<p>b", "docs/two.htm": "<p>c", "docs/skip.txt": "d"}


def _written(spark) -> str:
    """A folder of small files, written by the cluster's file system."""
    root = scratch(spark, "run")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in _FILES.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(text, "utf-8"))
        out.close()
    return root


@query(literal_table([("/", "Home", "a"), ("/docs/one", "one", "b"), ("/docs/two.htm", "two", "c")], "url, title, markdown"))
def html_file_scan(spark, d):
    """Files by two globs, each once, their addresses, titles and Markdown."""
    files = crawl.read_html_files(spark, _written(spark), ("*.html", "*.htm*"))
    return convert(files, ["url", "title"])


@query(literal_table([("docs/one.md", "b")], "path, markdown"))
def build_outputs(spark, d):
    """Html files of a build by inclusion and exclusion."""
    files = _given(spark, list(_FILES.items()), "path string, html string")
    return crawling.build_outputs(files, "path", "html", ["**/*.html"], ["index.html"])


@query(literal_table([("/docs/one", "/docs/one.html"), ("/docs/", "/docs/index.html"), ("/gone", "/index.html"), ("/a.html", "/a.html")], "path, file"))
def dev_path_resolution(spark, d):
    files = _given(spark, [("/docs/one.html",), ("/docs/index.html",), ("/index.html",), ("/a.html",)], "path string")
    return crawling.resolved_paths(_given(spark, [("/docs/one",), ("/docs/",), ("/gone",), ("/a.html",)], "path string"), files, "path")


@query(literal_table([("/index.md", "/"), ("/docs/a.md", "/docs/a"), ("/docs/index.md", "/docs")], "route, page_route"))
def prerendered_routes(spark, d):
    return crawling.markdown_routes(_given(spark, [("/index.md",), ("/docs/a.md",), ("/docs/index.md",), ("/docs/a",)], "route string"), "route")


@query("SELECT page_id, html IS NULL AS is_null FROM pages")
def sql_functions(spark, d):
    """The conversions as functions of SQL; the same as through the DataFrame."""
    register(spark)
    table(spark, d, "pages").createOrReplaceTempView("__quillspan_pages")
    said = spark.sql("SELECT page_id, html_to_markdown(html) AS md, html_to_text(html) AS txt FROM __quillspan_pages")
    plain = convert(table(spark, d, "pages"), ["page_id"], outputs=("markdown", "text")).toDF("page_id", "markdown", "text")
    same = said.join(plain, "page_id").where("md <=> markdown AND txt <=> text")
    return same.select("page_id", F.col("md").isNull().alias("is_null"))


@query(
    f"""WITH p AS (SELECT {_SITE} AS site, page_id, title, url, description FROM pages WHERE {_SITE} IS NOT NULL)
    SELECT site, (row_number() OVER (PARTITION BY site ORDER BY page_id))::INT AS place,
      '- [' || coalesce(title, '') || '](' || url || ')' || CASE WHEN coalesce(description, '') = '' THEN '' ELSE ': ' || substring(description, 1, 160) || CASE WHEN length(description) > 160 THEN '...' ELSE '' END END AS line FROM p"""
)
def index_lines(spark, d):
    """Site indexes as sorted lines, for sites too large for one string."""
    from pyspark.sql import Window

    p = table(spark, d, "pages").select(site_of(F.col("origin"), F.col("url")).alias("site"), "page_id", "title", "url", "description").where("site IS NOT NULL")
    placed = p.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).withColumn("breaks", F.lit(False))
    return corpus.index_parts(placed, "site")


@query(f"SELECT page_id, {_SITE} AS site FROM pages WHERE {_SITE} IS NOT NULL")
def streamed_index(spark, d):
    """The full file grows as pages arrive in a stream, the index is sorted at its end; here: every page stands in it once."""
    from quillspan.streaming.index_stream import stream_index

    p = table(spark, d, "pages").select("page_id", site_of(F.col("origin"), F.col("url")).alias("site"), "url", "title", "description", F.lit("text").alias("content")).where("site IS NOT NULL")
    root = scratch(spark, "run")
    p.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    index = stream_index(stream, f"{root}/run", "site", "page_id")
    full = spark.read.parquet(f"{root}/run/full")
    return index.join(full, "page_id").select("page_id", index["site"])


@query(literal_table([(0, "# A\n\nb"), (1, "A\n\nb"), (2, '<h1 id="a">A</h1><p>b</p>'), (3, "[x](https://e.example/q)"), (4, "aaa\nbbb")], "n, result"))
def command_line(spark, d):
    """The command-line wrapper: formats, origin, clean urls and wrap width."""
    import io

    from quillspan.__main__ import main

    html = "<h1>A</h1><p>b</p>"
    calls = [([], html), (["--text"], html), (["--format", "html"], html), (["--origin", "https://e.example", "--clean-urls"], "<a href='/q?utm_source=z'>x</a>"), (["--wrap-width", "4"], "<p>aaa bbb</p>")]
    made = []
    for n, (argv, given) in enumerate(calls):
        out = io.StringIO()
        main(argv, io.BytesIO(given.encode()), out)
        made.append((n, out.getvalue()))
    return _given(spark, made, "n int, result string")


_RESPONSES = [
    (0, 200, 0, None, "text/html; charset=x", None, True), (1, 429, 0, "7", "text/html", 7.0, True), (2, 429, 1, "Wed, 01 Jan 2025 00:00:30 GMT", None, 30.0, False),
    (3, 429, 1, "soon", "text/markdown", 2.0, True), (4, 503, 1, None, "image/png", 2.0, False), (5, 503, 2, None, "Text/HTML", None, True), (6, None, 0, None, None, 1.0, False), (7, 404, 0, None, "application/xhtml+xml", None, True),
]


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"({n}, {'NULL' if w is None else w}::DOUBLE, {str(a).lower()})" for n, *_, w, a in _RESPONSES) + ") AS t(n, wait, accepted)"
)
def fetch_decisions(spark, d):
    """What is fetched again and when, and what is taken in."""
    from quillspan.functions.fetching import is_accepted, next_try

    r = _given(spark, [x[:5] for x in _RESPONSES], "n int, status int, attempt int, retry_field string, content_type string")
    now = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    return r.select("n", next_try(F.col("status"), F.col("attempt"), F.col("retry_field"), now).alias("wait"), is_accepted(F.col("content_type")).alias("accepted"))


_VARY = [(0, None, "Accept"), (1, "Accept-Encoding", "Accept-Encoding, Accept"), (2, "accept, Cookie", "accept, Cookie"), (3, "*", "*"), (4, "", "Accept")]


@query(literal_table([(n, want) for n, _, want in _VARY], "n, vary"))
def vary_header(spark, d):
    """The Vary field with Accept in it, once in any case."""
    from quillspan.functions.negotiation import merged_vary

    return _given(spark, [x[:2] for x in _VARY], "n int, given string").select("n", merged_vary(F.col("given"), ["Accept"]).alias("vary"))


_STARTS = [(0, "https://e.example/docs/a*", "https://e.example/docs/"), (1, "https://e.example/**", "https://e.example/"), (2, "https://e.example/x", "https://e.example/x"), (3, "e.example/docs/v?/x", "https://e.example/docs/")]


@query(literal_table([(n, want) for n, _, want in _STARTS], "n, start"))
def pattern_starts(spark, d):
    """Where a crawl of a url pattern begins."""
    from quillspan.functions.url_columns import starting_url

    return _given(spark, [x[:2] for x in _STARTS], "n int, p string").select("n", starting_url(F.col("p")).alias("start"))


# what holds of every page -----------------------------------------------------------------------

_BODY = "regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|title)\\b.*?</\\1>', '', 'g'), '(?s)<!--.*?-->', '', 'g')".replace("</\\1>", "</(script|style|noscript|title)>")


@query(f"SELECT page_id, len(regexp_extract_all({_BODY}, '<h2>')) AS n_h2, len(regexp_extract_all({_BODY}, '<li>')) AS n_items FROM pages WHERE html IS NOT NULL")
def markdown_structure(spark, d):
    """Headings and items of every page's Markdown, outside code, are those of its html; in table cells they stay tags."""
    md = convert(table(spark, d, "pages").where("html IS NOT NULL"), ["page_id"])
    md = md.withColumn("o", F.regexp_replace("markdown", r"(?ms)^([ >]*)(`{3,})[^\n]*\n.*?^\1\2[ ]*$", ""))
    count = lambda p: F.regexp_count("o", F.lit(p)).cast("bigint")
    return md.select("page_id", count(r"(?m)^[ >]*(?:- )?## |(?<!\\)<h2>").alias("n_h2"), count(r"(?m)^[ >]*(?:- |\d+\. |-$)|(?<!\\)<li>").alias("n_items"))


_LETTERS = "regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '[^A-Za-z0-9]+', '', 'g')"


@query(f"SELECT page_id, md5({_LETTERS.format(_BODY)}) AS digest FROM pages WHERE html IS NOT NULL AND NOT contains(html, '&') AND NOT contains(html, '<img')")
def text_letters(spark, d):
    """Without references and images, a page's text has the letters and digits of its html."""
    p = table(spark, d, "pages").where("html IS NOT NULL").where(~F.col("html").contains("&") & ~F.col("html").contains("<img"))
    return convert(p, ["page_id"], outputs=("text",)).select("page_id", F.md5(F.regexp_replace("text", "[^A-Za-z0-9]+", "")).alias("digest"))


@query(f"SELECT page_id, md5({_LETTERS.format(_BODY)}) AS digest FROM pages WHERE html IS NOT NULL AND NOT contains(html, '&')")
def safe_html_letters(spark, d):
    """Safe html keeps the letters and digits and no script, style or handler."""
    p = table(spark, d, "pages").where("html IS NOT NULL").where(~F.col("html").contains("&"))
    out = convert(p, ["page_id"], outputs=("safe_html",)).where(~F.lower("safe_html").rlike(r"<script|<style|<[^>]* on[a-z]+="))
    return out.select("page_id", F.md5(F.regexp_replace(F.regexp_replace("safe_html", "<[^>]*>", ""), "[^A-Za-z0-9]+", "")).alias("digest"))


@query(
    f"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description
    FROM pages WHERE html IS NOT NULL AND NOT contains(html, '&')"""
)
def page_head(spark, d):
    """Title and description in the head of every page without references."""
    p = table(spark, d, "pages").where("html IS NOT NULL").where(~F.col("html").contains("&"))
    out = convert(p, ["page_id"], outputs=("metadata",))
    get = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    return out.select("page_id", get("title").alias("title"), get("description").alias("description"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, '---') AND trim(text, ' \t\n\r') <> '' AND NOT regexp_matches(text, '(?m)^ *(\\* ?){3,}$|^ *(- ?){3,}$|^_{3,}$')".replace("\\\\", "\\"))
def chunks_rejoined(spark, d):
    """Chunks of a document, without overlap and with their headings, hold all its letters and digits in order."""
    from quillspan.functions.convert import split_texts
    from quillspan.operators.splitter import Split

    docs = table(spark, d, "documents").where("text IS NOT NULL").where(~F.col("text").startswith("---"))
    docs = docs.where(F.trim(F.translate("text", "\t\n\r", "   ")) != "").where(~F.col("text").rlike(r"(?m)^ *(\* ?){3,}$|^ *(- ?){3,}$|^_{3,}$"))
    out = split_texts(docs, ["doc_id"], "text", Split(size=300, overlap=0, strip_headers=False))
    own = F.array_sort(F.collect_list(F.struct("chunk_no", "content")))
    whole = F.array_join(F.transform(own, lambda x: x["content"]), "")
    return out.groupBy("doc_id").agg(F.md5(F.regexp_replace(whole, "[^A-Za-z0-9]+", "")).alias("digest"))
