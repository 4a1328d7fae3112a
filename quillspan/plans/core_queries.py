"""The queries of the library's own operators, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import negotiation, text_columns, url_columns
from quillspan.functions.convert import convert, html_events, split_texts
from quillspan.functions.sites import host_of, registered_domain, site_of, site_sql
from quillspan.operators import corpus, crawling
from quillspan.operators.options import minimal, options
from quillspan.operators.selectors import selector_column
from quillspan.operators.splitter import Split
from quillspan.plans.tables import materialize, scratch, table
from quillspan.sources import crawl

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


# the kernel ------------------------------------------------------------------


@query()
def flagship(spark, d):
    """Title, number of links and Markdown of the main content of each page."""
    return convert(pages(spark, d), ["page_id", "title"], outputs=("n_links", "markdown"), o=options(isolate_main=True))


@query()
def to_markdown(spark, d):
    return convert(pages(spark, d), ["page_id"])


@query()
def to_markdown_minimal(spark, d):
    return convert(pages(spark, d), ["page_id"], o=minimal())


@query()
def to_markdown_clean(spark, d):
    return convert(pages(spark, d), ["page_id", "url"], o=options(clean=True, wrap_width=80))


@query()
def to_text(spark, d):
    return convert(pages(spark, d), ["page_id"], outputs=("text",))


@query()
def to_safe_html(spark, d):
    return convert(pages(spark, d), ["page_id"], outputs=("safe_html",))


@query()
def filtered_markdown(spark, d):
    """Without menus and asides by selector."""
    o = options(exclude=("nav", "aside", "footer", ".menu-top", "#footer", "[role=dialog]"))
    return convert(pages(spark, d), ["page_id"], o=o)


@query()
def page_metadata(spark, d):
    return convert(pages(spark, d), ["page_id"], outputs=("metadata",)).select(
        "page_id", F.try_element_at("metadata", F.lit("title")).alias("title"), F.try_element_at("metadata", F.lit("description")).alias("description")
    )


@query()
def html_chunks(spark, d):
    """HTML to chunks in one pass of the kernel."""
    out = convert(pages(spark, d), ["page_id"], outputs=("chunks",)).select("page_id", F.explode("chunks").alias("c"))
    return out.select("page_id", "c.chunk_no", "c.content", "c.code", "c.line_from", "c.line_to")


@query()
def markdown_chunks(spark, d):
    out = split_texts(table(spark, d, "documents"), ["doc_id"], "text", Split(size=600, overlap=100))
    return out.select("doc_id", "chunk_no", "content", "code", "line_from", "line_to")


@query()
def html_event_counts(spark, d):
    return html_events(pages(spark, d), "page_id").groupBy("ev").agg(F.count(F.lit(1)).alias("n"))


_BARE = "regexp_replace(regexp_replace(html, '(?is)<(script|style|title|noscript)\\b[^>]*>.*?(</(script|style|title|noscript)>|$)', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query(
    f"""SELECT tag, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    GROUP BY tag"""
)
def tag_histogram(spark, d):
    """Start tags outside raw text, from the event relation."""
    raw = ["script", "style", "title", "noscript"]
    return html_events(pages(spark, d), "page_id").where((F.col("ev") == 0) & ~F.col("tag").isin(raw)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def extract_links(spark, d):
    out = convert(pages(spark, d), ["page_id"], outputs=("extracted",), selectors=("a[href]",)).select("page_id", F.explode("extracted").alias("e"))
    return out.select("page_id", F.col("e.attributes")["href"].alias("href"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM pages")
def select_attribute_prefix(spark, d):
    """The same through the event relation and a selector compiled to a native predicate."""
    e = html_events(pages(spark, d), "page_id").where("ev = 0")
    return e.where(selector_column('a[href^="/"]', F.col("tag"), F.col("attrs"))).select("page_id", F.col("attrs")["href"].alias("href"))


@query("SELECT page_id, len(regexp_extract_all(html, '<(?:div|section)[^>]* class=\"(?:post-content|article|sidebar)\"')) AS n FROM pages WHERE n > 0")
def select_classes(spark, d):
    e = html_events(pages(spark, d), "page_id").where("ev = 0")
    s = ", ".join(f"{t}.{c}" for t in ("div", "section") for c in ("post-content", "article", "sidebar"))
    return e.where(selector_column(s, F.col("tag"), F.col("attrs"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h2>')) AS n_h2, len(regexp_extract_all(html, '<pre>')) AS n_pre FROM pages")
def extract_counts(spark, d):
    out = convert(pages(spark, d), ["page_id"], outputs=("extracted",), selectors=("h2", "pre"))
    n = lambda t: F.size(F.filter(F.coalesce("extracted", F.array().cast(out.schema["extracted"].dataType)), lambda e: e["tag"] == t)).cast("bigint")
    return out.select("page_id", n("h2").alias("n_h2"), n("pre").alias("n_pre"))


# urls ------------------------------------------------------------------------

_TRACKED = "url || '?utm_source=feed&b=2&fbclid=z&a=1&ref=x&a=0#top'"


@query(
    f"""SELECT page_id, CASE WHEN q IS NULL THEN u ELSE base || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || frag END AS clean_url FROM (
      SELECT page_id, u, regexp_extract(u, '(#.*)$', 1) AS frag, regexp_extract(u, '^([^?#]*)', 1) AS base,
        CASE WHEN contains(regexp_replace(u, '#.*$', ''), '?') THEN regexp_extract(regexp_replace(u, '#.*$', ''), '^[^?]*\\?(.*)$', 1) END AS q,
        array_to_string(list_filter(string_split(q, '&'), lambda p: NOT regexp_matches(p, '{url_columns.TRACKING_PREFIX}')), '&') AS kept
      FROM (SELECT page_id, {_TRACKED} AS u FROM pages))"""
)
def url_strip_tracking(spark, d):
    return pages(spark, d).select("page_id", url_columns.strip_tracking(F.expr(_TRACKED)).alias("clean_url"))


@query(
    f"""SELECT page_id, regexp_replace(CASE WHEN q IS NULL OR kept = '' THEN base ELSE base || '?' || kept END, '/$', '') AS page_key FROM (
      SELECT page_id, regexp_extract(u, '^([^?#]*)', 1) AS base,
        CASE WHEN contains(regexp_replace(u, '#.*$', ''), '?') THEN regexp_extract(regexp_replace(u, '#.*$', ''), '^[^?]*\\?(.*)$', 1) END AS q,
        list_filter(string_split(q, '&'), lambda p: p <> '' AND regexp_extract(p, '^([^=]*)', 1) NOT IN ({", ".join(f"'{n}'" for n in url_columns.TRACKING_NAMES)})) AS ps,
        array_to_string(list_transform(list_sort(list_transform(ps, lambda p, i: {{'k': regexp_extract(p, '^([^=]*)', 1), 'i': i, 'p': p}})), lambda x: x.p), '&') AS kept
      FROM (SELECT page_id, {_TRACKED} AS u FROM pages))"""
)
def url_normalize(spark, d):
    return pages(spark, d).select("page_id", url_columns.normalize_url(F.expr(_TRACKED)).alias("page_key"))


_HREFS = ["#", "#top", " javascript:void(0)", "data:text/html,x", "mailto:a@b.example", "/docs", "//cdn.example/x", "HTTP://A.example/", "jav\tascript:x", "ftp://a.example/f", "tel:1", "a b"]
_HREF_SQL = "[" + ", ".join("'" + h.replace("\t", "' || chr(9) || '") + "'" for h in _HREFS) + "]"
_PLAIN = "lower(regexp_replace(regexp_replace(h, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g'))"


@query(
    f"""SELECT page_id, h AS href, regexp_matches({_PLAIN}, '^(#$|javascript:|data:|vbscript:)') AS is_empty, starts_with({_PLAIN}, 'data:') AS is_data,
      NOT regexp_matches({_PLAIN}, '^[a-z][a-z0-9+.-]*:') OR regexp_matches({_PLAIN}, '^(https?|mailto|tel|ftp):') AS is_safe,
      regexp_matches(h, '^(https?://|ftp://|mailto:)[^ <>\\n\\r\\t]*$') AS is_autolink
    FROM (SELECT page_id, ({_HREF_SQL} || [url])[page_id % {len(_HREFS) + 1} + 1] AS h FROM pages)"""
)
def url_predicates(spark, d):
    h = F.element_at(F.array(*[F.lit(x) for x in _HREFS], F.col("url")), (F.col("page_id") % (len(_HREFS) + 1) + 1).cast("int"))
    p = pages(spark, d).select("page_id", h.alias("href"))
    return p.select(
        "page_id", "href", url_columns.is_empty_href(F.col("href")).alias("is_empty"), url_columns.is_data_url(F.col("href")).alias("is_data"),
        url_columns.is_safe_url(F.col("href")).alias("is_safe"), url_columns.is_autolink(F.col("href")).alias("is_autolink"),
    )


_REFS = ["", "#top", "//cdn.example/x.js", "/a/./b/../c?x=1#y", "../up/one.html", "next", "./", "a/../../../../z", "?q=1", "mailto:a@b.example", "x/.."]


@query(
    f"""SELECT page_id, h AS href, CASE WHEN h = '' OR starts_with(h, '#') THEN h WHEN starts_with(h, '//') THEN regexp_extract(base, '^([a-z]+:)', 1) || h
      WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '?') THEN o || own || h
      ELSE o || array_to_string(done || CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE [] END, '/') || regexp_extract(h, '^[^?#]*(.*)$', 1) END AS resolved
    FROM (SELECT *, list_reduce(list_transform(parts, lambda x: [x]), lambda acc, p: CASE WHEN p[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[:-2] ELSE acc END WHEN p[1] = '.' THEN acc ELSE acc || p END) AS done
      FROM (SELECT *, string_split(CASE WHEN starts_with(h, '/') THEN regexp_extract(h, '^([^?#]*)', 1) ELSE regexp_extract(own, '^(.*/)', 1) || regexp_extract(h, '^([^?#]*)', 1) END, '/') AS parts
        FROM (SELECT page_id, {_REFS}[page_id % {len(_REFS)} + 1] AS h, url || '/deep/er/page' AS base, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS o,
          regexp_extract(url || '/deep/er/page', '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS own FROM pages)))"""
)
def url_resolve(spark, d):
    """References of all forms as seen from a page below each url: its directory, and without dot segments."""
    h = F.element_at(F.array(*map(F.lit, _REFS)), (F.col("page_id") % len(_REFS) + 1).cast("int"))
    return pages(spark, d).select("page_id", h.alias("href"), url_columns.resolve(h, F.concat("url", F.lit("/deep/er/page"))).alias("resolved"))


_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(
    f"""SELECT page_id, u AS url, NOT regexp_matches({_PATH.replace("url", "u", 1)}, '{url_columns.NO_CONTENT}')
      AND (NOT contains(regexp_extract({_PATH.replace("url", "u", 1)}, '([^/]*)$', 1), '.') OR regexp_matches({_PATH.replace("url", "u", 1)}, '(?i)\\.(html?|php|aspx?|jsp)$')) AS is_content
    FROM (SELECT page_id, [url, url || 'a.pdf', 'https://a.example/api/x', 'https://a.example/_next/y.js'][page_id % 4 + 1] AS u FROM pages)"""
)
def url_is_content(spark, d):
    u = F.element_at(F.array(F.col("url"), F.concat("url", F.lit("a.pdf")), F.lit("https://a.example/api/x"), F.lit("https://a.example/_next/y.js")), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, d).select("page_id", u.alias("url"), url_columns.is_content_url(u).alias("is_content"))


@query(
    f"""SELECT page_id, CASE WHEN len(s) = 0 THEN 'index' ELSE array_to_string(list_transform(s, lambda x: CASE WHEN lower(x) IN ({", ".join(f"'{n}'" for n in url_columns.DEVICES)}) THEN '~' || x ELSE x END), '/') END || '.md' AS file_path
    FROM (SELECT page_id, list_transform(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\\w-]', '-', 'g')) AS s FROM pages)"""
)
def markdown_paths(spark, d):
    """Where each page's Markdown goes."""
    return pages(spark, d).select("page_id", crawl.file_path(F.col("url")).alias("file_path"))


@query(
    """SELECT coalesce(page_id, -1) AS page_id, CASE WHEN p = 'index' THEN '/' WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS url
    FROM (SELECT page_id, regexp_replace(regexp_replace(f, '\\.html$', ''), '/index$', '') AS p FROM (
      SELECT page_id, [coalesce(file_path, ''), 'index.html', 'a/index.html', 'b/c.html'][coalesce(page_id, 0) % 4 + 1] AS f FROM crawl_results))"""
)
def file_urls(spark, d):
    f = F.element_at(F.array(F.coalesce("file_path", F.lit("")), F.lit("index.html"), F.lit("a/index.html"), F.lit("b/c.html")), (F.coalesce("page_id", F.lit(0)) % 4 + 1).cast("int"))
    return table(spark, d, "crawl_results").select(F.coalesce("page_id", F.lit(-1)).alias("page_id"), url_columns.file_to_url(f).alias("url"))


_SITE = site_sql("origin", "url")


@query(
    f"""SELECT page_id, site, h AS host, CASE WHEN len(string_split(h, '.')) <= 2 THEN h ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS domain
    FROM (SELECT page_id, {_SITE} AS site, nullif(regexp_extract({_SITE}, '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '') AS h FROM pages)"""
)
def site_domains(spark, d):
    p = pages(spark, d).select("page_id", site_of(F.col("origin"), F.col("url")).alias("site"))
    return p.select("page_id", "site", host_of(F.col("site")).alias("host"), registered_domain(host_of(F.col("site"))).alias("domain"))


_PATTERNS = ["https://a.example/docs/**", "b.example/x/*", "https://c.example/", "https://d.example/v?/[ab]*"]


@query(
    f"""SELECT page_id, CASE WHEN g THEN regexp_extract(f, '^([a-z]+://[^/*?\\[]*)', 1) ELSE p END AS base_url,
      CASE WHEN g THEN substring(f, length(regexp_extract(f, '^([a-z]+://[^/*?\\[]*)', 1)) + 1) ELSE '' END AS pattern, g AS is_glob
    FROM (SELECT page_id, p, regexp_matches(p, '[*?\\[]') AS g, CASE WHEN starts_with(p, 'http') THEN p ELSE 'https://' || p END AS f
      FROM (SELECT page_id, {[*_PATTERNS]}[page_id % {len(_PATTERNS)} + 1] AS p FROM pages))"""
)
def url_patterns(spark, d):
    p = F.element_at(F.array(*map(F.lit, _PATTERNS)), (F.col("page_id") % len(_PATTERNS) + 1).cast("int"))
    return pages(spark, d).select("page_id", url_columns.pattern_parts(p).alias("x")).select("page_id", "x.*")


_EXCLUDES = ["/guides/*", "*.html", "https://blog.kitevavel.test/**", "**/pavi*"]


@query(
    f"""SELECT page_id, regexp_matches(r, '{corpus.glob_regex("/guides/**")}') OR regexp_matches(r, '{corpus.glob_regex("*.html")}') OR regexp_matches(substring(r, 2), '{corpus.glob_regex("*.html")}')
      OR (starts_with(url, 'https://blog.kitevavel.test/') AND regexp_matches(r, '{corpus.glob_regex("/**")}')) OR regexp_matches(r, '{corpus.glob_regex("**/pavi*")}') OR regexp_matches(substring(r, 2), '{corpus.glob_regex("**/pavi*")}') AS excluded
    FROM (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1) AS r FROM pages)"""
)
def exclude_globs(spark, d):
    return pages(spark, d).select("page_id", corpus.excluded(F.col("url"), _EXCLUDES).alias("excluded"))


# texts -----------------------------------------------------------------------


@query(
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_ \\t-]', '', 'g'), '[ \\t-]+', '-', 'g'), '-+$', '') AS slug,
      regexp_replace(lower(title), '[^a-z0-9]', '-', 'g') AS anchor FROM pages"""
)
def slugs(spark, d):
    return pages(spark, d).select("page_id", text_columns.slugify(F.col("title")).alias("slug"), text_columns.toc_anchor(F.col("title")).alias("anchor"))


@query("SELECT chunk_id, len(regexp_extract_all(content, '[\\[\\]()#*|!:-]|[^ \\n\\t\\r\\[\\]()#*|!:-]+')) AS n_tokens FROM chunks")
def word_token_counts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", text_columns.word_tokens(F.col("content")).cast("bigint").alias("n_tokens"))


@query(
    """SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped,
      md5(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS collapsed, md5(regexp_replace(text, '([\\\\*_~`\\[])', '\\\\\\1', 'g')) AS marked FROM documents"""
)
def text_escapes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text_columns.html_escape(t)).alias("escaped"), F.md5(text_columns.collapse_space(t)).alias("collapsed"), F.md5(text_columns.escape_inline(t)).alias("marked")
    )


_NUMBERS = ["12", " +7 ", "4294967295", "4294967296", "-1", "0012", "1e3", "", "99999999999999999999"]


@query(
    f"""SELECT page_id, coalesce(CASE WHEN n <= 4294967295 THEN n END, -1) AS number FROM (
      SELECT page_id, CASE WHEN s <> '' AND length(regexp_replace(s, '^0+', '')) <= 10 THEN s::BIGINT END AS n FROM (
        SELECT page_id, regexp_extract({_NUMBERS}[page_id % {len(_NUMBERS)} + 1], '^[ \\t\\n\\f\\r]*\\+?([0-9]+)[ \\t\\n\\f\\r]*$', 1) AS s FROM pages))"""
)
def strict_numbers(spark, d):
    s = F.element_at(F.array(*map(F.lit, _NUMBERS)), (F.col("page_id") % len(_NUMBERS) + 1).cast("int"))
    return pages(spark, d).select("page_id", F.coalesce(text_columns.strict_u32(s), F.lit(-1)).alias("number"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(title, '[\\n:# ]') THEN '"' || replace(replace(title, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE title END AS yaml FROM pages"""
)
def yaml_titles(spark, d):
    return pages(spark, d).select("page_id", text_columns.yaml_quoted(F.col("title")).alias("yaml"))


_FRONT = "'---\ntitle: ' || coalesce(title, 'none') || '\nlang: x\nmeta:\n  lang: ' || coalesce(lang, 'none') || '\n---\n\n# ' || coalesce(title, 'none') || '\n\nBody.'"
_FRONT_SQL = _FRONT.replace("\n", "' || chr(10) || '")


@query(
    f"""SELECT page_id, trim(coalesce(title, 'none')) AS title, coalesce(trim(lang), 'none') AS lang, 'Body.' AS body FROM pages"""
)
def frontmatter_fields(spark, d):
    """Parse a front block (the last of a key holds) and drop the title that the body repeats."""
    p = pages(spark, d).select("page_id", F.coalesce("title", F.lit("none")).alias("t"), F.expr(_FRONT_SQL).alias("md"))
    m = text_columns.frontmatter_map(F.col("md"))
    body = text_columns.body_without_title(F.col("md"), F.trim("t"))
    return p.select("page_id", m["title"].alias("title"), m["lang"].alias("lang"), F.trim(body).alias("body"))


@query(
    """SELECT doc_id, line_no::INT AS line_no, line FROM (
      SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
    WHERE regexp_matches(line, '[^ \\t\\r]')"""
)
def chunk_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(r"[^ \t\r]")).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


_SECTION = """WITH line AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
marked AS (SELECT *, regexp_matches(line, '^## ') AS h2, regexp_matches(line, '^(-{3,}|\\*{3,})[ \\t]*$') AS rule FROM line),
counted AS (SELECT *, sum(h2::INT) OVER w AS seen, sum(rule::INT) OVER w AS rules FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
placed AS (SELECT *, greatest(seen - 1, 0) + rules AS section, last_value(CASE WHEN regexp_matches(line, '^#{1,6} ') THEN regexp_replace(line, '^#{1,6} +', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS heading FROM counted)
"""


@query(
    _SECTION
    + "SELECT doc_id, section::BIGINT AS section, min(n)::INT AS line_from, max(n)::INT AS line_to, count(*) FILTER (line <> '') AS n_lines, arg_max(heading, n) AS heading FROM placed GROUP BY doc_id, section"
)
def markdown_sections(spark, d):
    """Sections as a relation: a new one at each level-two heading but the first, and at each rule; with its last heading."""
    w = Window.partitionBy("doc_id").orderBy("n")
    line = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("n"), "line")
    seen = F.sum(F.col("line").rlike("^## ").cast("int")).over(w)
    rules = F.sum(F.col("line").rlike(r"^(-{3,}|\*{3,})[ \t]*$").cast("int")).over(w)
    heading = F.last(F.when(F.col("line").rlike("^#{1,6} "), F.regexp_replace("line", "^#{1,6} +", "")), True).over(w)
    placed = line.withColumns({"section": F.greatest(seen - 1, F.lit(0)) + rules, "heading": heading})
    return placed.groupBy("doc_id", "section").agg(
        F.min("n").alias("line_from"), F.max("n").alias("line_to"), F.count_if(F.col("line") != "").alias("n_lines"), F.max_by("heading", "n").alias("heading")
    )


# negotiation -----------------------------------------------------------------

_ACCEPTS = [
    "text/markdown", "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "text/html;q=0.5, text/markdown;q=0.9", "*/*", "application/json", "",
    "text/plain;Q=0.4,text/html;q=0.4", "text/markdown;q=0,*/*", "text/html;q=0,*/*;q=0.1", ", text/*;q=0.3 ,", "text/markdown;q=abc", "TEXT/HTML;level=1, text/markdown;q=1",
]
_ACCEPT = f"{_ACCEPTS}[page_id % {len(_ACCEPTS)} + 1]"
_ENTRIES = f"""WITH h AS (SELECT page_id, {_ACCEPT} AS a, CASE WHEN page_id % 7 = 0 THEN 'document' END AS dest FROM pages),
part AS (SELECT page_id, unnest(string_split(a, ',')) AS p, unnest(range(len(string_split(a, ',')))) AS position FROM h),
entry AS (SELECT page_id, trim(string_split(trim(p), ';')[1]) AS type,
  CASE WHEN regexp_matches(p, ';.*?[qQ]=') THEN coalesce(try_cast(nullif(regexp_extract(p, ';.*?[qQ]=([^; ]*)', 1), '') AS DOUBLE), 0.0) ELSE 1.0 END::DOUBLE AS q, position::INT AS position
  FROM part WHERE trim(p) <> '')
"""


def _accept(spark, d):
    a = F.element_at(F.array(*map(F.lit, _ACCEPTS)), (F.col("page_id") % len(_ACCEPTS) + 1).cast("int"))
    return pages(spark, d).select("page_id", a.alias("accept"), F.when(F.col("page_id") % 7 == 0, "document").alias("dest"))


@query(_ENTRIES + "SELECT * FROM entry")
def accept_entries(spark, d):
    e = _accept(spark, d).select("page_id", F.explode(negotiation.accept_entries(F.col("accept"))).alias("e"))
    return e.select("page_id", "e.type", "e.q", "e.position")


@query(
    _ENTRIES
    + """, kind AS (SELECT *, CASE WHEN lower(type) IN ('text/markdown', 'text/plain') THEN 'md' WHEN lower(type) IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN type IN ('*/*', 'text/*') THEN 'any' END AS k FROM entry),
    best AS (SELECT page_id, count(*) AS n, max(struct_pack(q := q, p := -position)) FILTER (k = 'md' AND q > 0) AS md, max(struct_pack(q := q, p := -position)) FILTER (k = 'html' AND q > 0) AS html,
      max(struct_pack(q := q, p := -position)) FILTER (k = 'any' AND q > 0) AS a, bool_or(k = 'md' AND q = 0) AS no_md, bool_or(k = 'html' AND q = 0) AS no_html FROM kind GROUP BY page_id),
    both_ AS (SELECT page_id, n, coalesce(md, CASE WHEN NOT coalesce(no_md, false) THEN a END) AS md, coalesce(html, CASE WHEN NOT coalesce(no_html, false) THEN a END) AS html FROM best)
    SELECT h.page_id, CASE WHEN dest = 'document' OR h.a = '' OR n IS NULL THEN 'html' WHEN md IS NULL AND html IS NULL THEN 'not-acceptable' WHEN md IS NULL THEN 'html'
      WHEN html IS NULL OR md > html THEN 'markdown' ELSE 'html' END AS served FROM h LEFT JOIN both_ USING (page_id)"""
)
def negotiate(spark, d):
    return _accept(spark, d).select("page_id", negotiation.negotiate(F.col("accept"), F.col("dest")).alias("served"))


@query(
    f"SELECT page_id, NOT regexp_matches({_PATH}, '^/(api|_|@)') AND (NOT contains(regexp_extract({_PATH}, '([^/]*)$', 1), '.') OR ends_with({_PATH}, '.md')) AS eligible FROM pages"
)
def routes(spark, d):
    return pages(spark, d).select("page_id", negotiation.route_eligible(url_columns.url_path(F.col("url"))).alias("eligible"))


# crawl -----------------------------------------------------------------------

_EDGES = f"""edge AS (SELECT DISTINCT {_SITE} AS src, url AS dst FROM pages WHERE {_SITE} IS NOT NULL
  UNION SELECT url, l FROM (SELECT url, unnest(links) AS l FROM pages) WHERE l IS NOT NULL)"""


def _edges(spark, d):
    p = pages(spark, d)
    roots = p.select(site_of(F.col("origin"), F.col("url")).alias("src"), F.col("url").alias("dst")).where("src IS NOT NULL")
    return roots.union(p.select("url", F.explode("links")).where("col IS NOT NULL")).distinct()


@query(f"WITH {_EDGES} SELECT src, count(*) AS n_out FROM edge GROUP BY src")
def out_degrees(spark, d):
    return _edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))


@query(
    f"""WITH RECURSIVE {_EDGES}, walk(url, depth) AS (SELECT DISTINCT src, 0 FROM edge WHERE src NOT IN (SELECT dst FROM edge WHERE dst IS NOT NULL) AND regexp_matches(src, '^[a-z]+://[^/]+$')
      UNION SELECT dst, depth + 1 FROM walk JOIN edge ON src = walk.url WHERE depth < 3)
    SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url"""
)
def bfs_depth(spark, d):
    """Breadth-first waves from the sites' roots along their pages and links."""
    e = materialize(_edges(spark, d), "edges")
    starts = e.where(F.col("src").rlike("^[a-z]+://[^/]+$")).select(F.col("src").alias("url")).distinct()
    roots = starts.join(e.select(F.col("dst").alias("url")), "url", "left_anti")
    return corpus.walk_links(e, roots, 3)


@query(
    """WITH u AS (SELECT regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '' ELSE '?v=' || (page_id % 9) END AS url, page_id FROM pages),
    f AS (SELECT url, regexp_extract(url, '^([^?#]*)', 1) AS path, contains(url, '?') AS variant, min(page_id) AS since FROM u GROUP BY ALL)
    SELECT url, CASE WHEN variant THEN n::INT ELSE 0 END AS n FROM (SELECT *, row_number() OVER (PARTITION BY path, variant ORDER BY since, url) AS n FROM f) WHERE NOT variant OR n <= 3"""
)
def query_variants(spark, d):
    """Three query variants of a path at most; urls without a query all stay."""
    query = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("?v="), (F.col("page_id") % 9).cast("string")))
    u = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), query)
    return corpus.capped_variants(pages(spark, d).select(u.alias("url"), "page_id"), "page_id", 3)


@query(
    """SELECT url, coalesce(page_id, -1) AS page_id, ts_ms, success FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY received_at, ts_ms, page_id NULLS FIRST, success, depth NULLS FIRST) AS n FROM crawl_results) WHERE n = 1"""
)
def first_fetches(spark, d):
    """Of the results of one url the first received."""
    out = crawling.first_fetches(table(spark, d, "crawl_results"), "url", ["received_at", "ts_ms", "page_id", "success", "depth"])
    return out.select("url", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "ts_ms", "success")


@query(
    """SELECT coalesce(depth, -1) AS depth, count(*) AS n, count(*) FILTER (success) AS n_ok, sum(lag)::BIGINT AS total_ms, min(lag) AS least_ms, max(lag) AS most_ms
    FROM (SELECT depth, success, epoch_us(received_at) // 1000 - ts_ms AS lag FROM crawl_results) GROUP BY 1"""
)
def crawl_latency(spark, d):
    """Counters and delays of a crawl by depth."""
    lag = F.expr("unix_micros(CAST(received_at AS timestamp)) div 1000 - ts_ms")
    r = table(spark, d, "crawl_results").select(F.coalesce("depth", F.lit(-1)).alias("depth"), "success", lag.alias("lag"))
    return crawling.latency(r, ["depth"], F.col("lag"))


@query("SELECT origin, unnest(list_transform(regexp_extract_all(robots, '(?i)Sitemap:[ \\t]*([^\\r\\n]*)', 1), lambda x: trim(x))) AS sitemap FROM sites")
def robots_sitemaps(spark, d):
    return table(spark, d, "sites").select("origin", F.explode(crawl.robots_sitemaps(F.col("robots"))).alias("sitemap"))


@query("SELECT origin, try_cast(nullif(regexp_extract(robots, '(?i)Crawl-delay:\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS delay FROM sites")
def robots_delay(spark, d):
    return table(spark, d, "sites").select("origin", crawl.robots_delay(F.col("robots")).alias("delay"))


@query(f"SELECT DISTINCT {_SITE} AS root, url || '?a=1&b=<2>' AS url FROM pages WHERE {_SITE} IS NOT NULL")
def sitemap_roundtrip(spark, d):
    """Sitemaps written from the pages, an index above them, and both read back."""
    loc = text_columns.html_escape(F.concat("url", F.lit("?a=1&b=<2>")))
    entry = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>"))
    p = pages(spark, d).select(site_of(F.col("origin"), F.col("url")).alias("root"), entry.alias("e"), (F.col("page_id") % 50).alias("part")).where("root IS NOT NULL")
    maps = p.groupBy("root", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_set("e"), "\n"), F.lit("</urlset>")).alias("xml"))
    maps = maps.select("root", F.concat("root", F.lit("/map-"), F.col("part").cast("string")).alias("address"), "xml")
    child = F.concat(F.lit("<sitemap><loc><![CDATA["), "address", F.lit("]]></loc></sitemap>"))
    index = maps.groupBy("root").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(child), ""), F.lit("</sitemapindex>")).alias("xml"))
    files = maps.select("address", "xml").union(index.select(F.concat("root", F.lit("/sitemap.xml")), "xml"))
    start = index.select("root", F.concat("root", F.lit("/sitemap.xml")).alias("address"))
    return crawl.expand_sitemaps(start, materialize(files, "sitemap_files"))


# chrome and artifacts ----------------------------------------------------------

_CHROME = f"""WITH site AS (SELECT page_id, min({_SITE}) AS site FROM pages GROUP BY 1),
doc AS (SELECT site, page_id, string_agg(content, chr(10) ORDER BY chunk_no) AS text FROM (SELECT DISTINCT page_id, chunk_no, content FROM chunks) JOIN site USING (page_id) WHERE site IS NOT NULL GROUP BY ALL),
tok AS (SELECT site, page_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT site, page_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM doc)),
sh AS (SELECT * FROM (SELECT site, page_id, pos, CASE WHEN lead(token, 5) OVER w IS NOT NULL THEN concat_ws(' ', token, lead(token, 1) OVER w, lead(token, 2) OVER w, lead(token, 3) OVER w, lead(token, 4) OVER w, lead(token, 5) OVER w) END AS shingle
  FROM tok WINDOW w AS (PARTITION BY site, page_id ORDER BY pos)) WHERE shingle IS NOT NULL),
n AS (SELECT site, count(DISTINCT page_id) AS n FROM sh GROUP BY 1),
chrome AS (SELECT site, shingle, count(DISTINCT page_id) AS df FROM sh JOIN n USING (site) GROUP BY site, shingle, n HAVING n >= 3 AND df >= greatest(2, ceil(0.5 * n)))
"""


def _page_texts(spark, d):
    sites = pages(spark, d).groupBy("page_id").agg(F.min(site_of(F.col("origin"), F.col("url"))).alias("site")).where("site IS NOT NULL")
    c = table(spark, d, "chunks").select("page_id", "chunk_no", "content")
    # a chunk that arrived twice is one element of the set
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("chunk_no", "content"))), lambda x: x["content"]), "\n")
    return c.groupBy("page_id").agg(text.alias("text")).join(sites, "page_id").select("site", "page_id", "text")


@query(_CHROME + "SELECT site, md5(shingle) AS shingle, df FROM chrome")
def chrome_shingles(spark, d):
    t = corpus.tokens(_page_texts(spark, d), ["site", "page_id"], "text")
    s = corpus.shingles(t, ["site", "page_id"])
    return corpus.chrome_shingles(s, "site", "page_id").select("site", F.md5("shingle").alias("shingle"), "df")


@query(
    _CHROME
    + """, starts AS (SELECT site, page_id, pos FROM sh SEMI JOIN chrome USING (site, shingle)),
    cov AS (SELECT tok.*, coalesce(max(CASE WHEN starts.pos IS NOT NULL THEN 1 END) OVER (PARTITION BY tok.site, tok.page_id ORDER BY tok.pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS covered FROM tok LEFT JOIN starts USING (site, page_id, pos)),
    run AS (SELECT *, pos - row_number() OVER (PARTITION BY site, page_id, covered ORDER BY pos) AS r FROM cov),
    len_ AS (SELECT *, count(*) OVER (PARTITION BY site, page_id, covered, r) AS l FROM run),
    kept AS (SELECT *, (NOT (covered = 1 AND l >= 12)) OR bool_and(covered = 1 AND l >= 12) OVER (PARTITION BY site, page_id) AS keep FROM len_),
    sep AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY site, page_id, keep ORDER BY pos) = 1 THEN '' WHEN NOT coalesce(lag(keep) OVER (PARTITION BY site, page_id ORDER BY pos), true) THEN chr(10) || chr(10) ELSE ' ' END AS s FROM kept)
    SELECT page_id, md5(coalesce(string_agg(s || token, '' ORDER BY pos) FILTER (keep), '')) AS digest, count(*) AS n_tokens, count(*) FILTER (keep) AS n_kept FROM sep GROUP BY page_id"""
)
def chrome_stripped(spark, d):
    """Each page's text without the word runs that its site repeats."""
    out = corpus.strip_chrome(materialize(_page_texts(spark, d), "page_texts"), "site", "page_id", "text")
    return out.select("page_id", F.md5("text").alias("digest"), "n_tokens", "n_kept")


_PLACED = f"""WITH p AS (SELECT page_id, {_SITE} AS site, url, title, description, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS seg FROM pages WHERE {_SITE} IS NOT NULL),
k AS (SELECT *, '/' || coalesce(seg[1], '') AS one, CASE WHEN len(seg) > 1 THEN '/' || seg[1] || '/' || seg[2] ELSE '/' || coalesce(seg[1], '') END AS two FROM p),
c AS (SELECT *, count(*) OVER (PARTITION BY site, two) AS n2, max(len(seg)) OVER (PARTITION BY site, one) > 1 AS deep FROM k),
g AS (SELECT *, CASE WHEN len(seg) <= 1 AND NOT deep THEN '' WHEN n2 > 1 THEN two ELSE one END AS grp FROM c),
placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY grp, seg, page_id) AS place FROM g)
"""


def _placed(spark, d):
    p = pages(spark, d).select("page_id", site_of(F.col("origin"), F.col("url")).alias("site"), "url", "title", "description", url_columns.url_path(F.col("url")).alias("path")).where("site IS NOT NULL")
    return corpus.sorted_pages(p, "site", "path", "page_id")


@query(_PLACED + 'SELECT page_id, grp AS "group", place::INT AS place FROM placed')
def pages_sorted(spark, d):
    return _placed(spark, d).select("page_id", "group", "place")


@query(
    _PLACED
    + """, b AS (SELECT *, coalesce(grp <> lag(grp) OVER w, false) AS fresh FROM placed WINDOW w AS (PARTITION BY site ORDER BY place)),
    m AS (SELECT *, sum(fresh::INT) OVER w + CASE WHEN first_value(grp) OVER w = '' THEN 0 ELSE 1 END AS num FROM b WINDOW w AS (PARTITION BY site ORDER BY place)),
    s AS (SELECT *, count(*) OVER (PARTITION BY site, num) AS size FROM m),
    l AS (SELECT *, lag(num) OVER w AS bn, lag(size) OVER w AS bs FROM s WINDOW w AS (PARTITION BY site ORDER BY place))
    SELECT page_id, coalesce(fresh AND (bn = 0 OR (bn BETWEEN 1 AND 2 AND bs > 1)), false) AS breaks FROM l"""
)
def group_breaks(spark, d):
    return corpus.group_breaks(_placed(spark, d), "site").select("page_id", "breaks")


@query(
    _PLACED
    + f""", names AS (SELECT {site_sql("origin", "origin")} AS site, any_value(site_name ORDER BY first_seen, origin) AS site_name, any_value(description ORDER BY first_seen, origin) AS site_description FROM sites GROUP BY 1),
    lists AS (SELECT site, string_agg('- [' || coalesce(title, '') || '](' || url || ')' || CASE WHEN coalesce(description, '') = '' THEN '' ELSE ': ' || substring(description, 1, 100) || CASE WHEN length(description) > 100 THEN '...' ELSE '' END END || chr(10), '' ORDER BY place) AS list FROM placed GROUP BY 1)
    SELECT site, md5('# ' || coalesce(nullif(site_name, ''), 'Site') || chr(10) || chr(10) || CASE WHEN coalesce(site_description, '') = '' THEN '' ELSE '> ' || site_description || chr(10) || chr(10) END
      || 'Canonical Origin: ' || site || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || list) AS digest FROM lists LEFT JOIN names USING (site)"""
)
def llms_txt(spark, d):
    """The index of each site as one artifact (its digest here)."""
    nm = table(spark, d, "sites").groupBy(site_of(F.col("origin"), F.col("origin")).alias("site"))
    pick = lambda c: F.array_min(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("first_seen", "origin", F.col(c).alias("v")))))["v"]
    names = nm.agg(pick("site_name").alias("site_name"), pick("description").alias("site_description"))
    out = corpus.llms_index(_placed(spark, d), names, "site")
    return out.select("site", F.md5("llms_txt").alias("digest"))


@query(
    _PLACED
    + """, doc AS (SELECT page_id, string_agg(content, chr(10) ORDER BY chunk_no) AS content FROM (SELECT DISTINCT page_id, chunk_no, content FROM chunks) GROUP BY 1),
    full_ AS (SELECT site, place, coalesce(placed.title, '') AS t, placed.url, placed.description, keywords, author, coalesce(content, '') AS c, trim(regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g')) AS tr
      FROM placed JOIN pages USING (page_id) LEFT JOIN doc USING (page_id)),
    page AS (SELECT site, place, '- [' || t || '](#' || regexp_replace(lower(t), '[^a-z0-9]', '-', 'g') || ')' || chr(10) AS toc,
      '---' || chr(10) || 'title: ' || t || chr(10) || 'url: ' || url || chr(10) || CASE WHEN coalesce(description, '') = '' THEN '' ELSE 'description: ' || description || chr(10) END
      || CASE WHEN coalesce(keywords, '') = '' THEN '' ELSE 'keywords: ' || keywords || chr(10) END || CASE WHEN coalesce(author, '') = '' THEN '' ELSE 'author: ' || author || chr(10) END || '---' || chr(10) || chr(10)
      || CASE WHEN string_split(tr, chr(10))[1] IN (t, '# ' || t) THEN regexp_replace(regexp_replace(tr, '^[^\\n]*\\n?', ''), '^\\s+', '') ELSE c END || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS text FROM full_)
    SELECT site, md5('# ' || site || chr(10) || chr(10) || '## Table of Contents' || chr(10) || chr(10) || string_agg(toc, '' ORDER BY place) || chr(10) || '---' || chr(10) || chr(10) || string_agg(text, '' ORDER BY place)) AS digest
    FROM page GROUP BY site"""
)
def llms_full(spark, d):
    """The whole text of each site as one artifact (its digest here)."""
    more = pages(spark, d).select("page_id", "keywords", "author")
    text = _page_texts(spark, d).select("page_id", F.col("text").alias("content"))
    p = _placed(spark, d).join(more, "page_id").join(text, "page_id", "left")
    return corpus.llms_full(p, "site").select("site", F.md5("llms_full").alias("digest"))


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(regexp_replace(text, '(?s)^---[^\\n]*\\n.*?\\n---[^\\n]*\\n?', ''), '^\\s+|\\s+$', '', 'g')) > 10")
def content_filter(spark, d):
    return corpus.with_content(table(spark, d, "documents"), "text").select("doc_id")


@query(
    f"""SELECT site, url FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS n FROM (
      SELECT DISTINCT {_SITE} AS site, regexp_replace(url, '/$', '') AS url FROM pages WHERE {_SITE} IS NOT NULL)) WHERE n <= 5"""
)
def start_urls(spark, d):
    """Start addresses of each site, once whether they end in a slash or not, five a site at most."""
    u = pages(spark, d).select(site_of(F.col("origin"), F.col("url")).alias("site"), "url")
    return crawling.start_urls(u, "site", "url", "url", 5)


@query(
    f"""SELECT site, coalesce(max(name), max(home), regexp_extract(site, '^[a-z]+://([^/:]+)', 1)) AS name FROM (
      SELECT {_SITE} AS site, NULL AS name, CASE WHEN {_PATH} IN ('', '/') THEN nullif(title, '') END AS home FROM pages
      UNION ALL SELECT {site_sql("origin", "origin")}, nullif(site_name, ''), NULL FROM sites) WHERE site IS NOT NULL GROUP BY site"""
)
def site_names(spark, d):
    """A site's name: the given one, the title of its home page, or its host."""
    p = pages(spark, d).select(site_of(F.col("origin"), F.col("url")).alias("site"), "url", "title", "description", F.col("page_id").alias("at"))
    s = table(spark, d, "sites").select(site_of(F.col("origin"), F.col("origin")).alias("site"), F.col("site_name").alias("name"), "description")
    return crawling.site_names(p, s).select("site", "name")


# streams -----------------------------------------------------------------------


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Hourly tumbling windows over the event stream, run to its end."""
    from quillspan.streaming.convert_stream import run_once, windowed_counts

    path = scratch(spark, "run")
    table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(f"{path}/in")
    # complete mode: the windows that no watermark has closed come out too
    run_once(windowed_counts(stream, "ts", "1 hour"), f"{path}/run", "complete")
    counted = spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(f"{path}/run/out")
    return counted.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT page_id AS doc_id, true AS complete, true AS equals_batch, length(html) > 700 AS in_parts FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL")
def stream_markdown(spark, d):
    """Pages cut into pieces and sent through the streaming converter in several batches; the joined parts equal the batch result."""
    streamed = _streamed(spark, d)
    from quillspan.streaming.convert_stream import joined_parts

    n = streamed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    batch = convert(pages(spark, d).where("page_id IS NOT NULL AND html IS NOT NULL").withColumn("size", F.length("html")), ["page_id", "size"])
    out = joined_parts(streamed).join(n, "doc_id").join(batch, F.col("doc_id") == F.col("page_id"))
    return out.select("doc_id", "complete", F.expr("text <=> markdown").alias("equals_batch"), (F.col("size") > 700).alias("in_parts"))


def _streamed(spark, d):
    from quillspan.streaming.convert_stream import convert_pieces, run_once

    path = scratch(spark, "run")
    size = 700
    n = F.greatest(F.lit(1), F.ceil(F.length("html") / size)).cast("int")
    p = pages(spark, d).where("page_id IS NOT NULL AND html IS NOT NULL").select(F.col("page_id").alias("doc_id"), "html", n.alias("n"))
    p = p.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"), "html", "n")
    pieces = p.select("doc_id", F.col("seq").cast("int").alias("seq"), F.substring("html", F.col("seq") * size + 1, F.lit(size)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("is_last"))
    pieces.repartition(3, "seq").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run_once(convert_pieces(stream, timeout_ms=None), f"{path}/run")
    return spark.read.schema("doc_id bigint, part int, text string, complete boolean").parquet(f"{path}/run/out")
