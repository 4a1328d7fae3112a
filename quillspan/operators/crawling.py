"""Planning and finishing a crawl, on DataFrames: what to fetch, what a page says about itself, what is written."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.convert import convert
from quillspan.functions.fetching import media_type
from quillspan.functions.sites import host_of, registrable_domain
from quillspan.functions.url_columns import normalize_url, pattern_of, resolve, url_path
from quillspan.operators.corpus import excluded, glob_regex

#: Where sitemaps usually are.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap-index.xml")
#: What a crawl can write, in the order in which it is written.
ARTIFACTS = ("llms.txt", "llms-full.txt", "markdown")
_TITLE = ("title", 'meta[property="og:title"]')
_DESCRIPTION = ('meta[name="description"]', 'meta[property="og:description"]')
_FIELDS = (*_TITLE, *_DESCRIPTION, 'meta[name="keywords"]', 'meta[name="author"]', "a[href]")


def page_metadata(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", domains: Iterable[str] = ()) -> DataFrame:
    """``keep``, ``title``, ``description``, ``keywords``, ``author`` and ``links`` of each page.

    The first that isn't empty holds, in document order, of the title and og:title, and of the description and
    og:description; a page without a title has its path. Links are resolved, normalised, each once, in order:
    those of the page's own origin, or of the registrable domains given.
    """
    out = convert(pages.withColumn("__url", F.col(url)), [*keep, "__url"], html, ("extracted",), selectors=_FIELDS)

    def first(names: tuple[str, ...]) -> Column:
        said = F.transform(
            F.filter("extracted", lambda e: e["selector"].isin(*names)),
            lambda e: F.trim(F.when(e["tag"] == "title", e["text"]).otherwise(F.coalesce(e["attributes"]["content"], F.lit("")))),
        )
        return F.get(F.filter(said, lambda s: s != ""), F.lit(0))

    origin = F.regexp_extract("__url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    hrefs = F.transform(F.filter("extracted", lambda e: (e["selector"] == "a[href]") & (e["attributes"]["href"] != "")), lambda e: e["attributes"]["href"])
    links = F.array_distinct(F.transform(hrefs, lambda h: normalize_url(resolve(F.regexp_replace(h, "#.*$", ""), F.col("__url")))))
    wanted = list(domains)
    if wanted:
        links = F.filter(links, lambda u: registrable_domain(host_of(F.lower(u))).isin(wanted))
    else:
        links = F.filter(links, lambda u: u.startswith(F.concat(origin, F.lit("/"))) | (u == origin))
    return out.select(
        *keep, F.coalesce(first(_TITLE), url_path(F.col("__url"))).alias("title"), first(_DESCRIPTION).alias("description"),
        first(('meta[name="keywords"]',)).alias("keywords"), first(('meta[name="author"]',)).alias("author"), links.alias("links"),
    )


def matches_pattern(url: Column, pattern: str, allow_subdomains: bool = False) -> Column:
    """Whether a url lies under a url pattern: the same scheme and host (or registrable domain), and its path, query and
    fragment fit the glob. A last ``x*`` also takes what is below ``x/``. A pattern without a glob takes everything."""
    base, glob, is_glob = pattern_of(pattern)
    if not is_glob:
        return F.lit(True)
    if glob.endswith("*") and not glob.endswith(("**", "/*")):
        glob = f"{{{glob[:-1]},{glob[:-1]}/**}}"
    own = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    same = registrable_domain(host_of(F.lower(own))) == registrable_domain(host_of(F.lit(base.lower()))) if allow_subdomains else own == base
    return same & rest.rlike(glob_regex(glob))


def filter_urls(urls: DataFrame, patterns: list[str], exclude: list[str], allow_subdomains: bool = False, url: str = "url") -> DataFrame:
    """The urls that no exclusion takes and, where there are glob patterns, one of them does."""
    kept = urls.where(~excluded(F.col(url), exclude))
    globs = [p for p in patterns if pattern_of(p)[2]]
    if not globs:
        return kept
    return kept.where(reduce(lambda a, b: a | b, [matches_pattern(F.col(url), p, allow_subdomains) for p in globs]))


def same_site_links(links: DataFrame, src: str, dst: str, domains: Iterable[str] = ()) -> DataFrame:
    """Links that stay on the origin of their page, or within registrable domains."""
    wanted = list(domains)
    if wanted:
        return links.where(registrable_domain(host_of(F.lower(dst))).isin(wanted))
    origin = lambda c: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return links.where(origin(dst) == origin(src))


def sitemap_candidates(sites: DataFrame, site: str, robots: str) -> DataFrame:
    """``(site, address, rank)``: sitemaps named by the robots file in order, then the usual places; each address once."""
    from quillspan.sources.crawl import robots_sitemaps

    named = F.coalesce(robots_sitemaps(F.col(robots)), F.array().cast("array<string>"))
    usual = F.array(*[F.concat(F.col(site), F.lit(p)) for p in SITEMAP_PATHS])
    return sites.where(F.col(site).isNotNull()).select(site, F.posexplode(F.array_distinct(F.concat(named, usual))).alias("rank", "address")).select(site, "address", "rank")


def sitemap_urls(candidates: DataFrame, found: DataFrame, site: str, merge: bool = False) -> DataFrame:
    """``(site, url)``: the urls of a site's first candidate that yields any, or of all of them.

    ``candidates`` is ``(site, address, rank)``, ``found`` the (filtered) ``(address, url)`` of the sitemaps that loaded.
    """
    got = candidates.join(found, "address")
    if not merge:
        best = got.groupBy(site).agg(F.min("rank").alias("rank"))
        got = got.join(best, [site, "rank"])
    return got.select(site, "url").distinct()


def start_urls(urls: DataFrame, site: str, url: str, order: str, max_pages: int) -> DataFrame:
    """``(site, url)``: start addresses in their order, once whether they end in a slash or not, ``max_pages`` a site at most."""
    key = F.regexp_replace(url, "/$", "")
    once = urls.where(F.col(site).isNotNull()).groupBy(site, key.alias("url")).agg(F.min(order).alias("__at"))
    return limit_pages(once, site, ["__at", "url"], max_pages).select(site, "url")


def limit_pages(urls: DataFrame, site: str, order: list[str], max_pages: int) -> DataFrame:
    """The first ``max_pages`` rows of each site. Spark cuts each task's rows to that many before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(site).orderBy(*order))
    return urls.withColumn("__rank", rank).where(F.col("__rank") <= max_pages).drop("__rank")


def first_fetches(results: DataFrame, url: str, order: list[str]) -> DataFrame:
    """The first row of each url, by an aggregate that combines before the shuffle."""
    rest = [c for c in results.columns if c != url]
    whole = F.min_by(F.struct(*rest), F.struct(*order)).alias("x")
    return results.where(F.col(url).isNotNull()).groupBy(url).agg(whole).select(*[F.col(url) if c == url else F.col(f"x.`{c}`").alias(c) for c in results.columns])


def latency(results: DataFrame, by: list[str], lag: Column) -> DataFrame:
    """Number of fetches, successes, and the total, least and most of their delay."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"), F.sum(lag).alias("total_ms"), F.min(lag).alias("least_ms"), F.max(lag).alias("most_ms")
    )


def site_names(pages: DataFrame, given: DataFrame) -> DataFrame:
    """``(site, name, description)``: what is given, what the home page says, or the host and the first page's description.

    ``pages`` is ``(site, url, title, description, at)`` in order of ``at``, ``given`` ``(site, name, description)``.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    home = url_path(F.col("url")).isin("", "/")
    said = pages.where("site IS NOT NULL").groupBy("site").agg(
        F.max(F.when(home, blank("title"))).alias("home"), F.max(F.when(home, blank("description"))).alias("home_says"),
        F.min_by(blank("description"), "at").alias("first_says"),
    )
    told = given.where("site IS NOT NULL").groupBy("site").agg(F.max(blank("name")).alias("given"), F.max(blank("description")).alias("given_says"))
    return said.join(told, "site", "full").select(
        "site", F.coalesce("given", "home", host_of(F.col("site"))).alias("name"), F.coalesce("given_says", "home_says", "first_says").alias("description")
    )


def passed_through(pages: DataFrame, content_type: str, body: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``markdown``: documents served as Markdown as they are, html converted, anything else left out."""
    kind = media_type(F.col(content_type))
    ready = pages.where(kind == "text/markdown").select(*keep, F.col(body).alias("markdown"))
    html = pages.where(kind.isin("text/html", "application/xhtml+xml"))
    return ready.union(convert(html, keep, body).select(*keep, "markdown"))


#: The points of a crawl at which hooks are called, in order.
HOOKS = ("crawl:url", "crawl:html", "crawl:page", "crawl:content", "crawl:done")


def with_hooks(df: DataFrame, point: str, hooks: dict[str, list[Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """The frame after the hooks of a point, functions from frame to frame (``crawl:url`` leaves out rows it filters)."""
    if bad := set(hooks) - set(HOOKS):
        raise ValueError(f"unknown hooks {sorted(bad)}; there are {', '.join(HOOKS)}")
    return reduce(lambda d, f: f(d), hooks.get(point, []), df)


def merged_options(*layers: dict) -> dict:
    """Option layers, later over earlier; None gives nothing, lists of exclusions add up."""
    out: dict = {}
    exclude: list = []
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None and not (k == "exclude" and isinstance(v, list | tuple))}
        if isinstance(layer.get("exclude"), list | tuple):
            exclude += layer["exclude"]
    return out | ({"exclude": exclude} if exclude else {})


def artifacts(wanted: Iterable[str] | None) -> tuple[str, ...]:
    """What to write, each once, in the usual order; None is all of it."""
    if wanted is None:
        return ARTIFACTS
    if isinstance(wanted, str) or (bad := set(wanted) - set(ARTIFACTS)):
        raise ValueError(f"artifacts are a list of {', '.join(ARTIFACTS)}" + ("" if isinstance(wanted, str) else f", not {sorted(bad)}"))
    return tuple(a for a in ARTIFACTS if a in set(wanted))


def section(title: str, description: str | list[str] = (), links: Iterable[tuple[str, str, str]] = ()) -> str:
    """A section of a site index: heading, paragraphs, and links of (title, address, description)."""
    paragraphs = [description] if isinstance(description, str) else list(description)
    listed = "".join(f"- [{t}]({href}){': ' + says if says else ''}\n" for t, href, says in links)
    return f"## {title}\n\n" + "".join(f"{p}\n\n" for p in paragraphs) + (listed + "\n" if listed else "")


def notes(text: str | list[str]) -> str:
    """The notes at the end of a site index."""
    return "".join(f"{x}\n\n" for x in ([text] if isinstance(text, str) else text))


def markdown_routes(routes: DataFrame, route: str) -> DataFrame:
    """Prerendered Markdown routes and the page routes they stand for (``/index.md`` is ``/``)."""
    r = F.col(route)
    bare = F.regexp_replace(F.regexp_replace(r, r"\.md$", ""), "/index$", "")
    return routes.where(r.endswith(".md")).withColumn("page_route", F.when(bare == "", "/").otherwise(bare))


def build_outputs(files: DataFrame, path: str, html: str, include: list[str], exclude: list[str]) -> DataFrame:
    """``(path, markdown)`` of the html files of a build that an inclusion takes and no exclusion does; ``.html`` becomes ``.md``."""
    fits = lambda globs: reduce(lambda a, b: a | b, [F.col(path).rlike(glob_regex(g)) for g in globs], F.lit(False))
    kept = files.where(F.col(path).endswith(".html") & (fits(include) if include else F.lit(True)) & ~fits(exclude))
    return convert(kept, [path], html).select(F.regexp_replace(path, r"\.html$", ".md").alias("path"), "markdown")


def resolved_paths(requests: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """``requests`` with ``file``: the first there is of ``p.html``, ``p`` or ``p/index.html``, and ``/index.html``."""
    p = F.regexp_replace(path, "/$", "")
    named = F.when(F.col(path).endswith(".html"), F.col(path)).otherwise(F.concat(p, F.lit("/index.html")))
    tries = F.array(F.concat(p, F.lit(".html")), named, F.lit("/index.html"))
    each = requests.select(path, F.posexplode(F.array_distinct(tries)).alias("rank", "file")).distinct()
    hit = each.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").groupBy(path).agg(F.min_by("file", "rank").alias("file"))
    return requests.join(hit, path, "left")
