"""Sources and sinks of a crawl: files, sitemaps, robots files, Markdown folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.url_columns import file_to_url, safe_segment


def read_html_files(spark: SparkSession, path: str, globs: str | tuple[str, ...] = "*.html") -> DataFrame:
    """``(path, url, html, title)`` of the files under a folder that match a glob; each path once.

    The title is the document's, or the name of the file without its ending.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    parts = [read.option("pathGlobFilter", g).load(path) for g in ((globs,) if isinstance(globs, str) else globs)]
    files = reduce(lambda a, b: a.union(b), parts)
    root = path.removeprefix("file://").rstrip("/")
    inner = F.regexp_replace("path", f"^.*?{root}/", "")
    html = F.decode("content", "UTF-8")
    said = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return files.dropDuplicates(["path"]).select("path", file_to_url(inner).alias("url"), html.alias("html"), F.coalesce(F.nullif(said, F.lit("")), name).alias("title"))


def is_sitemap(xml: Column) -> Column:
    return xml.contains("<urlset") | xml.contains("<sitemapindex")


def clean_loc(loc: Column) -> Column:
    t = F.trim(loc)
    decoded = t
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(name), F.lit(c))
    cdata = t.startswith("<![CDATA[") & t.endswith("]]>")
    return F.when(cdata, F.substring(t, 10, F.length(t) - 12)).otherwise(decoded)


def sitemap_locs(xml: Column, item: str = "url") -> Column:
    """The addresses in a sitemap (item ``url``) or an index of sitemaps (item ``sitemap``), the first of each entry."""
    entries = F.split(xml, f"</{item}\\s*>")
    entries = F.slice(entries, 1, F.size(entries) - 1)
    own = F.transform(entries, lambda e: F.regexp_extract(e, rf"(?s).*<{item}(?:\s[^>]*)?>(.*)$", 1))  # what follows the entry's own start tag
    held = F.filter(own, lambda e: e.contains("<loc>") & e.contains("</loc>"))
    locs = F.transform(held, lambda e: clean_loc(F.substring_index(F.element_at(F.split(e, "<loc>"), 2), "</loc>", 1)))
    return F.when(is_sitemap(xml), locs).otherwise(F.array().cast("array<string>"))


def _robots_values(robots: Column, field: str) -> Column:
    """What stands after ``field:`` in the lines of a robots file."""
    lines = F.transform(F.split(robots, "[\r\n]+"), lambda x: F.trim(x))
    named = F.filter(lines, lambda x: F.lower(x).contains(f"{field}:"))
    return F.transform(named, lambda x: F.trim(F.substr(x, F.locate(f"{field}:", F.lower(x)) + F.lit(len(field) + 1))))


def robots_sitemaps(robots: Column) -> Column:
    return _robots_values(robots, "sitemap")


def robots_delay(robots: Column) -> Column:
    """The first delay that is a number, in seconds."""
    numbers = F.filter(F.transform(_robots_values(robots, "crawl-delay"), lambda x: F.regexp_extract(x, r"^([0-9]+\.?[0-9]*)", 1)), lambda x: x != "")
    return F.get(numbers, F.lit(0)).try_cast("double")


def expand_sitemaps(start: DataFrame, files: DataFrame) -> DataFrame:
    """``(root, url)``: all page addresses below the sitemaps ``start(root, address)``; ``files`` is ``(address, xml)``.

    Indexes are followed level by level until none is left; an address seen under the same root isn't
    followed again, which ends cycles.
    """
    from quillspan.plans.tables import materialize

    seen = materialize(start.select("root", "address").distinct(), "sitemaps_0")
    frontier, found, depth = seen, None, 0
    while found is None or not frontier.isEmpty():
        depth += 1
        loaded = frontier.join(files, "address")
        urls = materialize(loaded.select("root", F.explode(sitemap_locs(F.col("xml"))).alias("url")), f"sitemap_urls_{depth}")
        found = urls if found is None else found.union(urls)
        children = loaded.select("root", F.explode(sitemap_locs(F.col("xml"), "sitemap")).alias("address")).distinct()
        frontier = materialize(children.join(seen, ["root", "address"], "left_anti"), f"sitemaps_{depth}")
        seen = seen.union(frontier)
    return found.distinct()


def file_path(url: Column, by_host: bool = False) -> Column:
    """Where a page's Markdown goes: its path's segments made safe; the root is ``index.md``.

    With ``by_host`` (crawls over several hosts) the host comes first, so that paths of two hosts don't meet.
    """
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), safe_segment)
    if by_host:
        host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
        segments = F.when(F.size(segments) == 0, F.array(F.lit("index"))).otherwise(segments)
        segments = F.concat(F.array(safe_segment(host)), segments)
    return F.concat(F.when(F.size(segments) == 0, "index").otherwise(F.array_join(segments, "/")), F.lit(".md"))


def file_list_path(path: Column) -> Column:
    """The place of a page in a list of Markdown files: ``md/`` and its path."""
    bare = F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", "")
    return F.concat(F.lit("md/"), F.when(path == "/", "index").otherwise(bare), F.lit(".md"))


def write_markdown(df: DataFrame, path: str) -> None:
    """A folder of Parquet files ``(file_path, markdown)``; small text files by the million would load the file system."""
    df.select(file_path(F.col("url")).alias("file_path"), "markdown").write.mode("overwrite").parquet(path)
