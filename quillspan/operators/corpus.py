"""Operators over sets of pages: repeated chrome, the link graph, globs, page order and artifacts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text_columns import FRONT_BLOCK, body_without_title, frontmatter_map, toc_anchor
from quillspan.plans.tables import materialize, spread

SHINGLE, MIN_RUN, MIN_DOCS = 6, 12, 3


def tokens(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row a word: ``keys``, its position and the word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return docs.select(*keys, F.posexplode(words).alias("pos", "token"))


def shingles(toks: DataFrame, keys: list[str], k: int = SHINGLE) -> DataFrame:
    """The ``k`` words from each position on, joined by spaces; none where fewer are left."""
    w = Window.partitionBy(*keys).orderBy("pos")
    ahead = [F.lead("token", i).over(w) for i in range(1, k)]
    every = F.concat_ws(" ", "token", *ahead)
    return toks.withColumn("shingle", F.when(ahead[-1].isNotNull(), every)).where("shingle IS NOT NULL").select(*keys, "pos", "shingle")


def chrome_shingles(shingled: DataFrame, group: str, doc: str, threshold: float = 0.5) -> DataFrame:
    """``(group, shingle, df)`` of the shingles in at least that part of the group's documents, two at least."""
    per_doc = shingled.select(group, doc, "shingle").distinct()
    counts = shingled.select(group, doc).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    df = per_doc.groupBy(group, "shingle").agg(F.count(F.lit(1)).alias("df"))
    enough = F.greatest(F.lit(2), F.ceil(F.lit(threshold) * F.col("n")))
    return df.join(counts, group).where((F.col("n") >= MIN_DOCS) & (F.col("df") >= enough)).select(group, "shingle", "df")


def _kept_text(words: list[str], covered: list[bool], min_run: int) -> tuple[str, int]:
    """The text outside runs of at least ``min_run`` covered words, and its number of words."""
    keep = [True] * len(words)
    start = 0
    for i in range(len(words) + 1):
        if i == len(words) or not covered[i]:
            if i - start >= min_run:
                keep[start:i] = [False] * (i - start)
            start = i + 1
    if not any(keep):
        keep = [True] * len(words)
    parts: list[str] = []
    for i, w in enumerate(words):
        if keep[i]:
            parts.append(w if not parts else (" " if keep[i - 1] else "\n\n") + w)
    return "".join(parts), len(parts)


_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
_MIX = 0x9E3779B97F4A7C15


def _shingle_keys(words: list[str], k: int) -> np.ndarray:
    """A 64-bit key of the ``k`` words from each position on."""
    if len(words) < k:
        return np.empty(0, np.int64)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = len(words) - k + 1
    keys = np.zeros(n, np.uint64)
    for i in range(k):
        keys = (keys ^ (own[i : i + n] + np.uint64(i))) * np.uint64(_MIX)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def strip_chrome(docs: DataFrame, group: str, doc: str, text: str, threshold: float = 0.5, k: int = SHINGLE, min_run: int = MIN_RUN) -> DataFrame:
    """``(group, doc, text, n_tokens, n_kept)``: the words outside runs of at least ``min_run`` covered ones.

    A document of which nothing would be left keeps all its words. A kept span's words are joined by
    spaces, spans by a blank line. Only the distinct keys of a document's shingles are shuffled, counted with a
    map-side combine; a group has at most ``1 / threshold`` times the shingles of a document that recur, so they
    go as one array a group to the documents, whose texts are read again and never shuffled.
    """
    own = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(group, doc, F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(_shingle_keys([w for w in _SPACES.split(t) if w], k)) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(x) for x in made), np.int64, len(made))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            flat = pa.array(np.concatenate(made) if made else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["__group", "keys"])

    # groups go by a hash too: a row of the count is 16 bytes and a number
    own = own.withColumn("__group", F.xxhash64(group))
    held = materialize(spread(own.select("__group", "text")).mapInArrow(keys, "__group bigint, keys array<bigint>"), "shingles")
    n = held.where(F.size("keys") > 0).groupBy("__group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    df = held.select("__group", F.explode("keys").alias("key")).groupBy("__group", "key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    enough = F.greatest(F.lit(2), F.ceil(F.lit(threshold) * F.col("n")))
    chrome = df.join(n, "__group").where(F.col("df") >= enough).groupBy("__group").agg(F.collect_list("key").alias("chrome"))
    joined = own.join(materialize(chrome, "chrome"), "__group", "left").select(group, doc, "text", "chrome")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, kept = [], [], []
            for t, c in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                w = [x for x in _SPACES.split(t) if x]
                covered = np.zeros(len(w) + k, bool)
                if c.is_valid and len(w) >= k:
                    hits = np.flatnonzero(np.isin(_shingle_keys(w, k), c.values.to_numpy(zero_copy_only=False)))
                    for i in range(k):
                        covered[hits + i] = True
                t, m = _kept_text(w, covered[: len(w)].tolist(), min_run) if covered.any() else (" ".join(w), len(w))
                texts.append(t)
                totals.append(len(w))
                kept.append(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(kept, pa.int64())],
                [group, doc, "text", "n_tokens", "n_kept"],
            )

    return joined.mapInArrow(run, f"`{group}` {kinds[group]}, `{doc}` {kinds[doc]}, text string, n_tokens bigint, n_kept bigint")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``*`` within a segment, ``**`` across, ``?``, classes and braces."""
    out, i, braces = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern.startswith("**", i):
                i += 2
                if pattern.startswith("/", i) and (i == 2 or pattern[i - 3] == "/"):
                    out += "(?:.*/)?"
                    i += 1
                elif out.endswith("/") and i == len(pattern):
                    out = out[:-1] + "(?:/.*)?"
                else:
                    out += ".*"
                continue
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i + 1)
            out += "[" + pattern[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def _after_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)


def excluded(url: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns (whole urls, paths from the root, or bare globs) holds for the url."""
    rest = _after_host(url)
    tests = []
    for p in patterns:
        if "://" in p:
            m = re.match(r"([a-z]+://[^/]*)(.*)", p)
            tests.append(url.startswith(m[1] + "/") & rest.rlike(glob_regex(m[2])) if re.search(r"[*?\[]", p) else url == p)
        elif p.startswith("/"):
            tests.append(rest.rlike(glob_regex(p[:-1] + "**" if p.endswith("/*") else p)))
        else:
            tests.append(rest.rlike(glob_regex(p)) | F.regexp_replace(rest, "^.", "").rlike(glob_regex(p)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def walk_links(edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """``(url, depth)`` of all that is reached from the roots, by waves; ``edges`` is ``(src, dst)``.

    Each wave is one join and one anti-join with what was seen, written before the next reads it.
    """
    seen = materialize(roots.select("url", F.lit(0).alias("depth")).distinct(), "wave_0")
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier, edges["src"] == frontier["url"], "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = materialize(reached.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth")), f"wave_{depth}")
        seen = seen.union(frontier)
    return seen


def capped_variants(urls: DataFrame, order: str, most: int = 5) -> DataFrame:
    """``(url, n)``: the urls, each once, without those beyond the first ``most`` query variants of their path.

    ``n`` counts the variants of a path in their order; urls without a query aren't counted and all stay, with 0.
    """
    first = urls.where("url IS NOT NULL").groupBy("url").agg(F.min(order).alias("__at"))
    variant = F.regexp_extract("url", r"\?([^#]*)", 1) != ""
    path = F.regexp_extract("url", r"^([^?#]*)", 1)
    rank = F.row_number().over(Window.partitionBy("__path").orderBy("__at", "url"))
    capped = first.where(variant).withColumn("__path", path).withColumn("n", rank).where(F.col("n") <= most)
    return first.where(~variant).select("url", F.lit(0).alias("n")).union(capped.select("url", "n"))


def page_groups(pages: DataFrame, site: str, path: str) -> DataFrame:
    """``pages`` with their segments and group: two segments where several pages share them, else one;
    root pages without pages below them are the group ''."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    p = pages.withColumn("segments", segments)
    first = F.concat(F.lit("/"), F.coalesce(F.get("segments", F.lit(0)), F.lit("")))
    two = F.when(F.size("segments") > 1, F.concat(first, F.lit("/"), F.get("segments", F.lit(1)))).otherwise(first)
    p = p.withColumns({"__one": first, "__two": two})
    p = p.withColumns(
        {
            "__n": F.count(F.lit(1)).over(Window.partitionBy(site, "__two")),
            "__deep": F.max(F.size("segments")).over(Window.partitionBy(site, "__one")) > 1,
        }
    )
    group = F.when((F.size("segments") <= 1) & ~F.col("__deep"), "").when(F.col("__n") > 1, F.col("__two")).otherwise(F.col("__one"))
    return p.withColumn("group", group).drop("__one", "__two", "__n", "__deep")


def sorted_pages(pages: DataFrame, site: str, path: str, tie: str) -> DataFrame:
    """With ``place``: the rank of a page on its site, by group, then by segments, shorter paths first."""
    grouped = page_groups(pages, site, path)
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy(site).orderBy("group", "segments", tie)))


def group_breaks(placed: DataFrame, site: str) -> DataFrame:
    """With ``breaks``: whether a blank line comes before the page; after the first group always, after the next two if they hold several."""
    w = Window.partitionBy(site).orderBy("place")
    new = F.col("group") != F.lag("group").over(w)
    g = placed.withColumn("__new", F.coalesce(new, F.lit(False)))
    number = F.sum(F.col("__new").cast("int")).over(w)
    # the root group is entered without a change
    g = g.withColumn("__number", number + F.when(F.first("group").over(w) == "", 0).otherwise(1))
    g = g.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(site, "__number")))
    before, size = F.lag("__number").over(w), F.lag("__size").over(w)
    wanted = F.col("__new") & ((before == 0) | (before.between(1, 2) & (size > 1)))
    return g.withColumn("breaks", F.coalesce(wanted, F.lit(False))).drop("__new", "__number", "__size")


def described(description: Column, most: int) -> Column:
    cut = F.concat(F.lit(": "), F.substring(description, 1, most), F.when(F.length(description) > most, "...").otherwise(""))
    return F.when(description.isNull() | (description == ""), "").otherwise(cut)


def llms_index(pages: DataFrame, names: DataFrame, site: str, most: int = 100, sections: str = "", notes: str = "") -> DataFrame:
    """``(site, llms_txt)``: header, description, origin and the list of pages of each site.

    ``pages`` is ``(site, place, title, url, description)``, ``names`` ``(site, site_name, site_description)``.
    ``sections`` (``crawling.section``) come before the list, ``notes`` (``crawling.notes``) after it.
    A site's list is its artifact, one string; its lines are gathered in order by one aggregate. For sites
    whose index is larger than a string can be, ``index_parts`` has the same lines as rows.
    """
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("]("), F.col("url"), F.lit(")"), described(F.col("description"), most), F.lit("\n"))
    lists = pages.select(site, "place", line.alias("line")).groupBy(site).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "").alias("list")
    )
    head = F.concat(
        F.lit("# "), F.coalesce(F.nullif("site_name", F.lit("")), F.lit("Site")), F.lit("\n\n"),
        F.when(F.coalesce("site_description", F.lit("")) == "", "").otherwise(F.concat(F.lit("> "), F.col("site_description"), F.lit("\n\n"))),
        F.lit("Canonical Origin: "), F.col(site), F.lit(f"\n\n{sections}## Pages\n\n"),
    )
    end = F.lit(f"\n{notes}" if notes else "")
    return lists.join(names, site, "left").select(site, F.concat(head, "list", end).alias("llms_txt"))


def index_parts(pages: DataFrame, site: str, most: int = 160) -> DataFrame:
    """``(site, place, line)``: the lines of the index, sorted over the cluster by site and place, with their blank lines.

    No site is gathered anywhere: a range sort spreads a large one over many tasks. ``pages`` has ``breaks``
    (``group_breaks``): a blank line before the page's.
    """
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("]("), F.col("url"), F.lit(")"), described(F.col("description"), most))
    return pages.select(site, "place", F.concat(F.when(F.col("breaks"), "\n").otherwise(""), line).alias("line")).orderBy(site, "place")


def llms_full(pages: DataFrame, site: str) -> DataFrame:
    """``(site, llms_full)``: table of contents and every page with its front block, without a repeated title.

    ``pages`` is ``(site, place, title, url, description, keywords, author, content)``. The fields of the
    page go over those of a front block that its content brings along.
    """
    title = F.coalesce("title", F.lit(""))
    p = pages.withColumns({"__t": title, "__anchor": toc_anchor(title)})
    field = lambda name, c: F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"{name}: "), c, F.lit("\n")))
    own = frontmatter_map(F.col("content"))
    given = F.map_filter(own, lambda k, v: ~k.isin("title", "url", "description", "keywords", "author"))
    kept = F.array_join(F.transform(F.array_sort(F.map_entries(given)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    block = F.concat(
        F.coalesce(kept, F.lit("")), F.lit("title: "), "__t", F.lit("\nurl: "), "url", F.lit("\n"),
        field("description", F.col("description")), field("keywords", F.col("keywords")), field("author", F.col("author")),
    )
    body = body_without_title(F.coalesce("content", F.lit("")), F.col("__t"))
    p = p.select(
        site, "place", F.concat(F.lit("- ["), "__t", F.lit("](#"), "__anchor", F.lit(")\n")).alias("toc"),
        F.concat(F.lit("---\n"), block, F.lit("---\n\n"), body, F.lit("\n\n---\n\n")).alias("text"),
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c]), "")
    return p.groupBy(site).agg(
        F.concat(F.lit("# "), F.col(site), F.lit("\n\n## Table of Contents\n\n"), joined("toc"), F.lit("\n---\n\n"), joined("text")).alias("llms_full")
    )


def with_content(docs: DataFrame, text: str, least: int = 10) -> DataFrame:
    """The documents of which more than ``least`` characters are left without a front block and outer white space."""
    body = F.regexp_replace(F.col(text), FRONT_BLOCK, "")
    return docs.where(F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) > least)
