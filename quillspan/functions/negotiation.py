"""Content negotiation between HTML and Markdown as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accept_entries(header: Column) -> Column:
    """``array<struct<type, q, position>>`` of an Accept header; empty parts are skipped, q is 1 where none is given."""
    parts = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda p, i: F.struct(F.trim(p).alias("p"), i.alias("i")))

    def entry(x: Column) -> Column:
        given = F.regexp_extract(x["p"], r";.*?[qQ]=([^; ]*)", 1)
        q = F.when(x["p"].rlike(r";.*?[qQ]="), F.coalesce(given.try_cast("double"), F.lit(0.0))).otherwise(1.0)
        return F.struct(F.trim(F.split(x["p"], ";")[0]).alias("type"), q.alias("q"), x["i"].alias("position"))

    return F.transform(F.filter(parts, lambda x: x["p"] != ""), entry)


def negotiate(header: Column, fetch_dest: Column) -> Column:
    """markdown, html or not-acceptable."""
    entries = accept_entries(header)
    kinds = {
        "md": ("text/markdown", "text/plain"),
        "html": ("text/html", "application/xhtml+xml"),
        "any": ("*/*", "text/*"),
    }

    def best(kind: str) -> Column:
        mine = F.filter(entries, lambda e: F.lower(e["type"]).isin(*kinds[kind]) & (e["q"] != 0))
        return F.array_max(F.transform(mine, lambda e: F.struct(e["q"].alias("q"), (-e["position"]).alias("at"))))

    def rejected(kind: str) -> Column:
        return F.exists(entries, lambda e: F.lower(e["type"]).isin(*kinds[kind]) & (e["q"] == 0))

    md = F.coalesce(best("md"), F.when(~rejected("md"), best("any")))
    html = F.coalesce(best("html"), F.when(~rejected("html"), best("any")))
    return (
        F.when(fetch_dest == "document", "html")
        .when(header.isNull() | (header == "") | (F.size(entries) == 0), "html")
        .when(md.isNull() & html.isNull(), "not-acceptable")
        .when(md.isNull(), "html")
        .when(html.isNull() | (md > html), "markdown")
        .otherwise("html")
    )


def route_eligible(path: Column) -> Column:
    last = F.regexp_extract(path, "([^/]*)$", 1)
    return ~path.rlike("^/(api|_|@)") & (~last.contains(".") | last.endswith(".md"))


def merged_vary(given: Column, more: list[str]) -> Column:
    """A Vary header with further names; each once whatever its case, ``*`` stands alone."""
    names = F.filter(F.transform(F.split(F.coalesce(given, F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != "")
    every = F.concat(names, F.array(*map(F.lit, more)))
    once = F.filter(every, lambda n, i: ~F.exists(F.slice(every, F.lit(1), i), lambda m: F.lower(m) == F.lower(n)))
    return F.when(F.array_contains(names, "*"), "*").otherwise(F.array_join(once, ", "))
