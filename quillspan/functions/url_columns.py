"""URL rules as native columns; each has its SQL for the check beside it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of query keys that only track visits.
TRACKING_PREFIX = "^(utm_|fbclid|gclid|mc_eid|msclkid|oly_)"
#: Whole names of such keys, for the key under which pages are taken as one.
TRACKING_NAMES = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid",
    "msclkid", "twclid", "li_fat_id", "mc_cid", "mc_eid", "ref", "source", "sessionid", "session_id", "sid", "_ga", "_gl", "_hsenc", "_hsmi",
    "_openstat", "yclid", "ymclid", "spm", "scm",
]
#: Beginnings of paths that hold no content.
NO_CONTENT = "^/(cdn-cgi/|_next/|_nuxt/|__|wp-admin/|wp-json/|wp-includes/|wp-content/uploads/|api/|assets/|static/)"
#: Names that Windows keeps for devices.
DEVICES = [
    "con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
]


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """What stands before the query, the query (null without one) and the fragment with its ``#``."""
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.when(bare.contains("?"), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1))
    return F.regexp_extract(bare, r"^([^?]*)", 1), query, fragment


def strip_tracking(url: Column) -> Column:
    base, query, fragment = _parts(url)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING_PREFIX)), "&")
    return F.when(query.isNull(), url).otherwise(F.concat(base, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment))


def normalize_url(url: Column) -> Column:
    """The key under which fetches of one page are found: no fragment, no tracking, sorted parameters, no last slash."""
    base, query, _ = _parts(url)
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(TRACKING_NAMES))
    placed = F.transform(pairs, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), p.alias("p")))
    kept = F.array_join(F.transform(F.array_sort(placed), lambda x: x["p"]), "&")
    whole = F.when(query.isNull() | (kept == ""), base).otherwise(F.concat(base, F.lit("?"), kept))
    return F.regexp_replace(whole, "/$", "")


def is_autolink(url: Column) -> Column:
    return url.rlike(r"^(https?://|ftp://|mailto:)[^ <>\n\r\t]*$")


def _plain(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""))


def is_empty_href(url: Column) -> Column:
    return _plain(url).rlike("^(#$|javascript:|data:|vbscript:)")


def is_data_url(url: Column) -> Column:
    return _plain(url).startswith("data:")


def is_safe_url(url: Column) -> Column:
    p = _plain(url)
    return ~p.rlike("^[a-z][a-z0-9+.-]*:") | p.rlike("^(https?|mailto|tel|ftp):")


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; ``..`` at the root goes nowhere."""
    parts = F.split(path, "/")
    root = F.array(F.lit(""))
    done = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        root,
        lambda got, p: F.when(p == "..", F.when(F.size(got) > 1, F.slice(got, 1, F.size(got) - 1)).otherwise(got)).when(p == ".", got).otherwise(F.array_append(got, p)),
    )
    # a path that ends in a dot segment ends in a slash
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(done, F.lit(""))).otherwise(done)
    return F.array_join(ended, "/")


def resolve(url: Column, base: Column) -> Column:
    """``url`` as seen from the page at ``base``: its directory, and without dot segments. Fragments and empty urls stay."""
    host = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    path, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(own, "^(.*/)", 1), F.lit("")), F.lit("/")), path))
    return (
        F.when(url.isNull() | (url == "") | url.startswith("#"), url)
        .when(url.startswith("//"), F.concat(F.when(scheme == "", "https:").otherwise(scheme), url))
        .when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(host == "", F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", "")))
        .when(path == "", F.concat(host, F.when(own == "", "/").otherwise(own), rest))
        .otherwise(F.concat(host, _without_dots(whole), rest))
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_content_url(url: Column) -> Column:
    path = url_path(url)
    last = F.regexp_extract(path, "([^/]*)$", 1)
    return ~path.rlike(NO_CONTENT) & (~last.contains(".") | path.rlike(r"(?i)\.(html?|php|aspx?|jsp)$"))


def safe_segment(segment: Column) -> Column:
    safe = F.regexp_replace(segment, r"[^\w-]", "-")
    return F.when(F.lower(safe).isin(DEVICES), F.concat(F.lit("~"), safe)).otherwise(safe)


def file_to_url(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/index$", "")
    return F.when(p == "index", "/").when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def pattern_parts(pattern: Column) -> Column:
    """(base_url, pattern, is_glob) of a url pattern."""
    glob = pattern.rlike(r"[*?\[]")
    full = F.when(pattern.startswith("http"), pattern).otherwise(F.concat(F.lit("https://"), pattern))
    base = F.regexp_extract(full, r"^([a-z]+://[^/*?\[]*)", 1)
    return F.struct(
        F.when(glob, base).otherwise(pattern).alias("base_url"),
        F.when(glob, F.substring(full, F.length(base) + 1, F.length(full))).otherwise("").alias("pattern"),
        glob.alias("is_glob"),
    )


def pattern_of(pattern: str) -> tuple[str, str, bool]:
    """The same of one pattern on the driver; a glob pattern without a host is an error."""
    if not re.search(r"[*?\[]", pattern):
        return pattern, "", False
    full = pattern if pattern.startswith("http") else f"https://{pattern}"
    m = re.match(r"([a-z]+://[^/*?\[]+)(.*)$", full, re.S)
    if not m:
        raise ValueError(f"{pattern!r} is no url pattern; one is like https://example.org/docs/**")
    return m[1], m[2], True


def starting_url(pattern: Column) -> Column:
    p = pattern_parts(pattern)
    before = F.regexp_extract(p["pattern"], r"^([^*?\[]*)", 1)
    directory = F.when(before.contains("/"), F.regexp_extract(before, "^(.*/)", 1)).otherwise("/")
    return F.when(p["is_glob"], F.concat(p["base_url"], directory)).otherwise(p["base_url"])
