"""URL rules shared by the renderers; the column twins are in ``functions.url_columns``."""

from __future__ import annotations

import re

#: Prefixes of query keys that only track visits.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "mc_eid", "msclkid", "oly_")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_IGNORED = re.compile(r"[\t\n\r]")
_CONTROLS = "".join(map(chr, range(0x21)))


def _plain(url: str) -> str:
    return _IGNORED.sub("", url.strip(_CONTROLS)).lower()


def is_empty_href(url: str) -> bool:
    p = _plain(url)
    return p == "#" or p.startswith(("javascript:", "data:", "vbscript:"))


def is_data_url(url: str) -> bool:
    return _plain(url).startswith("data:")


def is_safe_url(url: str, image: bool = False) -> bool:
    p = _plain(url)
    m = _SCHEME.match(p)
    return not m or m[0] in (("http:", "https:") if image else ("http:", "https:", "mailto:", "tel:", "ftp:"))


def is_autolink(url: str) -> bool:
    return bool(re.fullmatch(r"(?:https?://|ftp://|mailto:)[^ <>\n\r\t]*", url))


def strip_tracking(url: str) -> str:
    q = url.find("?")
    h = url.find("#")
    if q < 0 or 0 <= h < q:
        return url
    query, hash_, fragment = url[q + 1 :].partition("#")
    kept = "&".join(p for p in query.split("&") if not p.startswith(TRACKING_PREFIXES))
    return url[:q] + ("?" + kept if kept else "") + hash_ + fragment


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        if p == "..":
            if len(out) > 1:
                out.pop()
        elif p != ".":
            out.append(p)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/".join(out)


def resolve(url: str, origin: str = "", clean: bool = False) -> str:
    """``url`` as seen from ``origin``; fragments and empty urls stay as they are."""
    if clean:
        url = strip_tracking(url)
    if not url or url.startswith("#"):
        return url
    if url.startswith("//"):
        m = re.match(r"(https?:)", origin)
        return (m[1] if m else "https:") + url
    if not origin or _SCHEME.match(url):
        return url
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)", origin)
    if not m:
        return origin.rstrip("/") + "/" + url.lstrip("/")
    base, directory = m[1], m[2].rsplit("/", 1)[0] if "/" in m[2] else ""
    path, rest = re.match(r"([^?#]*)(.*)", url, re.S).groups()
    if not path:
        return base + (m[2] or "/") + rest
    return base + _without_dots(path if path.startswith("/") else f"{directory}/{path}") + rest


def slugify(text: str) -> str:
    s = re.sub(r"[ \t-]+", "-", re.sub(r"[^a-z0-9_ \t-]", "", text.lower()))
    return s.rstrip("-")
