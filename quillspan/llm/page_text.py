"""The text blocks of an HTML page and its main subtree, by composite text density.

Every element gets the density (Sun, Song and Liao, 2011): characters per tag, adjusted by the
share of characters and tags in links. The densities of an element's children are summed; the
element with the largest sum holds the article. Lines that are page furniture by their wording
(``furniture``) count as link text, so that long footers don't pass for articles. The least
density on the path from that element to the body is the threshold for taking in further
subtrees beside it.
"""

from __future__ import annotations

import html as _html
import math
import re
from functools import lru_cache

from quillspan.llm.folding import fold
from quillspan.llm.furniture import normals, worded

_TOKEN = re.compile(
    r"<!--.*?-->|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
#: The tokens that may hold further ``<``.
_SKIPPED = re.compile(r"<!--.*?-->|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*", re.I)
_BODY = re.compile(r"<body\b[^>]*>", re.I)
_HEAD_END = re.compile(r"</head\s*>", re.I)
_KEY = re.compile(r"[\W_]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the text block before and after them.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html li main nav noscript ol option p pre section select summary table tbody tfoot"
    " thead tr ul".split()
)
#: Elements of a text; the article is the first element around them that is none of these.
CONTENT = frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre code h1 h2 h3 h4 h5 h6 span a b i em strong figure figcaption caption".split())
_CLOSES_P = BLOCK - {"br", "body", "html", "option", "select", "noscript"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HIDDEN = frozenset({"noscript"})
_OUTER = frozenset({"body", "html"})
_HOLDS = BLOCK | {"td", "th"}


def _about(tag: str) -> tuple:
    """What the parser asks about a tag: its name, block, cell, void, closes a paragraph, what else it ends."""
    return tag, tag in BLOCK, tag in ("td", "th"), tag in VOID, tag in _CLOSES_P, _ENDS.get(tag)


_TAGS = {t: _about(t) for t in (*BLOCK, *VOID, *CONTENT)}
#: A token that says nothing: a comment, a script, a declaration.
_NOTHING = ()


@lru_cache(1 << 14)
def _head(head: str) -> tuple | None:
    """What stands between ``<`` and ``>``: whether it closes, what is known about its tag, whether it closes itself; None where it is no tag."""
    m = _TAG.fullmatch(head)
    if m is None:
        return _NOTHING if head[:1] in ("!", "?", "/") else None
    return bool(m[1]), _TAGS.get(m[2]) or _about(m[2].lower()), head.endswith("/")


def _tokens(html: str) -> tuple[str, list[tuple[tuple, str]]]:
    """The text before the first token, and each token with the text that follows it."""
    first, *pieces = _SKIPPED.sub("<!>", html).split("<")
    if not pieces:
        return first, []
    heads, ends, texts = zip(*[x.partition(">") for x in pieces], strict=True)
    kinds = list(map(_head, heads))
    if "" not in ends and None not in kinds:
        return first, list(zip(kinds, texts, strict=True))
    # a ``<`` that begins no token, or stands within one
    parts = _TOKEN.split(html)
    if "<" in parts[-1]:
        parts[-1] = ""
    found = []
    for at in range(5, len(parts), 5):
        _, closing, name, rest = parts[at - 4 : at]
        found.append((_NOTHING if name is None else _head(f"{closing}{name}{rest}"), parts[at]))
    return parts[0], found


def line_key(line: str) -> str:
    """What two forms of a line share: letters and digits without case."""
    return _KEY.sub("", line.casefold())


class Page:
    """``blocks``: (text, element, kind, text without code); kind is the tag of its block, ``pre`` for lines of code.

    ``furniture`` tells of each block whether its wording is page furniture, ``folded`` and ``forms`` have its
    folded form and its form for matching (None for lines of code).
    """

    __slots__ = ("blocks", "furniture", "folded", "forms", "tags", "parents", "chars", "link_chars", "n_tags", "link_tags")

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, str, str]] = []
        self.furniture: list[bool] = []
        self.folded: list[str | None] = []
        self.forms: list[str | None] = []
        self.tags = ["body"]
        self.parents = [-1]
        self.link_tags = [0]
        self._parse(html)
        self._densities()

    def _parse(self, html: str) -> None:
        start = _BODY.search(html) or _HEAD_END.search(html)
        tags, parents, blocks, link_tags = self.tags, self.parents, self.blocks, self.link_tags
        stack = [0]
        names = ["body"]  # of the open elements
        near = [0]  # of each open element, the block it is in
        text: list[str] = []
        plain: list[str] | None = None  # the text without code, once a block holds any
        linked = pre = code = link = own = 0
        in_links: list[int] = []  # of each block, the characters in links
        in_pre: set[int] = set()

        def flush() -> None:
            nonlocal linked, plain
            raw = text[0] if len(text) == 1 else "".join(text)
            outside = raw if plain is None else "".join(plain)
            text.clear()
            plain = None
            was, linked = linked, 0
            if "&" in raw:
                raw, outside = _html.unescape(raw), _html.unescape(outside)
            if pre:
                for x in raw.split("\n"):
                    if x.strip():
                        in_pre.add(len(blocks))
                        blocks.append((x, own, "pre", ""))
                        in_links.append(was)
                return
            s = " ".join(raw.split())
            if s:
                blocks.append((s, own, tags[own], outside))
                in_links.append(was)

        def pop_to(k: int) -> None:
            nonlocal pre, code, link
            for t in names[k:]:
                if t == "pre":
                    pre -= 1
                elif t == "code":
                    code -= 1
                elif t == "a":
                    link -= 1
            del stack[k:], near[k:], names[k:]

        before, tokens = _tokens(html[start.end() :] if start else html)
        for what, piece in ((_NOTHING, before), *tokens):
            if what:
                closing, (tag, is_block, is_cell, is_void, closes_p, ends), closed = what
                if closing:
                    if is_cell:
                        if text:
                            text.append(" ")
                            if plain is not None:
                                plain.append(" ")
                    elif is_block and text:
                        flush()
                    if not is_void and tag not in _OUTER and tag in names:
                        for k in range(len(names) - 1, 0, -1):
                            if names[k] == tag:
                                pop_to(k)
                                break
                elif tag not in _OUTER and tag != "head":
                    if is_block and text:
                        flush()
                    if closes_p and "p" in names:
                        for k in range(len(names) - 1, 0, -1):
                            t = names[k]
                            if t == "p":
                                pop_to(k)
                                break
                            if t in _HOLDS:
                                break
                    if ends:
                        closes, scope = ends
                        for k in range(len(names) - 1, 0, -1):
                            t = names[k]
                            if t in closes:
                                if tag == "tr" and text:
                                    flush()
                                pop_to(k)
                                break
                            if t in scope:
                                break
                    n = len(tags)
                    tags.append(tag)
                    parents.append(stack[-1])
                    link_tags.append(1 if link or tag == "a" else 0)
                    if is_cell and text:
                        text.append(" ")
                        if plain is not None:
                            plain.append(" ")
                    if not is_void and not closed:
                        stack.append(n)
                        names.append(tag)
                        near.append(n if is_block or is_cell else near[-1])
                        if tag == "pre":
                            pre += 1
                        elif tag == "code":
                            code += 1
                        elif tag == "a":
                            link += 1
            if piece:
                if text:
                    text.append(piece)
                    if plain is not None:
                        plain.append(" " if code and not piece.isspace() else piece)
                    elif code and not piece.isspace():
                        plain = [*text[:-1], " "]
                    if link and not piece.isspace():
                        linked += len(piece)
                elif not piece.isspace():
                    own = near[-1]
                    text.append(piece)
                    if code:
                        plain = [" "]
                    if link:
                        linked += len(piece)
        if text:
            flush()
        lines = [b[0] for b in blocks]
        if in_pre:
            lines = [x for n, x in enumerate(lines) if n not in in_pre]
        folded = fold("\n".join(lines))
        forms = normals(lines, folded)
        self.folded = folded.split("\n") if lines else []
        if in_pre:
            for n in sorted(in_pre):
                forms.insert(n, None)
                self.folded.insert(n, None)
        self.forms = forms
        self.furniture = worded(forms)
        chars, link_chars = [0] * len(tags), [0] * len(tags)
        self.chars, self.link_chars, self.n_tags = chars, link_chars, [0] * len(tags)
        for (s, at, _, _), was, form, wording in zip(blocks, in_links, forms, self.furniture, strict=True):
            n = len(s)
            chars[at] += n
            link_chars[at] += n if wording or was >= n or (form is not None and was >= n * 0.9) else was

    def _densities(self) -> None:
        chars, link_chars, n_tags, link_tags, parents = self.chars, self.link_chars, self.n_tags, self.link_tags, self.parents
        for n in range(len(parents) - 1, 0, -1):
            p = parents[n]
            chars[p] += chars[n]
            link_chars[p] += link_chars[n]
            n_tags[p] += n_tags[n] + 1
            link_tags[p] += link_tags[n]

    def densities(self) -> list[float]:
        """Of each element."""
        log, out = math.log, []
        share = self.link_chars[0] / max(1, self.chars[0])
        for c, lc, t, lt in zip(self.chars, self.link_chars, self.n_tags, self.link_tags, strict=True):
            if c <= lc:
                out.append(0.0)
                continue
            t, lt = t or 1, lt or 1
            held = c / (lc or 1) * t / lt
            out.append(c / t * log(held) / log(c / (c - lc) * lc + share * c + math.e) if held > 1.0 else 0.0)
        return out

    def main(self) -> set[int]:
        """The elements of the main subtree (or subtrees)."""
        n_all = len(self.tags)
        density = self.densities()
        sums = [0.0] * n_all
        for n in range(n_all - 1, 0, -1):
            if self.tags[n] not in HIDDEN:
                sums[self.parents[n]] += density[n]
        tags, parents = self.tags, self.parents
        with_blocks = {parents[n] for n in range(1, n_all) if tags[n] in ("p", "h1", "h2", "ul")}
        # a leaf counts for its parent, so that a page of one paragraph has an article too
        best = max(range(n_all), key=lambda n: (sums[n] if n else 0.0, -n))
        if not sums[best] or not best:
            best = max(range(n_all), key=lambda n: (density[n] if n and tags[n] not in HIDDEN else 0.0, -n))
        while best and parents[best] > 0 and tags[best] in CONTENT and not (tags[best] in ("td", "th") and best in with_blocks):
            best = parents[best]
        titles = [n for n in range(1, n_all) if tags[n] == "h1" and self.chars[n]]
        if best and titles:
            up = best
            while up > 0 and not any(self._inside(t, up) for t in titles):
                up = parents[up]
            if up > 0:
                best = up
        if not best:
            return set(range(n_all))
        path, n = [], best
        while n > 0:
            path.append(density[n])
            n = parents[n]
        threshold = min(path)
        chosen = {best}
        for n in range(1, n_all):
            if (
                parents[n] == parents[best]
                and n != best
                and density[n] >= threshold
                and sums[n] >= 0.5 * sums[best]
                and tags[n] not in HIDDEN
            ):
                chosen.add(n)
        inside = set()
        for n in range(n_all):
            if n in chosen or parents[n] in inside:
                inside.add(n)
        return inside

    def _inside(self, n: int, top: int) -> bool:
        while n > top:
            n = self.parents[n]
        return n == top
