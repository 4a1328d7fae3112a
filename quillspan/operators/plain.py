"""A tree as readable plain text, and as allow-listed HTML."""

from __future__ import annotations

import re
import sys

from quillspan.operators import tags as T
from quillspan.operators import urls
from quillspan.operators.dom import Node
from quillspan.operators.markdown import _LANGUAGE, _SPACE, _integer, _Out, html_escape
from quillspan.operators.options import Options

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # MAX_DEPTH elements, a few frames each
_LINE_BLOCKS = T._set("li", "dt", "dd", "tr", "caption", "summary", "option", "legend", "address")


class _Text:
    def __init__(self, o: Options):
        self.o, self.pre = o, 0

    def kids(self, n: Node, out: _Out) -> None:
        for k in n.kids:
            if isinstance(k, str):
                self.text(k, out)
            else:
                self.element(k, out)

    def text(self, s: str, out: _Out) -> None:
        if self.pre:
            out.put(s)
            return
        s = _SPACE.sub(" ", s)
        if out.line_start() or out.tail.endswith((" ", "\t")):
            s = s.lstrip(" ")
        if not s:
            return
        if not self.o.wrap_width:
            out.put(s)
            return
        column = 0 if out.pending else out.column()
        for i, w in enumerate(s.split(" ")):
            if not w:
                continue
            gap = (i > 0) and column > 0
            if gap and column + 1 + len(w) > self.o.wrap_width:
                out.trim()
                out.put("\n" + w)
                column = len(w)
            else:
                out.put((" " if gap else "") + w)
                column += len(w) + gap
        if s.endswith(" ") and column:
            out.put(" ")

    def element(self, n: Node, out: _Out) -> None:
        tag = n.tag
        if tag in T.SILENT:
            return
        if tag == "br":
            out.trim()
            out.put("\n")
        elif tag == "hr":
            if n.parent is not None and n.parent.tag == "li":
                self.text(" ", out)
            else:
                out.want(2)
        elif tag == "img":
            label = n.attrs.get("alt") or n.attrs.get("title") or n.attrs.get("src", "")
            if label and not urls.is_data_url(label):
                self.text(label, out)
        elif tag == "q":
            inner = _Out()
            self.kids(n, inner)
            if body := inner.text().strip():
                out.put(f'"{body}"')
        elif tag in ("td", "th"):
            if not out.line_start():
                out.trim()
                out.put("\t")
            self.kids(n, out)
        elif tag == "pre":
            out.want(2)
            self.pre += 1
            self.kids(n, out)
            self.pre -= 1
            out.want(2)
        elif tag in _LINE_BLOCKS:
            out.want(1)
            self.kids(n, out)
            out.want(1)
        elif tag in T.SPACED or tag == "figcaption":
            nested = tag in ("ul", "ol") and n.parent is not None and n.parent.tag == "li"
            out.want(1 if nested else 2)
            self.kids(n, out)
            out.want(1 if nested else 2)
        else:
            self.kids(n, out)


def to_text(root: Node, o: Options) -> str:
    out = _Out()
    _Text(o).kids(root, out)
    lines = [x.rstrip(" \t") for x in out.text().split("\n")]
    return "\n".join(lines).strip()


def _attribute(name: str, value: str) -> str:
    return f' {name}="{html_escape(value).replace(chr(34), "&quot;")}"'


def _safe_attributes(n: Node, tag: str, o: Options) -> str | None:
    """The attributes that stay; None where the element isn't to be written."""
    a = n.attrs
    clean = "urls" in o.clean
    if tag == "a":
        href = a.get("href")
        if href is None or not urls.is_safe_url(href):
            return None
        return _attribute("href", urls.resolve(href, o.origin, clean)) + (_attribute("title", a["title"]) if a.get("title") else "")
    if tag == "img":
        src = a.get("src", "")
        if not src or not urls.is_safe_url(src, image=True):
            return None
        return _attribute("src", urls.resolve(src, o.origin, clean)) + _attribute("alt", a.get("alt", "")) + (_attribute("title", a["title"]) if a.get("title") else "")
    if tag in T.HEADINGS:
        slug = urls.slugify(" ".join(n.text().split()))
        return _attribute("id", slug) if slug else ""
    if tag == "ol" and (start := _integer(a.get("start"), 0, 999_999_999)) is not None and start != 1:
        return _attribute("start", str(start))
    if tag == "code" and (m := _LANGUAGE.search(a.get("class", ""))):
        return _attribute("class", f"language-{m[1]}")
    if tag in ("td", "th"):
        out = ""
        if (span := _integer(a.get("colspan"), 2, 64)) is not None:
            out += _attribute("colspan", str(span))
        if tag == "th" and a.get("align", "").lower() in ("left", "center", "right"):
            out += _attribute("align", a["align"].lower())
        return out
    return ""


class _Safe:
    def __init__(self, o: Options):
        self.o = o
        self.parts: list[str] = []
        self.tail = " "  # the last character; the beginning counts as a space

    def put(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.tail = s[-1]

    def text(self, s: str, pre: bool) -> None:
        if not pre:
            s = _SPACE.sub(" ", s)
            if self.tail in " \n":
                s = s.lstrip(" ")
        self.put(html_escape(s))

    def kids(self, n: Node, pre: bool) -> None:
        for k in n.kids:
            if isinstance(k, str):
                self.text(k, pre)
            else:
                self.element(k, pre)

    def element(self, k: Node, pre: bool = False) -> None:
        if k.tag in T.SILENT:
            return
        tag = T.SAFE.get(k.tag)
        attributes = _safe_attributes(k, tag, self.o) if tag else None
        if tag is None or attributes is None:
            self.kids(k, pre)
            return
        self.put(f"<{tag}{attributes}>")
        if tag not in T.VOID:
            self.kids(k, pre or tag == "pre")
            self.put(f"</{tag}>")


def to_safe_html(root: Node, o: Options) -> str:
    w = _Safe(o)
    w.kids(root, False)
    return "".join(w.parts).strip()


def extract(root: Node, selectors: tuple[str, ...]) -> list[tuple[str, str, str, dict[str, str]]]:
    """``(selector, tag, text, attributes)`` of each element for each selector it matches, in order of their ends."""
    from quillspan.operators.selectors import matcher

    tests = [(s, matcher((s,))) for s in selectors]
    out: list[tuple[str, str, str, dict[str, str]]] = []
    stack: list[tuple[Node, bool]] = [(k, False) for k in reversed(root.kids) if isinstance(k, Node)]
    while stack:
        n, leaving = stack.pop()
        if leaving:
            out += [(s, n.tag, n.text().strip(), n.attrs) for s, t in tests if t(n)]
            continue
        stack.append((n, True))
        stack.extend((k, False) for k in reversed(n.kids) if isinstance(k, Node))
    return out


_LINE_WORD = re.compile(r"\S+")


def wrap_text(text: str, width: int) -> str:
    """Greedy wrap at ``width`` code points; words are never split, blank lines stay."""
    out = []
    for paragraph in text.split("\n"):
        line = ""
        lines = []
        for w in _LINE_WORD.findall(paragraph):
            if line and len(line) + 1 + len(w) > width:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}" if line else w
        out.append("\n".join([*lines, line]))
    return "\n".join(out)
