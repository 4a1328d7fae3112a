"""A tree as GitHub-flavoured Markdown."""

from __future__ import annotations

import re
import sys

from quillspan.operators import tags as T
from quillspan.operators import urls
from quillspan.operators.dom import Node
from quillspan.operators.entities import NAMED
from quillspan.operators.options import Options
from quillspan.operators.prepare import RAW, class_marks

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # MAX_DEPTH elements, a few frames each
#: Unicode's White_Space, which the information separators U+001C to U+001F aren't part of.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(r"[ \t\n\f\r]+")
_RUN = re.compile(r"[\t\n\f\r]|  ")
#: What may need an escape anywhere; most texts have none of it.
_SPECIAL = re.compile(r"[\\*_~`\[<&\]|]")
_ALWAYS = re.compile(r"[\\*_~`\[]")
_START = re.compile(r"(?:(#{1,6})(?=\s|$)|([-+](?=\s|$)|-{3,}(?=\s*$)|={3,}(?=\s*$))|(>)|(\d{1,9})([.)])(?=\s|$))")
_REFERENCE = re.compile(r"&(?:#(?:[xX][0-9a-fA-F]+|[0-9]+)|([A-Za-z][A-Za-z0-9]*));")
_TAG_LIKE = re.compile(r"<(?=[A-Za-z!/?])")
_LANGUAGE = re.compile(r"(?:^|\s)language-([^\s\"'&<>`~\x00-\x1f]+)")


def _integer(s: str | None, low: int, high: int) -> int | None:
    m = re.fullmatch(r"[ \t\n\f\r]*\+?(\d{1,10})[ \t\n\f\r]*", s or "")
    return int(m[1]) if m and low <= int(m[1]) <= high else None


def _destination(url: str) -> str:
    if re.search(r"[\s()\\<>]", url):
        return "<" + re.sub(r"[\\<>]", r"\\\g<0>", url).replace("\n", "%0A") + ">"
    return url


def _title(s: str | None) -> str:
    return ' "' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' if s else ""


def _span(text: str) -> str:
    runs = [len(r) for r in re.findall("`+", text)]
    fence = "`" * (max(runs, default=0) + 1) if runs else "`"
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def html_escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class _Out:
    """Text with newlines that are only written once something follows them."""

    __slots__ = ("parts", "pending", "tail", "last", "base")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.pending = 0
        self.tail = ""
        self.last = ""  # how the last piece begins
        self.base = 0  # the column at which the parts begin, once earlier ones were taken

    def want(self, newlines: int) -> None:
        self.pending = max(self.pending, newlines)

    def line_start(self) -> bool:
        return not self.tail or bool(self.pending) or self.tail.endswith("\n")

    def put(self, s: str) -> None:
        if not s:
            return
        if self.pending and self.tail:
            if not self.tail.endswith("\n"):
                self.trim()
            have = len(self.tail) - len(self.tail.rstrip("\n"))
            if have < self.pending:
                self.parts.append("\n" * (self.pending - have))
        self.pending = 0
        self.parts.append(s)
        self.last = s[0]
        self.tail = (self.tail + s)[-4:] if len(s) < 4 else s[-4:]

    def trim(self) -> bool:
        """Take spaces from the end; whether there were any."""
        took = False
        while self.parts and self.parts[-1].endswith(" "):
            took = True
            last = self.parts[-1].rstrip(" ")
            if last:
                self.parts[-1] = last
                break
            self.parts.pop()
        if took:
            self.tail = "".join(self.parts[-4:])[-4:]
        return took

    def mark(self) -> tuple[int, int, str]:
        return len(self.parts), self.pending, self.tail

    def back(self, to: tuple[int, int, str]) -> None:
        del self.parts[to[0] :]
        self.pending, self.tail = to[1], to[2]

    def column(self) -> int:
        n = 0
        for p in reversed(self.parts):
            k = p.rfind("\n")
            if k >= 0:
                return n + len(p) - k - 1
            n += len(p)
        return n + self.base

    def take(self, held: str) -> str:
        """Give away what is written, but for characters of ``held`` at its end."""
        whole = "".join(self.parts)
        given = whole.rstrip(held)
        if given:
            k = given.rfind("\n")
            self.base = len(given) - k - 1 if k >= 0 else self.base + len(given)
            self.parts = [whole[len(given) :]] if len(given) < len(whole) else []
        return given

    def text(self) -> str:
        return "".join(self.parts)


class Renderer:
    def __init__(self, o: Options):
        self.o = o
        self.pre = self.code = self.cell = self.link = self.heading = self.literal = 0
        self.bold = self.italic = self.tables = self.margin = 0
        self.after: Node | str | None = None
        self.slugs: set[str] = set()

    # text -------------------------------------------------------------
    def _escaped(self, s: str, at_start: bool) -> str:
        if self.literal:
            s = html_escape(s).replace("\n", "&#10;").replace("\r", "&#13;")
            if self.link:
                s = s.replace("[", "&#91;").replace("]", "&#93;")
            return s.replace("|", "&#124;") if self.cell else s
        if not _SPECIAL.search(s):
            return self._at_start(s) if at_start and not self.heading else s
        if _ALWAYS.search(s):
            s = _ALWAYS.sub(r"\\\g<0>", s)
        if "<" in s:
            s = _TAG_LIKE.sub(r"\\<", s)
        if "&" in s:  # a decoded ampersand must not begin another reference
            s = _REFERENCE.sub(lambda m: "\\" + m[0] if m[1] is None or m[1] in NAMED else m[0], s)
        if self.link and "]" in s:
            s = s.replace("]", "\\]")
        if self.cell and "|" in s:
            s = s.replace("|", "\\|")
        return self._at_start(s) if at_start and not self.heading else s

    @staticmethod
    def _at_start(s: str) -> str:
        """A text at the beginning of a line, where it would begin a heading, an item, a quote or a rule."""
        if m := _START.match(s):
            return s[: m.start(5)] + "\\" + s[m.start(5) :] if m[5] else "\\" + s
        return s

    def _text(self, s: str, out: _Out) -> None:
        if self.pre:
            out.put(s.replace("\n", "<br>") if self.cell else s)
            return
        if _RUN.search(s):
            s = _SPACE.sub(" ", s)
        if self.code:
            out.put(s)
            return
        start = out.line_start()
        if start or out.tail.endswith(" "):
            s = s.lstrip(" ")
        if not s:
            return
        s = self._escaped(s, start)
        width = self.o.wrap_width
        if width and not (self.cell or self.heading or self.literal):
            self._wrapped(s, out, max(1, width - self.margin))
        else:
            out.put(s)

    def _wrapped(self, s: str, out: _Out, width: int) -> None:
        lead = s.startswith(" ")
        words = s.split(" ")
        column = 0 if out.pending else out.column()
        for i, w in enumerate(words):
            if not w:
                continue
            gap = bool(i) or lead
            if gap and column and column + 1 + len(w) > width:
                out.trim()
                out.put("\n" + w)
                column = len(w)
            else:
                out.put((" " if gap and column else "") + w)
                column += len(w) + bool(gap and column)
        if s.endswith(" ") and column:
            out.put(" ")

    # elements ---------------------------------------------------------
    def kids(self, n: Node, out: _Out) -> None:
        kids = n.kids
        for i, k in enumerate(kids):
            if isinstance(k, str):
                self._text(k, out)
            else:
                self.after = kids[i + 1] if i + 1 < len(kids) else None
                self.element(k, out)

    def sub(self, n: Node) -> str:
        out = _Out()
        self.kids(n, out)
        return out.text()

    def element(self, n: Node, out: _Out) -> None:
        tag = n.tag
        follows = self.after
        if tag in self.o.overrides:
            self._overridden(n, out)
            return
        if tag == RAW:
            out.put(n.kids[0])
            return
        if tag in T.SILENT:
            return
        if self.o.tailwind and (c := n.attrs.get("class")):
            before, after, _ = class_marks(c)
            if before:
                block = tag in T.SPACED and not (self.cell or self.link)
                out.want(2 if block else 0)
                self._pair(n, out, before, after)
                out.want(2 if block else 0)
                return
        handler = _HANDLERS.get(tag)
        if handler is not None:
            handler(self, n, out)
        elif tag in T.SPACED:
            if self.cell or (self.link and tag != "p"):
                if not out.line_start() and tag in ("p", "div"):
                    out.put(" " if not out.tail.endswith((" ", ">")) else "")
                self.kids(n, out)
            else:
                out.want(2)
                self.kids(n, out)
                if tag == "p" and n.parent is not None and n.parent.tag == "li":
                    if isinstance(follows, Node) and follows.tag not in _BLOCKS:
                        out.put(" ")  # inline content goes on in the paragraph's line
                        return
                out.want(2)
        elif tag == "center" and self.tables > 1:
            self._raw(n, out, tag)
        else:
            self.kids(n, out)

    def _overridden(self, n: Node, out: _Out) -> None:
        x = self.o.overrides[n.tag]
        if x.alias:
            n.tag, own = x.alias, n.tag
            self.element(n, out)
            n.tag = own
            return
        if x.enter is None and x.exit is None and n.tag in T.SILENT:
            return
        before, after = x.spacing or (0, 0)
        if not x.inline:
            out.want(before)
        out.put(x.enter or "")
        if not x.self_closing:
            self.kids(n, out)
        out.put(x.exit or "")
        if not x.inline:
            out.want(after)

    def _pair(self, n: Node, out: _Out, before: str, after: str) -> None:
        kind = "bold" if before == "**" else "italic" if before == "*" else ""
        if self.pre or self.code or (kind and getattr(self, kind)):
            self.kids(n, out)
            return
        first = n.text()
        if first[:1].isspace() and not out.line_start() and not out.tail.endswith(" "):
            out.put(" ")
        state = out.mark()
        out.put(before)
        opened = out.mark()
        if kind:
            setattr(self, kind, 1)
        inner = _Out()
        self.kids(n, inner)
        if kind:
            setattr(self, kind, 0)
        body = inner.text()
        if not body.strip():
            out.back(state)
            if body and not out.line_start() and not out.tail.endswith(" "):
                out.put(" ")
            return
        spaced = body.endswith(" ") and not body.endswith("  \n")
        out.put(body.lstrip(" ").rstrip(" ") if spaced else body.lstrip(" "))
        if out.mark() == opened:
            out.back(state)
            return
        out.put(after)
        if spaced:
            out.put(" ")
        if inner.pending:
            out.want(inner.pending)

    def _heading(self, n: Node, out: _Out) -> None:
        if self.link or self.cell:
            out.put(f"<{n.tag}>")
            self.kids(n, out)
            out.put(f"</{n.tag}>")
            return
        self.heading += 1
        body = _SPACE.sub(" ", self.sub(n)).strip()
        self.heading -= 1
        out.want(2)
        if body:
            self.slugs.add(urls.slugify(plain_heading(body)))
            body = re.sub(r"(?<!\\)(#+)$", r"\\\1", body)
            out.put("#" * int(n.tag[1]) + " " + body)
            out.want(2)

    def _a(self, n: Node, out: _Out) -> None:
        href = n.attrs.get("href")
        clean = self.o.clean
        if href is None or self.pre or self.code or ("empty_links" in clean and urls.is_empty_href(href)):
            self.kids(n, out)
            return
        if n.text()[:1].isspace() and not out.line_start() and not out.tail.endswith(" "):
            out.put(" ")
        self.link += 1
        body = self.sub(n)
        self.link -= 1
        to = urls.resolve(href, self.o.origin, "urls" in clean)
        text = body.strip()
        if self.literal:
            if not urls.is_safe_url(href):
                out.put(text)
                return
            title = n.attrs.get("title")
            quoted = lambda name, s: f' {name}="{html_escape(s).replace(chr(34), "&quot;")}"'
            out.put(f"<a{quoted('href', to)}{quoted('title', title) if title else ''}>{text}</a>")
            return
        if not text and "empty_link_text" in clean:
            return
        if self.heading and "self_link_headings" in clean and to.startswith("#"):
            out.put(text)
            return
        bare = re.sub(r"\\(.)", r"\1", text)
        if bare == to and to:
            if "redundant_links" in clean:
                out.put(text)
                return
            if urls.is_autolink(to):
                out.put(f"<{to}>")
                return
        title = n.attrs.get("title")
        if out.tail.endswith(")") and out.last == "[" and not out.pending:
            out.put(" ")  # two links aren't glued
        shown = f"[{text}]({_destination(to)}{_title(title if title != n.text().strip() else None)})"
        out.put(shown)
        if body.endswith(" "):
            out.put(" ")

    def _img(self, n: Node, out: _Out) -> None:
        src = n.attrs.get("src", "")
        alt = n.attrs.get("alt", "")
        if urls.is_data_url(src) or (not alt and "empty_images" in self.o.clean):
            return
        alt = re.sub(r"[\\\[\]*_`~<&]", r"\\\g<0>", _SPACE.sub(" ", alt))
        to = urls.resolve(src, self.o.origin, "urls" in self.o.clean)
        out.put(f"![{alt}]({_destination(to)}{_title(n.attrs.get('title'))})")

    def _br(self, n: Node, out: _Out) -> None:
        if self.pre or self.code:
            out.put("<br>" if self.cell else "\n")
        elif self.cell or self.heading or self.literal:
            out.put("<br>")
        elif not out.line_start():
            out.trim()
            out.put("  \n")

    def _hr(self, n: Node, out: _Out) -> None:
        if self.cell:
            out.put("<hr>")
        else:
            shares = not out.parts and n.parent is not None and n.parent.tag == "li"  # the line of an item's marker
            out.want(2)
            out.put("***" if shares else "---")
            out.want(2)

    def _code(self, n: Node, out: _Out) -> None:
        if self.pre or self.code:
            self.kids(n, out)
            return
        if self.literal:
            self._raw(n, out, "code")
            return
        self.code += 1
        text = self.sub(n)
        self.code -= 1
        if not text.strip():
            return
        if self.cell:
            text = text.replace("|", "\\|")
        if out.tail.endswith("`") and not out.pending:
            out.put(" ")
        out.put(_span(text.strip("\n") if text.strip(" ") else text))

    def _pre(self, n: Node, out: _Out) -> None:
        inner = next((k for k in n.kids if isinstance(k, Node) and k.tag == "code"), None)
        if self.cell or self.literal:
            body = html_escape(n.text().strip("\n")).replace("|", "&#124;").replace("\n", "<br>" if self.cell else "\n")
            out.put(f"<pre><code>{body}</code></pre>" if inner is not None else f"<pre>{body}</pre>")
            return
        self.pre += 1
        body = self.sub(n)
        self.pre -= 1
        if not body.strip():
            return
        m = _LANGUAGE.search((inner.attrs.get("class", "") if inner is not None else "") + " " + n.attrs.get("class", ""))
        language = m[1] if m else ""
        mark = "~" if "`" in language else "`"
        run = max((len(r) for r in re.findall(re.escape(mark) + "+", body)), default=0)
        fence = mark * max(3, run + 1)
        out.want(2)
        out.put(f"{fence}{language}\n{body.strip(chr(10)).rstrip()}\n{fence}")
        out.want(2)

    def _blockquote(self, n: Node, out: _Out) -> None:
        if self.cell or self.literal:
            self._raw(n, out, "blockquote") if self.literal else self.kids(n, out)
            return
        self.margin += 2
        body = self.sub(n).strip("\n ")
        self.margin -= 2
        if not body:
            return
        out.want(2)
        out.put("\n".join("> " + x if x else ">" for x in body.split("\n")))
        out.want(2)

    @staticmethod
    def first_number(n: Node) -> int:
        at = _integer(n.attrs.get("start"), 0, 999_999_999)
        return 1 if at is None else at

    def _list(self, n: Node, out: _Out) -> None:
        if self.cell:
            self._raw(n, out, n.tag)
            return
        nested = n.parent is not None and n.parent.tag == "li"
        out.want(1 if nested else 2)
        number = self.first_number(n)
        for k in n.kids:
            if isinstance(k, str):
                if k.strip():
                    self._text(k, out)
            elif k.tag == "li":
                self._item(k, out, f"{number}. " if n.tag == "ol" else "- ", nested and k is n.kids[0])
                number += 1
            else:
                self.element(k, out)
        out.want(1 if nested else 2)

    def _item(self, n: Node, out: _Out, marker: str, first: bool = False) -> None:
        inner = _Out()
        self.margin += len(marker)
        self.kids(n, inner)
        self.margin -= len(marker)
        body = inner.text().strip("\n")
        body = body if body.endswith("  ") else body.rstrip(" ")
        # an empty item right below a line of text would make that line a heading
        out.want(2 if first and not body and out.tail and not out.tail.endswith("\n") else 1)
        indent = " " * len(marker)
        lines = body.split("\n")
        out.put(marker.rstrip() if not body else marker + "\n".join([lines[0], *(indent + x if x else "" for x in lines[1:])]))
        out.want(1)

    def _li(self, n: Node, out: _Out) -> None:
        if self.cell:
            self._raw(n, out, "li")
        else:
            self._item(n, out, "- ")

    def _raw(self, n: Node, out: _Out, tag: str) -> None:
        out.put(f"<{tag}>")
        for k in n.kids:
            if isinstance(k, str):
                if k.strip():
                    self._text(k, out)
            elif k.tag == "li":
                self._raw(k, out, "li")
            else:
                self.element(k, out)
        out.trim()
        out.put(f"</{tag}>")

    def _kept(self, n: Node, out: _Out) -> None:
        block = n.tag in ("details", "summary", "dl") and not self.cell
        if block and n.tag != "summary":
            out.want(2)
        self.literal += 1
        self._raw(n, out, n.tag)
        self.literal -= 1
        if block:
            out.want(2)
        elif n.tag in ("dt", "dd") and not self.cell:
            out.want(1)

    def _figcaption(self, n: Node, out: _Out) -> None:
        was, self.italic = self.italic, 1  # the caption is emphasised as a whole
        body = self.sub(n).strip()
        self.italic = was
        if body:
            out.want(2)
            out.put(f"*{body}*")
            out.want(2)

    def _table(self, n: Node, out: _Out) -> None:
        if self.cell or self.literal:
            self._raw_table(n, out)
            return
        rows = [k for k in _rows(n)]
        caption = next((k for k in n.kids if isinstance(k, Node) and k.tag == "caption"), None)
        if caption is not None and (text := self.sub(caption).strip()):
            out.want(2)
            out.put(text)
        width, lines = 0, []
        self.tables += 1
        for row in rows:
            cells: list[str] = []
            aligns: list[str] = []
            for c in row.kids:
                if not isinstance(c, Node) or c.tag not in ("td", "th"):
                    continue
                self.cell += 1
                body = self.sub(c).replace("\n", " ").strip()
                self.cell -= 1
                cells.append(body)
                align = (c.attrs.get("align") or "").strip().lower()
                aligns.append({"left": ":---", "center": ":---:", "right": "---:"}.get(align, "---"))
                extra = (_integer(c.attrs.get("colspan"), 1, 64) or 1) - 1
                cells += [""] * extra
                aligns += ["---"] * extra
            if not cells:
                continue
            if not lines:
                width = len(cells)
                lines = [_row(cells), _row(aligns)]
                continue
            if len(cells) > width:
                cells = [*cells[: width - 1], " ".join(x for x in cells[width - 1 :] if x)]
            lines.append(_row(cells))
        self.tables -= 1
        if lines:
            out.want(2)
            out.put("\n".join(lines))
            out.want(2)

    def _raw_table(self, n: Node, out: _Out) -> None:
        self.tables += n.tag == "table"
        out.put(f"<{n.tag}>")
        for k in n.kids:
            if isinstance(k, str):
                if k.strip():
                    self._text(k, out)
            elif k.tag in ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"):
                self._raw_table(k, out)
            else:
                self.element(k, out)
        out.put(f"</{n.tag}>")
        self.tables -= n.tag == "table"


def _as_pair(before: str, after: str):
    return lambda r, n, out: r._pair(n, out, before, after)


_BLOCKS = T.SPACED | T.PASSING
_HANDLERS = (
    {t: Renderer._heading for t in T.HEADINGS}
    | {t: _as_pair(f"<{t}>", f"</{t}>") for t in T.KEPT_INLINE}
    | {t: Renderer._code for t in (*T.BACKTICKED, "code")}
    | {t: Renderer._kept for t in T.LITERAL}
    | {t: _as_pair("**", "**") for t in ("strong", "b", "dfn")}
    | {t: _as_pair("*", "*") for t in ("em", "i", "cite")}
    | {t: _as_pair("~~", "~~") for t in ("del", "s", "strike")}
    | {
        "q": _as_pair('"', '"'), "ul": Renderer._list, "ol": Renderer._list, "li": Renderer._li, "a": Renderer._a, "img": Renderer._img, "br": Renderer._br,
        "hr": Renderer._hr, "pre": Renderer._pre, "blockquote": Renderer._blockquote, "table": Renderer._table, "figcaption": Renderer._figcaption,
    }
)


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(cells) + " |"


def _rows(table: Node):
    for k in table.kids:
        if isinstance(k, Node):
            if k.tag == "tr":
                yield k
            elif k.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(k)


def plain_heading(md: str) -> str:
    """Heading text without its marks."""
    s = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", md)
    s = re.sub(r"</?[A-Za-z][^>]*>", "", s)
    return re.sub(r"(?<!\\)[*_~`]", "", s).replace("\\", "")


_FRAGMENT = re.compile(r"(?<!!)\[((?:[^\[\]\\]|\\.)*)\]\(#([^\s()<>]*)\)")


def without_dead_fragments(md: str, slugs: set[str]) -> str:
    """Links to headings that the document doesn't have, as their text; code stays."""
    out, fenced = [], ""
    for line in md.split("\n"):
        mark = re.match(r"\s*(?:>\s*)*(`{3,}|~{3,})", line)
        if mark and (not fenced or line.strip().startswith(fenced)):
            fenced = "" if fenced else mark[1]
        elif not fenced and "](#" in line:
            parts = re.split(r"(`+[^`]*`+)", line)
            line = "".join(p if i % 2 else _FRAGMENT.sub(lambda m: m[0] if m[2] in slugs else m[1], p) for i, p in enumerate(parts))
        out.append(line)
    return "\n".join(out)


def to_markdown(root: Node, o: Options) -> str:
    r = Renderer(o)
    out = _Out()
    r.kids(root, out)
    md = out.text().lstrip(WHITE).rstrip(" \t\n\x0b\f\r")
    return without_dead_fragments(md, r.slugs) if "fragments" in o.clean and "](#" in md else md
