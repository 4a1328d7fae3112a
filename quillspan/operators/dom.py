"""HTML to a tree, with the end tags that malformed pages leave out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from quillspan.operators import tags as T
from quillspan.operators.entities import decode

MAX_DEPTH = 512
_OPEN = re.compile(r"<([a-zA-Z][^\s/>\x00]*)")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>\x00]*)[^>]*>")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Attributes of the usual forms up to the end of a tag.
_PLAIN_TAG = re.compile(r"""(?:\s+[^\s"'<>=/]+(?:=(?:"[^">]*"|'[^'>]*'|[^\s"'<>=`]+))?)*\s*/?>""")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Start tags that may end other elements.
_ENDS_OTHERS = T.CLOSES_P | T.HEADINGS | {"a", "td", "th", "tr", "thead", "tbody", "tfoot", "select", "option", "optgroup", "li", "dt", "dd"}
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|$))", re.S)
_SCRIPT_STEP = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)


class Node:
    """An element; ``kids`` holds elements and strings (decoded text)."""

    __slots__ = ("tag", "attrs", "kids", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0

    def walk(self) -> Iterator[Node]:
        """This element and those inside it, in document order."""
        stack: list[Node] = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self) -> str:
        """All text inside, as it stands."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.kids))
        return "".join(out)

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)


def parse_attributes(s: str) -> dict[str, str]:
    """Names in lower case, values decoded, the first of a name holds, no value is ''."""
    return dict(_attributes(s))


@lru_cache(1 << 12)
def _attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(s):
        name = m[1].lower()
        if name not in out:
            out[name] = decode(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "", True)
    return out


def _tag_end(html: str, at: int) -> int:
    """The place of the ``>`` that ends the tag begun before ``at``; -1 without one."""
    first = html.find(">", at)
    if first < 0:
        return -1
    if html.find('"', at, first) < 0 and html.find("'", at, first) < 0:
        return first
    if _PLAIN_TAG.match(html, at, first + 1):
        return first
    quote = ""
    i, n = at, len(html)
    after_equals = False
    while i < n:
        c = html[i]
        if quote:
            j = html.find(quote, i)
            if j < 0:
                return -1
            i, quote = j, ""
        elif c == ">":
            return i
        elif c in "\"'" and after_equals:
            quote = c
        if not c.isspace():
            after_equals = c == "="
        i += 1
    return -1


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#root", {}, None)
        self.top = self.root
        self.open: dict[str, int] = {}
        self.flat: dict[str, int] = {}  # open elements flattened into the deepest one, by name

    def text(self, s: str) -> None:
        if s:
            kids = self.top.kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += s
            else:
                kids.append(s)

    def pop(self) -> None:
        n = self.top
        self.open[n.tag] -= 1
        if self.flat:
            self.flat = {}
        if n.tag == "a" and not n.kids and "href" in n.attrs:
            label = n.attrs.get("title") or n.attrs.get("aria-label")
            if label:
                n.kids.append(label)
        self.top = n.parent

    def pop_to(self, n: Node) -> None:
        while self.top is not n.parent:
            self.pop()

    def within(self, names, scope) -> Node | None:
        """The nearest open element of these names, looked for up to the scope."""
        if not any(self.open.get(x) for x in names):
            return None
        n = self.top
        while n is not self.root:
            if n.tag in names:
                return n
            if n.tag in scope:
                return None
            n = n.parent
        return None

    def close_implied(self, tag: str) -> bool:
        """Close what a start tag ends; False if the tag itself is to be ignored."""
        if self.open.get("head") and tag not in T.IN_HEAD:
            head = self.within({"head"}, ())
            if head is not None and tag not in ("head", "html"):
                self.pop_to(head)
        if tag == "a":
            if n := self.within({"a"}, T.A_SCOPE):
                self.pop_to(n)
        elif tag in ("td", "th"):
            if n := self.within({"td", "th"}, T.CELL_SCOPE):
                self.pop_to(n)
        elif tag == "tr":
            if n := self.within({"tr"}, T.ROW_SCOPE):
                self.pop_to(n)
        elif tag in ("thead", "tbody", "tfoot"):
            if n := self.within({"thead", "tbody", "tfoot", "caption"}, T.SECTION_SCOPE):
                self.pop_to(n)
        elif tag == "select" and self.open.get("select"):
            if n := self.within({"select"}, {"template"}):
                self.pop_to(n)
                return False
        elif tag in ("option", "optgroup"):
            if n := self.within({"option"}, {"select", "optgroup", "datalist"}):
                self.pop_to(n)
            if tag == "optgroup" and (n := self.within({"optgroup"}, {"select"})):
                self.pop_to(n)
        if tag in T.CLOSES_P and self.open.get("p") and (n := self.within({"p"}, T.P_SCOPE)):
            self.pop_to(n)
        if tag in T.HEADINGS and self.top.tag in T.HEADINGS:
            self.pop()
        elif tag == "li" and (n := self.within({"li"}, T.LI_SCOPE)):
            self.pop_to(n)
        elif tag in ("dt", "dd") and (n := self.within({"dt", "dd"}, T.DL_SCOPE)):
            self.pop_to(n)
        return True

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if (tag in _ENDS_OTHERS or self.open.get("head")) and not self.close_implied(tag):
            return None
        if self.top.depth >= MAX_DEPTH:  # deeper elements are flattened into this one
            if not closed:
                self.flat[tag] = self.flat.get(tag, 0) + 1
            return None
        n = Node(tag, attrs, self.top)
        self.top.kids.append(n)
        if not closed:
            self.top = n
            self.open[tag] = self.open.get(tag, 0) + 1
        return n

    def end(self, tag: str) -> None:
        if self.flat.get(tag):
            self.flat[tag] -= 1
            return
        if self.top.tag == tag:
            self.pop()
        elif self.open.get(tag) and (n := self.within({tag}, {"template"} - {tag})):
            self.pop_to(n)

    def finish(self) -> Node:
        while self.top is not self.root:
            self.pop()
        return self.root


CDATA = "#cdata-section"
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in T.RAW_TEXT - {"script", "plaintext"}}
_BLANK = re.compile(r"[ \t\n\f\r](?=[^ \t\n\f\r]*$)")


class Parser:
    """A parser that takes a document in pieces; ``rest`` is what a piece leaves for the next.

    Comments and raw text without output (scripts, styles and the like) are not kept while they go on,
    unless ``keep`` asks for them.
    """

    def __init__(self, cdata: bool = False, void: frozenset[str] = frozenset(), keep: bool = True):
        self.b = _Builder()
        self.rest = ""
        self.cdata, self.keep = cdata, keep
        self.none = T.VOID | void if void else T.VOID
        self.raw: tuple[str, Node | None] | None = None
        self.body: list[str] = []
        self.escaped = self.nested = False  # in a script: within <!--, and within <script in it

    def _script_end(self, html: str, at: int) -> tuple[int, int]:
        """Where the end tag begins (-1 without one) and up to where the marks are taken in: inside ``<!-- <script`` the next end tag doesn't count."""
        seen = at
        for m in _SCRIPT_STEP.finditer(html, at):
            s = m[0]
            seen = m.end()
            if s == "<!--":
                self.escaped = True
            elif s == "-->":
                self.escaped = self.nested = False
            elif m[1]:
                if not self.nested:
                    return m.start(), seen
                self.nested = False
            elif self.escaped:
                self.nested = True
        return -1, seen

    def _raw_text(self, html: str, pos: int, final: bool) -> int:
        """Take in the text of a raw element from ``pos`` on; where it ends, or -1 if more is to come."""
        tag, node = self.raw
        n = len(html)
        kept = node is not None and (self.keep or tag == "title" or tag not in T.SILENT)
        if tag == "script":
            stop, seen = self._script_end(html, pos)
            hold = max(seen, n - 9)
        elif tag == "plaintext":
            stop, hold = -1, n
        else:
            m = _RAW_END[tag].search(html, pos)
            stop, hold = (m.start() if m else -1), max(pos, n - len(tag) - 2)
        end = html.find(">", stop) if stop >= 0 else -1
        if end < 0 and not final:
            upto = stop if stop >= 0 else hold
            if kept:
                self.body.append(html[pos:upto])
            self.rest = html[upto:]
            return -1
        if kept:
            self.body.append(html[pos:] if stop < 0 else html[pos:stop])
            if body := "".join(self.body):
                node.kids.append(decode(body) if tag in ("title", "textarea") else body)
        self.body = []
        self.raw = None
        self.escaped = self.nested = False
        if stop < 0:
            return n
        if node is not None:
            self.b.end(tag)
        return n if end < 0 else end + 1

    def feed(self, html: str, final: bool = False) -> None:
        if self.rest:
            html, self.rest = self.rest + html, ""
        b = self.b
        pos, n = 0, len(html)
        if self.raw is not None and (n or final):
            pos = self._raw_text(html, 0, final)
            if pos < 0:
                return
        while pos < n:
            at = html.find("<", pos)
            if at < 0:
                cut = n
                if not final:  # a reference may go on in the next piece, white space ends it
                    m = _BLANK.search(html, pos)
                    cut = m.start() if m else pos
                b.text(decode(html[pos:cut]))
                self.rest = html[cut:]
                return
            after = html[at + 1 : at + 2]
            if not after and not final:
                break
            if after not in _LETTERS and after not in ("/", "!", "?"):
                b.text(decode(html[pos : at + 1]))
                pos = at + 1
                continue
            if at > pos:
                b.text(decode(html[pos:at]))
                pos = at
            if after == "!" or after == "?":
                if not final and n - at < 9 and ("<![CDATA[".startswith(html[at:]) or "<!--".startswith(html[at : at + 4]) and n - at < 7):
                    break
                if m := _COMMENT.match(html, at):
                    if not final and m.end() == n and not m[0].endswith(("-->", "--!>", "<!-->", "<!--->")):
                        self.rest = "<!-- " + html[max(at + 4, n - 3) :]
                        return
                    pos = m.end()
                elif html.startswith("<![CDATA[", at):
                    end = html.find("]]>", at)
                    if end < 0 and not final:
                        break
                    if self.cdata and (node := b.start(CDATA, {}, True)) is not None:
                        node.kids.append(html[at + 9 : n if end < 0 else end])
                    pos = n if end < 0 else end + 3
                else:
                    end = html.find(">", at)
                    if end < 0 and not final:
                        break
                    pos = n if end < 0 else end + 1
                continue
            if after == "/":
                if m := _CLOSE.match(html, at):
                    b.end(m[1].lower())
                    pos = m.end()
                else:
                    end = html.find(">", at)
                    if end < 0:
                        break
                    pos = end + 1
                continue
            m = _OPEN.match(html, at)
            end = _tag_end(html, m.end())
            if end < 0:
                break
            tag = m[1].lower()
            raw = html[m.end() : end]
            closed = tag in self.none or raw.endswith("/")
            node = b.start(tag, parse_attributes(raw) if raw.strip(" /") else {}, closed)
            pos = end + 1
            if tag in T.RAW_TEXT and not closed:
                self.raw = tag, node
                pos = self._raw_text(html, pos, final)
                if pos < 0:
                    return
        if not final and pos < n:
            self.rest = html[pos:]

    def finish(self) -> Node:
        """The tree; an incomplete tag at the end is dropped."""
        self.feed("", True)
        return self.b.finish()


def parse(html: str, cdata: bool = False, void: frozenset[str] = frozenset()) -> Node:
    """The tree of a page or fragment; its root is ``#root``. Incomplete tags at the end are dropped.

    CDATA sections are dropped, or become elements of that name; ``void`` names further tags without content.
    """
    p = Parser(cdata, void)
    p.feed(html, True)
    return p.b.finish()


def events(html: str) -> Iterator[tuple[int, int, int, int, str | None, dict[str, str] | None, str | None]]:
    """``(seq, ev, node_id, parent_id, tag, attrs, text)`` in document order; ev is 0 enter, 1 exit, 2 text."""
    seq = node = 0
    stack: list[tuple[Node | str, int, bool]] = [(k, -1, False) for k in reversed(parse(html).kids)]
    while stack:
        n, parent, leaving = stack.pop()
        if isinstance(n, str):
            yield seq, 2, node, parent, None, None, n
            node += 1
        elif leaving:
            yield seq, 1, parent, -1, n.tag, None, None
        else:
            yield seq, 0, node, parent, n.tag, n.attrs, None
            stack.append((n, node, True))
            stack.extend((k, node, False) for k in reversed(n.kids))
            node += 1
        seq += 1


def prune(root: Node, gone: Callable[[Node], bool]) -> None:
    """Remove the elements for which ``gone`` holds, with all inside them."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not gone(k)]
        stack.extend(k for k in n.kids if isinstance(k, Node))
