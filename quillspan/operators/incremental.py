"""Conversion of a document that comes in pieces, put out as far as it can't change any more.

The parser takes pieces as they come. Elements that only group others (``ENTERED``) are rendered while they are
still open, lists item by item; any other element once it is closed. What is rendered leaves the tree, so that the
state is the open construct and what the parser holds back, not the document. White space at the end is held until
something follows it. The parts put out, joined, are the result of the whole document for every way of cutting it.

Some options need the whole document first: dead fragments, the main part, inclusions, front blocks, hidden classes,
and hooks. Then everything comes out at the end. Metadata and extracted elements are handed over once, at the end;
asking for them keeps the tree.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable

from quillspan.operators import tags as T
from quillspan.operators.dom import CDATA, Node, Parser, prune
from quillspan.operators.markdown import WHITE, Renderer, _Out, to_markdown
from quillspan.operators.options import Options
from quillspan.operators.plain import _Safe, _Text, extract, to_safe_html, to_text
from quillspan.operators.prepare import Plugin, apply_plugins, frontmatter_block, head_metadata, is_hidden, prepare
from quillspan.operators.selectors import matcher

ENTERED = frozenset({"html", "body", "head", "div", "main", "article", "section", "header", "nav", "footer", "aside", "form", "center", "figure", "p", "span"})
_LISTS = frozenset({"ul", "ol"})
_HELD = {"markdown": " \t\n\x0b\f\r", "text": None, "safe_html": None}


class Converter:
    """``process`` takes a piece (text or UTF-8 bytes) and returns what is ready, ``finish`` the rest.

    ``output`` is markdown, text or safe_html. ``on_end`` is called once with the metadata and the extracted elements.
    """

    def __init__(self, output: str = "markdown", o: Options = Options(), selectors: tuple[str, ...] = (), plugins: tuple[Plugin, ...] = (), on_end: Callable[[dict, list], None] | None = None):
        if output not in _HELD:
            raise ValueError(f"unknown output {output}; there are {', '.join(_HELD)}")
        self.output, self.o, self.selectors, self.plugins, self.on_end = output, o, selectors, plugins, on_end
        void = frozenset(t for t, x in o.overrides.items() if x.self_closing)
        self.whole = bool("fragments" in o.clean or o.isolate_main or o.include or o.frontmatter or o.tailwind or plugins or selectors or on_end)
        self.parser = Parser(CDATA in o.overrides, void, keep=self.whole)
        self.renderer = {"markdown": Renderer, "text": _Text, "safe_html": _Safe}[output](o)
        self.out = _Out()
        self.path: list[list] = [[self.parser.b.root, 0]]  # entered elements, and the number of the next item of a list
        self.started = False
        self.bytes: bytes = b""
        self.high = ""

    def _decoded(self, piece: str | bytes) -> str:
        if isinstance(piece, bytes):  # the bytes of a character that the piece cuts are kept for the next one
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            text = decoder.decode(self.bytes + piece)
            self.bytes = decoder.getstate()[0]
            return text
        piece, self.high = self.high + piece, ""
        if piece and "\ud800" <= piece[-1] <= "\udbff":
            piece, self.high = piece[:-1], piece[-1]
        if any("\ud800" <= c <= "\udfff" for c in piece) if not piece.isascii() else False:
            piece = piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return piece

    def process(self, piece: str | bytes) -> str:
        if not piece:
            return ""
        self.parser.feed(self._decoded(piece))
        if self.whole:
            return ""
        self._advance(False)
        return self._ready(False)

    def finish(self) -> str:
        if self.bytes or self.high:
            self.parser.feed("\ufffd")
            self.bytes, self.high = b"", ""
        root = self.parser.finish()
        if self.whole:
            return self._all(root)
        self._advance(True)
        return self._ready(True)

    def _all(self, root: Node) -> str:
        o = self.o
        apply_plugins(root, self.plugins)
        metadata = head_metadata(root, o.meta_fields, o.additional_fields) if o.frontmatter or self.on_end else {}
        found = extract(root, self.selectors) if self.selectors else []
        prepare(root, o)
        if self.output == "markdown":
            said = to_markdown(root, o)
            if o.frontmatter and (block := frontmatter_block(metadata, o.additional_fields)):
                said = f"{block}\n\n{said}" if said else block
        else:
            said = (to_text if self.output == "text" else to_safe_html)(root, o)
        if self.on_end:
            self.on_end(metadata, found)
        return said

    # rendering ----------------------------------------------------------
    def _gone(self, n: Node) -> bool:
        if not self.o.exclude:
            return False
        return matcher(self.o.exclude)(n) or is_hidden(n)

    def _enters(self, n: Node) -> bool:
        if n.tag in self.o.overrides:
            return False
        if self.output == "safe_html":
            return n.tag in ENTERED and n.tag not in T.SAFE
        return n.tag in ENTERED or (self.output == "markdown" and n.tag in _LISTS)

    def _edge(self, n: Node) -> None:
        """The spacing at the beginning and the end of an entered element."""
        if self.output != "safe_html" and n.tag in T.SPACED:
            self.out.want(2)

    def _render(self, k: Node | str, frame: list) -> None:
        r, out = self.renderer, self.out
        if self.output == "safe_html":
            r.text(k, False) if isinstance(k, str) else r.element(k)
        elif self.output == "text":
            r.text(k, out) if isinstance(k, str) else r.element(k, out)
        elif frame[0].tag in _LISTS:
            if isinstance(k, str):
                if k.strip():
                    r._text(k, out)
            elif k.tag == "li":
                r._item(k, out, f"{frame[1]}. " if frame[0].tag == "ol" else "- ")
                frame[1] += 1
            else:
                r.element(k, out)
        else:
            r._text(k, out) if isinstance(k, str) else r.element(k, out)

    def _advance(self, final: bool) -> None:
        open_now: set[int] = set()
        n = self.parser.b.top
        while n is not None and not final:
            open_now.add(id(n))
            n = n.parent
        while True:
            frame = self.path[-1]
            here = frame[0]
            kids = here.kids
            done = 0
            entered = False
            for i, k in enumerate(kids):
                last = i == len(kids) - 1
                if isinstance(k, str):
                    if last and id(here) in open_now:
                        break
                elif self._gone(k):
                    if id(k) in open_now:
                        k.kids = [k.kids[-1]] if k.kids and isinstance(k.kids[-1], Node) else []
                        break
                    done = i + 1
                    continue
                elif id(k) in open_now or (self._enters(k) and last):
                    if id(k) in open_now and not self._enters(k):
                        break
                    self._edge(k)
                    self.path.append([k, Renderer.first_number(k) if k.tag == "ol" else 1])
                    done, entered = i + 1, True
                    break
                elif self.o.exclude:
                    prune(k, self._gone)
                self._render(k, frame)
                done = i + 1
            del kids[:done]
            if entered:
                continue
            if id(here) in open_now or len(self.path) == 1:
                return
            self._edge(here)
            self.path.pop()

    def _ready(self, final: bool) -> str:
        held = _HELD[self.output]
        if self.output == "safe_html":
            said = "".join(self.renderer.parts)
            ready = said if final else said.rstrip()
            self.renderer.parts = [said[len(ready) :]] if len(ready) < len(said) else []
        elif final:
            ready = self.out.text()
        elif self.output == "text":
            whole = self.out.text()
            ready = self.out.take(whole[len(whole.rstrip()) :] or " ") if whole.strip() else ""
        else:
            ready = self.out.take(held)
        if final:
            ready = ready.rstrip() if held is None else ready.rstrip(held)
        if self.output == "text":
            ready = "\n".join(x.rstrip(" \t") for x in ready.split("\n")) if "\n" in ready else ready
            ready = ready if not final else ready.rstrip()
        if not self.started and ready:
            ready = ready.lstrip() if held is None else ready.lstrip(WHITE)
            self.started = bool(ready)
        return ready
