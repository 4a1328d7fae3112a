"""What happens to a tree before it is rendered: filters, the main part, head metadata."""

from __future__ import annotations

import re

from quillspan.operators import tags as T
from quillspan.operators.dom import Node, prune
from quillspan.operators.options import Options
from quillspan.operators.selectors import matcher

_SPACE = re.compile(r"[ \t\n\f\r]+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s?:\s?none|visibility\s?:\s?hidden|position\s?:\s?(?:absolute|fixed))", re.I)
#: The meta names that frontmatter takes by default.
META_FIELDS = ("description", "keywords", "author", "date", "og:title", "og:description", "twitter:title", "twitter:description")
#: Utility classes and what they mean in text; other ``font-`` classes take weight away, ``invisible`` hides.
_UTILITIES = {
    "italic": ("style", "*"), "not-italic": ("style", ""),
    "font-bold": ("weight", "**"), "font-semibold": ("weight", "**"), "font-black": ("weight", "**"), "font-extrabold": ("weight", "**"),
    "font-medium": ("weight", "**"), "bold": ("weight", "**"),
    "line-through": ("line", "~~"), "underline": ("line", "~~"), "no-underline": ("line", ""),
    "hidden": ("display", "hide"), "block": ("display", ""), "flex": ("display", ""), "inline": ("display", ""),
    "absolute": ("position", "hide"), "fixed": ("position", "hide"), "sticky": ("position", "hide"), "static": ("position", ""), "relative": ("position", ""),
}
_BREAKPOINTS = {"": 0, "sm": 1, "md": 2, "lg": 3, "xl": 4, "2xl": 5}


def class_marks(classes: str) -> tuple[str, str, bool]:
    """(before, after, hidden): of each group the widest breakpoint holds, of equals the last."""
    best: dict[str, tuple[int, str]] = {}
    for c in classes.split():
        prefix, _, name = c.rpartition(":")
        if prefix not in _BREAKPOINTS:
            continue
        known = _UTILITIES.get(name) or (("weight", "") if "font-" in name else ("display", "hide") if "invisible" in name else None)
        if known:
            group, mark = known
            if _BREAKPOINTS[prefix] >= best.get(group, (-1, ""))[0]:
                best[group] = (_BREAKPOINTS[prefix], mark)
    marks = [best[g][1] for g in ("weight", "style", "line") if g in best and best[g][1]]
    return "".join(marks), "".join(reversed(marks)), any(best.get(g, (0, ""))[1] == "hide" for g in ("display", "position"))


def is_hidden(n: Node) -> bool:
    return ("hidden" in n.attrs and n.attrs["hidden"] != "until-found") or bool(_HIDDEN.search(n.attrs.get("style", "")))


def keep_main(root: Node) -> None:
    """Only the first ``main``; without one, from the first heading outside a header to the first footer."""
    found = next((n for n in root.walk() if n.tag == "main" and n.depth <= 50), None)
    head = root.first("head")
    if found is not None:
        root.kids = ([head] if head is not None else []) + [found]
        return
    start = stop = None
    header: Node | None = None
    order = list(root.walk())
    inside_header: set[int] = set()
    for n in order:
        if n.tag == "header" or (n.parent is not None and id(n.parent) in inside_header):
            inside_header.add(id(n))
        if start is None and n.tag in T.HEADINGS and id(n) not in inside_header:
            start = n
        elif start is not None and n.tag == "footer" and abs(n.depth - start.depth) <= 5:
            stop = n
            break
    if start is None:
        return
    up: set[int] = set()
    n: Node | None = start
    while n is not None:
        up.add(id(n))
        n = n.parent
    down: set[int] = set()
    n = stop
    while n is not None:
        down.add(id(n))
        n = n.parent

    def cut(node: Node) -> None:
        kids = node.kids
        if id(node) in up and node is not start:
            at = next(i for i, k in enumerate(kids) if isinstance(k, Node) and id(k) in up)
            kids = [k for k in kids[:at] if k is head] + kids[at:]
        if stop is not None and id(node) in down and node is not stop:
            at = next((i for i, k in enumerate(kids) if isinstance(k, Node) and id(k) in down), None)
            if at is not None:
                kids = kids[: at + (kids[at] is not stop)]
        node.kids = kids
        for k in kids:
            if isinstance(k, Node) and (id(k) in up or id(k) in down):
                cut(k)

    cut(root)


def prepare(root: Node, o: Options) -> Node:
    if o.isolate_main:
        keep_main(root)
    if o.exclude or o.include:
        out = matcher(o.exclude) if o.exclude else lambda n: False
        prune(root, lambda n: out(n) or is_hidden(n))
    if o.include:
        wanted = matcher(o.include)
        kept: list[Node | str] = []
        stack: list[Node | str] = list(reversed(root.kids))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                continue
            if wanted(n):
                if not o.process_children:
                    n.kids = [k for k in n.kids if isinstance(k, str)]
                kept.append(n)
            else:
                stack.extend(reversed(n.kids))
        root.kids = kept
    if o.tailwind:
        prune(root, lambda n: class_marks(n.attrs.get("class", ""))[2])
    return root


def head_metadata(root: Node, more: tuple[str, ...] = (), given: dict[str, str] | None = None) -> dict[str, str]:
    """Title and the meta fields of the head; the last of a name holds. Fields given beside it stay, but for title and description."""
    head = root.first("head")
    out: dict[str, str] = {k: v for k, v in (given or {}).items() if k not in ("title", "description")}
    for n in (head or root).walk():
        if n.tag == "title" and "title" not in out and (t := _SPACE.sub(" ", n.text()).strip(" ")):
            out["title"] = t
        elif n.tag == "meta" and head is not None:
            name = n.attrs.get("name") or n.attrs.get("property") or ""
            if name in META_FIELDS + more and "content" in n.attrs:
                out[name] = n.attrs["content"]
    return out


_UNSAFE_YAML = re.compile(r"[:#\n\r\t\"'\\{}\[\],&*!|>%@`]|^[\s?-]|\s$|^$")
_TYPED_YAML = re.compile(r"(?:true|false|null|yes|no|on|off|~|[-+]?[\d.][\d._eExXoO+-]*|\d{4}-\d\d-\d\d.*)", re.I)


def yaml_scalar(value: str) -> str:
    if " " in value or _UNSAFE_YAML.search(value) or _TYPED_YAML.fullmatch(value):
        escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        return f'"{escaped}"'
    return value


def frontmatter_block(meta: dict[str, str], given: dict[str, str] | None = None) -> str:
    if not meta:
        return ""
    lines = ["---"]
    if "title" in meta:
        lines.append(f"title: {yaml_scalar(meta['title'])}")
    lines += [f"{k}: {yaml_scalar(v)}" for k, v in (given or {}).items() if k in meta and k not in ("title", "description")]
    rest = {k: v for k, v in meta.items() if k != "title" and k not in (given or {})}
    if rest:
        lines.append("meta:")
        lines += [f"  {yaml_scalar(k) if ':' in k else k}: {yaml_scalar(v)}" for k, v in sorted(rest.items())]
    return "\n".join([*lines, "---"])


class Plugin:
    """Hooks of a conversion, run on the tree before it is rendered; each may be left out.

    Order at an element: attributes, skip, enter; its content; exit. At the end of the document: end.
    """

    def process_attributes(self, n: Node) -> None: ...
    def skip(self, n: Node) -> bool:
        return False

    def enter(self, n: Node) -> str | None: ...
    def exit(self, n: Node) -> str | None: ...
    def text(self, s: str, parent: Node) -> str | None:
        """What stands for a text; None leaves it out."""
        return s

    def end(self, root: Node) -> None: ...


RAW = "#raw"


def apply_plugins(root: Node, plugins: tuple[Plugin, ...]) -> None:
    """Run the hooks in document order. What enter and exit return stands literally at the beginning and end of the element."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        n, leaving = stack.pop()
        if leaving:
            for p in plugins:
                if said := p.exit(n):
                    n.kids.append(_raw(said, n))
            continue
        kids: list[Node | str] = []
        for k in n.kids:
            if isinstance(k, str):
                for p in plugins:
                    k = p.text(k, n) if k is not None else None
                if k is not None:
                    kids.append(k)
                continue
            for p in plugins:
                p.process_attributes(k)
            if not any([p.skip(k) for p in plugins]):
                kids.append(k)
        n.kids = kids
        below = [k for k in kids if isinstance(k, Node)]
        if n is not root:
            stack.append((n, True))
            n.kids = [*(_raw(said, n) for p in plugins if (said := p.enter(n))), *kids]
        stack.extend((k, False) for k in reversed(below))
    for p in plugins:
        p.end(root)


def _raw(said: str, parent: Node) -> Node:
    n = Node(RAW, {}, parent)
    n.kids.append(said)
    return n
