"""CSS selectors without combinators: tag, .class, #id, [attribute] and lists of those."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.operators.dom import Node

_PART = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*))\s*)?\]""")

Test = tuple[str, str, str]


@lru_cache(256)
def parse_selector(selector: str) -> tuple[tuple[Test, ...], ...]:
    """Alternatives, each a tuple of tests ``(kind, name, value)``; kind is tag or an operator."""
    out = []
    for one in selector.split(","):
        one, pos, tests = one.strip(), 0, []
        while pos < len(one):
            m = _PART.match(one, pos)
            if not m:
                raise ValueError(f"selector not supported: {one!r}")
            if m[1]:
                tests.append(("tag", m[1].lower(), ""))
            elif m[2]:
                tests.append(("~=", "class", m[2]))
            elif m[3]:
                tests.append(("=", "id", m[3]))
            else:
                value = next((x for x in m.group(6, 7, 8) if x is not None), "")
                tests.append((m[5] or "has", m[4].lower(), value))
            pos = m.end()
        if tests:
            out.append(tuple(tests))
    if not out:
        raise ValueError("empty selector")
    return tuple(out)


def _holds(value: str | None, kind: str, want: str) -> bool:
    if value is None:
        return False
    return {
        "has": True,
        "=": value == want,
        "~=": want in value.split(),
        "^=": bool(want) and value.startswith(want),
        "$=": bool(want) and value.endswith(want),
        "*=": bool(want) and want in value,
        "|=": value == want or value.startswith(want + "-"),
    }[kind]


def matcher(selectors: tuple[str, ...]) -> Callable[[Node], bool]:
    groups = [alt for s in selectors for alt in parse_selector(s)]

    def match(n: Node) -> bool:
        return any(
            all(name in ("*", n.tag) if kind == "tag" else _holds(n.attrs.get(name), kind, want) for kind, name, want in alt)
            for alt in groups
        )

    return match


def selector_column(selector: str, tag: Column, attrs: Column) -> Column:
    """The same test as a native column over a relation of elements."""

    def one(kind: str, name: str, want: str) -> Column:
        if kind == "tag":
            return F.lit(True) if name == "*" else tag == name
        value = F.try_element_at(attrs, F.lit(name))
        test = {
            "has": lambda: value.isNotNull(),
            "=": lambda: value == want,
            "~=": lambda: F.array_contains(F.split(value, r"\s+"), want),
            "^=": lambda: value.startswith(want),
            "$=": lambda: value.endswith(want),
            "*=": lambda: value.contains(want),
            "|=": lambda: (value == want) | value.startswith(want + "-"),
        }[kind]()
        return F.coalesce(test, F.lit(False))

    result = F.lit(False)
    for alt in parse_selector(selector):
        every = F.lit(True)
        for test in alt:
            every = every & one(*test)
        result = result | every
    return result
