"""Character references, decoded from a reduced table that follows a rule.

The names are those HTML 4 defined, without ENTITIES_LEFT_OUT, and the legacy names that may
stand without a semicolon (as in the table of HTML 5). Any other reference stays as it is.
"""

from __future__ import annotations

import re
from html.entities import html5, name2codepoint

#: Names of HTML 4 that stay literal.
ENTITIES_LEFT_OUT = frozenset({"emsp", "ensp", "thinsp", "zwnj", "zwj", "lrm", "rlm"})
LEGACY = {name: value for name, value in html5.items() if not name.endswith(";")}
NAMED = {"apos": "'"} | {name: chr(point) for name, point in name2codepoint.items() if name not in ENTITIES_LEFT_OUT} | LEGACY
_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([A-Za-z][A-Za-z0-9]{1,31});?)")
#: C1 controls are read as Windows-1252, as browsers do.
_C1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _character(n: int) -> str:
    if n in _C1:
        return _C1[n]
    if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        return "�"
    return chr(n)


def decode(text: str, attribute: bool = False) -> str:
    """Resolve references; in an attribute a legacy name before ``=`` or a letter or digit stays."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            digits = m[1] or m[2]
            return _character(int(digits[:12], 16 if m[1] else 10))
        name = m[3]
        ended = m[0].endswith(";")
        if ended and name in NAMED:
            return NAMED[name]
        for k in range(len(name), 1, -1):
            if name[:k] in LEGACY:
                rest = name[k:] + (";" if ended else "")
                after = rest[:1] or text[m.end() : m.end() + 1]
                if attribute and (after == "=" or after.isalnum()):
                    return m[0]
                return LEGACY[name[:k]] + rest
        return m[0]

    return _REFERENCE.sub(one, text)
