"""Tables that bring characters which look the same to one form, built from Unicode's own data.

The look-alikes are the letters of the Cyrillic and Greek alphabets whose usual printed
shape is that of a Latin letter. Compatibility forms are taken by rule: every letter or
digit whose compatibility mapping is of the kind <wide>, <narrow> or <font>, and the
joined Latin and Armenian letters. Raised and lowered digits, circled letters, fractions
and full-width punctuation look different and stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

#: Letters of one shape, Cyrillic and Greek against Latin, in the same order.
CYRILLIC = "АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTXYaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιυ"
GREEK_AS = "ABEZHIKMNOPTYXoviu"

#: Ranges of characters without a visible shape.
INVISIBLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0x1D173, 0x1D17A), (0xE0000, 0xE01EF),
)


def _class(ranges) -> str:
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges)


INVISIBLE_CLASS = _class(INVISIBLE_RANGES)


@lru_cache(1)
def compatibility() -> dict[str, str]:
    """Characters and what they read as; values of more than one character are joined letters."""
    out = {}
    for n in range(0xA0, sys.maxunicode):
        c = chr(n)
        kind = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif kind.startswith(("<wide>", "<narrow>", "<font>")):
            to = unicodedata.normalize("NFKC", c)
            if to.isalnum() or n in range(0xFF61, 0xFFA0):
                out[c] = to
        elif 0xFB00 <= n <= 0xFB17 and kind:
            out[c] = unicodedata.normalize("NFKC", c)
        elif kind.startswith("<compat>") and (0x1C4 <= n <= 0x1F3 or n in (0x132, 0x133, 0x149)):
            out[c] = unicodedata.normalize("NFKC", c)
    return out


@lru_cache(1)
def composed_class() -> str:
    """A character class of the letters that NFC changes by themselves, such as the Kelvin sign."""
    changed = [n for n in range(0x80, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000 and unicodedata.normalize("NFC", chr(n)) != chr(n)]
    ranges: list[list[int]] = []
    for n in changed:
        if ranges and n == ranges[-1][1] + 1:
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


@lru_cache(1)
def tables() -> dict[str, object]:
    singles = {c: t for c, t in compatibility().items() if len(t) == 1}
    joined = {c: t for c, t in compatibility().items() if len(t) > 1}
    return {"from": "".join(singles), "to": "".join(singles.values()), "joined": joined}


@lru_cache(1)
def _skeleton_table() -> dict[str, str]:
    return dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True))


@lru_cache(1)
def _special() -> tuple[re.Pattern, dict[str, str]]:
    """A short character class around all characters concerned, and what each of them becomes."""
    table = dict(compatibility()) | {chr(n): "" for a, b in INVISIBLE_RANGES for n in range(a, b + 1)}
    ranges: list[list[int]] = []
    for n in sorted(map(ord, table)):
        if ranges and n - ranges[-1][1] <= (8 if n < 0x2E80 else 160):
            ranges[-1][1] = n
        else:
            ranges.append([n, n])
    return re.compile(f"[{_class(ranges)}]"), table


_LOOKALIKE = re.compile(f"[{CYRILLIC}{GREEK}]")


def fold(text: str) -> str:
    """Compatibility forms, spaces, invisible characters and separate accents in one form.

    Only the characters concerned are looked up one by one; the rest is scanned by the regular
    expression, which is much faster than a translation of the whole text.
    """
    if text.isascii():
        return text
    special, table = _special()
    return unicodedata.normalize("NFC", special.sub(lambda m: table.get(m[0], m[0]), text))


def skeleton(folded: str) -> str:
    """Every look-alike as its Latin letter; for comparisons only."""
    if folded.isascii():
        return folded
    table = _skeleton_table()
    return _LOOKALIKE.sub(lambda m: table[m[0]], folded)


_CAPITALS = re.compile("[вкмнт]")
_CAPITALS_AS = dict(zip("вкмнт", "bkmht", strict=True))


def match_form(text: str) -> str:
    """Folded, in lower case and with every look-alike (also of capitals) as its Latin letter.

    For matching wording against patterns in the same form, never for output.
    """
    return match_folded(fold(text))


def match_folded(folded: str) -> str:
    """:func:`match_form` of a folded text."""
    low = folded.lower()
    if low.isascii():
        return low
    return _CAPITALS.sub(lambda m: _CAPITALS_AS[m[0]], skeleton(low))


def pattern_form(pattern: str) -> str:
    """A regular expression in lower case, for texts in :func:`match_form`; its escapes stay as they are."""
    return _CAPITALS.sub(lambda m: _CAPITALS_AS[m[0]], skeleton(pattern))
