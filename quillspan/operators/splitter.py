"""Markdown into chunks for retrieval, with headings and line numbers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"\s*(?:>\s*)*(`{3,}|~{3,})[ \t]*([^\s`]*)")
_RULE = re.compile(r"(?:-{3,}|\*{3,}|_{3,})\s*$")


@dataclass(frozen=True)
class Split:
    levels: tuple[int, ...] = (2, 3, 4, 5, 6)
    each_line: bool = False
    strip_headers: bool = True
    size: int = 1000
    overlap: int = 200
    length: Callable[[str], int] = len

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("the overlap must be smaller than the chunk size")
        if any(x not in range(1, 7) for x in self.levels):
            raise ValueError("heading levels are 1 to 6")


Chunk = tuple[int, str, dict[str, str], str | None, int, int]


def _fences(md: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of fenced code."""
    out, pos, mark, start, language = [], 0, "", 0, ""
    for line in md.split("\n"):
        m = _FENCE.match(line)
        if m and not mark:
            mark, start, language = m[1], pos, m[2]
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2]:
            out.append((start, pos + len(line), language))
            mark = ""
        pos += len(line) + 1
    if mark:
        out.append((start, len(md), language))
    return out


def sections(md: str, levels: tuple[int, ...]) -> list[tuple[int, int, dict[str, str]]]:
    """(start, end, headings): cut at a split level that was seen before, and at every rule."""
    fences = _fences(md)
    out: list[tuple[int, int, dict[str, str]]] = []
    start, pos, f = 0, 0, 0
    seen: set[int] = set()
    headings: dict[str, str] = {}
    for line in md.split("\n"):
        while f < len(fences) and fences[f][1] < pos:
            f += 1
        inside = f < len(fences) and fences[f][0] <= pos <= fences[f][1]
        m = None if inside else _HEADING.match(line)
        if m:
            level = len(m[1])
            if level in levels:
                if level in seen and pos > start:
                    out.append((start, pos, dict(headings)))
                    start = pos
                    seen = {x for x in seen if x <= level}
                seen.add(level)
            for deeper in range(level, 7):
                headings.pop(f"h{deeper}", None)
            headings[f"h{level}"] = m[2]
        elif not inside and _RULE.match(line) and pos > start:
            out.append((start, pos, dict(headings)))
            start = pos + len(line) + 1
        pos += len(line) + 1
    if start < len(md):
        out.append((start, len(md), dict(headings)))
    return out


def _cut(text: str, fences: list[tuple[int, int]], o: Split) -> list[tuple[int, int]]:
    """Parts of at most the chunk size, cut at the best separator, never inside a fence."""
    parts, at = [], 0
    while at < len(text):
        if o.length(text[at:]) <= o.size:
            parts.append((at, len(text)))
            break
        if o.length is len:
            limit = at + o.size
        else:
            low, high = at + 1, len(text)
            while low < high:
                middle = (low + high + 1) // 2
                if o.length(text[at:middle]) <= o.size:
                    low = middle
                else:
                    high = middle - 1
            limit = low
        end = -1
        for separator in ("\n\n", "```\n", "\n", " "):
            k = text.rfind(separator, at + 1, limit)
            while k > at and any(a < k < b for a, b in fences):
                k = text.rfind(separator, at + 1, k)
            if k > at:
                end = k + (len(separator) if separator == "```\n" else 0)
                break
        if end < 0:  # a word or a fence longer than the limit stays whole
            inside = next((b for a, b in fences if a < limit < b), None)
            m = re.compile(r"\s").search(text, limit)
            end = inside if inside is not None else m.start() if m else len(text)
        parts.append((at, end))
        following = end
        while following < len(text) and text[following] in " \n":
            following += 1
        if o.overlap and following < len(text):
            back = max(at + 1, end - o.overlap)
            m = re.compile(r"\s\S").search(text, back, end)
            if m and not any(a < m.start() + 1 < b for a, b in fences):
                following = m.start() + 1
        at = following
    return parts


def split_markdown(md: str | None, o: Split = Split()) -> list[Chunk]:
    """``(chunk_no, content, headers, code, line_from, line_to)``; a front block of metadata is no content."""
    if not md or not md.strip():
        return []
    offset = 0
    if m := re.match(r"---\n.*?\n---(?:\n|$)", md, re.S):
        offset = m.end()
    body = md[offset:]
    fences = _fences(body)
    out: list[Chunk] = []
    breaks = [m.start() for m in re.finditer("\n", md)]
    for start, end, headings in sections(body, o.levels):
        own = [(a - start, b - start) for a, b, _ in fences if start <= a < end]
        for a, b in _cut(body[start:end], own, o):
            text = body[start + a : start + b]
            first = bisect_left(breaks, offset + start + a + len(text) - len(text.lstrip("\n"))) + 1
            if o.strip_headers:
                kept, fenced = [], False
                for line in text.split("\n"):
                    fenced = fenced != bool(_FENCE.match(line))
                    if fenced or not re.match(r"#{1,6}\s", line):
                        kept.append(line)
                shown = "\n".join(kept).strip("\n").rstrip()
            else:
                shown = text.strip("\n").rstrip()
            if not shown.strip():
                continue
            last = bisect_left(breaks, offset + start + a + len(text.rstrip("\n"))) + 1
            code = next((lang for x, _, lang in fences if start + a <= x < start + b and lang), None)
            if o.each_line:
                for line in shown.split("\n"):
                    if line.strip():
                        out.append((len(out), line, headings, code, first, last))
            else:
                out.append((len(out), shown, headings, code, first, last))
    return out
