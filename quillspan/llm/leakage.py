"""Problem 6: evaluation texts that leaked into the corpus.

Method: one Aho-Corasick automaton over the normalised test questions (and answers), with
which every text is scanned once; offsets are mapped back to the original text.

The automaton holds each item's blocks of ``MIN_WORDS // 2`` words that begin at multiples
of that number: any ``MIN_WORDS`` consecutive words of an item hold at least one such block,
so a block's occurrence, extended word by word to both sides, finds every passage and no other.
That keeps the automaton small (4,000 patterns for 400 items). It is built once a Python worker.

Defined results
---------------
* words are runs of letters and digits after folding (``folding.fold``), case folding, and
  reading look-alikes, also those of capitals, as Latin; tags, link targets, character references, emphasis and
  punctuation are no words. Numbers that only number a line ("3. ") may stand between words or not.
* null or empty texts, and items of fewer than ``MIN_WORDS`` words, match nothing.
* offsets are of the text as stored, also where line numbers are left out (they are blanked in place).
* an item that occurs several times in a document is one row, with the longest passage;
  items that share a passage each get a row.
* a repeated ``doc_id`` or ``item_id`` is one row a pair; extra columns are ignored.
* more items than fit ``MAX_BLOCK_CHARS`` are taken in blocks, each against all documents.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.folding import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, INVISIBLE_CLASS, fold, skeleton
from quillspan.plans.tables import spread, table

MIN_WORDS = 12
MAX_BLOCK_CHARS = 20_000_000
_INLINE = "a|abbr|b|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|<![A-Za-z][^<>]*>", re.S)
_TARGET = re.compile(r"\]\([^()\s]*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)")
_NO_WORD = re.compile(r"[\W_]+")
#: Small letters whose capitals alone look Latin, so that a capital reads as its look-alike in either case.
CAPITALS = {
    ord(c.casefold()): a.lower()
    for c, a in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)
    if c.isupper() and c.casefold() not in CYRILLIC + GREEK
}
_WITH_NU = re.compile(r"[^\W_]*\u039d[^\W_]*")
#: A word with Latin letters, or of look-alike capitals only.
_LATIN_READ = re.compile(rf"[A-Za-z]|^[{''.join(c for c in CYRILLIC + GREEK if c.isupper())}]+$")
_LINE_NUMBER = re.compile(r"(?m)^([ \t>*+#|-]*)\d{1,4}[.)](?=[ \t])")
_RAW_WORD = re.compile(
    rf"(?:[^\W_]|[\u0300-\u036f\u3099\u309a{INVISIBLE_CLASS}]|&(?:#\w+|\w+);|</?(?:{_INLINE})(?:\s[^<>]*)?/?>)+", re.I
)

SCHEMA = "doc_id bigint, item_id bigint, n_words int, start int, stop int, has_answer boolean"


def normalised(text: str) -> str:
    """The words of a text in one form, with one space before, between and after them."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "](" in text:
        text = _TARGET.sub("]", text)
    if "&" in text:
        text = _html.unescape(text)
    text = fold(text)
    if not text.isascii():
        if "\u039d" in text:  # Greek capital Nu reads as N, the small one as v
            text = _WITH_NU.sub(lambda m: skeleton(m[0]) if _LATIN_READ.search(m[0]) else m[0], text)
        text = skeleton(text.casefold()).translate(CAPITALS)
    text = text.casefold()
    return " " + _NO_WORD.sub(" ", text).strip() + " "


def _original_spans(text: str, words: list[str]) -> list[tuple[int, int]] | None:
    """Where each word stands in the text as stored; None if the two can't be brought together."""
    # what is no word is blanked in place, so that places stay
    kept = _TAG.sub(lambda m: m[0] if _INLINE_TAG.fullmatch(m[0]) else " " * len(m[0]), text) if "<" in text else text
    kept = _TARGET.sub(lambda m: "]" + " " * (len(m[0]) - 1), kept) if "](" in kept else kept
    spans = []
    for m in _RAW_WORD.finditer(kept):
        for _ in normalised(m[0]).split():
            spans.append((m.start(), m.end()))
    return spans if len(spans) == len(words) else None


@lru_cache(4)
def _automaton(items: tuple[tuple[int, tuple[str, ...], str], ...], min_words: int):
    import ahocorasick

    step = min_words // 2
    places: dict[str, list[tuple[int, int]]] = {}
    for n, (_, words, answer) in enumerate(items):
        for at in range(0, len(words) - step + 1, step):
            places.setdefault(" " + " ".join(words[at : at + step]) + " ", []).append((n, at))
        if answer.strip():
            places.setdefault(answer, []).append((n, -1))
    machine = ahocorasick.Automaton()
    for pattern, where in places.items():
        machine.add_word(pattern, (len(pattern), tuple(where)))
    if places:
        machine.make_automaton()
    return machine if places else None


def _passages(norms: list[str], items, machine, min_words: int) -> list[dict[int, tuple[int, int, bool]]]:
    """For each form of a text, scanned together: of each leaked item the first and the last word (exclusive) of its
    longest passage, and whether its answer stands in the text."""
    hits: list[list[tuple[int, int, int]]] = [[] for _ in norms]
    answers: list[set[int]] = [set() for _ in norms]
    k, begins = 0, 0
    for end, (length, where) in machine.iter("\n".join(norms)):  # no pattern holds a newline
        while end > begins + len(norms[k]):
            begins += len(norms[k]) + 1
            k += 1
        for n, at in where:
            if at < 0:
                answers[k].add(n)
            else:
                hits[k].append((end - length + 1 - begins, n, at))
    return [_extended(norm, h, a, items, min_words) for norm, h, a in zip(norms, hits, answers, strict=True)]


def _extended(norm: str, hits: list[tuple[int, int, int]], answers: set[int], items, min_words: int) -> dict[int, tuple[int, int, bool]]:
    if not hits:
        return {}
    words = norm.split()
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    found: dict[int, tuple[int, int]] = {}
    seen: dict[tuple[int, int], int] = {}
    for pos, n, at in hits:
        i = bisect.bisect_left(starts, pos)
        own = items[n][1]
        if seen.get((n, i - at), -1) > i:  # a passage already followed to its end
            continue
        a, b = i, at
        while a and b and words[a - 1] == own[b - 1]:
            a, b = a - 1, b - 1
        c, d = i, at
        while c < len(words) and d < len(own) and words[c] == own[d]:
            c, d = c + 1, d + 1
        seen[n, i - at] = c
        if c - a >= min_words and c - a > found.get(n, (0, 0))[1] - found.get(n, (0, 0))[0]:
            found[n] = (a, c)
    return {n: (a, c, n in answers) for n, (a, c) in found.items()}


def _scan(items, min_words: int, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(items, min_words)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or machine is None:
                    continue
                forms = [text]
                # numbers of lines are optional words: the text with blanks in their places goes along in the same scan
                if (bare := _LINE_NUMBER.sub(lambda m: m[1] + " " * (len(m[0]) - len(m[1])), text)) != text:
                    forms.append(bare)
                norms = [normalised(x) for x in forms]
                best: dict[int, tuple[int, int, int, int, bool]] = {}
                for k, found in enumerate(_passages(norms, items, machine, min_words)):
                    spans = _original_spans(forms[k], norms[k].split()) if found else None
                    for n, (a, c, answer) in found.items():
                        at = (spans[a][0], spans[c - 1][1]) if spans else (None, None)
                        if n not in best or c - a > best[n][0]:
                            best[n] = (c - a, *at, answer or (n in best and best[n][3]))
                rows += [(doc, items[n][0], *x) for n, x in best.items()]
            names = [id_name, "item_id", "n_words", "start", "stop", "has_answer"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return run


def _blocks(items: DataFrame, max_chars: int) -> Iterator[tuple]:
    """The items, normalised, in blocks of about ``max_chars`` characters; one block unless there are more."""
    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(
        F.min(F.struct("text", "answer")).alias("x")
    )
    chars = usable.agg(F.sum(F.length("x.text") + F.coalesce(F.length("x.answer"), F.lit(0)))).first()[0] or 0
    n = -(-chars // max_chars) or 1
    for k in range(n):
        part = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).select("item_id", "x.text", "x.answer")
        yield tuple(
            (r.item_id, tuple(normalised(r.text).split()), normalised(r.answer or ""))
            for r in sorted(part.collect(), key=lambda r: r.item_id)
        )


def leaked_passages(
    documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_block_chars: int = MAX_BLOCK_CHARS
) -> DataFrame:
    """``(doc_id, item_id, n_words, start, stop, has_answer)``: the longest passage of each leaked item in each document.

    ``start`` and ``stop`` are offsets in ``text`` as stored,
    ``has_answer`` tells whether the item's answer stands in the document too.
    """
    texts = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))
    parts = [texts.mapInArrow(_scan(block, min_words, "doc_id"), SCHEMA) for block in _blocks(items, max_block_chars)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return (
        out.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_words", "start", "stop", "has_answer")).alias("x"))
        .select("doc_id", "item_id", "x.*")
    )


def p6_found(spark, sf_dir: str) -> DataFrame:
    return p6_passages(spark, sf_dir).select("doc_id", "item_id")


def p6_passages(spark, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark, sf_dir: str) -> DataFrame:
    """The report by test item: documents it leaked into, the longest passage, documents with its answer too."""
    found = p6_passages(spark, sf_dir)
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    return items.join(
        found.groupBy("item_id").agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.max("n_words").alias("longest"),
            F.count_if("has_answer").alias("n_with_answer"),
        ),
        "item_id",
    )


QUERIES = {"p6_found": p6_found, "p6_passages": p6_passages, "p6_items": p6_items}
ORACLE: dict[str, str] = {}
