"""Problem 4: page boilerplate mixed with main content.

Method: composite text density (``page_text``) over the DOM of each page selects the subtree
that holds the article. The page's Markdown chunks are matched to it line by line through keys
of letters and digits; lines that stand outside the subtree, or are page furniture by their
wording inside it (bylines, notes on the version, promotions), are not main text. A wrapped
paragraph is matched as a whole; a part of one that a chunk's end cuts off matches nothing and,
unless its wording says otherwise, is main text.

Only keys (8 bytes a line) and flags are shuffled, once, by page.

Defined results
---------------
* blank lines are never returned; rows of tables' rules and code fences belong to what they enclose.
* pages served as Markdown (``html`` null or empty) have no DOM: there only the wording decides.
* chunks of unknown or null pages, and chunks without content, give no rows.
* a chunk delivered twice gives its rows once; extra columns are ignored.
* unclosed html is closed as a browser would; html without text gives no main text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillspan.llm.furniture import is_furniture
from quillspan.llm.page_text import Page, line_key
from quillspan.plans.tables import spread, table

_TARGET = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_MARKED = re.compile(r"\s*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|>|\||```)")
BLANK, TEXT, FURNITURE, RULE, CODE = range(5)


def _signed(key: str) -> int:
    n = xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >= 1 << 63 else n


def _page_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, mains, rests = [], [], []
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(page_id)
            if not html or not html.strip():
                mains.append(None)
                rests.append(None)
                continue
            page = Page(html)
            inside = page.main()
            main, rest = set(), set()
            for text, at, _, _ in page.blocks:
                if key := line_key(text):
                    (main if at in inside else rest).add(_signed(key))
            mains.append(sorted(main))
            rests.append(sorted(rest - main))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(mains, longs), pa.array(rests, longs)], ["page_id", "main", "rest"]
        )


def chunk_lines(content: str) -> tuple[list[int | None], list[int | None], list[int]]:
    """For each line of Markdown: its key, the key of the paragraph it is wrapped in, and a flag.

    A paragraph is a run of lines without a blank one; headings, rows, fences and the first lines
    of list items begin a new one, lines of a quote stay together.
    """
    keys: list[int | None] = []
    wholes: list[int | None] = []
    flags: list[int] = []
    group: list[int] = []
    texts: list[str] = []
    quoted = fenced = False

    def close() -> None:
        if not group:
            return
        whole = " ".join(texts)
        furniture = is_furniture(whole) and not marked
        key = _signed(line_key(whole)) if len(group) > 1 else None
        for i in group:
            wholes[i] = key
            if furniture:
                flags[i] = FURNITURE
        group.clear()
        texts.clear()

    marked = False
    for i, line in enumerate(content.split("\n")):
        keys.append(None)
        wholes.append(None)
        stripped = line.strip()
        if not stripped:
            close()
            flags.append(BLANK)
            continue
        if stripped.startswith("```") or fenced:
            fenced = fenced != stripped.startswith("```")
            close()
            flags.append(CODE)
            continue
        text = _TARGET.sub("]", stripped) if "](" in stripped else stripped
        m = _MARKED.match(text)
        is_quote = text.startswith(">")
        if m and not (is_quote and quoted and group):
            close()
        elif quoted and not is_quote:
            close()
        if not group:
            marked = m is not None
        quoted = is_quote
        if m and m[0].strip()[:1].isdigit():
            text = text[m.end() :]
        key = line_key(text)
        flags.append(TEXT if key else RULE)
        if key:
            keys[i] = _signed(key)
            group.append(i)
            texts.append(text)
        if text.startswith(("#", "|")):
            close()
    close()
    return keys, wholes, flags


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [chunk_lines(content) for content in batch.column(2).to_pylist()]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([c[0] for c in columns], longs),
                pa.array([c[1] for c in columns], longs),
                pa.array([c[2] for c in columns], pa.list_(pa.int8())),
            ],
            ["chunk_id", "page_id", "keys", "wholes", "flags"],
        )


def page_main_keys(pages: DataFrame) -> DataFrame:
    """``(page_id, main, rest)``: the keys of the lines in the main text and of those only outside; null without html."""
    return spread(pages.where("page_id IS NOT NULL").select("page_id", "html")).mapInArrow(
        _page_keys, "page_id bigint, main array<bigint>, rest array<bigint>"
    )


def boilerplate_lines(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``(chunk_id, lines)``: for each chunk that has any, the numbers of the lines that aren't main text."""
    given = chunks.where("chunk_id IS NOT NULL AND page_id IS NOT NULL AND content IS NOT NULL")
    lines = spread(given.select("chunk_id", "page_id", "content")).mapInArrow(
        _chunk_keys, "chunk_id bigint, page_id bigint, keys array<bigint>, wholes array<bigint>, flags array<tinyint>"
    )
    judged = F.expr(
        f"""transform(flags, (f, i) -> CASE
            WHEN f = {FURNITURE} THEN i + 1
            WHEN f = {TEXT} AND rest IS NOT NULL AND (array_contains(rest, keys[i])
              OR (wholes[i] IS NOT NULL AND array_contains(rest, wholes[i]))) THEN i + 1 END)"""
    )
    return (
        lines.join(page_main_keys(pages), "page_id")
        .select("chunk_id", F.array_compact(judged).alias("lines"))
        .where(F.size("lines") > 0)
        .dropDuplicates(["chunk_id"])
    )


def keep_main_text(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunks, each once, with only the lines of the main text in ``content``; other columns stay."""
    found = boilerplate_lines(chunks, pages).select(F.col("chunk_id").alias("__id"), F.col("lines").alias("__at"))
    once = chunks.dropDuplicates(["chunk_id"])
    kept = F.filter(F.split("content", "\n"), lambda _, i: ~F.array_contains("__at", i + 1))
    return (
        once.join(found, once["chunk_id"] == found["__id"], "left")
        .withColumn("content", F.when(F.col("__at").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")))
        .drop("__id", "__at")
    )


def p4_found(spark, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "pages")).select(
        "chunk_id", F.explode("lines").alias("line_no")
    )


def p4_main_text(spark, sf_dir: str) -> DataFrame:
    """Every chunk with the lines of the main text only."""
    out = keep_main_text(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "pages"))
    return out.select("chunk_id", "page_id", "chunk_no", "content")


QUERIES = {"p4_found": p4_found, "p4_main_text": p4_main_text}
ORACLE: dict[str, str] = {}
