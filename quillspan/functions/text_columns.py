"""Context-free text rules as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9_ \t-]", "")
    return F.regexp_replace(F.regexp_replace(s, r"[ \t-]+", "-"), "-+$", "")


def toc_anchor(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "-")


def word_tokens(text: Column) -> Column:
    """Words, and each of ten marks as one of its own."""
    return F.regexp_count(text, F.lit(r"[\[\]()#*|!:-]|[^ \n\t\r\[\]()#*|!:-]+"))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\f\r]+", " ")


def escape_inline(text: Column) -> Column:
    """The escapes of Markdown that need no context."""
    return F.regexp_replace(text, r"([\\*_~`\[])", r"\\$1")


def strict_u32(text: Column) -> Column:
    s = F.regexp_extract(text, r"^[ \t\n\f\r]*\+?([0-9]+)[ \t\n\f\r]*$", 1)
    n = F.when((s != "") & (F.length(F.regexp_replace(s, "^0+", "")) <= 10), s).cast("bigint")
    return F.when(n <= 4294967295, n)


def yaml_quoted(text: Column) -> Column:
    needs = text.rlike(r"[\n:# ]")
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(needs, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text)


#: Fixed value: a block of metadata at the beginning of a Markdown text, with the line that ends it.
FRONT_BLOCK = r"(?s)^---[^\n]*\n.*?\n---[^\n]*\n?"


def frontmatter_map(text: Column) -> Column:
    """The ``key: value`` lines of a leading block; the last of a key holds. Null without a block."""
    block = F.regexp_extract(text, r"(?s)^---[^\n]*\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike("^[^:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.when(text.rlike(r"(?s)^---[^\n]*\n.*?\n---"), F.map_from_entries(last))


def body_without_title(text: Column, title: Column) -> Column:
    """A body whose first line only repeats the title, without it."""
    body = F.regexp_replace(text, FRONT_BLOCK, "")
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    first = F.split(trimmed, "\n")[0]
    rest = F.regexp_replace(F.regexp_replace(trimmed, r"^[^\n]*\n?", ""), r"^\s+", "")
    return F.when((first == title) | (first == F.concat(F.lit("# "), title)), rest).otherwise(body)
