"""Problem 2: visually identical text with different characters.

Method: DuckDB runs inside each Arrow partition over embedded SQL (``translate`` for
compatibility forms and spaces, regular expressions for invisible characters and mixed
words, ``nfc_normalize`` for accents). Python only resolves the character references of
html before. Expensive functions run for the rows whose text needs them.

Two results per text:

* the *form*: the text to keep. Only words that mix scripts get their look-alikes replaced,
  by the script of their unambiguous letters, so that Russian or Greek words stay as they are;
  in html the references of ``< > & "`` stay references, so that markup stays markup.
* the *key*: the form with every look-alike as its Latin letter and those references resolved;
  equal keys mean that the texts read the same.

Defined results
---------------
* null stays null, empty stays empty, and neither ever makes a pair; nor does a text that
  consists of invisible characters only.
* equal strings make no pair; repeated rows (one ``page_id`` twice) count once per string.
* letter case, missing accents, raised digits, punctuation and the number of spaces tell texts apart.
* very long texts are handled in Arrow batches of bounded rows; empty tables give empty results.
* extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import folding
from quillspan.plans.tables import materialize, spread, table

BATCH_CHARS = 24_000_000
_MARKUP = {"<": "&lt;", ">": "&gt;", "&": "&amp;", '"': "&quot;"}
_REFERENCE = re.compile(r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});?")


def _resolve_one(m: re.Match) -> str:
    to = _html.unescape(m[0])
    return "".join(_MARKUP.get(c, c) for c in to) if to != m[0] else to


def resolve_references(text: str | None) -> str | None:
    """Character references as characters, but for those of markup, which come out in one spelling."""
    return _REFERENCE.sub(_resolve_one, text) if text and "&" in text else text


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(column: str = "text") -> str:
    """The embedded SQL: from a relation ``t(id, text)`` to ``(id, form, key)``."""
    t = folding.tables()
    cyr, gre = folding.CYRILLIC, folding.GREEK
    compat_class = "[" + re.sub(r"([\]\\^-])", r"\\\1", "".join(t["from"])) + "]"
    steps = f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7f]') THEN {column} END"
    joined = "m"
    for c, to in t["joined"].items():
        joined = f"replace({joined}, {_quoted(c)}, {_quoted(to)})"
    joined_class = "".join(t["joined"])
    combining = f"[\\p{{M}}\\x{{1100}}-\\x{{11ff}}{folding.composed_class()}]"
    own_cyr = "[\\x{0400}-\\x{052f}]"
    # a word that has letters of Latin and of another script
    mixed = "[\\p{L}\\p{M}\\p{Nd}]*(?:[A-Za-z\\x{00c0}-\\x{024f}][\\p{M}\\p{Nd}]*[\\x{0370}-\\x{052f}]|[\\x{0370}-\\x{052f}][\\p{M}\\p{Nd}]*[A-Za-z\\x{00c0}-\\x{024f}]|[\\x{0370}-\\x{03ff}][\\p{M}\\p{Nd}]*[\\x{0400}-\\x{052f}]|[\\x{0400}-\\x{052f}][\\p{M}\\p{Nd}]*[\\x{0370}-\\x{03ff}])[\\p{L}\\p{M}\\p{Nd}]*"
    latin_alike = folding.CYRILLIC_AS
    # the letters that only one script has decide; then Latin
    word = (
        f"CASE WHEN regexp_matches(translate(w, {_quoted(cyr)}, ''), {_quoted(own_cyr)})"
        f" AND NOT regexp_matches(translate(w, {_quoted(latin_alike)}, ''), '[A-Za-z]')"
        f" THEN translate(translate(w, {_quoted(folding.GREEK)}, {_quoted(folding.GREEK_AS)}), {_quoted(latin_alike)}, {_quoted(cyr)})"
        f" WHEN regexp_matches(translate(w, {_quoted(gre)}, ''), '[\\x{{0370}}-\\x{{03ff}}]')"
        f" AND NOT regexp_matches(translate(w, {_quoted(folding.GREEK_AS)}, ''), '[A-Za-z]')"
        f" THEN translate(w, {_quoted(folding.GREEK_AS)}, {_quoted(gre)})"
        f" ELSE translate(w, {_quoted(cyr + gre)}, {_quoted(folding.CYRILLIC_AS + folding.GREEK_AS)}) END"
    )
    return f"""
WITH a AS (SELECT id, {column} AS raw, {steps} AS x FROM t),
b AS (SELECT id, raw, CASE WHEN regexp_matches(x, {_quoted(compat_class)}) THEN translate(x, {_quoted(t["from"])}, {_quoted(t["to"])}) ELSE x END AS m FROM a),
c AS (SELECT id, raw, CASE WHEN regexp_matches(m, '[{joined_class}]') THEN {joined} ELSE m END AS m FROM b),
d AS (SELECT id, raw, regexp_replace(m, '[{folding.INVISIBLE_CLASS}]+', '', 'g') AS m FROM c),
e AS (SELECT id, raw, CASE WHEN regexp_matches(m, {_quoted(combining)}) THEN nfc_normalize(m) ELSE m END AS m FROM d),
f AS (SELECT id, raw, m, CASE WHEN regexp_matches(m, '[\\x{{0370}}-\\x{{052f}}]') THEN list_sort(list_distinct(regexp_extract_all(m, {_quoted(mixed)})), 'DESC') END AS words FROM e),
g AS (SELECT id, coalesce(CASE WHEN len(words) > 0 THEN list_reduce(list_prepend(m, words), lambda acc, w: replace(acc, w, {word})) ELSE m END, raw) AS form FROM f)
SELECT id, form, CASE WHEN regexp_matches(form, '[\\x{{0370}}-\\x{{052f}}]')
  THEN translate(form, {_quoted(cyr + gre)}, {_quoted(folding.CYRILLIC_AS + folding.GREEK_AS)}) ELSE form END AS key
FROM g"""


_RESOLVED_KEY = "replace(replace(replace(replace(key, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


def _run_sql(con, texts: list[str | None], resolved: bool, digests: bool) -> pa.Table:
    con.register("t", pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    key = _RESOLVED_KEY if resolved else "key"
    last = f"md5({key}) AS k, (length(trim(key)) = 0) AS blank" if digests else "form"
    out = con.sql(f"SELECT id, {last} FROM ({form_sql()}) ORDER BY id").to_arrow_table()
    con.unregister("t")
    return out


def _connection():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '400MB'")
    return con


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most BATCH_CHARS bytes of text; a longer row is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    con = _connection()
    for whole in batches:
        for batch in _slices(whole, "html"):
            ids = batch.column("page_id")
            for name in ("title", "html"):
                raw = batch.column(name).to_pylist()
                texts = [resolve_references(x) for x in raw] if name == "html" else raw
                out = _run_sql(con, texts, name == "html", True)
                blanks = out.column("blank").to_pylist()
                keep = pa.array([i for i, (x, blank) in enumerate(zip(raw, blanks, strict=True)) if x and not blank], pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": ids.take(keep),
                        "field_name": pa.array([name] * len(keep), pa.string()),
                        "key": out.column("k").combine_chunks().take(keep),
                        "raw": pa.array([hashlib.md5(raw[i].encode("utf-8", "surrogatepass")).hexdigest() for i in keep.to_pylist()], pa.string()),
                    }
                )


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connection()
    for whole in batches:
        for batch in _slices(whole, "html"):
            html = [resolve_references(x) for x in batch.column("html").to_pylist()]
            titles = batch.column("title").to_pylist()
            forms = {
                "title": _run_sql(con, titles, False, False).column("form").combine_chunks(),
                "html": _run_sql(con, html, True, False).column("form").combine_chunks(),
            }
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id")} | forms)


def text_keys(pages: DataFrame) -> DataFrame:
    """``(page_id, field_name, key, raw)``: digests of the key and of the string as stored."""
    return spread(pages.select("page_id", "title", "html")).mapInArrow(
        _keys, "page_id bigint, field_name string, key string, raw string"
    )


def one_form(pages: DataFrame) -> DataFrame:
    """``(page_id, title, html)`` in one consistent form."""
    return spread(pages.select("page_id", "title", "html")).mapInArrow(_forms, "page_id bigint, title string, html string")


def reading_classes(keys: DataFrame) -> DataFrame:
    """Every non-empty text once: ``(page_id, field_name, class_id, n_pages, n_texts)``.

    Equal ``class_id`` (the digest of the key): the texts read the same; ``n_pages`` pages hold it, in ``n_texts``
    different spellings. Nothing is expanded into pairs: the counts combine on the map side, and a class of any size
    is as many rows as it has pages.
    """
    spelled = keys.groupBy("field_name", "key", "raw").agg(F.count_distinct("page_id").alias("n"))
    classes = spelled.groupBy("field_name", "key").agg(F.sum("n").alias("n_pages"), F.count(F.lit(1)).alias("n_texts"))
    return keys.where("page_id IS NOT NULL").select("page_id", "field_name", "key").dropDuplicates().join(classes, ["field_name", "key"]).select(
        "page_id", "field_name", F.col("key").alias("class_id"), "n_pages", "n_texts"
    )


def same_reading_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of pages that read the same but aren't stored the same.

    Copies of one string are no pairs and drop out before the join: only keys with more
    than one string take part, found by an aggregate that combines on the map side.
    """
    several = (
        keys.groupBy("field_name", "key")
        .agg(F.min("raw").alias("least"), F.max("raw").alias("most"))
        .where("least <> most")
        .select("field_name", "key")
    )
    kept = keys.where("page_id IS NOT NULL").join(several, ["field_name", "key"], "left_semi").dropDuplicates()
    a = kept.select("field_name", "key", F.col("page_id").alias("page_a"), F.col("raw").alias("raw_a"))
    b = kept.select("field_name", "key", F.col("page_id").alias("page_b"), F.col("raw").alias("raw_b"))
    return (
        a.join(b, ["field_name", "key"])
        .where("page_a < page_b AND raw_a <> raw_b")
        .select("page_a", "page_b", "field_name")
    )


def p2_found(spark, sf_dir: str) -> DataFrame:
    return same_reading_pairs(materialize(text_keys(table(spark, sf_dir, "pages")), "text_keys"))


def p2_one_form(spark, sf_dir: str) -> DataFrame:
    """Every title and html in one form."""
    return one_form(table(spark, sf_dir, "pages"))


def p2_classes(spark, sf_dir: str) -> DataFrame:
    """Of each title and html the class of texts that read the same."""
    return reading_classes(materialize(text_keys(table(spark, sf_dir, "pages")), "text_keys"))


QUERIES = {"p2_found": p2_found, "p2_one_form": p2_one_form, "p2_classes": p2_classes}
ORACLE: dict[str, str] = {}
