"""Problem 8: per-document text quality statistics.

The statistics are native column expressions over whole texts. Natural prose is told from
lists, tables, code and junk by an ordered rule list, induced by incremental reduced-error
pruning (``rule_induction``) on labelled documents and applied as a SQL CASE expression.
``python -m quillspan.llm.quality DIR`` induces the rules anew from at most ``LABELLED``
documents; the labels come from :func:`prose_share`, which reads a text line by line the way
a person would label it and is far too slow for the corpus.

Defined results
---------------
* null and blank texts: no words, all shares 0, not prose. Null ``doc_id`` rows keep their row.
* repeated rows come out as often as they come in; extra columns are ignored.
* shares are of visible characters (symbols, digits), of non-blank lines, or of words.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.rule_induction import case_sql
from quillspan.plans.tables import table

LABELLED = 6000
MAX_COMMON_WORDS = 20_000

#: The full-width forms of the printable ASCII characters and these characters.
_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_NARROW = "".join(chr(0x21 + k) for k in range(94))
_HIDDEN = r"[­​-‏⁠﻿]+"
_END = r"[.!?:;。！？：；…\"”»’')\]*_`>]"

FEATURES = (
    "words", "mean_word_length", "symbol_share", "digit_share", "punct_line_share", "common_share",
    "marked_line_share", "words_per_line", "kana_share", "separators_per_word", "commas_per_word",
)


def with_statistics(documents: DataFrame, common: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the columns of FEATURES. ``common`` is ``(lang, word)``, of bounded size."""
    words = [r[0] for r in common.where("word IS NOT NULL AND lang IS NOT NULL AND lang <> 'ja'").select(F.lower("word")).distinct().orderBy(F.lower("word")).limit(MAX_COMMON_WORDS + 1).collect()]
    if len(words) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    raw = F.coalesce(F.col(text), F.lit(""))
    plain = F.when(raw.rlike("[！-～]"), F.translate(raw, _WIDE, _NARROW)).otherwise(raw)
    plain = F.when(plain.rlike(_HIDDEN), F.regexp_replace(plain, _HIDDEN, "")).otherwise(plain)
    d = documents.withColumn("__t", F.regexp_replace(plain, r"\]\([^()\s]*\)", "]"))
    d = d.withColumn("__w", F.filter(F.split(F.lower("__t"), r"[^\p{L}\p{M}]+"), lambda w: w != ""))

    def count(pattern: str) -> Column:
        return F.regexp_count("__t", F.lit(pattern))

    def kept(drop: str) -> Column:
        return F.length(F.regexp_replace("__t", drop, ""))

    d = d.withColumns(
        {
            "words": F.size("__w"),
            "__letters": F.length(F.array_join("__w", "")),
            "visible": kept(r"[\s\p{Z}]+"),
            "__symbols": kept(r"[\p{L}\p{M}\p{N}\s\p{Z}]+"),
            "__digits": F.length("__t") - F.length(F.translate("__t", "0123456789", "")),
            "__lines": count(r"(?m)^[^\n]*[^\s]"),
            "__ends": count(rf"(?m){_END}[ \t\r]*$"),
            "__marks": count(r"(?m)^[ \t]*(?:[-*+•–][ \t]|[0-9]+(?:\.[0-9]+)*[.)]?[ \t]|\[[^\]\n]*\][ \t]*$|\||```)"),
            "__common": F.size(F.filter("__w", lambda w: w.isin(words))) if words else F.lit(0),
            "__kana": F.when(F.col("__t").rlike("[ぁ-ゖ]"), kept(r"[^ぁ-ゖ]+")).otherwise(0),
            "__separators": F.when(F.col("__t").rlike("[\t;/|·•]"), count(r"\t|;| [/|·•] ")).otherwise(0),
            "__commas": F.length("__t") - F.length(F.replace("__t", F.lit(","))),
        }
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))

    return d.withColumns(
        {
            "mean_word_length": share("__letters", "words"),
            "symbol_share": share("__symbols", "visible"),
            "digit_share": share("__digits", "visible"),
            "punct_line_share": share("__ends", "__lines"),
            "common_share": share("__common", "words"),
            "marked_line_share": share("__marks", "__lines"),
            "words_per_line": share("words", "__lines"),
            "kana_share": share("__kana", "visible"),
            "separators_per_word": share("__separators", "words"),
            "commas_per_word": share("__commas", "words"),
        }
    ).drop("__t", "__w", "__letters", "__symbols", "__digits", "__lines", "__ends", "__marks", "__common", "__kana", "__separators", "__commas")


#: Learned, in order: a document that one of these holds for isn't natural prose.
RULES: list = [
    (("common_share", "<=", 0.3465), ("symbol_share", ">", 0.0837), ("words_per_line", "<=", 11.4167)),
    (("commas_per_word", "<=", 0.0015), ("kana_share", "<=", 0.2161), ("common_share", "<=", 0.2206)),
    (("marked_line_share", ">", 0.9286), ("words", "<=", 230.0)),
    (("commas_per_word", ">", 0.3556), ("common_share", "<=", 0.1875)),
    (("separators_per_word", ">", 0.0375), ("punct_line_share", "<=", 0.1833)),
]


def classified(documents: DataFrame, common: DataFrame, text: str = "text") -> DataFrame:
    """With the statistics, and ``rule``: 0 for natural prose, else the number of the rule that speaks against it."""
    return with_statistics(documents, common, text).withColumn("rule", F.expr(case_sql(RULES)))


def _visible(s: str) -> int:
    return len(re.sub(r"\s", "", s))


def prose_share(text: str | None, common: set[str]) -> float:
    """The share of visible characters in running sentences; the labelling function."""
    from quillspan.llm.folding import fold, skeleton

    t = fold(text or "")
    t = re.sub(r"</?[a-z][^<>]*>", "", re.sub(r"\]\([^()\s]*\)", "]", t))
    if not _visible(t):
        return 0.0
    known = common | {skeleton(w) for w in common}
    good, fenced, run = 0, False, []

    def end_run() -> None:
        nonlocal good
        s = " ".join(run)
        run.clear()
        words = re.findall(r"[^\W\d_]+", s.lower())
        cjk = len(re.findall(r"[ぁ-ヿ一-鿿]", s))
        if cjk > 0.3 * max(1, _visible(s)):
            good += _visible(s) if cjk >= 12 and re.search("です|ます|ました|ません|でした|ください", s) else 0
        elif len(words) >= 5:
            cyrillic = sum(bool(re.search("[а-яё]", w)) for w in words) > len(words) / 2
            share = sum(w in known or skeleton(w) in known for w in words) / len(words)
            good += _visible(s) if share >= (0.07 if cyrillic else 0.2) else 0

    for line in t.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
        if fenced or not s or s.startswith("```") or re.match(r"#{1,6} ", s):
            end_run()
            continue
        if m := re.match(r"(?:[-*+•–]|\d+(?:\.\d+)*[.)]?)\s+(.*)", s):
            if not run or not s[0].isdigit():
                end_run()
                if len(m[1].split()) >= 6 and m[1].rstrip()[-1:] in ".?!":
                    run.append(m[1])
                    end_run()
                continue
        s = re.sub(r"^>+\s*", "", s)
        words = re.findall(r"[^\W\d_]+", s.lower())
        running = len(words) >= 4 and sum(w in known for w in words) >= 0.25 * len(words) and s.count(" / ") < 2
        parted = s.count("|") >= 2 or s.count("\t") >= 2 or s.count(";") >= 3 or s.count(" / ") >= 2 or len(re.findall(r", [\d.]", s)) >= 2
        if re.fullmatch(r"\[[^\]]*\]", s) or (parted and not running) or re.search(r"\.{4,}|[{}=]|\w\(|^\S+: \d+$|^if \(", s):
            end_run()
            continue
        run.append(s)
        if len(run) > 1 and all(len(x.split()) <= 3 and len(x) < 40 for x in run[-2:]) and not re.search("[.?!。]$", s):
            run.clear()
    end_run()
    return good / _visible(t)


def p8_stats(spark, sf_dir: str) -> DataFrame:
    d = with_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return d.select("doc_id", "visible", *FEATURES)


def p8_found(spark, sf_dir: str) -> DataFrame:
    d = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")).where("doc_id IS NOT NULL")
    # a filter on the rule itself would be pushed below the statistics, which would then be computed for each use
    return d.groupBy("doc_id").agg(F.max("rule").alias("rule")).where("rule > 0").select("doc_id")


def p8_by_source(spark, sf_dir: str) -> DataFrame:
    """Documents and prose of each source."""
    d = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("rule") == 0).alias("n_prose"), F.sum("words").alias("words"))


QUERIES = {"p8_found": p8_found, "p8_stats": p8_stats, "p8_by_source": p8_by_source}


def _statistics_sql() -> str:
    """The statistics in DuckDB's SQL, from their definitions."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def kept(drop: str) -> str:
        return f"length(regexp_replace(t, {quoted(drop)}, '', 'g'))"

    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(t, {quoted(pattern)}))"

    def share(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN round({a} / {b}, 6) ELSE 0.0 END"

    return f"""WITH common AS (SELECT list(DISTINCT lower(word)) AS cw FROM common_words WHERE word IS NOT NULL AND lang <> 'ja'),
plain AS (SELECT doc_id, source, regexp_replace(translate(coalesce(text, ''), {quoted(_WIDE)}, {quoted(_NARROW)}), {quoted(_HIDDEN)}, '', 'g') AS x FROM documents),
shown AS (SELECT doc_id, source, regexp_replace(x, '\\]\\([^()\\s]*\\)', ']', 'g') AS t FROM plain),
split AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{M}}]+'), lambda w: w <> '') AS w FROM shown),
counted AS (SELECT doc_id, source, len(w) AS words, coalesce(length(array_to_string(w, '')), 0) AS letters, {kept(r"[\s\p{Z}]+")} AS visible, {kept(r"[\p{L}\p{M}\p{N}\s\p{Z}]+")} AS symbols,
  {kept(r"[^0-9]+")} AS digits, {count(r"(?m)^[^\n]*[^\s]")} AS lines, {count(rf"(?m){_END}[ \t\r]*$")} AS ends,
  {count(r"(?m)^[ \t]*(?:[-*+•–][ \t]|[0-9]+(?:\.[0-9]+)*[.)]?[ \t]|\[[^\]\n]*\][ \t]*$|\||```)")} AS marks, len(list_filter(w, lambda x: list_contains(cw, x))) AS common,
  {kept(r"[^ぁ-ゖ]+")} AS kana, {count(r"\t|;| [/|·•] ")} AS separators, {kept(r"[^,]+")} AS commas FROM split, common),
stats AS (SELECT doc_id, source, visible::INT AS visible, words::INT AS words, {share("letters", "words")} AS mean_word_length, {share("symbols", "visible")} AS symbol_share, {share("digits", "visible")} AS digit_share,
  {share("ends", "lines")} AS punct_line_share, {share("common", "words")} AS common_share, {share("marks", "lines")} AS marked_line_share, {share("words", "lines")} AS words_per_line,
  {share("kana", "visible")} AS kana_share, {share("separators", "words")} AS separators_per_word, {share("commas", "words")} AS commas_per_word FROM counted)
"""


_STATS = _statistics_sql()
_RULE = re.sub(r"(?<=\d)D\b", "", case_sql(RULES))
ORACLE = {
    "p8_stats": _STATS + f"SELECT doc_id, visible, {', '.join(FEATURES)} FROM stats",
    "p8_found": _STATS + f"SELECT DISTINCT doc_id FROM stats WHERE {_RULE} > 0",
    "p8_by_source": _STATS + f"SELECT source, count(*) AS n_docs, count(*) FILTER ({_RULE} = 0) AS n_prose, sum(words)::BIGINT AS words FROM stats GROUP BY source",
}


def fit(spark, sf_dir: str, labelled: int = LABELLED):
    """Induce rules from at most ``labelled`` documents; returns them with the accuracy on the others."""
    import numpy as np

    from quillspan.llm.rule_induction import induce, predict

    common = table(spark, sf_dir, "common_words")
    rows = with_statistics(table(spark, sf_dir, "documents"), common).select("doc_id", "text", *FEATURES).orderBy(F.xxhash64("doc_id")).limit(2 * labelled).toPandas()
    known = {w.lower() for (w,) in common.where("lang <> 'ja'").select("word").collect()}
    y = np.array([prose_share(t, known) < 0.5 for t in rows["text"]])
    x = {f: rows[f].to_numpy(float) for f in FEATURES}
    own = np.arange(len(rows)) < min(labelled, len(rows) * 2 // 3)
    seen = {f: v[own] for f, v in x.items()}
    lists = [induce(seen, y[own], seed=seed) for seed in range(12)]
    rules = min(lists, key=lambda r: ((predict(seen, r, int(own.sum())) != y[own]).sum(), len(r)))
    said = predict(x, rules, len(rows))
    wrong = rows["doc_id"][said != y].tolist()
    return rules, float((said == y)[~own].mean()), wrong


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    found, accuracy, wrong = fit(SparkSession.builder.master("local[4]").getOrCreate(), sys.argv[1])
    print(f"held-out accuracy {accuracy:.4f}; wrong: {wrong[:40]}")
    for r in found:
        print(f"    {r!r},")
