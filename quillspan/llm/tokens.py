"""Problem 5: token budget per source and language.

Method: a table of counts keyed by a hash of the content and one of the tokenizer; only contents
without a row are encoded. A snapshot of the pages' tokens is compared with the last one, and
the cubes (totals by site, language and registered domain) change by signed deltas: a page that
is new adds, one that is gone subtracts, one that changed does both.

Defined results
---------------
* a chunk delivered twice counts once; equal contents of different chunks count each, and are
  encoded once; null and empty contents have no tokens.
* chunks of unknown pages count under their own origin's site and language ``und``.
* languages come out as their two-letter code; null, blank and ``und`` are ``und``.
* extra columns are ignored; empty tables give empty cubes.
* the vocabulary file is read on the driver and its bytes (``MAX_VOCABULARY_BYTES`` at most, checked)
  go with the tasks, so executors need no such file.
* a store (``Budget``) is updated by versions: an update that breaks off leaves the version before it,
  and run again it gives what it would have given.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.sites import host_of, registered_domain, site_of
from quillspan.plans.tables import scratch, spread, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 8_000_000
#: Fixed value: how the byte-level vocabularies split a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Names of languages in place of their codes.
LANGUAGE_NAMES = {
    "english": "en", "deutsch": "de", "german": "de", "francais": "fr", "français": "fr", "french": "fr",
    "espanol": "es", "español": "es", "spanish": "es", "russian": "ru", "русский": "ru", "japanese": "ja", "日本語": "ja",
}
CUBES = ("site", "lang", "domain")


def language(declared: Column) -> Column:
    base = F.split(F.lower(F.trim(declared)), "[-_]")[0]
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.when(declared.isNull() | base.isin("", "und"), "und").otherwise(F.coalesce(F.try_element_at(names, base), base))


@lru_cache(4)
def _vocabulary(path: str) -> tuple[bytes, str]:
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data, hashlib.sha256(data + PATTERN.encode()).hexdigest()[:16]


def tokenizer_key(path: str = TOKENIZER) -> str:
    return _vocabulary(path)[1]


@lru_cache(2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = TOKENIZER):
    """A function for ``mapInArrow``: the columns before the last stay, the last (text) becomes ``n_tokens``."""
    data, _ = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(data).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = pa.array([len(encode(x)) if x else 0 for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*batch.schema.names[:-1], "n_tokens"])

    return run


def with_tokens(df: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of ``text``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return spread(df.select(*keep, text)).mapInArrow(token_counter(path), f"{schema}, n_tokens bigint")


def content_hash(content: Column) -> Column:
    return F.unhex(F.md5(content))


def encode_unseen(contents: DataFrame, counts: DataFrame | None, path: str = TOKENIZER) -> DataFrame:
    """Rows for the count table: of ``(hash, content)``, those without a row under this tokenizer, encoded once each."""
    key = tokenizer_key(path)
    todo = contents.where("content IS NOT NULL AND content <> ''")
    if counts is not None:
        todo = todo.join(counts.where(F.col("tokenizer") == key).select("hash"), "hash", "left_anti")
    todo = todo.groupBy("hash").agg(F.any_value("content").alias("content"))
    return with_tokens(todo, ["hash"], "content", path).withColumn("tokenizer", F.lit(key))


def page_tokens(chunks: DataFrame, pages: DataFrame, counts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The snapshot ``(page_id, site, lang, domain, n_chunks, n_tokens)``."""
    own = pages.where("page_id IS NOT NULL").groupBy("page_id").agg(
        F.min(site_of(F.col("origin"), F.col("url"))).alias("site"), F.min(language(F.col("lang"))).alias("lang")
    )
    once = chunks.where("page_id IS NOT NULL").groupBy("chunk_id").agg(
        F.min("page_id").alias("page_id"), F.min("origin").alias("origin"), F.min(content_hash(F.col("content"))).alias("hash")
    )
    known = counts.where(F.col("tokenizer") == tokenizer_key(path)).select("hash", "n_tokens")
    # chunks without content meet nothing; each gets a key of its own, so that they don't gather in one task
    alone = F.unhex(F.md5(F.concat(F.lit("no content of "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("")))))
    return (
        once.withColumn("hash", F.coalesce("hash", alone))
        .join(known, "hash", "left")
        .groupBy("page_id")
        .agg(
            F.min("origin").alias("origin"), F.count(F.lit(1)).alias("n_chunks"),
            F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"),
        )
        .join(own, "page_id", "left")
        .withColumns({"site": F.coalesce("site", site_of(F.col("origin"), F.lit(None).cast("string"))), "lang": F.coalesce("lang", F.lit("und"))})
        .withColumn("domain", registered_domain(host_of(F.col("site"))))
        .select("page_id", "site", "lang", "domain", "n_chunks", "n_tokens")
    )


def deltas(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Signed changes ``(site, lang, domain, d_pages, d_chunks, d_tokens)`` from one snapshot to the next.

    Snapshots are compared by page; a page that stayed the same cancels out and drops out.
    """
    plus = new.withColumn("sign", F.lit(1))
    both = plus if old is None else plus.union(old.select(new.columns).withColumn("sign", F.lit(-1)))
    same = both.groupBy(new.columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return same.groupBy(*CUBES).agg(
        F.sum("sign").alias("d_pages"), F.sum(F.col("sign") * F.col("n_chunks")).alias("d_chunks"),
        F.sum(F.col("sign") * F.col("n_tokens")).alias("d_tokens"),
    )


def updated_cube(cube: DataFrame | None, change: DataFrame) -> DataFrame:
    """The cells ``(site, lang, domain, n_pages, n_chunks, n_tokens)`` after the change; empty cells go."""
    names = [*CUBES, "n_pages", "n_chunks", "n_tokens"]
    cells = change.toDF(*names)
    if cube is not None:
        cells = cells.union(cube.select(names))
    summed = cells.groupBy(*CUBES).agg(*[F.sum(c).alias(c) for c in names[3:]])
    return summed.where("n_pages <> 0 OR n_chunks <> 0 OR n_tokens <> 0")


def totals(cube: DataFrame) -> DataFrame:
    """``(slice, name, n_pages, n_chunks, n_tokens)``: totals by site, language and registered domain."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).alias("name")) for c in CUBES])).alias("x")
    return (
        cube.select(each, "n_pages", "n_chunks", "n_tokens")
        .groupBy("x.slice", "x.name")
        .agg(*[F.sum(c).alias(c) for c in ("n_pages", "n_chunks", "n_tokens")])
    )


class Budget:
    """A count table, snapshots and cubes kept at a path, and brought up to date by what changed.

    ``counts/`` grows by the contents that were unseen; ``v=N/`` holds the snapshot and the cube of an update and,
    written last, the mark that it is whole. Counts are of contents, so those of an update that broke off stay right;
    rows of one hash are the same and are taken once.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: str = TOKENIZER):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer

    def _folders(self, at: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(at)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []

    def version(self) -> int:
        """The last whole version, 0 before the first."""
        numbers = [int(x[2:]) for x in self._folders(self.path) if x.startswith("v=")]
        return max((n for n in numbers if "whole" in self._folders(f"{self.path}/v={n}")), default=0)

    def counts(self) -> DataFrame | None:
        """``(hash, n_tokens, tokenizer)``, each hash once a tokenizer."""
        if not self._folders(f"{self.path}/counts"):
            return None
        rows = self.spark.read.schema(_COUNTS).parquet(f"{self.path}/counts/*")
        return rows.groupBy("hash", "tokenizer").agg(F.min("n_tokens").alias("n_tokens")).select("hash", "n_tokens", "tokenizer")

    def _read(self, name: str, version: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v={version}/{name}") if version else None

    def snapshot(self) -> DataFrame | None:
        return self._read("snapshot", self.version())

    def cube(self) -> DataFrame | None:
        return self._read("cube", self.version())

    def update(self, chunks: DataFrame, pages: DataFrame) -> int:
        """Bring the store to the chunks and pages as they are now; the new version."""
        last = self.version()
        old, cube = self._read("snapshot", last), self._read("cube", last)
        at = f"{self.path}/v={last + 1}"
        encode_unseen(_contents(chunks), self.counts(), self.tokenizer).select("hash", "n_tokens", "tokenizer").write.mode("overwrite").parquet(
            f"{self.path}/counts/{last + 1}-{tokenizer_key(self.tokenizer)}"
        )
        page_tokens(chunks, pages, self.counts(), self.tokenizer).write.mode("overwrite").parquet(f"{at}/snapshot")
        new = self.spark.read.parquet(f"{at}/snapshot")
        updated_cube(cube, deltas(old, new)).write.mode("overwrite").parquet(f"{at}/cube")
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/whole")
        return last + 1


_COUNTS = "hash binary, n_tokens bigint, tokenizer string"


def _scratch(spark, label: str) -> Budget:
    return Budget(spark, scratch(spark, label))


def _contents(chunks: DataFrame) -> DataFrame:
    return chunks.select(content_hash(F.col("content")).alias("hash"), "content")


def _first(spark, sf_dir: str) -> Budget:
    budget = _scratch(spark, "budget")
    budget.update(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "pages"))
    return budget


def p5_totals(spark, sf_dir: str) -> DataFrame:
    """The totals of a store that starts from nothing."""
    return totals(_first(spark, sf_dir).cube())


def p5_page_tokens(spark, sf_dir: str) -> DataFrame:
    """The estimated tokens of each page."""
    return _first(spark, sf_dir).snapshot()


def p5_incremental(spark, sf_dir: str) -> DataFrame:
    """The totals of a store after an update: first the pages fetched by the middle day, then all but the oldest day's.

    The second load encodes only contents the first didn't hold, and subtracts the pages removed.
    """
    chunks, pages = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "pages")
    day = F.to_date("fetched_at")
    low, middle = pages.agg(F.min(day), F.percentile_approx(F.unix_date(day), 0.5)).first()
    budget = _scratch(spark, "budget")
    if low is not None:
        first = pages.where(F.unix_date(day) <= middle)
        budget.update(chunks.join(first.select("page_id"), "page_id", "left_semi"), first)
        pages = pages.where((day > F.lit(low)) | day.isNull())
        chunks = chunks.join(pages.select("page_id"), "page_id", "left_semi")
    budget.update(chunks, pages)
    return totals(budget.cube())


QUERIES = {"p5_totals": p5_totals, "p5_page_tokens": p5_page_tokens, "p5_incremental": p5_incremental}
ORACLE: dict[str, str] = {}
