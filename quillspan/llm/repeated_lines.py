"""Problem 1: lines repeated across one site's documents.

Method: documents with the same lines are collapsed into a cluster first; each line
is then counted over the distinct clusters of its site and their publication dates,
with the number of pages kept as the clusters' weight. One table of line keys, written
once, serves the counting and the removal, and only keys (8 bytes a line) are shuffled.

Defined results
---------------
* null ``content``: no lines; null ``page_id``, or one without a row in ``pages``: no
  site, so no line of it is counted or removed.
* empty tables give empty results with the same columns.
* a chunk delivered twice counts and comes out once; equal chunks with other ids count each.
* a line that stands twice on a page counts once for the page; both places come out.
* fetches of one url under several ``page_id`` are several pages.
* extra columns of the inputs are ignored, in :func:`strip_repeated_lines` those of the
  chunks are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.sites import site_of, site_sql
from quillspan.plans.tables import materialize, table

MIN_LETTERS = 10
MIN_PAGES = 5
MIN_SHARE = 0.2
MIN_CLUSTERS = 3
MIN_DAYS = 2
_BLANKS = r"[\s\p{Z}&&[^\n]]+"


def line_keys(content: Column, min_letters: int = MIN_LETTERS) -> Column:
    """An array with one hash a line; null for a line with fewer letters.

    Equal hashes: equal but for letter case, amount of white space and the digits of numbers.
    """
    masked = F.regexp_replace(F.lower(F.upper(content)), r"\p{Nd}+", "0")
    masked = F.split(F.regexp_replace(masked, _BLANKS, " "), "\n")
    letters = F.split(F.regexp_replace(content, r"[^\p{L}\n]+", ""), "\n")
    return F.zip_with(masked, letters, lambda m, n: F.when(F.length(n) >= min_letters, F.xxhash64(F.trim(m))))


def keyed_chunks(chunks: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``(chunk_id, page_id, keys)``, written to the shared folder."""
    return materialize(
        chunks.where("content IS NOT NULL AND page_id IS NOT NULL AND chunk_id IS NOT NULL").select(
            "chunk_id", "page_id", line_keys(F.col("content"), min_letters).alias("keys")
        ),
        "line_keys",
    )


def page_sites(pages: DataFrame) -> DataFrame:
    """``(page_id, site, day)``, a row for each page that has a site."""
    return (
        pages.where("page_id IS NOT NULL")
        .groupBy("page_id")
        .agg(
            F.min(site_of(F.col("origin"), F.col("url"))).alias("site"),
            F.min(F.to_date("fetched_at")).alias("day"),
        )
        .where("site IS NOT NULL")
    )


def count_lines(keyed: DataFrame, sites: DataFrame) -> DataFrame:
    """``(site, key, n_pages, n_clusters, n_days, site_pages)`` for every line of every site.

    ``n_clusters`` counts the distinct documents (clusters of pages with the same lines),
    ``n_days`` the distinct days on which such a document was first fetched.
    """
    per_page = keyed.groupBy("page_id").agg(
        F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list("keys"))))).alias("keys")
    )
    clusters = (
        per_page.join(sites, "page_id")
        .withColumn("cluster", F.xxhash64("keys"))
        .groupBy("site", "cluster")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("day").alias("day"), F.any_value("keys").alias("keys"))
    )
    per_day = (
        clusters.select("site", "weight", "day", F.explode("keys").alias("key"))
        .groupBy("site", "key", "day")
        .agg(F.sum("weight").alias("n_pages"), F.count(F.lit(1)).alias("n_clusters"))
    )
    counted = per_day.groupBy("site", "key").agg(
        F.sum("n_pages").alias("n_pages"), F.sum("n_clusters").alias("n_clusters"), F.count("day").alias("n_days")
    )
    return counted.join(sites.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages")), "site")


def repeated_keys(
    counted: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    min_clusters: int = MIN_CLUSTERS,
    min_days: int = MIN_DAYS,
) -> DataFrame:
    """The lines repeated excessively: ``(site, key)`` and the counts.

    Besides its pages, a line must stand in ``min_clusters`` different documents, first fetched on ``min_days`` days, so
    that an article republished on many pages isn't taken for boilerplate.
    """
    return counted.where(
        (F.col("n_pages") >= min_pages)
        & (F.col("n_pages") / F.col("site_pages") >= min_share)
        & (F.col("n_clusters") >= min_clusters)
        & (F.col("n_days") >= min_days)
    )


def repeated_lines(keyed: DataFrame, sites: DataFrame, hot: DataFrame) -> DataFrame:
    """``(chunk_id, lines)``: for each chunk with repeated lines, the array of their numbers.

    A site has at most ``1 / min_share`` times the lines of a page as repeated lines, which
    bounds the array that goes along with each of its pages.
    """
    per_site = hot.groupBy("site").agg(F.collect_list("key").alias("hot"))
    page_hot = sites.join(per_site, "site").select("page_id", "hot")
    numbered = F.transform(
        "keys", lambda k, i: F.when(k.isNotNull() & F.array_contains("hot", F.coalesce(k, F.lit(0))), i + 1)
    )
    return (
        keyed.join(page_hot, "page_id")
        .where(F.arrays_overlap("keys", "hot"))
        .select("chunk_id", F.array_compact(numbered).alias("lines"))
        .where(F.size("lines") > 0)
        .dropDuplicates(["chunk_id"])
    )


def find_repeated(chunks: DataFrame, pages: DataFrame, **limits: float) -> DataFrame:
    keyed = keyed_chunks(chunks)
    sites = page_sites(pages)
    return repeated_lines(keyed, sites, repeated_keys(count_lines(keyed, sites), **limits))


def strip_repeated_lines(chunks: DataFrame, pages: DataFrame, **limits: float) -> DataFrame:
    """The chunks, each once, without the lines repeated within their site; ``n_removed`` counts those.

    Where ``chunks`` has a column ``n_removed`` of its own, the count is ``n_removed_``.
    """
    name = "n_removed"
    while name in chunks.columns:
        name += "_"
    found = find_repeated(chunks, pages, **limits).select(F.col("chunk_id").alias("__id"), F.col("lines").alias("__at"))
    lines = F.split("content", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.coalesce("__at", F.array().cast("array<int>")), i + 1))
    once = chunks.dropDuplicates(["chunk_id"])
    joined = once.join(found, once["chunk_id"] == found["__id"], "left")
    return joined.withColumns(
        {
            "content": F.when(F.col("__at").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")),
            name: F.when(F.col("__at").isNull(), 0).otherwise(F.size("__at")),
        }
    ).drop("__id", "__at")


def p1_found(spark, sf_dir: str) -> DataFrame:
    # the test tables define this query by pages alone
    found = find_repeated(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "pages"), min_clusters=1, min_days=0)
    return found.select("chunk_id", F.explode("lines").alias("line_no"))


def p1_stripped(spark, sf_dir: str) -> DataFrame:
    """Every chunk without the lines that its site repeats, in different documents and on several days."""
    out = strip_repeated_lines(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "pages"))
    return out.select("chunk_id", "page_id", "content", "n_removed")


def p1_boilerplate_sites(spark, sf_dir: str) -> DataFrame:
    """The lines that each site repeats: their number, the most pages of one, and their places in different documents."""
    keyed = keyed_chunks(table(spark, sf_dir, "chunks"))
    hot = repeated_keys(count_lines(keyed, page_sites(table(spark, sf_dir, "pages"))))
    return hot.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("n_pages").alias("most_pages"), F.sum("n_clusters").alias("clusters")
    )


QUERIES = {"p1_found": p1_found, "p1_stripped": p1_stripped, "p1_boilerplate_sites": p1_boilerplate_sites}

_LINES = f"""
WITH site AS (SELECT page_id, min({site_sql("origin", "url")}) AS site FROM pages WHERE page_id IS NOT NULL GROUP BY 1),
per_site AS (SELECT site, count(*) AS n FROM site WHERE site IS NOT NULL GROUP BY 1),
once AS (SELECT chunk_id, any_value(page_id) AS page_id, any_value(content) AS content FROM chunks GROUP BY 1),
line AS (
  SELECT chunk_id, page_id, unnest(range(1, len(l) + 1))::INT AS line_no, unnest(l) AS line
  FROM (SELECT chunk_id, page_id, string_split(content, chr(10)) AS l FROM once)),
keyed AS (
  SELECT chunk_id, site.page_id, site, line_no,
    trim(regexp_replace(regexp_replace(lower(line), '\\p{{Nd}}+', '0', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS k
  FROM line JOIN site USING (page_id)
  WHERE site IS NOT NULL AND length(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')) >= {MIN_LETTERS}),
hot AS (
  SELECT site, k FROM keyed JOIN per_site USING (site) GROUP BY site, k, n
  HAVING count(DISTINCT page_id) >= {MIN_PAGES} AND count(DISTINCT page_id) / n >= {MIN_SHARE})
"""
_CLUSTERS = """, page_keys AS (SELECT site, page_id, list_sort(list(DISTINCT k)) AS sig FROM keyed GROUP BY ALL),
first_day AS (SELECT site, sig, min(CAST(p.fetched_at AS DATE)) AS day FROM page_keys JOIN (SELECT page_id, min(fetched_at) AS fetched_at FROM pages GROUP BY 1) p USING (page_id) GROUP BY ALL),
spread AS (SELECT site, k, count(*) AS n_clusters, count(DISTINCT day) AS n_days FROM (SELECT site, day, unnest(sig) AS k FROM first_day) GROUP BY ALL),
kept_hot AS (SELECT site, k FROM hot JOIN spread USING (site, k) WHERE n_clusters >= {clusters} AND n_days >= {days})
""".format(clusters=MIN_CLUSTERS, days=MIN_DAYS)
ORACLE = {
    "p1_found": _LINES + "SELECT chunk_id, line_no FROM keyed JOIN hot USING (site, k)",
    "p1_stripped": _LINES + _CLUSTERS
    + """, hit AS (SELECT chunk_id, line_no FROM keyed JOIN kept_hot USING (site, k)),
rest AS (
  SELECT chunk_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (hit.line_no IS NULL) AS content, count(hit.line_no) AS n_removed
  FROM line LEFT JOIN hit USING (chunk_id, line_no) GROUP BY 1)
SELECT chunk_id, page_id, coalesce(rest.content, '') AS content, n_removed::INT AS n_removed
FROM once JOIN rest USING (chunk_id)""",
    "p1_boilerplate_sites": _LINES + _CLUSTERS
    + """SELECT site, count(*) AS n_lines, max(n_pages) AS most_pages, sum(n_clusters)::BIGINT AS clusters
FROM kept_hot JOIN spread USING (site, k) JOIN (SELECT site, k, count(DISTINCT page_id) AS n_pages FROM keyed GROUP BY ALL) USING (site, k) GROUP BY site""",
}
