"""Site indexes from a stream of pages: the full text grows as pages arrive, the index is sorted at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.corpus import group_breaks, index_parts, sorted_pages
from quillspan.functions.url_columns import url_path


def stream_index(pages: DataFrame, path: str, site: str, tie: str, most: int = 160) -> DataFrame:
    """Run the stream of ``(site, url, title, description, content, ...)`` over what there is.

    Each batch's pages are appended to ``path``/full; at the end the index of all of them, in their order on the
    site, is written to ``path``/index as ``(site, place, line)`` and returned with ``tie``. Batches are written under
    their number, so that one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/full/batch={number}")

    pages.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = pages.sparkSession
    arrived = spark.read.schema(pages.schema).parquet(f"{path}/full")
    placed = sorted_pages(arrived.withColumn("__path", url_path(F.col("url"))), site, "__path", tie)
    placed = group_breaks(placed, site)
    index_parts(placed, site, most).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index").join(placed.select(site, "place", tie), [site, "place"])
