"""Problem 7: mixing sources to target weights.

Method: weighted fair queueing. The documents of a source stand in a shuffled order; each gets
the virtual finish time (cumulative tokens of its source) / (weight of its source). Sorted by
that time over all sources, any prefix holds the sources in proportion to their weights; the
order is cut at the total budget. A source too small for its part comes again, shuffled anew,
at most ``max_repeats`` times.

Cumulative sums never run through one task: documents fall into buckets of their shuffled order
(as many as their source needs, ``2 ** MAX_BITS`` at most), the buckets' sums are accumulated, and
only within a bucket are documents summed one by one. Documents that the queue can't reach before
the budget is full drop out there; the rest is range-sorted by finish time over the cluster, in
ranges of equal numbers of documents, and cut at the budget by the sums of the ranges.

Defined results
---------------
* sources that aren't listed, and null sources, aren't used; listed sources without tokens are
  reported with a share of 0, and the others' targets are scaled to fill their place.
* documents without tokens (null or blank texts) aren't used. Null or non-positive shares and
  repeats count as 0. Of a source listed twice the larger share holds.
* repeated ``doc_id`` rows are documents of their own; ties are broken by ``doc_id``.
* ``total_tokens`` None: the largest budget at which the shares that can be reached lie within
  ``tolerance`` of the targets (half the sum of the differences, over the sources that have tokens);
  ``"strict"``: at which every such source reaches its share; ``"all"``: all tokens at hand, each
  document's once. Where small sources run dry before the budget, the others fill it by their weights,
  and the report tells.
* empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tokens import TOKENIZER, with_tokens
from quillspan.plans.tables import materialize, spread, table

#: A source's shuffled order has up to 2 to this number buckets, of about BUCKET_DOCS documents.
MAX_BITS = 12
BUCKET_DOCS = 256
#: Documents a range of the final sort, about.
RANGE_DOCS = 500_000
TOLERANCE = 0.01


def sized_documents(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents of listed sources, written to the shared folder."""
    listed = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source").distinct()
    texts = documents.where("doc_id IS NOT NULL").where(F.col("text").rlike(r"[^\s\p{Z}]"))
    own = spread(texts.select("doc_id", "source", "text")).join(listed, "source", "left_semi")
    return materialize(with_tokens(own, ["doc_id", "source"], "text", path).where("n_tokens > 0"), "sized")


def plan_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | str | None, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a listed source: its weight, tokens, copies needed, the budget and how far the queue can come (``until``).

    The queue ends about the virtual time at which the sources, each as long as it lasts, have
    brought the budget together. That time is found over the points at which sources run dry, and
    bounds the copies to make.
    """
    listed = (
        targets.where("source IS NOT NULL")
        .groupBy("source")
        .agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"))).alias("x"))
        .select("source", F.col("x.share").alias("target_share"), F.col("x.repeats").alias("max_repeats"))
    )
    have = sized.groupBy("source").agg(
        F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("longest")
    )
    all_rows = Window.partitionBy(F.lit(1))
    plan = listed.join(have, "source", "left").withColumn(
        "usable", (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("have").isNotNull()
    )
    plan = plan.withColumn("weight", F.when(F.col("usable"), F.col("target_share")) / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(all_rows))
    plan = plan.withColumn("cap", F.when(F.col("usable"), F.col("have") * F.col("max_repeats")).cast("double"))
    plan = plan.withColumn("dry", F.col("cap") / F.col("weight"))
    by_dry = all_rows.orderBy("dry", "source")
    # with the sources up to this one dry, budgets up to C / (W - tolerance) miss the targets by no more than the tolerance
    dried = by_dry.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.sum("weight").over(dried) - F.lit(tolerance)
    plan = plan.withColumns({"__reach": F.when(over > 0, F.sum("cap").over(dried) / over), "__next": F.lead("dry").over(by_dry)})
    within = F.min(F.when(F.col("usable") & (F.col("__reach") <= F.coalesce("__next", F.lit(float("inf")))), F.col("__reach"))).over(all_rows)
    budget = {
        "strict": F.floor(F.min("dry").over(all_rows)),
        "all": F.sum(F.when(F.col("usable"), F.col("have"))).over(all_rows),
        None: F.floor(F.coalesce(F.greatest(within, F.min("dry").over(all_rows)), F.sum("cap").over(all_rows))),
    }.get(total_tokens, F.lit(total_tokens))
    plan = plan.withColumn("budget", F.coalesce(budget.cast("bigint"), F.lit(0))).drop("__reach", "__next")
    ended = F.coalesce(F.sum("cap").over(by_dry.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    going = F.sum("weight").over(by_dry.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    plan = plan.withColumns({"__ended": ended, "__going": going})  # sources that are dry before, and the weights of the rest
    ends = (F.col("budget") - F.col("__ended")) / F.col("__going")
    end = F.min_by(ends, F.when(F.col("usable") & (ends <= F.col("dry")), F.col("dry"))).over(all_rows)
    late = F.sum(F.when(F.col("usable"), F.col("longest"))).over(all_rows)  # whole documents end that much later at most
    plan = plan.withColumn("until", end + late)
    need = F.least("cap", F.when(F.col("until").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("until")))
    return plan.withColumn("copies", F.ceil(need / F.col("have")).cast("int")).drop("__ended", "__going", "dry", "longest", "cap")


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = 7, path: str = TOKENIZER, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """The queue up to the budget ``(doc_id, source, copy, n_tokens, finish, at)``, and the plan of the sources.

    ``at`` is the number of tokens in the queue up to and with the document: ordered by it, the mix is in its order.
    """
    sized = sized_documents(documents, targets, path)
    plan = materialize(plan_sources(sized, targets, total_tokens, tolerance), "mix_plan")
    bits = F.least(F.lit(MAX_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / BUCKET_DOCS)))).cast("int")
    use = plan.where("usable AND copies > 0").select("source", "weight", "copies", "budget", F.coalesce("until", F.lit(float("inf"))).alias("until"), bits.alias("bits"))
    copies = sized.join(use, "source")  # the planner broadcasts the plan by its size in the file
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("order", F.xxhash64("doc_id", "copy", F.lit(seed)))
    copies = copies.withColumn("bucket", F.expr("CASE WHEN bits = 0 THEN 0 ELSE CAST(shiftrightunsigned(order, 64 - bits) AS INT) END"))

    per_bucket = copies.groupBy("source", "copy", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("source", "copy", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = (
        copies.join(per_bucket, ["source", "copy", "bucket"])
        .where("before / weight <= until")
        .withColumn("finish", (F.col("before") + F.sum("n_tokens").over(inside)) / F.col("weight"))
        .where("finish <= until")
        .select("doc_id", "source", "copy", "n_tokens", "finish", "budget")
    )
    timed = materialize(timed, "timed")

    n = max(int(timed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-timed.count() // RANGE_DOCS))
    order = ["finish", "source", "doc_id", "copy"]
    ranged = materialize(timed.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranged.groupBy("range").agg(F.sum("n_tokens").alias("sum")).select("range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("so_far"))
    queue = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        ranged.join(ranges, "range")
        .where("so_far < budget")
        .withColumn("at", F.col("so_far") + F.sum("n_tokens").over(queue))
        .where("at <= budget")
        .select("doc_id", "source", "copy", "n_tokens", "finish", "at")
    )
    return taken, plan


def shares(taken: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: target and actual share of each listed source, tokens, documents and the most often a document is used."""
    used = taken.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("most_repeats")
    )
    everything = Window.partitionBy(F.lit(1))
    return (
        plan.select("source", "target_share", "weight", "max_repeats", F.coalesce("have", F.lit(0)).alias("available"))
        .join(used, "source", "left")
        .na.fill(0, ["tokens", "uses", "most_repeats"])
        .withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(everything), F.lit(0)), F.lit(0.0)))
        # the target among the sources that have tokens
        .withColumn("reachable_share", F.when(F.col("available") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0)))
        .drop("weight")
    )


def p7_mix(spark, sf_dir: str) -> DataFrame:
    """The documents of the mix with their place in it; the largest budget that keeps the shares within the tolerance."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mix(documents, targets)[0]


def p7_shares(spark, sf_dir: str) -> DataFrame:
    return shares(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p7_all_shares(spark, sf_dir: str) -> DataFrame:
    """The report where the budget is all tokens at hand, which is more than the small sources can fill."""
    return shares(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "all"))


def p7_strict_shares(spark, sf_dir: str) -> DataFrame:
    """The report at the largest budget at which every source that has documents reaches its share."""
    return shares(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "strict"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_strict_shares": p7_strict_shares, "p7_all_shares": p7_all_shares}
ORACLE: dict[str, str] = {}
