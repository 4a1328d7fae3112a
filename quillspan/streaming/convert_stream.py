"""Documents that arrive in pieces, converted incrementally with keyed state.

The state of a document is its converter (``operators.incremental``): the construct that is still open and what the
parser holds back, and pieces that came before their turn. Each piece releases what can't change any more, so the
parts of a document, joined in their order, equal the batch result for every way of cutting it. A document that
never ends is evicted after ``timeout_ms``, and comes out as far as it came. A run to the end of what there is
(``availableNow``) needs ``timeout_ms=None``: with a processing-time timeout Spark would go on with empty batches for ever.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.operators.incremental import Converter
from quillspan.operators.options import Options

TIMEOUT_MS = 3_600_000


def convert_pieces(pieces: DataFrame, output: str = "markdown", o: Options = Options(), timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """From a stream of ``(doc_id bigint, seq int, piece string or binary, is_last boolean)`` to ``(doc_id, part, text, complete)``.

    ``part`` is the number of the piece that released the text; pieces are taken in the order of ``seq`` from 0 on, one
    that comes again counts once. ``complete`` stands on the last part.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            blob, following, last = state.get
            converter, waiting = pickle.loads(blob)
        else:
            converter, waiting, following, last = Converter(output, o), {}, 0, -1
        rows = []
        if state.hasTimedOut:
            state.remove()
            for k in sorted(waiting):
                rows.append((key[0], k, converter.process(waiting[k]), False))
            rows.append((key[0], 2**31 - 1, converter.finish(), False))
        else:
            for b in batches:
                for k, piece, ends in zip(b["seq"].tolist(), b["piece"].tolist(), b["is_last"].tolist(), strict=True):
                    if k >= following:
                        waiting[k] = piece if piece is not None else ""
                    if ends:
                        last = max(last, k)
            while following in waiting:
                if text := converter.process(waiting.pop(following)):
                    rows.append((key[0], following, text, False))
                following += 1
            if 0 <= last < following:
                rows.append((key[0], following, converter.finish(), True))
                state.remove()
            else:
                state.update((pickle.dumps((converter, waiting)), following, last))
                if timeout_ms is not None:
                    state.setTimeoutDuration(timeout_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "part", "text", "complete"])

    return pieces.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id bigint, part int, text string, complete boolean", "converter binary, following int, last int",
        "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def joined_parts(parts: DataFrame) -> DataFrame:
    """``(doc_id, text, complete)``: the parts of each document as one text."""
    own = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["text"]), "").alias("text"), F.max("complete").alias("complete"))


def windowed_counts(events: DataFrame, time: str, size: str, late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type; those later than ``late`` are dropped once their window is out."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def run_once(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a streaming query over what there is and write its rows to ``path``/out; in mode complete, the last result."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        query.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    else:
        query.format("parquet").start(f"{path}/out").awaitTermination()
