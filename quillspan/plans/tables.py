"""Reading the input tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"quillspan-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for a run in the shared folder, deleted at the end of the application."""
    path = f"{shared_dir(spark)}/quillspan-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return f"{path}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where two branches of a plan need the same costly rows: the scan and the
    expressions run once, and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for costly per-row kernels.

    A small input in one file comes as one task; it is shuffled once to fill the cores. An
    input of as many splits as there are cores, the case at scale, is left where it is. So is
    what comes out of a shuffle: counting its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    shuffled = "Adaptive" in (text := plan.executedPlan().toString()) or "Exchange" in text
    if shuffled or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the next folder may belong to another
            continue
