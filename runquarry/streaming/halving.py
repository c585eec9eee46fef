"""Early-stopping decisions while runs report: the compact log of a stream and what successive halving says of it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runquarry.operators.sweeps import halving_survivors


def _stretch(step: Column, min_resource: int, factor: int) -> Column:
    """Number of the first rung at or above a step; steps up to the first rung are stretch 0."""
    return F.greatest(F.lit(0), F.ceil(F.ln(step / F.lit(min_resource)) / F.lit(math.log(factor)) - 1e-9)).cast("int")


def compact_log(log: DataFrame, keys: Sequence[str], reduction_factor: int, min_resource: int) -> DataFrame:
    """The rows of a (keys, trial, step, value) log that can decide anything: the last one of each trial between two rungs.

    ``halving_survivors`` of it is that of the whole log. Compact logs are merged by compacting their union.
    """
    named = log.select(*keys, "trial", "step", "value").withColumn("stretch", _stretch(F.col("step"), min_resource, reduction_factor))
    return named.groupBy(*keys, "trial", "stretch").agg(F.max(F.struct("step", "value")).alias("_l")).select(*keys, "trial", "_l.step", "_l.value")


def start_halving(log: DataFrame, location: str, checkpoint: str, keys: Sequence[str], direction: str = "maximize", reduction_factor: int = 4,
                  min_resource: int = 10, **trigger) -> StreamingQuery:
    """Follow a streaming (keys, trial, step, value) log and decide after every batch which trials go on.

    Each batch writes its compact rows to ``rows/batch=<n>`` and the decisions over all rows so far to ``decisions/batch=<n>``;
    both are overwritten when the batch is run again, so a restart in the middle gives the same. What is kept and read
    grows with the trials and rungs, not with the log. A decision is that of the trials that have reached the rung so far, and
    may be taken back when others reach it; after the last batch the decisions are ``halving_survivors`` of the whole log.
    """
    keys = list(keys)

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        compact_log(batch, keys, reduction_factor, min_resource).write.mode("overwrite").parquet(f"{location}/rows/batch={batch_id}")
        # a batch that failed after writing its rows leaves none beyond its own number
        known = spark.read.option("basePath", f"{location}/rows").parquet(f"{location}/rows").where(F.col("batch") <= batch_id)
        decisions = halving_survivors(compact_log(known, keys, reduction_factor, min_resource), keys, direction, reduction_factor, min_resource)
        decisions.write.mode("overwrite").parquet(f"{location}/decisions/batch={batch_id}")

    return log.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_decisions(spark: SparkSession, location: str) -> DataFrame:
    """(keys, trial, rung, value, survived) after the last batch; a trial with a rung it did not survive is to be stopped."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/decisions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [int(p.getName().split("=")[1]) for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not numbers:
        raise ValueError(f"no batch has been decided below {location}")
    return spark.read.parquet(f"{location}/decisions/batch={max(numbers)}")
