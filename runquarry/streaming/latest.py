"""Latest metrics kept up to date from an append-only log, without state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runquarry.functions.scale import dealt


def start_latest_metrics(log: DataFrame, location: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Follow a streaming (run_uuid, key, value, step, ts) log and write each batch's last values below ``location``.

    A last value is the highest of what the batches hold, so batches are merged when the view is read or folded, and the
    stream keeps no state: nothing grows with the runs that have ended, and late rows need no watermark. A batch goes to
    its own folder and is overwritten when it is run again, so a restart after a failure neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        values = batch.select("run_uuid", "key", F.struct("step", "ts", "value").alias("last"))
        last = _last_values(values)
        last.write.mode("overwrite").parquet(f"{location}/batch={batch_id}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold_latest_metrics(spark: SparkSession, location: str) -> None:
    """Replace all batch folders written so far by one of the last values, so that a look reads no long history.

    Call it between batches (the stream stopped, or from its ``foreachBatch``). The view is written next to the batches
    first and they are removed afterwards: where this is cut short, some rows stand twice and the view is the same.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(location)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    if len(old) < 2:
        return
    number = max(int(p.getName().split("=")[1].split("-")[0]) for p in old)
    _last_values(spark.read.parquet(location)).write.parquet(f"{location}/batch={number}-{uuid.uuid4().hex}")
    for path in old:
        files.delete(path, True)


def _last_values(changes: DataFrame) -> DataFrame:
    """A maximum of structs sorts its rows, so they are dealt to partitions of bounded size first."""
    return dealt(changes.select("run_uuid", "key", "last"), ["run_uuid", "key"]).groupBy("run_uuid", "key").agg(F.max("last").alias("last"))


def current_latest_metrics(spark: SparkSession, location: str) -> DataFrame:
    """The standing view: the highest (step, ts, value) written for each (run, key); no rows before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(location)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "run_uuid string, key string, value double")
    best = _last_values(spark.read.parquet(location))
    return best.select("run_uuid", "key", F.col("last.value").alias("value"))
