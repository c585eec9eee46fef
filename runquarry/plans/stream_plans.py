"""Streaming view of the metric log."""

from pyspark.sql import functions as F

from runquarry.functions.scale import scratch_path
from runquarry.plans.fixtures import VIEWS
from runquarry.plans.registry import query
from runquarry.plans.sweep_plans import HALVING_SQL
from runquarry.streaming import current_latest_metrics, fold_latest_metrics, start_latest_metrics
from runquarry.streaming.halving import current_decisions, start_halving


@query("stream_latest_metrics", """
SELECT run_uuid, key, value FROM (SELECT *, row_number() OVER (
    PARTITION BY run_uuid, key ORDER BY step DESC, ts DESC, value DESC) AS r FROM metrics) WHERE r = 1""")
def _(t):
    out = scratch_path(t.spark, "latest-metrics")
    for i in range(3):  # three files, so three batches; later ones hold later steps of the same runs
        part = t["lineitem"].where(F.col("l_linenumber") >= 5 if i == 2 else F.col("l_linenumber").between(2 * i + 1, 2 * i + 2))
        part.write.mode("append").parquet(f"{out}/log")
        lines = t.spark.readStream.schema(t["lineitem"].schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/log")
        log = t.spark.sql(VIEWS["metrics"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
        start_latest_metrics(log, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
        if i == 1:
            fold_latest_metrics(t.spark, f"{out}/rows")
    return current_latest_metrics(t.spark, f"{out}/rows").select("run_uuid", "key", F.col("value"))


@query("stream_halving_survivors", HALVING_SQL)
def _(t):
    out = scratch_path(t.spark, "halving")
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_shipdate")
    for i in range(2):  # two batches: early and late steps of the same trials
        lines.where(F.col("l_linenumber") <= 2 if i == 0 else F.col("l_linenumber") > 2).write.mode("append").parquet(f"{out}/log")
        stream = t.spark.readStream.schema(lines.schema).parquet(f"{out}/log")
        metrics = t.spark.sql(VIEWS["metrics"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=stream)
        log = metrics.select(F.col("key").alias("study"), F.expr("cast(replace(run_uuid, 'run-', '') AS bigint)").alias("trial"), "step", "value")
        start_halving(log, f"{out}/halving", f"{out}/checkpoint", ["study"], reduction_factor=2, min_resource=1).awaitTermination()
    return current_decisions(t.spark, f"{out}/halving").select("study", "trial", "rung", "value", "survived")
