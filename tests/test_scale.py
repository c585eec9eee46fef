"""Helpers that cut hot groups give what one window over the group would."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runquarry.functions.hashing import uniform
from runquarry.functions.scale import bounded, distinct_values, explode_range, local_frame, number_rows, running_below


def _skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 50}", rng.choice([rng.gauss(0, 1), 0.5, 1e9 * rng.random()]), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, x double, id bigint")


def test_running_below_equals_window(spark):
    odd = spark.createDataFrame([(None, float("inf"), 1), (None, float("-inf"), 2), (None, 1e12, 3), ("hot", float("nan"), 4), ("hot", float("inf"), 5)],
                                "g string, x double, id bigint")
    d = _skewed(spark).unionByName(odd).groupBy("g", "x").agg(F.count("*").alias("n"))
    got = running_below(d, ["g"], "x", ["n"]).select("g", "x", "below_n", "total_n")
    w = Window.partitionBy("g")
    want = d.select("g", "x", F.coalesce(F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below_n"),
                    F.sum("n").over(w).alias("total_n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.where("g is null").count() == 3


def test_running_below_by_ranges_equals_window(spark):
    d = _skewed(spark).groupBy("g", "x").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    keys = ["g", "x", "below_n", "total_n", "below_s", "total_s"]
    ranges, window = (running_below(d, ["g"], "x", ["n", "s"], few_rows=few).select(*keys) for few in (0, 50_000))
    assert ranges.exceptAll(window).isEmpty() and window.exceptAll(ranges).isEmpty() and window.count() == d.count()


def test_running_below_of_a_constant(spark):
    d = spark.createDataFrame([("a", 1.0, 2), ("b", 5.0, 3)], "g string, x double, n bigint")
    rows = {r["g"]: (r["below_n"], r["total_n"]) for r in running_below(d, ["g"], "x", ["n"]).collect()}
    assert rows == {"a": (0, 2), "b": (0, 3)}


@pytest.mark.parametrize("limit", [10, 10_000])
def test_number_rows_both_ways(spark, limit):
    df = _skewed(spark, 500).select("id")
    rows = number_rows(df, [F.col("id").desc()], single_task_rows=limit).collect()
    assert sorted((r["row_no"], r["id"]) for r in rows) == [(i, 499 - i) for i in range(500)]


def test_explode_range(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 1)], "k string, n int")
    rows = sorted((r["k"], r["i"]) for r in explode_range(df, F.col("n"), "i", chunk=10).collect())
    assert rows == [("a", i) for i in range(25)] + [("c", 0)]


def test_distinct_values_has_a_bound(spark):
    df = spark.range(20).selectExpr("cast(id as string) v")
    assert len(distinct_values(df, "v", limit=20)) == 20
    with pytest.raises(ValueError):
        distinct_values(df, "v", limit=19)


def test_uniform_does_not_depend_on_partitions(spark):
    one = spark.range(0, 100, 1, 1).select("id", uniform(3, F.col("id")).alias("u"))
    many = spark.range(0, 100, 1, 8).select("id", uniform(3, F.col("id")).alias("u"))
    assert one.exceptAll(many).isEmpty()
    assert one.where("u < 0 or u >= 1").isEmpty()
    assert 0.4 < one.agg(F.avg("u")).first()[0] < 0.6


def test_bounded_sides_are_broadcast(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 7)
    side = big.groupBy("k").agg(F.max("id").alias("m"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(big.join(bounded(side), "k")) and "Exchange hashpartitioning" not in plan(big.join(bounded(side), "k"))
    assert bounded(side, max_rows=3) is side
    assert big.join(bounded(side), "k").count() == 1000
    assert local_frame(spark, [], "a string, b int").count() == 0
    assert [tuple(r) for r in local_frame(spark, [("x", None)], "a string, b int").collect()] == [("x", None)]


def test_sorted_aggregates_are_dealt_to_bounded_partitions(spark):
    """A maximum of structs or texts sorts its rows: one task must not get more of them as the table grows."""
    from runquarry.functions.scale import dealt

    rows = spark.range(40_000).selectExpr("concat('run-', id) AS run_uuid", "'k' AS key")
    parts = dealt(rows, ["run_uuid", "key"], rows=1000)
    assert parts.rdd.getNumPartitions() == 40 and max(len(p) for p in parts.rdd.glom().collect()) < 1300
