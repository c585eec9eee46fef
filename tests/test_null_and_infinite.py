"""NULL, NaN and infinite keys and values give the same at every size."""

import pytest
from pyspark.sql import functions as F

from runquarry.operators import nested, preprocess, runs, split, sweeps
from runquarry.streaming import latest


def test_quantiles_with_infinities(spark):
    rows = [(float(i), float("inf") if i > 95 else float(i)) for i in range(100)] + [(float("-inf"), None), (float("inf"), float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double")
    asked = {"a": [0.0, 0.25, 0.5, 1.0], "b": [0.5, 0.9, 1.0]}
    inf, got = float("inf"), preprocess.exact_quantiles(df, asked)
    assert got["a"] == [-inf, 24.25, 49.5, inf] and got["b"] == pytest.approx([49.5, 89.1, inf])


def test_nan_is_no_category(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (1.0,)], "x double")
    assert [r["category"] for r in preprocess.category_counts(df, ["x"]).collect()] == ["1.0"]


def test_stratified_split_of_a_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id int, c string")
    test = split.assign_split(df, "id", 0.2, stratify="c").where("is_test")
    assert test.count() == 20 and test.where("c is null").count() == 10


def test_null_study(spark):
    trials = spark.createDataFrame([(None, i, 1.0) for i in range(6)] + [("s", i, 1.0) for i in range(6)], "study string, trial int, elapsed double")
    assert sweeps.effective_trials(trials, ["study"], 2.0).groupBy("study").count().select("count").distinct().count() == 1
    log = trials.select("study", "trial", F.lit(1).alias("step"), F.col("trial").cast("double").alias("value"))
    alive = sweeps.halving_survivors(log, ["study"], reduction_factor=2, min_resource=1).where("survived")
    assert sorted((r["study"] or "", r["trial"]) for r in alive.collect()) == [("", 3), ("", 4), ("", 5), ("s", 3), ("s", 4), ("s", 5)]


def test_leaf_without_path_moves_nothing(spark):
    df = spark.createDataFrame([(1, "a", "1"), (1, None, "9"), (1, "b", "2")], "id int, path string, value string")
    assert nested.unflatten_params(df, ["id"]).first()["document"] == '{"a":1,"b":2}'


def test_existing_run_by_nested_arguments(spark):
    store = {"experiments": spark.createDataFrame([(1, "e")], "experiment_id int, name string"),
             "runs": spark.createDataFrame([("r", 1, "FINISHED", None)], "run_uuid string, experiment_id int, status string, start_time timestamp"),
             "tags": spark.createDataFrame([("r", "raised_exception", "False")], "run_uuid string, key string, value string"),
             "params": spark.createDataFrame([("r", "opt/lr", "0.1"), ("r", "sizes/item_0", "3")], "run_uuid string, key string, value string")}
    assert runs.find_existing_run(store, "e", {"opt": {"lr": 0.1}, "sizes": [3]}).count() == 1
    assert runs.find_existing_run(store, "e", {"opt": {"lr": 0.2}}).count() == 0


def test_folded_view_is_the_same(spark, tmp_path):
    rows = f"{tmp_path}/rows"
    assert latest.current_latest_metrics(spark, rows).isEmpty()
    latest.fold_latest_metrics(spark, rows)
    for batch, (step, value) in enumerate([(1, 5.0), (3, 7.0), (2, 9.0)]):
        last = F.struct(F.lit(step).alias("step"), F.lit(0).alias("ts"), F.lit(value).alias("value"))
        spark.range(2).select(F.concat(F.lit("r"), "id").alias("run_uuid"), F.lit("k").alias("key"), last.alias("last")).write.parquet(f"{rows}/batch={batch}")
    before = sorted(map(tuple, latest.current_latest_metrics(spark, rows).collect()))
    latest.fold_latest_metrics(spark, rows)
    assert before == sorted(map(tuple, latest.current_latest_metrics(spark, rows).collect())) == [("r0", "k", 7.0), ("r1", "k", 7.0)]
    assert len([p for p in (tmp_path / "rows").iterdir() if not p.name.startswith((".", "_"))]) == 1
