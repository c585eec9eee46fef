import datetime as dt

import pytest
from pyspark.sql import functions as F

from runquarry.operators import runs as R
from runquarry.sources import append_table, error_report, hex_prefix_predicates, read_run_store, search_runs, sql_source

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def store(spark):
    runs = spark.createDataFrame(
        [("a", 1, "FINISHED", "active", T0), ("b", 1, "FINISHED", "active", T0 + dt.timedelta(1)), ("c", 2, "FAILED", "active", T0),
         ("d", None, "FINISHED", "active", T0)],
        "run_uuid string, experiment_id int, status string, lifecycle_stage string, start_time timestamp_ntz")
    experiments = spark.createDataFrame([(1, "one", "active"), (2, "two", "deleted")], "experiment_id int, name string, lifecycle_stage string")
    params = spark.createDataFrame([("a", "m", "x"), ("a", "s", "1"), ("b", "m", "x"), ("b", "s", "1"), ("c", "m", "y")],
                                   "run_uuid string, key string, value string")
    metrics = spark.createDataFrame(
        [("a", "rmse", 1.0, 0, T0), ("a", "rmse", 3.0, 1, T0), ("a", "rmse", 2.0, 1, T0), ("a", "rmse", 0.5, 1, T0 - dt.timedelta(1)), ("b", "r2", 9.0, 0, T0)],
        "run_uuid string, key string, value double, step bigint, ts timestamp_ntz")
    tags = spark.createDataFrame([("a", "raised_exception", "False"), ("b", "raised_exception", "False"), ("c", "raised_exception", "True"),
                                  ("a", "child_run_id_10", "k10"), ("a", "child_run_id_2", "k2")], "run_uuid string, key string, value string")
    return {"runs": runs, "experiments": experiments, "params": params, "metrics": metrics, "tags": tags}


def test_pivot_drops_runs_without_the_keys_and_keeps_absent_columns(store):
    columns = ["status"]
    rows = {r["run_uuid"]: r for r in R.query_runs(store, columns, other_table="params", other_table_keys=["s", "nowhere"]).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["s"] == "1" and rows["a"]["nowhere"] is None
    assert columns == ["status"]  # the caller's list is left alone


def test_a_repeated_key_is_an_error(store):
    twice = {**store, "params": store["params"].unionByName(store["params"].where("run_uuid = 'a' AND key = 'm'"))}
    with pytest.raises(Exception, match="duplicate entry for key m in a"):
        R.query_runs(twice, [], other_table="params", other_table_keys=["m"]).collect()


def test_key_step_cells_keep_the_latest(store):
    row = R.query_runs(store, ["status"], other_table="metrics", other_table_keys=["rmse"]).first()
    assert (row["rmse@0"], row["rmse@1"]) == (1.0, 3.0)


def test_names_need_no_quoting(store):
    assert R.query_runs(store, [], experiments_names=["o'ne"]).count() == 0
    assert R.query_runs(store, [], experiments_names=["one"]).count() == 2


def test_without_names_all_runs_stay(store):
    rows = R.query_runs(store, ["run_uuid"], experiments_columns=["name"]).collect()
    assert {r["run_uuid"]: r["name"] for r in rows} == {"a": "one", "b": "one", "c": "two", "d": None}


def test_same_named_experiment_column_and_missing_step(spark, store):
    rows = {r["run_uuid"]: r for r in R.query_runs(store, ["run_uuid", "lifecycle_stage"], experiments_columns=["lifecycle_stage"]).collect()}
    assert (rows["c"]["lifecycle_stage"], rows["c"]["experiments.lifecycle_stage"]) == ("active", "deleted")
    metrics = store["metrics"].unionByName(store["metrics"].limit(1).withColumn("step", F.lit(None).cast("bigint")))
    wide = R.query_runs({**store, "metrics": metrics}, ["status"], other_table="metrics", other_table_keys=["rmse"])
    assert wide.columns == ["status", "run_uuid", "rmse@0", "rmse@1"]
    with pytest.raises(ValueError, match="too many"):
        R.query_runs(store, ["status"], other_table="metrics", other_table_keys=["rmse"], max_columns=1)


def test_unknown_table(store):
    with pytest.raises(ValueError):
        R.query_runs(store, [], other_table="nope")


def test_latest_metrics(store):
    assert {(r["run_uuid"], r["key"]): r["value"] for r in R.latest_metrics(store["metrics"]).collect()} == {("a", "rmse"): 3.0, ("b", "r2"): 9.0}


def test_existing_run_is_the_newest_that_matches_all_pairs(store):
    assert R.find_existing_run(store, "one", {"m": "x", "s": 1}).first()["run_uuid"] == "b"
    assert R.find_existing_run(store, "one", {"m": "x", "s": 2}).first() is None
    assert R.find_existing_run(store, "two", {"m": "y"}).first() is None  # it failed


def test_match_existing_runs(spark, store):
    wanted = spark.createDataFrame([(0, "x", 1), (1, "x", 2)], "position int, m string, s int")
    assert [tuple(r) for r in R.match_existing_runs(store, wanted, "position", ["m", "s"]).collect()] == [(0, "b")]


def test_copied_results_carry_the_link(spark, store):
    out = R.copy_cached_results(store, spark.createDataFrame([("n", "a")], "new_run string, old_run string"))
    assert out["params"].count() == 2 and out["metrics"].count() == 4
    assert out["tags"].where("key = 'existent_run_id'").first()["value"] == "a"
    assert [tuple(r) for r in out["runs"].collect()] == [("n", "FINISHED")]


def test_children_are_ordered_by_number(store):
    assert [r["child_run"] for r in R.child_runs(store["tags"], "a").collect()] == ["k2", "k10"]


def test_search_runs_finds_the_keys_itself(store):
    wide = search_runs(store)
    assert {"params.m", "params.s", "metrics.rmse", "metrics.r2", "tags.raised_exception"} <= set(wide.columns)
    assert wide.count() == 4


def test_store_round_trip_and_lists(spark, store, tmp_path):
    for name, df in {**store, "alembic_version": store["tags"]}.items():
        df.write.parquet(f"{tmp_path}/{name}")
    found = read_run_store(spark, str(tmp_path))
    assert list(found) == ["experiments", "runs", "params", "tags", "metrics"]
    store["tags"].write.parquet(f"{tmp_path}/notes.parquet")
    assert list(read_run_store(spark, str(tmp_path)))[-1] == "notes"
    assert {r["table_name"]: r["n_rows"] for r in found.row_counts().collect()}["metrics"] == 5
    assert list(read_run_store(spark, str(tmp_path), tables=["params", "runs"], exclude_tables=["runs"])) == ["params"]
    assert "start_time" in found["runs"].columns  # unknown columns are kept


def test_jdbc_predicates_cover_every_id():
    parts = hex_prefix_predicates(digits=1)
    assert len(parts) == 16 and parts[0] == "run_uuid < '1' OR run_uuid IS NULL" and parts[-1] == "run_uuid >= 'f'"
    assert parts[1] == "run_uuid >= '1' AND run_uuid < '2'"


def test_sql_source(spark, store):
    assert sql_source(spark, "SELECT count(*) AS n FROM {runs}", store).first()["n"] == 4


def test_append_and_error_report(spark, store, tmp_path):
    path = f"{tmp_path}/t"
    append_table(store["params"], path)
    assert append_table(store["params"], path).count() == 10
    errors = spark.createDataFrame([("u", 'it said "no", twice')], "db1_url string, error string")
    assert [tuple(r) for r in error_report(errors, f"{tmp_path}/e").collect()] == [("u", 'it said "no", twice')]


def test_key_filter_reaches_the_scan(spark, store, tmp_path):
    store["params"].write.parquet(f"{tmp_path}/p")
    wide = R.pivot_keys(spark.read.parquet(f"{tmp_path}/p"), ["m"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,m)]" in plan or "PushedFilters: [In(key, [m])" in plan
    assert plan.count("Exchange hashpartitioning") == 1
