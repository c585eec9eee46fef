import pytest
from pyspark.sql import functions as F

from runquarry.operators import merge as M
from runquarry.schemas import PRIMARY_KEYS

EXP = "experiment_id int, name string, lifecycle_stage string"
RUN = "run_uuid string, experiment_id int, status string, lifecycle_stage string"
EAV = "run_uuid string, key string, value string"


@pytest.fixture()
def stores(spark):
    target = {"experiments": spark.createDataFrame([(3, "both", "active"), (7, "only_target", "active")], EXP),
              "runs": spark.createDataFrame([("r1", 3, "FINISHED", "active")], RUN),
              "params": spark.createDataFrame([("r1", "k", "v")], EAV)}
    source = {"experiments": spark.createDataFrame([(1, "zeta", "active"), (2, "both", "active"), (9, "alpha", "active")], EXP),
              "runs": spark.createDataFrame([("r1", 2, "FAILED", "active"), ("r2", 1, "FINISHED", "active"), ("r3", 9, "FINISHED", "active")], RUN),
              "params": spark.createDataFrame([("r1", "k2", "v"), ("r2", "k", "w")], EAV)}
    return target, source


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ids(stores):
    target, source = stores
    assert _rows(M.experiment_id_map(source["experiments"], target["experiments"])) == [(2, 3)]
    assert _rows(M.allocate_experiment_ids(source["experiments"], target["experiments"])) == [(1, 9, "zeta"), (9, 8, "alpha")]
    assert _rows(M.merge_experiments(source["experiments"], target["experiments"]).select("experiment_id", "name")) == [
        (3, "both"), (7, "only_target"), (8, "alpha"), (9, "zeta")]


def test_empty_target_starts_at_one(stores):
    target, source = stores
    ids = M.allocate_experiment_ids(source["experiments"], target["experiments"].where("false"))
    assert _rows(ids.select("name", "new_experiment_id")) == [("alpha", 1), ("both", 2), ("zeta", 3)]


def test_conflicts_and_insert_new(stores):
    target, source = stores
    assert _rows(M.merge_conflicts(source["runs"], target["runs"], PRIMARY_KEYS["runs"]).select("run_uuid")) == [("r1",)]
    once = M.merge_insert_new(source["runs"], target["runs"])
    assert _rows(once.select("run_uuid", "status")) == [("r1", "FINISHED"), ("r2", "FINISHED"), ("r3", "FINISHED")]
    assert _rows(M.merge_insert_new(source["runs"], once)) == _rows(once)
    # new rows of a known run are left out by default and kept with the whole key
    assert M.merge_insert_new(source["params"], target["params"]).count() == 2
    assert M.merge_insert_new(source["params"], target["params"], PRIMARY_KEYS["params"]).count() == 3
    with pytest.raises(ValueError, match="run_uuid"):
        M.merge_insert_new(source["experiments"], target["experiments"])


def test_merge_stores(spark, stores):
    target, source = stores

    def lost():
        raise OSError("gone")

    merged, errors = M.merge_stores(spark, target, {"u0": lost, "u1": source}, try_to_insert_new=True)
    assert _rows(merged["runs"].select("run_uuid", "experiment_id")) == [("r1", 3), ("r2", 9), ("r3", 8)]
    assert [tuple(r) for r in errors.collect()] == [("u0", "OSError: gone")]
    again, errors = M.merge_stores(spark, merged, {"u1": source}, try_to_insert_new=True)
    assert {n: _rows(df) for n, df in again.items()} == {n: _rows(df) for n, df in merged.items()} and errors.isEmpty()


def test_a_conflict_leaves_the_table_out_and_is_reported(spark, stores):
    target, source = stores
    merged, errors = M.merge_stores(spark, target, {"u1": source})
    assert merged["runs"].count() == 1 and merged["params"].count() == 3  # params have no conflicting key
    assert [r["error"] for r in errors.collect()] == ["table runs: some keys already exist in the target"]


def test_two_sources_see_each_other(spark, stores):
    target, source = stores
    other = {"experiments": source["experiments"].where("name = 'zeta'").selectExpr("50 as experiment_id", "name", "lifecycle_stage"),
             "runs": spark.createDataFrame([("r9", 50, "FINISHED", "active")], RUN)}
    merged, _ = M.merge_stores(spark, target, {"u1": source, "u2": other}, try_to_insert_new=True)
    assert merged["experiments"].where("name = 'zeta'").count() == 1
    assert merged["runs"].where("run_uuid = 'r9'").first()["experiment_id"] == 9


def test_every_source_adds_one_fixed_part(spark, stores):
    target, source = stores

    def scans(n):
        more = {f"u{i}": {name: df.withColumn("run_uuid", F.concat(F.col("run_uuid"), F.lit(f"-{i}"))) if "run_uuid" in df.columns else df for name, df in source.items()}
                for i in range(n)}
        merged, errors = M.merge_stores(spark, target, more, try_to_insert_new=True)
        assert errors.isEmpty() and merged["runs"].count() == 1 + 3 * n
        return merged["runs"]._jdf.queryExecution().executedPlan().toString().count("Scan")

    one, two, three = (scans(n) for n in (1, 2, 3))
    assert two - one == three - two <= 1


def test_gc(spark):
    store = {"experiments": spark.createDataFrame([(1, "a", "active"), (2, "b", "deleted"), (3, "c", None)], EXP),
             "experiment_tags": spark.createDataFrame([(1, "k", "v"), (2, "k", "v"), (5, "k", "v")], "experiment_id int, key string, value string"),
             "runs": spark.createDataFrame([("x", 1, "FINISHED", "deleted"), ("y", 2, "FINISHED", "active"), ("z", 1, "FINISHED", None)], RUN),
             "params": spark.createDataFrame([("x", "k", "v"), ("y", "k", "v"), ("stray", "k", "v"), (None, "k", "v")], EAV)}
    clean = M.gc_store(store)
    assert _rows(clean["experiments"].select("experiment_id")) == [(1,), (3,)]
    assert _rows(clean["experiment_tags"].select("experiment_id")) == [(1,), (5,)]
    assert _rows(clean["runs"].select("run_uuid")) == [("y",), ("z",)]  # an active run of a deleted experiment stays
    assert sorted(str(r[0]) for r in clean["params"].select("run_uuid").collect()) == ["None", "stray", "y"]
    twice = M.gc_store(clean)
    assert all(sorted(map(str, twice[n].collect())) == sorted(map(str, clean[n].collect())) for n in store)


def _parts(spark, runs):
    return runs.selectExpr("concat('run-', id) AS run_uuid", "explode(array('a', 'b')) AS key").selectExpr("*", "'v' AS value")


def test_many_runs_travel_as_runs(spark, monkeypatch):
    """Beyond the bound only one row per run is compared: a source that is all new is not shuffled, a known one adds nothing."""
    monkeypatch.setattr(M, "bounded", lambda df, *_: df)
    monkeypatch.setattr(M, "MAX_BROADCAST_ROWS", 0)
    old, new, both = _parts(spark, spark.range(0, 300)), _parts(spark, spark.range(300, 500)), _parts(spark, spark.range(200, 400))
    odd = spark.createDataFrame([(None, "a", "v"), ("run-1", "c", "v")], "run_uuid string, key string, value string")
    assert M._unknown(new, old, ["run_uuid"]) is new
    assert M._unknown(old, old, ["run_uuid"]).count() == 0
    rows = M._unknown(both.unionByName(odd), old, ["run_uuid"]).collect()
    assert len(rows) == 201 and sum(r["run_uuid"] is None for r in rows) == 1
    keys = ["run_uuid", "key"]
    assert M._has_conflicts(both, old, keys) and not M._has_conflicts(new, old, keys)
    assert not M._has_conflicts(odd, old, keys)  # a known run with another key, and a NULL
    assert M._has_conflicts(_parts(spark, spark.range(299, 301)), old, keys)
