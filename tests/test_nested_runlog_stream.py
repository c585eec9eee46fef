import json

import pytest
from pyspark.sql import functions as F

from runquarry.operators import nested as N
from runquarry.operators import runlog as L
from runquarry.streaming import current_latest_metrics, start_latest_metrics

DOC = {"a": {"b": 1, "c": [1, {"x": "y", "e": []}, [True]]}, "e": {}, "n": None, "f": 1.5, "s": "é/q"}


def _docs(spark, *docs):
    return spark.createDataFrame([(i, d if d is None else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "id int, document string")


def _flat(df, **options):
    return {r["path"]: r["value"] for r in N.flatten_params(df, ["id"], "document", **options).collect()}


def test_flatten(spark):
    df = _docs(spark, DOC, None)
    assert _flat(df) == {"a/b": "1", "a/c/item_0": "1", "a/c/item_1/x": "y", "a/c/item_2/item_0": "true", "n": None, "f": "1.5", "s": "é/q"}
    assert _flat(df, values="logged")["a/c/item_2/item_0"] == "True" and _flat(df, values="logged")["n"] == "None"
    assert _flat(df, lists=False)["a/c"] == '[1,{"e":[],"x":"y"},[true]]'
    assert _flat(_docs(spark, [3, {"k": 4}])) == {"item_0": "3", "item_1/k": "4"}


def test_deep_documents(spark):
    doc = 1
    for _ in range(200):
        doc = {"k": doc}
    assert _flat(_docs(spark, doc)) == {"/".join("k" * 200): "1"}


@pytest.mark.parametrize("lists", [False, True])
def test_round_trip(spark, lists):
    doc = {"a": {"b": 1, "c": [1, {"x": "y"}]}, "item": {"item_1": 3, "z": [[2.5], "t"]}, "n": None}
    rows = N.flatten_params(_docs(spark, doc, {"only": "1"}), ["id"], "document", lists=lists, values="json")
    back = {r["id"]: json.loads(r["document"]) for r in N.unflatten_params(rows, ["id"], lists=lists).collect()}
    assert back == {0: doc, 1: {"only": "1"}}


def test_lists_in_index_order(spark):
    rows = spark.createDataFrame([(1, f"v/item_{i}", str(i)) for i in range(12)], "id int, path string, value string")
    assert json.loads(N.unflatten_params(rows, ["id"], lists=True).first()["document"]) == {"v": list(range(12))}


def test_leaf_and_prefix_clash(spark):
    rows = spark.createDataFrame([(1, "a", "1"), (1, "a/b", "2")], "id int, path string, value string")
    with pytest.raises(Exception, match="continues a path"):
        N.unflatten_params(rows, ["id"]).collect()


@pytest.mark.parametrize("left, right, want", [
    ({"a": {"b": 1, "c": 2}, "l": [1, 2]}, {"a": {"c": 3}, "l": [9]}, {"a": {"b": 1, "c": 3}, "l": [9]}),
    ({"a": 1}, {"a": {"b": 2}}, {"a": {"b": 2}}),
    ({"a": {"b": 2}}, {"a": 1}, {"a": 1}),
    ({"a": 1}, {}, {"a": 1}), (None, {"x": 1}, {"x": 1}), ({"a": {}}, {"a": {}}, {"a": {}}),
])
def test_deep_merge(spark, left, right, want):
    df = spark.createDataFrame([(left and json.dumps(left), json.dumps(right))], "l string, r string")
    assert json.loads(N.deep_merge_params(df, "l", "r").first()["document"]) == want


def test_log_metrics(spark):
    rows = [("r", "fit_model_return", {"elapsed_time": "1.5", "n": "4"}), ("r", None, {"total_elapsed_time": "9", "max_memory_used_x": "3", "y": "1"}),
            ("r", "evaluate_model_return", {"elapsed_time": "2", "max_memory_used": "7", "acc": "0.5", "ok": "true", "note": "text", "none": None})]
    df = spark.createDataFrame(rows, "run_uuid string, step_name string, payload map<string,string>")
    assert {r["key"]: r["value"] for r in L.log_metrics(df).collect()} == {
        "fit_model_return_elapsed_time": 1.5, "total_elapsed_time": 9.0, "max_memory_used_x": 3.0, "evaluate_model_return_elapsed_time": 2.0,
        "evaluate_model_return_max_memory_used": 7.0, "max_memory_used": 7.0, "acc": 0.5, "ok": 1.0}


def test_changed_params_take_the_next_free_suffix(spark):
    schema = "run_uuid string, key string, value string"
    existing = spark.createDataFrame([("r", "a", "1"), ("r", "a_change_1", "2"), ("r", "a_change_3", "2"), ("r", "b", "1"), ("q", "b", "1"),
                                      ("r", "d", "x")], schema)
    new = spark.createDataFrame([("r", "a", "9"), ("r", "b", "1"), ("r", "c", "5"), ("r", "d", "y"), ("s", "a", "1"), ("r", "a_change_1", "2")], schema)
    added = sorted(tuple(r) for r in L.log_params_with_changes(existing, new).collect())
    assert added == [("r", "a_change_2", "9"), ("r", "c", "5"), ("r", "d_change_1", "y"), ("s", "a", "1")]


def test_outcome_and_steps_and_hash(spark):
    df = spark.createDataFrame([("a", True, None), ("b", False, "boom"), ("c", None, None)], "run_uuid string, finished boolean, exception string")
    status, tags = L.log_outcome(df)
    assert {tuple(r) for r in status.collect()} == {("a", "FINISHED"), ("b", "FAILED")}
    assert {tuple(r) for r in tags.collect()} == {("a", "raised_exception", "False"), ("b", "raised_exception", "True"), ("b", "EXCEPTION", "boom")}
    steps = spark.createDataFrame([("a", "_load", 1), ("a", "_fit", 2)], "run_uuid string, step_name string, step_order int")
    assert L.last_step_finished(steps).first()["value"] == "_fit"
    import hashlib

    row = spark.createDataFrame([("m", 3)], "model string, fold int").select(L.run_hash(["model", "fold"]).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"model_m_fold_3").hexdigest()[:10]


def test_stream_follows_an_append_log(spark, tmp_path):
    schema = "run_uuid string, key string, value double, step bigint, ts timestamp_ntz"
    src, out, mark = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/mark"

    def append(*rows):
        spark.createDataFrame(rows, "run_uuid string, key string, value double, step bigint").withColumn(
            "ts", F.lit("2024-01-01").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)

    def follow():
        start_latest_metrics(spark.readStream.schema(schema).parquet(src), out, mark).awaitTermination()
        return {(r["run_uuid"], r["key"]): r["value"] for r in current_latest_metrics(spark, out).collect()}

    append(("a", "m", 1.0, 1), ("a", "m", 2.0, 2), ("b", "m", 5.0, 1))
    assert follow() == {("a", "m"): 2.0, ("b", "m"): 5.0}
    append(("a", "m", 9.0, 1), ("b", "m", 6.0, 3), ("c", "m", 0.0, 1))  # a late lower step loses
    assert follow() == {("a", "m"): 2.0, ("b", "m"): 6.0, ("c", "m"): 0.0}
    assert follow()[("b", "m")] == 6.0  # nothing new: a restart changes nothing
