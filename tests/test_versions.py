import json

import pytest
from pyspark.sql import functions as F

from runquarry.functions.keyfilter import KeyFilter, known_rows, possible_hits
from runquarry.operators import merge as M
from runquarry.sources.versions import ConflictingCommit, VersionedStore

EXP = "experiment_id int, name string, lifecycle_stage string"
RUN = "run_uuid string, experiment_id int, status string, lifecycle_stage string"
EAV = "run_uuid string, key string, value string"


@pytest.fixture()
def stores(spark):
    target = {"experiments": spark.createDataFrame([(3, "both", "active"), (4, "old", "deleted")], EXP),
              "runs": spark.createDataFrame([("r1", 3, "FINISHED", "active"), ("r9", 3, "FINISHED", "deleted")], RUN),
              "params": spark.createDataFrame([("r1", "k", "v"), ("r9", "k", "v")], EAV)}
    source = {"experiments": spark.createDataFrame([(1, "zeta", "active"), (2, "both", "active")], EXP),
              "runs": spark.createDataFrame([("r1", 2, "FAILED", "active"), ("r2", 1, "FINISHED", "active"), ("r3", 77, "FINISHED", "active"), ("r4", None, "FINISHED", "active")], RUN),
              "params": spark.createDataFrame([("r1", "k2", "v"), ("r2", "k", "w")], EAV)}
    return target, source


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_and_clean_up_are_versions(spark, stores, tmp_path):
    target, source = stores
    store = VersionedStore(spark, str(tmp_path / "store"))
    assert store.version() == 0 and list(store.read()) == []
    assert store.append(target) == 1
    version, errors = store.merge({"u": source}, try_to_insert_new=True)
    assert version == 2
    assert _rows(errors) == [("u", "table runs: rows of unknown experiments are left out: 77 (1 rows)")]
    assert _rows(store.read()["runs"].select("run_uuid", "experiment_id")) == [("r1", 3), ("r2", 5), ("r4", None), ("r9", 3)]
    assert store.merge({"u": source}, try_to_insert_new=True)[0] == 2  # once more is the same as once
    assert _rows(store.read()["params"]) == [("r1", "k", "v"), ("r2", "k", "w"), ("r9", "k", "v")]
    assert store.collect_garbage() == 3
    assert _rows(store.read()["params"]) == [("r1", "k", "v"), ("r2", "k", "w")]
    assert {r["name"] for r in store.read()["experiments"].collect()} == {"both", "zeta"}
    assert store.collect_garbage() == 3
    assert store.read(1)["params"].count() == 2 and store.read(2)["experiments"].count() == 3


def test_a_crash_between_tables_leaves_the_old_version(spark, stores, tmp_path, monkeypatch):
    target, source = stores
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.append(target)
    before = {n: _rows(df) for n, df in store.read().items()}
    write = VersionedStore._write

    def dies(self, table, df):
        if table == "params":
            raise OSError("lost the node")
        return write(self, table, df)

    monkeypatch.setattr(VersionedStore, "_write", dies)
    version, errors = store.merge({"u": source}, try_to_insert_new=True)
    assert version == 1 and "lost the node" in errors.first()["error"]
    with pytest.raises(OSError):
        store.append(source)
    with pytest.raises(OSError):
        store.collect_garbage()
    monkeypatch.undo()
    assert {n: _rows(df) for n, df in store.read().items()} == before
    assert store.vacuum(hours=0) > 0  # what the failed attempts have left behind
    assert {n: _rows(df) for n, df in store.read().items()} == before


def test_concurrent_commits(spark, stores, tmp_path):
    target, source = stores
    one, other = (VersionedStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.append(target)
    base, seen = one._manifest(1), one.version()
    other.append({"params": spark.createDataFrame([("r8", "k", "v")], EAV)})
    with pytest.raises(ConflictingCommit):
        one._commit(seen, {"tables": base["tables"], "applied": {}})
    # the rename itself does not replace a manifest that came in between the look and the rename
    one.version = lambda: seen
    with pytest.raises(Exception):
        one._commit(seen, {"tables": {}, "applied": {}})
    assert other.read()["params"].count() == 3 and json.loads((tmp_path / "store/manifests/0000000002.json").read_text())["version"] == 2
    # an append follows what others have committed
    again = VersionedStore(spark, str(tmp_path / "store"))
    again.append({"params": spark.createDataFrame([("r7", "k", "v")], EAV)})
    assert again.read()["params"].count() == 4


def test_repeated_appends(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    rows = lambda *ids: {"params": spark.createDataFrame([(i, "k", "v") for i in ids], EAV)}
    for writer, batch, ids in (("a", 0, "x"), ("a", 0, "x"), ("b", 0, "y"), ("a", 1, "z"), ("a", 0, "x"), ("a", 1, "z")):
        store.append(rows(ids), writer=writer, batch=batch)
    assert [r["run_uuid"] for r in store.read()["params"].orderBy("run_uuid").collect()] == ["x", "y", "z"] and store.version() == 3
    store.append({"params": spark.createDataFrame([("w", 1)], "run_uuid string, extra int")})  # another column
    assert _rows(store.read()["params"].where("run_uuid in ('w', 'x')")) == [("w", None, None, 1), ("x", "k", "v", None)]
    with pytest.raises(Exception, match="extra is integer"):
        store.append({"params": spark.createDataFrame([("w", "1")], "run_uuid string, extra string")})


def test_vacuum_keeps_what_versions_name(spark, stores, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.append(stores[0])
    store.collect_garbage()
    assert store.vacuum(keep=2, hours=0) == 0 and store.read(1)["runs"].count() == 2
    assert store.vacuum(keep=1, hours=24) == 0
    assert store.vacuum(keep=1, hours=0) == 3
    assert store.read()["runs"].count() == 1 and store.version() == 2


def test_key_filter(spark):
    source = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("j"))
    target = spark.range(4000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("j"), F.lit(1).alias("x"))
    nulls = spark.createDataFrame([(None, 1), ("0", None)], "k string, j bigint")
    for words in (16, 64, 4096):
        passed = KeyFilter.of(source, ["k", "j"], words).maybe(target)
        found = {r["k"] for r in passed.collect()}
        assert {str(i) for i in range(0, 4000, 2)} <= found and passed.columns == target.columns
        # the smaller the filter, the more passes wrongly
        assert (len(found) == 4000) == (words == 16) and len(found) < (2050 if words == 4096 else 4001)
    parts = [KeyFilter.of(source.where(f"j = {i}"), ["k", "j"], 4096) for i in range(3)]
    joined = parts[0].merged(parts[1]).merged(parts[2])
    assert _rows(joined.table) == _rows(KeyFilter.of(source, ["k", "j"], 4096).table)
    with pytest.raises(ValueError):
        parts[0].merged(KeyFilter.of(source, ["k", "j"], 64))
    both = source.unionByName(nulls)
    want = _rows(both.join(target.select("k", "j").distinct(), ["k", "j"], "left_semi"))
    fresh = _rows(both.join(target.select("k", "j").distinct(), ["k", "j"], "left_anti"))
    for limits in ({}, {"max_local": 10}, {"max_local": 10, "max_words": 1}):
        assert _rows(known_rows(both, target, ["k", "j"], **limits)) == want
        assert _rows(known_rows(both, target, ["k", "j"], known=False, **limits)) == fresh
    longer = source.withColumn("j", F.col("j").cast("int"))  # a key of another type is compared, not hashed
    assert known_rows(longer, target, ["k", "j"], max_local=10).count() == 2000
    # a filter that lets everything pass changes no result
    assert _rows(source.join(KeyFilter.of(source, ["k"], 1).maybe(target.select("k")), ["k"], "left_semi")) == _rows(source)


def test_a_small_source_does_not_shuffle_the_target(spark, tmp_path):
    spark.range(300_000).select(F.col("id").cast("string").alias("run_uuid"), F.lit(1).alias("v")).write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    source = spark.createDataFrame([("5", "a"), ("x", "b")], "run_uuid string, w string")

    def exchanges(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]

    hits = possible_hits(source, target, ["run_uuid"])
    assert hits.count() == 1 and not exchanges(hits)
    filtered = KeyFilter.of(source, ["run_uuid"], 16).maybe(target.select("run_uuid"))
    assert not [x for x in exchanges(filtered) if "_word" not in x]
    assert _rows(M.merge_conflicts(source, target, ["run_uuid"])) == [("5", "a")]
