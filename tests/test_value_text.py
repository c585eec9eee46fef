import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from runquarry.functions.hashing import hash_key
from runquarry.functions.text import column_text
from runquarry.operators import grid as G, runlog as L, runs as R, sweeps as W
from runquarry.plans.fixtures import Tables


def test_doubles_read_as_python_writes_them(spark):
    rng = random.Random(6)
    values = [0.0, -0.0, 1.0, 0.001, 0.0001, 1e-05, 123456.789, 1e7, 12345678.0, 1e15, 1e16, -1e16, 1.5e300, 5e-324, 1.7976931348623157e308, 2.0**-44, 2e23, 8.41e21, 1e23, 0.1 + 0.2,
              math.inf, -math.inf, math.nan, 9999999.999999998, 1e22, 123456789012345680.0, 9.999999999999999e22]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-8, 20) for _ in range(3000)]
    values += [round(rng.uniform(0, 1), rng.randrange(1, 17)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r["t"] for r in df.select(column_text(df, "x").alias("t")).collect()]
    assert all(t == "None" if v is None else math.isnan(v) and t == "nan" or float(t) == v for v, t in zip([*values, None], got))
    wrong = [(v, t) for v, t in zip([*values, None], got) if t != str(v)]
    few = [v for v, _ in wrong if len(repr(v).split("e")[0].replace(".", "").strip("-0")) < 16]
    # Java before 19 does not always write the nearest of several texts of 16 or 17 digits
    assert not few and len(wrong) < len(values) / 100, (len(wrong), wrong[:5], few)


def test_other_values(spark):
    df = spark.createDataFrame([(True, 3, "x", 0.5), (False, -3, "", 0.1), (None, None, None, None)], "b boolean, i int, s string, f float")
    got = [tuple(r) for r in df.select(*[column_text(df, c).alias(c) for c in df.columns]).collect()]
    assert got == [("True", "3", "x", "0.5"), ("False", "-3", "", "0.10000000149011612"), ("None", "None", "None", "None")]
    assert df.select(column_text(df, "b", none=None).alias("b")).where("b IS NULL").count() == 1


RUN = "run_uuid string, experiment_id int, status string, lifecycle_stage string, start_time timestamp"


@pytest.fixture()
def store(spark):
    combos = [("r1", {"lr": 0.0001, "warm": True, "depth": 3, "note": None}), ("r2", {"lr": 25000000.0, "warm": False, "depth": 4, "note": "n"})]
    runs = spark.createDataFrame([(r, 1, "FINISHED", "active", None) for r, _ in combos], RUN)
    documents = spark.createDataFrame([(r, json.dumps(c)) for r, c in combos], "run_uuid string, combination string")
    return {"runs": runs, "params": L.log_start_params(documents, ["combination"]),
            "tags": runs.select("run_uuid", F.lit("raised_exception").alias("key"), F.lit("False").alias("value")),
            "experiments": spark.createDataFrame([(1, "e", "active")], "experiment_id int, name string, lifecycle_stage string")}, combos


def test_look_ups_agree_with_what_was_logged(spark, store):
    store, combos = store
    names = ["lr", "warm", "depth", "note"]
    wanted = spark.createDataFrame([(0.0001, True, 3, None), (25000000.0, False, 4, "n"), (0.0001, False, 3, None), (0.0001, True, 3, "n")], "lr double, warm boolean, depth int, note string")
    pending = G.pending_combinations(store, wanted, names)
    assert sorted(map(tuple, pending.select(*names).collect()), key=str) == [(0.0001, False, 3, None), (0.0001, True, 3, "n")]
    for run, params in combos:  # the look-up of a single combination
        assert R.find_existing_run(store, "e", params).first()["run_uuid"] == run
    # an integer's text is no double's, whichever way it is looked up
    other = wanted.withColumn("depth", F.col("depth").cast("double"))
    assert G.pending_combinations(store, other, names).count() == 4 and R.find_existing_run(store, "e", {"depth": 3.0}).isEmpty()


def test_hash_and_trial_key(spark):
    import hashlib

    df = spark.createDataFrame([(True, 0.0001, None, 1)], "b boolean, x double, s string, trial bigint")
    assert df.select(L.run_hash(["b", "x", "s"], df)).first()[0] == hashlib.sha256(b"b_True_x_0.0001_s_None").hexdigest()[:10]
    assert W.trial_seeds_keys(df, ["b", "x", "s"]).first()["trial_key"] == "True_0.0001_None-1"


def test_parts_of_a_hash_are_told_apart(spark):
    rows = [("a", None), (None, "a"), ("a:b", "c"), ("a", "b:c"), ("a\\", ":b"), ("a\\:", "b"), (None, None), ("\\N", None), ("", "")]
    df = spark.createDataFrame(rows, "p string, q string")
    assert df.select(hash_key(1, F.col("p"), F.col("q")).alias("h")).distinct().count() == len(rows)
    assert spark.range(1).select(hash_key("s", F.lit("a"), F.lit(3)).alias("h")).first()["h"] == hashlib_md5("s:a:3")


def hashlib_md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def test_null_is_a_value_of_a_combination(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (1, 2, "a"), (None, None, "a"), (None, None, "b"), (3, 3, "b")], "x int, y int, s string")
    common = G.common_combinations(df, "s", ["x", "y"])
    assert sorted(map(tuple, common.collect()), key=str) == [(1, None), (None, None)]
    assert G.filter_combinations(df, ["x", "y"], common).count() == 4
    assert G.missing_entries(df, ["x", "y"], common).isEmpty()
    want = spark.createDataFrame([(None, 2), (3, None), (1, None)], "x int, y int")
    assert sorted(map(tuple, G.missing_entries(df, ["x", "y"], want).collect()), key=str) == [(3, None), (None, 2)]


def test_a_null_study_has_its_own_trials(spark):
    defaults = spark.createDataFrame([(None, 0, "d"), (1, 0, "d")], "study int, trial bigint, origin string")
    sampled = spark.createDataFrame([(s, i, "s") for s in (None, 1, 2) for i in range(5)], "study int, trial bigint, origin string")
    queue = W.candidate_queue(defaults, sampled, 4, ["study"]).collect()
    for study in (None, 1, 2):
        mine = sorted((r["trial"], r["origin"]) for r in queue if r["study"] == study)
        assert [t for t, _ in mine] == [0, 1, 2, 3] and [o for _, o in mine].count("d") == (study != 2)


def test_fixture_store_still_matches(spark):
    t = Tables.of(spark, "/root/testdata/sf0.001")
    assert G.pending_combinations(t.store, t["params"].where("key = 'fold'").select(F.col("value").alias("fold")).distinct(), ["fold"]).isEmpty()
