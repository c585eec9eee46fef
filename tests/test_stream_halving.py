import random
import shutil

import pytest
from pyspark.sql import functions as F

from runquarry.operators.sweeps import halving_survivors
from runquarry.streaming.halving import compact_log, current_decisions, start_halving

LOG = "study int, trial bigint, step bigint, value double"


def _log(seed=2, trials=60):
    rng = random.Random(seed)
    rows = [(s, t, step, float(rng.randrange(9))) for s in (1, None) for t in range(trials) for step in range(1, rng.randrange(2, 30))]
    rng.shuffle(rows)
    return rows


def _rows(df):
    return sorted(map(tuple, df.select("study", "trial", "rung", "value", "survived").collect()), key=str)


@pytest.mark.parametrize("factor, first", [(2, 1), (3, 2), (4, 10)])
def test_compact_log_decides_the_same(spark, factor, first):
    log = spark.createDataFrame(_log(), LOG)
    small = compact_log(log, ["study"], factor, first)
    assert small.count() < log.count() / 2
    assert _rows(halving_survivors(small, ["study"], "maximize", factor, first)) == _rows(halving_survivors(log, ["study"], "maximize", factor, first))
    parts = [compact_log(log.where(f"trial % 3 = {i}" if i < 2 else "trial % 3 = 2"), ["study"], factor, first) for i in range(3)]
    again = compact_log(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["study"], factor, first)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


def test_stream_and_restart(spark, tmp_path):
    rows, source, out = _log(), f"{tmp_path}/log", f"{tmp_path}/out"
    with pytest.raises(ValueError, match="no batch"):
        current_decisions(spark, out)

    def follow():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        query = start_halving(stream, out, f"{tmp_path}/mark", ["study"], "minimize", 2, 2)
        query.awaitTermination()
        return query

    cut = len(rows) // 3
    for i in range(3):
        part = rows[i * cut:(i + 1) * cut] if i < 2 else rows[i * cut:]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        follow()
        so_far = spark.createDataFrame(rows[:(i + 1) * cut] if i < 2 else rows, LOG)
        assert _rows(current_decisions(spark, out)) == _rows(halving_survivors(so_far, ["study"], "minimize", 2, 2))
        if i == 1:  # the last batch was decided but not committed: it is run again
            for name in ("commits/1", "commits/.1.crc"):
                (tmp_path / "mark" / name).unlink(missing_ok=True)
            shutil.rmtree(tmp_path / "out/decisions/batch=1")
            follow()
            assert _rows(current_decisions(spark, out)) == _rows(halving_survivors(so_far, ["study"], "minimize", 2, 2))


def test_the_metric_stream_keeps_no_state(spark, tmp_path):
    from runquarry.operators.runs import latest_metrics
    from runquarry.streaming import current_latest_metrics, fold_latest_metrics, start_latest_metrics

    schema, rng, all_rows = "run_uuid string, key string, value double, step bigint, ts timestamp_ntz", random.Random(4), None
    for i in range(3):
        rows = [(f"r{rng.randrange(20)}", rng.choice("ab"), rng.random(), rng.randrange(50)) for _ in range(200)]
        part = spark.createDataFrame(rows, "run_uuid string, key string, value double, step bigint").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        all_rows = part if all_rows is None else all_rows.unionByName(part)
        query = start_latest_metrics(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/mark")
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
        if i == 1:
            fold_latest_metrics(spark, f"{tmp_path}/out")
        view = {(r["run_uuid"], r["key"]): r["value"] for r in current_latest_metrics(spark, f"{tmp_path}/out").collect()}
        assert view == {(r["run_uuid"], r["key"]): r["value"] for r in latest_metrics(all_rows).collect()}
