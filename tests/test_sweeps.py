import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from runquarry.operators import sweeps as W

SPEC = "study int, param string, kind string, low double, high double, step double, log boolean, choices array<string>"


def _spec(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], SPEC)


def _points(spark, *row):
    rows = W.discretize_space(_spec(spark, row), ["study"]).orderBy("position").collect()
    return [r["choice"] if r["number"] is None else r["number"] for r in rows]


def test_points_include_both_ends(spark):
    assert _points(spark, "x", "float", 0.0, 1.0, 0.25, False, None) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert _points(spark, "x", "float", 0.0, 1.0, 0.3, False, None) == pytest.approx(np.linspace(0, 1, 4))  # not 0.3 apart
    assert _points(spark, "x", "int", 1.0, 6.0, 2.0, False, None) == [1.0, 3.0, 6.0]  # 1, 3.5, 6
    assert _points(spark, "x", "int", 3.0, 3.0, None, False, None) == [3.0]
    assert _points(spark, "x", "categorical", None, None, None, False, ["b", "a"]) == ["b", "a"]
    assert _points(spark, "x", "float", 0.01, 100.0, 10.0, True, None) == pytest.approx([0.01, 0.1, 1, 10, 100])


@pytest.mark.parametrize("step", [None, 1.0, 0.5])
def test_log_grid_needs_a_step_above_one(spark, step):
    with pytest.raises(Exception, match="step above 1"):
        _points(spark, "x", "float", 0.01, 1.0, step, True, None)


def test_grid_candidates(spark):
    spec = _spec(spark, ("b", "int", 1.0, 2.0, None, False, None), ("a", "categorical", None, None, None, False, ["u", "v"]))
    rows = W.grid_candidates(spec, ["study"]).orderBy("trial").collect()
    assert [(r["params"]["a"], r["params"]["b"]) for r in rows] == [("u", "1"), ("u", "2"), ("v", "1"), ("v", "2")]


def test_random_candidates(spark):
    spec = _spec(spark, ("i", "int", 2.0, 8.0, 3.0, False, None), ("f", "float", -1.0, 1.0, None, False, None), ("g", "float", 1e-4, 1.0, None, True, None),
                 ("s", "float", 0.0, 1.0, 0.5, False, None), ("l", "int", 1.0, 64.0, None, True, None), ("c", "categorical", None, None, None, False, ["x", "y"]))
    draws = W.random_candidates(spec, 400, 7, ["study"])
    seen = {}
    for r in draws.collect():
        seen.setdefault(r["param"], []).append(r["choice"] if r["number"] is None else r["number"])
    assert {k: len(v) for k, v in seen.items()} == dict.fromkeys("ifgslc", 400)
    assert set(seen["i"]) == {2.0, 5.0, 8.0} and set(seen["s"]) == {0.0, 0.5, 1.0} and set(seen["c"]) == {"x", "y"}
    assert -1 <= min(seen["f"]) and max(seen["f"]) <= 1 and abs(np.mean(seen["f"])) < 0.15
    assert abs(np.mean(np.log10(seen["g"])) + 2) < 0.25
    assert {1.0, 64.0} > {min(seen["l"])} - {2.0} and max(seen["l"]) <= 64 and all(v == int(v) for v in seen["l"])
    assert draws.exceptAll(W.random_candidates(spec.repartition(5), 400, 7, ["study"])).isEmpty()


def test_queue_puts_defaults_first(spark):
    defaults = spark.createDataFrame([(1, 0, "d")], "study int, trial bigint, p string")
    sampled = spark.createDataFrame([(s, i, f"s{i}") for s in (1, 2) for i in range(5)], defaults.schema)
    rows = sorted(tuple(r) for r in W.candidate_queue(defaults, sampled, 3, ["study"]).collect())
    assert rows == [(1, 0, "d"), (1, 1, "s0"), (1, 2, "s1"), (2, 0, "s0"), (2, 1, "s1"), (2, 2, "s2")]
    assert W.candidate_queue(defaults, sampled, 3, ["study"], sampler="grid").where("p = 'd'").isEmpty()


def test_seeds_and_keys(spark):
    df = W.trial_seeds_keys(spark.createDataFrame([("m", 3, 0), ("m", 3, 1)], "model string, fold int, trial int"), ["model", "fold"], 9)
    rows = df.collect()
    assert [r["trial_key"] for r in rows] == ["m_3-0", "m_3-1"]
    assert all(0 <= r["random_seed"] < 2**31 - 1 for r in rows) and rows[0]["random_seed"] != rows[1]["random_seed"]


def _trials(spark):
    rows = [(1, 0, {"m": 2.0}, 5.0), (1, 1, {"m": 1.0}, 5.0), (1, 2, {"m": 1.0}, 5.0), (1, 3, {"z": 0.0}, 5.0), (1, 4, None, 5.0)]
    return spark.createDataFrame([(*r, {"p": str(r[1])}, f"c{r[1]}") for r in rows],
                                 "study int, trial int, result map<string,double>, elapsed double, params map<string,string>, child_run_id string")


def test_objective_and_best(spark):
    low = W.trial_objective(_trials(spark), "m")
    assert [r["value"] for r in low.orderBy("trial").collect()] == [2.0, 1.0, 1.0, math.inf, None]
    assert W.best_trial(low, ["study"]).first()["trial"] == 1  # tied: the lowest number
    high = W.trial_objective(_trials(spark), "m", "maximize")
    assert high.where("trial = 3").first()["value"] == -math.inf
    assert W.best_trial(high, ["study"], "maximize").first()["trial"] == 0
    numbers, texts = W.best_summary(W.best_trial(low, ["study"]), ["study"], "m")
    assert {r["key"]: r["value"] for r in numbers.collect()} == {"best/m": 1.0, "best/value": 1.0}
    assert {r["key"]: r["value"] for r in texts.collect()} == {"best/p": "1", "best/child_run_id": "c1"}
    with pytest.raises(Exception, match="every trial may have failed"):
        W.best_summary(W.best_trial(low.where("trial = 3"), ["study"]), ["study"], "m")[0].collect()
    with pytest.raises(ValueError):
        W.best_trial(low, ["study"], "sideways")


@pytest.mark.parametrize("budget, kept", [(0, 5), (1, 1), (5, 2), (10, 3), (100, 5)])
def test_budget_stops_after_the_trial_that_passes_it(spark, budget, kept):
    assert W.effective_trials(_trials(spark), ["study"], budget).count() == kept


def test_child_runs_are_scheduled_once(spark):
    parents = spark.createDataFrame([("p", 1), ("q", 1)], "run_uuid string, experiment_id int")
    tags = spark.createDataFrame([("q", "child_run_id_0", "x")], "run_uuid string, key string, value string")
    runs, up, down = W.schedule_child_runs(parents, tags, 3)
    assert runs.count() == 3 and {r["value"] for r in up.collect()} == {"p"}
    assert {r["key"] for r in down.collect()} == {"child_run_id_0", "child_run_id_1", "child_run_id_2"}
    again, _, _ = W.schedule_child_runs(parents, tags.unionByName(down), 3)
    assert again.isEmpty()


def test_closing_children(spark):
    runs = spark.createDataFrame([("p", "FINISHED"), ("a", "SCHEDULED"), ("b", "FINISHED"), ("c", "SCHEDULED")], "run_uuid string, status string")
    links = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c")], "parent_run string, child_run string")
    stopped = spark.createDataFrame([("p", "timeout", 1)], "parent_run string, reason string, n_trials_effective int")
    closed, tags = W.close_scheduled_children(runs, links, stopped)
    assert {r["run_uuid"]: r["status"] for r in closed.collect()} == {"p": "FINISHED", "a": "FAILED", "b": "FINISHED", "c": "SCHEDULED"}
    assert sorted(tuple(r) for r in tags.collect()) == [("a", "EXCEPTION", "Elapsed time timed out."), ("a", "raised_exception", "True"),
                                                        ("p", "elapsed_time_timed_out", "True"), ("p", "n_trials_effective", "1")]


def _halving(rows, factor, at):
    alive, out = sorted({t for t, _, _ in rows}), []
    for rung, step in enumerate(at):
        reached = [t for t in alive if max(s for u, s, _ in rows if u == t) >= step]
        last = {t: max((s, v) for u, s, v in rows if u == t and s <= step)[1] for t in reached if any(u == t and s <= step for u, s, _ in rows)}
        order = sorted(last, key=lambda t: (-last[t], t))
        alive = order[:max(1, len(order) // factor)]
        out += [(t, rung, last[t], t in alive) for t in order]
    return sorted(out)


def test_halving_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(t, s, float(rng.integers(0, 6))) for t in range(40) for s in range(1, int(rng.integers(1, 11)))]
    rows = [r for r in rows if (r[0] + r[1]) % 7]
    log = spark.createDataFrame([(1, *r) for r in rows], "study int, trial int, step bigint, value double")
    got = W.halving_survivors(log, ["study"], reduction_factor=2, min_resource=1)
    assert sorted((r["trial"], r["rung"], r["value"], r["survived"]) for r in got.collect()) == _halving(rows, 2, [1, 2, 4, 8])


@pytest.mark.parametrize("kind", ["ties", "spread", "nan", "infinite"])
def test_halving_of_many_trials(spark, kind):
    rng = np.random.default_rng(7)
    value = {"ties": lambda: float(rng.integers(0, 3)), "spread": rng.random, "nan": lambda: float(rng.choice([np.nan, 1.0, 2.0])),
             "infinite": lambda: float(rng.choice([np.inf, -np.inf, 0.0]))}[kind]
    rows = [(s, t, step, value()) for s in (None, 1, 2) for t in range({None: 3000, 1: 50, 2: 1}[s]) for step in (1, 3, 9)[:1 + t % 3]]
    log = spark.createDataFrame(rows, "study int, trial bigint, step bigint, value double")
    got = W.halving_survivors(log, ["study"], "maximize", reduction_factor=3, min_resource=1).collect()
    order = lambda v: (np.isnan(v), -v if not np.isnan(v) else 0)  # noqa: E731  NaN comes last
    for study in (None, 1, 2):
        values = {(t, step): v for s, t, step, v in rows if s == study}
        alive = {t for t, _ in values}
        for rung, step in enumerate((1, 3, 9)):
            here = sorted((t for t in alive if (t, step) in values), key=lambda t: (order(values[t, step]), t))
            alive = set(here[:max(1, len(here) // 3)]) if here else set()
            mine = {r["trial"]: r["survived"] for r in got if r["study"] == study and r["rung"] == rung}
            assert mine == {t: t in alive for t in here}, (study, rung)


def test_hyperband_brackets(spark):
    log = spark.createDataFrame([(1, t, s, float(t)) for t in range(10) for s in range(1, 17)], "study int, trial int, step bigint, value double")
    out = W.hyperband_survivors(log, ["study"], 16)
    per = {r["bracket"]: r["n"] for r in out.groupBy("bracket").agg(F.count_distinct("rung").alias("n")).collect()}
    assert per == {0: 5, 1: 4, 2: 3, 3: 2, 4: 1}
    with pytest.raises(ValueError):
        W.hyperband_survivors(log, ["study"], 10)
    assert W.halving_survivors(log, ["study"], min_resource=100).isEmpty()


def test_sweep_linear_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(f), float(x), float(3 * x + 1e6 + rng.normal())) for g in "ab" for f, x in zip(rng.integers(0, 3, 60), rng.normal(1e4, 5, 60))]
    out = W.sweep_linear(spark.createDataFrame(rows, "g string, f int, x double, y double"), ["g"], "f", "x", "y", [0.0, 50.0]).collect()
    assert len(out) == 12
    for r in out:
        train = np.array([(x, y) for g, f, x, y in rows if g == r["g"] and f != r["f"]])
        test = np.array([(x, y) for g, f, x, y in rows if g == r["g"] and f == r["f"]])
        cx, cy = train - train.mean(0), None
        slope = (cx[:, 0] * cx[:, 1]).sum() / ((cx[:, 0] ** 2).sum() + r["penalty"])
        intercept = train[:, 1].mean() - slope * train[:, 0].mean()
        assert cy is None and r["slope"] == pytest.approx(slope, rel=1e-6)
        assert r["test_mse"] == pytest.approx(((test[:, 1] - intercept - slope * test[:, 0]) ** 2).mean(), rel=1e-5)


def test_user_functions(spark):
    def _count(part):
        return {"n": len(part), "total": part["x"].sum()}

    def _mean(sums, combination):
        if combination["g"] == "bad":
            raise RuntimeError("no fit")
        return {"mean": sums["total"] / sums["n"]}

    df = spark.createDataFrame([("ok", float(i)) for i in range(100)] + [("bad", 1.0)], "g string, x double").repartition(6)
    rows = {r["g"]: r for r in W.sweep_grouped_udf(df, ["g"], _count, ["n", "total"], _mean).collect()}
    assert rows["ok"]["status"] == "FINISHED" and rows["ok"]["metrics"] == {"mean": 49.5}
    assert (rows["bad"]["status"], rows["bad"]["exception"], rows["bad"]["metrics"]) == ("FAILED", "RuntimeError: no fit", {})
    with pytest.raises(Exception, match="no fit"):
        W.sweep_grouped_udf(df, ["g"], _count, ["n", "total"], _mean, raise_on_error=True).collect()


def test_a_failing_summary_fails_its_combination_only(spark):
    def _count(part):
        if (part["g"] == "bad").any():
            raise RuntimeError("no sums")
        return {"n": len(part)}

    df = spark.createDataFrame([("ok", float(i)) for i in range(100)] + [("bad", 1.0), (None, 2.0)], "g string, x double").repartition(6)
    rows = {r["g"]: r for r in W.sweep_grouped_udf(df, ["g"], _count, ["n"], lambda sums, _: {"n": sums["n"]}).collect()}
    assert rows["ok"]["metrics"] == {"n": 100.0} and rows[None]["metrics"] == {"n": 1.0}
    assert (rows["bad"]["status"], rows["bad"]["exception"]) == ("FAILED", "RuntimeError: no sums")


def test_ml_estimator(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, label double"))

    def rmse(p):
        return p.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2)).alias("rmse"))

    grid = [{"regParam": 0.0}, {"regParam": 100.0}, {"regParam": -1.0}]
    rows = W.sweep_ml_estimator(df, LinearRegression(solver="normal"), grid, rmse).orderBy("trial").collect()
    assert [r["status"] for r in rows] == ["FINISHED", "FINISHED", "FAILED"]
    assert rows[0]["metrics"]["rmse"] < 1e-6 < rows[1]["metrics"]["rmse"]
    with pytest.raises(Exception):
        W.sweep_ml_estimator(df, LinearRegression(), grid[2:], rmse, raise_on_error=True)


def test_settings_side_by_side(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, label double"))
    slow = F.udf(lambda v: __import__("time").sleep(40.0 if v == 3.0 else 0.0) or v, "double")

    def evaluate(p):
        # the setting with the large penalty predicts badly and hangs in a job
        bad = p.agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] > 1
        if bad:
            p = p.withColumn("x", slow(F.when(F.col("x") >= 0, F.lit(3.0)))).where("x >= 0")
        return p.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2)).alias("rmse"))

    grid = [{"regParam": 0.0}, {"regParam": 100.0}, {"regParam": -1.0}, {"regParam": 0.0001}]
    rows = W.sweep_ml_estimator(df, LinearRegression(solver="normal"), grid, evaluate, concurrent=4, timeout=6).orderBy("trial").collect()
    assert [r["status"] for r in rows] == ["FINISHED", "FAILED", "FAILED", "FINISHED"]
    assert rows[1]["exception"] == "TimeoutError: fit took longer than 6 s" and rows[1]["elapsed"] < 30 and rows[1]["metrics"] == {}
    assert "regParam" in rows[2]["exception"] and rows[3]["metrics"]["rmse"] < 0.1
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_settings_do_not_wait_for_each_other(spark):
    import time

    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, label double"))

    def evaluate(p):
        time.sleep(2)
        return p.agg(F.avg("prediction").alias("mean"))

    start = time.perf_counter()
    rows = W.sweep_ml_estimator(df, LinearRegression(solver="normal"), [{"regParam": 0.1 * i} for i in range(6)], evaluate, concurrent=6).collect()
    assert len(rows) == 6 and time.perf_counter() - start < 0.8 * sum(r["elapsed"] for r in rows)


def test_bagged(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "trial int, m double")
    assert {r["trial"]: (r["value"], r["n_bagging"]) for r in W.bagged_objective(df, ["trial"], "m").collect()} == {1: (1.5, 2), 2: (5.0, 1)}
