import time

import pytest

from runquarry.operators import sweeps as W
from runquarry.operators.fits import DeadlinePassed, deadline, fit_combinations


def _fit():
    """A function of its own for each test: workers cannot import this module."""

    def median(rows, combination):
        if combination["g"] == "bad":
            raise RuntimeError("no fit")
        if combination["g"] == "slow":
            while True:
                time.sleep(0.01)
        assert list(rows.columns) == ["g", "h", "x"] and (rows["g"].isna().all() if combination["g"] is None else (rows["g"] == combination["g"]).all())
        return {"median": rows["x"].median(), "n": len(rows), "h": combination["h"]}

    return median


def test_combinations(spark):
    rows = [("ok", 1.5, float(i)) for i in range(11)] + [("bad", 1.5, 1.0), ("slow", 1.5, 1.0), (None, 1.5, 4.0), (None, 1.5, 6.0), ("ok", None, 3.0), ("ok", float("nan"), 5.0)]
    rows += [("big", 1.5, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, h double, x double").repartition(5)
    got = {(r["g"], str(r["h"])): r for r in fit_combinations(df, ["g", "h"], _fit(), timeout=0.5, max_rows=20).collect()}
    assert len(got) == 7
    assert got["ok", "1.5"]["metrics"] == {"median": 5.0, "n": 11.0, "h": 1.5} and got["ok", "1.5"]["status"] == "FINISHED"
    assert got[None, "1.5"]["metrics"] == {"median": 5.0, "n": 2.0, "h": 1.5}
    assert got["ok", "None"]["metrics"] == {"median": 3.0, "n": 1.0, "h": None}  # NULL and NaN are two values
    assert got["ok", "nan"]["metrics"]["median"] == 5.0
    bad, slow, big = (got[k, "1.5"] for k in ("bad", "slow", "big"))
    assert (bad["status"], bad["exception"], bad["metrics"]) == ("FAILED", "RuntimeError: no fit", None)
    assert (slow["status"], slow["exception"], slow["metrics"]) == ("FAILED", "TimeoutError: fit took longer than 0.5 s", None) and slow["elapsed"] < 5
    assert (big["status"], big["n_rows"], big["metrics"]) == ("FAILED", 50, None) and big["exception"].startswith("TooLarge: 50 rows")
    assert fit_combinations(df.limit(0), ["g", "h"], _fit()).collect() == []


def test_bytes_bound_too(spark):
    df = spark.createDataFrame([("a", "x" * 1000), ("b", "x")], "g string, t string")
    got = {r["g"]: r["status"] for r in fit_combinations(df, ["g"], lambda rows, _: {"n": len(rows)}, max_bytes=500).collect()}
    assert got == {"a": "FAILED", "b": "FINISHED"}


@pytest.mark.parametrize("g, text", [("bad", "no fit"), ("slow", "took longer"), ("big", "TooLarge")])
def test_raise_on_error(spark, g, text):
    df = spark.createDataFrame([(g, 1.5, 1.0)] * 3, "g string, h double, x double")
    with pytest.raises(Exception, match=text):
        fit_combinations(df, ["g", "h"], _fit(), timeout=0.3, max_rows=2 if g == "big" else 10, raise_on_error=True).collect()


def test_deadline_leaves_no_timer():
    with deadline(5):
        pass
    with pytest.raises(DeadlinePassed), deadline(0.05):
        time.sleep(1)
    time.sleep(0.1)
    with deadline(None):
        pass


def test_sums_with_null_keys(spark):
    df = spark.createDataFrame([(None, None, float(i)) for i in range(5)] + [("a", float("nan"), 1.0), ("a", None, 2.0), ("a", None, 3.0)], "g string, h double, x double")
    summarise = lambda part: {"n": len(part), "x": part["x"].sum()}
    train = lambda sums, c: {"mean": sums["x"] / sums["n"], "known": (c["g"] is not None) + (c["h"] is not None)}
    for some in (df, df.coalesce(1), df.where("g IS NULL"), df.repartition(8)):
        got = {(r["g"], str(r["h"])): r["metrics"] for r in W.sweep_grouped_udf(some, ["g", "h"], summarise, ["n", "x"], train).collect()}
        assert got[None, "None"] == {"mean": 2.0, "known": 0.0}
        if len(got) > 1:
            assert got == {(None, "None"): {"mean": 2.0, "known": 0.0}, ("a", "nan"): {"mean": 1.0, "known": 2.0}, ("a", "None"): {"mean": 2.5, "known": 1.0}}


def test_many_combinations_share_a_batch(spark):
    """Far more rows than a batch of Arrow has; NULL in one combination leaves the integers of the others as they are."""
    rows = [(i % 700, None if i % 700 == 3 and i > 5000 else 2**60 + i % 700, None if i % 700 == 4 and i > 5000 else True, i) for i in range(35_000)]
    df = spark.createDataFrame(rows, "g int, n bigint, b boolean, x bigint").repartition(3)

    def fit(rows, combination):
        kinds = [str(rows[c].dtype) for c in "gnbx"]
        assert list(rows.index) == list(range(50)) and (rows["g"] == combination["g"]).all() and type(combination["g"]) is int
        assert kinds == ["int32", "float64" if combination["g"] == 3 else "int64", "object" if combination["g"] == 4 else "bool", "int64"], kinds
        return {"x": rows["x"].sum(), "low": 0 if combination["g"] == 3 else (rows["n"] - 2**60).max(), "holes": rows["n"].isna().sum() + rows["b"].isna().sum()}

    found = fit_combinations(df, ["g"], fit)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # a group of Spark's own for each took most of the time
    got = {r["g"]: r for r in found.collect()}
    assert len(got) == 700 and {r["exception"] for r in got.values()} == {None}
    assert all(r["metrics"]["x"] == 50 * g + 700 * 1225 and r["metrics"]["low"] == (g if g != 3 else 0) for g, r in got.items())
    assert got[3]["metrics"]["holes"] == got[4]["metrics"]["holes"] == 42 and got[5]["metrics"]["holes"] == 0
