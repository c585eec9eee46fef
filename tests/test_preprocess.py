import random

import pytest
from pyspark.ml.feature import Imputer, StringIndexer
from pyspark.sql import functions as F

from runquarry.operators import preprocess as P
from runquarry.operators import split as SP


def _frame(spark, values, kind="double", name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def _column(df, name="x"):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("accuracy", [5, 100, 10_000])
def test_exact_quantiles_are_those_of_percentile(spark, accuracy):
    rng = random.Random(3)
    x = [rng.choice([rng.gauss(0, 1e6), 7.25, rng.random() * 1e-9, 10.0 ** rng.uniform(-300, 300)]) for _ in range(2001)]
    df = spark.createDataFrame([(v, None if i % 4 else v, float("nan"), 1.5, float("inf") if i % 3 else -v) for i, v in enumerate(x)],
                               "a double, b double, c double, d double, e double")
    asked = [0.0, 0.2, 0.25, 0.5, 0.9, 1.0]
    got = P.exact_quantiles(df, dict.fromkeys("abcde", asked), accuracy=accuracy)
    want = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcde"]).agg(*[F.percentile(c, asked).alias(c) for c in "abcde"]).first()
    assert got == {c: want[c] or [None] * len(asked) for c in "abcde"}
    assert P.exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]} and P.exact_quantiles(df, {}) == {}


def test_imputers(spark):
    df = _frame(spark, [1.0, None, 4.0, 10.0])
    assert sorted(_column(P.fit_imputer(df, ["x"], "median").transform(df))) == [1.0, 4.0, 4.0, 10.0]
    assert sorted(_column(P.fit_imputer(df, ["x"], "mean").transform(df))) == [1.0, 4.0, 5.0, 10.0]
    assert sorted(_column(P.fit_imputer(df, ["x"], 0).transform(df))) == [0.0, 1.0, 4.0, 10.0]
    tied = _frame(spark, ["b", "a", "b", "a", None], "string")
    assert _column(P.fit_imputer(tied, ["x"], "most_frequent").transform(tied))[-1] == "a"
    numbers = _frame(spark, [10, 9, 10, 9, None], "int")
    assert _column(P.fit_imputer(numbers, ["x"], "most_frequent").transform(numbers))[-1] == 9
    with pytest.raises(ValueError):
        P.fit_imputer(df, ["x"], "magic")


def test_a_feature_without_values_is_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    fitted = P.fit_imputer(df, ["x", "y"], "median")
    assert fitted.features == ["x"] and fitted.transform(df).columns == ["x"]


def test_variance_threshold(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0), (2.0, 5.0, 0.1)], "a double, b double, c double")
    assert P.fit_variance_threshold(df, ["a", "b", "c"]).features == ["a", "c"]
    assert P.fit_variance_threshold(df, ["a", "b", "c"], 0.1).features == ["a"]
    assert P.fit_variance_threshold(df, ["a", "b", "c"], None).features == ["a", "b", "c"]
    with pytest.raises(ValueError):
        P.fit_variance_threshold(df, ["b"])


def test_scalers(spark):
    df = spark.createDataFrame([(0.0, 3.0), (2.0, 3.0), (4.0, 3.0), (10.0, 3.0)], "x double, c double")
    assert _column(P.fit_scaler(df, ["x", "c"], "minmax").transform(df)) == [0.0, 0.2, 0.4, 1.0]
    out = P.fit_scaler(df, ["x", "c"], "standard").transform(df)
    assert sum(_column(out)) == pytest.approx(0) and _column(out, "c") == [0.0] * 4
    robust = P.fit_scaler(df, ["x"], "robust").transform(df)
    assert _column(robust) == pytest.approx([(v - 3.0) / (5.5 - 1.5) for v in (0.0, 2.0, 4.0, 10.0)])
    with pytest.raises(ValueError):
        P.fit_scaler(df, ["x"], "other")


def test_cast(spark):
    df = _frame(spark, ["1", "2"], "string")
    assert dict(P.cast_types(df, {"x": "int64"}).dtypes)["x"] == "bigint"
    assert dict(P.cast_types(df, {"x": "float32"}).dtypes)["x"] == "float"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        P.cast_types(_frame(spark, ["a"], "string"), {"x": "int"}).collect()


@pytest.mark.parametrize("limit", [10_000, 1])
def test_ordinal(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "MAX_DRIVER_VALUES", limit)
    train = spark.createDataFrame([("b", 10), ("a", 9), ("c", 100), (None, 9)], "x string, n int")
    fitted = P.fit_ordinal(train, ["x", "n"])
    other = spark.createDataFrame([("a", 100), ("c", 9), ("new", 10), (None, 55)], "x string, n int")
    assert sorted((r["x"], r["n"]) for r in fitted.transform(other).collect() if r["x"] is not None) == [(0.0, 2.0), (2.0, 0.0), (3.0, 1.0)]
    assert [r["n"] for r in fitted.transform(other).where("x is null").collect()] == [3.0]
    strict = P.fit_ordinal(train, ["x"], handle_unknown=False)
    assert strict.transform(train.select("x")).count() == 4
    with pytest.raises(Exception, match="unknown category in x: new"):
        strict.transform(other.select("x")).collect()


@pytest.mark.parametrize("limit", [10_000, 1])
def test_ordinal_with_a_minimum(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "MAX_DRIVER_VALUES", limit)
    train = _frame(spark, ["a"] * 5 + ["b"] + ["c"] * 4 + ["d"], "string")
    fitted = P.fit_ordinal(train, ["x"], min_frequency=4)
    codes = {r[0]: r[1] for r in fitted.transform(spark.createDataFrame([(v, v) for v in "abcde"], "k string, x string")).collect()}
    assert codes == {"a": 0.0, "c": 1.0, "b": 2.0, "d": 2.0, "e": 3.0}


def test_one_hot(spark):
    train = spark.createDataFrame([("r", "y"), ("g", "n"), ("b", "y")], "c string, d string")
    other = spark.createDataFrame([("g", "y"), ("new", "new"), (None, None)], "c string, d string")
    out = P.fit_one_hot(train, ["c", "d"]).transform(other)
    assert out.columns == ["c_b", "c_g", "c_r", "d_y"]
    assert [tuple(r) for r in out.collect()] == [(0.0, 1.0, 0.0, 1.0), (0.0,) * 4, (0.0,) * 4]


def test_one_hot_limits(spark):
    counts = {chr(ord("a") + i): n for i, n in enumerate([30, 20, 20, 20, 5, 5])}
    train = _frame(spark, [k for k, n in counts.items() for _ in range(n)], "string")
    assert P.fit_one_hot(train, ["x"], min_frequency=0.1, max_categories=10).features == ["x_a", "x_b", "x_c", "x_d", "x_infrequent_sklearn"]
    # three columns in all: of the tied ones the last stays
    fitted = P.fit_one_hot(train, ["x"], min_frequency=0.1, max_categories=3)
    assert fitted.features == ["x_a", "x_d", "x_infrequent_sklearn"]
    rows = {r["k"]: tuple(r)[1:] for r in fitted.transform(spark.createDataFrame([(v, v) for v in "abfz"], "k string, x string")).collect()}
    assert rows == {"a": (1.0, 0.0, 0.0), "b": (0.0, 0.0, 1.0), "f": (0.0, 0.0, 1.0), "z": (0.0, 0.0, 0.0)}


def test_reorder_prefers_the_longest_name():
    columns = ["a_b_x", "a_y", "z", "a_b_w"]
    assert P.reorder_columns(columns, ["a", "gone", "a_b", "z"]) == ["a_y", "a_b_x", "a_b_w", "z"]


def test_pipeline_defaults_and_custom_stages(spark):
    df = spark.createDataFrame([(i, float(i) if i % 3 else None, "k", "p" if i % 2 else "q", None if i % 5 == 0 else "m") for i in range(30)],
                               "id int, x double, const string, c string, d string")
    out = P.DataPreprocess(["const", "c", "d"], ["x"], ["c", "x", "const", "d"]).fit(df, keep=["id"]).transform(df)
    assert out.columns == ["id", "c", "x"]  # const is constant, and so is d once its gaps are filled
    assert dict(out.dtypes) == {"id": "int", "c": "string", "x": "float"}
    custom = P.DataPreprocess(["c"], ["x"], ["x", "c"], continuous_imputer=Imputer(strategy="median"), categorical_imputer=None,
                              categorical_encoder=StringIndexer(stringOrderType="alphabetAsc"), scaler=None, categorical_type="int32")
    assert custom.fit(df).transform(df).columns == ["x", "c"]
    for wrong in (dict(continuous_imputer="most"), dict(scaler="most"), dict(categorical_encoder="most")):
        with pytest.raises(ValueError):
            P.DataPreprocess(["c"], ["x"], ["x", "c"], **wrong).fit(df)


def test_transform_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 4.0, "c")], "id int, x double, c string")
    out = P.DataPreprocess(["c"], ["x"], ["x", "c"]).fit(df, keep=["id"]).transform(df)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_targets(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0), (None, 20.0)], "a double, b double")
    out = P.TargetPreprocess("multi_regression", imputer="mean").fit(df, ["a", "b"]).transform(df)
    assert _column(out, "a") == pytest.approx([-1.2247449, 1.2247449, 0.0])
    with pytest.raises(ValueError):
        P.TargetPreprocess("ranking")
    with pytest.raises(ValueError):
        P.TargetPreprocess("classification", categorical_encoder="one_hot_10").fit(df, ["a"])


def test_split_is_seeded_and_exact(spark):
    df = spark.range(1001)
    train, test = SP.train_test_split(df, "id", 0.25, seed=1)
    assert (train.count(), test.count()) == (750, 251)
    assert train.join(test, "id").isEmpty()
    again = SP.train_test_split(df.repartition(7), "id", 0.25, seed=1)[1]
    assert again.exceptAll(test).isEmpty()
    assert not SP.train_test_split(df, "id", 0.25, seed=2)[1].exceptAll(test).isEmpty()
    assert SP.train_test_split(df, "id", 17)[1].count() == 17
    assert SP.train_test_split(df, "id", 0.0)[1].isEmpty()


def test_stratified_split(spark):
    df = spark.createDataFrame([(i, "hot" if i < 700 else f"c{i % 3}") for i in range(1000)], "id int, y string")
    split = SP.assign_split(df, "id", 0.1, stratify="y")
    assert {r["y"]: r["count"] for r in split.where("is_test").groupBy("y").count().collect()} == {"hot": 70, "c0": 10, "c1": 10, "c2": 10}
    with pytest.raises(ValueError, match="only 1 member"):
        SP.assign_split(df.union(spark.createDataFrame([(5000, "lonely")], df.schema)), "id", 0.1, stratify="y")
    with pytest.raises(ValueError, match="at least one row"):
        SP.assign_split(df, "id", 3, stratify="y")


def test_forced_split(spark):
    df = spark.createDataFrame([(i, f"c{i % 10}") for i in range(50)] + [(99, "lonely")], "id int, y string")
    with pytest.warns(UserWarning):
        train, test = SP.train_test_split_forced(df, "id", 0.05, stratify="y")
    assert train.count() + test.count() == 52  # the lonely row twice
    assert test.count() == 11  # raised to the number of classes
    assert train.columns == ["id", "y"]
    assert sum(part.where("y = 'lonely'").count() for part in (train, test)) == 2
    plain = SP.train_test_split_forced(df, "id", 0.2)
    assert (plain[0].count(), plain[1].count()) == (40, 11)
