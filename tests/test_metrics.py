import math

import pytest

from runquarry.operators.metrics import METRICS, get_metric_fn


def _value(df, metric, y, p, groups=(), **options):
    rows = get_metric_fn(metric, **options)[0](df, y, p, list(groups)).collect()
    return rows[0][metric] if len(rows) == 1 else rows


@pytest.fixture(scope="module")
def binary(spark):
    # scores with ties, one group without positives
    rows = [("m", 1, 0.9), ("m", 0, 0.8), ("m", 1, 0.8), ("m", 0, 0.1), ("m", 1, 0.1), ("n", 0, 0.5), ("n", 0, 0.6)]
    return spark.createDataFrame(rows, "g string, y int, s double")


def test_registry_flags():
    assert len(METRICS) == 39
    assert get_metric_fn("logloss", n_classes=3)[1:] == (True, False)
    assert get_metric_fn("auc")[1:] == (True, True)
    assert get_metric_fn("rmse")[1:] == (False, False)
    with pytest.raises(KeyError):
        get_metric_fn("nope")


def test_auc_counts_ties_as_half(binary):
    rows = {r["g"]: r["auc_binary"] for r in get_metric_fn("auc_binary")[0](binary, "y", "s", ["g"]).collect()}
    pairs = [(p, n) for p in (0.9, 0.8, 0.1) for n in (0.8, 0.1)]
    assert rows["m"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p, n in pairs) / 6)
    assert rows["n"] is None


def test_average_precision_and_curve(binary):
    rows = {r["g"]: r["average_precision_binary"] for r in get_metric_fn("average_precision_binary")[0](binary, "y", "s", ["g"]).collect()}
    assert rows["m"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert rows["n"] == 0.0
    curve = sorted((tuple(r) for r in get_metric_fn("precision_recall_curve")[0](binary.where("g = 'm'"), "y", "s", []).collect()),
                   key=lambda r: (r[0] is None, r[0]))
    assert [c[0] for c in curve] == [0.1, 0.8, 0.9, None]
    assert [c[1] for c in curve] == pytest.approx([3 / 5, 2 / 3, 1, 1]) and [c[2] for c in curve] == pytest.approx([1, 2 / 3, 1 / 3, 0])
    none = get_metric_fn("precision_recall_curve")[0](binary.where("g = 'n'"), "y", "s", []).where("threshold is not null").collect()
    assert {r["recall"] for r in none} == {1.0}


def test_scores_beyond_the_unit_range(spark):
    df = spark.createDataFrame([(1, 1e12), (0, -5.0), (1, 3.0), (0, 2.0)], "y int, s double")
    assert _value(df, "auc_binary", "y", "s") == 1.0


def test_r2_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert _value(df, "r2_score", "y", "p") == 1.0
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert _value(df, "r2_score", "y", "p") == 0.0


def test_mape_of_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert _value(df, "mape", "y", "p") == pytest.approx(1 / 2.220446049250313e-16)


def test_labels_absent_from_the_data_count_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "y int, p int")
    assert _value(df, "recall_macro", "y", "p", n_classes=3) == pytest.approx((1 + 0.5 + 0) / 3)
    assert _value(df, "recall_macro", "y", "p") == pytest.approx((1 + 0.5) / 2)
    rows = {r["label"]: r for r in _value(df, "precision_recall_fscore_support_all", "y", "p", n_classes=3)}
    assert (rows[2]["precision"], rows[2]["support"]) == (0.0, 0) and rows[1]["fscore"] == pytest.approx(2 / 3)
    assert _value(df, "f1_micro", "y", "p", n_classes=3) == pytest.approx(2 / 3)
    assert _value(df, "precision_binary", "y", "p", pos_label=0) == pytest.approx(0.5)
    assert _value(df, "recall_binary", "y", "p", pos_label=7) == 0.0


def test_text_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b")], "y string, p string")
    assert _value(df, "f1_macro", "y", "p", labels=["a", "b"]) == pytest.approx(2 / 3)
    probs = spark.createDataFrame([("a", [0.8, 0.2]), ("b", [0.3, 0.7])], "y string, p array<double>")
    assert _value(probs, "logloss", "y", "p", labels=["a", "b"]) == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2)


def test_balanced_accuracy_uses_seen_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y int, p int")
    assert _value(df, "balanced_accuracy", "y", "p") == pytest.approx(0.75)
    assert _value(df, "balanced_accuracy_adjusted", "y", "p") == pytest.approx(0.5)


def test_logloss_is_clipped_and_needs_the_class(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], "y int, p array<double>")
    assert _value(df, "logloss", "y", "p") == pytest.approx(-math.log(2.220446049250313e-16) / 2)
    with pytest.raises(Exception, match="no probability"):
        _value(spark.createDataFrame([(5, [0.5, 0.5])], df.schema), "logloss", "y", "p")


def test_multiclass_auc(spark):
    rows = [(0, 0.7, 0.2, 0.1), (1, 0.1, 0.6, 0.3), (2, 0.3, 0.3, 0.4), (0, 0.2, 0.5, 0.3), (0, 0.9, 0.05, 0.05)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")

    def auc(label):
        s = [(r[1 + label], r[0] == label) for r in rows]
        pairs = [(p, n) for p, hit in s if hit for n, other in s if not other]
        return sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs)

    each = [auc(i) for i in range(3)]
    assert _value(df, "auc", "y", ["a", "b", "c"], n_classes=3) == pytest.approx(sum(each) / 3)
    assert _value(df, "auc_weighted", "y", ["a", "b", "c"], n_classes=3) == pytest.approx((3 * each[0] + each[1] + each[2]) / 5)
    assert _value(df.where("y < 2"), "auc", "y", ["a", "b", "c"], n_classes=3) is None  # class 2 has no rows
