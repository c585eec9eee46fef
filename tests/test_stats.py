import math

import numpy as np
import pytest

from runquarry.functions.special import chi2_tail, studentized_range_tail
from runquarry.operators import stats as S


def _frame(spark, table, models="ABC"):
    rows = [(m, f"b{i}", v) for i, line in enumerate(table) for m, v in zip(models, line) if v is not None]
    return spark.createDataFrame([(m, b, float(v)) for m, b, v in rows], "model string, block string, metric double")


def test_single_row_and_missing_keys(spark):
    df = spark.createDataFrame([("A", "t", 1.0), ("A", None, 5.0), ("B", "t", 2.0), ("B", "t", 4.0), ("A", "t2", float("nan"))],
                               "model string, task string, metric double")
    rows = {r["task"]: r for r in S.means_stds_by_model(df, "model", ["task"], "metric").collect()}
    assert set(rows) == {"t", "t2"}
    assert (rows["t"]["A_mean"], rows["t"]["A_std"]) == (1.0, None)
    assert rows["t"]["B_mean"] == 3.0 and math.isclose(rows["t"]["B_std"], math.sqrt(2))
    assert rows["t2"]["A_mean"] is None


@pytest.mark.parametrize("ascending", [False, True])
def test_ranks_share_ties(spark, ascending):
    df = spark.createDataFrame([("x", 3.0), ("x", 1.0), ("x", 3.0), ("x", None), ("x", float("nan")), ("y", 7.0), (None, 2.0)], "b string, v double")
    rows = S.rank_in_block(df, ["b"], "v", ascending=ascending).collect()
    got = sorted((r["b"] or "", str(r["v"]), r["rank"]) for r in rows)
    high, low = (2.5, 1.0) if ascending else (1.5, 3.0)
    assert got == sorted([("x", "3.0", high), ("x", "3.0", high), ("x", "1.0", low), ("x", "None", None), ("x", "nan", None), ("y", "7.0", 1.0),
                          ("", "2.0", None)])


def test_mean_rank_both_ways(spark):
    df = _frame(spark, [(1, 2, 3), (3, 2, 1), (1, 1, 5)])
    want = {"A": (3 + 1 + 2.5) / 3, "B": (2 + 2 + 2.5) / 3, "C": (1 + 3 + 1) / 3}
    for _ in (0,):
        got = {r["model"]: r["mean_rank"] for r in S.mean_rank(df, "model", ["block"], "metric").collect()}
        assert got == pytest.approx(want)


def test_friedman_by_hand(spark):
    # ranks 1,2,3 in 4 blocks, one block reversed: R = (4+... ) -> statistic 12/(n k (k+1)) sum R^2 - 3 n (k+1)
    df = _frame(spark, [(1, 2, 3), (1, 2, 3), (1, 2, 3), (3, 2, 1)])
    r = S.friedman(df, "model", ["block"], "metric").first()
    rank_sums = (1 + 1 + 1 + 3, 8, 3 + 3 + 3 + 1)
    want = 12 / (4 * 3 * 4) * sum(x * x for x in rank_sums) - 3 * 4 * 4
    assert r["statistic"] == pytest.approx(want) and (r["k"], r["n"]) == (3, 4)
    assert r["p_value"] == pytest.approx(math.exp(-want / 2))


def test_friedman_ties_incomplete_blocks_and_even_k(spark):
    df = _frame(spark, [(1, 1, 2, 4), (1, 2, 3, 4), (2, 1, 4, 3), (5, 6, None, 1)], "ABCD")
    r = S.friedman(df, "model", ["block"], "metric").first()
    ranks = np.array([[1.5, 1.5, 3, 4], [1, 2, 3, 4], [2, 1, 4, 3]])
    n, k = ranks.shape
    raw = 12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)
    want = raw / (1 - (2**3 - 2) / (n * k * (k * k - 1)))
    assert r["n"] == 3 and r["statistic"] == pytest.approx(want)
    assert r["p_value"] == pytest.approx(chi2_tail(want, 3))


def test_all_tied_has_no_statistic(spark):
    r = S.friedman(_frame(spark, [(1, 1, 1), (2, 2, 2)]), "model", ["block"], "metric").first()
    assert r["statistic"] is None and r["p_value"] is None


def test_two_models_are_too_few(spark):
    with pytest.raises(Exception, match="at least 3 models"):
        S.friedman(_frame(spark, [(1, 2), (2, 1)], "AB"), "model", ["block"], "metric").collect()


def test_chi_square_tail():
    # published 5 % points
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (9, 16.918978)):
        assert chi2_tail(x, df) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(0.0, 3) == 1.0


def test_studentized_range_tail():
    # published critical differences: q / sqrt(2) at 5 %
    for k, q in ((2, 1.960), (3, 2.343), (5, 2.728), (10, 3.164)):
        assert studentized_range_tail(np.array([q * math.sqrt(2)]), k)[0] == pytest.approx(0.05, abs=3e-4)


def test_nemenyi_and_the_gate(spark):
    df = _frame(spark, [(1, 2, 3)] * 10)
    test, pairs, means = S.friedman_nemenyi(df, "model", ["block"], "metric")
    assert test.first()["p_value"] < 0.05
    p = {(r["model_a"], r["model_b"]): (r["q"], r["p_value"]) for r in pairs.collect()}
    assert len(p) == 6 and p[("A", "C")] == p[("C", "A")]
    assert p[("A", "C")][0] == pytest.approx(2 / math.sqrt(3 * 4 / 60))
    assert p[("A", "C")][1] < p[("A", "B")][1]
    assert {r["model"]: r["mean_rank"] for r in means.collect()} == {"A": 3.0, "B": 2.0, "C": 1.0}
    same = _frame(spark, [(1, 2, 3), (3, 2, 1)] * 3)
    test, pairs, means = S.friedman_nemenyi(same, "model", ["block"], "metric")
    assert test.count() == 1 and pairs.count() == 0 and means.count() == 0
