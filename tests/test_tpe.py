import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runquarry.operators import tpe as Q

SPEC = "study int, param string, kind string, low double, high double, step double, log boolean, choices array<string>"
PARAMS = [("x", "float", -2.0, 3.0, None, False, None), ("lr", "float", 1e-4, 1.0, None, True, None), ("n", "int", 1.0, 9.0, 2.0, None, None),
          ("m", "int", 1.0, 64.0, None, True, None), ("q", "float", 0.0, 1.0, 0.25, False, None), ("c", "categorical", None, None, None, False, ["r", "g", "b"])]


def _tables(spark, sizes, seed=1, pending=3):
    """Studies whose best x is near 1, lr near 0.01, n 5, m 8, q 0.25, c "g"."""
    rng, trials, values = np.random.default_rng(seed), [], []
    for study, size in sizes.items():
        for t in range(size):
            x, lr, n, m = rng.uniform(-2, 3), 10 ** rng.uniform(-4, 0), 1 + 2 * int(rng.integers(0, 5)), int(rng.integers(1, 65))
            q, c = 0.25 * int(rng.integers(0, 5)), "rgb"[rng.integers(0, 3)]
            loss = (x - 1) ** 2 + (math.log10(lr) + 2) ** 2 + abs(n - 5) / 4 + abs(math.log2(m) - 3) + 2 * abs(q - 0.25) + (c != "g")
            trials.append((study, t, None if t >= size - pending else float("nan") if t == 4 else round(loss, 1)))
            values += [(study, t, p, float(v), None) for p, v in (("x", x), ("lr", lr), ("n", n), ("m", m), ("q", q))] + [(study, t, "c", None, c)]
    spec = spark.createDataFrame([(s, *p) for s in sizes for p in PARAMS], SPEC)
    trials = spark.createDataFrame([(s, t, None if v is None or v != v else v) for s, t, v in trials], "study int, trial bigint, value double")
    return spec, trials, spark.createDataFrame(values, "study int, trial bigint, param string, number double, choice string")


def test_split(spark):
    _, trials, _ = _tables(spark, {1: 40, None: 300, 3: 1})
    for direction, sign in (("minimize", 1), ("maximize", -1)):
        got = Q.split_trials(trials, ["study"], direction).collect()
        assert len(got) == 341
        for study, size in ((1, 40), (None, 300), (3, 1)):
            mine = [r for r in got if r["study"] == study]
            done = sorted((sign * r["value"], r["trial"]) for r in mine if r["value"] is not None)
            want = {t for _, t in done[:min(25, math.ceil(0.1 * len(done)))]}
            assert {r["trial"] for r in mine if r["good"]} == want
            assert not any(r["good"] for r in mine if r["value"] is None)  # running trials count as bad


def _sides(trials, values, study):
    done = sorted((r["value"], r["trial"]) for r in trials if r["study"] == study and r["value"] is not None)
    good = {t for _, t in done[:min(25, math.ceil(0.1 * len(done)))]}
    seen = defaultdict(list)
    for r in sorted((r for r in values if r["study"] == study), key=lambda r: r["trial"]):
        seen[r["param"], r["trial"] in good].append(r["choice"] if r["number"] is None else r["number"])
    return seen


def _weights(n):
    return [1.0] * n if n <= 25 else [1 / n + i * (1 - 1 / n) / max(n - 26, 1) for i in range(n - 25)] + [1.0] * 25


def _kernels(numbers, low, high, step, log):
    half = (step or 0) / 2
    lo, hi = (math.log(low - half), math.log(high + half)) if log else (low - half, high + half)
    mus = [math.log(v) if log else v for v in numbers]
    return sorted([*mus, (lo + hi) / 2]), lo, hi, len(mus)


def _cdf(x, mu, sigma):
    return 1 / (1 + math.exp(-(x - mu) / (sigma * math.sqrt(3) / math.pi)))


def test_densities(spark):
    spec, trials, values = _tables(spark, {1: 60, 2: 500})
    split = Q.split_trials(trials, ["study"])
    kernels = Q.parzen_kernels(spec, split, values, ["study"])
    rows, values_rows, trial_rows = kernels.collect(), values.collect(), trials.collect()
    for study in (1, 2):
        seen = _sides(trial_rows, values_rows, study)
        for param, kind, low, high, step, log, _ in PARAMS[:5]:
            step = 1.0 if kind == "int" and step is None else step
            for good in (True, False):
                mine = sorted((r["mu"], r["trial"] is None, r["trial"], r["sigma"], r["weight"]) for r in rows if (r["study"], r["param"], r["good"]) == (study, param, good))
                order, lo, hi, n = _kernels(seen[param, good], low, high, step, bool(log))
                assert [m[0] for m in mine] == pytest.approx(order) and len(mine) == n + 1
                assert sorted(m[4] for m in mine) == pytest.approx(sorted([*_weights(n), 1.0]))
                for i, (mu, whole, _, sigma, _) in enumerate(mine):
                    gaps = ([mine[i][0] - mine[i - 1][0]] if i else []) + ([mine[i + 1][0] - mine[i][0]] if i < n else [])
                    assert sigma == pytest.approx(hi - lo if whole else min(hi - lo, max((hi - lo) / min(100, n + 1), max(gaps))))
    # densities over a range sum up to one, on a grid over its points
    for param, kind, low, high, step, log, _ in PARAMS[:5]:
        step = 1.0 if kind == "int" and step is None else step
        grid = np.arange(low, high + 1e-9, step) if step else np.exp(np.linspace(math.log(low), math.log(high), 4001)) if log else np.linspace(low, high, 4001)
        points = spark.createDataFrame([(1, param, i, float(v)) for i, v in enumerate(grid)], "study int, param string, place int, number double")
        found = Q.densities(kernels, points, ["study"], ["place"]).orderBy("place").collect()
        for good in (True, False):
            d = np.array([r["density"] for r in found if r["good"] == good])
            total = d.sum() if step else np.trapezoid(d, np.log(grid) if log else grid)
            assert total == pytest.approx(1, abs=2e-3), (param, good)
    own = [r for r in rows if (r["study"], r["param"], r["good"]) == (1, "x", True)]
    at = Q.densities(kernels, spark.createDataFrame([(1, "x", 0, 0.7)], "study int, param string, place int, number double"), ["study"], ["place"]).where("good").first()["density"]
    s = [r["sigma"] * math.sqrt(3) / math.pi for r in own]
    one = [math.exp(-abs(z)) / (k * (1 + math.exp(-abs(z))) ** 2) / (_cdf(3, r["mu"], r["sigma"]) - _cdf(-2, r["mu"], r["sigma"]))
           for r, k, z in ((r, k, (0.7 - r["mu"]) / k) for r, k in zip(own, s))]
    assert at == pytest.approx(sum(r["weight"] * o for r, o in zip(own, one)) / sum(r["weight"] for r in own))


def test_choices(spark):
    spec, trials, values = _tables(spark, {1: 200})
    shares = Q.choice_shares(spec, Q.split_trials(trials, ["study"]), values, ["study"]).collect()
    seen = _sides(trials.collect(), values.collect(), 1)
    for good, name in ((True, "share_good"), (False, "share_bad")):
        total = sum(_weights(len(seen["c", good])))
        for r in shares:
            mine = sum(w for v, w in zip(seen["c", good], _weights(len(seen["c", good]))) if v == r["choice"])
            assert r[name] == pytest.approx((mine + 1 / 3) / (total + 1))


def _draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48


def test_proposals_follow_the_densities(spark):
    spec, trials, values = _tables(spark, {1: 120, 2: 5})
    got = Q.tpe_candidates(spec, trials, values, 6, seed=3, keys=["study"], n_candidates=8).collect()
    assert len(got) == 2 * 6 * len(PARAMS) and len({(r["study"], r["trial"], r["param"]) for r in got}) == len(got)
    kernels = Q.parzen_kernels(spec, Q.split_trials(trials, ["study"]), values, ["study"]).where("study = 1").collect()
    shares = sorted(Q.choice_shares(spec, Q.split_trials(trials, ["study"]), values, ["study"]).where("study = 1").collect(), key=lambda r: r["position"])
    scale = math.sqrt(3) / math.pi

    def density(side, x, number, step, log):
        total = 0
        for r in side:
            s, edge = r["sigma"], (lambda v: math.log(v) if log else v)
            z = (x - r["mu"]) / (s * scale)
            one = _cdf(edge(number + step / 2), r["mu"], s) - _cdf(edge(number - step / 2), r["mu"], s) if step else math.exp(-abs(z)) / (s * scale * (1 + math.exp(-abs(z))) ** 2)
            total += r["weight"] * one / (_cdf(r["hi"], r["mu"], s) - _cdf(r["lo"], r["mu"], s))
        return total / sum(r["weight"] for r in side)

    for r in got:
        param, kind, low, high, step, log, choices = next(p for p in PARAMS if p[0] == r["param"])
        step = 1.0 if kind == "int" and step is None else step
        if r["param"] != "c":
            assert low <= r["number"] <= high and (not step or (r["number"] - low) / step == round((r["number"] - low) / step))
        else:
            assert r["choice"] in choices
        if r["study"] != 1:
            continue
        tries = []
        for c in range(8):
            u, v = (_draw(3, 1, r["trial"], r["param"], c, what) for what in ("which", "where"))
            if param == "c":
                k = next((s for i, s in enumerate(shares) if u < sum(x["share_good"] for x in shares[:i + 1])), shares[-1])
                tries.append((math.log(k["share_good"]) - math.log(k["share_bad"]), -c, k["choice"]))
                continue
            good, bad = (sorted((k for k in kernels if k["param"] == param and k["good"] == side), key=lambda k: (k["mu"], k["sigma"], k["weight"])) for side in (True, False))
            left = u * sum(k["weight"] for k in good)
            for k in good:
                if left < k["weight"]:
                    break
                left -= k["weight"]
            a, b = _cdf(k["lo"], k["mu"], k["sigma"]), _cdf(k["hi"], k["mu"], k["sigma"])
            p = a + v * (b - a)
            number = k["mu"] + k["sigma"] * scale * math.log(p / (1 - p))
            number = math.exp(number) if log else number
            if step:
                number = low + step * round((number - low) / step)
            number = min(low + step * math.floor((high - low) / step + 1e-9) if step else high, max(low, number))
            x = math.log(number) if log else number
            tries.append((math.log(density(good, x, number, step, log)) - math.log(density(bad, x, number, step, log)), -c, number))
        best = max(tries)
        close = [t[2] for t in tries if best[0] - t[0] < 1e-9]
        assert r["choice"] in close if param == "c" else any(r["number"] == pytest.approx(t) for t in close), (r, best)


def test_proposals_are_better_than_random(spark):
    spec, trials, values = _tables(spark, {i: 150 for i in range(4)}, seed=8)
    loss = lambda df: df.where("param = 'x'").agg(F.avg(F.abs(F.col("number") - 1))).first()[0]
    tpe = Q.tpe_candidates(spec, trials, values, 20, seed=1, keys=["study"])
    early = Q.tpe_candidates(spec, trials, values, 20, seed=1, keys=["study"], n_startup=1000)
    assert loss(tpe) < 0.6 * loss(early)
    again = Q.tpe_candidates(spec.repartition(3), trials.repartition(5), values.repartition(2), 20, seed=1, keys=["study"])
    key = lambda df: sorted((r["study"], r["trial"], r["param"], r["choice"] or round(r["number"], 9)) for r in df.collect())
    assert key(again) == key(tpe)


def test_study_without_trials(spark):
    spec, trials, values = _tables(spark, {1: 30})
    got = Q.tpe_candidates(spec, trials.limit(0), values.limit(0), 3, seed=1, keys=["study"])
    assert got.count() == 3 * len(PARAMS)
    assert Q.tpe_candidates(spec.limit(0), trials, values, 3, seed=1, keys=["study"]).count() == 0


def test_numbers_tried_often_are_one_kernel(spark):
    """40 000 trials of two numbers meet a point as a few kernels, and the density is that of all."""
    kernels = spark.range(40_000).selectExpr("1 AS study", "'x' AS param", "true AS good", "id % 2 * 1.0D AS mu", "0.5D AS sigma", "(id % 7 + 1) / 7.0D AS weight",
                                             "0.0D AS lo", "1.0D AS hi", "false AS log", "cast(NULL AS double) AS step")
    points = spark.createDataFrame([(1, "x", 0, 0.25)], "study int, param string, place int, number double")
    found = Q.densities(kernels, points, ["study"], ["place"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.rindex("Aggregate [") > plan.index("Join")  # summed below the join too
    one = Q.kernel_density(F.lit(0.25), *[F.col(c) for c in ("mu", "sigma", "lo", "hi", "log", "step")])
    expected = kernels.agg(F.sum(F.col("weight") * one) / F.sum("weight")).first()[0]
    assert abs(found.first()["density"] - expected) < 1e-9
