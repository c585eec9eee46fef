"""Proposals of a tree-structured Parzen estimator for many studies at once.

Spaces are described as in ``sweeps`` (keys, param, kind, low, high, step, log, choices). Trials come in two tables: (keys, trial, value),
where a trial without a value is still running, and (keys, trial, param, number, choice) with what each was tried at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from runquarry.functions.hashing import uniform
from runquarry.functions.scale import explode_range, same_keys, written
from runquarry.operators.sweeps import _direction, random_candidates

# At most this many trials are good ones; older trials than the last of these count less and less.
MAX_GOOD, FULL_WEIGHT = 25, 25
_SALTS = 1024
_TO_SCALE = math.sqrt(3) / math.pi  # a logistic distribution's scale from its deviation


def split_trials(trials: DataFrame, keys: Sequence[str], direction: str = "minimize", fraction: float = 0.1) -> DataFrame:
    """(keys, trial, value, good): whether a trial is among the best ``fraction`` of its study's finished ones (rounded up, at most 25).

    Running trials (no value, or NaN) count as bad ones, so that several proposals at once do not all go to the same place
    (a constant liar). Ties go to the lowest trial. The best 25 of a study are found among the best 25 of its
    parts, so a study of any size is ranked by many tasks.
    """
    keys = list(keys)
    order = [F.col("value") * _direction(direction), F.col("trial")]
    done = trials.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "trial", "value")
    sizes = done.groupBy(*keys).agg(F.least(F.ceil(F.count("*") * F.lit(fraction)), F.lit(MAX_GOOD)).alias("_good"))
    salted = done.withColumn("_salt", F.pmod(F.xxhash64("trial"), F.lit(_SALTS)))
    best = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= MAX_GOOD)
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= MAX_GOOD)
    good = same_keys(best.select(*keys, "trial", "_r"), sizes, keys, "inner").where(F.col("_r") <= F.col("_good")).select(*keys, "trial", F.lit(True).alias("good"))
    out = same_keys(trials.select(*keys, "trial", "value"), good, [*keys, "trial"])
    return out.withColumn("good", F.coalesce("good", F.lit(False)))


def _bounds(spec: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per numeric parameter the range on the scale it is searched on; grid points are the middles of cells."""
    step = F.when(F.col("kind") == "int", F.coalesce(F.col("step").cast("double"), F.lit(1.0))).when(F.col("step").isNotNull(), F.col("step").cast("double"))
    log = F.coalesce(F.col("log"), F.lit(False))
    half = F.coalesce(step, F.lit(0.0)) / 2
    low, high = F.col("low").cast("double") - half, F.col("high").cast("double") + half
    scaled = lambda c: F.when(log, F.ln(F.nullif(c, F.lit(0.0)))).otherwise(c)
    return spec.where("kind <> 'categorical'").select(*keys, "param", scaled(low).alias("lo"), scaled(high).alias("hi"), log.alias("log"), step.alias("step"),
                                                      F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


def _weights(split: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observations with their side and weight: 1 for the last 25 of a side, rising to it in steps from 1/n on before."""
    seen = same_keys(values, split.select(*keys, "trial", "good"), [*keys, "trial"], "inner")
    group = [*keys, "param", "good"]
    sizes = seen.groupBy(*group).agg(F.count("*").alias("n"))
    age = F.row_number().over(Window.partitionBy(*group).orderBy("trial")) - 1
    seen = same_keys(seen.withColumn("_i", age), sizes, group, "inner")
    ramp = F.col("n") - FULL_WEIGHT
    rising = 1 / F.col("n") + F.col("_i") * (1 - 1 / F.col("n")) / F.greatest(ramp - 1, F.lit(1))
    return seen.withColumn("weight", F.when(F.col("_i") < ramp, rising).otherwise(F.lit(1.0))).drop("_i")


def parzen_kernels(spec: DataFrame, split: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, param, good, mu, sigma, weight, lo, hi, ...): one kernel per observed number, and one over the whole range per side.

    A kernel's width is the larger gap to its neighbours (among them the middle of the range), clipped to between the
    range over min(100, n + 1) and the range. ``log`` parameters are seen on their logarithm.
    """
    keys = list(keys)
    bounds = _bounds(spec, keys)
    seen = _weights(split, values.where("number IS NOT NULL"), keys)
    x = F.when(F.col("log"), F.ln(F.nullif(F.col("number"), F.lit(0.0)))).otherwise(F.col("number"))
    rows = same_keys(seen, bounds, [*keys, "param"], "inner").select(*keys, "param", "good", "trial", x.alias("mu"), "weight", "n")
    sides = bounds.select(*keys, "param", ((F.col("lo") + F.col("hi")) / 2).alias("mu"), F.explode(F.array(F.lit(True), F.lit(False))).alias("good"))
    whole = sides.select(*keys, "param", "good", F.lit(None).cast("bigint").alias("trial"), "mu", F.lit(1.0).alias("weight"), F.lit(None).cast("bigint").alias("n"))
    near = Window.partitionBy(*keys, "param", "good").orderBy("mu", F.col("trial").asc_nulls_last())
    rows = rows.unionByName(whole).withColumns({"_left": F.col("mu") - F.lag("mu").over(near), "_right": F.lead("mu").over(near) - F.col("mu")})
    rows = same_keys(rows, bounds, [*keys, "param"], "inner")
    range_ = F.col("hi") - F.col("lo")
    gap = F.greatest("_left", "_right")  # at an end there is but one
    clipped = F.least(range_, F.greatest(range_ / F.least(F.lit(100.0), F.col("n") + 1), gap))
    return rows.withColumn("sigma", F.when(F.col("trial").isNull(), range_).otherwise(clipped)).drop("_left", "_right", "n")


def _below(x: Column, mu: Column, sigma: Column) -> Column:
    """Distribution function of a kernel. It is logistic, so that it and its inverse are plain expressions."""
    return 1 / (1 + F.exp(-(x - mu) / (sigma * _TO_SCALE)))


def kernel_density(x: Column, mu: Column, sigma: Column, lo: Column, hi: Column, log: Column, step: Column) -> Column:
    """A kernel's density at ``x``, cut to its range; for a grid point the mass of its cell."""
    z = (x - mu) / (sigma * _TO_SCALE)
    peak = F.exp(-F.abs(z)) / (sigma * _TO_SCALE * F.pow(1 + F.exp(-F.abs(z)), F.lit(2.0)))
    number = F.when(log, F.exp(x)).otherwise(x)
    edge = lambda sign: F.when(log, F.ln(number + sign * step / 2)).otherwise(number + sign * step / 2)
    mass = _below(edge(1), mu, sigma) - _below(edge(-1), mu, sigma)
    return F.when(step.isNull(), peak).otherwise(mass) / (_below(hi, mu, sigma) - _below(lo, mu, sigma))


def densities(kernels: DataFrame, points: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(keys, param, ids, good, density) of numbers under both sides; ``points`` is (keys, param, ids, number).

    Kernels of one place and width differ in their weights only and count as one, so a number that was tried often costs
    no more. Points meet the kernels of their study and parameter in a join; their densities are combined before the shuffle.
    """
    keys = [*keys, "param"]
    merged = kernels.groupBy(*keys, "good", "mu", "sigma", "lo", "hi", "log", "step").agg(F.sum("weight").alias("weight"))
    at = same_keys(points, merged, keys, "inner")
    x = F.when(F.col("log"), F.ln(F.nullif(F.col("number"), F.lit(0.0)))).otherwise(F.col("number"))
    one = kernel_density(x, *[F.col(c) for c in ("mu", "sigma", "lo", "hi", "log", "step")])
    return at.groupBy(*keys, *ids, "number", "good").agg((F.sum(F.col("weight") * one) / F.sum("weight")).alias("density"))


def choice_shares(spec: DataFrame, split: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, param, choice, position, share_good, share_bad): smoothed shares of each choice on both sides; all choices together are given
    the weight of one trial beforehand."""
    keys = list(keys)
    options = spec.where("kind = 'categorical'").select(*keys, "param", F.size("choices").alias("_k"), F.posexplode("choices").alias("position", "choice"))
    seen = _weights(split, values.where("choice IS NOT NULL"), keys)
    per = seen.groupBy(*keys, "param", "choice").agg(*[F.sum(F.when(F.col("good") == side, F.col("weight")).otherwise(0.0)).alias(n) for side, n in ((True, "_g"), (False, "_b"))])
    rows = same_keys(options, per, [*keys, "param", "choice"]).fillna(0.0, ["_g", "_b"])
    w = Window.partitionBy(*keys, "param")  # the choices of one parameter
    share = lambda c: (F.col(c) + 1 / F.col("_k")) / (F.sum(c).over(w) + 1)
    return rows.select(*keys, "param", "choice", "position", share("_g").alias("share_good"), share("_b").alias("share_bad"))


def tpe_candidates(spec: DataFrame, trials: DataFrame, values: DataFrame, n_trials: int, seed: int, keys: Sequence[str], direction: str = "minimize",
                   n_startup: int = 10, n_candidates: int = 24, fraction: float = 0.1) -> DataFrame:
    """(keys, trial, param, number, choice): ``n_trials`` proposals per study of ``spec``, numbered from 0 like ``random_candidates``.

    Per parameter ``n_candidates`` values are drawn from the density of the good trials, and the one with the highest ratio of
    good to bad density is proposed; of equal ones the first. Draws depend on (seed, keys, trial, param, candidate)
    only. A study with fewer than ``n_startup`` finished trials gets random draws. Numbers of a grid are grid points.
    """
    keys = list(keys)
    studies = spec.select(*keys).distinct()
    done = trials.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys).agg(F.count("*").alias("_n"))
    ready = written(same_keys(studies, done, keys).withColumn("_ready", F.coalesce("_n", F.lit(0)) >= n_startup).select(*keys, "_ready"))
    own = same_keys(spec, ready.where("_ready"), keys, "left_semi")
    split = written(split_trials(same_keys(trials, ready.where("_ready"), keys, "left_semi"), keys, direction, fraction))
    kernels = written(parzen_kernels(own, split, values, keys))

    asked = explode_range(own.select(*keys, "param", "kind", F.lit(n_trials).alias("_t")), F.col("_t"), "trial")
    asked = asked.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    draw = lambda what: uniform(seed, *[F.col(k) for k in keys], F.col("trial"), F.col("param"), F.col("candidate"), F.lit(what))
    asked = asked.withColumns({"_u": draw("which"), "_v": draw("where")})

    # at most 26 good kernels per parameter
    good = kernels.where("good").groupBy(*keys, "param", "lo", "hi", "log", "step", "low", "high").agg(F.sort_array(F.collect_list(F.struct("mu", "sigma", "weight"))).alias("_ks"))
    total = F.aggregate("_ks", F.lit(0.0), lambda a, k: a + k["weight"])
    start = F.struct((F.col("_u") * total).alias("left"), F.lit(None).cast("double").alias("mu"), F.lit(None).cast("double").alias("sigma"))
    chosen = F.aggregate("_ks", start, lambda a, k: F.struct(
        (a["left"] - k["weight"]).alias("left"), F.when(a["mu"].isNull() & (a["left"] < k["weight"]), k["mu"]).otherwise(a["mu"]).alias("mu"),
        F.when(a["mu"].isNull() & (a["left"] < k["weight"]), k["sigma"]).otherwise(a["sigma"]).alias("sigma")))
    numeric = same_keys(asked.where("kind <> 'categorical'"), good, [*keys, "param"], "inner").withColumn("_c", chosen)
    mu, sigma = F.coalesce("_c.mu", F.element_at("_ks", -1)["mu"]), F.coalesce("_c.sigma", F.element_at("_ks", -1)["sigma"])
    numeric = numeric.withColumns({"_mu": mu, "_sigma": sigma})
    low, high = _below(F.col("lo"), F.col("_mu"), F.col("_sigma")), _below(F.col("hi"), F.col("_mu"), F.col("_sigma"))
    at = low + F.col("_v") * (high - low)
    x = F.col("_mu") + F.col("_sigma") * _TO_SCALE * F.ln(at / (1 - at))
    number = F.when(F.col("log"), F.exp(x)).otherwise(x)
    steps = F.when(F.col("step").isNotNull(), F.col("low") + F.col("step") * F.round((number - F.col("low")) / F.nullif("step", F.lit(0.0))))
    last = F.col("low") + F.col("step") * F.floor((F.col("high") - F.col("low")) / F.nullif("step", F.lit(0.0)) + 1e-9)
    number = F.least(F.coalesce(last, F.col("high")), F.greatest(F.col("low"), F.coalesce(steps, number)))
    points = written(numeric.select(*keys, "param", "trial", "candidate", number.alias("number")))
    sides = densities(kernels, points, keys, ["trial", "candidate"]).groupBy(*keys, "param", "trial", "candidate", "number").agg(
        F.max(F.when(F.col("good"), F.col("density"))).alias("g"), F.max(F.when(~F.col("good"), F.col("density"))).alias("b"))
    ratio = F.ln(F.greatest("g", F.lit(1e-300))) - F.ln(F.greatest("b", F.lit(1e-300)))
    numbers = sides.groupBy(*keys, "trial", "param").agg(F.max_by("number", F.struct(ratio, -F.col("candidate"))).alias("number"))

    shares = choice_shares(own, split, values, keys).groupBy(*keys, "param").agg(F.sort_array(F.collect_list(F.struct("position", "choice", "share_good", "share_bad"))).alias("_ks"))
    pick = F.aggregate("_ks", F.struct(F.col("_u").alias("left"), F.lit(None).cast("int").alias("at")), lambda a, k: F.struct(
        (a["left"] - k["share_good"]).alias("left"), F.when(a["at"].isNull() & (a["left"] < k["share_good"]), k["position"]).otherwise(a["at"]).alias("at")))
    texts = same_keys(asked.where("kind = 'categorical'"), shares, [*keys, "param"], "inner").withColumn("_at", F.coalesce(pick["at"], F.size("_ks") - 1))
    texts = texts.withColumn("_k", F.get("_ks", F.col("_at")))
    texts = texts.groupBy(*keys, "trial", "param").agg(F.max_by(F.col("_k.choice"), F.struct(F.ln("_k.share_good") - F.ln("_k.share_bad"), -F.col("candidate"))).alias("choice"))

    late = random_candidates(same_keys(spec, ready.where("NOT _ready"), keys, "left_semi"), n_trials, seed, keys)
    proposed = numbers.withColumn("choice", F.lit(None).cast("string")).unionByName(texts.withColumn("number", F.lit(None).cast("double")), allowMissingColumns=True)
    return proposed.select(*keys, "trial", "param", "number", "choice").unionByName(late.select(*keys, "trial", "param", "number", "choice"))
