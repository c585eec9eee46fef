"""Hyperparameter sweeps: search spaces, candidates, trial analysis and model fits per combination.

A search space is a DataFrame with one row per (study, param): ``param, kind`` (categorical, int, float),
``low, high, step, log, choices``.
"""

from __future__ import annotations

import math
import threading
import time
import traceback
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from runquarry.functions.hashing import hash_int, hash_key, uniform
from runquarry.functions.scale import bounded, explode_range, materialize, running_below, same_keys
from runquarry.functions.text import column_text, double_text

SEED_BOUND = 2**31 - 1


# ---- discretised spaces

def _grid_size() -> Column:
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    step = F.coalesce(F.col("step").cast("double"), F.lit(1.0))
    bad_log = F.raise_error(F.concat(F.lit("a log grid needs a step above 1: "), F.col("param"))).cast("bigint")
    log_n = F.floor(F.ln(high / F.nullif(low, F.lit(0.0))) / F.ln(F.when(step > 1, step))) + 1
    n = F.when(F.coalesce(F.col("log"), F.lit(False)), F.coalesce(log_n.cast("bigint"), bad_log)).otherwise(
        (F.floor((high - low) / F.nullif(step, F.lit(0.0))) + 1).cast("bigint"))
    return F.when(F.col("kind") == "categorical", F.size("choices").cast("bigint")).otherwise(n)


def _grid_number(position: Column, n: Column) -> Column:
    """Point ``position`` of ``n`` evenly spaced ones that include both ends."""
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    parts = F.nullif((n - 1).cast("double"), F.lit(0.0))
    linear = F.when(position == 0, low).when(position == n - 1, high).otherwise(low + position * ((high - low) / parts))
    log_low, log_high = F.log10(F.nullif(low, F.lit(0.0))), F.log10(F.nullif(high, F.lit(0.0)))
    at = F.when(position == 0, log_low).when(position == n - 1, log_high).otherwise(log_low + position * ((log_high - log_low) / parts))
    value = F.when(F.coalesce(F.col("log"), F.lit(False)), F.pow(F.lit(10.0), at)).otherwise(linear)
    value = F.when(F.col("kind") == "int", F.floor(value).cast("double")).otherwise(value)
    return F.when(F.col("kind") != "categorical", value)


def discretize_space(spec: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, param, position, number, choice): the points of each parameter, both ends included.

    Numbers are evenly spaced (on a log scale for ``log``): floor((high-low)/step)+1 points, so the spacing
    differs from ``step`` where it does not divide the range. ``step`` is 1 by default; ints are rounded down.
    """
    sized = spec.withColumn("_n", _grid_size())
    points = explode_range(sized, F.col("_n"), "position")
    choice = F.when(F.col("kind") == "categorical", F.get(F.col("choices"), F.col("position").cast("int")))
    return points.select(*keys, "param", "position", _grid_number(F.col("position"), F.col("_n")).alias("number"), choice.alias("choice"))


def grid_candidates(spec: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, trial, params): all combinations of each study's discretised space as maps of text.

    Parameters are taken in name order, the last one varies fastest. A trial is decoded from its number, so a
    large grid is spread over the cluster without a join.
    """
    points = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda i: _grid_number(i, F.col("_n")))
    as_text = F.transform(points, lambda x: F.when(F.col("kind") == "int", x.cast("bigint").cast("string")).otherwise(double_text(x)))
    options = F.when(F.col("kind") == "categorical", F.col("choices")).otherwise(as_text)
    per_param = spec.withColumn("_n", _grid_size()).select(*keys, F.struct(F.col("param"), options.alias("options")).alias("_p"))
    studies = per_param.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    total = F.aggregate("_ps", F.lit(1).cast("bigint"), lambda acc, p: acc * F.size(p["options"]))
    trials = explode_range(studies.withColumn("_total", total), F.col("_total"), "trial")
    start = F.struct(F.col("trial").alias("rest"), F.create_map().cast("map<string,string>").alias("params"))
    decoded = F.aggregate(F.reverse("_ps"), start, lambda acc, p: F.struct(
        F.floor(acc["rest"] / F.size(p["options"])).cast("bigint").alias("rest"),
        F.map_concat(acc["params"], F.create_map(p["param"], F.get(p["options"], (acc["rest"] % F.size(p["options"])).cast("int")))).alias("params")))
    return trials.select(*keys, "trial", decoded["params"].alias("params"))


def random_candidates(spec: DataFrame, n_trials: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """(keys, trial, param, number, choice): independent draws; each depends on (seed, keys, trial, param) only."""
    rows = explode_range(spec.withColumn("_t", F.lit(n_trials)), F.col("_t"), "trial")
    u = uniform(seed, *[F.col(k) for k in keys], F.col("trial"), F.col("param"))
    low, high, step = F.col("low").cast("double"), F.col("high").cast("double"), F.col("step").cast("double")
    log = F.coalesce(F.col("log"), F.lit(False))
    step_or_one = F.coalesce(step, F.lit(1.0))
    stepped = low + step_or_one * F.floor(u * (F.floor((high - low) / F.nullif(step_or_one, F.lit(0.0))) + 1))

    def log_uniform(a: Column, b: Column) -> Column:
        return F.exp(F.ln(F.nullif(a, F.lit(0.0))) + u * (F.ln(F.nullif(b, F.lit(0.0))) - F.ln(F.nullif(a, F.lit(0.0)))))

    number = (F.when(F.col("kind") == "categorical", F.lit(None).cast("double"))
              .when((F.col("kind") == "int") & log, F.least(high, F.greatest(low, F.round(log_uniform(low - 0.5, high + 0.5)))))
              .when(F.col("kind") == "int", stepped).when(log, log_uniform(low, high))
              .when(step.isNotNull(), stepped).otherwise(low + u * (high - low)))
    choice = F.when(F.col("kind") == "categorical", F.get(F.col("choices"), F.floor(u * F.size("choices")).cast("int")))
    return rows.select(*keys, "trial", "param", number.alias("number"), choice.alias("choice"))


def candidate_queue(defaults: DataFrame, sampled: DataFrame, n_trials: int, keys: Sequence[str], sampler: str = "random") -> DataFrame:
    """Trials in running order: each study's defaults first (not for a grid), then the sampled ones, ``n_trials`` in all.

    Both inputs number their rows from 0 in ``trial``; the numbers are shifted, not ranked, so nothing is sorted.
    """
    if sampler == "grid":
        return sampled.where(F.col("trial") < n_trials)
    counts = defaults.groupBy(*keys).agg(F.count("*").alias("_d"))
    shifted = same_keys(sampled, counts, keys).withColumn("trial", F.col("trial") + F.coalesce(F.col("_d"), F.lit(0))).drop("_d")
    return defaults.unionByName(shifted.select(*defaults.columns)).where(F.col("trial") < n_trials)


def trial_seeds_keys(trials: DataFrame, combination: Sequence[str], hpo_seed: int = 0) -> DataFrame:
    """Add ``random_seed`` (below 2^31-1) and ``trial_key`` (combination values joined by ``_``, then ``-<trial>``).

    Values count as they are logged (``functions/text.py``): ``True``, ``0.0001``, ``None``.
    """
    joined = F.concat_ws("_", *[column_text(trials, c) for c in combination])
    return trials.withColumns({"random_seed": hash_int(SEED_BOUND, hpo_seed, *[column_text(trials, c, none=None) for c in combination], F.col("trial")),
                               "trial_key": F.concat(joined, F.lit("-"), F.col("trial").cast("string"))})


# ---- trial analysis

def _direction(direction: str) -> int:
    if direction not in ("minimize", "maximize"):
        raise ValueError(f"unknown direction: {direction}")
    return 1 if direction == "minimize" else -1


def trial_objective(trials: DataFrame, metric: str, direction: str = "minimize", result: str = "result") -> DataFrame:
    """Add ``value``: the metric of the result map, the worst possible value where it is missing, NULL without a result."""
    worst = F.lit(_direction(direction) * math.inf)
    found = F.try_element_at(F.col(result), F.lit(metric)).cast("double")
    return trials.withColumn("value", F.when(F.col(result).isNotNull(), F.coalesce(found, worst)))


def effective_trials(trials: DataFrame, keys: Sequence[str], timeout_total: float = 0, elapsed: str = "elapsed") -> DataFrame:
    """Trials that were started within the time budget: the one that passes it is the last. 0 means no limit."""
    if timeout_total <= 0:
        return trials
    spent = running_below(trials.groupBy(*keys, "trial").agg(F.sum(elapsed).alias("_e")), keys, "trial", ["_e"], few_rows=0)
    started = spent.where(F.col("below__e") <= timeout_total).select(*keys, "trial")
    return same_keys(trials, started, [*keys, "trial"], "left_semi")


def best_trial(trials: DataFrame, keys: Sequence[str], direction: str = "minimize") -> DataFrame:
    """The best trial of each study; trials without a value are left out, ties go to the lowest number."""
    rated = trials.where(F.col("value").isNotNull() & ~F.isnan("value"))
    place = F.struct((F.col("value") * _direction(direction)).alias("v"), F.col("trial").alias("t"))
    rest = [c for c in trials.columns if c not in keys]
    best = rated.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_b"))
    return best.select(*keys, "_b.*")


def best_summary(best: DataFrame, keys: Sequence[str], metric: str) -> tuple[DataFrame, DataFrame]:
    """(keys, key, value) of the best trials' results and of their parameters, under ``best/`` names.

    A best trial without the metric means that every trial failed; that raises.
    """
    lost = F.raise_error(F.lit(f"metric {metric} not found in the best trial, every trial may have failed"))
    result = F.when(F.try_element_at("result", F.lit(metric)).isNull(), lost.cast("map<string,double>")).otherwise(F.col("result"))
    numbers = F.map_concat(F.transform_keys(result, lambda k, _: F.concat(F.lit("best/"), k)), F.create_map(F.lit("best/value"), F.col("value")))
    texts = F.map_concat(F.transform_keys("params", lambda k, _: F.concat(F.lit("best/"), k)),
                         F.create_map(F.lit("best/child_run_id"), F.col("child_run_id").cast("string")))
    return best.select(*keys, F.explode(numbers).alias("key", "value")), best.select(*keys, F.explode(texts).alias("key", "value"))


def schedule_child_runs(parents: DataFrame, tags: DataFrame, n_trials: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New SCHEDULED runs, their parent tags, and the parents' ``child_run_id_<i>`` tags; parents with children are skipped."""
    known = tags.where(F.col("key").startswith("child_run_id_")).select("run_uuid").distinct()
    new = parents.select("run_uuid", "experiment_id").join(known, "run_uuid", "left_anti")
    rows = explode_range(new.withColumn("_t", F.lit(n_trials)), F.col("_t"), "trial")
    rows = rows.withColumn("child", hash_key(F.col("run_uuid"), F.col("trial")))
    runs = rows.select(F.col("child").alias("run_uuid"), "experiment_id", F.lit("SCHEDULED").alias("status"), F.lit("active").alias("lifecycle_stage"))
    up = rows.select(F.col("child").alias("run_uuid"), F.lit("mlflow.parentRunId").alias("key"), F.col("run_uuid").alias("value"))
    down = rows.select("run_uuid", F.concat(F.lit("child_run_id_"), F.col("trial").cast("string")).alias("key"), F.col("child").alias("value"))
    return runs, up, down


# Why a search stopped early -> (tag on the parent, text on its unrun children).
STOP_REASONS = {"grid": ("grid_search_stopped", "Grid search stopped."), "timeout": ("elapsed_time_timed_out", "Elapsed time timed out.")}


def close_scheduled_children(runs: DataFrame, links: DataFrame, stopped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with the still SCHEDULED children of stopped parents set to FAILED, and the tags to set.

    ``links`` is (parent_run, child_run), ``stopped`` is (parent_run, reason, n_trials_effective).
    """
    def by_reason(i: int) -> Column:
        c = F.lit(None).cast("string")
        for reason, texts in STOP_REASONS.items():
            c = F.when(F.col("reason") == reason, texts[i]).otherwise(c)
        return c

    unrun = (links.join(stopped, "parent_run").select(F.col("child_run").alias("run_uuid"), "reason").distinct()
             .join(runs.where(F.col("status") == "SCHEDULED").select("run_uuid"), "run_uuid", "left_semi"))
    closed = runs.join(unrun.select("run_uuid", F.lit(True).alias("_closed")), "run_uuid", "left")
    closed = closed.withColumn("status", F.when(F.col("_closed"), "FAILED").otherwise(F.col("status"))).select(*runs.columns)

    def rows(df: DataFrame, run: str, *pairs: tuple[Column, Column]) -> DataFrame:
        items = F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in pairs])
        return df.select(F.col(run).alias("run_uuid"), F.explode(items).alias("_t")).select("run_uuid", "_t.*")

    child_tags = rows(unrun, "run_uuid", (F.lit("raised_exception"), F.lit("True")), (F.lit("EXCEPTION"), by_reason(1)))
    parent_tags = rows(stopped, "parent_run", (by_reason(0), F.lit("True")),
                       (F.lit("n_trials_effective"), F.col("n_trials_effective").cast("string")))
    return closed, child_tags.unionByName(parent_tags)


# ---- early stopping

def halving_survivors(log: DataFrame, keys: Sequence[str], direction: str = "maximize", reduction_factor: int = 4,
                      min_resource: int = 10, bracket: str | None = None) -> DataFrame:
    """(keys, trial, rung, value, survived) of successive halving over a log of (keys, trial, step, value).

    At step ``min_resource * factor^rung`` the runs still alive that got there are compared by their last value up
    to that step and the best 1/factor (at least one) go on; ties go to the lowest trial. With a ``bracket``
    column the first rung of a bracket is ``bracket`` factors later, and brackets do not compete.
    """
    sign = _direction(direction)
    group = [*keys, bracket] if bracket else list(keys)
    later = F.col(bracket) if bracket else F.lit(0)
    reach = F.ln(F.max("_end") / F.lit(min_resource)) / F.lit(math.log(reduction_factor))
    ends = log.groupBy(*group, "trial").agg(F.max("step").alias("_end"))
    sizes = ends.groupBy(*group).agg(reach.alias("r")).agg(F.max(F.col("r") - later).alias("r")).first()
    rungs = 0 if sizes["r"] is None or sizes["r"] < 0 else int(math.floor(sizes["r"] + 1e-9)) + 1
    if not rungs:
        return log.select(*group, "trial", F.lit(0).alias("rung"), "value", F.lit(True).alias("survived")).where(F.lit(False))
    steps = [F.lit(min_resource) * F.pow(F.lit(float(reduction_factor)), later + rung) for rung in range(rungs)]
    # one pass over the log: per trial its last value up to each rung's step, NULL where it did not get there
    last = [F.max(F.when(F.col("step") <= at, F.struct("step", "value")))["value"].alias(f"_v{rung}") for rung, at in enumerate(steps)]
    trials = log.groupBy(*group, "trial").agg(F.max("step").alias("_end"), *last)
    trials = trials.select(*group, "trial", *[F.when(F.col("_end") >= at, F.col(f"_v{rung}")).alias(f"_v{rung}") for rung, at in enumerate(steps)])
    here, parts = materialize(trials), []
    for rung in range(rungs):
        # a rung's rows are fixed once; the next rung reads only those of them that went on
        rows = here.where(F.col(f"_v{rung}").isNotNull()).withColumn("_order", F.col(f"_v{rung}") * sign)
        part = materialize(_best_share(rows, group, reduction_factor).drop("_order"))
        parts.append(part.select(*group, "trial", F.lit(rung).alias("rung"), F.col(f"_v{rung}").alias("value"), F.col("_survived").alias("survived")))
        here = part.where("_survived").drop("_survived")
    return reduce(DataFrame.unionByName, parts)


def _best_share(rows: DataFrame, group: Sequence[str], factor: int, margin: float = 0.002) -> DataFrame:
    """Add ``_survived``: whether a row is among the first 1/factor (at least one) of its group by ``_order`` and trial.

    Only the value at that place is wanted, so nothing is sorted whole: approximate quantiles on both sides of it serve as
    edges, the rows below and up to them are counted, and a window ranks what lies between, a few thousandths of
    a group. Where the counts show that the place is not between the edges, all rows of the group are ranked.
    """
    group = list(group)
    clean = F.when(~F.isnan("_order"), F.col("_order"))
    edges = F.percentile_approx(clean, [max(0.0, 1 / factor - margin), min(1.0, 1 / factor + margin)], 10_000)
    stats = rows.groupBy(*group).agg(F.greatest(F.lit(1), F.floor(F.count("*") / F.lit(factor))).alias("_quota"), edges.alias("_e"))
    stats = bounded(stats.select(*group, "_quota", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi")))
    placed = same_keys(rows, stats, group, "inner")
    counted = placed.groupBy(*group).agg(F.count_if(F.col("_order") < F.col("_lo")).alias("_below"),
                                         F.count_if(F.col("_order") <= F.col("_hi")).alias("_upto"), F.max("_quota").alias("_q"))
    sound = F.coalesce((F.col("_below") < F.col("_q")) & (F.col("_q") <= F.col("_upto")), F.lit(False))
    counted = bounded(counted.select(*group, F.when(sound, F.col("_below")).otherwise(0).alias("_start"), sound.alias("_sound")))
    placed = same_keys(placed, counted, group, "inner")
    between = ~F.col("_sound") | F.coalesce(F.col("_order").between(F.col("_lo"), F.col("_hi")), F.lit(False))
    place = F.col("_start") + F.row_number().over(Window.partitionBy(*group).orderBy("_order", "trial"))
    decided = placed.where(~between).withColumn("_survived", F.col("_order") < F.col("_lo"))
    ranked = placed.where(between).withColumn("_survived", place <= F.col("_quota"))
    return decided.unionByName(ranked).drop("_quota", "_lo", "_hi", "_start", "_sound")


HYPERBAND_BRACKETS = 5


def hyperband_survivors(log: DataFrame, keys: Sequence[str], max_resources: int, direction: str = "maximize") -> DataFrame:
    """Successive halving in five brackets (trial number modulo 5) with factor floor(max_resources^(1/4)) from step 1 on."""
    factor = math.floor(max_resources ** (1 / (HYPERBAND_BRACKETS - 1)) + 1e-9)
    if factor < 2:
        raise ValueError("five brackets need at least 16 resources")
    bracketed = log.withColumn("bracket", (F.col("trial") % HYPERBAND_BRACKETS).cast("int"))
    return halving_survivors(bracketed, keys, direction, factor, 1, bracket="bracket")


def bagged_objective(results: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean metric over the bagged fits of each trial."""
    return results.groupBy(*keys).agg(F.avg(metric).alias("value"), F.count(metric).alias("n_bagging"))


# ---- fits per combination

def sweep_linear(df: DataFrame, groups: Sequence[str], fold: str, x: str, y: str, penalties: Sequence[float]) -> DataFrame:
    """(groups, fold, penalty, slope, intercept, test_mse) of a one-feature ridge line fitted on the other folds.

    One pass takes centred moments per (group, fold). The training moments are those of the whole group
    without the fold's, and the test error follows from the fold's own, so the data is read once for
    any number of folds and penalties.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).cast("double")
    used = df.where(a.isNotNull() & b.isNotNull())
    own = used.groupBy(*groups, fold).agg(n.alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), (F.var_pop(a) * n).alias("sxx"),
                                          (F.covar_pop(a, b) * n).alias("sxy"), (F.var_pop(b) * n).alias("syy"))
    # from here on one row per fold
    w = Window.partitionBy(*groups)
    c = F.col
    own = own.withColumn("all_n", F.sum("n").over(w)).withColumns(
        {"all_x": F.sum(c("n") * c("mx")).over(w) / c("all_n"), "all_y": F.sum(c("n") * c("my")).over(w) / c("all_n")})
    dx, dy = c("mx") - c("all_x"), c("my") - c("all_y")
    own = own.withColumns({"all_xx": F.sum(c("sxx") + c("n") * dx * dx).over(w), "all_xy": F.sum(c("sxy") + c("n") * dx * dy).over(w),
                           "tn": c("all_n") - c("n")}).where(c("tn") > 0)
    own = own.withColumns({"tx": (c("all_n") * c("all_x") - c("n") * c("mx")) / c("tn"), "ty": (c("all_n") * c("all_y") - c("n") * c("my")) / c("tn")})
    weight, dx, dy = c("n") * c("tn") / c("all_n"), c("mx") - c("tx"), c("my") - c("ty")
    own = own.withColumns({"txx": c("all_xx") - c("sxx") - weight * dx * dx, "txy": c("all_xy") - c("sxy") - weight * dx * dy})
    grid = own.withColumn("penalty", F.explode(F.array(*[F.lit(float(v)) for v in penalties])))
    grid = grid.withColumn("slope", F.coalesce(c("txy") / F.nullif(c("txx") + c("penalty"), F.lit(0.0)), F.lit(0.0)))
    grid = grid.withColumn("intercept", c("ty") - c("slope") * c("tx"))
    bias = c("my") - c("intercept") - c("slope") * c("mx")
    spread = (c("syy") - 2 * c("slope") * c("sxy") + c("slope") * c("slope") * c("sxx")) / c("n")
    return grid.select(*groups, fold, "penalty", "slope", "intercept", (spread + bias * bias).alias("test_mse"))


def sweep_grouped_udf(df: DataFrame, combination: Sequence[str], summarise: Callable[[pd.DataFrame], Mapping[str, float]],
                      summary: Sequence[str], train: Callable[[Mapping[str, float], Mapping[str, object]], Mapping[str, float]],
                      raise_on_error: bool = False) -> DataFrame:
    """Fit and evaluate user code for every combination of ``combination`` values in the data.

    ``summarise`` turns any part of a combination's rows into sums (named in ``summary``); Spark adds the sums
    up, so no task ever holds a whole combination. ``train`` gets the totals and the combination and returns
    metrics. An exception in either becomes a FAILED row, or is raised again with ``raise_on_error``.

    Result: combination, status, exception, elapsed, metrics (a map). NULL is a value of a combination like any other, and
    reaches ``train`` as None. For models that need all rows at once see ``fits.fit_combinations``.
    """
    combination, summary = list(combination), list(summary)
    fields = {f.name: f for f in df.schema.fields}
    key_fields = [T.StructField(c, fields[c].dataType) for c in combination]
    flagged = [c for c in combination if isinstance(fields[c].dataType, (T.FloatType, T.DoubleType))]  # pandas holds NULL as NaN
    flag_fields = [T.StructField(f"_null_{c}", T.BooleanType()) for c in flagged]
    part_schema = T.StructType(key_fields + [T.StructField(s, T.DoubleType()) for s in summary] + [T.StructField("_failure", T.StringType())] + flag_fields)

    def frame(rows: list[list], schema: T.StructType) -> pd.DataFrame:
        """Columns of plain objects: pandas would guess another type where a batch has nothing but NULL."""
        columns = zip(*rows) if rows else [[] for _ in schema.fields]
        return pd.DataFrame({f.name: pd.Series(list(c), dtype=object) for f, c in zip(schema.fields, columns)})

    def key_values(values: tuple, nulls: tuple) -> list:
        """A group's values without pandas' stand-ins for NULL."""
        flags = dict(zip(flagged, nulls))
        return [None if flags.get(c, c not in flags and pd.isna(v)) else v for c, v in zip(combination, values)]

    def failure(error: Exception) -> str:
        return traceback.format_exception_only(error)[-1].strip()

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values, part in batch.groupby([*combination, *[f"_null_{c}" for c in flagged]], dropna=False, sort=False):
                values, part = key_values(values[:len(combination)], values[len(combination):]), part.drop(columns=[f"_null_{c}" for c in flagged])
                try:
                    sums, failed = summarise(part), None
                    sums = [float(sums[s]) for s in summary]
                except Exception as error:  # noqa: BLE001 - a failed part fails its combination only
                    if raise_on_error:
                        raise
                    sums, failed = [None] * len(summary), failure(error)
                rows.append([*values, *sums, failed, *[v is None for c, v in zip(combination, values) if c in flagged]])
            yield frame(rows, part_schema)

    out_schema = T.StructType(key_fields + [T.StructField("status", T.StringType()), T.StructField("exception", T.StringType()),
                                            T.StructField("elapsed", T.DoubleType()),
                                            T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))] + flag_fields)

    def fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                start = time.perf_counter()
                flags = [record[f"_null_{c}"] for c in flagged]
                record |= zip(combination, key_values([record[c] for c in combination], flags))
                if not pd.isna(record["_failure"]):
                    rows.append([*[record[c] for c in combination], "FAILED", record["_failure"], time.perf_counter() - start, {}, *flags])
                    continue
                try:
                    metrics = train({s: record[s] for s in summary}, {c: record[c] for c in combination})
                    result = ["FINISHED", None, {k: float(v) for k, v in metrics.items()}]
                except Exception as error:  # noqa: BLE001 - a failed combination is a result
                    if raise_on_error:
                        raise
                    result = ["FAILED", failure(error), {}]
                rows.append([*[record[c] for c in combination], result[0], result[1], time.perf_counter() - start, result[2], *flags])
            yield frame(rows, out_schema)

    def with_flags(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"_null_{c}": F.col(c).isNull() for c in flagged}) if flagged else rows

    def without_flags(rows: DataFrame) -> DataFrame:
        """NaN comes back from pandas as NULL."""
        nan = F.lit(float("nan"))
        return rows.withColumns({c: F.when(F.col(c).isNull() & ~F.col(f"_null_{c}"), nan).otherwise(F.col(c)) for c in flagged}).drop(*[f.name for f in flag_fields]) if flagged else rows

    parts = without_flags(with_flags(df).mapInPandas(partial_sums, part_schema))
    sums = parts.groupBy(*combination).agg(*[F.sum(s).alias(s) for s in summary], F.min("_failure").alias("_failure"))
    return without_flags(with_flags(sums).mapInPandas(fit_rows, out_schema))


def sweep_ml_estimator(df: DataFrame, estimator: Estimator, grid: Sequence[Mapping[str, object]],
                       evaluate: Callable[[DataFrame], DataFrame], test: DataFrame | None = None,
                       raise_on_error: bool = False, concurrent: int = 1, timeout: float | None = None) -> DataFrame:
    """Fit a ``pyspark.ml`` estimator for each parameter setting of a (short) grid and evaluate it.

    Every fit and evaluation is itself a distributed job; ``evaluate`` turns predictions into one row of metrics. The
    rows are kept in memory, or on disk where that is full, during the loop. Without ``test`` the training rows are evaluated.

    Up to ``concurrent`` settings run side by side, each in a scheduler pool of its own (with ``spark.scheduler.mode`` FAIR they share
    the executors evenly; without it a later one takes what an earlier one leaves). The jobs of a setting that takes longer than
    ``timeout`` seconds are cancelled, and it becomes a FAILED row like one that raises; the others go on.
    """
    spark = df.sparkSession
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    test = df if test is None else test.persist(StorageLevel.MEMORY_AND_DISK)

    def fit(setting: Mapping[str, object]) -> Mapping[str, object]:
        model = estimator.fit(df, {estimator.getParam(k): v for k, v in setting.items()})
        return evaluate(model.transform(test)).first().asDict()

    try:
        with ThreadPoolExecutor(max(1, concurrent)) as pool:
            def run(n: int, setting: Mapping[str, object]) -> tuple:
                return _fit_one(spark.sparkContext, n % max(1, concurrent), lambda: fit(setting), timeout, raise_on_error)

            # wrapped once each: what is wrapped together shares its job group
            found = [pool.submit(inheritable_thread_target(spark)(run), n, setting) for n, setting in enumerate(grid)]
            rows = [(n, {k: str(v) for k, v in setting.items()}, *f.result()) for n, (setting, f) in enumerate(zip(grid, found))]
    finally:
        test.unpersist()
        df.unpersist()
    schema = ("trial int, params map<string,string>, status string, exception string, elapsed double, metrics map<string,double>")
    return spark.createDataFrame(rows, schema)


def _fit_one(context, pool: int, fit: Callable[[], Mapping[str, object]], timeout: float | None, raise_on_error: bool) -> tuple:
    """(status, exception, elapsed, metrics) of one setting, whose jobs are a group that is cancelled at the deadline."""
    start, group, done, late = time.perf_counter(), f"fit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(timeout):
            late.set()
            while not done.wait(0.2):  # a fit of many jobs may start another one after its last was cancelled
                context.cancelJobGroup(group)

    context.setJobGroup(group, "one setting of a sweep", interruptOnCancel=True)
    context.setLocalProperty("spark.scheduler.pool", f"fits-{pool}")
    if timeout:
        threading.Thread(target=watch, daemon=True).start()
    try:
        metrics = fit()
        return "FINISHED", None, time.perf_counter() - start, {k: float(v) for k, v in metrics.items() if v is not None}
    except Exception as error:  # noqa: BLE001 - a failed setting is a result
        if raise_on_error:
            raise
        text = f"TimeoutError: fit took longer than {timeout} s" if late.is_set() else f"{type(error).__name__}: {error}"
        return "FAILED", text, time.perf_counter() - start, {}
    finally:
        done.set()
        context.setLocalProperty("spark.scheduler.pool", None)
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
