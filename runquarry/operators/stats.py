"""Means, ranks and significance tests over model x block results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from runquarry.functions.scale import distinct_values, materialize, null_if_nan, number_rows, running_below
from runquarry.functions.special import chi2_sf, studentized_range_sf


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def _complete_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a NULL key take part in no group."""
    return df.dropna(subset=list(keys))


def _by_model(df, model, keys, metric, models, makers, digits):
    models = distinct_values(df, model) if models is None else list(models)
    value = null_if_nan(metric)
    aggs = [_rounded(make(F.when(F.col(model) == m, value)), digits).alias(f"{m}{suffix}")
            for m in models for suffix, make in makers]
    return _complete_keys(df, [model, *keys]).where(F.col(model).isin(models)).groupBy(*keys).agg(*aggs)


def means_by_model(df: DataFrame, model: str, keys: Sequence[str], metric: str, models: Sequence | None = None,
                   digits: int | None = None) -> DataFrame:
    """Mean of the metric per key group, one column per model; one pass, combined before the shuffle."""
    return _by_model(df, model, keys, metric, models, [("", F.avg)], digits)


def stds_by_model(df: DataFrame, model: str, keys: Sequence[str], metric: str, models: Sequence | None = None,
                  digits: int | None = None) -> DataFrame:
    """Sample standard deviation in the same layout; NULL for a single row."""
    return _by_model(df, model, keys, metric, models, [("", F.stddev_samp)], digits)


def means_stds_by_model(df: DataFrame, model: str, keys: Sequence[str], metric: str, models: Sequence | None = None,
                        digits: int | None = None) -> DataFrame:
    """``<model>_mean`` and ``<model>_std`` next to each other."""
    return _by_model(df, model, keys, metric, models, [("_mean", F.avg), ("_std", F.stddev_samp)], digits)


def _average_rank(first: Column, ties: Column) -> Column:
    return first + (ties - 1) / F.lit(2.0)


def rank_in_block(df: DataFrame, blocks: Sequence[str], metric: str, ascending: bool = False) -> DataFrame:
    """Rank of the metric in its block; ties share their average rank, a missing metric or block has no rank.

    Ranks are taken over the distinct values of a block with their row counts, in range partitions.
    """
    value = null_if_nan(metric)
    df = df.withColumn("_order", value if ascending else -value)
    counts = df.where(F.col("_order").isNotNull()).groupBy(*blocks, "_order").agg(F.count("*").alias("n"))
    ranks = running_below(_complete_keys(counts, blocks), blocks, "_order", ["n"], few_rows=0).select(
        *blocks, "_order", _average_rank(F.col("below_n") + 1, F.col("n")).alias("rank"))
    return df.join(ranks, [*blocks, "_order"], "left").drop("_order")


def mean_rank(df: DataFrame, model: str, blocks: Sequence[str], metric: str, ascending: bool = False) -> DataFrame:
    """Mean rank of each model over the blocks."""
    kept = _complete_keys(df.select(model, *blocks, metric), [model, *blocks])
    ranked = rank_in_block(kept, blocks, metric, ascending)
    return ranked.groupBy(model).agg(F.avg("rank").alias("mean_rank"))


def complete_block_ranks(df: DataFrame, model: str, block: Sequence[str], metric: str, ascending: bool = False) -> DataFrame:
    """(block, model, rank, ties) over the blocks that have every model.

    Several rows of one (model, block) count as their mean. A block then has one row per model, so the
    window over a block is as small as the number of models.
    """
    cells = (_complete_keys(df, [model, *block]).groupBy(*block, model).agg(F.avg(null_if_nan(metric)).alias("_cell"))
             .where(F.col("_cell").isNotNull()))
    k = cells.agg(F.count_distinct(model)).scalar()
    whole = Window.partitionBy(*block)
    tied = Window.partitionBy(*block, "_cell")
    ordered = whole.orderBy(F.col("_cell").asc() if ascending else F.col("_cell").desc())
    ranked = cells.select(*block, model, F.count("*").over(whole).alias("_size"), F.count("*").over(tied).alias("ties"),
                          F.rank().over(ordered).alias("_first"))
    return ranked.where(F.col("_size") == k).select(
        *block, model, _average_rank(F.col("_first"), F.col("ties")).alias("rank"), "ties")


def _model_ranks(df: DataFrame, model: str, block: Sequence[str], metric: str) -> DataFrame:
    """One row (model, rank sum, blocks, tie sum) per model: all that the tests need."""
    ranks = complete_block_ranks(df, model, block, metric, ascending=True)
    return ranks.groupBy(model).agg(F.sum("rank").alias("_r"), F.count("*").alias("_n"),
                                    F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("_t"))


def _friedman_row(per_model: DataFrame, digits: int | None) -> DataFrame:
    one = per_model.agg(F.count("*").alias("k"), F.max("_n").alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("_rr"),
                        F.sum("_t").alias("_tt"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    few = F.raise_error(F.lit("the Friedman test needs at least 3 models")).cast("double")
    correction = F.lit(1.0) - F.col("_tt") / (n * k * (k * k - 1))
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("_rr") - F.lit(3.0) * n * (k + 1)
    statistic = F.when(F.col("k") < 3, few).otherwise(raw / F.nullif(correction, F.lit(0.0)))
    out = one.select(statistic.alias("statistic"), "k", "n").withColumn(
        "p_value", F.nanvl(chi2_sf(F.col("statistic"), (F.col("k") - 1).cast("int")), F.lit(None).cast("double")))
    return out.select(_rounded(F.col("statistic"), digits).alias("statistic"), "k", "n",
                      _rounded(F.col("p_value"), digits).alias("p_value"))


def _pairs(per_model: DataFrame, model: str, digits: int | None) -> DataFrame:
    """Every pair of models once, decoded from its number so that pairs are spread over the cluster, then mirrored."""
    k = per_model.count()
    means = number_rows(per_model.select(F.col(model).alias("m"), (F.col("_r") / F.col("_n")).alias("r"), F.col("_n").alias("n")), ["m"], out="no")
    high = F.floor((F.sqrt(8.0 * F.col("id") + 1) + 1) / 2)  # at most one off for very large numbers
    high = high + F.when(high * (high - 1) / 2 > F.col("id"), -1).when(high * (high + 1) / 2 <= F.col("id"), 1).otherwise(0)
    numbers = per_model.sparkSession.range(k * (k - 1) // 2).select("id", high.cast("bigint").alias("j"))
    numbers = numbers.select((F.col("id") - (F.col("j") * (F.col("j") - 1) / 2).cast("bigint")).alias("i"), "j")

    def side(no: str) -> DataFrame:
        return means.select(F.struct("m", "r", "n").alias(f"at_{no}"), F.col("no").alias(no))

    both = numbers.join(side("i"), "i").join(side("j"), "j")
    q = F.abs(F.col("at_i.r") - F.col("at_j.r")) / F.sqrt(F.lit(k * (k + 1.0)) / (F.lit(6.0) * F.col("at_i.n")))
    both = both.select(F.col("at_i.m").alias("a"), F.col("at_j.m").alias("b"), q.alias("q"))
    both = both.select("a", "b", "q", studentized_range_sf(F.col("q") * F.sqrt(F.lit(2.0)), F.lit(float(k))).alias("p"))
    return both.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("pair"),
                       "q", "p").select(F.col("pair.x").alias("model_a"), F.col("pair.y").alias("model_b"), _rounded(F.col("q"), digits).alias("q"),
                                        _rounded(F.col("p"), digits).alias("p_value"))


def friedman(df: DataFrame, model: str, block: Sequence[str], metric: str, digits: int | None = None) -> DataFrame:
    """One row (statistic, k, n, p_value): Friedman chi-square with tie correction, blocks matched by key."""
    return _friedman_row(_model_ranks(df, model, block, metric), digits)


def nemenyi(df: DataFrame, model: str, block: Sequence[str], metric: str, digits: int | None = None) -> DataFrame:
    """(model_a, model_b, q, p_value) for every pair of models, both ways round as in a square matrix.

    Works on one rank sum per model; the pairs are the result itself.
    """
    return _pairs(materialize(_model_ranks(df, model, block, metric)), model, digits)


def friedman_nemenyi(df: DataFrame, model: str, block: Sequence[str], metric: str, ascending_rank: bool = False,
                     alpha: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(test, pairwise, mean ranks); the last two are empty unless the test's p-value is below 1 - alpha.

    The ranks are taken once; test, gate and pairs come from one row per model.
    """
    per_model = materialize(_model_ranks(df, model, block, metric))
    test = _friedman_row(per_model, None)
    significant = test.select(F.coalesce(F.col("p_value") < 1 - alpha, F.lit(False))).first()[0]
    return (test, _pairs(per_model, model, None).where(F.lit(significant)),
            mean_rank(df, model, block, metric, ascending_rank).where(F.lit(significant)))
