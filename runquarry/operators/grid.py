"""Combination grids, completeness and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runquarry.functions.scale import number_rows, same_keys
from runquarry.operators.runs import match_existing_runs

# Longer value lists are joined by position instead of being written into the plan.
_MAX_INLINE_VALUES = 500


def combination_grid(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    """All combinations of the value lists, with their ``position``; the last name varies fastest.

    A value may be a list, a single value, or a one-column DataFrame (taken in sorted order). Row i of the
    grid is decoded from the number i, one digit per name, so the grid is made in parallel without a join;
    a DataFrame of values is joined on its digit.
    """
    lists: dict[str, object] = {}
    sizes = []
    for name, value in values.items():
        if isinstance(value, DataFrame):
            column = value.columns[0]
            few = value.limit(_MAX_INLINE_VALUES + 1).collect()
            if len(few) <= _MAX_INLINE_VALUES:
                lists[name] = sorted((r[0] for r in few), key=lambda v: (v is not None, v))
                sizes.append(len(few))
                continue
            lists[name] = number_rows(value.select(F.col(column).alias(name)), [name], out="_digit")
            sizes.append(lists[name].count())
            continue
        items = list(value) if isinstance(value, (list, tuple)) else [value]
        if len(items) > _MAX_INLINE_VALUES:
            lists[name] = spark.createDataFrame([(i, v) for i, v in enumerate(items)], ["_digit", name])
        else:
            lists[name] = items
        sizes.append(len(items))
    grid = spark.range(prod(sizes)).withColumnRenamed("id", "position")
    stride = prod(sizes)
    for (name, items), size in zip(lists.items(), sizes):
        stride = stride // size if size else 0
        digit = F.floor(F.col("position") / F.lit(max(stride, 1))) % F.lit(max(size, 1))
        if isinstance(items, DataFrame):
            grid = grid.withColumn("_digit", digit.cast("bigint")).join(items, "_digit").drop("_digit")
        else:
            options = F.array(*[F.lit(v) for v in items]) if items else F.array(F.lit(None))
            grid = grid.withColumn(name, F.get(options, digit.cast("int")))
    return grid.select("position", *values)


def grid_from_spec(specs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Expand textual grids: per row, ``,`` separates alternatives and ``-`` the members of one value.

    Each named column becomes an array of members; an empty list is skipped (NULL).
    """
    grid = specs
    for name in names:
        filled = F.when(F.trim(F.col(name)) != "", F.split(F.col(name), ","))
        grid = grid.withColumn(name, F.explode_outer(filled))
    for name in names:
        grid = grid.withColumn(name, F.split(F.col(name), "-"))
    return grid


def grid_batches(grid: DataFrame, batch_size: int, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Keep positions start, start+step, … up to ``end`` (included) and number their batches of ``batch_size``."""
    kept = grid.where((F.col("position") >= start) & ((F.col("position") - start) % step == 0))
    if end is not None:
        kept = kept.where(F.col("position") <= end)
    return kept.withColumn("batch", F.floor((F.col("position") - start) / F.lit(batch_size)).cast("bigint"))


def missing_entries(df: DataFrame, names: Sequence[str], required: DataFrame) -> DataFrame:
    """Required combinations with no row in ``df``; NULL is a value like any other."""
    present = df.select(*names).distinct()  # popular combinations shrink before the join
    return same_keys(required.select(*names), present, list(names), "left_anti")


def common_combinations(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Combinations that occur with every value of ``column``."""
    pairs = df.where(F.col(column).isNotNull()).select(column, *names).distinct()
    n_values = df.agg(F.count_distinct(column)).scalar()
    return pairs.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") == n_values).select(*names)


def filter_combinations(df: DataFrame, names: Sequence[str], combinations: DataFrame) -> DataFrame:
    """Rows whose combination is in the set; NULL is a value like any other."""
    return same_keys(df, combinations.select(*names), list(names), "left_semi")


def pending_combinations(store: Mapping[str, DataFrame], grid: DataFrame, names: Sequence[str]) -> DataFrame:
    """Grid rows without a successful run of the same parameters, compared as they are logged (``functions/text.py``)."""
    numbered = grid if "position" in grid.columns else number_rows(grid, list(names), out="position")
    done = match_existing_runs(store, numbered, "position", names).select("position")
    return numbered.join(done, "position", "left_anti")


def status_tally(outcomes: DataFrame, outcome: str | Column = "finished") -> DataFrame:
    """One row: combinations in total, completed (True), failed (False) and without outcome (NULL)."""
    c = F.col(outcome) if isinstance(outcome, str) else outcome
    return outcomes.agg(F.count("*").alias("total"), F.count_if(c).alias("completed"), F.count_if(~c).alias("failed"),
                        F.count_if(c.isNull()).alias("none"))
