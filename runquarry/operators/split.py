"""Seeded train / test splits without moving the data.

Rows are ordered by a hash of (seed, id). The test rows are those up to a threshold hash per class, which is
found from row counts per hash bucket and the rows of one bucket only; the split itself is then a filter.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from runquarry.functions.hashing import hash_key
from runquarry.functions.scale import bounded, number_rows, same_keys

_HEX_DIGITS = 4  # 65 536 buckets


def n_test_rows(n_rows: int, test_size: float | int) -> int:
    """A fraction is rounded up; an integer is a number of rows."""
    return test_size if isinstance(test_size, int) and not isinstance(test_size, bool) else math.ceil(test_size * n_rows)


def _quotas(counts: DataFrame, n_rows: int, n_test: int) -> DataFrame:
    """(_class, _quota): proportional shares; the rows left over go to the largest remainders."""
    n = F.lit(n_rows).cast("decimal(19,0)")
    exact = F.lit(n_test).cast("decimal(19,0)") * F.col("_n").cast("decimal(18,0)")
    rest = exact % n
    shares = counts.select("_class", ((exact - rest) / n).cast("bigint").alias("_share"), rest.alias("_rest"))
    left = n_test - shares.agg(F.sum("_share")).first()[0]
    ranked = number_rows(shares, [F.col("_rest").desc(), F.col("_class")], out="_place")
    return ranked.select("_class", (F.col("_share") + (F.col("_place") < left).cast("bigint")).alias("_quota"))


def _thresholds(rows: DataFrame, quotas: DataFrame | int, order: list[str]) -> DataFrame:
    """(_class, _last): the last test row's order key per class."""
    bucket = F.substring("_hash", 1, _HEX_DIGITS)
    per_bucket = rows.groupBy("_class", bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    counted = per_bucket.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_class").orderBy("_bucket")))
    counted = counted.withColumn("_quota", F.lit(quotas)) if isinstance(quotas, int) else same_keys(counted, quotas, ["_class"], "inner")
    edges = (counted.where((F.col("_quota") <= F.col("_upto")) & (F.col("_quota") > F.col("_upto") - F.col("_n")))
             .select("_class", "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need")))
    # one bucket per class: as a local side it picks out the edge rows without moving the others
    edge_rows = same_keys(rows.withColumn("_bucket", bucket), bounded(edges), ["_class", "_bucket"], "inner")
    place = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy(*order))
    return (edge_rows.withColumn("_place", place).where(F.col("_place") == F.col("_need"))
            .select("_class", F.struct(*order).alias("_last")))


def assign_split(df: DataFrame, id_col: str, test_size: float | int, seed: int = 0, stratify: str | None = None,
                 out: str = "is_test", tie: str | None = None) -> DataFrame:
    """Add a boolean: the row is in the test part. ``stratify`` gives every class its share.

    ``id_col`` identifies a row; ``tie`` is a second key where ids repeat.
    """
    order = ["_hash", id_col] + ([tie] if tie else [])
    marked = df.withColumn("_hash", hash_key(seed, F.col(id_col)))
    if stratify is None:
        n_test = n_test_rows(df.count(), test_size)
        if n_test <= 0:
            return df.withColumn(out, F.lit(False))
        rows = marked.withColumn("_class", F.lit(0))
        last = _thresholds(rows.select("_class", *order), n_test, order).select("_last").scalar()
        # no threshold: more test rows are asked for than there are
        return marked.withColumn(out, F.coalesce(F.struct(*order) <= last, F.lit(True))).drop("_hash")
    rows = marked.withColumn("_class", F.col(stratify))
    counts = rows.groupBy("_class").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("k"), F.min("_n").alias("least")).first()
    n_test = n_test_rows(total["n"], test_size)
    if total["least"] < 2:
        raise ValueError("the least populated class has only 1 member; each class needs at least 2")
    if n_test < total["k"] or total["n"] - n_test < total["k"]:
        raise ValueError(f"both parts need at least one row for each of the {total['k']} classes")
    last = bounded(_thresholds(rows.select("_class", *order), _quotas(counts, total["n"], n_test), order))
    joined = same_keys(rows, last, ["_class"])
    return joined.withColumn(out, F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False))).drop("_hash", "_class", "_last")


def train_test_split(df: DataFrame, id_col: str, test_size: float | int, seed: int = 0,
                     stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    split = assign_split(df, id_col, test_size, seed, stratify, out="_is_test")
    return split.where(~F.col("_is_test")).drop("_is_test"), split.where("_is_test").drop("_is_test")


def assign_split_forced(df: DataFrame, id_col: str, test_size: float | int, seed: int = 0, stratify: str | None = None,
                        out: str = "is_test", copy: str = "copy") -> DataFrame:
    """As :func:`assign_split`, but never refuses a stratified split for lack of rows.

    A test part smaller than the number of classes is raised to that number; the row of a class with one
    member is repeated (``copy`` = 1). Without ``stratify`` it is the plain split.
    """
    df = df.withColumn(copy, F.lit(0))
    if stratify is None:
        return assign_split(df, id_col, test_size, seed, out=out)
    counts = df.groupBy(stratify).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("k"), F.min("_n").alias("least")).first()
    wanted = test_size if isinstance(test_size, int) else test_size * total["n"]
    if wanted < total["k"]:
        test_size = int(total["k"])
    if total["least"] < 2:
        warnings.warn("some classes have one member; their rows are repeated", stacklevel=2)
        single = same_keys(df, counts.where(F.col("_n") == 1).select(stratify), [stratify], "left_semi")
        df = df.unionByName(single.withColumn(copy, F.lit(1)))
    return assign_split(df, id_col, test_size, seed, stratify, out=out, tie=copy)


def train_test_split_forced(df: DataFrame, id_col: str, test_size: float | int, seed: int = 0,
                            stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    split = assign_split_forced(df, id_col, test_size, seed, stratify, out="_is_test", copy="_copy")
    return split.where(~F.col("_is_test")).drop("_is_test", "_copy"), split.where("_is_test").drop("_is_test", "_copy")
