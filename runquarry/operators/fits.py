"""Fits of user code over all rows of a combination, with a deadline: for models that sums cannot train."""

from __future__ import annotations

import signal
import time
import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from runquarry.functions.scale import same_keys, written

#: A combination with more rows or bytes than this is not fitted in one task.
MAX_ROWS, MAX_BYTES = 2_000_000, 256_000_000


class DeadlinePassed(BaseException):
    """A fit has run into its time limit. Not an ``Exception``, so that user code does not catch it by accident."""


@contextmanager
def deadline(seconds: float | None):
    """Ends the block with ``DeadlinePassed`` after ``seconds``; None or 0 is no limit.

    By a timer signal in the worker's main thread, as the Python code there is what has to stop. A call into compiled
    code ends first.
    """
    if not seconds:
        yield
        return

    def stop(*_):
        raise DeadlinePassed

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def run_fit(fit: Callable[[], Mapping[str, float]], timeout: float | None, raise_on_error: bool) -> tuple[str, str | None, float, dict | None]:
    """(status, exception, elapsed, metrics) of one call. A fit that fails or passes its deadline has no metrics."""
    start = time.perf_counter()
    try:
        with deadline(timeout):
            found = {k: None if v is None else float(v) for k, v in fit().items()}
        return "FINISHED", None, time.perf_counter() - start, found
    except DeadlinePassed:
        if raise_on_error:
            raise TimeoutError(f"fit took longer than {timeout} s") from None
        return "FAILED", f"TimeoutError: fit took longer than {timeout} s", time.perf_counter() - start, None
    except Exception as error:  # noqa: BLE001 - a failed combination is a result
        if raise_on_error:
            raise
        return "FAILED", traceback.format_exception_only(error)[-1].strip(), time.perf_counter() - start, None


def combination_sizes(df: DataFrame, combination: Sequence[str]) -> DataFrame:
    """(combination, n_rows, n_bytes) by one aggregate that is combined before its shuffle; bytes are those of the values."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [F.coalesce(F.length(F.to_json(F.struct(f.name))), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    row = F.lit(8 * len(df.columns)).cast("bigint")
    for c in [*wide, *nested]:
        row = row + c
    return df.groupBy(*combination).agg(F.count("*").alias("n_rows"), F.sum(row).alias("n_bytes"))


def fit_combinations(df: DataFrame, combination: Sequence[str], fit: Callable[[pd.DataFrame, Mapping[str, object]], Mapping[str, float]],
                     timeout: float | None = None, raise_on_error: bool = False, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One call of ``fit(rows, combination)`` per combination of values in the data, each with all of its rows at once.

    For trees, kernels, iterative and other fits that cannot be written over sums (``sweeps.sweep_grouped_udf`` can, and
    has no size limit; neither has ``sweeps.sweep_ml_estimator``, whose every fit is a distributed job). Combinations are
    counted first. Those of at most ``max_rows`` rows and ``max_bytes`` bytes go to a task each; a larger one is never brought
    together and becomes a FAILED row that says so. A fit that takes longer than ``timeout`` seconds is ended inside the
    worker. ``raise_on_error`` ends the job with what would have been a FAILED row.

    Result: combination, n_rows, status, exception, elapsed, metrics (a map, NULL without a result). NULL is a value of a
    combination like any other, and reaches ``fit`` as None. Columns named ``_fit_...`` are reserved.
    """
    combination = list(combination)
    number = F.monotonically_increasing_id()
    sizes = written(combination_sizes(df, combination).withColumn("_fit_id", number))
    fits = (F.col("n_rows") <= max_rows) & (F.col("n_bytes") <= max_bytes)
    nulls = F.lit(0).cast("bigint")
    for i, c in enumerate(combination):
        nulls = nulls + F.shiftleft(F.col(c).isNull().cast("bigint"), i)
    small = sizes.where(fits).select(*combination, "_fit_id")
    # pandas holds NULL among integers as NaN and makes the column double: as combinations share batches, they travel beside it
    holed = {f"_fit_hole_{i}": f for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    rows = same_keys(df.withColumn("_fit_nulls", nulls), small, combination, "inner")
    filled = {f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in holed.values()}
    rows = rows.withColumns({hole: F.col(f.name).isNull() for hole, f in holed.items()} | filled) if holed else rows
    result = T.StructType([T.StructField("_fit_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("exception", T.StringType()),
                           T.StructField("elapsed", T.DoubleType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])

    def one(group: pd.DataFrame, flags: int) -> tuple:
        values = {}
        for i, c in enumerate(combination):
            first = group[c].iloc[0]
            values[c] = None if flags >> i & 1 else getattr(first, "item", lambda v=first: v)()
        return run_fit(lambda: fit(group, values), timeout, raise_on_error)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Combinations lie one after the other; one that a batch cuts off waits for its other rows."""
        waiting: list[pd.DataFrame] = []
        for batch in chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            if waiting and (batch is None or batch["_fit_id"].iloc[0] != waiting[0]["_fit_id"].iloc[0]):
                yield found(pd.concat(waiting, ignore_index=True) if len(waiting) > 1 else waiting[0])
                waiting = []
            if batch is None:
                return
            ids = batch["_fit_id"].to_numpy()
            begin = int((ids != ids[-1]).sum())  # of the last combination
            if begin:
                yield found(pd.concat([*waiting, batch.iloc[:begin]], ignore_index=True))
                waiting = []
            waiting.append(batch.iloc[begin:])

    def found(some: pd.DataFrame) -> pd.DataFrame:
        """Fits of whole combinations that lie one after the other."""
        ids, flags, data = some["_fit_id"].to_numpy(), some["_fit_nulls"].to_numpy(), some.drop(columns=["_fit_id", "_fit_nulls", *holed])
        holes = {f.name: some[hole].to_numpy() for hole, f in holed.items() if some[hole].any()}
        cuts = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]

        def part(a: int, b: int) -> pd.DataFrame:
            rows = data.iloc[a:b].reset_index(drop=True)
            for c, missing in holes.items():
                if missing[a:b].any():
                    rows[c] = rows[c].astype(object if rows[c].dtype == bool else float).mask(missing[a:b], None)
            return rows

        return pd.DataFrame([(ids[a], *one(part(a, b), int(flags[a]))) for a, b in zip(cuts, cuts[1:])], columns=result.fieldNames())

    # many small combinations share a batch: a group of Spark's own costs more than a small fit
    fitted = rows.repartition("_fit_id").sortWithinPartitions("_fit_id").mapInPandas(each, result)
    text = F.concat(F.lit("TooLarge: "), F.col("n_rows").cast("string"), F.lit(" rows, "), F.col("n_bytes").cast("string"),
                    F.lit(f" bytes; one task fits at most {max_rows} and {max_bytes}"))
    large = sizes.where(~fits)
    if raise_on_error:
        large = large.withColumn("n_rows", F.raise_error(text).cast("bigint"))
    large = large.select(*combination, "n_rows", F.lit("FAILED").alias("status"), text.alias("exception"), F.lit(0.0).alias("elapsed"),
                         F.lit(None).cast("map<string,double>").alias("metrics"))
    return sizes.join(fitted, "_fit_id").select(*combination, "n_rows", "status", "exception", "elapsed", "metrics").unionByName(large)
