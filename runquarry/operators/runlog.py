"""Shaping run results into store rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runquarry.functions.scale import bounded, dealt
from runquarry.functions.text import column_text
from runquarry.operators.nested import flatten_params

# Names of the step results and of the run-level numbers that are logged.
EVALUATION_STEP = "evaluate_model_return"
STEP_NUMBERS = ("elapsed_time", "max_memory_used")
RUN_NUMBERS = ("total_elapsed_time",)
RUN_PREFIXES = ("max_memory_used_", "max_cuda_memory_")


def _number(text: Column) -> Column:
    truth = F.lower(text)
    return F.when(truth == "true", 1.0).when(truth == "false", 0.0).otherwise(text.try_cast("double"))


def log_metrics(results: DataFrame, run: str = "run_uuid", step: str = "step_name", payload: str = "payload") -> DataFrame:
    """(run, key, value) from one row per (run, step) with a map of results.

    A step gives ``<step>_elapsed_time`` and ``<step>_max_memory_used``; the evaluation step also gives every
    other number under its own name (a boolean counts as a number, text is dropped). The row with an empty
    step name holds run-level numbers.
    """
    rows = results.select(run, F.coalesce(F.col(step), F.lit("")).alias("_s"), F.explode(payload).alias("_k", "_v"))
    rows = rows.withColumn("value", _number(F.col("_v"))).where(F.col("value").isNotNull())
    run_level = F.col("_k").isin(*RUN_NUMBERS)
    for prefix in RUN_PREFIXES:
        run_level = run_level | F.col("_k").startswith(prefix)
    of_step = F.when((F.col("_s") != "") & F.col("_k").isin(*STEP_NUMBERS), F.concat_ws("_", "_s", "_k"))
    of_run = F.when((F.col("_s") == "") & run_level, F.col("_k"))
    own = F.when((F.col("_s") == EVALUATION_STEP) & (F.col("_k") != "elapsed_time"), F.col("_k"))
    named = rows.select(run, F.explode(F.array(of_step, of_run, own)).alias("key"), "value")
    return named.where(F.col("key").isNotNull())


def log_params_with_changes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to add for new params: unknown keys as they are, the same value not at all, another value as
    ``<key>_change_<n>`` with the smallest free n."""
    touched, asked = existing.select("run_uuid", "key", "value"), new.select("run_uuid").distinct()
    few = bounded(asked)
    if few is not asked:  # many runs are not looked up: what is known of other runs meets no new value
        touched = touched.join(few, "run_uuid", "left_semi")
    suffix = "_change_([0-9]+)$"
    renamed = F.col("key").rlike(suffix)
    none = F.lit(None)

    def entry(key: Column, old: Column, number: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), old.cast("string").alias("old"), number.cast("int").alias("number"), value.cast("string").alias("value"))

    itself = entry(F.col("key"), F.col("value"), none, none)
    base = entry(F.regexp_replace("key", suffix, ""), none, F.regexp_extract("key", suffix, 1).try_cast("int"), none)
    old = touched.select("run_uuid", F.explode(F.when(renamed, F.array(itself, base)).otherwise(F.array(itself))).alias("_e"))
    rows = old.unionByName(new.select("run_uuid", entry(F.col("key"), none, none, F.col("value")).alias("_e"))).select("run_uuid", "_e.*")
    # one group per (run, key): its logged value, the numbers already used and the new value
    met = dealt(rows, ["run_uuid", "key"]).groupBy("run_uuid", "key").agg(F.max("old").alias("old"), F.collect_set("number").alias("used"), F.max("value").alias("value"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), F.col("used")))
    name = F.when(F.col("old").isNull(), F.col("key")).otherwise(F.concat("key", F.lit("_change_"), free.cast("string")))
    return met.where(F.col("value").isNotNull() & ~F.col("old").eqNullSafe(F.col("value"))).select("run_uuid", name.alias("key"), "value")


def log_outcome(outcomes: DataFrame, run: str = "run_uuid", finished: str = "finished",
                exception: str = "exception") -> tuple[DataFrame, DataFrame]:
    """(run, status) and (run, key, value) tags of finished and failed runs."""
    ended = outcomes.where(F.col(finished).isNotNull())
    status = ended.select(run, F.when(F.col(finished), "FINISHED").otherwise("FAILED").alias("status"))
    raised = F.struct(F.lit("raised_exception").alias("key"), F.when(F.col(finished), "False").otherwise("True").alias("value"))
    text = F.struct(F.lit("EXCEPTION").alias("key"), F.col(exception).cast("string").alias("value"))
    tags = F.when(F.col(finished), F.array(raised)).otherwise(F.array(raised, text))
    return status, ended.select(run, F.explode(tags).alias("_t")).select(run, "_t.*")


def log_start_params(runs: DataFrame, documents: Sequence[str], constants: Mapping[str, object] | None = None,
                     run: str = "run_uuid") -> DataFrame:
    """(run, key, value): the flattened JSON documents (combination, unique params) and the same constants for each run."""
    out = None
    for document in documents:
        rows = flatten_params(runs, [run], document, values="logged").select(run, F.col("path").alias("key"), "value")
        out = rows if out is None else out.unionByName(rows)
    fixed = [F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in (constants or {}).items()]
    if fixed:
        out = out.unionByName(runs.select(run, F.explode(F.array(*fixed)).alias("_c")).select(run, "_c.*"))
    return out


def run_hash(names: Sequence[str], df: DataFrame | None = None) -> Column:
    """First 10 hex digits of the sha256 of ``name_value`` pairs joined by ``_``.

    Values of ``df`` count as they are logged (a boolean or double needs it, as its text follows from the column's type).
    """
    pairs = [F.concat(F.lit(f"{n}_"), F.coalesce(F.col(n).cast("string"), F.lit("None")) if df is None else column_text(df, n)) for n in names]
    return F.substring(F.sha2(F.concat_ws("_", *pairs), 256), 1, 10)


def last_step_finished(steps: DataFrame, run: str = "run_uuid", name: str = "step_name", order: str = "step_order") -> DataFrame:
    """(run, key, value) tag with the last finished step of each run."""
    last = F.max(F.struct(F.col(order), F.col(name)))[name]
    return steps.groupBy(run).agg(last.alias("value")).select(run, F.lit("Last step finished").alias("key"), "value")
