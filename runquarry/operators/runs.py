"""Queries over a run store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from runquarry.functions.scale import MAX_DRIVER_VALUES, materialize, same_keys
from runquarry.functions.text import NONE, column_text
from runquarry.operators.nested import flat_leaves

EAV_TABLES = ("params", "tags", "metrics", "latest_metrics")


def pivot_keys(eav: DataFrame, keys: Sequence[str], id_col: str = "run_uuid", prefix: str = "",
               types: Mapping[str, str] | None = None) -> DataFrame:
    """Long (id, key, value) to one column per key; a repeated (id, key) is an error.

    One aggregate per key in a single pass: rows of other keys are dropped at the scan and the rest is
    combined before the only shuffle, so a run with very many rows costs no more than its own keys.
    """
    types = types or {}
    aggs = []
    for key in keys:
        hit = F.col("key") == key
        value = F.max(F.when(hit, F.col("value")))
        repeated = F.raise_error(F.concat(F.lit(f"duplicate entry for key {key} in "), F.col(id_col).cast("string")))
        value = F.when(F.count(F.when(hit, 1)) > 1, repeated.cast(eav.schema["value"].dataType)).otherwise(value)
        aggs.append((value.cast(types[key]) if key in types else value).alias(f"{prefix}{key}"))
    return eav.where(F.col("key").isin(list(keys))).groupBy(id_col).agg(*aggs)


def pivot_key_steps(metrics: DataFrame, cells: Sequence[tuple[str, int]], id_col: str = "run_uuid") -> DataFrame:
    """Columns ``<key>@<step>``; where a cell has several values the one with the latest (ts, value) stands."""
    aggs = []
    for key, step in cells:
        hit = (F.col("key") == key) & (F.col("step") == step)
        aggs.append(F.max(F.when(hit, F.struct("ts", "value")))["value"].alias(f"{key}@{step}"))
    if not aggs:
        return metrics.select(id_col).where(F.lit(False))
    wanted = F.col("key").isin(sorted({k for k, _ in cells}))
    return metrics.where(wanted).groupBy(id_col).agg(*aggs)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Last value per (run, key): the highest (step, ts, value)."""
    return metrics.groupBy("run_uuid", "key").agg(F.max(F.struct("step", "ts", "value"))["value"].alias("value"))


def _key_steps(metrics: DataFrame, keys: Sequence[str], max_columns: int) -> list[tuple[str, int]]:
    rows = (metrics.where(F.col("key").isin(list(keys)) & F.col("step").isNotNull()).select("key", "step").distinct()
            .limit(max_columns + 1).collect())
    if len(rows) > max_columns:
        raise ValueError("too many (key, step) columns; use pivot_other_table=False")
    return sorted((r["key"], r["step"]) for r in rows)


def query_runs(store: Mapping[str, DataFrame], runs_columns: Sequence[str],
               experiments_columns: Sequence[str] | None = None, experiments_names: Sequence[str] | None = None,
               other_table: str | None = None, other_table_keys: Sequence[str] | None = None,
               pivot_other_table: bool = True, max_columns: int = MAX_DRIVER_VALUES) -> DataFrame:
    """Run columns, optionally next to experiment columns and one of params / tags / metrics / latest_metrics.

    With keys the result is wide (one column per key, ``<key>@<step>`` for ``metrics``) unless
    ``pivot_other_table`` is off, and runs with none of the keys are dropped. Without keys it is long. An experiment column
    named like a chosen run column becomes ``experiments.<name>``. Metric rows without a step have no cell.
    """
    if other_table is not None and other_table not in EAV_TABLES:
        raise ValueError(f"unknown table {other_table}")
    columns = list(runs_columns) + ([] if "run_uuid" in runs_columns else ["run_uuid"])
    named = {c: f"experiments.{c}" if c in columns and c != "experiment_id" else c for c in experiments_columns or []}
    extra = [f"`{n}`" for n in named.values() if n not in columns]
    df = store["runs"]
    if experiments_columns or experiments_names:
        experiments = store["experiments"].select("experiment_id", F.col("name").alias("_experiment_name"),
                                                  *[F.col(c).alias(n) for c, n in named.items() if c != "experiment_id"])
        clash = [c for c in experiments.columns if c in df.columns and c != "experiment_id"]
        df = df.drop(*clash).join(experiments, "experiment_id", "left")
        if experiments_names:
            df = df.where(F.col("_experiment_name").isin(list(experiments_names)))
    df = df.select(*columns, *extra)
    if other_table is None:
        return df
    other = store[other_table]
    if not other_table_keys:
        value_columns = ["key", "value"] + (["step"] if other_table == "metrics" else [])
        return df.join(other.select("run_uuid", *value_columns), "run_uuid", "left").select(*columns, *extra, *value_columns)
    if not pivot_other_table:
        value_columns = ["key", "value"] + (["step"] if other_table == "metrics" else [])
        other = other.where(F.col("key").isin(list(other_table_keys))).select("run_uuid", *value_columns)
        return df.join(other, "run_uuid").select(*columns, *extra, *value_columns)
    if other_table == "metrics":
        wide = pivot_key_steps(other, _key_steps(other, other_table_keys, max_columns))
    else:
        wide = pivot_keys(other, other_table_keys)
    return df.join(wide, "run_uuid").select(*columns, *extra, *[F.col(f"`{c}`") for c in wide.columns if c != "run_uuid"])


def crosstab(store: Mapping[str, DataFrame], table: str, keys: Sequence[str], type: str | None = None) -> DataFrame:
    """run_uuid and one column per key for the runs of the store that have at least one of the keys."""
    wide = pivot_keys(store[table], keys, types={k: type for k in keys} if type else None)
    return store["runs"].select("run_uuid").join(wide, "run_uuid").select("run_uuid", *keys)


def successful_runs(store: Mapping[str, DataFrame]) -> DataFrame:
    """Finished runs whose ``raised_exception`` tag is False."""
    fine = store["tags"].where((F.col("key") == "raised_exception") & (F.col("value") == "False")).select("run_uuid").distinct()
    return store["runs"].where(F.col("status") == "FINISHED").join(fine, "run_uuid", "left_semi")


def find_existing_run(store: Mapping[str, DataFrame], experiment_name: str, params: Mapping[str, object]) -> DataFrame:
    """The newest successful run of the experiment whose params equal all the given pairs (0 or 1 row).

    Nested objects and lists are flattened as they are when logged (``a/b``, ``a/item_0``).
    """
    pairs = {path: str(v) for path, v in flat_leaves(dict(params))}
    hit = F.lit(False)
    for key, value in pairs.items():
        hit = hit | ((F.col("key") == key) & (F.col("value") == value))
    experiment = store["experiments"].where(F.col("name") == experiment_name).select("experiment_id")
    runs = successful_runs(store).join(experiment, "experiment_id", "left_semi")
    if pairs:
        full = (store["params"].where(hit).groupBy("run_uuid").agg(F.count_distinct("key").alias("_n"))
                .where(F.col("_n") == len(pairs)).select("run_uuid"))
        runs = runs.join(full, "run_uuid", "left_semi")
    return runs.orderBy(F.col("start_time").desc_nulls_last(), "run_uuid").limit(1)


def match_existing_runs(store: Mapping[str, DataFrame], wanted: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    """For many wanted combinations at once: (id_col, run_uuid) of the newest successful run with the same params.

    ``wanted`` has one row per combination with a column per name; doubles are compared as numbers, all else by the text
    it is logged as (``True``, ``3``), and NULL equals a logged ``None``.
    """
    done = successful_runs(store).select("run_uuid", "start_time").join(pivot_keys(store["params"], names), "run_uuid")
    for name in names:
        done = done.where(F.col(name).isNotNull())
    here = {n: (logged_number(F.col(n)), F.col(n).cast("double")) if isinstance(wanted.schema[n].dataType, (T.DoubleType, T.FloatType)) else
            (F.col(n), column_text(wanted, n, none=None)) for n in names}
    # NULL was logged as a text too
    done = done.select("run_uuid", "start_time", *[F.when(F.col(n) != NONE, there).alias(n) for n, (there, _) in here.items()])
    # newest run per combination first, so popular combinations shrink to one row before they meet the wanted ones
    newest = done.groupBy(*names).agg(
        F.min_by("run_uuid", F.struct(F.col("start_time").isNull(), -F.unix_micros(F.col("start_time").cast("timestamp")), F.col("run_uuid"))).alias("run_uuid"))
    asked = wanted.select(id_col, *[F.when(wanted_value.cast("string") != NONE, wanted_value).alias(n) for n, (_, wanted_value) in here.items()])
    return same_keys(asked, newest, list(names), "inner").select(id_col, "run_uuid")


def logged_number(text: Column) -> Column:
    """The double that was logged as ``text``; NULL for the text of an integer or of anything else."""
    return F.when(text.rlike("[.a-zA-Z]"), text.try_cast("double"))


def copy_cached_results(store: Mapping[str, DataFrame], hits: DataFrame) -> dict[str, DataFrame]:
    """Rows that give each new run the results of the old one; ``hits`` is (new_run, old_run).

    Returns params, metrics, tags (with ``existent_run_id``) and the new runs' status. The pairs are fixed once, so each
    table is read once.
    """
    hits = materialize(hits.select("new_run", "old_run"))
    old = hits.select("new_run", F.col("old_run").alias("run_uuid"))

    def copied(table: str) -> DataFrame:
        df = store[table]
        rest = [c for c in df.columns if c != "run_uuid"]
        return df.join(old, "run_uuid").select(F.col("new_run").alias("run_uuid"), *rest)

    link = hits.select(F.col("new_run").alias("run_uuid"), F.lit("existent_run_id").alias("key"), F.col("old_run").alias("value"))
    status = store["runs"].join(old, "run_uuid").select(F.col("new_run").alias("run_uuid"), "status")
    tags = copied("tags").where(F.col("key") != "existent_run_id").unionByName(link)
    return {"params": copied("params"), "metrics": copied("metrics"), "tags": tags, "runs": status}


def child_runs(tags: DataFrame, parent_id: str | None = None) -> DataFrame:
    """(parent, trial, child) from the ``child_run_id_<n>`` tags, ordered by trial number."""
    links = tags.where(F.col("key").startswith("child_run_id_"))
    if parent_id is not None:
        links = links.where(F.col("run_uuid") == parent_id)
    return links.select(F.col("run_uuid").alias("parent_run"), F.substring_index("key", "_", -1).try_cast("int").alias("trial"),
                        F.col("value").alias("child_run")).orderBy("parent_run", "trial")
