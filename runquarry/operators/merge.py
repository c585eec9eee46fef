"""Merging run stores and removing soft-deleted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from runquarry.functions.keyfilter import known_rows
from runquarry.functions.scale import MAX_BROADCAST_ROWS, bounded, local_frame, number_rows, same_keys, written
from runquarry.schemas import DEFAULT_EXCLUDED, DELETED, PRIMARY_KEYS, STORE_SCHEMAS

# Tables that point to an experiment / to a run.
EXPERIMENT_CHILDREN = ("runs", "datasets", "trace_info", "experiment_tags")
RUN_CHILDREN = ("latest_metrics", "metrics", "params", "tags")


def experiment_id_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """(experiment_id, new_experiment_id) of the experiments both stores have, matched by name."""
    known = target.select("name", F.col("experiment_id").alias("new_experiment_id"))
    return source.select("name", "experiment_id").join(known, "name").select("experiment_id", "new_experiment_id")


def allocate_experiment_ids(source: DataFrame, target: DataFrame) -> DataFrame:
    """(experiment_id, new_experiment_id, name) of new names: the highest target id + 1, + 2, … in name order."""
    new = source.select("experiment_id", "name").join(target.select("name"), "name", "left_anti")
    highest = target.agg(F.coalesce(F.max("experiment_id"), F.lit(0))).scalar()
    id_type = target.schema["experiment_id"].dataType
    return number_rows(new, ["name"], out="_no").select(
        "experiment_id", (F.col("_no") + 1 + highest).cast(id_type).alias("new_experiment_id"), "name")


def full_experiment_map(source: DataFrame, target: DataFrame) -> DataFrame:
    return experiment_id_map(source, target).unionByName(
        allocate_experiment_ids(source, target).drop("name"))


def merge_experiments(source: DataFrame, target: DataFrame) -> DataFrame:
    """Target rows, plus the new names under their new ids."""
    return _append(target, _under_new_ids(source, allocate_experiment_ids(source, target)))


def _under_new_ids(source: DataFrame, ids: DataFrame) -> DataFrame:
    new = source.join(ids.select("experiment_id", "new_experiment_id"), "experiment_id")
    return new.withColumn("experiment_id", F.col("new_experiment_id")).select(*source.columns)


def remap_experiment_fk(df: DataFrame, id_map: DataFrame) -> DataFrame:
    """Replace ``experiment_id`` by the target's; an id without a match becomes NULL (``unknown_experiments`` names those)."""
    columns = df.columns
    mapped = df.join(bounded(id_map.select("experiment_id", "new_experiment_id")), "experiment_id", "left")
    return mapped.withColumn("experiment_id", F.col("new_experiment_id")).select(*columns)


def unknown_experiments(df: DataFrame, id_map: DataFrame) -> DataFrame:
    """(experiment_id, n_rows) of the ids that the map does not have; rows without an id are not among them."""
    counted = df.where(F.col("experiment_id").isNotNull()).groupBy("experiment_id").agg(F.count("*").alias("n_rows"))
    return counted.join(bounded(id_map.select("experiment_id")), "experiment_id", "left_anti")


def merge_conflicts(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target already has. The target is not shuffled for a source that is small beside it."""
    return known_rows(source, target, keys)


def _append(target: DataFrame, new: DataFrame) -> DataFrame:
    known = [c for c in target.columns if c in new.columns]
    return target.unionByName(new.select(*known), allowMissingColumns=True)


def merge_insert_new(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("run_uuid",)) -> DataFrame:
    """Target plus the source rows whose run (or whole key, with ``keys``) the target does not have."""
    return _append(target, _unknown(source, target, keys))


def _unknown(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        if key not in source.columns:
            raise ValueError(f"the table does not have a {key} column")
    asked = source.select(*keys).distinct()
    if bounded(asked) is not asked:
        return known_rows(source, target, keys, known=False)
    # Many runs: which of them are new is found from one row per run, and the rows themselves travel only where some are and some are not.
    asked = written(asked)
    fresh = written(known_rows(asked, target.select(*keys).distinct(), keys, known=False))
    n = fresh.count()
    if n == asked.count():
        return source
    return same_keys(source, bounded(fresh) if n <= MAX_BROADCAST_ROWS else fresh, keys, "left_semi")


def _has_conflicts(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> bool:
    """Whether ``merge_conflicts`` has rows. Common conflicts show among a few keys, and runs that are not shared have none."""
    def some(df: DataFrame) -> DataFrame:
        return df.select(*keys).where(F.pmod(F.xxhash64(*keys), F.lit(64)) == 0)

    def runs(df: DataFrame) -> DataFrame:
        return df.select("run_uuid").distinct()

    if not merge_conflicts(some(source), some(target), keys).isEmpty():
        return True
    if "run_uuid" in keys and len(keys) > 1 and merge_conflicts(runs(source), runs(target), ["run_uuid"]).isEmpty():
        return False
    return not merge_conflicts(source.select(*keys), target, keys).isEmpty()


def merge_stores(spark: SparkSession, target: Mapping[str, DataFrame],
                 sources: Mapping[str, Mapping[str, DataFrame] | Callable[[], Mapping[str, DataFrame]]],
                 tables: Iterable[str] | None = None, exclude_tables: Iterable[str] | None = None,
                 try_to_insert_new: bool = False, cut: Callable[[DataFrame], DataFrame] = written,
                 ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge several stores into ``target``; returns the merged tables and (db1_url, error) of what failed.

    A source is a store or a function that loads one; a source that cannot be loaded is recorded and
    skipped. A table with a key the target already has is left out and recorded, unless
    ``try_to_insert_new`` is set: then the rows of unknown runs are added. Rows of an experiment that the source itself
    does not have are left out and recorded. What a source adds is fixed by ``cut``
    (a table written to the shared folder) before the next source is looked at, and a merged table is
    the target's rows and one fixed part per source.
    """
    added, errors = merge_added(spark, target, sources, tables, exclude_tables, try_to_insert_new, lambda _, df: cut(df))
    merged = dict(target)
    for name, parts in added.items():
        for part in parts:
            merged[name] = _append(merged[name], part)
    return merged, errors


def merge_added(spark: SparkSession, target: Mapping[str, DataFrame], sources, tables: Iterable[str] | None, exclude_tables: Iterable[str] | None,
                try_to_insert_new: bool, fix: Callable[[str, DataFrame], DataFrame]) -> tuple[dict[str, list[DataFrame]], DataFrame]:
    """(new rows of each table, one part per source; errors) of ``merge_stores``; ``fix(table, rows)`` writes a part.

    The tables of a source do not depend on each other once the experiments are mapped, so their jobs run side by side.
    """
    skip = set(DEFAULT_EXCLUDED if exclude_tables is None else exclude_tables)
    errors: list[tuple[str, str]] = []
    order = [t for t in STORE_SCHEMAS if t in target] + [t for t in target if t not in STORE_SCHEMAS]
    order = [t for t in order if t not in skip and (tables is None or t in set(tables))]
    merged = dict(target)
    added: dict[str, list[DataFrame]] = {}

    def new_rows(name: str, store, id_map: DataFrame, known: Mapping[str, DataFrame]) -> tuple[DataFrame | None, list[str]]:
        """What one table of a source adds, and what is wrong with it."""
        rows, wrong = store[name], []
        if name in EXPERIMENT_CHILDREN:
            lost = unknown_experiments(rows, id_map).orderBy("experiment_id").limit(11).collect()
            if lost:
                named = ", ".join(f"{r['experiment_id']} ({r['n_rows']} rows)" for r in lost[:10]) + (", ..." if len(lost) > 10 else "")
                wrong.append(f"table {name}: rows of unknown experiments are left out: {named}")
                rows = rows.join(bounded(id_map.select("experiment_id")), "experiment_id", "left_semi").unionByName(rows.where(F.col("experiment_id").isNull()))
            rows = remap_experiment_fk(rows, id_map)
        if try_to_insert_new and "run_uuid" in rows.columns:
            return fix(name, _unknown(rows, known[name], ["run_uuid"])), wrong
        keys = [k for k in PRIMARY_KEYS.get(name, []) if k in rows.columns and k in known[name].columns]
        if keys and _has_conflicts(rows, known[name], keys):
            if try_to_insert_new:
                raise ValueError(f"table {name} does not have a run_uuid column")
            return None, [*wrong, f"table {name}: some keys already exist in the target"]
        return fix(name, rows), wrong

    for url, source in sources.items():
        try:
            store = source() if callable(source) else source
            known, incoming = merged["experiments"], store["experiments"]
            # one row per new or common experiment, read by every table that follows
            fresh = _evaluated(allocate_experiment_ids(incoming, known))
            id_map = _evaluated(experiment_id_map(incoming, known).unionByName(fresh.drop("name")))
            names = [n for n in order if n in store and n != "experiments"]
            parts: dict[str, DataFrame] = {}
            if "experiments" in order:
                parts["experiments"] = fix("experiments", _under_new_ids(incoming, fresh))
            with ThreadPoolExecutor(4) as pool:
                known_now = dict(merged)
                jobs = {n: pool.submit(inheritable_thread_target(spark)(new_rows), n, store, id_map, known_now) for n in names}
            found, wrong = {n: j.result() for n, j in jobs.items()}, []
            for name, (part, said) in found.items():
                wrong += [(url, text) for text in said]
                if part is not None:
                    parts[name] = part
            for name, part in parts.items():
                merged[name] = _append(merged[name], part)
                added.setdefault(name, []).append(part)
            errors += wrong
        except Exception as error:  # noqa: BLE001 - one bad source must not stop the others
            errors.append((url, f"{type(error).__name__}: {error}"))
    return added, local_frame(spark, errors, "db1_url string, error string")


def _evaluated(df: DataFrame) -> DataFrame:
    """The rows, evaluated once: local if they are few, else as a written table."""
    few = bounded(df)
    return written(df) if few is df else few


def gc_table(store: Mapping[str, DataFrame], table: str) -> DataFrame:
    """A table without the rows of soft-deleted experiments or runs.

    An active run of a deleted experiment stays, and so do child rows of a run that is not in ``runs``.
    """
    df = store[table]
    if table in ("runs", "experiments"):
        return df.where(~F.coalesce(F.col("lifecycle_stage") == DELETED, F.lit(False)))
    parent, key = ("experiments", "experiment_id") if table == "experiment_tags" else ("runs", "run_uuid")
    gone = store[parent].where(F.col("lifecycle_stage") == DELETED).select(key)
    few = bounded(gone)
    return df if few is not gone and few.isEmpty() else df.join(few, key, "left_anti")


def gc_store(store: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables cleaned, children before their parents."""
    cleaned = ("experiments", "experiment_tags", "runs", *RUN_CHILDREN)
    return {name: gc_table(store, name) if name in cleaned else store[name] for name in store}
