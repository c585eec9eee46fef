"""Store merge and cleanup."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from runquarry.functions.keyfilter import known_rows
from runquarry.functions.scale import scratch_path, written
from runquarry.operators import merge as M
from runquarry.plans.registry import query
from runquarry.schemas import PRIMARY_KEYS
from runquarry.sources.versions import VersionedStore

_IDS = """known AS (SELECT s.experiment_id, d.experiment_id AS new_experiment_id FROM src_experiments s JOIN experiments d ON s.name = d.name),
fresh AS (SELECT s.experiment_id, cast(row_number() OVER (ORDER BY s.name) + (SELECT max(experiment_id) FROM experiments) AS int) AS new_experiment_id,
                 s.name, s.lifecycle_stage FROM src_experiments s WHERE s.name NOT IN (SELECT name FROM experiments)),
ids AS (SELECT experiment_id, new_experiment_id FROM known UNION ALL SELECT experiment_id, new_experiment_id FROM fresh),
merged_experiments AS (SELECT * FROM experiments UNION ALL SELECT new_experiment_id, name, lifecycle_stage FROM fresh),
remapped AS (SELECT s.run_uuid, i.new_experiment_id AS experiment_id, s.status, s.lifecycle_stage
             FROM src_runs s LEFT JOIN ids i ON s.experiment_id = i.experiment_id),
merged_runs AS (SELECT * FROM dst_runs UNION ALL SELECT * FROM remapped WHERE run_uuid NOT IN (SELECT run_uuid FROM dst_runs))"""


def _map(t):
    return M.full_experiment_map(t["src_experiments"], t["experiments"])


@query("experiment_id_map", f"""
WITH {_IDS} SELECT r.run_uuid, r.experiment_id, k.new_experiment_id FROM src_runs r JOIN known k ON r.experiment_id = k.experiment_id""")
def _(t):
    known = M.experiment_id_map(t["src_experiments"], t["experiments"])
    return t["src_runs"].select("run_uuid", "experiment_id").join(known, "experiment_id")


@query("allocate_experiment_ids", f"""
WITH {_IDS} SELECT f.new_experiment_id, f.name, count(*) AS n_runs FROM src_runs r JOIN fresh f ON r.experiment_id = f.experiment_id GROUP BY ALL""")
def _(t):
    fresh = M.allocate_experiment_ids(t["src_experiments"], t["experiments"])
    runs = t["src_runs"].groupBy("experiment_id").agg(F.count("*").alias("n_runs"))
    return runs.join(fresh, "experiment_id").select("new_experiment_id", "name", "n_runs")


@query("merge_experiments", f"WITH {_IDS} SELECT * FROM merged_experiments")
def _(t):
    return M.merge_experiments(t["src_experiments"], t["experiments"])


@query("remap_experiment_fk", f"WITH {_IDS} SELECT * FROM remapped")
def _(t):
    return M.remap_experiment_fk(t["src_runs"], _map(t))


@query("merge_conflicts", "SELECT * FROM src_runs WHERE run_uuid IN (SELECT run_uuid FROM dst_runs)")
def _(t):
    return M.merge_conflicts(t["src_runs"], t["dst_runs"], PRIMARY_KEYS["runs"])


@query("merge_insert_new", f"WITH {_IDS} SELECT * FROM merged_runs")
def _(t):
    return M.merge_insert_new(M.remap_experiment_fk(t["src_runs"], _map(t)), t["dst_runs"])


# Three stores come in: one that cannot be loaded, the second store of the fixtures, and a late one with one more experiment.
_OWN = "SELECT * FROM {0} WHERE run_uuid IN (SELECT run_uuid FROM dst_runs)"
_NEW = "SELECT * FROM {0} WHERE run_uuid IN (SELECT run_uuid FROM src_runs) AND run_uuid NOT IN (SELECT run_uuid FROM dst_runs)"
_LATE = "SELECT concat('late-', run_uuid) AS run_uuid, * EXCLUDE (run_uuid) FROM {0} WHERE run_uuid IN (SELECT run_uuid FROM src_runs WHERE status = 'FAILED')"


def _merged_rows(try_to_insert_new: bool) -> str:
    parts = []
    for name, text in (("params", "concat(key, '=', value)"), ("tags", "concat(key, '=', value)"), ("metrics", "concat(key, ' ', cast(step AS string), ' ', cast(ts AS string))")):
        rows = [_OWN, _NEW, _LATE] if try_to_insert_new else [_OWN, _LATE]
        parts += [f"SELECT '{name}' AS table_name, run_uuid AS id, {text} AS value FROM ({r.format(name)})" for r in rows]
    runs = "merged_runs" if try_to_insert_new else "dst_runs"
    return " UNION ALL ".join([*parts,
        f"SELECT 'experiments', name, cast(experiment_id AS string) FROM (FROM merged_experiments UNION ALL FROM late)",
        f"SELECT 'experiment_tags', cast(experiment_id AS string), concat(key, '=', value) FROM (FROM experiment_tags UNION ALL "
        "SELECT new_experiment_id, 'owner', name FROM fresh UNION ALL SELECT experiment_id, 'owner', name FROM late)",
        f"SELECT 'runs', run_uuid, concat(cast(experiment_id AS string), ' ', status) FROM {runs}",
        f"SELECT 'runs', concat('late-', run_uuid), concat(cast(late.experiment_id AS string), ' FAILED') FROM src_runs, late WHERE status = 'FAILED'",
        f"SELECT 'errors', 'store-lost', 'KeyError'",
        *([] if try_to_insert_new else [f"SELECT 'errors', 'store-1', 'table {t}' FROM (SELECT count(*) AS n FROM src_runs WHERE run_uuid IN (SELECT run_uuid FROM dst_runs)) WHERE n > 0"
                                        for t in ("runs", "params", "tags", "metrics")])])


_LATE_IDS = "late AS (SELECT cast(max(experiment_id) + 1 AS int) AS experiment_id, 'LATE' AS name, 'active' AS lifecycle_stage FROM merged_experiments)"


@query("merge_stores", f"WITH {_IDS}, {_LATE_IDS} {_merged_rows(True)}")
def _(t):
    return _merge_all(t, try_to_insert_new=True)


@query("merge_stores_conflicts", f"WITH {_IDS}, {_LATE_IDS} {_merged_rows(False)}")
def _(t):
    return _merge_all(t, try_to_insert_new=False)


def _rows_of(t, tables, **runs):
    """{store: {table: its rows of the store's runs}}: each table meets all lists of runs in one join and is written once."""
    parts = [r.select("run_uuid", *[F.lit(name == other).alias(f"_in_{other}") for other in runs]) for name, r in runs.items()]
    marks = reduce(DataFrame.unionByName, parts).groupBy("run_uuid").agg(*[F.max(f"_in_{name}").alias(f"_in_{name}") for name in runs])
    marked = {table: written(t[table].join(marks, "run_uuid")) for table in tables}
    return {name: {table: marked[table].where(f"_in_{name}").select(*t[table].columns) for table in tables} for name in runs}


def _merge_all(t, try_to_insert_new):

    def lost():
        raise KeyError("experiments")

    def renamed(df):
        return df.withColumn("run_uuid", F.concat(F.lit("late-"), "run_uuid"))

    def owners(experiments):
        return experiments.select("experiment_id", F.lit("owner").alias("key"), F.col("name").alias("value"))

    failed = t["src_runs"].where("status = 'FAILED'")
    rows = _rows_of(t, ("params", "tags", "metrics"), target=t["dst_runs"], first=t["src_runs"], late=failed)
    extra = t["experiments"].limit(1).select(F.lit(7).alias("experiment_id"), F.lit("LATE").alias("name"), F.lit("active").alias("lifecycle_stage"))
    target = {"experiments": t["experiments"], "experiment_tags": t["experiment_tags"], "runs": t["dst_runs"], **rows["target"]}
    first = {"experiments": t["src_experiments"], "experiment_tags": owners(t["src_experiments"].where("name LIKE '%_B'")), "runs": t["src_runs"], **rows["first"]}
    late = {"experiments": extra, "experiment_tags": owners(extra), "runs": renamed(failed).withColumn("experiment_id", F.lit(7)),
            **{name: renamed(df) for name, df in rows["late"].items()}}
    merged, errors = M.merge_stores(t.spark, target, {"store-lost": lost, "store-1": first, "store-2": late}, try_to_insert_new=try_to_insert_new)
    pair = F.concat_ws("=", "key", "value")
    shown = [("experiments", F.col("name"), F.col("experiment_id").cast("string")), ("experiment_tags", F.col("experiment_id").cast("string"), pair),
             ("runs", F.col("run_uuid"), F.concat_ws(" ", F.col("experiment_id").cast("string"), "status")), ("params", F.col("run_uuid"), pair),
             ("tags", F.col("run_uuid"), pair), ("metrics", F.col("run_uuid"), F.concat_ws(" ", "key", F.col("step").cast("string"), F.col("ts").cast("string")))]
    parts = [merged[name].select(F.lit(name).alias("table_name"), i.alias("id"), v.alias("value")) for name, i, v in shown]
    parts.append(errors.select(F.lit("errors").alias("table_name"), F.col("db1_url").alias("id"), F.substring_index("error", ":", 1).alias("value")))
    return reduce(DataFrame.unionByName, parts)


# Every tenth run of the second store names an experiment that this store does not have.
@query("merge_unknown_experiments", f"""
WITH {_IDS}, new AS (SELECT * FROM src_runs WHERE run_uuid NOT IN (SELECT run_uuid FROM dst_runs)),
lost AS (SELECT run_uuid FROM src_runs WHERE cast(replace(run_uuid, 'run-', '') AS bigint) % 10 = 7)
SELECT run_uuid, experiment_id, cast(NULL AS string) AS error FROM dst_runs
UNION ALL SELECT n.run_uuid, i.new_experiment_id, NULL FROM new n JOIN ids i ON i.experiment_id = n.experiment_id WHERE n.run_uuid NOT IN (SELECT run_uuid FROM lost)
UNION ALL SELECT 'store-1', NULL, concat('table runs: rows of unknown experiments are left out: 900 (', cast(count(*) AS string), ' rows)') FROM lost HAVING count(*) > 0""")
def _(t):
    odd = F.expr("cast(replace(run_uuid, 'run-', '') AS bigint) % 10 = 7")
    runs = t["src_runs"].withColumn("experiment_id", F.when(odd, 900).otherwise(F.col("experiment_id")))
    merged, errors = M.merge_stores(t.spark, {"experiments": t["experiments"], "runs": t["dst_runs"]},
                                    {"store-1": {"experiments": t["src_experiments"], "runs": runs}}, try_to_insert_new=True)
    rows = merged["runs"].select("run_uuid", "experiment_id", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(errors.select(F.col("db1_url").alias("run_uuid"), F.lit(None).cast("int").alias("experiment_id"), "error"))


def _stores(t):
    rows = _rows_of(t, ("params",), target=t["dst_runs"], source=t["src_runs"])
    return ({"experiments": t["experiments"], "runs": t["dst_runs"], **rows["target"]},
            {"experiments": t["src_experiments"], "runs": t["src_runs"], **rows["source"]})


# Version 1 is the target, 2 the merge, 3 the clean-up; the merge is done twice and the clean-up too, without another version.
@query("merge_stores_committed", f"""
WITH {_IDS}, v2_params AS (SELECT * FROM params WHERE run_uuid IN (SELECT run_uuid FROM merged_runs)),
gone AS (SELECT run_uuid FROM merged_runs WHERE lifecycle_stage = 'deleted')
SELECT 1 AS version, 'experiments' AS table_name, count(*) AS n_rows FROM experiments
UNION ALL SELECT 1, 'runs', count(*) FROM dst_runs UNION ALL SELECT 1, 'params', count(*) FROM params WHERE run_uuid IN (SELECT run_uuid FROM dst_runs)
UNION ALL SELECT 2, 'experiments', count(*) FROM merged_experiments UNION ALL SELECT 2, 'runs', count(*) FROM merged_runs UNION ALL SELECT 2, 'params', count(*) FROM v2_params
UNION ALL SELECT 3, 'experiments', count(*) FROM merged_experiments WHERE lifecycle_stage <> 'deleted'
UNION ALL SELECT 3, 'runs', count(*) FROM merged_runs WHERE lifecycle_stage <> 'deleted'
UNION ALL SELECT 3, 'params', count(*) FROM v2_params WHERE run_uuid NOT IN (SELECT run_uuid FROM gone)""")
def _(t):
    store, (target, source) = VersionedStore(t.spark, scratch_path(t.spark, "versions")), _stores(t)
    store.append(target, writer="first load")
    for _ in range(2):
        store.merge({"store-1": source}, try_to_insert_new=True)
    for _ in range(2):
        store.collect_garbage()
    return store.row_counts()


@query("append_table_repeated", """
SELECT run_uuid, experiment_id, status, lifecycle_stage FROM dst_runs UNION ALL SELECT run_uuid, experiment_id, status, lifecycle_stage FROM src_runs""")
def _(t):
    store = VersionedStore(t.spark, scratch_path(t.spark, "versions"))
    for batch, rows in ((0, "dst_runs"), (0, "dst_runs"), (1, "src_runs"), (1, "src_runs"), (0, "dst_runs")):
        store.append({"runs": t[rows]}, writer="nightly", batch=batch)
    return store.read()["runs"]


# Through a Bloom filter, as for a source with more keys than are broadcast themselves.
@query("merge_conflicts_filtered", "SELECT * FROM src_runs WHERE run_uuid IN (SELECT run_uuid FROM dst_runs)")
def _(t):
    return known_rows(t["src_runs"], t["dst_runs"], PRIMARY_KEYS["runs"], max_local=0)


_GONE = "WHERE run_uuid NOT IN (SELECT run_uuid FROM runs WHERE lifecycle_stage = 'deleted')"


@query("gc_experiment_tags", """
SELECT * FROM experiment_tags WHERE experiment_id NOT IN (SELECT experiment_id FROM experiments WHERE lifecycle_stage = 'deleted')""")
def _(t):
    return M.gc_table(t.store, "experiment_tags")


@query("gc_latest_metrics", f"""
WITH latest AS (SELECT run_uuid, key, value FROM (SELECT *, row_number() OVER (
    PARTITION BY run_uuid, key ORDER BY step DESC, ts DESC, value DESC) AS r FROM metrics) WHERE r = 1)
SELECT * FROM latest {_GONE}""")
def _(t):
    from runquarry.operators.runs import latest_metrics

    return M.gc_table({**t.store, "latest_metrics": latest_metrics(t["metrics"])}, "latest_metrics")


for _table in ("metrics", "params", "tags"):
    @query(f"gc_{_table}", f"SELECT * FROM {_table} {_GONE}")
    def _(t, table=_table):
        return M.gc_table(t.store, table)


for _table in ("runs", "experiments"):
    @query(f"gc_{_table}", f"SELECT * FROM {_table} WHERE lifecycle_stage <> 'deleted' OR lifecycle_stage IS NULL")
    def _(t, table=_table):
        return M.gc_table(t.store, table)
