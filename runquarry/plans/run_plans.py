"""Sources, sinks and run-store queries."""

from pyspark.sql import functions as F

from runquarry.functions.scale import scratch_path
from runquarry.operators import runs as R, stats as S
from runquarry.plans.registry import query
from runquarry.sources import append_table, error_report, read_run_store, search_runs, sql_source

_NAMES = ["ASIA", "EUROPE"]
_PARAM_KEYS = ["model_nickname", "dataset_name", "seed_dataset", "fold", "random_seed"]
_METRIC_KEYS = ["test_rmse", "test_r2_score"]


def _case(keys, value="value", prefix=""):
    return ", ".join(f"max(CASE WHEN key = '{k}' THEN {value} END) AS \"{prefix}{k}\"" for k in keys)


_LATEST = """latest AS (SELECT run_uuid, key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY run_uuid, key ORDER BY step DESC, ts DESC, value DESC) AS r FROM metrics)
    WHERE r = 1)"""


@query("read_run_store", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
    for t in ("experiments", "experiment_tags", "runs", "params", "tags", "metrics")))
def _(t):
    folder = scratch_path(t.spark, "store")
    for name, df in t.store.items():
        df.write.parquet(f"{folder}/{'notes' if name == 'experiment_tags' else name}")  # one name that no schema knows
    counts = read_run_store(t.spark, folder).row_counts()
    return counts.withColumn("table_name", F.when(F.col("table_name") == "notes", "experiment_tags").otherwise(F.col("table_name")))


@query("sql_source", """
SELECT e.name, r.status, count(*) AS n_runs, avg(round(r.elapsed * 100)) AS mean_elapsed_cents
FROM runs r JOIN experiments e ON r.experiment_id = e.experiment_id WHERE r.lifecycle_stage = 'active'
GROUP BY e.name, r.status""")
def _(t):
    return sql_source(t.spark, """
        SELECT e.name, r.status, count(*) AS n_runs, avg(round(r.elapsed * 100)) AS mean_elapsed_cents
        FROM {runs} r JOIN {experiments} e ON r.experiment_id = e.experiment_id WHERE r.lifecycle_stage = 'active'
        GROUP BY e.name, r.status""", t.store)


@query("append_table", "SELECT status, lifecycle_stage, count(*) AS n_runs, min(run_uuid) AS first_run FROM runs GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "append_table")
    runs = t["runs"]
    append_table(runs.where("status = 'FINISHED'"), path)
    whole = append_table(runs.where("status <> 'FINISHED'"), path)
    return whole.groupBy("status", "lifecycle_stage").agg(F.count("*").alias("n_runs"), F.min("run_uuid").alias("first_run"))


@query("error_report", """
SELECT concat('store-', cast(experiment_id AS string)) AS db1_url, concat('run "', run_uuid, '", failed') AS error
FROM runs WHERE status = 'FAILED'""")
def _(t):
    failed = t["runs"].where("status = 'FAILED'").select(
        F.concat(F.lit("store-"), F.col("experiment_id").cast("string")).alias("db1_url"),
        F.concat(F.lit('run "'), "run_uuid", F.lit('", failed')).alias("error"))
    return error_report(failed, scratch_path(t.spark, "error_report"))


@query("search_runs", f"""
WITH {_LATEST},
p AS (SELECT run_uuid, {_case(_PARAM_KEYS, prefix='params.')} FROM params GROUP BY run_uuid),
m AS (SELECT run_uuid, {_case([*_METRIC_KEYS, 'validation_score'], prefix='metrics.')} FROM latest GROUP BY run_uuid),
g AS (SELECT run_uuid, {_case(['raised_exception', 'mlflow.parentRunId'], prefix='tags.')} FROM tags GROUP BY run_uuid)
SELECT runs.*, p.* EXCLUDE (run_uuid), m.* EXCLUDE (run_uuid), g.* EXCLUDE (run_uuid) FROM runs
LEFT JOIN p ON p.run_uuid = runs.run_uuid LEFT JOIN m ON m.run_uuid = runs.run_uuid LEFT JOIN g ON g.run_uuid = runs.run_uuid""")
def _(t):
    return search_runs(t.store, param_keys=_PARAM_KEYS, tag_keys=["raised_exception", "mlflow.parentRunId"])


@query("runs_project", "SELECT status, lifecycle_stage, run_uuid FROM runs")
def _(t):
    return R.query_runs(t.store, ["status", "lifecycle_stage"])


@query("runs_join_experiments", """
SELECT r.run_uuid, r.lifecycle_stage, e.name, e.lifecycle_stage AS "experiments.lifecycle_stage"
FROM runs r LEFT JOIN experiments e ON r.experiment_id = e.experiment_id""")
def _(t):
    return R.query_runs(t.store, ["run_uuid", "lifecycle_stage"], experiments_columns=["name", "lifecycle_stage"])


@query("runs_join_eav", """
SELECT r.run_uuid, r.status, m.key, m.value, m.step FROM runs r LEFT JOIN metrics m ON m.run_uuid = r.run_uuid""")
def _(t):
    return R.query_runs(t.store, ["run_uuid", "status"], other_table="metrics")


@query("runs_filter", """
SELECT r.run_uuid, r.status, p.key, p.value FROM runs r LEFT JOIN experiments e ON r.experiment_id = e.experiment_id
LEFT JOIN params p ON p.run_uuid = r.run_uuid
WHERE e.name IN ('ASIA', 'EUROPE') AND p.key IN ('random_seed', 'fold')""")
def _(t):
    return R.query_runs(t.store, ["run_uuid", "status"], experiments_names=_NAMES, other_table="params",
                        other_table_keys=["random_seed", "fold"], pivot_other_table=False)


@query("runs_pivot_keys", f"""
WITH p AS (SELECT run_uuid, {_case(['model_nickname', 'random_seed', 'absent_key'])} FROM params
           WHERE key IN ('model_nickname', 'random_seed', 'absent_key') GROUP BY run_uuid)
SELECT r.run_uuid, r.status, e.name, p.* EXCLUDE (run_uuid) FROM runs r JOIN p ON p.run_uuid = r.run_uuid
LEFT JOIN experiments e ON r.experiment_id = e.experiment_id WHERE e.name IN ('ASIA', 'EUROPE')""")
def _(t):
    return R.query_runs(t.store, ["run_uuid", "status"], ["name"], _NAMES, "params",
                        ["model_nickname", "random_seed", "absent_key"])


_CELLS = [(k, s) for k in sorted(_METRIC_KEYS) for s in range(1, 8)]


@query("runs_pivot_key_step", """
WITH best AS (SELECT run_uuid, key, step, value FROM (
    SELECT *, row_number() OVER (PARTITION BY run_uuid, key, step ORDER BY ts DESC, value DESC) AS r FROM metrics
    WHERE key IN ('test_rmse', 'test_r2_score')) WHERE r = 1),
w AS (SELECT run_uuid, """ + ", ".join(
    f"max(CASE WHEN key = '{k}' AND step = {s} THEN value END) AS \"{k}@{s}\"" for k, s in _CELLS) + """
    FROM best GROUP BY run_uuid)
SELECT r.run_uuid, r.status, w.* EXCLUDE (run_uuid) FROM runs r JOIN w ON w.run_uuid = r.run_uuid""")
def _(t):
    return R.query_runs(t.store, ["run_uuid", "status"], other_table="metrics", other_table_keys=_METRIC_KEYS)


@query("crosstab_latest_metrics", f"""
WITH {_LATEST}
SELECT r.run_uuid, {_case(_METRIC_KEYS)} FROM runs r JOIN latest l ON l.run_uuid = r.run_uuid
WHERE key IN ('test_rmse', 'test_r2_score') GROUP BY r.run_uuid""")
def _(t):
    store = {**t.store, "latest_metrics": R.latest_metrics(t["metrics"].where(F.col("key").isin(_METRIC_KEYS)))}
    return R.crosstab(store, "latest_metrics", _METRIC_KEYS, type="double")


@query("crosstab_params", f"""
SELECT r.run_uuid, {_case(_PARAM_KEYS)} FROM runs r JOIN params p ON p.run_uuid = r.run_uuid GROUP BY r.run_uuid""")
def _(t):
    return R.crosstab(t.store, "params", _PARAM_KEYS)


@query("runs_long", """
SELECT r.run_uuid, r.elapsed, e.name, p.key, p.value FROM runs r LEFT JOIN experiments e ON r.experiment_id = e.experiment_id
JOIN params p ON p.run_uuid = r.run_uuid WHERE p.key IN ('model_nickname', 'dataset_name')""")
def _(t):
    return R.query_runs(t.store, ["run_uuid", "elapsed"], ["name"], other_table="params",
                        other_table_keys=["model_nickname", "dataset_name"], pivot_other_table=False)


_WANTED = {"model_nickname": "2-HIGH", "dataset_name": "ds3", "fold": 1}


@query("find_existing_run", """
SELECT r.* FROM runs r JOIN experiments e ON r.experiment_id = e.experiment_id
WHERE e.name = 'ASIA' AND r.status = 'FINISHED'
  AND EXISTS (SELECT 1 FROM tags g WHERE g.run_uuid = r.run_uuid AND g.key = 'raised_exception' AND g.value = 'False')
  AND (SELECT count(*) FROM params p WHERE p.run_uuid = r.run_uuid AND
       (key, value) IN (('model_nickname', '2-HIGH'), ('dataset_name', 'ds3'), ('fold', '1'))) = 3
ORDER BY r.start_time DESC, r.run_uuid LIMIT 1""")
def _(t):
    return R.find_existing_run(t.store, "ASIA", _WANTED)


@query("copy_cached_results", """
WITH done AS (SELECT p.value AS model, q.value AS ds, f.value AS fold, r.run_uuid, r.start_time FROM runs r
    JOIN params p ON p.run_uuid = r.run_uuid AND p.key = 'model_nickname'
    JOIN params q ON q.run_uuid = r.run_uuid AND q.key = 'dataset_name'
    JOIN params f ON f.run_uuid = r.run_uuid AND f.key = 'fold'
    JOIN tags g ON g.run_uuid = r.run_uuid AND g.key = 'raised_exception' AND g.value = 'False'
    WHERE r.status = 'FINISHED'),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, ds, fold ORDER BY start_time DESC, run_uuid) AS k FROM done)
    WHERE k = 1),
hits AS (SELECT r.run_uuid AS new_run, n.run_uuid AS old_run FROM runs r
    JOIN params p ON p.run_uuid = r.run_uuid AND p.key = 'model_nickname'
    JOIN params q ON q.run_uuid = r.run_uuid AND q.key = 'dataset_name'
    JOIN params f ON f.run_uuid = r.run_uuid AND f.key = 'fold'
    JOIN newest n ON n.model = p.value AND n.ds = q.value AND n.fold = f.value
    WHERE r.status = 'SCHEDULED')
SELECT 'params' AS kind, h.new_run AS run_uuid, p.key, p.value, NULL::DOUBLE AS number, NULL::VARCHAR AS at FROM hits h JOIN params p ON p.run_uuid = h.old_run
UNION ALL SELECT 'metrics', h.new_run, m.key, cast(m.step AS string), m.value, cast(cast(m.ts AS date) AS string) FROM hits h JOIN metrics m ON m.run_uuid = h.old_run
UNION ALL SELECT 'tags', h.new_run, g.key, g.value, NULL, NULL FROM hits h JOIN tags g ON g.run_uuid = h.old_run
UNION ALL SELECT 'tags', new_run, 'existent_run_id', old_run, NULL, NULL FROM hits
UNION ALL SELECT 'runs', new_run, 'status', 'FINISHED', NULL, NULL FROM hits""")
def _(t):
    names = ["model_nickname", "dataset_name", "fold"]
    waiting = t["runs"].where("status = 'SCHEDULED'").select("run_uuid").join(R.pivot_keys(t["params"], names), "run_uuid")
    hits = R.match_existing_runs(t.store, waiting.withColumnRenamed("run_uuid", "new_run"), "new_run", names)
    out = R.copy_cached_results(t.store, hits.select("new_run", F.col("run_uuid").alias("old_run")))
    rows = [out["params"].select(F.lit("params").alias("kind"), "run_uuid", "key", "value"),
            out["metrics"].select(F.lit("metrics").alias("kind"), "run_uuid", "key", F.col("step").cast("string").alias("value"),
                                  F.col("value").alias("number"), F.col("ts").cast("date").cast("string").alias("at")),
            out["tags"].select(F.lit("tags").alias("kind"), "run_uuid", "key", "value"),
            out["runs"].select(F.lit("runs").alias("kind"), "run_uuid", F.lit("status").alias("key"), F.col("status").alias("value"))]
    return rows[1].unionByName(rows[0], True).unionByName(rows[2], True).unionByName(rows[3], True)


@query("child_runs", """
SELECT run_uuid AS parent_run, cast(regexp_extract(key, '([0-9]+)$', 1) AS int) AS trial, value AS child_run
FROM tags WHERE key LIKE 'child\\_run\\_id\\_%' ESCAPE '\\'""")
def _(t):
    return R.child_runs(t["tags"])


@query("latest_metrics", f"WITH {_LATEST} SELECT * FROM latest")
def _(t):
    return R.latest_metrics(t["metrics"])


@query("model_comparison", f"""
WITH {_LATEST},
w AS (SELECT run_uuid, {_case(['model_nickname', 'dataset_name'])} FROM params GROUP BY run_uuid),
f AS (SELECT w.model_nickname, w.dataset_name, l.value FROM runs r JOIN w ON w.run_uuid = r.run_uuid
      JOIN experiments e ON e.experiment_id = r.experiment_id JOIN latest l ON l.run_uuid = r.run_uuid AND l.key = 'test_rmse'
      WHERE r.status = 'FINISHED' AND r.lifecycle_stage = 'active' AND e.name IN ('ASIA', 'EUROPE'))
SELECT dataset_name, """ + ", ".join(
    f"avg(CASE WHEN model_nickname = '{m}' THEN round(value * 100) END) AS \"{m}\""
    for m in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM f GROUP BY dataset_name")
def model_comparison(t):
    """For the finished, active runs of two experiments: mean latest test_rmse (in hundredths, so sums are exact) per dataset."""
    runs = t["runs"].where("status = 'FINISHED' AND lifecycle_stage = 'active'")
    params = R.query_runs({**t.store, "runs": runs}, ["run_uuid"], None, _NAMES, "params", ["model_nickname", "dataset_name"])
    scores = R.pivot_keys(R.latest_metrics(t["metrics"].where("key = 'test_rmse'")), ["test_rmse"])
    models = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    joined = params.join(scores.withColumn("rmse_cents", F.round(F.col("test_rmse") * 100)), "run_uuid")
    return S.means_by_model(joined, "model_nickname", ["dataset_name"], "rmse_cents", models)
