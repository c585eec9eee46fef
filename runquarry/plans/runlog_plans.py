"""Run-log shaping; one run per order."""

from pyspark.sql import functions as F

from runquarry.operators import runlog as L
from runquarry.operators.grid import pending_combinations
from runquarry.plans.registry import query

_RUN = "concat('run-', cast(o_orderkey AS string))"


def _run():
    return F.expr(_RUN).alias("run_uuid")


@query("log_metrics", f"""
WITH o AS (SELECT {_RUN} AS run_uuid, o_totalprice, cast(o_custkey AS double) AS c, (o_orderstatus = 'F')::int::double AS ok FROM orders)
SELECT run_uuid, 'fit_model_return_elapsed_time' AS key, o_totalprice AS value FROM o
UNION ALL SELECT run_uuid, 'fit_model_return_max_memory_used', c FROM o
UNION ALL SELECT run_uuid, 'evaluate_model_return_elapsed_time', c FROM o
UNION ALL SELECT run_uuid, 'test_rmse', o_totalprice FROM o
UNION ALL SELECT run_uuid, 'converged', ok FROM o
UNION ALL SELECT run_uuid, 'total_elapsed_time', o_totalprice FROM o
UNION ALL SELECT run_uuid, 'max_memory_used_after_fit', c FROM o""")
def _(t):
    price, customer = F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    steps = {
        "fit_model_return": {"elapsed_time": price, "max_memory_used": customer, "n_iter": customer},
        "evaluate_model_return": {"elapsed_time": customer, "test_rmse": price, "note": F.col("o_orderpriority"),
                                  "converged": (F.col("o_orderstatus") == "F").cast("string")},
        "": {"total_elapsed_time": price, "max_memory_used_after_fit": customer, "other": price},
    }
    rows = [F.struct(F.lit(step).alias("step_name"), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]).alias("payload"))
            for step, values in steps.items()]
    results = t["orders"].select(_run(), F.explode(F.array(*rows)).alias("r")).select("run_uuid", "r.*")
    return L.log_metrics(results)


_EXISTING = f"""existing AS (SELECT run_uuid, key, value FROM params
    UNION ALL SELECT {_RUN}, 'fold_change_1', 'x' FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT {_RUN}, 'fold_change_3', 'y' FROM orders WHERE o_orderstatus = 'F')"""


@query("log_params_with_changes", """
WITH o AS (SELECT run_uuid, n, status FROM runs)
SELECT run_uuid, CASE WHEN status = 'FINISHED' THEN 'fold_change_2' ELSE 'fold_change_1' END AS key, concat('new-', cast(n AS string)) AS value FROM o
UNION ALL SELECT run_uuid, 'extra', cast(n AS string) FROM o
UNION ALL SELECT p.run_uuid, 'random_seed_change_1', '0' FROM params p WHERE p.key = 'random_seed' AND p.value <> '0'
UNION ALL SELECT run_uuid, 'random_seed', '0' FROM o WHERE run_uuid NOT IN (SELECT run_uuid FROM params WHERE key = 'random_seed')""")
def _(t):
    finished = t["runs"].where("status = 'FINISHED'").select("run_uuid")
    existing = t["params"]
    for key, value in (("fold_change_1", "x"), ("fold_change_3", "y")):
        existing = existing.unionByName(finished.select("run_uuid", F.lit(key).alias("key"), F.lit(value).alias("value")))
    n = F.col("n").cast("string")
    items = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (
        ("fold", F.concat(F.lit("new-"), n)), ("extra", n), ("random_seed", F.lit("0")))])
    new = t["runs"].select("run_uuid", F.explode(items).alias("p")).select("run_uuid", "p.*")
    return L.log_params_with_changes(existing, new)


@query("log_outcome", """
SELECT run_uuid, 'status' AS key, status AS value FROM runs WHERE status <> 'SCHEDULED'
UNION ALL SELECT run_uuid, 'raised_exception', CASE WHEN status = 'FAILED' THEN 'True' ELSE 'False' END FROM runs WHERE status <> 'SCHEDULED'
UNION ALL SELECT run_uuid, 'EXCEPTION', concat('failed after ', cast(n AS string)) FROM runs WHERE status = 'FAILED'""")
def _(t):
    outcome = F.when(F.col("status") == "FINISHED", True).when(F.col("status") == "FAILED", False)
    outcomes = t["runs"].select("run_uuid", outcome.alias("finished"), F.concat(F.lit("failed after "), F.col("n").cast("string")).alias("exception"))
    status, tags = L.log_outcome(outcomes)
    return status.select("run_uuid", F.lit("status").alias("key"), F.col("status").alias("value")).unionByName(tags)


@query("log_start_params", f"""
WITH o AS (SELECT {_RUN} AS run_uuid, * FROM orders)
SELECT run_uuid, 'model' AS key, o_orderpriority AS value FROM o
UNION ALL SELECT run_uuid, 'seeds/item_0', cast(o_custkey AS string) FROM o
UNION ALL SELECT run_uuid, 'seeds/item_1', cast(o_orderkey AS string) FROM o
UNION ALL SELECT run_uuid, 'fit/verbose', 'False' FROM o
UNION ALL SELECT run_uuid, 'fit/status', o_orderstatus FROM o
UNION ALL SELECT run_uuid, 'experiment_class_name', 'OrderExperiment' FROM o""")
def _(t):
    combination = F.to_json(F.struct(F.col("o_orderpriority").alias("model"), F.array("o_custkey", "o_orderkey").alias("seeds")))
    unique = F.to_json(F.struct(F.struct(F.lit(False).alias("verbose"), F.col("o_orderstatus").alias("status")).alias("fit")))
    runs = t["orders"].select(_run(), combination.alias("combination"), unique.alias("unique_params"))
    return L.log_start_params(runs, ["combination", "unique_params"], {"experiment_class_name": "OrderExperiment"})


@query("run_hash", f"""
SELECT {_RUN} AS run_uuid, substring(sha256(concat('o_orderpriority_', o_orderpriority, '_o_custkey_', cast(o_custkey AS string),
       '_o_orderkey_', cast(o_orderkey AS string))), 1, 10) AS hash FROM orders""")
def _(t):
    return t["orders"].select(_run(), L.run_hash(["o_orderpriority", "o_custkey", "o_orderkey"], t["orders"]).alias("hash"))


# Parameters of every kind: doubles that Spark and Python lay out differently, booleans, NULL.
TYPED = """SELECT concat('run-', cast(o_orderkey AS string)) AS run_uuid, o_orderstatus, o_custkey % 500 / 1.0E7 AS rate, o_totalprice * 1000 AS budget,
       o_custkey % 2 = 0 AS warm, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 5 > 2 END AS early, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS model FROM {0}"""
TYPED_NAMES = ["rate", "budget", "warm", "early", "model"]
_TYPED_TEXT = {"rate": "cast(rate AS string)", "budget": "cast(budget AS string)", "warm": "CASE WHEN warm THEN 'True' ELSE 'False' END",
               "early": "CASE WHEN early THEN 'True' WHEN NOT early THEN 'False' ELSE 'None' END", "model": "coalesce(model, 'None')"}


def typed(t):
    return t.spark.sql(TYPED.format("{orders}"), orders=t["orders"])


@query("run_hash_typed", f"""
WITH typed AS ({TYPED.format("orders")}) SELECT run_uuid, substring(sha256(concat({", '_', ".join(f"'{n}_', {_TYPED_TEXT[n]}" for n in TYPED_NAMES)})), 1, 10) AS hash FROM typed""")
def _(t):
    df = typed(t)
    return df.select("run_uuid", L.run_hash(TYPED_NAMES, df).alias("hash"))


@query("log_start_params_typed", f"WITH typed AS ({TYPED.format('orders')}) " + " UNION ALL ".join(f"SELECT run_uuid, '{n}' AS key, {_TYPED_TEXT[n]} AS value FROM typed" for n in TYPED_NAMES))
def _(t):
    return L.log_start_params(_typed_documents(t), ["combination"])


def _typed_documents(t):
    return typed(t).select("run_uuid", F.to_json(F.struct(*TYPED_NAMES), {"ignoreNullFields": "false"}).alias("combination"))


# What the runs of all orders have logged, looked up by the values themselves: only those without a finished run are pending.
@query("pending_combinations_typed", f"""
WITH typed AS ({TYPED.format("orders")}) SELECT DISTINCT rate, warm, early, model FROM typed w WHERE NOT EXISTS (SELECT 1 FROM typed d WHERE d.o_orderstatus = 'F'
  AND d.rate = w.rate AND d.warm = w.warm AND d.early IS NOT DISTINCT FROM w.early AND d.model IS NOT DISTINCT FROM w.model)""")
def _(t):
    names = ["rate", "warm", "early", "model"]
    store = t.store.replace(params=L.log_start_params(_typed_documents(t), ["combination"]))
    return pending_combinations(store, typed(t).select(*names).distinct(), names).select(*names)


@query("last_step_finished", """
SELECT l_orderkey AS run_uuid, 'Last step finished' AS key, concat('step_', cast(max(l_linenumber) AS string)) AS value FROM lineitem GROUP BY 1""")
def _(t):
    steps = t["lineitem"].select(F.col("l_orderkey").alias("run_uuid"), F.concat(F.lit("step_"), F.col("l_linenumber").cast("string")).alias("step_name"),
                                 F.col("l_linenumber").alias("step_order"))
    return L.last_step_finished(steps)
