"""Run-store shaped views over the test tables (FIXTURES.md), for Spark and for the SQL check."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from runquarry.sources.store import RunStore

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
               "conversations").split()

_KEYS = "'model_nickname', 'dataset_name', 'seed_dataset', 'fold', 'random_seed'"
_KEYS_SPARK = f"orders LATERAL VIEW explode(array({_KEYS})) k AS key"
_KEYS_DUCKDB = f"orders CROSS JOIN (SELECT unnest([{_KEYS}]) AS key) AS k"

# In dependency order.
VIEWS: dict[str, str] = {
    "experiments": """
SELECT r_regionkey AS experiment_id, r_name AS name,
       CASE WHEN r_regionkey = 4 THEN 'deleted' ELSE 'active' END AS lifecycle_stage FROM region""",
    "runs": """
SELECT concat('run-', cast(o_orderkey AS string)) AS run_uuid, cast(o_custkey % 5 AS int) AS experiment_id,
       CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'SCHEDULED' ELSE 'FAILED' END AS status,
       CASE WHEN o_orderkey % 10 = 0 THEN 'deleted' ELSE 'active' END AS lifecycle_stage,
       o_orderdate AS start_time, o_totalprice AS elapsed, o_orderkey AS n FROM orders""",
    "params": """
SELECT concat('run-', cast(o_orderkey AS string)) AS run_uuid, k.key AS key,
       CASE k.key WHEN 'model_nickname' THEN o_orderpriority
                  WHEN 'dataset_name' THEN concat('ds', cast(o_custkey % 7 AS string))
                  WHEN 'seed_dataset' THEN cast(o_custkey % 3 AS string)
                  WHEN 'fold' THEN cast(o_orderkey % 5 AS string)
                  ELSE cast(o_orderkey % 4 AS string) END AS value
FROM {orders_and_keys}
WHERE NOT (k.key = 'random_seed' AND o_orderkey % 11 = 0)""",
    "metrics": """
SELECT concat('run-', cast(l_orderkey AS string)) AS run_uuid,
       CASE l_returnflag WHEN 'A' THEN 'test_rmse' WHEN 'N' THEN 'test_r2_score' ELSE 'validation_score' END AS key,
       l_extendedprice AS value, cast(l_linenumber AS bigint) AS step, l_shipdate AS ts FROM lineitem""",
    "tags": """
SELECT run_uuid, 'raised_exception' AS key, CASE WHEN status = 'FAILED' THEN 'True' ELSE 'False' END AS value FROM runs
UNION ALL
SELECT run_uuid, 'mlflow.parentRunId', concat('run-', cast(n - n % 20 AS string)) FROM runs WHERE n % 20 <> 0
UNION ALL
SELECT concat('run-', cast(n - n % 20 AS string)), concat('child_run_id_', cast(n % 20 - 1 AS string)), run_uuid
FROM runs WHERE n % 20 <> 0""",
    "experiment_tags": "SELECT experiment_id, 'owner' AS key, name AS value FROM experiments",
    "results": """
SELECT l_returnflag AS model, l_suppkey AS task_id, concat('ds', cast(l_suppkey % 7 AS string)) AS dataset,
       l_linenumber AS fold, l_extendedprice AS metric FROM lineitem""",
    "predictions": """
SELECT cast(l_orderkey % 3 AS int) AS model, l_extendedprice AS y_reg, l_quantity * 1500.0E0 AS p_reg,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y_bin,
       CASE WHEN l_discount >= 0.05E0 THEN 1 ELSE 0 END AS p_bin, l_discount * 10 AS s_bin,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y_cls, cast(l_quantity AS int) % 3 AS p_cls,
       (l_discount + 0.01E0) / (l_discount + l_tax + 0.06E0) AS s0,
       (l_tax + 0.01E0) / (l_discount + l_tax + 0.06E0) AS s1,
       0.04E0 / (l_discount + l_tax + 0.06E0) AS s2 FROM lineitem""",
    "features": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS size, 1.0E0 AS const,
       CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END AS type,
       CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS bin, p_brand AS brand,
       CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM part""",
    "src_experiments": """
SELECT experiment_id + 100 AS experiment_id, CASE WHEN experiment_id < 2 THEN concat(name, '_B') ELSE name END AS name,
       lifecycle_stage FROM experiments""",
    "src_runs": """
SELECT run_uuid, experiment_id + 100 AS experiment_id, status, lifecycle_stage FROM runs WHERE n % 3 <> 0""",
    "dst_runs": "SELECT run_uuid, experiment_id, status, lifecycle_stage FROM runs WHERE n % 3 <> 1",
}


def _names_in(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [v for v in VIEWS if v in words]


def duckdb_with(query: str) -> str:
    """The query with the views it needs as a WITH prefix."""
    needed: set[str] = set()
    todo = _names_in(query)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _names_in(VIEWS[name]) if n != name]
    ctes = [f"{name} AS ({VIEWS[name].format(orders_and_keys=_KEYS_DUCKDB).strip()})" for name in VIEWS if name in needed]
    query = query.strip()
    if not ctes:
        return query
    if re.match(r"with\s", query, re.IGNORECASE):
        return "WITH " + ",\n".join(ctes) + ",\n" + query[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + query


class Tables(Mapping[str, DataFrame]):
    """Test tables and fixture views of one scale factor, loaded on first use."""

    _cache: dict[tuple[str, str], Tables] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._loaded: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        key = (spark.sparkContext.applicationId + str(id(spark)), sf_dir)
        return cls._cache.setdefault(key, cls(spark, sf_dir))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            if name in VIEWS:
                text = VIEWS[name].format(orders_and_keys=_KEYS_SPARK)
                sources = [n for n in [*VIEWS, *BASE_TABLES] if n != name and re.search(rf"\bFROM {n}\b", text)]
                marked = re.sub(rf"\bFROM ({'|'.join(sources)})\b", r"FROM {\1}", text)
                self._loaded[name] = self.spark.sql(marked, **{n: self[n] for n in sources})
            else:
                self._loaded[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._loaded[name]

    def __iter__(self):
        return iter([*VIEWS, *BASE_TABLES])

    def __len__(self):
        return len(VIEWS) + len(BASE_TABLES)

    @property
    def store(self) -> RunStore:
        """The fixture views as one run store."""
        return RunStore({n: self[n] for n in ("experiments", "experiment_tags", "runs", "params", "tags", "metrics")})
