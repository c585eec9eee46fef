"""Means, ranks and significance tests. Metrics are fed in hundredths: their sums are then exact in a double."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from runquarry.operators import stats as S
from runquarry.plans.registry import query

_MODELS = ["A", "N", "R"]


def _results(t):
    return t["results"].withColumn("metric", F.round(F.col("metric") * 100))


_RES = "res AS (SELECT model, task_id, dataset, fold, round(metric * 100) AS metric FROM results)"


def _cols(fn, suffix="", digits=None):
    expr = f"{fn}(CASE WHEN model = '{{m}}' THEN metric END)"
    expr = f"round({expr}, {digits})" if digits else expr
    return ", ".join(f'{expr.format(m=m)} AS "{m}{suffix}"' for m in _MODELS)


@query("means_by_model", f"WITH {_RES} SELECT task_id, dataset, {_cols('avg')} FROM res GROUP BY task_id, dataset")
def _(t):
    return S.means_by_model(_results(t), "model", ["task_id", "dataset"], "metric")


@query("stds_by_model", f"WITH {_RES} SELECT task_id, dataset, {_cols('stddev_samp', digits=4)} FROM res GROUP BY task_id, dataset")
def _(t):
    return S.stds_by_model(_results(t), "model", ["task_id", "dataset"], "metric", digits=4)


@query("means_stds_by_model", f"""
WITH {_RES} SELECT task_id, dataset, {_cols('avg', '_mean', 4)}, {_cols('stddev_samp', '_std', 4)}
FROM res GROUP BY task_id, dataset""")
def _(t):
    return S.means_stds_by_model(_results(t), "model", ["task_id", "dataset"], "metric", _MODELS, digits=4)


def _ranked(direction, block="task_id, dataset"):
    return f"""ranked AS (SELECT *, rank() OVER (PARTITION BY {block} ORDER BY metric {direction})
    + (count(*) OVER (PARTITION BY {block}, metric) - 1) / 2.0E0 AS rank FROM res)"""


@query("rank_in_block", f"WITH {_RES}, {_ranked('DESC')} SELECT * FROM ranked")
def _(t):
    return S.rank_in_block(_results(t), ["task_id", "dataset"], "metric")


@query("mean_rank", f"WITH {_RES}, {_ranked('DESC')} SELECT model, avg(rank) AS mean_rank FROM ranked GROUP BY model")
def _(t):
    return S.mean_rank(_results(t), "model", ["task_id", "dataset"], "metric")


_CELLS = """cells AS (SELECT task_id, model, avg(metric) AS metric FROM res GROUP BY task_id, model),
full_blocks AS (SELECT task_id FROM cells GROUP BY task_id HAVING count(*) = (SELECT count(DISTINCT model) FROM cells)),
ranked AS (SELECT model, task_id, rank() OVER (PARTITION BY task_id ORDER BY metric) + (count(*) OVER (PARTITION BY task_id, metric) - 1) / 2.0E0 AS rank,
    count(*) OVER (PARTITION BY task_id, metric) AS ties FROM cells WHERE task_id IN (SELECT task_id FROM full_blocks)),
per_model AS (SELECT model, sum(rank) AS r, count(*) AS n, avg(rank) AS mean_rank, sum(ties * ties - 1) AS t FROM ranked GROUP BY model),
one AS (SELECT count(*) AS k, max(n) AS n, sum(r * r) AS rr, sum(t) AS tt FROM per_model),
test AS (SELECT (12.0E0 / (n * k * (k + 1)) * rr - 3.0E0 * n * (k + 1)) / (1.0E0 - tt / cast(n * k * (k * k - 1) AS double)) AS statistic, k, n FROM one)"""


@query("friedman", f"""
WITH {_RES}, {_CELLS}
SELECT round(statistic, 6) AS statistic, k, n, round(exp(-statistic / 2), 6) AS p_value FROM test""")
def _(t):
    return S.friedman(_results(t), "model", ["task_id"], "metric", digits=6)


# The normal distribution by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7), the integral
# over a fixed grid. Its six constants.
_TAIL = """grid AS (SELECT -9 + 0.01E0 * i AS z FROM range(1801) AS g(i)),
pairs AS (SELECT a.model AS model_a, b.model AS model_b, one.k AS k,
    abs(a.mean_rank - b.mean_rank) / sqrt(one.k * (one.k + 1) / (6.0E0 * one.n)) AS q
    FROM per_model a JOIN per_model b ON a.model <> b.model CROSS JOIN one),
points AS (SELECT model_a, model_b, k, q, z, x, 1 / (1 + 0.2316419E0 * abs(x)) AS u, lower
    FROM (SELECT *, unnest([z, z - q * sqrt(2.0E0)]) AS x, unnest([1, -1]) AS lower FROM pairs, grid)),
cdf AS (SELECT *, CASE WHEN x < 0 THEN t ELSE 1 - t END AS c FROM (SELECT *, exp(-x * x / 2) / sqrt(2 * pi())
    * u * (0.319381530E0 + u * (-0.356563782E0 + u * (1.781477937E0 + u * (-1.821255978E0 + u * 1.330274429E0)))) AS t FROM points)),
spans AS (SELECT model_a, model_b, k, q, z, greatest(sum(lower * c), 0) AS span FROM cdf GROUP BY ALL),
p_values AS (SELECT model_a, model_b, q, 1 - k * 0.01E0 * sum(exp(-z * z / 2) / sqrt(2 * pi()) * pow(span, k - 1)) AS p FROM spans GROUP BY model_a, model_b, k, q)"""


@query("nemenyi", f"""
WITH {_RES}, {_CELLS}, {_TAIL}
SELECT model_a, model_b, round(q, 6) AS q, round(p, 4) AS p_value FROM p_values""")
def _(t):
    return S.nemenyi(_results(t), "model", ["task_id"], "metric", digits=6).withColumn("p_value", F.round("p_value", 4))


@query("nemenyi_p_values", f"""
WITH {_RES}, {_CELLS.replace("task_id", "dataset")}, {_TAIL}
SELECT model_a, model_b, round(p, 4) AS p_value FROM p_values""")
def _(t):
    return S.nemenyi(_results(t), "model", ["dataset"], "metric").select("model_a", "model_b", F.round("p_value", 4).alias("p_value"))


_ALPHAS = (0.05, 0.95)
_PLACES = _ranked("DESC", "task_id").replace("ranked AS", "places AS", 1)


@query("friedman_nemenyi", f"""
WITH {_RES}, {_CELLS}, {_TAIL},
shown AS (SELECT alpha, exp(-statistic / 2) AS p, exp(-statistic / 2) < bound AS significant
          FROM test, (VALUES (0.05E0, 0.95E0), (0.95E0, 0.05E0)) AS gates(alpha, bound)),
{_PLACES}
SELECT alpha, 'friedman' AS kind, NULL::VARCHAR AS model_a, NULL::VARCHAR AS model_b, round(p, 4) AS value FROM shown
UNION ALL SELECT alpha, 'nemenyi', model_a, model_b, round(p_values.p, 4) FROM shown, p_values WHERE significant
UNION ALL SELECT alpha, 'mean_rank', model, NULL, round(avg(rank), 4) FROM shown, places WHERE significant GROUP BY alpha, model""")
def _(t):
    parts, none = [], F.lit(None).cast("string")
    for alpha in _ALPHAS:
        test, pairs, means = S.friedman_nemenyi(_results(t), "model", ["task_id"], "metric", alpha=alpha)
        parts += [test.select(F.lit("friedman").alias("kind"), none.alias("model_a"), none.alias("model_b"), F.col("p_value").alias("value"), F.lit(alpha).alias("alpha")),
                  pairs.select(F.lit("nemenyi").alias("kind"), "model_a", "model_b", F.col("p_value").alias("value"), F.lit(alpha).alias("alpha")),
                  means.select(F.lit("mean_rank").alias("kind"), F.col("model").alias("model_a"), none.alias("model_b"), F.col("mean_rank").alias("value"), F.lit(alpha).alias("alpha"))]
    return reduce(DataFrame.unionByName, parts).withColumn("value", F.round("value", 4))
