"""Parzen-estimator proposals. A study is a fortieth of the customers; its orders are the trials, finished ones have a value."""

from pyspark.sql import functions as F

from runquarry.operators import tpe as Q
from runquarry.plans.registry import query

_SPEC = """SELECT s.study, p.* FROM (SELECT DISTINCT o_custkey % 40 AS study FROM {0}) s, (VALUES
    ('rate', 'float', 0.0005E0, 1.0E0, cast(NULL AS double), true), ('depth', 'int', 1.0E0, 8.0E0, 1.0E0, false),
    ('width', 'float', 0.0E0, 10.0E0, 0.5E0, false)) AS p(param, kind, low, high, step, log)"""
_TRIALS = "SELECT o_custkey % 40 AS study, o_orderkey AS trial, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS value FROM {0}"
_VALUES = """SELECT o_custkey % 40 AS study, o_orderkey AS trial, 'rate' AS param, 0.001E0 + o_orderkey % 97 / 100.0E0 AS number, cast(NULL AS string) AS choice FROM {0}
    UNION ALL SELECT o_custkey % 40, o_orderkey, 'depth', 1.0E0 + o_orderkey % 8, NULL FROM {0}
    UNION ALL SELECT o_custkey % 40, o_orderkey, 'width', o_orderkey % 21 / 2.0E0, NULL FROM {0}
    UNION ALL SELECT o_custkey % 40, o_orderkey, 'kind', NULL, substring('abca', cast(o_orderkey % 4 AS int) + 1, 1) FROM {0}"""

_SPLIT = f"""t AS ({_TRIALS.format("orders")}),
r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value, trial) AS k, count(*) OVER (PARTITION BY study) AS n FROM t WHERE value IS NOT NULL),
s AS (SELECT t.*, coalesce(k <= least(ceil(n * 0.1E0), 25), false) AS good FROM t LEFT JOIN r ON r.study = t.study AND r.trial = t.trial)"""


def _of(t, text):
    return t.spark.sql(text.replace("{0}", "{orders}"), orders=t["orders"])


def _spec(t):
    numeric = _of(t, _SPEC).withColumn("choices", F.lit(None).cast("array<string>"))
    kinds = numeric.where("param = 'rate'").withColumns({
        "param": F.lit("kind"), "kind": F.lit("categorical"), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "log": F.lit(False),
        "choices": F.array(F.lit("a"), F.lit("b"), F.lit("c"))})
    return numeric.unionByName(kinds)


@query("tpe_split", f"WITH {_SPLIT} SELECT study, trial, value, good FROM s")
def _(t):
    return Q.split_trials(_of(t, _TRIALS), ["study"])


_WEIGHTED = f"""v AS ({_VALUES.format("orders")}),
w AS (SELECT v.*, good, row_number() OVER (PARTITION BY v.study, param, good ORDER BY v.trial) - 1 AS i, count(*) OVER (PARTITION BY v.study, param, good) AS n
      FROM v JOIN s ON s.study = v.study AND s.trial = v.trial),
x AS (SELECT *, CASE WHEN i < n - 25 THEN 1.0E0 / n + i * (1 - 1.0E0 / n) / greatest(n - 26, 1) ELSE 1.0E0 END AS weight FROM w)"""


# The density of both sides at both ends and in the middle of every range.
@query("tpe_densities", f"""
WITH {_SPLIT}, {_WEIGHTED}, p AS ({_SPEC.format("orders")}),
b AS (SELECT *, CASE WHEN log THEN ln(low) ELSE low - coalesce(step, 0) / 2 END AS lo, CASE WHEN log THEN ln(high) ELSE high + coalesce(step, 0) / 2 END AS hi FROM p),
k AS (SELECT b.*, good, trial, CASE WHEN log THEN ln(number) ELSE number END AS mu, weight, n FROM x JOIN b ON b.study = x.study AND b.param = x.param
      UNION ALL SELECT b.*, good, NULL, (lo + hi) / 2, 1, NULL FROM b, (VALUES (true), (false)) AS g(good)),
g AS (SELECT *, mu - lag(mu) OVER o AS l, lead(mu) OVER o - mu AS r FROM k WINDOW o AS (PARTITION BY study, param, good ORDER BY mu, trial NULLS LAST)),
z AS (SELECT *, (CASE WHEN trial IS NULL THEN hi - lo ELSE least(hi - lo, greatest((hi - lo) / least(100, n + 1), greatest(coalesce(l, r), coalesce(r, l)))) END) * sqrt(3) / pi() AS scale FROM g),
a AS (SELECT *, low + (high - low) * j / 2 AS number FROM z, (SELECT unnest([0, 1, 2]) AS j)),
e AS (SELECT *, CASE WHEN log THEN ln(number) ELSE number END AS place_x FROM a),
f AS (SELECT *, CASE WHEN step IS NULL THEN exp(-abs((place_x - mu) / scale)) / (scale * (1 + exp(-abs((place_x - mu) / scale))) ** 2)
      ELSE 1 / (1 + exp(-(place_x + step / 2 - mu) / scale)) - 1 / (1 + exp(-(place_x - step / 2 - mu) / scale)) END
      / (1 / (1 + exp(-(hi - mu) / scale)) - 1 / (1 + exp(-(lo - mu) / scale))) AS one FROM e)
SELECT study, param, j AS place, number, good, round(sum(weight * one) / sum(weight), 9) AS density FROM f GROUP BY ALL""")
def _(t):
    spec = _spec(t).where("kind <> 'categorical'")
    split = Q.split_trials(_of(t, _TRIALS), ["study"])
    kernels = Q.parzen_kernels(spec, split, _of(t, _VALUES), ["study"])
    points = spec.select("study", "param", "low", "high", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("place"))
    points = points.select("study", "param", "place", (F.col("low") + (F.col("high") - F.col("low")) * F.col("place") / 2).alias("number"))
    return Q.densities(kernels, points, ["study"], ["place"]).select("study", "param", "place", "number", "good", F.round("density", 9).alias("density"))


@query("tpe_choice_shares", f"""
WITH {_SPLIT}, {_WEIGHTED}, c AS (SELECT DISTINCT study, unnest(['a', 'b', 'c']) AS choice FROM t),
m AS (SELECT c.study, c.choice, coalesce(sum(weight) FILTER (good), 0) AS g, coalesce(sum(weight) FILTER (NOT good), 0) AS b
      FROM c LEFT JOIN x ON x.study = c.study AND x.param = 'kind' AND x.choice = c.choice GROUP BY ALL)
SELECT study, choice, round((g + 1 / 3.0E0) / (sum(g) OVER o + 1), 9) AS share_good, round((b + 1 / 3.0E0) / (sum(b) OVER o + 1), 9) AS share_bad FROM m WINDOW o AS (PARTITION BY study)""")
def _(t):
    shares = Q.choice_shares(_spec(t), Q.split_trials(_of(t, _TRIALS), ["study"]), _of(t, _VALUES), ["study"])
    return shares.select("study", "choice", F.round("share_good", 9).alias("share_good"), F.round("share_bad", 9).alias("share_bad"))


# Ten proposals a study, the first trial being its default setting. Draws by density ratio have no SQL; tests follow them.
@query("tpe_candidates")
def _(t):
    sampled = Q.tpe_candidates(_spec(t), _of(t, _TRIALS), _of(t, _VALUES), 10, seed=5, keys=["study"])
    default = _spec(t).select("study", F.lit(0).cast("bigint").alias("trial"), "param", "low", F.get("choices", F.lit(0)).alias("choice"))
    default = default.select("study", "trial", "param", F.col("low").alias("number"), "choice")
    first = sampled.withColumn("trial", F.col("trial") + 1)
    return default.unionByName(first).where("trial < 10")
