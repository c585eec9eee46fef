"""Search spaces, candidates, trials and fits. A supplier is a study, an order a trial of its customer's study."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from runquarry.operators import sweeps as W
from runquarry.operators.fits import fit_combinations
from runquarry.plans.registry import query
from runquarry.plans.runlog_plans import TYPED, typed


def _round(df, digits):
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def _spec(t, log=False):
    null, nation = F.lit(None), F.col("s_nationkey")

    def row(param, kind, low=null, high=null, step=null, log=False, choices=null):
        return F.struct(F.lit(param).alias("param"), F.lit(kind).alias("kind"), low.cast("double").alias("low"), high.cast("double").alias("high"),
                        step.cast("double").alias("step"), F.lit(log).alias("log"), choices.cast("array<string>").alias("choices"))

    if log:
        rows = [row("rate", "float", F.lit(0.001), F.pow(F.lit(10.0), nation % 3), F.lit(10.0), True),
                row("scale", "float", F.lit(0.5), F.lit(2.0) + nation, F.lit(1.7), True)]
    else:
        rows = [row("depth", "int", F.lit(1), F.lit(3) + nation % 4, F.lit(2)), row("width", "int", F.lit(2), F.lit(4) + nation % 2),
                row("rate", "float", F.lit(0.1), F.lit(0.6), F.lit(0.2)), row("kind", "categorical", choices=F.array(F.lit("a"), F.lit("b"), F.lit("c")))]
    return t["supplier"].select(F.col("s_suppkey").alias("study"), F.explode(F.array(*rows)).alias("r")).select("study", "r.*")


# (study, param, low, high, step, n) of the numeric parameters
_NUMERIC = """numeric AS (
    SELECT s_suppkey AS study, 'depth' AS param, 1.0E0 AS low, 3.0E0 + s_nationkey % 4 AS high, 2.0E0 AS step, true AS is_int FROM supplier
    UNION ALL SELECT s_suppkey, 'width', 2.0E0, 4.0E0 + s_nationkey % 2, 1.0E0, true FROM supplier
    UNION ALL SELECT s_suppkey, 'rate', 0.1E0, 0.6E0, 0.2E0, false FROM supplier),
sized AS (SELECT *, cast(floor((high - low) / step) + 1 AS bigint) AS n FROM numeric),
listed AS (SELECT *, unnest(range(n)) AS position FROM sized),
points AS (SELECT study, param, position, CASE WHEN is_int THEN floor(v) ELSE v END AS number, cast(NULL AS string) AS choice FROM (
    SELECT *, CASE WHEN position = 0 THEN low WHEN position = n - 1 THEN high ELSE low + position * ((high - low) / (n - 1)) END AS v FROM listed)
    UNION ALL SELECT s_suppkey, 'kind', unnest([0, 1, 2]), NULL, unnest(['a', 'b', 'c']) FROM supplier)"""


@query("discretize_space", f"WITH {_NUMERIC} SELECT study, param, position, round(number, 9) AS number, choice FROM points")
def _(t):
    return _round(W.discretize_space(_spec(t), ["study"]), 9)


@query("discretize_log_space", """
WITH spec AS (SELECT s_suppkey AS study, 'rate' AS param, 0.001E0 AS low, pow(10.0E0, s_nationkey % 3) AS high, 10.0E0 AS step FROM supplier
              UNION ALL SELECT s_suppkey, 'scale', 0.5E0, 2.0E0 + s_nationkey, 1.7E0 FROM supplier),
sized AS (SELECT *, cast(floor(ln(high / low) / ln(step)) + 1 AS bigint) AS n FROM spec),
listed AS (SELECT *, unnest(range(n)) AS position FROM sized)
SELECT study, param, position, round(pow(10.0E0, CASE WHEN n = 1 THEN log10(low) ELSE log10(low) + position * (log10(high) - log10(low)) / (n - 1) END), 9) AS number,
       cast(NULL AS string) AS choice FROM listed""")
def _(t):
    return _round(W.discretize_space(_spec(t, log=True), ["study"]), 9)


@query("grid_candidates", f"""
WITH {_NUMERIC},
d AS (SELECT study, position AS i, number AS depth FROM points WHERE param = 'depth'),
k AS (SELECT study, position AS i, choice AS kind FROM points WHERE param = 'kind'),
r AS (SELECT study, position AS i, number AS rate, count(*) OVER (PARTITION BY study) AS n FROM points WHERE param = 'rate'),
w AS (SELECT study, position AS i, number AS width, count(*) OVER (PARTITION BY study) AS n FROM points WHERE param = 'width')
SELECT d.study, ((d.i * 3 + k.i) * r.n + r.i) * w.n + w.i AS trial, cast(depth AS bigint) AS depth, kind, round(rate, 9) AS rate, cast(width AS bigint) AS width
FROM d JOIN k ON k.study = d.study JOIN r ON r.study = d.study JOIN w ON w.study = d.study""")
def _(t):
    p = F.col("params")
    return W.grid_candidates(_spec(t), ["study"]).select(
        "study", "trial", p["depth"].cast("bigint").alias("depth"), p["kind"].alias("kind"),
        F.round(p["rate"].cast("double"), 9).alias("rate"), p["width"].cast("bigint").alias("width"))


_U = """cast('0x' || substr(md5(concat('5:', cast(study AS string), ':', cast(trial AS string), ':', param)), 1, 12) AS ubigint) / 281474976710656.0E0"""
_DRAWS = f"""{_NUMERIC},
specs AS (SELECT study, param, low, high, step, is_int, cast(NULL AS string[]) AS choices FROM numeric
          UNION ALL SELECT s_suppkey, 'kind', NULL, NULL, NULL, false, ['a', 'b', 'c'] FROM supplier),
rows AS (SELECT *, unnest(range(20)) AS trial FROM specs),
u AS (SELECT *, {_U} AS u FROM rows),
draws AS (SELECT study, trial, param, CASE WHEN choices IS NULL THEN low + step * floor(u * (floor((high - low) / step) + 1)) END AS number,
                 choices[cast(floor(u * 3) AS int) + 1] AS choice FROM u)"""


@query("random_candidates", f"WITH {_DRAWS} SELECT study, trial, param, round(number, 9) AS number, choice FROM draws")
def _(t):
    return _round(W.random_candidates(_spec(t), 20, seed=5, keys=["study"]), 9)


@query("candidate_queue", f"""
WITH {_DRAWS}, all_trials AS (
    SELECT s_suppkey AS study, 0 AS trial, 0.1E0 AS rate, 'default' AS origin FROM supplier
    UNION ALL SELECT s_suppkey, 1, cast(s_nationkey AS double), 'default' FROM supplier WHERE s_acctbal > 5000
    UNION ALL SELECT d.study, d.trial + CASE WHEN s.s_acctbal > 5000 THEN 2 ELSE 1 END, d.number, 'sampled'
    FROM draws d JOIN supplier s ON s.s_suppkey = d.study WHERE d.param = 'rate')
SELECT study, trial, round(rate, 9) AS rate, origin FROM all_trials WHERE trial < 20""")
def _(t):
    s = t["supplier"]
    first = s.select(F.col("s_suppkey").alias("study"), F.lit(0).cast("bigint").alias("trial"), F.lit(0.1).alias("rate"), F.lit("default").alias("origin"))
    second = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("study"), F.lit(1).cast("bigint").alias("trial"),
                                               F.col("s_nationkey").cast("double").alias("rate"), F.lit("default").alias("origin"))
    sampled = W.random_candidates(_spec(t), 20, seed=5, keys=["study"]).where("param = 'rate'").select(
        "study", "trial", F.col("number").alias("rate"), F.lit("sampled").alias("origin"))
    return _round(W.candidate_queue(first.unionByName(second), sampled, 20, ["study"]), 9)


# The studies of every ninth supplier are NULL: they are one study.
@query("candidate_queue_null_study", """
WITH d AS (SELECT nullif(s_suppkey % 9, 0) AS study FROM supplier GROUP BY ALL),
all_trials AS (SELECT study, 0 AS trial, 'default' AS origin FROM d UNION ALL SELECT study, 1 + i, 'sampled' FROM d, (SELECT unnest(range(20)) AS i))
SELECT study, trial, origin FROM all_trials WHERE trial < 20""")
def _(t):
    studies = t["supplier"].select(F.expr("nullif(s_suppkey % 9, 0)").alias("study")).distinct()
    defaults = studies.select("study", F.lit(0).cast("bigint").alias("trial"), F.lit("default").alias("origin"))
    sampled = studies.select("study", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("trial"), F.lit("sampled").alias("origin"))
    return W.candidate_queue(defaults, sampled, 20, ["study"])


@query("trial_seeds_keys", """
SELECT o_orderpriority, o_custkey, o_orderkey AS trial,
       cast(cast('0x' || substr(md5(concat('3:', o_orderpriority, ':', cast(o_custkey AS string), ':', cast(o_orderkey AS string))), 1, 12) AS ubigint)
            % 2147483647 AS bigint) AS random_seed,
       concat(o_orderpriority, '_', cast(o_custkey AS string), '-', cast(o_orderkey AS string)) AS trial_key FROM orders""")
def _(t):
    trials = t["orders"].select("o_orderpriority", "o_custkey", F.col("o_orderkey").alias("trial"))
    return W.trial_seeds_keys(trials, ["o_orderpriority", "o_custkey"], hpo_seed=3)


@query("trial_seeds_keys_typed", f"""
WITH typed AS ({TYPED.format("orders")}), texts AS (SELECT run_uuid, cast(rate AS string) AS rate, CASE WHEN warm THEN 'True' ELSE 'False' END AS warm,
    CASE WHEN early THEN 'True' WHEN NOT early THEN 'False' END AS early, cast(replace(run_uuid, 'run-', '') AS bigint) AS trial FROM typed)
SELECT trial, cast(cast('0x' || substr(md5(concat('3:', rate, ':', warm, ':', coalesce(early, '\\N'), ':', cast(trial AS string))), 1, 12) AS ubigint)
            % 2147483647 AS bigint) AS random_seed,
       concat(rate, '_', warm, '_', coalesce(early, 'None'), '-', cast(trial AS string)) AS trial_key FROM texts""")
def _(t):
    trials = typed(t).select("rate", "warm", "early", F.expr("cast(replace(run_uuid, 'run-', '') AS bigint)").alias("trial"))
    return W.trial_seeds_keys(trials, ["rate", "warm", "early"], hpo_seed=3).select("trial", "random_seed", "trial_key")


def _trials(t):
    """Failed orders lack the metric, pending ones have no result."""
    result = (F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("rmse"), F.col("o_totalprice")))
              .when(F.col("o_orderstatus") == "O", F.create_map(F.lit("other"), F.lit(1.0))))
    return t["orders"].select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("trial"), result.alias("result"),
                              F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("params"), F.col("o_totalprice").alias("elapsed"),
                              F.concat(F.lit("child-"), F.col("o_orderkey").cast("string")).alias("child_run_id"))


_TRIALS = """trials AS (SELECT o_custkey AS study, o_orderkey AS trial, o_totalprice AS elapsed, o_orderpriority AS priority,
    CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN {worst}'Infinity'::double END AS value, o_orderstatus FROM orders)"""


@query("trial_objective", f"WITH {_TRIALS.format(worst='')} SELECT study, trial, value FROM trials")
def _(t):
    return W.trial_objective(_trials(t), "rmse").select("study", "trial", "value")


@query("effective_trials", """
WITH s AS (SELECT o_custkey AS study, o_orderkey AS trial, o_totalprice AS elapsed,
    coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT study, trial, elapsed FROM s WHERE before <= 1000000""")
def _(t):
    return W.effective_trials(_trials(t).select("study", "trial", "elapsed"), ["study"], 1_000_000)


_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value {order}, trial) AS r FROM trials
    WHERE value IS NOT NULL) WHERE r = 1)"""


@query("best_trial", f"""
WITH {_TRIALS.format(worst='-')}, {_BEST.format(order='DESC')} SELECT study, trial, value, elapsed, priority FROM best""")
def _(t):
    trials = W.trial_objective(_trials(t), "rmse", "maximize")
    return W.best_trial(trials, ["study"], "maximize").select("study", "trial", "value", "elapsed", F.col("params")["priority"].alias("priority"))


@query("best_summary", f"""
WITH {_TRIALS.format(worst='')}, {_BEST.format(order='')}, fine AS (SELECT * FROM best WHERE o_orderstatus = 'F')
SELECT study, 'best/rmse' AS key, value AS number, cast(NULL AS string) AS text FROM fine
UNION ALL SELECT study, 'best/value', value, NULL FROM fine
UNION ALL SELECT study, 'best/priority', NULL, priority FROM fine
UNION ALL SELECT study, 'best/child_run_id', NULL, concat('child-', cast(trial AS string)) FROM fine""")
def _(t):
    best = W.best_trial(W.trial_objective(_trials(t), "rmse"), ["study"])
    # studies where every trial failed would make the summary raise, as they should
    numbers, texts = W.best_summary(best.where(F.col("value") < float("inf")), ["study"], "rmse")
    return numbers.select("study", "key", F.col("value").alias("number"), F.lit(None).cast("string").alias("text")).unionByName(
        texts.select("study", "key", F.lit(None).cast("double").alias("number"), F.col("value").alias("text")))


@query("schedule_child_runs", """
WITH parents AS (SELECT run_uuid, experiment_id FROM runs WHERE run_uuid NOT IN (SELECT run_uuid FROM tags WHERE key LIKE 'child%')),
rows AS (SELECT *, unnest(range(3)) AS trial FROM parents)
SELECT md5(concat(run_uuid, ':', cast(trial AS string))) AS run_uuid, experiment_id, 'SCHEDULED' AS status, 'active' AS lifecycle_stage FROM rows""")
def _(t):
    runs, _, _ = W.schedule_child_runs(t["runs"], t["tags"], 3)
    return runs


@query("close_scheduled_children", """
WITH links AS (SELECT run_uuid AS parent_run, value AS child_run FROM tags WHERE key LIKE 'child\\_run\\_id\\_%' ESCAPE '\\'),
stopped AS (SELECT run_uuid AS parent_run, CASE WHEN elapsed > 300000 THEN 'timeout' ELSE 'grid' END AS reason, n FROM runs WHERE status = 'FINISHED'),
unrun AS (SELECT DISTINCT l.child_run AS run_uuid, s.reason FROM links l JOIN stopped s ON s.parent_run = l.parent_run
          JOIN runs r ON r.run_uuid = l.child_run AND r.status = 'SCHEDULED')
SELECT 'run' AS kind, run_uuid, 'status' AS key, CASE WHEN run_uuid IN (SELECT run_uuid FROM unrun) THEN 'FAILED' ELSE status END AS value FROM runs
UNION ALL SELECT 'tag', run_uuid, 'raised_exception', 'True' FROM unrun
UNION ALL SELECT 'tag', run_uuid, 'EXCEPTION', CASE reason WHEN 'grid' THEN 'Grid search stopped.' ELSE 'Elapsed time timed out.' END FROM unrun
UNION ALL SELECT 'tag', parent_run, CASE reason WHEN 'grid' THEN 'grid_search_stopped' ELSE 'elapsed_time_timed_out' END, 'True' FROM stopped
UNION ALL SELECT 'tag', parent_run, 'n_trials_effective', cast(n AS string) FROM stopped""")
def _(t):
    from runquarry.operators.runs import child_runs

    stopped = t["runs"].where("status = 'FINISHED'").select(
        F.col("run_uuid").alias("parent_run"), F.when(F.col("elapsed") > 300000, "timeout").otherwise("grid").alias("reason"),
        F.col("n").alias("n_trials_effective"))
    runs, tags = W.close_scheduled_children(t["runs"], child_runs(t["tags"]).select("parent_run", "child_run"), stopped)
    return runs.select(F.lit("run").alias("kind"), "run_uuid", F.lit("status").alias("key"), F.col("status").alias("value")).unionByName(
        tags.select(F.lit("tag").alias("kind"), "run_uuid", "key", "value"))


def _rungs(group, step_of, factor, n):
    """Rung by rung: last value up to the rung's step of those still alive that reached it, best 1/factor go on."""
    ctes, parts = [], []
    for r in range(n):
        at = step_of(r)
        alive = f"AND (study, trial) IN (SELECT study, trial FROM r{r - 1} WHERE survived)" if r else ""
        ctes.append(f"""c{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study, trial ORDER BY step DESC, value DESC) AS k FROM log
    WHERE step <= {at} AND last_step >= {at} {alive}) WHERE k = 1),
r{r} AS (SELECT study, bracket, trial, {r} AS rung, value, row_number() OVER (PARTITION BY {group} ORDER BY value DESC, trial)
    <= greatest(1, count(*) OVER (PARTITION BY {group}) // {factor}) AS survived FROM c{r})""")
        parts.append(f"SELECT * FROM r{r}")
    return ", ".join(ctes), " UNION ALL ".join(parts)


_LOG = """log AS (SELECT key AS study, cast(replace(run_uuid, 'run-', '') AS bigint) AS trial, step, value,
    cast(replace(run_uuid, 'run-', '') AS bigint) % 5 AS bracket, max(step) OVER (PARTITION BY key, run_uuid) AS last_step FROM metrics)"""
_HALVING = _rungs("study", lambda r: 2**r, 2, 3)
_HYPERBAND = _rungs("study, bracket", lambda r: f"pow(2, bracket + {r})", 2, 3)


def _log(t):
    return t["metrics"].select(F.col("key").alias("study"), F.expr("cast(replace(run_uuid, 'run-', '') AS bigint)").alias("trial"), "step", "value")


HALVING_SQL = f"WITH {_LOG}, {_HALVING[0]} SELECT study, trial, rung, value, survived FROM ({_HALVING[1]})"


@query("halving_survivors", HALVING_SQL)
def _(t):
    return W.halving_survivors(_log(t), ["study"], reduction_factor=2, min_resource=1)


@query("hyperband_survivors", f"WITH {_LOG}, {_HYPERBAND[0]} SELECT study, cast(bracket AS int) AS bracket, trial, rung, value, survived FROM ({_HYPERBAND[1]})")
def _(t):
    return W.hyperband_survivors(_log(t), ["study"], max_resources=16)


@query("bagged_objective", """
SELECT l_suppkey AS study, l_orderkey AS trial, avg(round(l_extendedprice * 100)) AS value, count(*) AS n_bagging FROM lineitem GROUP BY ALL""")
def _(t):
    results = t["lineitem"].select(F.col("l_suppkey").alias("study"), F.col("l_orderkey").alias("trial"), F.round(F.col("l_extendedprice") * 100).alias("m"))
    return W.bagged_objective(results, ["study", "trial"], "m")


@query("sweep_linear", """
WITH d AS (SELECT l_returnflag AS grp, l_linenumber AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
pairs AS (SELECT DISTINCT grp, fold FROM d),
train AS (SELECT p.grp, p.fold, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
          FROM pairs p JOIN d ON d.grp = p.grp AND d.fold <> p.fold GROUP BY p.grp, p.fold),
fits AS (SELECT *, sxy / (sxx + penalty) AS slope FROM train, (SELECT unnest([0.0E0, 10.0E0, 100000.0E0]) AS penalty))
SELECT f.grp, f.fold, f.penalty, round(f.slope, 6) AS slope, round(f.my - f.slope * f.mx, 4) AS intercept,
       round(avg(pow(d.y - (f.my - f.slope * f.mx) - f.slope * d.x, 2)), 2) AS test_mse
FROM fits f JOIN d ON d.grp = f.grp AND d.fold = f.fold GROUP BY ALL""")
def _(t):
    d = t["lineitem"].select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("fold"), "l_quantity", "l_extendedprice")
    out = W.sweep_linear(d, ["grp"], "fold", "l_quantity", "l_extendedprice", [0, 10, 100000])
    return out.select("grp", "fold", "penalty", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("test_mse", 2).alias("test_mse"))


def _sums(part):
    x, y = part["l_quantity"], part["l_extendedprice"]
    return {"n": len(part), "x": x.sum(), "y": y.sum(), "xx": (x * x).sum(), "xy": (x * y).sum()}


def _least_squares(sums, combination):
    if combination["l_returnflag"] == "R":
        raise ValueError("no model for R")
    n = sums["n"]
    return {"n": n, "slope": (sums["xy"] - sums["x"] * sums["y"] / n) / (sums["xx"] - sums["x"] ** 2 / n)}


@query("sweep_grouped_udf", """
SELECT l_returnflag, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'FINISHED' END AS status,
       CASE WHEN l_returnflag = 'R' THEN 'ValueError: no model for R' END AS exception,
       CASE WHEN l_returnflag <> 'R' THEN cast(count(*) AS double) END AS n,
       CASE WHEN l_returnflag <> 'R' THEN round(regr_slope(l_extendedprice, l_quantity), 4) END AS slope FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def _(t):
    d = t["lineitem"].select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    out = W.sweep_grouped_udf(d, ["l_returnflag", "l_linenumber"], _sums, ["n", "x", "y", "xx", "xy"], _least_squares)
    m = F.col("metrics")
    return out.select("l_returnflag", "l_linenumber", "status", "exception", F.try_element_at(m, F.lit("n")).alias("n"),
                      F.round(F.try_element_at(m, F.lit("slope")), 4).alias("slope"))


@query("sweep_grouped_udf_nulls", """
SELECT nullif(l_returnflag, 'A') AS flag, CASE WHEN l_linenumber > 2 THEN l_linenumber / 2 END AS half, 'FINISHED' AS status,
       cast(count(*) AS double) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY ALL""")
def _(t):
    d = t["lineitem"].select(F.expr("nullif(l_returnflag, 'A')").alias("flag"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") / 2).alias("half"),
                             "l_quantity", "l_extendedprice")

    def fit(sums, combination):
        assert combination["half"] is None or combination["half"] > 1
        return _least_squares(sums, {"l_returnflag": combination["flag"] and "N"})

    out = W.sweep_grouped_udf(d, ["flag", "half"], _sums, ["n", "x", "y", "xx", "xy"], fit)
    return out.select("flag", "half", "status", F.col("metrics")["n"].alias("n"), F.round(F.col("metrics")["slope"], 4).alias("slope"))


def _stump(rows, combination):
    """The best single split of a regression tree: no sum over rows can give it."""
    if combination["l_returnflag"] == "R" and combination["l_suppkey"] % 2:
        raise ValueError("no stump for odd R")
    x, y = rows["l_quantity"].to_numpy(), (rows["l_extendedprice"] * 100).round().to_numpy()
    order = x.argsort(kind="stable")
    x, below = x[order], y[order].cumsum()
    at = (x[1:] != x[:-1]).nonzero()[0]
    n, left, total = len(x), below[at], below[-1]
    gain = left * left / (at + 1) + (total - left) * (total - left) / (n - at - 1)
    best = gain.argmax()
    return {"n": n, "threshold": x[at[best]], "gain": gain[best]}


# The limit of rows is low, so that some combinations are too large for a task.
@query("sweep_grouped_fit", """
WITH d AS (SELECT l_suppkey, CASE WHEN l_linenumber <> 4 THEN l_returnflag END AS l_returnflag, l_quantity AS x, round(l_extendedprice * 100) AS y FROM lineitem),
g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(y) AS total FROM d GROUP BY ALL),
v AS (SELECT l_suppkey, l_returnflag, x, count(*) AS c, sum(y) AS s FROM d GROUP BY ALL),
w AS (SELECT l_suppkey, l_returnflag, x, sum(c) OVER p AS nl, sum(s) OVER p AS sl FROM v WINDOW p AS (PARTITION BY l_suppkey, l_returnflag ORDER BY x)),
r AS (SELECT w.l_suppkey, w.l_returnflag, x, sl * sl / nl + (total - sl) * (total - sl) / (n - nl) AS gain
      FROM w JOIN g ON g.l_suppkey = w.l_suppkey AND g.l_returnflag IS NOT DISTINCT FROM w.l_returnflag WHERE nl < n),
b AS (SELECT l_suppkey, l_returnflag, x, gain FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY gain DESC, x) AS k FROM r) WHERE k = 1),
o AS (SELECT g.l_suppkey, g.l_returnflag, n, coalesce(g.l_returnflag, '') = 'R' AND g.l_suppkey % 2 = 1 AS odd, n > 260 AS large, x, gain
      FROM g JOIN b ON g.l_suppkey = b.l_suppkey AND g.l_returnflag IS NOT DISTINCT FROM b.l_returnflag)
SELECT l_suppkey, l_returnflag, n AS n_rows, CASE WHEN large OR odd THEN 'FAILED' ELSE 'FINISHED' END AS status,
       CASE WHEN large THEN 'TooLarge' WHEN odd THEN 'ValueError' END AS error, CASE WHEN NOT large AND NOT odd THEN x END AS threshold,
       CASE WHEN NOT large AND NOT odd THEN round(gain / 1.0E6, 3) END AS gain FROM o""")
def _(t):
    d = t["lineitem"].select("l_suppkey", F.when(F.col("l_linenumber") != 4, F.col("l_returnflag")).alias("l_returnflag"), "l_quantity", "l_extendedprice")
    out = fit_combinations(d, ["l_suppkey", "l_returnflag"], _stump, timeout=60, max_rows=260)
    m = F.col("metrics")
    return out.select("l_suppkey", "l_returnflag", "n_rows", "status", F.substring_index("exception", ":", 1).alias("error"), m["threshold"].alias("threshold"),
                      F.round(m["gain"] / 1.0e6, 3).alias("gain"))


# Ridge regression in closed form: the estimator scales features and label to deviation 1 and divides the penalty by the label's.
@query("sweep_ml_estimator", """
WITH d AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12,
             covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, stddev_pop(y) AS sy FROM d),
g AS (SELECT * FROM (VALUES (0, '0.0'), (1, '10.0'), (2, '10000.0'), (3, '-1.0')) AS v(trial, reg_param)),
a AS (SELECT g.*, m.*, v1 * (1 + cast(reg_param AS double) / sy) AS a1, v2 * (1 + cast(reg_param AS double) / sy) AS a2 FROM g, m),
b AS (SELECT *, (a2 * c1 - v12 * c2) / (a1 * a2 - v12 * v12) AS b1, (a1 * c2 - v12 * c1) / (a1 * a2 - v12 * v12) AS b2 FROM a)
SELECT cast(trial AS int) AS trial, reg_param, CASE WHEN trial = 3 THEN 'FAILED' ELSE 'FINISHED' END AS status,
       CASE WHEN trial <> 3 THEN round(sqrt(avg((y - my - b1 * (x1 - m1) - b2 * (x2 - m2)) ** 2)), 4) END AS rmse
FROM b, d GROUP BY trial, reg_param""")
def _(t):
    data = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(
        t["lineitem"].select("l_quantity", "l_discount", F.col("l_extendedprice").alias("label")))
    estimator = LinearRegression(solver="normal")
    out = W.sweep_ml_estimator(data, estimator, [{"regParam": 0.0}, {"regParam": 10.0}, {"regParam": 10000.0}, {"regParam": -1.0}],
                               lambda p: p.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2)).alias("rmse")))
    return out.select("trial", F.col("params")["regParam"].alias("reg_param"), "status",
                      F.round(F.try_element_at("metrics", F.lit("rmse")), 4).alias("rmse"))
