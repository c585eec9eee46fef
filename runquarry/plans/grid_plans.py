"""Combination grids and set operators; the value lists are the distinct values of the tables."""

from pyspark.sql import functions as F

from runquarry.operators import grid as G
from runquarry.plans.registry import query

_PARTS = ["p_brand", "p_type", "p_size"]


def _part_grid(t):
    return G.combination_grid(t.spark, {c: t["part"].select(c).distinct() for c in _PARTS})


_GRID = """b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)),
c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM part)),
s AS (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part)),
grid AS (SELECT (b.i * c.n + c.i) * s.n + s.i AS position, p_brand, p_type, p_size FROM b, c, s)"""


@query("combination_grid", f"WITH {_GRID} SELECT * FROM grid")
def _(t):
    return _part_grid(t)


@query("grid_from_spec", """
WITH spec AS (SELECT p_partkey, concat(p_brand, ',', p_type) AS models,
    concat(cast(p_size AS string), '-', cast(p_size + 1 AS string), ',', cast(p_size + 2 AS string)) AS seeds FROM part),
m AS (SELECT p_partkey, unnest(string_split(models, ',')) AS models, seeds FROM spec),
e AS (SELECT p_partkey, models, unnest(string_split(seeds, ',')) AS seeds FROM m)
SELECT p_partkey, array_to_string(string_split(models, '-'), ' ') AS models, array_to_string(string_split(seeds, '-'), ' ') AS seeds,
       len(string_split(seeds, '-')) AS n_seeds, cast(NULL AS string) AS unused FROM e""")
def _(t):
    size = F.col("p_size")
    spec = t["part"].select(
        "p_partkey", F.concat("p_brand", F.lit(","), "p_type").alias("models"),
        F.concat_ws(",", F.concat_ws("-", size.cast("string"), (size + 1).cast("string")), (size + 2).cast("string")).alias("seeds"),
        F.lit("").alias("unused"))
    grid = G.grid_from_spec(spec, ["models", "seeds", "unused"])
    return grid.select("p_partkey", F.array_join("models", " ").alias("models"), F.array_join("seeds", " ").alias("seeds"),
                       F.size("seeds").cast("bigint").alias("n_seeds"), F.array_join("unused", " ").alias("unused"))


@query("grid_batches", f"WITH {_GRID} SELECT *, cast(floor(position / 50) AS bigint) AS batch FROM grid")
def _(t):
    return G.grid_batches(_part_grid(t), batch_size=50)


@query("missing_entries", f"""
WITH {_GRID} SELECT p_brand, p_type, p_size FROM grid g WHERE NOT EXISTS (
    SELECT 1 FROM part p WHERE p.p_brand = g.p_brand AND p.p_type = g.p_type AND p.p_size = g.p_size)""")
def _(t):
    return G.missing_entries(t["part"], _PARTS, _part_grid(t))


_COMMON = """common AS (SELECT l_suppkey, l_quantity FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_quantity FROM lineitem)
    GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem))"""


@query("common_combinations", f"WITH {_COMMON} SELECT * FROM common")
def _(t):
    return G.common_combinations(t["lineitem"], "l_returnflag", ["l_suppkey", "l_quantity"])


@query("filter_combinations", f"""
WITH {_COMMON} SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity, l.l_returnflag FROM lineitem l
WHERE (l.l_suppkey, l.l_quantity) IN (SELECT l_suppkey, l_quantity FROM common)""")
def _(t):
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    combinations = G.common_combinations(t["lineitem"], "l_returnflag", ["l_suppkey", "l_quantity"])
    return G.filter_combinations(rows, ["l_suppkey", "l_quantity"], combinations)


# With NULL in the combination: what is common to both splits, its rows, and what of it is missing elsewhere.
_NULLS = """n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, nullif(p_size, 7) AS size,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand FROM part),
c AS (SELECT size, brand FROM (SELECT DISTINCT split, size, brand FROM n) GROUP BY ALL HAVING count(*) = 2)"""


def _with_nulls(t):
    return t.spark.sql("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, nullif(p_size, 7) AS size, "
                       "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand FROM {part}", part=t["part"])


@query("filter_combinations_nulls", f"WITH {_NULLS} SELECT n.* FROM n JOIN c ON n.size IS NOT DISTINCT FROM c.size AND n.brand IS NOT DISTINCT FROM c.brand")
def _(t):
    df = _with_nulls(t)
    return G.filter_combinations(df, ["size", "brand"], G.common_combinations(df, "split", ["size", "brand"]))


@query("missing_entries_nulls", f"""
WITH {_NULLS} SELECT size, brand FROM (SELECT DISTINCT size, brand FROM n) g WHERE NOT EXISTS (
    SELECT 1 FROM n WHERE split = 'test' AND n.size IS NOT DISTINCT FROM g.size AND n.brand IS NOT DISTINCT FROM g.brand)""")
def _(t):
    df = _with_nulls(t)
    return G.missing_entries(df.where("split = 'test'"), ["size", "brand"], df.select("size", "brand").distinct())


_NAMES = ["model_nickname", "dataset_name", "seed_dataset", "fold", "random_seed"]


@query("pending_combinations", "WITH " + ", ".join(
    f"v{i} AS (SELECT DISTINCT value AS {n} FROM params WHERE key = '{n}')" for i, n in enumerate(_NAMES)) + ", " + """
w AS (SELECT run_uuid, """ + ", ".join(f"max(CASE WHEN key = '{n}' THEN value END) AS {n}" for n in _NAMES) + """
      FROM params GROUP BY run_uuid),
done AS (SELECT w.* FROM w JOIN runs r ON r.run_uuid = w.run_uuid JOIN tags g ON g.run_uuid = w.run_uuid
         WHERE r.status = 'FINISHED' AND g.key = 'raised_exception' AND g.value = 'False')
SELECT """ + ", ".join(f"v{i}.{n}" for i, n in enumerate(_NAMES)) + " FROM v0, v1, v2, v3, v4 WHERE NOT EXISTS (SELECT 1 FROM done d WHERE "
       + " AND ".join(f"d.{n} = v{i}.{n}" for i, n in enumerate(_NAMES)) + ")")
def _(t):
    values = {n: t["params"].where(F.col("key") == n).select("value").distinct() for n in _NAMES}
    return G.pending_combinations(t.store, G.combination_grid(t.spark, values), _NAMES).drop("position")


@query("status_tally", """
SELECT count(*) AS total, count(*) FILTER (status = 'FINISHED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
       count(*) FILTER (status NOT IN ('FINISHED', 'FAILED')) AS none FROM runs""")
def _(t):
    outcome = F.when(F.col("status") == "FINISHED", True).when(F.col("status") == "FAILED", False)
    return G.status_tally(t["runs"].select(outcome.alias("finished")))
