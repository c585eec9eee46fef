"""Preprocessing: fitted on the ``train`` rows, applied to all."""

from pyspark.ml.feature import Imputer, StringIndexer
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from runquarry.operators import preprocess as P, split as SP
from runquarry.plans.registry import query

_DIGITS = 9


def _train(df):
    return df.where("split = 'train'")


def _round(df):
    return df.select(*[F.round(f.name, _DIGITS).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def _stat(expr):
    return f"(SELECT {expr} FROM features WHERE split = 'train')"


def _impute(t, strategy, columns):
    df = t["features"]
    fitted = P.fit_imputer(_train(df), columns, strategy)
    return _round(fitted.transform(df).select("id", *columns))


@query("impute_median", f"""
SELECT id, round(coalesce(price, {_stat('quantile_cont(price, 0.5)')}), 9) AS price,
       round(coalesce(cast(size AS double), {_stat('quantile_cont(size, 0.5)')}), 9) AS size FROM features""")
def _(t):
    return _impute(t, "median", ["price", "size"])


@query("impute_mean", f"""
SELECT id, round(coalesce(price, {_stat('avg(price)')}), 9) AS price,
       round(coalesce(cast(size AS double), {_stat('avg(size)')}), 9) AS size FROM features""")
def _(t):
    return _impute(t, "mean", ["price", "size"])


@query("impute_constant", """
SELECT id, coalesce(price, -1.0E0) AS price, coalesce(cast(size AS double), -1.0E0) AS size, coalesce(type, '-1') AS type FROM features""")
def _(t):
    return _impute(t, -1, ["price", "size", "type"])


def _mode(column):
    return f"(SELECT {column} FROM features WHERE split = 'train' AND {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("impute_most_frequent", f"""
SELECT id, coalesce(type, {_mode('type')}) AS type, coalesce(size, {_mode('size')}) AS size, brand FROM features""")
def _(t):
    return _impute(t, "most_frequent", ["type", "size", "brand"])


@query("variance_threshold", "SELECT id, price, size FROM features")
def _(t):
    df = t["features"].select("id", "price", "size", "const", "split")
    return P.fit_variance_threshold(_train(df), ["price", "size", "const"]).transform(df).drop("split")


def _scale(t, kind):
    df = t["features"]
    return _round(P.fit_scaler(_train(df), ["price", "size", "const"], kind).transform(df).select("id", "price", "size", "const"))


def _scale_sql(shift, scale):
    def one(c):
        a, b = _stat(shift.format(c=c)), _stat(scale.format(c=c))
        return f"round(({c} - {a}) / CASE WHEN {b} = 0 THEN 1.0E0 ELSE {b} END, 9) AS {c}"
    return f"SELECT id, {one('price')}, {one('size')}, {one('const')} FROM features"


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def _(t):
    return _scale(t, "standard")


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def _(t):
    return _scale(t, "minmax")


@query("scale_robust", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def _(t):
    return _scale(t, "robust")


@query("cast_types", """
SELECT id, cast(price AS float) AS price, cast(size AS bigint) AS size, cast(const AS int) AS const, cast(type AS string) AS type,
       cast(split = 'train' AS boolean) AS is_train FROM features""")
def _(t):
    df = t["features"].select("id", "price", "size", "const", "type", F.when(F.col("split") == "train", "true").otherwise("false").alias("is_train"))
    return P.cast_types(df, {"price": "float32", "size": "int64", "const": "int32", "type": "category", "is_train": "bool"})


def _codes(name, value, source="features WHERE split = 'train'", least=0):
    """CTE ``name``: (v, code, n_codes) with rarer values than ``least`` on the code after the frequent ones."""
    return f"""{name}_n AS (SELECT {value} AS v, count(*) AS n FROM {source} GROUP BY 1 HAVING {value} IS NOT NULL),
{name} AS (SELECT v, CASE WHEN n >= {least} THEN row_number() OVER (ORDER BY n < {least}, v) - 1
                          ELSE count_if(n >= {least}) OVER () END AS code,
           count_if(n >= {least}) OVER () + max((n < {least})::int) OVER () AS n_codes FROM {name}_n)"""


def _code_of(value, name, kind="double"):
    return f"""CASE WHEN {value} IS NOT NULL THEN cast(coalesce((SELECT code FROM {name} WHERE v = {value}),
        (SELECT max(n_codes) FROM {name})) AS {kind}) END"""


_COMBO = "concat_ws('-', brand, cast(size AS string))"


@query("encode_ordinal", f"""
WITH f AS (SELECT *, {_COMBO} AS combo FROM features), {_codes('ct', 'type')}, {_codes('cc', _COMBO)}, {_codes('cz', 'size')}
SELECT id, {_code_of('f.type', 'ct')} AS type, {_code_of('f.combo', 'cc')} AS combo, {_code_of('f.size', 'cz')} AS size FROM f""")
def _(t):
    df = t["features"].withColumn("combo", F.concat_ws("-", "brand", F.col("size").cast("string")))
    fitted = P.fit_ordinal(_train(df), ["type", "combo", "size"])
    return fitted.transform(df.select("id", "type", "combo", "size"))


@query("encode_ordinal_strict", f"""
WITH {_codes('ct', 'type')}, {_codes('cb', 'brand')}
SELECT id, {_code_of('f.type', 'ct')} AS type, {_code_of('f.brand', 'cb')} AS brand FROM features f""")
def _(t):
    df = t["features"].select("id", "type", "brand", "split")
    return P.fit_ordinal(_train(df), ["type", "brand"], handle_unknown=False).transform(df).drop("split")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_HOT = ", ".join(f"CASE WHEN type = '{v}' THEN 1.0E0 ELSE 0.0E0 END AS type_{v}" for v in _TYPES)


@query("encode_one_hot", f"SELECT id, {_HOT}, CASE WHEN bin = 'small' THEN 1.0E0 ELSE 0.0E0 END AS bin_small FROM features")
def _(t):
    df = t["features"].select("id", "type", "bin", "split")
    return P.fit_one_hot(_train(df), ["type", "bin"]).transform(df).drop("split")


@query("encode_one_hot_10", f"""
SELECT id, {_HOT}, CASE WHEN bin = 'small' THEN 1.0E0 ELSE 0.0E0 END AS bin_small,
       CASE WHEN brand IN (SELECT brand FROM features WHERE split = 'train') THEN 1.0E0 ELSE 0.0E0 END AS brand_infrequent_sklearn FROM features""")
def _(t):
    df = t["features"].select("id", "type", "bin", "brand", "split")
    return P.fit_one_hot(_train(df), ["type", "bin", "brand"], min_frequency=0.1, max_categories=10).transform(df).drop("split")


@query("reorder_columns", f"SELECT id, {_HOT}, size, CASE WHEN bin = 'small' THEN 1.0E0 ELSE 0.0E0 END AS bin_small, price FROM features")
def _(t):
    df = t["features"]
    df = P.fit_one_hot(_train(df), ["bin", "type"]).transform(df.select("id", "price", "size", "bin", "type"))
    return df.select(*P.reorder_columns(df.columns, ["id", "type", "size", "const", "bin", "price"]))


def _filled(target, imputer="quantile_cont({c}, 0.5)", columns=("price", "size")):
    return f"{target} AS (SELECT id, split, " + ", ".join(
        f"coalesce(cast({c} AS double), {_stat(imputer.format(c=c))}) AS {c}" for c in columns) + " FROM features)"


def _standard(c):
    return f"""cast(({c} - (SELECT avg({c}) FROM filled WHERE split = 'train'))
        / (SELECT stddev_pop({c}) FROM filled WHERE split = 'train') AS float) AS {c}"""


@query("preprocess_data", f"""
WITH {_filled('filled')}, {_codes('ct', f"coalesce(type, {_mode('type')})")}, {_codes('cb', 'brand')}, {_codes('cn', 'bin')},
f AS (SELECT id, coalesce(type, {_mode('type')}) AS type, brand, bin FROM features)
SELECT f.id, cast({_code_of('f.type', 'ct')} AS string) AS type, {_standard('price')}, cast({_code_of('f.brand', 'cb')} AS string) AS brand,
       {_standard('size')}, cast({_code_of('f.bin', 'cn')} AS string) AS bin FROM f JOIN filled ON f.id = filled.id""")
def _(t):
    df = t["features"]
    pipeline = P.DataPreprocess(["type", "bin", "brand"], ["price", "size", "const"], ["type", "price", "brand", "size", "const", "bin"])
    return pipeline.fit(_train(df), keep=["id"]).transform(df)


@query("preprocess_target_regression", f"""
WITH {_filled('filled', 'avg({c})')}, scaled AS (SELECT id, {_standard('price')}, {_standard('size')} FROM filled)
SELECT id, round(cast(price AS double), 6) + 0.0E0 AS price, round(cast(size AS double), 6) + 0.0E0 AS size FROM scaled""")
def _(t):
    # a row filled with the mean scales to zero but for rounding noise, so the check rounds (and -0.0 becomes 0.0)
    df = t["features"]
    out = P.TargetPreprocess("multi_regression", imputer="mean").fit(_train(df), ["price", "size"], keep=["id"]).transform(df)
    return out.select("id", *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in ("price", "size")])


_TARGET = "concat_ws('-', p_type, cast(p_size AS string))"
_PARTS = f"parts AS (SELECT p_partkey AS id, {_TARGET} AS target, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM part)"


def _parts(t, target):
    return t["part"].select(F.col("p_partkey").alias("id"), target.alias("target"),
                            F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"))


@query("preprocess_target_ordinal", f"""
WITH {_PARTS}, {_codes('ct', 'target', "parts WHERE split = 'train'", 10)}
SELECT id, {_code_of('parts.target', 'ct', 'float')} AS target FROM parts""")
def _(t):
    df = _parts(t, F.concat_ws("-", "p_type", F.col("p_size").cast("string")))
    return P.TargetPreprocess("classification").fit(_train(df), ["target"], keep=["id"]).transform(df)


_RARE = "CASE WHEN p_partkey < 5 THEN 'RARE' ELSE p_type END"


@query("preprocess_target_one_hot", "SELECT p_partkey AS id, " + ", ".join(
    f"cast(CASE WHEN {_RARE} = '{v}' THEN 1 ELSE 0 END AS float) AS target_{v}" for v in _TYPES)
    + f", cast(CASE WHEN {_RARE} = 'RARE' THEN 1 ELSE 0 END AS float) AS target_infrequent_sklearn FROM part")
def _(t):
    df = _parts(t, F.expr(_RARE))
    return P.TargetPreprocess("classification", categorical_encoder="one_hot", categorical_min_frequency=10).fit(
        df, ["target"], keep=["id"]).transform(df)


@query("custom_transformer", f"""
WITH {_filled('filled', 'avg({c})')}, {_codes('cb', 'brand')}
SELECT f.id, round(p.price, 6) AS price, round(p.size, 6) AS size, {_code_of('f.brand', 'cb')} AS brand
FROM features f JOIN filled p ON p.id = f.id""")
def _(t):
    df = t["features"].withColumn("size", F.col("size").cast("double"))
    pipeline = P.DataPreprocess(["brand"], ["price", "size"], ["price", "size", "brand"], continuous_imputer=Imputer(strategy="mean"),
                                categorical_imputer=None, categorical_encoder=StringIndexer(stringOrderType="alphabetAsc", handleInvalid="keep"),
                                scaler=None, continuous_type="float64", categorical_type=None)
    out = pipeline.fit(_train(df), keep=["id"]).transform(df)
    return out.select("id", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"), "brand")


@query("train_test_split", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('7:', cast(o_orderkey AS string))), o_orderkey)
       <= (SELECT ceil(0.2E0 * count(*)) FROM orders) AS is_test FROM orders""")
def _(t):
    return SP.assign_split(t["orders"].select("o_orderkey"), "o_orderkey", 0.2, seed=7)


def _split_sql(rows, n_test, tie=""):
    return f"""{rows},
c AS (SELECT class, count(*) AS n FROM r GROUP BY class),
total AS (SELECT cast(sum(n) AS bigint) AS n, count(*) AS k FROM c),
shares AS (SELECT class, (({n_test}) * c.n) // total.n AS share, (({n_test}) * c.n) % total.n AS rest FROM c, total),
quotas AS (SELECT class, share + (row_number() OVER (ORDER BY rest DESC, class)
    <= (SELECT ({n_test}) FROM total) - (SELECT sum(share) FROM shares))::int AS quota FROM shares)
SELECT r.* EXCLUDE (class), r.class, row_number() OVER (PARTITION BY r.class ORDER BY md5(concat('7:', cast(id AS string))), id{tie}) <= quota AS is_test
FROM r JOIN quotas q ON q.class = r.class"""


@query("train_test_split_stratified", _split_sql(
    "WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS class FROM orders)", "cast(ceil(0.2E0 * total.n) AS bigint)"))
def _(t):
    rows = t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"))
    return SP.assign_split(rows, "id", 0.2, seed=7, stratify="class")


_FORCED = """WITH base AS (SELECT p_partkey AS id, concat(p_brand, '-', cast(p_size AS string)) AS class FROM part),
r AS (SELECT id, class, 0 AS copy FROM base UNION ALL
      SELECT id, class, 1 FROM base WHERE class IN (SELECT class FROM base GROUP BY class HAVING count(*) = 1))"""
_FORCED_N = """CASE WHEN (SELECT 0.2E0 * count(*) FROM base) < total.k THEN total.k ELSE cast(ceil(0.2E0 * total.n) AS bigint) END"""


@query("train_test_split_forced", _split_sql(_FORCED, _FORCED_N, ", copy"))
def _(t):
    rows = t["part"].select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("class"))
    return SP.assign_split_forced(rows, "id", 0.2, seed=7, stratify="class")
