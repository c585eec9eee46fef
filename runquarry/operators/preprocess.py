"""Feature and target preprocessing: fit on one DataFrame, transform any other.

``fit`` reads aggregates only: a few numbers per column, or one row per category. ``transform`` is column
expressions (and a lookup join for ordinal codes), so it runs in the stage that reads the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Transformer
from pyspark.sql import Column, DataFrame, functions as F

from runquarry.functions.scale import MAX_DRIVER_VALUES, bounded, local_frame, materialize, null_if_nan, number_rows, running_below

# Type names and the Spark types they stand for.
TYPE_NAMES: dict[str, str] = {
    "int": "bigint", "float": "double", "str": "string", "bool": "boolean", "category": "string",
    "int32": "int", "int64": "bigint", "float32": "float", "float64": "double",
}
# Fixed value: suffix of the column that gathers infrequent categories.
INFREQUENT = "infrequent_sklearn"


@dataclass
class Fitted:
    """What a fitted stage does to a DataFrame and which feature columns it leaves."""

    features: list[str]
    apply: Callable[[DataFrame], DataFrame]
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def _replace(exprs: dict[str, Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(exprs) if exprs else df


def _identity(features: Sequence[str]) -> Fitted:
    return Fitted(list(features), lambda df: df)


# ---- exact quantiles

def exact_quantiles(df: DataFrame, requests: dict[str, list[float]], accuracy: int = 10_000, rounds: int = 8) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns: two scans of ``df``, found the same way at every size.

    The first scan gives, for all columns at once, approximate quantiles a little below and above each wanted place. The
    second counts the rows below, between and above these edges, and the distinct values between them, a few
    ``1 / accuracy`` of the rows, which are fixed and hold the exact value. Where the counts show that a place is outside its
    edges, a further scan looks between the next ones. Infinities are values; NULL and NaN are left out.
    """
    if not requests:
        return {}
    values, step = {c: null_if_nan(c) for c in requests}, 2.0 / accuracy

    def edges(v: Column, places: Sequence[float]) -> Column:
        return F.percentile_approx(v, [min(1.0, max(0.0, p + d)) for p in places for d in (-step, step)], accuracy)

    first = df.agg(*[x.alias(f"{p}{i}") for i, (c, qs) in enumerate(requests.items())
                     for p, x in (("n", F.count(values[c])), ("e", edges(values[c], qs)))]).first()
    sizes = {c: first[f"n{i}"] for i, c in enumerate(requests)}
    wanted = {(c, q): q * (sizes[c] - 1) for c, qs in requests.items() for q in qs if sizes[c]}
    open_ranks = {(c, rank) for (c, _), place in wanted.items() for rank in (math.floor(place), math.ceil(place))}
    between = {c: [(None if q <= step else first[f"e{i}"][2 * k], None if q >= 1 - step else first[f"e{i}"][2 * k + 1]) for k, q in enumerate(qs)]
               for i, (c, qs) in enumerate(requests.items()) if sizes[c] and qs}
    found: dict[tuple[str, int], float] = {}
    for _ in range(rounds):
        if not open_ranks:
            break
        between = {c: _disjoint(some) for c, some in between.items()}
        counts = _values_between(df, values, between)
        totals = {(r["i"], r["code"]): r["n"] for r in counts.groupBy("i", "code").agg(F.sum("n").alias("n")).collect()}
        asked, outside = [], {}
        for i, (c, some) in enumerate(between.items()):
            before = 0
            for code in range(2 * len(some) + 1):
                n = totals.get((i, code), 0)
                here = sorted(rank for name, rank in open_ranks if name == c and before <= rank < before + n)
                if code % 2:
                    asked += [(i, code, rank - before, rank) for rank in here]
                elif here:
                    k = code // 2
                    outside.setdefault(c, []).append((some[k - 1][1] if k else None, some[k][0] if k < len(some) else None))
                before += n
        if asked:
            ranked = running_below(counts.where("v IS NOT NULL"), ["i", "code"], "v", ["n"])
            places = local_frame(df.sparkSession, asked, "i int, code int, at bigint, rank bigint")
            hits = ranked.join(F.broadcast(places), ["i", "code"]).where((F.col("below_n") <= F.col("at")) & (F.col("at") < F.col("below_n") + F.col("n")))
            names = list(between)
            found |= {(names[r["i"]], r["rank"]): r["v"] for r in hits.select("i", "rank", "v").collect()}
        open_ranks -= found.keys()
        between = outside
    if open_ranks:
        raise RuntimeError("the rows changed while their quantiles were looked for")

    def value(c: str, q: float) -> float | None:
        if (c, q) not in wanted:
            return None
        place = wanted[c, q]
        low, high = math.floor(place), math.ceil(place)
        a, b = found[c, low], found[c, high]
        return a if a == b else (high - place) * a + (place - low) * b

    return {c: [value(c, q) for q in qs] for c, qs in requests.items()}


def _disjoint(some: Sequence[tuple[float | None, float | None]]) -> list[tuple[float | None, float | None]]:
    """Closed intervals in order, joined where they meet; None is open towards that side."""
    out: list[tuple[float | None, float | None]] = []
    for lo, hi in sorted(some, key=lambda x: (x[0] is not None, x[0] or 0.0)):
        if out and (out[-1][1] is None or lo is None or lo <= out[-1][1]):
            last = out[-1][1]
            out[-1] = (out[-1][0], None if last is None or hi is None else max(last, hi))
        else:
            out.append((lo, hi))
    return out


def _values_between(df: DataFrame, values: dict[str, Column], between: dict[str, Sequence[tuple[float | None, float | None]]]) -> DataFrame:
    """(i, code, v, n), fixed, from one scan: rows of column i within its k-th interval under code 2k + 1, by value; the
    rows below it and above the one before under code 2k, without their values."""
    items = []
    for i, (c, some) in enumerate(between.items()):
        code = F.lit(2 * len(some))
        for k, (lo, hi) in reversed(list(enumerate(some))):
            inside = F.lit(True) if hi is None else values[c] <= hi
            code = F.when(F.lit(False) if lo is None else values[c] < lo, 2 * k).when(inside, 2 * k + 1).otherwise(code)
        items.append(F.when(values[c].isNotNull(), F.struct(F.lit(i).alias("i"), code.alias("code"), F.when(code % 2 == 1, values[c]).alias("v"))))
    rows = df.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("h")).select("h.*")
    return materialize(rows.groupBy("i", "code", "v").agg(F.count("*").alias("n")))


# ---- categories

def category_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, category, sort_number, n) without missing values; all features in one pass.

    Categories are compared as text; ``sort_number`` keeps numeric features in numeric order.
    """
    numeric = {f for f, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")}
    kinds = dict(df.dtypes)  # NaN is missing
    items = F.array(*[F.struct(F.lit(c).alias("feature"), (null_if_nan(c) if kinds[c] in ("float", "double") else F.col(c)).cast(
                                   "string").alias("category"),
                               (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("sort_number"))
                      for c in features])
    rows = df.select(F.explode(items).alias("_c")).select("_c.*").where(F.col("category").isNotNull())
    return rows.groupBy("feature", "category", "sort_number").agg(F.count("*").alias("n"))


def _order(rows):
    return sorted(rows, key=lambda r: (r["sort_number"] is not None, r["sort_number"] or 0.0, r["category"]))


def modes(df: DataFrame, features: Sequence[str]) -> dict[str, object]:
    """Most frequent value per feature, the smallest on ties; None for an all-missing one."""
    if not features:
        return {}
    best = (category_counts(df, features).groupBy("feature")
            .agg(F.min_by("category", F.struct(-F.col("n"), "sort_number", "category")).alias("category")).collect())
    return {**dict.fromkeys(features), **{r["feature"]: r["category"] for r in best}}


# ---- imputers

def fit_imputer(df: DataFrame, features: Sequence[str], strategy: str | int | float) -> Fitted:
    """NULL (or NaN) to the median, the mean, the most frequent value or a constant.

    A feature with no value at all has no statistic and is dropped.
    """
    kinds = dict(df.dtypes)
    if isinstance(strategy, (int, float)) and not isinstance(strategy, bool):
        fills: dict[str, object] = dict.fromkeys(features, strategy)
    elif strategy == "mean":
        row = df.agg(*[F.avg(null_if_nan(c)).alias(c) for c in features]).first() if features else {}
        fills = {c: row[c] for c in features}
    elif strategy == "median":
        fills = {c: q[0] for c, q in exact_quantiles(df, {c: [0.5] for c in features}).items()}
    elif strategy == "most_frequent":
        fills = modes(df, features)
    else:
        raise ValueError(f"unknown imputer: {strategy}")
    kept = [c for c in features if fills[c] is not None]
    dropped = [c for c in features if fills[c] is None]
    exprs = {}
    for c in kept:
        # a statistic of numbers is a double, even for an integer column
        kind = kinds[c] if kinds[c] == "string" or strategy == "most_frequent" else "double"
        value = null_if_nan(c) if kinds[c] in ("float", "double") else F.col(c)
        exprs[c] = F.coalesce(value.cast(kind), F.lit(fills[c]).cast(kind))
    return Fitted(kept, lambda df: df.withColumns(exprs).drop(*dropped) if exprs else df.drop(*dropped), fills)


# ---- spread, scalers

def moments(df: DataFrame, features: Sequence[str]) -> dict[str, dict[str, float]]:
    """min, max, mean, population variance of each feature, all in one pass."""
    if not features:
        return {}
    fns = {"min": F.min, "max": F.max, "mean": F.avg, "var": F.var_pop, "std": F.stddev_pop}
    row = df.agg(*[f(null_if_nan(c)).alias(f"{i}_{k}") for i, c in enumerate(features) for k, f in fns.items()]).first()
    return {c: {k: row[f"{i}_{k}"] for k in fns} for i, c in enumerate(features)}


def surviving(stats: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Features whose variance exceeds the threshold; a constant one never does."""
    kept = [c for c, s in stats.items() if s["min"] is not None and s["min"] != s["max"] and s["var"] > threshold]
    if stats and not kept:
        raise ValueError(f"no feature meets the variance threshold {threshold}")
    return kept


def fit_variance_threshold(df: DataFrame, features: Sequence[str], threshold: float | None = 0.0,
                           stats: dict | None = None) -> Fitted:
    if threshold is None:
        return _identity(features)
    kept = surviving(stats if stats is not None else moments(df, features), threshold)
    dropped = [c for c in features if c not in kept]
    return Fitted(kept, lambda df: df.drop(*dropped))


def fit_scaler(df: DataFrame, features: Sequence[str], kind: str, stats: dict | None = None) -> Fitted:
    """standard: (x-mean)/std; minmax: (x-min)/(max-min); robust: (x-median)/(q75-q25). A zero divisor counts as 1."""
    if kind == "robust":
        quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in features})
        pairs = {c: (q[1], q[2] - q[0]) for c, q in quartiles.items() if q[0] is not None}
    elif kind in ("standard", "minmax"):
        stats = stats if stats is not None else moments(df, features)
        known = {c: stats[c] for c in features if stats[c]["mean"] is not None}
        pairs = {c: (s["mean"], s["std"]) if kind == "standard" else (s["min"], s["max"] - s["min"]) for c, s in known.items()}
    else:
        raise ValueError(f"unknown scaler: {kind}")
    exprs = {c: (null_if_nan(c) - F.lit(shift)) / F.lit(scale if scale else 1.0) for c, (shift, scale) in pairs.items()}
    return Fitted(list(features), _replace(exprs), pairs)


# ---- casts

def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns by type name; a value that does not fit raises."""
    return df.withColumns({c: F.col(c).cast(TYPE_NAMES.get(t, t)) for c, t in types.items()})


# ---- encoders

def _abs_frequency(min_frequency: int | float | None, n_rows: int) -> float:
    if min_frequency is None:
        return 0
    return min_frequency * n_rows if isinstance(min_frequency, float) else min_frequency


def fit_ordinal(df: DataFrame, features: Sequence[str], handle_unknown: bool = True,
                min_frequency: int | float | None = None) -> Fitted:
    """Sorted categories to 0 … n-1 and unseen ones to the next code; a missing value stays missing.

    With ``min_frequency`` all rarer categories share the code after the frequent ones. Without
    ``handle_unknown`` an unseen category raises.
    """
    if not features:
        return _identity(features)
    counts = category_counts(df, features)
    least = _abs_frequency(min_frequency, df.count() if isinstance(min_frequency, float) else 0)
    collected = counts.limit(MAX_DRIVER_VALUES + 1).collect()
    if len(collected) <= MAX_DRIVER_VALUES:
        codes, n_codes = [], {}
        for c in features:
            mine = _order(r for r in collected if r["feature"] == c)
            frequent = [r["category"] for r in mine if r["n"] >= least]
            rare = [r["category"] for r in mine if r["n"] < least]
            codes += [(c, v, float(i)) for i, v in enumerate(frequent)] + [(c, v, float(len(frequent))) for v in rare]
            n_codes[c] = len(frequent) + bool(rare)
        lookup = local_frame(df.sparkSession, codes, "feature string, category string, code double")
    else:
        is_frequent = F.col("n") >= least
        sizes = {c: (0, 0) for c in features}
        for r in counts.groupBy("feature").agg(F.count_if(is_frequent).alias("f"), F.count_if(~is_frequent).alias("r")).collect():
            sizes[r["feature"]] = (r["f"], r["r"])
        n_codes = {c: f + bool(r) for c, (f, r) in sizes.items()}
        starts, seen = {}, 0
        for c in sorted(features):
            starts[c] = seen
            seen += sizes[c][0]
        start, rare = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
        for c in features:
            start = F.when(F.col("feature") == c, F.lit(starts[c])).otherwise(start)
            rare = F.when(F.col("feature") == c, F.lit(sizes[c][0])).otherwise(rare)
        numbered = number_rows(counts.where(is_frequent), ["feature", "sort_number", "category"], out="_no")
        lookup = numbered.select("feature", "category", (F.col("_no") - start).cast("double").alias("code")).unionByName(
            counts.where(~is_frequent).select("feature", "category", rare.cast("double").alias("code")))
        lookup = materialize(lookup)

    def apply(df: DataFrame) -> DataFrame:
        columns = df.columns
        for c in features:
            own = lookup.where(F.col("feature") == c).select(F.col("category").alias("_category"), F.col("code").alias("_code"))
            df = df.withColumn("_text", F.col(c).cast("string"))
            df = df.join(own, F.col("_text") == F.col("_category"), "left")
            if handle_unknown:
                unseen = F.lit(float(n_codes[c]))
            else:
                unseen = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.col("_text"))).cast("double")
            code = F.when(F.col("_text").isNotNull(), F.coalesce(F.col("_code"), unseen))
            df = df.withColumn(c, code).drop("_text", "_category", "_code")
        return df.select(*columns)

    return Fitted(list(features), apply, n_codes)


def fit_one_hot(df: DataFrame, features: Sequence[str], min_frequency: int | float | None = None,
                max_categories: int | None = None) -> Fitted:
    """``<feature>_<category>`` columns of 0.0 / 1.0; two columns become one (the first goes); unseen is all zeros.

    With limits, categories below ``min_frequency`` and beyond the ``max_categories`` most frequent share
    the column ``<feature>_infrequent_sklearn``. The columns are the result's schema, so the frequent
    categories of a feature must fit on the driver; otherwise this raises.
    """
    if not features:
        return _identity(features)
    counts = category_counts(df, features)
    least = _abs_frequency(min_frequency, df.count() if isinstance(min_frequency, float) else 0)
    frequent = counts.where(F.col("n") >= least).limit(MAX_DRIVER_VALUES + 1).collect()
    if len(frequent) > MAX_DRIVER_VALUES:
        raise ValueError(f"more than {MAX_DRIVER_VALUES} categories; use an ordinal encoder or a minimum frequency")
    with_rare = {r["feature"] for r in counts.where(F.col("n") < least).select("feature").distinct().collect()}
    plan: dict[str, list[tuple[str, Column]]] = {}
    for c in features:
        kept = _order(r for r in frequent if r["feature"] == c)
        rare = c in with_rare
        if max_categories is not None and max_categories < len(kept) + 1:
            by_count = sorted(range(len(kept)), key=lambda i: (kept[i]["n"], i))
            top = set(by_count[len(kept) - (max_categories - 1):]) if max_categories > 1 else set()
            kept, rare = [r for i, r in enumerate(kept) if i in top], True
        values = [r["category"] for r in kept]
        text = F.col(c).cast("string")
        columns = [(f"{c}_{v}", F.when(text == v, 1.0).otherwise(0.0)) for v in values]
        if rare:
            known = _rare_lookup(counts, c, values)
            columns.append((f"{c}_{INFREQUENT}", known))
        plan[c] = columns[1:] if len(columns) == 2 else columns

    def apply(df: DataFrame) -> DataFrame:
        for c, columns in plan.items():
            lookups = [x for _, x in columns if isinstance(x, DataFrame)]
            if lookups:
                df = df.join(lookups[0], F.col(c).cast("string") == F.col("_rare"), "left")
            exprs = {name: F.when(F.col("_rare").isNotNull(), 1.0).otherwise(0.0) if isinstance(x, DataFrame) else x for name, x in columns}
            df = df.withColumns(exprs).drop(c, "_rare")
        return df

    return Fitted([name for c in features for name, _ in plan[c]], apply)


def _rare_lookup(counts: DataFrame, feature: str, frequent: list[str]) -> DataFrame:
    """(_rare): the infrequent categories seen in fit; an unseen category is not one of them."""
    rare = counts.where((F.col("feature") == feature) & ~F.col("category").isin(frequent)).select(F.col("category").alias("_rare"))
    local = bounded(rare)
    return materialize(rare) if local is rare else local


# ---- custom stages

def fit_custom(df: DataFrame, features: Sequence[str], stage: Estimator | Transformer) -> Fitted:
    """Any ``pyspark.ml`` stage: its columns are set to the features and its output takes their names."""
    features = list(features)
    made = [f"_{c}_out" for c in features]
    if stage.hasParam("inputCols") and stage.hasParam("outputCols"):
        configured = [stage.copy({stage.getParam("inputCols"): features, stage.getParam("outputCols"): made})]
    elif stage.hasParam("inputCol") and stage.hasParam("outputCol"):
        configured = [stage.copy({stage.getParam("inputCol"): c, stage.getParam("outputCol"): m}) for c, m in zip(features, made)]
    else:
        raise ValueError(f"{type(stage).__name__} has no input and output columns to set")
    models = [s.fit(df) if isinstance(s, Estimator) else s for s in configured]

    def apply(df: DataFrame) -> DataFrame:
        for m in models:
            df = m.transform(df)
        return df.drop(*features).withColumnsRenamed(dict(zip(made, features)))

    return Fitted(features, apply)


def _is_custom(x) -> bool:
    return isinstance(x, (Estimator, Transformer))


def reorder_columns(columns: Sequence[str], orderly: Sequence[str]) -> list[str]:
    """The wanted order of ``columns``: one-hot columns sit where their feature was, dropped features vanish."""
    out = []
    for feature in orderly:
        if feature in columns:
            out.append(feature)
            continue
        longer = [f"{f}_" for f in orderly if f != feature and f.startswith(f"{feature}_")]
        out += [c for c in columns if c.startswith(f"{feature}_") and not c.startswith(tuple(longer)) and c not in out]
    return out


# ---- composed pipelines

@dataclass
class FittedPipeline:
    stages: list[Fitted]
    features: list[str]
    keep: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df.select(*self.keep, *self.features)


def _fit_chain(df: DataFrame, features: Sequence[str], makers: Sequence[Callable]) -> tuple[DataFrame, list[str], list[Fitted]]:
    features, stages = list(features), []
    for make in makers:
        stage = make(df, features)
        stages.append(stage)
        df, features = stage.transform(df), stage.features
    return df, features, stages


def _imputer(choice, allowed: Sequence[str]):
    if choice is None or choice == "":
        return lambda df, features: _identity(features)
    if _is_custom(choice):
        return lambda df, features: fit_custom(df, features, choice)
    if isinstance(choice, str) and choice not in allowed:
        raise ValueError(f"unknown imputer: {choice}")
    return lambda df, features: fit_imputer(df, features, choice)


def _spread(threshold: float | None, scaler):
    """Variance threshold and scaler together: both come from one pass over the data."""
    if isinstance(scaler, str) and scaler not in ("standard", "minmax", "robust", ""):
        raise ValueError(f"unknown scaler: {scaler}")

    def fit(df: DataFrame, features: list[str]) -> Fitted:
        needs = threshold is not None or scaler in ("standard", "minmax")
        stats = moments(df, features) if needs else None
        first = fit_variance_threshold(df, features, threshold, stats)
        if not scaler:
            return first
        kept = first.transform(df)
        second = fit_custom(kept, first.features, scaler) if _is_custom(scaler) else fit_scaler(kept, first.features, scaler, stats)
        return Fitted(second.features, lambda d: second.transform(first.transform(d)))

    return fit


def _caster(name: str | None):
    if not name:
        return lambda df, features: _identity(features)
    return lambda df, features: Fitted(list(features), lambda d: cast_types(d, dict.fromkeys(features, name)))


def _encoder(choice, handle_unknown: bool, min_frequency=None):
    if not choice:
        return lambda df, features: _identity(features)
    if _is_custom(choice):
        return lambda df, features: fit_custom(df, features, choice)
    if choice == "ordinal":
        return lambda df, features: fit_ordinal(df, features, handle_unknown, min_frequency)
    if choice == "one_hot":
        return lambda df, features: fit_one_hot(df, features, min_frequency)
    if choice == "one_hot_10":
        return lambda df, features: fit_one_hot(df, features, 0.1, 10)
    raise ValueError(f"unknown categorical encoder: {choice}")


@dataclass
class DataPreprocess:
    """Continuous features: impute, variance threshold, scale, cast. Categorical: impute, encode, variance threshold, cast."""

    categorical_features_names: Sequence[str]
    continuous_features_names: Sequence[str]
    orderly_features_names: Sequence[str]
    continuous_imputer: object = "median"
    categorical_imputer: object = "most_frequent"
    categorical_encoder: object = "ordinal"
    handle_unknown_categories: bool = True
    variance_threshold: float | None = 0.0
    scaler: object = "standard"
    categorical_type: str | None = "category"
    continuous_type: str | None = "float32"

    def fit(self, df: DataFrame, keep: Sequence[str] = ()) -> FittedPipeline:
        """``keep`` names columns to pass through, such as an id."""
        continuous = [_imputer(self.continuous_imputer, ("median", "mean")), _spread(self.variance_threshold, self.scaler),
                      _caster(self.continuous_type)]
        categorical = [_imputer(self.categorical_imputer, ("most_frequent",)),
                       _encoder(self.categorical_encoder, self.handle_unknown_categories),
                       lambda d, f: fit_variance_threshold(d, f, self.variance_threshold) if f else _identity(f),
                       _caster(self.categorical_type)]
        _, numbers, first = _fit_chain(df.select(*self.continuous_features_names), self.continuous_features_names, continuous)
        _, codes, second = _fit_chain(df.select(*self.categorical_features_names), self.categorical_features_names, categorical)
        order = reorder_columns([*numbers, *codes], self.orderly_features_names)
        return FittedPipeline([*first, *second], order, list(keep))


TASKS = ("regression", "multi_regression", "classification", "binary_classification")


@dataclass
class TargetPreprocess:
    """Target columns: impute, then scale (regression tasks) or encode (classification tasks), then cast."""

    task: str
    imputer: object = None
    categorical_encoder: object = "ordinal"
    categorical_min_frequency: int | float | None = 10
    continuous_scaler: object = "standard"
    categorical_type: str | None = "float32"
    continuous_type: str | None = "float32"

    def __post_init__(self):
        if self.task not in TASKS:
            raise ValueError(f"unknown task: {self.task}")

    def fit(self, df: DataFrame, targets: Sequence[str], keep: Sequence[str] = ()) -> FittedPipeline:
        makers = [_imputer(self.imputer, ("median", "mean", "most_frequent"))]
        if self.task in ("classification", "binary_classification"):
            if self.categorical_encoder == "one_hot_10":
                raise ValueError("unknown encoder: one_hot_10")
            makers += [_encoder(self.categorical_encoder, True, self.categorical_min_frequency), _caster(self.categorical_type)]
        else:
            makers += [_spread(None, self.continuous_scaler), _caster(self.continuous_type)]
        _, features, stages = _fit_chain(df.select(*targets), targets, makers)
        return FittedPipeline(stages, features, list(keep))
