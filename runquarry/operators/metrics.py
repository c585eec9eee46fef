"""Grouped prediction metrics: predictions in, one row per group (or per group and label, or threshold) out.

Every metric starts from an aggregate that is combined before its shuffle: moments for regression, a confusion
matrix for labels, counts per distinct score for rankings. Hot groups therefore shrink before they travel, and
running counts over the scores of a group are taken in range partitions (see ``running_below``).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from runquarry.functions.scale import running_below

# Fixed value: spacing of doubles at 1, the smallest divisor and probability.
EPS = 2.220446049250313e-16

Proba = str | Sequence[str]


def _ratio(a: Column, b: Column, undefined: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(undefined).cast("double")).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


# ---- regression

def _regression(kind: str, df: DataFrame, y_true: str, y_pred: str, groups: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    squared = (y - p) * (y - p)
    if kind == "mse":
        value = F.avg(squared)
    elif kind == "rmse":
        value = F.sqrt(F.avg(squared))
    elif kind == "mae":
        value = F.avg(F.abs(y - p))
    elif kind == "mape":
        value = F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)))
    else:
        residual, total = F.sum(squared), F.var_pop(y) * F.count(y)
        constant = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        value = (F.when(F.count(y) < 2, F.lit(None).cast("double")).when(total == 0, constant)
                 .otherwise(F.lit(1.0) - residual / F.nullif(total, F.lit(0.0))))
    return df.groupBy(*groups).agg(value.alias(kind))


# ---- labels

def class_counts(df: DataFrame, y_true: str, y_pred: str, groups: Sequence[str] = (), labels: Sequence | None = None) -> DataFrame:
    """(group, label, support, predicted, tp); with ``labels`` exactly those, zeros for the absent ones."""
    cm = df.groupBy(*groups, F.col(y_true).alias("_t"), F.col(y_pred).alias("_p")).agg(F.count("*").alias("_n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(zero)
    label_type = cm.schema["_t"].dataType
    as_true = F.struct(F.col("_t").alias("label"), F.col("_n").alias("support"), zero.alias("predicted"), hit.alias("tp"))
    as_pred = F.struct(F.col("_p").cast(label_type).alias("label"), zero.alias("support"), F.col("_n").alias("predicted"), zero.alias("tp"))
    sides = cm.select(*groups, F.explode(F.array(as_true, as_pred)).alias("_s")).select(*groups, "_s.*")
    sums = [F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    if labels is None:
        return sides.groupBy(*groups, "label").agg(*sums)
    names = [(label, i) for i, label in enumerate(labels)]
    wide = sides.groupBy(*groups).agg(*[
        F.coalesce(F.sum(F.when(F.col("label") == F.lit(label), F.col(c))), zero).alias(f"_{c}_{i}")
        for label, i in names for c in ("support", "predicted", "tp")])
    rows = F.array(*[F.struct(F.lit(label).cast(label_type).alias("label"), *[
        F.col(f"_{c}_{i}").alias(c) for c in ("support", "predicted", "tp")]) for label, i in names])
    return wide.select(*groups, F.explode(rows).alias("_s")).select(*groups, "_s.*")


_SCORES: dict[str, tuple[str, Callable[[Column, Column, Column], Column]]] = {
    "precision": ("precision", lambda tp, support, predicted: _ratio(tp, predicted)),
    "recall": ("recall", lambda tp, support, predicted: _ratio(tp, support)),
    "fscore": ("fscore", lambda tp, support, predicted: _ratio(2 * tp, support + predicted)),
}


def _label_scores(scores: Sequence[str], average: str, rename: dict[str, str], with_support: bool, df: DataFrame, y_true: str,
                  y_pred: str, groups: Sequence[str] = (), labels: Sequence | None = None, pos_label=1) -> DataFrame:
    counts = class_counts(df, y_true, y_pred, groups, [pos_label] if average == "binary" else labels)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    formulas = {rename.get(s, s): _SCORES[s][1] for s in scores}
    no_support = [F.lit(None).cast("bigint").alias("support")] if with_support else []
    if average == "all":
        return counts.select(*groups, "label", *[f(tp, support, predicted).alias(n) for n, f in formulas.items()],
                             *(["support"] if with_support else []))
    if average == "binary":
        return counts.select(*groups, *[f(tp, support, predicted).alias(n) for n, f in formulas.items()], *no_support)
    if average == "micro":
        aggs = [f(F.sum(tp), F.sum(support), F.sum(predicted)).alias(n) for n, f in formulas.items()]
    elif average == "macro":
        aggs = [F.avg(f(tp, support, predicted)).alias(n) for n, f in formulas.items()]
    else:
        aggs = [_ratio(F.sum(f(tp, support, predicted) * support), F.sum(support)).alias(n) for n, f in formulas.items()]
    return counts.groupBy(*groups).agg(*aggs).select("*", *no_support)


def _accuracy(df: DataFrame, y_true: str, y_pred: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(F.when(F.col(y_true) == F.col(y_pred), 1.0).otherwise(0.0)).alias("accuracy"))


def _balanced_accuracy(adjusted: bool, df: DataFrame, y_true: str, y_pred: str, groups: Sequence[str] = ()) -> DataFrame:
    seen = class_counts(df, y_true, y_pred, groups).where(F.col("support") > 0)
    balanced = F.avg(F.col("tp").cast("double") / F.col("support"))
    if not adjusted:
        return seen.groupBy(*groups).agg(balanced.alias("balanced_accuracy"))
    chance = F.lit(1.0) / F.count("*")
    value = (balanced - chance) / F.nullif(F.lit(1.0) - chance, F.lit(0.0))
    return seen.groupBy(*groups).agg(value.alias("balanced_accuracy_adjusted"))


# ---- rankings by score

def _proba_array(proba: Proba) -> Column:
    return F.col(proba) if isinstance(proba, str) else F.array(*[F.col(c).cast("double") for c in proba])


def _one_vs_rest(df: DataFrame, y_true: str, proba: Proba, groups: Sequence[str], labels: Sequence | None) -> DataFrame:
    """(group, label, score, is_pos): one row per prediction and class, reduced to distinct scores right after."""
    rows = df.select(*groups, F.col(y_true).alias("_y"), F.posexplode(_proba_array(proba)).alias("_i", "score"))
    label = F.col("_i") if labels is None else F.get(F.array(*[F.lit(x) for x in labels]), F.col("_i"))
    return rows.select(*groups, label.alias("label"), "score", (F.col("_y") == label).cast("bigint").alias("is_pos"))


def _binary(df: DataFrame, y_true: str, score: str, groups: Sequence[str], pos_label) -> DataFrame:
    return df.select(*groups, F.col(score).cast("double").alias("score"),
                     (F.col(y_true) == F.lit(pos_label)).cast("bigint").alias("is_pos"))


def _score_counts(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Distinct scores of a group with the positives and negatives at, below and in total."""
    if not groups:
        return _score_counts(rows.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    counts = rows.groupBy(*groups, "score").agg(F.sum("is_pos").alias("pos"), F.sum(1 - F.col("is_pos")).alias("neg"))
    return running_below(counts, groups, "score", ["pos", "neg"])


def _auc_of(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(group, auc, positives): share of (positive, negative) pairs in the right order, ties count half."""
    d = _score_counts(rows, groups)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pairs = F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
    return d.groupBy(*groups).agg(_ratio(F.sum(pos * (F.col("below_neg") + neg / 2)), pairs, None).alias("auc"),
                                  F.max("total_pos").alias("positives"))


def _auc_binary(df: DataFrame, y_true: str, score: str, groups: Sequence[str] = (), pos_label=1) -> DataFrame:
    return _auc_of(_binary(df, y_true, score, groups, pos_label), groups).select(*groups, F.col("auc").alias("auc_binary"))


def _average_precision_of(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(group, ap, positives): recall steps times precision from the highest score down; 0 without positives."""
    d = _score_counts(rows, groups)
    tp = (F.col("total_pos") - F.col("below_pos")).cast("double")
    fp = (F.col("total_neg") - F.col("below_neg")).cast("double")
    step = F.sum(F.col("pos") * tp / (tp + fp))
    return d.groupBy(*groups).agg(_ratio(step, F.max("total_pos")).alias("ap"), F.max("total_pos").alias("positives"))


def _averaged(per_label: DataFrame, value: str, average: str, groups: Sequence[str], name: str) -> DataFrame:
    v, w = F.col(value), F.col("positives").cast("double")
    # one undefined class makes the average undefined
    whole = F.count(v) == F.count("*")
    agg = F.avg(v) if average == "macro" else _ratio(F.sum(v * w), F.sum(w), 0.0)
    return per_label.groupBy(*groups).agg(F.when(whole, agg).alias(name))


def _ranking(of: Callable, value: str, average: str, name: str, df: DataFrame, y_true: str, proba: Proba,
             groups: Sequence[str] = (), labels: Sequence | None = None) -> DataFrame:
    rows = _one_vs_rest(df, y_true, proba, groups, labels)
    if average == "micro":
        return of(rows, groups).select(*groups, F.col(value).alias(name))
    per_label = of(rows, [*groups, "label"])
    if average == "all":
        return per_label.select(*groups, "label", F.col(value).alias(name))
    return _averaged(per_label, value, average, groups, name)


def _average_precision_binary(df: DataFrame, y_true: str, score: str, groups: Sequence[str] = (), pos_label=1) -> DataFrame:
    rows = _binary(df, y_true, score, groups, pos_label)
    return _average_precision_of(rows, groups).select(*groups, F.col("ap").alias("average_precision_binary"))


def _precision_recall_curve(df: DataFrame, y_true: str, score: str, groups: Sequence[str] = (), pos_label=1) -> DataFrame:
    d = _score_counts(_binary(df, y_true, score, groups, pos_label), groups)
    tp = (F.col("total_pos") - F.col("below_pos")).cast("double")
    fp = (F.col("total_neg") - F.col("below_neg")).cast("double")
    curve = d.select(*groups, F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"),
                     _ratio(tp, F.col("total_pos"), 1.0).alias("recall"))
    end = df.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    end = end.select(*groups, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def _logloss(df: DataFrame, y_true: str, proba: Proba, groups: Sequence[str] = (), labels: Sequence | None = None) -> DataFrame:
    if labels is None:
        index = F.col(y_true).cast("int")
    else:
        index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(y_true)).cast("int") - 1
    known = F.get(_proba_array(proba), F.when(index >= 0, index))
    p = F.coalesce(known, F.raise_error(F.lit("a true label has no probability")).cast("double"))
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return df.groupBy(*groups).agg((-F.avg(F.ln(clipped))).alias("logloss"))


# ---- registry

_AVERAGES = ("micro", "macro", "weighted", "all", "binary")


def _registry() -> dict[str, tuple[Callable[..., DataFrame], bool, bool]]:
    """name -> (function, needs probabilities, higher is better)."""
    out: dict[str, tuple[Callable[..., DataFrame], bool, bool]] = {}
    for kind, higher in (("mse", False), ("rmse", False), ("r2_score", True), ("mae", False), ("mape", False)):
        out[kind] = (partial(_regression, kind), False, higher)
    out["accuracy"] = (_accuracy, False, True)
    out["balanced_accuracy"] = (partial(_balanced_accuracy, False), False, True)
    out["balanced_accuracy_adjusted"] = (partial(_balanced_accuracy, True), False, True)
    out["auc_binary"] = (_auc_binary, True, True)
    for name, average in (("auc", "macro"), ("auc_micro", "micro"), ("auc_weighted", "weighted")):
        out[name] = (partial(_ranking, _auc_of, "auc", average, name), True, True)
    out["logloss"] = (_logloss, True, False)
    for average in _AVERAGES:
        for score, key in (("f1", "fscore"), ("precision", "precision"), ("recall", "recall")):
            name = f"{score}_{average}"
            out[name] = (partial(_label_scores, [key], average, {key: name}, False), False, True)
        name = f"average_precision_{average}"
        out[name] = (_average_precision_binary if average == "binary" else
                     partial(_ranking, _average_precision_of, "ap", average, name), True, True)
        out[f"precision_recall_fscore_support_{average}"] = (
            partial(_label_scores, ["precision", "recall", "fscore"], average, {}, True), False, True)
    out["precision_recall_curve"] = (_precision_recall_curve, True, True)
    return out


METRICS = _registry()
def get_metric_fn(metric: str, labels: Sequence | None = None, n_classes: int | None = None,
                  pos_label=1) -> tuple[Callable[..., DataFrame], bool, bool]:
    """(fn, needs probabilities, higher is better); ``fn(df, y_true, prediction, groups)`` gives the metric.

    ``prediction`` is a label or score column, or for multi-class probabilities an array column or one
    column per class. Labels default to 0 … n_classes-1, else to those in the data.
    """
    if metric not in METRICS:
        raise KeyError(f"unknown metric {metric}")
    if labels is None and n_classes is not None:
        labels = list(range(n_classes))
    fn, need_proba, higher = METRICS[metric]
    choices = {"labels": labels, "pos_label": pos_label}
    accepted = inspect.signature(fn).parameters
    return partial(fn, **{name: value for name, value in choices.items() if name in accepted}), need_proba, higher
