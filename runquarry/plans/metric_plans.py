"""All registry metrics per model."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from runquarry.operators.metrics import METRICS, get_metric_fn
from runquarry.plans.registry import query

_DIGITS = 9
_AVERAGES = ("micro", "macro", "weighted", "all", "binary")


def _round(df, digits=_DIGITS):
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) and f.name != "threshold" else F.col(f.name)
                       for f in df.schema.fields])


_PER = """cm AS (SELECT model, {t} AS t, {p} AS p, count(*) AS n FROM predictions GROUP BY ALL),
per AS (SELECT model, label, cast(sum(CASE WHEN t = label THEN n ELSE 0 END) AS bigint) AS support,
        cast(sum(CASE WHEN p = label THEN n ELSE 0 END) AS bigint) AS predicted,
        cast(sum(CASE WHEN t = label AND p = label THEN n ELSE 0 END) AS bigint) AS tp
        FROM cm, (SELECT unnest({labels}) AS label) GROUP BY model, label)"""
_CLS = _PER.format(t="y_cls", p="p_cls", labels="[0, 1, 2]")
_BIN = _PER.format(t="y_bin", p="p_bin", labels="[1]")
_SCORE = {"precision": ("tp", "predicted"), "recall": ("tp", "support"), "f1": ("2 * tp", "(support + predicted)")}


def _score(name, average):
    a, b = _SCORE[name]
    if average == "micro":
        a, b = f"sum({a})", f"sum({b})"
    each = f"(CASE WHEN {b} = 0 THEN 0.0E0 ELSE cast({a} AS double) / {b} END)"
    if average == "macro":
        each = f"avg({each})"
    if average == "weighted":
        each = f"sum({each} * support) / sum(support)"
    return f"round({each}, {_DIGITS})"


def _label_sql(average, columns):
    base = _BIN if average == "binary" else _CLS
    keys = "model, label" if average == "all" else "model"
    group = "" if average in ("all", "binary") else " GROUP BY model"
    return f"WITH {base} SELECT {keys}, {', '.join(columns)} FROM per{group}"


_OVR = """ovr AS (SELECT model, 0 AS label, s0 AS score, (y_cls = 0)::int AS pos FROM predictions UNION ALL
SELECT model, 1, s1, (y_cls = 1)::int FROM predictions UNION ALL SELECT model, 2, s2, (y_cls = 2)::int FROM predictions)"""
_BINARY = "ovr AS (SELECT model, 1 AS label, s_bin AS score, y_bin AS pos FROM predictions)"


def _auc(rows, keys):
    return f"""{rows}, ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score)
    + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0E0 AS r FROM ovr),
per AS (SELECT {keys}, sum(pos) AS p, (sum(CASE WHEN pos = 1 THEN r ELSE 0 END) - sum(pos) * (sum(pos) + 1) / 2.0E0)
    / (cast(sum(pos) AS double) * sum(1 - pos)) AS v FROM ranked GROUP BY {keys})"""


def _ap(rows, keys):
    return f"""{rows}, running AS (SELECT *, sum(pos) OVER (PARTITION BY {keys}) AS total,
    sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS tp,
    count(*) OVER (PARTITION BY {keys} ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS seen FROM ovr),
per AS (SELECT {keys}, sum(pos) AS p, sum(pos / cast(total AS double) * (tp / cast(seen AS double))) AS v FROM running GROUP BY {keys})"""


def _ranking_sql(base, name, average):
    if average == "binary":
        return f"WITH {base(_BINARY, 'model')} SELECT model, round(v, {_DIGITS}) AS {name} FROM per"
    if average == "micro":
        return f"WITH {base(_OVR, 'model')} SELECT model, round(v, {_DIGITS}) AS {name} FROM per"
    with_labels = f"WITH {base(_OVR, 'model, label')} "
    if average == "all":
        return f"{with_labels} SELECT model, label, round(v, {_DIGITS}) AS {name} FROM per"
    value = "avg(v)" if average == "macro" else "sum(v * p) / sum(p)"
    return f"{with_labels} SELECT model, round({value}, {_DIGITS}) AS {name} FROM per GROUP BY model"


def _oracles():
    eps = "2.220446049250313E-16"
    y, p = "y_reg", "p_reg"
    simple = {
        "mse": f"avg(pow({y} - {p}, 2))", "rmse": f"sqrt(avg(pow({y} - {p}, 2)))",
        "r2_score": f"1 - sum(pow({y} - {p}, 2)) / (var_pop({y}) * count(*))", "mae": f"avg(abs({y} - {p}))",
        "mape": f"avg(abs({y} - {p}) / greatest(abs({y}), {eps}))",
        "accuracy": "avg((y_cls = p_cls)::int)",
        "logloss": f"-avg(ln(greatest({eps}, least(1 - {eps}, CASE y_cls WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END))))",
    }
    # squared prices are of the order 1e9, so nine digits would be below their spacing
    digits = {"mse": 3, "rmse": 6, "mae": 6}
    out = {n: f"SELECT model, round({e}, {digits.get(n, _DIGITS)}) AS {n} FROM predictions GROUP BY model" for n, e in simple.items()}
    balanced = f"WITH {_CLS}, b AS (SELECT model, avg(cast(tp AS double) / support) AS v, count(*) AS c FROM per WHERE support > 0 GROUP BY model) "
    out["balanced_accuracy"] = balanced + f"SELECT model, round(v, {_DIGITS}) AS balanced_accuracy FROM b"
    out["balanced_accuracy_adjusted"] = (balanced + f"SELECT model, round((v - 1.0E0 / c) / (1.0E0 - 1.0E0 / c), {_DIGITS})"
                                         " AS balanced_accuracy_adjusted FROM b")
    for average in _AVERAGES:
        for s in _SCORE:
            out[f"{s}_{average}"] = _label_sql(average, [f"{_score(s, average)} AS {s}_{average}"])
        support = "support" if average == "all" else "cast(NULL AS bigint) AS support"
        out[f"precision_recall_fscore_support_{average}"] = _label_sql(average, [
            f"{_score('precision', average)} AS precision", f"{_score('recall', average)} AS recall",
            f"{_score('f1', average)} AS fscore", support])
        out[f"average_precision_{average}"] = _ranking_sql(_ap, f"average_precision_{average}", average)
    out["auc_binary"] = _ranking_sql(_auc, "auc_binary", "binary")
    out["auc"] = _ranking_sql(_auc, "auc", "macro")
    out["auc_micro"] = _ranking_sql(_auc, "auc_micro", "micro")
    out["auc_weighted"] = _ranking_sql(_auc, "auc_weighted", "weighted")
    out["precision_recall_curve"] = f"""
WITH d AS (SELECT model, s_bin AS threshold, sum(y_bin) AS pos, count(*) AS n FROM predictions GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY threshold DESC) AS seen,
      sum(pos) OVER (PARTITION BY model) AS total FROM d)
SELECT model, threshold, round(cast(tp AS double) / seen, {_DIGITS}) AS precision, round(cast(tp AS double) / total, {_DIGITS}) AS recall FROM r
UNION ALL SELECT DISTINCT model, cast(NULL AS double), 1.0E0, 0.0E0 FROM predictions"""
    return out, digits


_ORACLES, _OWN_DIGITS = _oracles()


def _inputs(name):
    if name in ("mse", "rmse", "r2_score", "mae", "mape"):
        return "y_reg", "p_reg"
    if name in ("auc_binary", "average_precision_binary", "precision_recall_curve"):
        return "y_bin", "s_bin"
    if name.endswith("_binary"):
        return "y_bin", "p_bin"
    return "y_cls", ["s0", "s1", "s2"] if METRICS[name][1] else "p_cls"


for _name in METRICS:
    @query(f"metric_{_name}", _ORACLES[_name])
    def _(t, name=_name):
        fn, _, _ = get_metric_fn(name, n_classes=3)
        return _round(fn(t["predictions"], *_inputs(name), ["model"]), _OWN_DIGITS.get(name, _DIGITS))
