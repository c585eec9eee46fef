"""Run-store schemas and naming rules."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()

# Tables in dependency order, parents first.
STORE_SCHEMAS: dict[str, T.StructType] = {
    "experiments": _schema(("experiment_id", _I), ("name", _S), ("lifecycle_stage", _S)),
    "experiment_tags": _schema(("experiment_id", _I), ("key", _S), ("value", _S)),
    "datasets": _schema(("experiment_id", _I)),
    "trace_info": _schema(("experiment_id", _I)),
    "runs": _schema(("run_uuid", _S), ("experiment_id", _I), ("status", _S), ("lifecycle_stage", _S)),
    "params": _schema(("run_uuid", _S), ("key", _S), ("value", _S)),
    "tags": _schema(("run_uuid", _S), ("key", _S), ("value", _S)),
    "metrics": _schema(("run_uuid", _S), ("key", _S), ("value", _D), ("step", _L), ("ts", _TS)),
    "latest_metrics": _schema(("run_uuid", _S), ("key", _S), ("value", _D)),
}

# What identifies a row when two stores are merged.
PRIMARY_KEYS: dict[str, list[str]] = {
    "experiments": ["name"],
    "experiment_tags": ["experiment_id", "key"],
    "runs": ["run_uuid"],
    "params": ["run_uuid", "key"],
    "tags": ["run_uuid", "key"],
    "metrics": ["run_uuid", "key", "step", "ts", "value"],
    "latest_metrics": ["run_uuid", "key"],
}

DEFAULT_EXCLUDED = ("alembic_version",)
DELETED = "deleted"


def with_store_schema(name: str, df):
    """Cast the known columns of a table; unknown extra columns stay as they are."""
    known = {f.name: f.dataType for f in STORE_SCHEMAS.get(name, T.StructType()).fields}
    return df.select(*[df[c].cast(known[c]).alias(c) if c in known else df[c] for c in df.columns])
