"""Reading and writing run stores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from runquarry.functions.scale import MAX_DRIVER_VALUES, distinct_values
from runquarry.operators.runs import latest_metrics, pivot_keys
from runquarry.schemas import DEFAULT_EXCLUDED, STORE_SCHEMAS, with_store_schema


class RunStore(Mapping[str, DataFrame]):
    """The tables of one store by name, iterated parents first."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        order = list(STORE_SCHEMAS)
        self._tables = dict(sorted(tables.items(), key=lambda kv: (order.index(kv[0]) if kv[0] in order else len(order))))

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def replace(self, **tables: DataFrame) -> RunStore:
        return RunStore({**self._tables, **tables})

    def row_counts(self) -> DataFrame:
        """(table_name, n_rows); the counts come from file footers where the source has them."""
        parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
                 for name, df in self.items()]
        return reduce(DataFrame.unionByName, parts)


def _wanted(names: Iterable[str], tables, exclude_tables) -> list[str]:
    skip = set(DEFAULT_EXCLUDED if exclude_tables is None else exclude_tables)
    return [n for n in names if n not in skip and (not tables or n in tables)]


def hex_prefix_predicates(column: str = "run_uuid", digits: int = 2) -> list[str]:
    """JDBC predicates that cut a table by the leading hex digits of an id; together they cover every row."""
    points = [format(i, f"0{digits}x") for i in range(1, 16**digits)]
    ranges = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(points, points[1:])]
    return [f"{column} < '{points[0]}' OR {column} IS NULL", *ranges, f"{column} >= '{points[-1]}'"]


def read_run_store(spark: SparkSession, location: str, tables: Iterable[str] | None = None,
                   exclude_tables: Iterable[str] | None = None, format: str = "parquet",
                   options: Mapping[str, str] | None = None) -> RunStore:
    """Load a store: files below ``location`` (one folder or file per table), or a database for ``format="jdbc"``.

    Without ``tables`` everything found below ``location`` is a table, whatever its name; of a database the tables with a
    known schema are read, name others. A database table with a run id is read in parallel, one partition per id prefix.
    """
    options = dict(options or {})
    loaded: dict[str, DataFrame] = {}
    files = {} if format == "jdbc" else _tables_below(spark, location, format)
    for name in _wanted(tables or (STORE_SCHEMAS if format == "jdbc" else files), tables, exclude_tables):
        if format == "jdbc":
            keyed = any(f.name == "run_uuid" for f in STORE_SCHEMAS[name].fields) if name in STORE_SCHEMAS else False
            df = (spark.read.jdbc(location, name, predicates=hex_prefix_predicates(), properties={"fetchsize": "100000", **options}) if keyed
                  else spark.read.jdbc(location, name, properties={"fetchsize": "100000", **options}))
        else:
            df = spark.read.format(format).options(**options).load(files.get(name, f"{location.rstrip('/')}/{name}"))
        loaded[name] = with_store_schema(name, df)
    return RunStore(loaded)


def _tables_below(spark: SparkSession, location: str, format: str) -> dict[str, str]:
    """Table name -> path of the folders and files of a store; hidden ones and those beginning with ``_`` are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(location)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = {status.getPath().getName(): status.getPath().toString() for status in found}
    return {n.removesuffix(f".{format}"): path for n, path in sorted(names.items()) if n[0] not in "._"}


def sql_source(spark: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """SQL text over the given tables, named by their keys: ``SELECT ... FROM {runs}``."""
    return spark.sql(query, **tables)


def append_table(df: DataFrame, location: str, format: str = "parquet") -> DataFrame:
    """Append rows to a table and return the whole table. ``VersionedStore.append`` makes a repeated append harmless."""
    df.write.format(format).mode("append").save(location)
    return df.sparkSession.read.format(format).load(location)


def error_report(errors: DataFrame, location: str) -> DataFrame:
    """Write (db1_url, error) as CSV with a header and read it back."""
    errors.select("db1_url", "error").write.mode("overwrite").csv(location, header=True, escape='"')
    return errors.sparkSession.read.csv(location, header=True, schema="db1_url string, error string", escape='"', multiLine=True)


def search_runs(store: Mapping[str, DataFrame], param_keys=None, metric_keys=None, tag_keys=None, max_columns: int = MAX_DRIVER_VALUES) -> DataFrame:
    """Run columns plus ``params.<key>``, ``metrics.<key>`` (last value) and ``tags.<key>``; all runs are kept.

    Keys that are not given are all those of the table, up to ``max_columns`` of them.
    """
    wide = store["runs"]
    parts = [("params", store["params"], param_keys), ("tags", store["tags"], tag_keys),
             ("metrics", latest_metrics(store["metrics"]), metric_keys)]
    for name, eav, keys in parts:
        keys = distinct_values(store[name], "key", max_columns) if keys is None else keys
        if not keys:
            continue
        wide = wide.join(pivot_keys(eav, keys, prefix=f"{name}."), "run_uuid", "left")
    return wide
