"""Building blocks that keep every operator distributed when keys are hot and groups are large."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

# A list of distinct values is read by the driver only below this size (Spark's own limit for pivot values).
MAX_DRIVER_VALUES = 10_000
# Rows of an ordered list that one window task may number.
MAX_SINGLE_TASK_ROWS = 10_000
# A side of a join is made local, and so broadcast, only up to this many rows.
MAX_BROADCAST_ROWS = 50_000
# Rows that one task sorts where their number is known beforehand.
PARTITION_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``. Where it is unset a local session gets a fresh one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="runquarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are fixed from here on, whatever executors are lost."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: fixed like a checkpoint, and later reads take only their columns."""
    path = scratch_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation: unlike a parallelised list its size is known, so joins broadcast it."""
    parsed = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in parsed.fields]
    table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, parsed.fields)], names=parsed.fieldNames())
    return spark.createDataFrame(table, schema=parsed)


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The same rows, evaluated once and made local if there are at most ``max_rows``; otherwise ``df`` itself.

    For the small side of a join with a large one. A computed side has no size estimate, so the planner would
    shuffle the large side before it learns that a broadcast would have done. Beyond the bound it is right to.
    """
    few = df.limit(max_rows + 1).toArrow()
    return df if few.num_rows > max_rows else df.sparkSession.createDataFrame(few, schema=df.schema)


def distinct_values(df: DataFrame, column: str, limit: int = MAX_DRIVER_VALUES) -> list:
    """Sorted non-NULL distinct values, for results whose *schema* depends on them; raises beyond ``limit``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values; pass the wanted values explicitly")
    return sorted(r[0] for r in rows)


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    """Rows of the largest group, counted with map-side combine."""
    return df.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def number_rows(df: DataFrame, order: Sequence[str | Column], out: str = "row_no",
                single_task_rows: int = MAX_SINGLE_TASK_ROWS) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    Small inputs (counted first) use one window. Larger ones are range-partitioned and fixed by a
    checkpoint; each partition numbers its own rows and adds the number of rows in the ones before it.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if df.limit(single_task_rows + 1).count() <= single_task_rows:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)
    # one row per partition, so the driver holds as many numbers as there are partitions
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    offsets, seen = [], 0
    for part, n in counts:
        offsets.append((part, seen))
        seen += n
    starts = local_frame(df.sparkSession, offsets, "_part int, _start bigint")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (ranged.withColumn(out, within).join(starts, "_part")
            .withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start"))


def explode_range(df: DataFrame, size: Column, out: str, chunk: int = 10_000) -> DataFrame:
    """One output row per integer in [0, size) of each input row.

    A huge range is first cut in chunks that are spread over the cluster, so that a single input row
    never expands within a single task.
    """
    last = size.cast("bigint") - 1
    cut = df.withColumn("_last", last).where(F.col("_last") >= 0)
    cut = cut.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"), F.lit(chunk).cast("bigint"))))
    # an explicit number: adaptive execution would merge these few-byte partitions back into one
    cut = cut.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    upto = F.least(F.col("_from") + chunk - 1, F.col("_last"))
    return cut.withColumn(out, F.explode(F.sequence(F.col("_from"), upto))).drop("_last", "_from")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, of which NULLs are equal; the keys come from ``left``."""
    named = right.select(*[F.col(k).alias(f"_same_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(named[f"_same_{i}"])
    return left.join(named, on, how).drop(*[f"_same_{i}" for i in range(len(keys))])


def running_below(d: DataFrame, groups: Sequence[str], order: str, sums: Sequence[str], few_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Per row, the sums over all rows of its group with a *lower* ``order`` value, and over the whole group.

    ``d`` holds one row per (group, order value). Adds ``below_<c>`` and ``total_<c>`` for each c in ``sums``. Up to ``few_rows``
    rows, which are counted by taking them, are local and need one window (0: not tried, for counts that are hardly
    fewer than the rows). More are range-partitioned by group and value and fixed by a checkpoint; as no two rows are equal, no partition can be
    skewed, whatever the values and the group sizes are. Rows are summed within their partition, and the sums of
    the group's lower partitions (one row per group and partition) are added. NULL groups are groups.
    """
    groups = list(groups)
    earlier = Window.unboundedPreceding, -1
    few = bounded(d, few_rows) if few_rows else d
    if few is not d:
        before, whole = Window.partitionBy(*groups).orderBy(order).rowsBetween(*earlier), Window.partitionBy(*groups)
        return few.select("*", *[x for c in sums for x in (F.sum(c).over(whole).alias(f"total_{c}"), F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"below_{c}"))])
    if few_rows:
        d = materialize(d)  # it has been evaluated once already
    ranged = materialize(d.repartitionByRange(*groups, order).withColumn("_part", F.spark_partition_id()))
    before, whole = Window.partitionBy(*groups).orderBy("_part").rowsBetween(*earlier), Window.partitionBy(*groups)
    per_part = ranged.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    offsets = per_part.select(*groups, "_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
                              *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in sums])
    inside = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(*earlier)
    placed = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in sums])
    out = same_keys(placed, offsets, [*groups, "_part"], "inner")
    for c in sums:
        out = out.withColumn(f"below_{c}", F.col(f"_o_{c}") + F.col(f"_i_{c}"))
    return out.drop("_part", *[f"_{x}_{c}" for c in sums for x in "oi"])


def dealt(df: DataFrame, keys: Sequence[str], rows: int = PARTITION_ROWS) -> DataFrame:
    """The rows dealt by ``keys`` to partitions of about ``rows`` each, however many there are.

    For aggregates that sort their input (a maximum of texts or structs): grouped by these keys, they need no second shuffle, and a
    task sorts no more rows in a large table than in a small one. The rows are counted first.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *keys)


def null_if_nan(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
