"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runquarry.functions.scale import scratch_path

#: Characters between words: space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def word_count(c: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def fixed(df: DataFrame, name: str = "stage", by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: rows, ids and lineage are fixed from here on."""
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._rq_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``fixed`` that nothing reads any more: neither what follows nor what it is made of."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._rq_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def worker_once(key: str, make: Callable[[], object]):
    """``make()`` once per Python worker, for tables that are costly to load."""
    store = sys.__dict__.setdefault("_runquarry_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit values (the splitmix finaliser); equal inputs stay equal, others look random."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and where each begins (n + 1 offsets); null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]] if len(column) else whole[:0], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Row slices of a batch whose texts hold about ``max_bytes``; a longer text comes alone, but whole."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


# Plain characters: letters, digits and signs that are surely no white space.
_PLAIN = "!-~À-ʯͰ-ϿЀ-ԯ"
# A space before a plain character always begins a piece of the byte-level pattern, and a single line break between
# plain characters (or before such a space) is a piece by itself, so a text may be encoded part by part there.
_UNSURE = re.compile(rf" (?![{_PLAIN}])|\n(?! ?[{_PLAIN}])|[^{_PLAIN}]\n")
_CUT = re.compile(rf"(?= [{_PLAIN}])")
#: What no plain part has.
ODD = re.compile(rf"[^ \n{_PLAIN}]")


_CONTROLS = [chr(c) for c in (*range(10), *range(11, 32), 127)]


def _sure(text: str) -> bool:
    """Whether all spaces and line breaks of a text stand between plain characters."""
    if not text.isascii():
        return "\0" not in text and not _UNSURE.search(text)
    return not ("  " in text or " \n" in text or "\n\n" in text or text.endswith((" ", "\n")) or any(c in text for c in _CONTROLS))


def parts_of(text: str) -> list[str]:
    """A text cut where pieces of the byte-level pattern surely begin; joined they are the text. Some may be empty."""
    if not _sure(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
