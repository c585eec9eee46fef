"""Nested parameters: JSON documents to (path, value) rows and back."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _leaves(document, lists: bool, sep: str, list_prefix: str) -> list[tuple[str, object]]:
    """(path, leaf) pairs in document order; no recursion, so any depth will do."""
    out, todo = [], [("", document)]
    while todo:
        path, node = todo.pop()
        start = f"{path}{sep}" if path else ""
        if isinstance(node, dict):
            todo.extend((f"{start}{k}", v) for k, v in reversed(node.items()))
        elif lists and isinstance(node, list):
            todo.extend((f"{start}{list_prefix}{i}", node[i]) for i in reversed(range(len(node))))
        else:
            out.append((path, node))
    return out


def _plain(leaf) -> str | None:
    return leaf if leaf is None or isinstance(leaf, str) else _dump(leaf)


def _fault(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _tried(make: Callable, *parts, strict: bool):
    """(result, None), or (None, what is wrong) where bad input is not to end the job."""
    try:
        return make(*parts), None
    except (ValueError, RecursionError) as error:
        if strict:
            raise
        return None, _fault(error)


def flatten_params(df: DataFrame, ids: Sequence[str], document: str, lists: bool = True, sep: str = "/", list_prefix: str = "item_",
                   values: str = "plain", errors: str | None = None) -> DataFrame:
    """(ids, path, value) of every leaf of a JSON column; empty objects and lists vanish.

    A document that is no JSON ends the job. With ``errors`` it is one row without path and value that says in the column
    of this name what is wrong; the column is NULL in all other rows. A document that is no object or list is
    one leaf with an empty path.

    List members are named ``item_<i>``; with ``lists=False`` a list is a leaf. ``values``: ``plain`` text (strings
    bare, the rest as JSON), ``json`` text, or ``logged`` (as a logged parameter reads: True, None, 1.5).

    Arrow batches of documents are parsed once and exploded in place: one scan, no shuffle, any depth. (A chain of
    variant casts and generators, one per level, took several times as long.)
    """
    text = {"plain": _plain, "json": _dump, "logged": str}[values]

    names = ["path", "value", "error"][:2 if errors is None else 3]

    def flat(documents: pa.Array) -> pa.Array:
        offsets, paths, leaves, faults = [0], [], [], []
        for document in documents.to_pylist():
            if document is not None:
                parsed, fault = _tried(json.loads, document, strict=errors is None)
                for path, leaf in _leaves(parsed, lists, sep, list_prefix) if fault is None else ():
                    paths.append(path)
                    leaves.append(text(leaf))
                    faults.append(None)
                if fault is not None:
                    paths.append(None)
                    leaves.append(None)
                    faults.append(fault)
            offsets.append(len(paths))
        rows = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (paths, leaves, faults)][:len(names)], names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    leaf = T.StructType([T.StructField(n, T.StringType()) for n in names])
    exploded = df.select(*ids, F.explode(F.arrow_udf(flat, T.ArrayType(leaf))(document)).alias("_n"))
    return exploded.select(*ids, "_n.path", "_n.value", *[F.col("_n.error").alias(e) for e in ([] if errors is None else [errors])])


def flat_leaves(document: dict, sep: str = "/", list_prefix: str = "item_") -> list[tuple[str, object]]:
    """(path, leaf) pairs of nested parameters with lists, as they are logged."""
    return _leaves(document, True, sep, list_prefix)


def _rebuilt(leaves: dict[tuple[str, ...], str], list_prefix: str | None = None) -> str:
    """JSON text, keys sorted, of an object given as its leaves: path -> JSON text.

    Works level by level from the deepest paths: the texts of one parent's children are joined to the parent's text.
    With ``list_prefix`` a parent whose children are all numbered with it becomes a list, and so does an empty one.
    """
    empty = "{}" if list_prefix is None else "[]"
    levels: dict[int, dict[tuple[str, ...], str]] = {}
    for path, text in leaves.items():
        levels.setdefault(len(path), {})[path] = empty if text == "{}" else text
    for depth in range(max(levels, default=0), 0, -1):
        children: dict[tuple[str, ...], dict[str, str]] = {}
        for path, text in levels.pop(depth, {}).items():
            children.setdefault(path[:-1], {})[path[-1]] = text
        above = levels.setdefault(depth - 1, {})
        for parent, named in children.items():
            if parent in above:
                raise ValueError(f"{sorted(named)[0]} continues a path that holds a value: {parent}")
            numbers = [n.removeprefix(list_prefix) for n in named] if list_prefix is not None else [""]
            if all(n.isdigit() for n in numbers) and all(n.startswith(list_prefix) for n in named):
                above[parent] = "[" + ",".join(t for _, t in sorted(zip(map(int, numbers), named.values()))) + "]"
            else:
                above[parent] = "{" + ",".join(f"{_dump(n)}:{named[n]}" for n in sorted(named)) + "}"
    return levels.get(0, {}).get((), empty)


_dump = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def unflatten_params(df: DataFrame, ids: Sequence[str], path: str = "path", value: str = "value", lists: bool = False,
                     sep: str = "/", list_prefix: str = "item_", out: str = "document", errors: str | None = None) -> DataFrame:
    """(ids, document): JSON objects rebuilt from (path, JSON value) rows, keys sorted.

    One shuffle by id brings the leaves of a document, which is a single value, together. A value that is no JSON, or
    paths of which one continues another, end the job; with ``errors`` such a document is NULL and the column of this name says
    what is wrong.
    """

    def build_one(leaves: list[dict]) -> str:
        # of several values of one path the last in order stands
        texts = {tuple(x["p"].split(sep)): _dump(json.loads(x["v"])) for x in sorted(leaves, key=lambda x: (x["p"], x["v"]))}
        return _rebuilt(texts, list_prefix if lists else None)

    def build(rows: pa.Array) -> pa.Array:
        return _results([_tried(build_one, leaves, strict=errors is None) for leaves in rows.to_pylist()], errors)

    # a leaf without a path has no place
    leaf = F.when(F.col(path).isNotNull(), F.struct(F.col(path).alias("p"), F.coalesce(F.col(value), F.lit("null")).alias("v")))
    grouped = df.groupBy(*ids).agg(F.collect_list(leaf).alias("_l"))
    return _with_result(grouped.select(*ids, "_l"), F.arrow_udf(build, _result_type(errors))("_l"), out, errors).drop("_l")


def _result_type(errors: str | None) -> T.DataType:
    return T.StringType() if errors is None else T.StructType([T.StructField("document", T.StringType()), T.StructField("error", T.StringType())])


def _results(found: list[tuple[str | None, str | None]], errors: str | None) -> pa.Array:
    columns = [pa.array(x, pa.string()) for x in (zip(*found) if found else ([], []))]
    return columns[0] if errors is None else pa.StructArray.from_arrays(columns, ["document", "error"])


def _with_result(df: DataFrame, result: Column, out: str, errors: str | None) -> DataFrame:
    if errors is None:
        return df.withColumn(out, result)
    return df.withColumn("_result", result).withColumns({out: F.col("_result.document"), errors: F.col("_result.error")}).drop("_result")


def _leaf_texts(document) -> dict[tuple[str, ...], str]:
    """Path -> JSON text of every leaf of an object; lists and empty objects are leaves."""
    out, todo = {}, [((), document)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict) and (node or not path):
            todo += [((*path, k), v) for k, v in node.items()]
        else:
            out[path] = _dump(node)
    return out


def _laid_over(left, right):
    """The right document over the left one, in place; no recursion, so any depth will do."""
    if not (isinstance(left, dict) and isinstance(right, dict)):
        return right
    todo = [(left, right)]
    while todo:
        below, above = todo.pop()
        for key, value in above.items():
            if isinstance(value, dict) and isinstance(below.get(key), dict):
                todo.append((below[key], value))
            else:
                below[key] = value
    return left


def _document_text(document) -> str:
    try:
        return _dump(document)
    except RecursionError:  # deeper than the encoder goes
        return _rebuilt(_leaf_texts(document))


def deep_merge_params(df: DataFrame, left: str, right: str, out: str = "document", errors: str | None = None) -> DataFrame:
    """Per row, the right JSON document over the left one: objects merge key by key, anything else is replaced.

    So where one side is an object and the other is not, the right one stands. NULL or empty text is an empty object. Text
    that is no JSON ends the job; with ``errors`` the result is NULL and the column of this name says what is wrong.
    """

    def merge_one(a: str | None, b: str | None) -> str:
        return _document_text(_laid_over(*(json.loads(x) if x else {} for x in (a, b))))

    def merge(a: pa.Array, b: pa.Array) -> pa.Array:
        return _results([_tried(merge_one, x, y, strict=errors is None) for x, y in zip(a.to_pylist(), b.to_pylist())], errors)

    return _with_result(df, F.arrow_udf(merge, _result_type(errors))(F.col(left), F.col(right)), out, errors)
