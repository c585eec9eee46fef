"""Nested parameters: each event's flat properties wrapped in an object and a list."""

from pyspark.sql import functions as F

from runquarry.operators import nested as N
from runquarry.plans.registry import query


def _documents(t):
    """{"list":[event_type, user_id],"outer":{"k":…}}; the keys are in sorted order already."""
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.concat(F.lit('{"list":["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit('],"outer":{"k":'), k.cast("string"), F.lit("}}"))
    return t["events"].select("event_id", doc.alias("document"), "event_type", "user_id", "value")


_DOC = """concat('{"list":["', event_type, '",', cast(user_id AS string), '],"outer":{"k":', json_extract_string(props, '$.k'), '}}')"""
_DOCS = f"docs AS (SELECT event_id, {_DOC} AS document FROM events)"


@query("flatten_params", f"""
WITH {_DOCS} SELECT event_id, replace(regexp_replace(regexp_replace(j.fullkey, '^\\$\\.', ''), '\\[([0-9]+)\\]', '/item_\\1', 'g'), '.', '/') AS path,
       json_extract_string(j.atom, '$') AS value FROM docs, json_tree(docs.document) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')""")
def _(t):
    return N.flatten_params(_documents(t), ["event_id"], "document")


@query("flatten_params_dicts", """
SELECT event_id, 'outer/k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL
SELECT event_id, 'list', concat('["', event_type, '",', cast(user_id AS string), ']') FROM events""")
def _(t):
    return N.flatten_params(_documents(t), ["event_id"], "document", lists=False)


@query("unflatten_params", """
SELECT event_id, concat('{"list":{"item_0":"', event_type, '","item_1":', cast(user_id AS string), '},"outer":{"k":',
                        json_extract_string(props, '$.k'), '}}') AS document FROM events""")
def _(t):
    return N.unflatten_params(N.flatten_params(_documents(t), ["event_id"], "document", values="json"), ["event_id"])


@query("unflatten_params_lists", f"SELECT event_id, {_DOC} AS document FROM events")
def _(t):
    return N.unflatten_params(N.flatten_params(_documents(t), ["event_id"], "document", values="json"), ["event_id"], lists=True)


@query("deep_merge_params", """
SELECT event_id, concat('{"list":["new"],"outer":{"k":', json_extract_string(props, '$.k'), ',"type":"', event_type, '"},"user":',
                        cast(user_id AS string), '}') AS document FROM events""")
def _(t):
    right = F.concat(F.lit('{"outer":{"type":"'), "event_type", F.lit('"},"list":["new"],"user":'), F.col("user_id").cast("string"), F.lit("}"))
    merged = N.deep_merge_params(_documents(t).withColumn("right", right), "document", "right", out="merged")
    return merged.select("event_id", F.col("merged").alias("document"))


# Every fifth document is cut off, every fifth is a bare number; the rest are as above.
_BAD = """bad AS (SELECT event_id, event_type, user_id, CASE event_id % 5 WHEN 0 THEN '{"list":[' WHEN 1 THEN cast(user_id AS string) ELSE document END AS document,
    event_id % 5 AS kind FROM (SELECT event_id, event_type, user_id, {0} AS document FROM events))"""


def _bad_documents(t):
    kind = F.col("event_id") % 5
    document = F.when(kind == 0, '{"list":[').when(kind == 1, F.col("user_id").cast("string")).otherwise(F.col("document"))
    return _documents(t).withColumns({"kind": kind, "document": document})


_ERROR = "JSONDecodeError"


def _kind_of_error(c):
    return F.substring_index(c, ":", 1).alias("error")


@query("flatten_params_bad", f"""
WITH {_BAD.replace("{0}", _DOC)} SELECT event_id, 'outer/k' AS path, json_extract_string(document, '$.outer.k') AS value, NULL AS error FROM bad WHERE kind > 1
UNION ALL SELECT event_id, 'list/item_0', event_type, NULL FROM bad WHERE kind > 1
UNION ALL SELECT event_id, 'list/item_1', cast(user_id AS string), NULL FROM bad WHERE kind > 1
UNION ALL SELECT event_id, '', document, NULL FROM bad WHERE kind = 1
UNION ALL SELECT event_id, NULL, NULL, '{_ERROR}' FROM bad WHERE kind = 0""")
def _(t):
    flat = N.flatten_params(_bad_documents(t), ["event_id"], "document", errors="fault")
    return flat.select("event_id", "path", "value", _kind_of_error("fault"))


@query("unflatten_params_bad", f"""
SELECT event_id, CASE event_id % 3 WHEN 2 THEN concat('{{"a":{{"b":', cast(user_id AS string), '}}}}') END AS document,
       CASE event_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN '{_ERROR}' END AS error FROM events""")
def _(t):
    kind, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    deep = F.struct(F.lit("a/b").alias("path"), F.when(kind == 1, "{").otherwise(user).alias("value"))
    high = F.when(kind == 0, F.struct(F.lit("a").alias("path"), F.lit("1").alias("value")))
    leaves = t["events"].select("event_id", F.explode(F.array(deep, high)).alias("l")).where("l IS NOT NULL").select("event_id", "l.*")
    return N.unflatten_params(leaves, ["event_id"], errors="fault").select("event_id", "document", _kind_of_error("fault"))


@query("deep_merge_params_bad", f"""
WITH {_BAD.replace("{0}", _DOC)} SELECT event_id, CASE WHEN kind = 1 THEN '{{"outer":{{"type":1}}}}' WHEN kind > 1 THEN concat('{{"list":["', event_type, '",', cast(user_id AS string),
       '],"outer":{{"k":', json_extract_string(document, '$.outer.k'), ',"type":1}}}}') END AS document, CASE WHEN kind = 0 THEN '{_ERROR}' END AS error FROM bad""")
def _(t):
    merged = N.deep_merge_params(_bad_documents(t).withColumn("right", F.lit('{"outer":{"type":1}}')), "document", "right", out="merged", errors="fault")
    return merged.select("event_id", F.col("merged").alias("document"), _kind_of_error("fault"))
