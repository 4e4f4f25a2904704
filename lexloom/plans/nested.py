"""Queries on the nested topic payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.nested import flatten
from lexloom.runtime import Scratch, read

#: Lists whose elements are the cases of p3_found: fixed values.
LISTS = (
    "resultHTML.footNote",
    "resultHTML.attendanceList",
    "resultHTML.atbpList",
    "resultHTML.ptbaList",
    "resultHTML.ptbaList[].periods",
    "resultData.questions",
    "resultData.questions[].supplementaries",
    "resultData.questions[].supplementaries[].replies",
)


def _flat(spark: SparkSession, sf_dir: str):
    return flatten(read(spark, sf_dir, "topic_payloads"), "payload_id", "payload", Scratch(spark, "nested"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = _flat(spark, sf_dir).children
    empty = spark.createDataFrame([], "payload_id long, parent_path string, node_path string")
    parts = [children[x].select("payload_id", F.col("_parent").alias("parent_path"), F.col("_node").alias("node_path")) for x in LISTS if x in children]
    return reduce(DataFrame.unionByName, parts, empty)


def p3_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest child table with its scalar fields."""
    children = _flat(spark, sf_dir).children
    if LISTS[-1] not in children:
        return spark.createDataFrame([], "payload_id long, parent_path string, node_path string, ordinal int, speaker string, text string")
    return children[LISTS[-1]].select("payload_id", F.col("_parent").alias("parent_path"), F.col("_node").alias("node_path"), F.col("_ordinal").alias("ordinal"), "speaker", "text")


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and records of each child table."""
    children = _flat(spark, sf_dir).children
    empty = spark.createDataFrame([], "list_path string, n_rows long, n_records long")
    parts = [df.agg(F.count("*").alias("n_rows"), F.countDistinct("payload_id").alias("n_records")).select(F.lit(x).alias("list_path"), "n_rows", "n_records") for x, df in sorted(children.items())]
    return reduce(DataFrame.unionByName, parts, empty)


QUERIES = {"p3_found": p3_found, "p3_replies": p3_replies, "p3_summary": p3_summary}

_ELEMENTS = """
WITH sound AS (
  SELECT payload_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM topic_payloads WHERE payload IS NOT NULL
), roots AS (
  SELECT payload_id, top, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) ELSE v END AS v
  FROM (SELECT payload_id, 'resultHTML' AS top, j -> 'resultHTML' AS v FROM sound UNION ALL SELECT payload_id, 'resultData', j -> 'resultData' FROM sound)
), firsts AS (
  SELECT payload_id, top AS parent_path, top || '.' || name AS list_path, v -> name AS v FROM roots, (VALUES ('resultHTML','footNote'),('resultHTML','attendanceList'),('resultHTML','atbpList'),('resultHTML','ptbaList'),('resultData','questions')) n(t, name) WHERE t = top
), e1 AS (
  SELECT payload_id, parent_path, list_path || '[' || i || ']' AS node_path, list_path, CASE WHEN json_type(v) = 'ARRAY' THEN v -> CAST(i AS BIGINT) ELSE v END AS v
  FROM (SELECT *, unnest(range(CAST(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) WHEN json_type(v) = 'OBJECT' THEN 1 ELSE 0 END AS BIGINT))) AS i FROM firsts)
), s2 AS (
  SELECT payload_id, node_path AS parent_path, node_path || '.' || name AS list_path, name, v -> name AS v FROM e1, (VALUES ('resultHTML.ptbaList','periods'),('resultData.questions','supplementaries')) n(t, name) WHERE t = list_path AND json_type(v) = 'OBJECT'
), e2 AS (
  SELECT payload_id, parent_path, list_path || '[' || i || ']' AS node_path, name, CASE WHEN json_type(v) = 'ARRAY' THEN v -> CAST(i AS BIGINT) ELSE v END AS v
  FROM (SELECT *, unnest(range(CAST(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) WHEN json_type(v) = 'OBJECT' THEN 1 ELSE 0 END AS BIGINT))) AS i FROM s2)
), s3 AS (
  SELECT payload_id, node_path AS parent_path, node_path || '.replies' AS list_path, v -> 'replies' AS v FROM e2 WHERE name = 'supplementaries' AND json_type(v) = 'OBJECT'
), e3 AS (
  SELECT payload_id, parent_path, list_path || '[' || i || ']' AS node_path, i, CASE WHEN json_type(v) = 'ARRAY' THEN v -> CAST(i AS BIGINT) ELSE v END AS v
  FROM (SELECT *, unnest(range(CAST(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) WHEN json_type(v) = 'OBJECT' THEN 1 ELSE 0 END AS BIGINT))) AS i FROM s3)
)
"""

SQL = {
    "p3_found": _ELEMENTS
    + """
SELECT payload_id, parent_path, node_path FROM e1 WHERE json_type(v) <> 'NULL'
UNION ALL SELECT payload_id, parent_path, node_path FROM e2 WHERE json_type(v) <> 'NULL'
UNION ALL SELECT payload_id, parent_path, node_path FROM e3 WHERE json_type(v) <> 'NULL'
""",
    "p3_replies": _ELEMENTS + "SELECT payload_id, parent_path, node_path, CAST(i AS INTEGER) AS ordinal, v ->> 'speaker' AS speaker, v ->> 'text' AS text FROM e3 WHERE json_type(v) <> 'NULL'",
}
