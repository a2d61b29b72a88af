"""Queries of problem 3 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.operators.skew import chunk_count, heavy_keys, tree_aggregate, tree_latest, unpivot_keys
from stewardry.runtime import read

FIELDS = ("user_id", "story_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(read(spark, sf_dir, "comments"), FIELDS, 0.02).select("key_field", "key_value")


_TOTALS = {"n_rows": ("count", None), "sum_upvotes": ("sum", "upvotes"), "first_at": ("min", "created_at"), "last_at": ("max", "created_at")}


def p3_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = read(spark, sf_dir, "comments")
    rows = unpivot_keys(comments, FIELDS, [F.col("upvotes"), F.col("created_at")])
    return tree_aggregate(rows, ["key_field", "key_value"], _TOTALS, chunks=chunk_count(comments, per_row=len(FIELDS)))


def p3_tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals through a tree of three levels and more: small chunks, four states to a merge."""
    rows = unpivot_keys(read(spark, sf_dir, "comments"), FIELDS, [F.col("upvotes"), F.col("created_at")])
    return tree_aggregate(rows, ["key_field", "key_value"], _TOTALS, chunk_rows=256, fan_in=4)


def p3_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = read(spark, sf_dir, "comments")
    rows = unpivot_keys(comments, FIELDS, [F.col("created_at"), F.col("id")])
    return tree_latest(rows, ["key_field", "key_value"], ["created_at", "id"], 3, chunks=chunk_count(comments, per_row=len(FIELDS)))


QUERIES = {"p3_found": p3_found, "p3_key_totals": p3_key_totals, "p3_tree_levels": p3_tree_levels, "p3_latest_rows": p3_latest_rows}

_BOTH = """SELECT 'user_id' AS key_field, user_id AS key_value, id, created_at, upvotes FROM comments
UNION ALL SELECT 'story_id', story_id, id, created_at, upvotes FROM comments"""

SQL = {
    "p3_found": f"""SELECT key_field, key_value FROM ({_BOTH}) WHERE key_value IS NOT NULL GROUP BY 1, 2
HAVING count(*) >= 0.02 * (SELECT count(*) FROM comments)""",
    "p3_key_totals": f"""SELECT key_field, key_value, count(*) AS n_rows, CAST(sum(upvotes) AS BIGINT) AS sum_upvotes,
min(created_at) AS first_at, max(created_at) AS last_at FROM ({_BOTH}) GROUP BY 1, 2""",
    "p3_latest_rows": f"""SELECT key_field, key_value, created_at, id, CAST(rank AS INTEGER) AS rank FROM (
SELECT key_field, key_value, created_at, id, row_number() OVER (PARTITION BY key_field, key_value
ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST) AS rank FROM ({_BOTH})) WHERE rank <= 3""",
}
SQL["p3_tree_levels"] = SQL["p3_key_totals"]
