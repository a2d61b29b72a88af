"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.operators.hierarchy import descendants, flaws, hierarchy
from stewardry.runtime import read


def _tree(spark: SparkSession, sf_dir: str, paths: bool) -> DataFrame:
    return hierarchy(read(spark, sf_dir, "comments"), "id", "parent_comment_id", "thread_id", paths)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flaws(_tree(spark, sf_dir, False)).select(F.col("node").alias("comment_id"), "flaw")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir, True).where(F.col("path").isNotNull())
    return tree.select(F.col("node").alias("comment_id"), "root", "depth", "n_descendants", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_tree(spark, sf_dir, True)).select(F.col("node").alias("comment_id"), F.col("descendant").alias("descendant_id"), "distance")


QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_NODES = "n AS (SELECT DISTINCT id, parent_comment_id AS parent, thread_id AS thread FROM comments WHERE id IS NOT NULL)"
_WALK = f"""{_NODES}, tops AS (SELECT * FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)),
walk AS (SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path, thread AS top_thread, parent IS NOT NULL AS top_missing, thread FROM tops
UNION ALL SELECT n.id, w.root, w.depth + 1, w.path || '/' || n.id, w.top_thread, w.top_missing, n.thread FROM walk w JOIN n ON n.parent = w.id)"""
_ANCESTORS = """up AS (SELECT w.id AS descendant_id, n.parent AS comment_id, 1 AS distance FROM walk w JOIN n ON n.id = w.id WHERE w.depth > 0
UNION ALL SELECT u.descendant_id, n.parent, u.distance + 1 FROM up u JOIN n ON n.id = u.comment_id
JOIN walk w ON w.id = n.id WHERE w.depth > 0)"""

SQL = {
    "p5_found": f"""WITH RECURSIVE {_WALK},
loose AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM walk)),
reach AS (SELECT id AS origin, parent AS here FROM loose UNION SELECT r.origin, l.parent FROM reach r JOIN loose l ON l.id = r.here),
rings AS (SELECT DISTINCT origin AS id FROM reach WHERE origin = here)
SELECT id AS comment_id, 'cycle' AS flaw FROM rings
UNION ALL SELECT id, 'below_cycle' FROM loose WHERE id NOT IN (SELECT id FROM rings)
UNION ALL SELECT id, 'missing_parent' FROM walk WHERE depth = 0 AND top_missing
UNION ALL SELECT id, 'wrong_thread' FROM walk WHERE NOT top_missing AND thread <> top_thread""",
    "p5_paths": f"""WITH RECURSIVE {_WALK}, {_ANCESTORS}
SELECT w.id AS comment_id, w.root, w.depth, coalesce(d.n, 0) AS n_descendants, w.path FROM walk w
LEFT JOIN (SELECT comment_id, count(*) AS n FROM up GROUP BY 1) d ON d.comment_id = w.id""",
    "p5_descendants": f"WITH RECURSIVE {_WALK}, {_ANCESTORS} SELECT comment_id, descendant_id, distance FROM up",
}
