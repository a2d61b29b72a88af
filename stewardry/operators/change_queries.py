"""Queries of data changes and incremental maintenance: each returns the state after the change, and its SQL computes that state anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.operators import dml
from stewardry.operators import relational as R
from stewardry.operators.ownership_queries import catalog, tables
from stewardry.plans import ddl, delta
from stewardry.runtime import ensure_checkpoint_dir, read
from stewardry.session import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _statement(name: str, schema: str, text: str, sql: str) -> None:
    """A DML statement's new contents of its table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, c, t = ddl.parse(text), catalog(schema), tables(spark, sf_dir, schema)
        if s.what == "insert":
            return dml.insert(c, t, s.name, s.columns, s.values, {}).contents
        if s.what == "replace":
            return dml.replace(c, t, s.name, s.columns, s.values, {}).contents
        return (dml.update(c, t, s.name, s.sets, s.where) if s.what == "update" else dml.delete(c, t, s.name, s.where)).contents

    QUERIES[name], SQL[name] = query, sql


_O = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"
_statement("D1_insert", "trade", "INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus) VALUES (99000001, 7, 'N')", f"SELECT {_O} FROM orders UNION ALL SELECT 99000001, 7, 'N', NULL")
_statement("D2_replace", "trade", "REPLACE INTO customer VALUES (7, 'nobody', 3, NULL)", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'nobody' ELSE c_name END AS c_name, CASE WHEN c_custkey = 7 THEN 3 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey = 7 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
_statement("D3_update", "trade", "UPDATE lineitem SET l_suppkey = l_suppkey + 1, l_returnflag = 'X' WHERE l_linenumber = 2 AND l_returnflag IN ('A', 'R')", "SELECT l_orderkey, l_partkey, l_suppkey + CASE WHEN l_linenumber = 2 AND l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END AS l_suppkey, l_linenumber, CASE WHEN l_linenumber = 2 AND l_returnflag IN ('A', 'R') THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem")
_statement("D3_update_owner", "trade", "UPDATE orders SET o_custkey = 7 WHERE o_custkey = 8", "SELECT o_orderkey, CASE WHEN o_custkey = 8 THEN 7 ELSE o_custkey END AS o_custkey, o_orderstatus, o_orderpriority FROM orders")
_statement("D4_delete", "trade", "DELETE FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'")


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables(spark, sf_dir, "trade")["orders"]
    return dml.upsert(orders, orders.where("o_orderstatus = 'F'").withColumn("o_orderpriority", F.lit("none")), "o_orderkey")


QUERIES["D5_bulk_upsert"] = _bulk
SQL["D5_bulk_upsert"] = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderpriority END AS o_orderpriority FROM orders"


# --- incremental maintenance: a table in its old state, and the change that leads to the stored one

#: Rows that the old state lacks, and rows of the stored state that the change takes away.
_NEW, _GONE = "created_at >= TIMESTAMP_NTZ '2024-06-01 00:00:00'", "is_deleted = 1"
_NOW = "(SELECT * FROM comments WHERE is_deleted IS DISTINCT FROM 1)"


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "comments").select("id", "user_id", "story_id", "hat_id", "upvotes", "is_deleted", "created_at")
    new = F.coalesce(F.expr(_NEW), F.lit(False))
    change = delta.weighted(rows.where(new)).unionByName(delta.weighted(rows.where(_GONE), -1))
    return rows.where(~new), change


def _maintained(name: str, sql: str, query: Callable[[DataFrame, DataFrame, Callable[[str], DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(*_changed(spark, sf_dir), lambda table: read(spark, sf_dir, table))
    SQL[name] = sql.replace("NOW", _NOW)


def _distinct_after(rows: DataFrame, d: DataFrame) -> DataFrame:
    narrow = rows.select("user_id", "story_id")
    return delta.apply(narrow.distinct(), delta.distinct(narrow, delta.select(d, "user_id", "story_id")))


def _later(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as it was before June 2024 and what has been added since."""
    new = F.coalesce(F.expr(_NEW), F.lit(False))
    return df.where(~new), delta.weighted(df.where(new))


def _join_after(rows: DataFrame, d: DataFrame, t) -> DataFrame:
    left, change = rows.select("id", "story_id"), delta.select(d, "id", "story_id")
    right, added = (x.withColumnRenamed("id", "story_id").select("story_id", "title", *{delta.W} & set(x.columns)) for x in _later(t("stories")))
    return delta.apply(left.join(right, "story_id"), delta.join(left, change, right, added, "story_id"))


def _left_after(rows: DataFrame, d: DataFrame, t) -> DataFrame:
    hats, added = (x.withColumnRenamed("id", "hat_id").select("hat_id", "hat", *{delta.W} & set(x.columns)) for x in _later(t("hats")))
    change, right = delta.select(d, "id", "hat_id"), rows.select("id", "hat_id")
    return delta.apply(hats.join(right, "hat_id", "left"), delta.outer_join(hats, added, right, change, "hat_id"))


def _aggregate_after(rows: DataFrame, d: DataFrame, groups: list[str]) -> DataFrame:
    return delta.aggregate(delta.aggregate_state(rows, groups, "upvotes"), d, groups, "upvotes")[0]


def _top_after(rows: DataFrame, d: DataFrame) -> DataFrame:
    narrow, change = rows.select("story_id", "upvotes", "id"), delta.select(d, "story_id", "upvotes", "id")
    order = [F.col("upvotes").desc_nulls_last(), F.col("id")]
    return delta.apply(R.top_per_key(narrow, ["story_id"], order, 3), delta.top(narrow, change, ["story_id"], order, 3))


_maintained("S9_apply", "SELECT id, user_id FROM NOW", lambda rows, d, t: delta.apply(rows.select("id", "user_id"), delta.select(d, "id", "user_id")))
_maintained("DELTA_filter_project", "SELECT id, upvotes FROM NOW WHERE upvotes > 3", lambda rows, d, t: delta.apply(rows.where("upvotes > 3").select("id", "upvotes"), delta.select(delta.where(d, F.col("upvotes") > 3), "id", "upvotes")))
_maintained("J6_join_delta", "SELECT c.story_id, c.id, s.title FROM NOW c JOIN stories s ON s.id = c.story_id", _join_after)
_maintained("DELTA_left_join", "SELECT h.id AS hat_id, h.hat, c.id FROM hats h LEFT JOIN NOW c ON c.hat_id = h.id", _left_after)
_maintained("A8_retraction", "SELECT user_id, count(*) AS n, CAST(sum(upvotes) AS BIGINT) AS total, count(upvotes) AS known FROM NOW GROUP BY 1", lambda rows, d, t: _aggregate_after(rows, d, ["user_id"]))
_maintained(
    "A9_changed_groups",
    """WITH old AS (SELECT story_id, count(*) AS n FROM comments WHERE NOT coalesce(created_at >= TIMESTAMP '2024-06-01', false) GROUP BY 1), new AS (SELECT story_id, count(*) AS n FROM NOW GROUP BY 1)
SELECT story_id, n, CAST(-1 AS BIGINT) AS _w FROM (FROM old EXCEPT FROM new) UNION ALL SELECT story_id, n, 1 FROM (FROM new EXCEPT FROM old)""",
    lambda rows, d, t: delta.aggregate(delta.aggregate_state(rows, ["story_id"]), d, ["story_id"])[1],
)
_maintained("DELTA_distinct", "SELECT DISTINCT user_id, story_id FROM NOW", lambda rows, d, t: _distinct_after(rows, d))
_maintained("DELTA_union", "SELECT id FROM NOW UNION ALL SELECT id FROM stories", lambda rows, d, t: delta.apply(R.union(rows.select("id"), t("stories").select("id")), delta.select(d, "id")))
_maintained("DELTA_top_per_key", "SELECT story_id, upvotes, id FROM NOW QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY upvotes DESC NULLS LAST, id) <= 3", lambda rows, d, t: _top_after(rows, d))


# --- stored views of the engine: loaded, changed by a statement, and read from what is stored -----------------------

_FORUM = """CREATE DATA_SUBJECT TABLE person (id INT PRIMARY KEY);
CREATE TABLE remark (id INT PRIMARY KEY, who INT OWNED_BY person(id), story INT, up INT);
CREATE VIEW liked AS '"SELECT id, who, story, up FROM remark WHERE up > 1"';
CREATE VIEW per_story AS '"SELECT story, COUNT(*) AS n, SUM(up) AS up FROM liked GROUP BY story"';
CREATE VIEW busy AS '"SELECT r.id, r.who, p.n FROM liked r JOIN per_story p ON r.story = p.story WHERE p.n > 2"'"""
_REMARKS = "remark AS (SELECT DISTINCT id, user_id AS who, story_id AS story, upvotes AS up FROM comments WHERE id IS NOT NULL AND user_id IS NOT NULL)"
_BUSY = """liked AS (SELECT * FROM after WHERE up > 1), per_story AS (SELECT story, count(*) AS n FROM liked GROUP BY 1)
SELECT r.id, r.who, p.n FROM liked r JOIN per_story p USING (story) WHERE p.n > 2"""


def _stored(name: str, statement: str, after: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        engine = Engine(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/engine-{uuid.uuid4()}")
        engine.script(_FORUM)
        rows = read(spark, sf_dir, "comments").where("id IS NOT NULL AND user_id IS NOT NULL")
        engine.load("person", rows.select(F.col("user_id").alias("id")).distinct())
        engine.load("remark", rows.select("id", F.col("user_id").alias("who"), F.col("story_id").alias("story"), F.col("upvotes").alias("up")).distinct())
        engine.materialise("busy")
        engine.sql(statement)
        return engine.sql("SELECT * FROM busy").df

    QUERIES[name], SQL[name] = query, f"WITH {_REMARKS}, after AS ({after}), {_BUSY}"


_stored("D1_stored_view", "INSERT INTO remark VALUES (99999999, 3, 1, 50)", "FROM remark UNION ALL SELECT 99999999, 3, 1, 50")
_stored("D3_stored_view", "UPDATE remark SET up = up - 2 WHERE who = 3", "SELECT id, who, story, CASE WHEN who = 3 THEN coalesce(up, 0) - 2 ELSE up END AS up FROM remark")
_stored("D4_stored_view", "DELETE FROM remark WHERE story = 1", "FROM remark WHERE story IS DISTINCT FROM 1")
_stored("G24_stored_view", "GDPR FORGET person 3", "FROM remark WHERE who <> 3")
