"""Queries over ownership, access, subject access and erasure, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions import crypt
from stewardry.operators import gdpr
from stewardry.operators.ownership import copies, orphans, owners, ownership_index, reach
from stewardry.plans import ddl, graph
from stewardry.plans.catalog import Catalog
from stewardry.runtime import cut, read

# Annotated schemas over the test tables. Forum tables hold repeated rows, which are dropped.
_SCHEMAS = {
    "trade": """CREATE DATA_SUBJECT TABLE customer (c_custkey INT PRIMARY KEY, c_name TEXT, c_nationkey INT, c_mktsegment TEXT);
CREATE TABLE orders (o_orderkey INT PRIMARY KEY, o_custkey INT OWNED_BY customer(c_custkey), o_orderstatus TEXT, o_orderpriority TEXT);
CREATE TABLE lineitem (l_orderkey INT PRIMARY KEY OWNED_BY orders(o_orderkey), l_partkey INT, l_suppkey INT, l_linenumber INT, l_returnflag TEXT)""",
    "hats": """CREATE DATA_SUBJECT TABLE users (id INT PRIMARY KEY, username TEXT);
CREATE TABLE hats (id INT PRIMARY KEY, user_id INT OWNED_BY users(id), granted_by_user_id INT ACCESSED_BY users(id), hat TEXT, link TEXT,
ON GET granted_by_user_id ANON (link), ON DEL granted_by_user_id ANON (granted_by_user_id, link))""",
    "shared": """CREATE DATA_SUBJECT TABLE users (id INT PRIMARY KEY, username TEXT);
CREATE TABLE hats (id INT PRIMARY KEY, user_id INT OWNED_BY users(id), granted_by_user_id INT OWNED_BY users(id), hat TEXT,
ON DEL user_id ANON (user_id), ON DEL granted_by_user_id ANON (granted_by_user_id))""",
    "drop": """CREATE DATA_SUBJECT TABLE users (id INT PRIMARY KEY, username TEXT);
CREATE TABLE hats (id INT PRIMARY KEY, user_id INT OWNED_BY users(id), granted_by_user_id INT ACCESSED_BY users(id), hat TEXT,
ON GET granted_by_user_id DELETE_ROW, ON DEL granted_by_user_id DELETE_ROW)""",
    "variable": """CREATE DATA_SUBJECT TABLE users (id INT PRIMARY KEY, username TEXT);
CREATE TABLE stories (id INT PRIMARY KEY, title TEXT);
CREATE TABLE comments (id INT PRIMARY KEY, user_id INT OWNED_BY users(id), story_id INT OWNS stories(id))""",
    "reverse": """CREATE DATA_SUBJECT TABLE users (id INT PRIMARY KEY, username TEXT);
CREATE TABLE stories (id INT PRIMARY KEY, user_id INT OWNED_BY users(id), title TEXT);
CREATE TABLE comments (id INT PRIMARY KEY, user_id INT OWNED_BY users(id), story_id INT ACCESSES stories(id))""",
    "replies": """CREATE DATA_SUBJECT TABLE users (id INT PRIMARY KEY, username TEXT);
CREATE TABLE comments (id INT PRIMARY KEY, user_id INT OWNED_BY users(id), parent_comment_id INT ACCESSED_BY comments(id), is_deleted INT)""",
}


@cache
def catalog(name: str) -> Catalog:
    made = Catalog()
    for text in _SCHEMAS[name].split(";"):
        t = ddl.parse(text).table
        graph.validate(made, t)
        made.tables[t.name] = t
    return made


def tables(spark: SparkSession, sf_dir: str, name: str) -> dict[str, DataFrame]:
    out = {}
    for t in catalog(name).tables.values():
        df = read(spark, sf_dir, t.name).select(*t.names)
        out[t.name] = df.distinct() if t.name == "comments" else df
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, schema: str, sql: str | None, query: Callable[[Catalog, dict[str, DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(catalog(schema), tables(spark, sf_dir, schema))
    if sql:
        SQL[name] = sql


_C = "(SELECT DISTINCT id, user_id, story_id, parent_comment_id, is_deleted FROM comments)"

_add("G1_data_subject", "trade", "SELECT c_custkey AS pk, 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS subject FROM customer", lambda c, t: owners(c, t)["customer"])
_add("G2_direct", "trade", "SELECT o_orderkey AS pk, 'customer' AS kind, CAST(o_custkey AS VARCHAR) AS subject FROM orders", lambda c, t: owners(c, t)["orders"])
_add("G3_transitive", "trade", "SELECT DISTINCT l_orderkey AS pk, 'customer' AS kind, CAST(o_custkey AS VARCHAR) AS subject FROM lineitem JOIN orders ON l_orderkey = o_orderkey", lambda c, t: owners(c, t)["lineitem"])
_add("G4_variable", "variable", f"SELECT DISTINCT s.id AS pk, 'users' AS kind, CAST(c.user_id AS VARCHAR) AS subject FROM stories s JOIN {_C} c ON c.story_id = s.id WHERE c.user_id IS NOT NULL", lambda c, t: owners(c, t)["stories"])
_add("G5_accessors", "hats", "SELECT id AS pk, 'granted_by_user_id' AS via FROM hats WHERE granted_by_user_id = 42", lambda c, t: reach(c, t, "users", 42)["hats"][1])
_add(
    "G5_self_reference",
    "replies",
    f"""WITH RECURSIVE c AS {_C}, r AS (SELECT id FROM c WHERE user_id = 24 UNION SELECT c.id FROM c JOIN r ON c.parent_comment_id = r.id)
SELECT id, user_id, parent_comment_id, is_deleted FROM c WHERE id IN (SELECT id FROM r)""",
    lambda c, t: gdpr.get(c, t, "users", 24)["comments"],
)
_add("G6_accesses", "reverse", f"SELECT DISTINCT s.id AS pk FROM stories s JOIN {_C} c ON c.story_id = s.id WHERE c.user_id = 3", lambda c, t: reach(c, t, "users", 3)["stories"][1].select("pk").distinct())
_add("G7_owned_or_seen", "reverse", f"SELECT id, user_id, title FROM stories WHERE user_id = 3 OR id IN (SELECT story_id FROM {_C} WHERE user_id = 3)", lambda c, t: gdpr.get(c, t, "users", 3)["stories"])
_add("G10_distinct_owners", "shared", "SELECT id AS pk, 'users' AS kind, CAST(user_id AS VARCHAR) AS subject FROM hats WHERE user_id IS NOT NULL UNION SELECT id, 'users', CAST(granted_by_user_id AS VARCHAR) FROM hats WHERE granted_by_user_id IS NOT NULL", lambda c, t: owners(c, t)["hats"])
_add("G_index_direct", "trade", "SELECT o_orderpriority AS _col, CAST(o_custkey AS VARCHAR) AS _shard, count(*) AS _c FROM orders GROUP BY 1, 2", lambda c, t: ownership_index(c, t, "orders", "o_orderpriority"))
_add("G_index_transitive", "trade", "SELECT l_partkey AS _col, CAST(o_custkey AS VARCHAR) AS _shard, count(*) AS _c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2", lambda c, t: ownership_index(c, t, "lineitem", "l_partkey"))
_add("G_index_variable", "variable", f"SELECT s.id AS _col, CAST(c.user_id AS VARCHAR) AS _shard, count(*) AS _c FROM stories s JOIN {_C} c ON c.story_id = s.id WHERE c.user_id IS NOT NULL GROUP BY 1, 2", lambda c, t: ownership_index(c, t, "stories", "id"))
_add("S7_shard_scan", "trade", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7", lambda c, t: t["orders"].join(owners(c, t)["orders"].where("subject = '7'").select(F.col("pk").alias("o_orderkey")), "o_orderkey", "left_semi"))
_add("S6_direct_lookup", "trade", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7 AND o_orderkey > 100", lambda c, t: t["orders"].where("o_custkey = 7 AND o_orderkey > 100"))
_add("G20_get_direct", "trade", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey = 7", lambda c, t: gdpr.get(c, t, "customer", 7)["orders"])
_add("G20_get_transitive", "trade", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)", lambda c, t: gdpr.get(c, t, "customer", 7)["lineitem"])
_add("G20_get_variable", "variable", f"SELECT id, title FROM stories WHERE id IN (SELECT story_id FROM {_C} WHERE user_id = 12)", lambda c, t: gdpr.get(c, t, "users", 12)["stories"])
_add(
    "G21_reached_through",
    "hats",
    "SELECT id AS pk, concat_ws(',', CASE WHEN granted_by_user_id = 42 THEN 'granted_by_user_id' END, CASE WHEN user_id = 42 THEN 'user_id' END) AS via FROM hats WHERE user_id = 42 OR granted_by_user_id = 42",
    lambda c, t: reach(c, t, "users", 42)["hats"][0].unionByName(reach(c, t, "users", 42)["hats"][1]).groupBy("pk").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via")),
)
_add("G22_get_anonymised", "hats", "SELECT id, user_id, granted_by_user_id, hat, CASE WHEN coalesce(granted_by_user_id = 42, false) THEN NULL ELSE link END AS link FROM hats WHERE user_id = 42 OR granted_by_user_id = 42", lambda c, t: gdpr.get(c, t, "users", 42)["hats"])
_add("G23_get_without_rows", "drop", "SELECT id, user_id, granted_by_user_id, hat FROM hats WHERE user_id = 42 AND coalesce(granted_by_user_id <> 42, true)", lambda c, t: gdpr.get(c, t, "users", 42)["hats"])
_add("G24_forget_direct", "trade", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey <> 7", lambda c, t: gdpr.forget(c, t, "customer", 7).tables["orders"])
_add("G24_forget_transitive", "trade", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)", lambda c, t: gdpr.forget(c, t, "customer", 7).tables["lineitem"])
_add(
    "G24_forget_variable",
    "variable",
    f"""SELECT id, title FROM stories WHERE NOT (id IN (SELECT story_id FROM {_C} WHERE user_id = 12)
AND id NOT IN (SELECT story_id FROM {_C} WHERE user_id <> 12 AND story_id IS NOT NULL))""",
    lambda c, t: gdpr.forget(c, t, "users", 12).tables["stories"],
)
_add(
    "G24_forget_count",
    "trade",
    "SELECT (SELECT count(*) FROM customer WHERE c_custkey = 7) + (SELECT count(*) FROM orders WHERE o_custkey = 7) + (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)) AS n",
    lambda c, t: gdpr.forget(c, t, "customer", 7).count,
)
_add(
    "G25_forget_anonymised",
    "hats",
    """SELECT id, user_id, CASE WHEN coalesce(granted_by_user_id = 42, false) THEN NULL ELSE granted_by_user_id END AS granted_by_user_id, hat,
CASE WHEN coalesce(granted_by_user_id = 42, false) THEN NULL ELSE link END AS link FROM hats WHERE coalesce(user_id <> 42, true)""",
    lambda c, t: gdpr.forget(c, t, "users", 42).tables["hats"],
)
_add(
    "G25_forget_shared",
    "shared",
    """SELECT id, CASE WHEN coalesce(user_id = 42, false) THEN NULL ELSE user_id END AS user_id, CASE WHEN coalesce(granted_by_user_id = 42, false) THEN NULL ELSE granted_by_user_id END AS granted_by_user_id, hat
FROM hats WHERE NOT (coalesce(user_id = 42, false) AND coalesce(granted_by_user_id, 42) = 42 OR coalesce(granted_by_user_id = 42, false) AND coalesce(user_id, 42) = 42)""",
    lambda c, t: gdpr.forget(c, t, "users", 42).tables["hats"],
)
_add("G26_forget_drops_rows", "drop", "SELECT id, user_id, granted_by_user_id, hat FROM hats WHERE coalesce(user_id <> 42, true) AND coalesce(granted_by_user_id <> 42, true)", lambda c, t: gdpr.forget(c, t, "users", 42).tables["hats"])
_add("G28_references_may_dangle", "replies", f"SELECT id, user_id, parent_comment_id, is_deleted FROM {_C} WHERE coalesce(user_id <> 24, true)", lambda c, t: gdpr.forget(c, t, "users", 24).tables["comments"])
_add("G29_orphans", "variable", f"SELECT id, title FROM stories WHERE id NOT IN (SELECT story_id FROM {_C} WHERE story_id IS NOT NULL AND user_id IS NOT NULL)", lambda c, t: orphans(c, t, "stories"))
_add("G30_copies", "variable", f"SELECT s.id AS pk, coalesce('users/' || c.user_id, 'default') AS shard FROM stories s LEFT JOIN (SELECT DISTINCT story_id, user_id FROM {_C} WHERE user_id IS NOT NULL) c ON c.story_id = s.id", lambda c, t: copies(c, t)["stories"])
_add("G33_shards", "trade", "SELECT 'customer/' || o_custkey AS shard, count(*) AS n FROM orders GROUP BY 1", lambda c, t: copies(c, t)["orders"].groupBy("shard").agg(F.count(F.lit(1)).alias("n")))


def _compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, *row) for name in _SCHEMAS for row in graph.explain_compliance(catalog(name))]
    return spark.createDataFrame(rows, "schema string, table string, status string, level string, text string")


def _encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through encryption under one key per customer and back."""
    orders = tables(spark, sf_dir, "trade")["orders"]
    keys = cut(crypt.new_keys(orders, "o_custkey"))
    secret = cut(crypt.encrypt(orders, "o_custkey", ["o_orderstatus", "o_orderpriority"], keys))
    return crypt.decrypt(secret, "o_custkey", {"o_orderstatus": "string", "o_orderpriority": "string"}, keys)


QUERIES |= {"G31_explain_compliance": _compliance, "G34_encryption_round_trip": _encrypted}
SQL["G34_encryption_round_trip"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"

# written by hand from the schemas: each table's status, its ways to data subjects, and that all of these may be null
_WAYS = {
    ("trade", "orders"): ["o_custkey leads to customer at distance 1 (as declared) via orders(o_custkey) -> customer(c_custkey)"],
    ("trade", "lineitem"): ["l_orderkey leads to customer at distance 2 (as declared) via lineitem(l_orderkey) -> orders(o_orderkey) -> orders(o_custkey) -> customer(c_custkey)"],
    ("hats", "hats"): ["user_id leads to users at distance 1 (as declared) via hats(user_id) -> users(id)"],
    ("shared", "hats"): ["user_id leads to users at distance 1 (as declared) via hats(user_id) -> users(id)", "granted_by_user_id leads to users at distance 1 (as declared) via hats(granted_by_user_id) -> users(id)"],
    ("drop", "hats"): ["user_id leads to users at distance 1 (as declared) via hats(user_id) -> users(id)"],
    ("variable", "stories"): ["comments(story_id) leads to users at distance 2 (as declared) via comments(story_id) -> comments(user_id) -> users(id)"],
    ("variable", "comments"): ["user_id leads to users at distance 1 (as declared) via comments(user_id) -> users(id)"],
    ("reverse", "stories"): ["user_id leads to users at distance 1 (as declared) via stories(user_id) -> users(id)"],
    ("reverse", "comments"): ["user_id leads to users at distance 1 (as declared) via comments(user_id) -> users(id)"],
    ("replies", "comments"): ["user_id leads to users at distance 1 (as declared) via comments(user_id) -> users(id)"],
}
_SUBJECTS = (("trade", "customer"), ("hats", "users"), ("shared", "users"), ("drop", "users"), ("variable", "users"), ("reverse", "users"), ("replies", "users"))
_NULLABLE = "every way to an owner may be null, so rows may have none"
_FOUND = [(s, t, "DATASUBJECT", "status", "DATASUBJECT") for s, t in _SUBJECTS] + [
    (s, t, "SHARDED", level, text) for (s, t), ways in _WAYS.items() for level, text in (("status", "SHARDED"), *(("path", w) for w in ways), ("warning", _NULLABLE))
]
SQL["G31_explain_compliance"] = 'SELECT * FROM (VALUES ' + ", ".join(str(row) for row in _FOUND) + ') v("schema", "table", status, level, text)'
