"""One query per operator of scans, projections, filters, joins, aggregates, sorting and set operations, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.functions.compat import is_in, plus, text_order
from stewardry.operators import relational as R
from stewardry.runtime import ensure_checkpoint_dir, read
from stewardry.session import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, query: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(lambda table: read(spark, sf_dir, table))
    SQL[name] = sql


def session(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> Engine:
    """An engine that reads the given tables where they are."""
    ensure_checkpoint_dir(spark)
    engine = Engine(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/session-{uuid.uuid4()}")
    for t in tables:
        engine.attach(t, read(spark, sf_dir, t))
    return engine


def _sql(name: str, text: str, tables: tuple[str, ...], oracle: str | None = None, args: list | None = None) -> None:
    """A statement through the engine."""
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir, tables).sql(text, args).df
    SQL[name] = text if oracle is None else oracle


def _view(name: str, text: str, oracle: str, tables: tuple[str, ...], where: str = "", read_by: Callable[[Engine], DataFrame] | None = None) -> None:
    """A view of the engine: the text's own semantics, parameters as keys; read by a statement or by ``lookup``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = session(spark, sf_dir, tables)
        engine.sql(f"CREATE VIEW _v AS '\"{text}\"'")
        return read_by(engine) if read_by else engine.sql(f"SELECT * FROM _v{' WHERE ' + where if where else ''}").df

    QUERIES[name], SQL[name] = query, oracle


# scans and view reads
_sql("S1_scan", "SELECT * FROM nation", ("nation",))
_add("S3_first_copies", "SELECT DISTINCT id, user_id, story_id, upvotes FROM comments", lambda t: R.first_copies(t("comments").select("id", "user_id", "story_id", "upvotes"), "id"))
_sql("S4_key_lookup", "SELECT * FROM orders WHERE o_orderkey IN (7, 77, 777)", ("orders",))
_sql("S5_index_lookup", "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)", ("customer",))
_sql("S8_get_all", "SELECT * FROM supplier", ("supplier",))
_add("S10_lookup_keys", "SELECT id, user_id, hat_id FROM comments WHERE user_id IN (3, 5) AND (hat_id IS NULL OR hat_id = 1)", lambda t: R.lookup(t("comments").select("id", "user_id", "hat_id"), {"user_id": [3, 5], "hat_id": [None, 1]}))
_add("S10_lookup_greater", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 10 OFFSET 5", lambda t: R.lookup_greater(t("orders").select("o_orderkey", "o_custkey"), {"o_orderkey": 500}, ["o_orderkey"], 10, 5))

# projections
_sql("P1_rename", "SELECT o_orderkey AS k, o_custkey FROM orders", ("orders",))
_add("P2_literals", "SELECT n_name, CAST(1 AS BIGINT) AS one, 'x' AS word FROM nation", lambda t: t("nation").select("n_name", F.lit(1).cast("bigint").alias("one"), F.lit("x").alias("word")))
_SUM = "CASE WHEN upvotes IS NULL AND hat_id IS NULL THEN NULL ELSE coalesce(upvotes, 0) {} coalesce(hat_id, 0) END"
_sql("P3_column_plus_column", "SELECT id, upvotes + hat_id AS v FROM comments", ("comments",), f"SELECT id, {_SUM.format('+')} AS v FROM comments")
_sql("P3_column_minus_column", "SELECT id, upvotes - hat_id AS v FROM comments", ("comments",), f"SELECT id, {_SUM.format('-')} AS v FROM comments")
_sql("P4_column_plus_literal", "SELECT id, hat_id + 5 AS v FROM comments", ("comments",), "SELECT id, coalesce(hat_id, 0) + 5 AS v FROM comments")
_sql("P5_literal_minus_column", "SELECT id, 5 - hat_id AS v FROM comments", ("comments",), "SELECT id, 5 - coalesce(hat_id, 0) AS v FROM comments")
_add("P6_integer_result", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) + l_orderkey AS v FROM lineitem", lambda t: t("lineitem").select("l_orderkey", plus("l_linenumber", "l_orderkey").alias("v")))
_view("P7_identity", "SELECT * FROM region", "SELECT * FROM region", ("region",))
_add("P8_literal_name", "SELECT r_name, 1 AS \"1\" FROM region", lambda t: t("region").select("r_name", F.lit(1).alias("1")))
_add("P9_column_once", "SELECT o_orderkey, o_custkey FROM orders", lambda t: t("orders").select(*dict.fromkeys(["o_orderkey", "o_custkey", "o_orderkey"])))
_sql("P10_identity", "SELECT * FROM part", ("part",))

# filters
for _n, _sign in {"less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "equal": "=", "not_equal": "<>"}.items():
    _sql(f"F1_{_n}", f"SELECT id, hat_id FROM comments WHERE hat_id {_sign} 9", ("comments",))
_sql("F1_null", "SELECT id FROM comments WHERE hat_id IS NULL AND parent_comment_id IS NOT NULL", ("comments",))
_sql("F2_columns", "SELECT id FROM comments WHERE upvotes > downvotes", ("comments",))
_sql("F3_null_is_rejected", "SELECT id FROM comments WHERE hat_id <> 3", ("comments",))
_sql("F4_literal_left", "SELECT id FROM comments WHERE 2 < upvotes", ("comments",))
_view("F5_equals_null", "SELECT id FROM comments WHERE hat_id = NULL AND parent_comment_id <> NULL", "SELECT id FROM comments WHERE hat_id IS NULL AND parent_comment_id IS NOT NULL", ("comments",))
_view("F6_or", "SELECT id FROM comments WHERE upvotes > 5 OR hat_id = 2", "SELECT id FROM comments WHERE upvotes > 5 OR hat_id = 2", ("comments",))
_view("F7_and_or", "SELECT id FROM comments WHERE is_deleted = 0 AND (upvotes > 5 OR (hat_id = 2 AND story_id < 100))", "SELECT id FROM comments WHERE is_deleted = 0 AND (upvotes > 5 OR (hat_id = 2 AND story_id < 100))", ("comments",))
_view("F8_arithmetic", "SELECT id FROM comments WHERE upvotes - downvotes > 3", "SELECT id FROM comments WHERE upvotes - downvotes > 3", ("comments",))
_view("F9_parameter_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ?", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7", ("orders",), "o_custkey = 7")
_view("F10_parameter_bound", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > ?", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100", ("orders",), "o_orderkey >= 100")
_view("F11_having", "SELECT story_id, COUNT(*) AS n FROM comments GROUP BY story_id HAVING n > 10", "SELECT story_id, count(*) AS n FROM comments GROUP BY story_id HAVING count(*) > 10", ("comments",))
_view("F11_having_key", "SELECT user_id, COUNT(*) FROM comments GROUP BY user_id HAVING user_id = ?", "SELECT user_id, count(*) AS \"Count\" FROM comments WHERE user_id = 3 GROUP BY user_id", ("comments",), "user_id = 3")
_add("F12_in_with_null", "SELECT id FROM comments WHERE hat_id IN (1, 2) OR hat_id IS NULL", lambda t: t("comments").where(is_in("hat_id", [1, 2, None])).select("id"))
_add("F13_view_read", "SELECT id, user_id FROM comments WHERE user_id IN (1, 4) AND id >= 900", lambda t: R.lookup_greater(R.lookup(t("comments").select("id", "user_id"), {"user_id": [1, 4]}), {"id": 900}, ["id"]))
_add("F14_key_product", "SELECT id, user_id, story_id FROM comments WHERE user_id IN (3, 7) AND story_id IN (1, 2, 3)", lambda t: R.lookup(t("comments").select("id", "user_id", "story_id"), {"user_id": [3, 7], "story_id": [1, 2, 3]}))

# parameters that must not be lifted, bounds by their signs, and limits that hold for each key
_view("F9_or", "SELECT id, user_id FROM comments WHERE user_id = ? OR hat_id = 1", "SELECT id, user_id FROM comments WHERE user_id = 3 OR hat_id = 1", ("comments",), read_by=lambda e: e.lookup("_v", [3]))
_view("F9_not", "SELECT id, user_id FROM comments WHERE NOT user_id = ?", "SELECT id, user_id FROM comments WHERE NOT user_id = 3", ("comments",), read_by=lambda e: e.lookup("_v", [3]))
_view(
    "F9_outer_join",
    "SELECT c.id, h.hat FROM comments c LEFT JOIN hats h ON c.hat_id = h.id AND h.user_id = ?",
    "SELECT c.id, h.hat FROM comments c LEFT JOIN hats h ON c.hat_id = h.id AND h.user_id = (SELECT min(user_id) FROM hats)",
    ("comments", "hats"),
    read_by=lambda e: e.lookup("_v", [e.table("hats").agg(F.min("user_id")).first()[0]]),
)
_view("F9_inner_limit", "SELECT count(*) AS n FROM (SELECT id FROM comments WHERE user_id = ? ORDER BY id LIMIT 5) x", "SELECT count(*) AS n FROM (SELECT id FROM comments WHERE user_id = 3 ORDER BY id LIMIT 5) x", ("comments",), read_by=lambda e: e.lookup("_v", [3]))
_view("F9_several_values", "SELECT id FROM comments WHERE user_id = ? OR user_id = ?", "SELECT id FROM comments WHERE user_id IN (3, 4) UNION ALL SELECT id FROM comments WHERE user_id IN (3, 5)", ("comments",), read_by=lambda e: e.lookup("_v", [3, [4, 5]]))
_view("F9_union", "SELECT id, user_id FROM comments WHERE user_id = ? UNION SELECT id, user_id FROM stories WHERE user_id = ?", "SELECT id, user_id FROM comments WHERE user_id = 3 UNION SELECT id, user_id FROM stories WHERE user_id = 3", ("comments", "stories"), "user_id = 3")
_view(
    "O4_keyed_limit",
    "SELECT id, user_id, created_at FROM comments WHERE user_id = ? ORDER BY created_at DESC, id LIMIT 3",
    "SELECT DISTINCT id, user_id, created_at FROM comments WHERE user_id IN (3, 5, 7) QUALIFY dense_rank() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 3",
    ("comments",),
    read_by=lambda e: e.lookup("_v", [[3, 5, 7]]).distinct(),
)
_view(
    "O4_keyed_limit_of_groups",
    "SELECT user_id, story_id, COUNT(*) AS n FROM comments WHERE user_id = ? GROUP BY user_id, story_id ORDER BY n DESC, story_id LIMIT 4",
    "SELECT user_id, story_id, count(*) AS n FROM comments WHERE user_id IN (3, 5) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, story_id NULLS FIRST) <= 4",
    ("comments",),
    "user_id IN (3, 5)",
)
_view("F10_less", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < ?", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 28", ("orders",), read_by=lambda e: e.lookup("_v", greater={"o_orderkey": 28}))
_view("F10_less_equal", "SELECT o_orderkey, o_custkey FROM orders WHERE ? >= o_orderkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 28", ("orders",), read_by=lambda e: e.lookup("_v", greater={"o_orderkey": 28}))
_view("O6_limit_at_read", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > ? LIMIT ? OFFSET ?", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 7 OFFSET 2", ("orders",), read_by=lambda e: e.lookup("_v", greater={"o_orderkey": 500}, limit=7, offset=2))
_sql("O9_base_limit", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 6", ("nation",))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that reads views, keyed by a column of its own."""
    engine = session(spark, sf_dir, ("comments", "stories"))
    engine.sql("CREATE VIEW _per_story AS '\"SELECT story_id, COUNT(*) AS n, SUM(upvotes) AS up FROM comments GROUP BY story_id\"'")
    engine.sql("CREATE VIEW _titled AS '\"SELECT s.id, s.user_id, p.n, p.up FROM stories s JOIN _per_story p ON s.id = p.story_id\"'")
    engine.sql("CREATE VIEW _v AS '\"SELECT user_id, SUM(n) AS n FROM _titled GROUP BY user_id HAVING user_id = ?\"'")
    return engine.lookup("_v", [[1, 2, 3, 4, 5]])


QUERIES["S2_nested_views"] = _nested
SQL["S2_nested_views"] = """SELECT s.user_id, CAST(sum(p.n) AS BIGINT) AS n FROM stories s JOIN (SELECT story_id, count(*) AS n FROM comments GROUP BY 1) p ON s.id = p.story_id
WHERE s.user_id BETWEEN 1 AND 5 GROUP BY 1"""

# joins
_JC, _JS = ("id", "story_id", "hat_id"), ("id", "title")
_stories = lambda t: t("stories").select(F.col("id").alias("s_id"), "title", "user_id")
_comments = lambda t: t("comments").select("id", "story_id", "hat_id")
_hats = lambda t: t("hats").select(F.col("id").alias("h_id"), "hat")
_add("J1_inner", "SELECT c.id, c.story_id, c.hat_id, s.title, s.user_id FROM comments c JOIN stories s ON c.story_id = s.id", lambda t: R.join(_comments(t), _stories(t), "story_id", "s_id"))
_add("J2_left", "SELECT c.id, c.story_id, c.hat_id, h.hat FROM comments c LEFT JOIN hats h ON c.hat_id = h.id", lambda t: R.join(_comments(t), _hats(t), "hat_id", "h_id", "left"))
_add("J3_right", "SELECT c.id, c.story_id, coalesce(c.hat_id, h.id) AS hat_id, h.hat FROM comments c RIGHT JOIN hats h ON c.hat_id = h.id", lambda t: R.join(_comments(t), _hats(t), "hat_id", "h_id", "right"))
_view("J4_right_key_dropped", "SELECT c.id, c.story_id, s.title FROM comments c JOIN stories s ON c.story_id = s.id", "SELECT c.id, c.story_id, s.title FROM comments c JOIN stories s ON c.story_id = s.id", ("comments", "stories"))
_view(
    "J5_four_way",
    "SELECT c.id, s.title, u.username, h.hat FROM comments c JOIN stories s ON c.story_id = s.id JOIN users u ON c.user_id = u.id LEFT JOIN hats h ON c.hat_id = h.id",
    "SELECT c.id, s.title, u.username, h.hat FROM comments c JOIN stories s ON c.story_id = s.id JOIN users u ON c.user_id = u.id LEFT JOIN hats h ON c.hat_id = h.id",
    ("comments", "stories", "users", "hats"),
)
_view("J5_self_join", "SELECT a.id, b.id AS parent FROM comments a JOIN comments b ON a.parent_comment_id = b.id", "SELECT a.id, b.id AS parent FROM comments a JOIN comments b ON a.parent_comment_id = b.id", ("comments",))
_view("J8_single_side_condition", "SELECT c.id FROM comments c JOIN stories s ON c.story_id = s.id AND s.is_expired = 0", "SELECT c.id FROM comments c JOIN stories s ON c.story_id = s.id AND s.is_expired = 0", ("comments", "stories"))
_view("J1_A1_orders_per_segment", "SELECT c_mktsegment, COUNT(*) FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS \"Count\" FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", ("customer", "orders"))

# aggregates
_add("A1_count", "SELECT story_id, count(*) AS \"Count\" FROM comments GROUP BY story_id", lambda t: R.aggregate(t("comments"), ["story_id"], "count"))
_view("A2_count_column", "SELECT user_id, COUNT(hat_id) AS n FROM comments GROUP BY user_id", "SELECT user_id, count(hat_id) AS n FROM comments GROUP BY user_id", ("comments",))
_add("A3_sum", "SELECT user_id, CAST(sum(upvotes) AS BIGINT) AS \"Sum\" FROM comments GROUP BY user_id", lambda t: R.aggregate(t("comments"), ["user_id"], "sum", "upvotes"))
_add("A4_integer_average", "SELECT user_id, CAST(sum(upvotes) // count(upvotes) AS BIGINT) AS \"Avg\" FROM comments GROUP BY user_id", lambda t: R.aggregate(t("comments"), ["user_id"], "avg", "upvotes"))
_view("A4_average_text", "SELECT l_returnflag, AVG(l_linenumber) FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS \"Avg\" FROM lineitem GROUP BY l_returnflag", ("lineitem",))
_sql("A5_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", ("lineitem",))
_add("A6_groups", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2", lambda t: R.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], "count", name="n"))
_sql("A6_no_group", "SELECT count(*) AS n FROM lineitem", ("lineitem",))

# sorting and limits
_add("O1_order", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name", lambda t: t("nation").select("n_name", "n_nationkey").orderBy(*text_order("n_name")))
_sql("O2_descending", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", ("orders",))
_add("O3_length_first", "SELECT username FROM users ORDER BY length(username) NULLS FIRST, username NULLS FIRST", lambda t: t("users").select("username").orderBy(*text_order("username", True)))
_add(
    "O4_top_per_key",
    "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    lambda t: R.top_per_key(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3),
)
_add("O5_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 30", lambda t: t("part").select("p_partkey").orderBy("p_partkey").offset(30).limit(10))
_sql("O7_read_limit", "SELECT story_id, n FROM (SELECT story_id, count(*) AS n FROM comments GROUP BY 1) ORDER BY n DESC, story_id LIMIT 7", ("comments",))
_add("O10_range_read", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1200", lambda t: R.lookup_greater(t("orders").select("o_orderkey", "o_custkey"), {"o_orderkey": 1200}, ["o_orderkey"]))

# set operations
_sql("U1_union_all", "SELECT user_id FROM comments UNION ALL SELECT user_id FROM stories", ("comments", "stories"))
_sql("U2_union", "SELECT user_id FROM comments UNION SELECT user_id FROM stories", ("comments", "stories"))
_view(
    "U1_left_join_union",
    "SELECT s.id, COUNT(*) AS n FROM stories s JOIN comments c ON s.id = c.story_id GROUP BY s.id UNION SELECT s.id, 0 AS n FROM stories s LEFT JOIN comments c ON s.id = c.story_id WHERE c.id IS NULL",
    "SELECT s.id, count(*) AS n FROM stories s JOIN comments c ON s.id = c.story_id GROUP BY s.id UNION SELECT s.id, 0 FROM stories s LEFT JOIN comments c ON s.id = c.story_id WHERE c.id IS NULL",
    ("stories", "comments"),
)
_add("X_exchange", "SELECT user_id, id FROM comments", lambda t: t("comments").select("user_id", "id").repartition("user_id"))
