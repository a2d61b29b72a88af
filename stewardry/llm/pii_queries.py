"""Queries of problem 1; what they find is not expressible in SQL and tested on texts of known content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import pii
from stewardry.runtime import read


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [("comments", "comment"), ("private_msg", "message"), ("hat_requests", "comment")]
    return pii.gather(spark, [(t, read(spark, sf_dir, t), "id", c) for t, c in tables])


def _key(spark: SparkSession) -> bytes:
    """The secret that ``stewardry.pii.key`` names; the test tables, whose content is invented, do with a public one."""
    return spark.conf.get("stewardry.pii.key", "for invented test tables only").encode()


def p1_pseudonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = pii.pseudonymise(_texts(spark, sf_dir), _key(spark), read(spark, sf_dir, "name_parts"), everything=True)
    return rewritten.select("src_table", "row_id", "redacted", "surrogate")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.types_found(pii.pseudonymise(_texts(spark, sf_dir), _key(spark), read(spark, sf_dir, "name_parts")))


def p1_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: rows, null texts, and what may not be: texts that changed without a mention, and plain addresses left in a redacted text."""
    made = pii.pseudonymise(_texts(spark, sf_dir), _key(spark), read(spark, sf_dir, "name_parts"), everything=True)
    left = F.col("redacted").rlike(r"(?<![\w.+-])\w[\w.+-]*@\w+\.(?:example|com|org|net)\b")
    odd = (F.size("pii_types") == 0) & (F.col("redacted") != F.col("surrogate"))
    return made.groupBy("src_table").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("redacted").isNull()).alias("n_null"), F.count_if(left | odd).alias("n_wrong"))


QUERIES = {"p1_found": p1_found, "p1_pseudonymised": p1_pseudonymised, "p1_invariants": p1_invariants}

SQL = {
    "p1_invariants": " UNION ALL ".join(
        f"SELECT '{t}' AS src_table, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_wrong FROM {t}" for t, c in (("comments", "comment"), ("private_msg", "message"), ("hat_requests", "comment"))
    )
}
