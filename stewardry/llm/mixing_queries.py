"""Queries of problem 7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import mixing
from stewardry.runtime import read


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.place(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_plan"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(*_placed(spark, sf_dir)).where("short").select("mix_id", "source")


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(_placed(spark, sf_dir)[0])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixing.report(*_placed(spark, sf_dir))
    return shares.withColumn("actual_share", F.round("actual_share", 6))


QUERIES = {"p7_found": p7_found, "p7_order": p7_order, "p7_shares": p7_shares}

_SUMS = """own AS (SELECT lower(trim(source)) AS k, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS own FROM documents GROUP BY 1),
plan AS (SELECT p.*, coalesce(o.own, 0) AS own FROM mix_plan p LEFT JOIN own o ON o.k = lower(trim(p.source))),
full_plan AS (SELECT *, sum(own) OVER (PARTITION BY mix_id) AS total FROM plan)"""

SQL = {"p7_found": f"WITH {_SUMS} SELECT mix_id, source FROM full_plan WHERE max_repeats * own < target_share * total"}
