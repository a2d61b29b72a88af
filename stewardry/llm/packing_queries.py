"""Queries of problem 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import packing
from stewardry.runtime import read


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pack_spec"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What had to be cut."""
    return p6_packed(spark, sf_dir).where("n_pieces > 1").select("pack_id", "doc_id").distinct()


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task: documents, tokens, and containers that hold more than they can."""
    packed = p6_packed(spark, sf_dir)
    held = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("held"), F.max("capacity").alias("capacity"))
    over = held.groupBy("pack_id").agg(F.count_if(F.col("held") > F.col("capacity")).alias("n_overfull"))
    return packed.groupBy("pack_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("tokens").alias("tokens")).join(over, "pack_id")


QUERIES = {"p6_found": p6_found, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_totals": p6_totals}

SQL = {
    "p6_totals": """SELECT s.pack_id, count(DISTINCT d.doc_id) AS n_docs, CAST(sum(coalesce(strlen(d.text), 0) + 1) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS n_overfull
FROM documents d JOIN pack_spec s ON (s.source IS NULL OR lower(trim(s.source)) = lower(trim(d.source))) GROUP BY 1""",
    "p6_found": """SELECT s.pack_id, d.doc_id FROM documents d JOIN pack_spec s
ON (s.source IS NULL OR lower(trim(s.source)) = lower(trim(d.source))) WHERE coalesce(strlen(d.text), 0) + 1 > s.capacity"""
}
