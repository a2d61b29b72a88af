"""Queries of problem 8; its results are not expressible in SQL and tested against a direct normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import looks
from stewardry.runtime import read


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = looks.same_look_pairs(read(spark, sf_dir, "documents"), "doc_id")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.normalise(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "look")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.look_classes(read(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def p8_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invariant that SQL can state: texts of printable ASCII and line feeds stay as they are, and all others come out as one text each."""
    made = looks.normalise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.col("text").rlike("^[ -~\\n]*$")
    return made.select("doc_id", F.when(plain, F.col("look")).alias("plain_look"), F.col("look").isNull().alias("is_null"))


QUERIES = {"p8_found": p8_found, "p8_texts": p8_texts, "p8_classes": p8_classes, "p8_ascii": p8_ascii}
SQL = {"p8_ascii": "SELECT doc_id, CASE WHEN regexp_full_match(text, '[ -~\\n]*') THEN text END AS plain_look, text IS NULL AS is_null FROM documents"}
