"""Queries of problem 4; what they find is not expressible in SQL and tested on labelled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import markup
from stewardry.runtime import read

KEYS = ["src_table", "src_field", "row_id"]
FIELDS = (("comments", "markeddown_comment"), ("stories", "markeddown_description"), ("stories", "story_cache"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, name in FIELDS:
        rows = read(spark, sf_dir, table).select(F.lit(table).alias("src_table"), F.lit(name).alias("src_field"), F.col("id").alias("row_id"), F.col(name).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.find_elements(_texts(spark, sf_dir), KEYS)
    return found.select(*KEYS, F.explode("elements").alias("element")).distinct()


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(_texts(spark, sf_dir), KEYS).select(*KEYS, "clean")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
SQL: dict[str, str] = {}
