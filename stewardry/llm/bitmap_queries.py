"""Queries of problem 2 and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import bitmaps
from stewardry.runtime import ensure_checkpoint_dir, read

BOTH = ["day", "story_id"]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "comments").select(F.to_date("created_at").alias("day"), "story_id", "user_id")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return bitmaps.build(facts, BOTH, "user_id", bitmaps.dictionary(facts, "user_id"))


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bitmaps.count(_built(spark, sf_dir), BOTH)
    known = F.col("day").isNotNull() & F.col("story_id").isNotNull()
    return _day(counted.where(known & (F.col("n_distinct") >= 30)).select(*BOTH))


def p2_day_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(bitmaps.count(_built(spark, sf_dir), BOTH))


def p2_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, from the merged partial results per day and story."""
    return _day(bitmaps.count(bitmaps.merge(_built(spark, sf_dir), ["day"]), ["day"]))


def p2_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per story, from the merged partial results per day and story."""
    return bitmaps.count(bitmaps.merge(_built(spark, sf_dir), ["story_id"]), ["story_id"])


def p2_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a day who were there the day before as well (AND of two days' bitmaps)."""
    days = bitmaps.merge(_built(spark, sf_dir), ["day"])
    before = days.withColumn("day", F.date_add("day", 1))
    return _day(bitmaps.count(bitmaps.intersect(days, before, ["day"]), ["day"], "n_returning"))


def p2_two_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of two runs, each stored as files: the second one extends the dictionary of the first, and OR merges what both have."""
    comments = read(spark, sf_dir, "comments").select("story_id", "user_id", "created_at")
    early = F.coalesce(F.col("created_at") < F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(True))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/bitmaps-{uuid.uuid4()}"
    codes = None
    for k, part in enumerate((comments.where(early), comments.where(~early))):
        made = bitmaps.dictionary(part, "user_id") if codes is None else bitmaps.extend(codes, part, "user_id")
        made.write.parquet(f"{folder}/codes-{k}")
        codes = spark.read.parquet(f"{folder}/codes-{k}")
        bitmaps.build(part, ["story_id"], "user_id", codes).write.parquet(f"{folder}/stories-{k}")
    stored = spark.read.parquet(f"{folder}/stories-0").unionByName(spark.read.parquet(f"{folder}/stories-1"))
    return bitmaps.count(bitmaps.merge(stored, ["story_id"]), ["story_id"], "n_users")


QUERIES = {"p2_found": p2_found, "p2_day_story": p2_day_story, "p2_day": p2_day, "p2_story": p2_story, "p2_returning": p2_returning, "p2_two_builds": p2_two_builds}

_FACTS = "(SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(created_at AS DATE) AS d, story_id, user_id FROM comments WHERE user_id IS NOT NULL)"

SQL = {
    "p2_two_builds": "SELECT story_id, count(DISTINCT user_id) AS n_users FROM comments WHERE user_id IS NOT NULL GROUP BY 1",
    "p2_found": f"SELECT day, story_id FROM {_FACTS} WHERE day IS NOT NULL AND story_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 30",
    "p2_day_story": f"SELECT day, story_id, count(DISTINCT user_id) AS n_distinct FROM {_FACTS} GROUP BY 1, 2",
    "p2_day": f"SELECT day, count(DISTINCT user_id) AS n_distinct FROM {_FACTS} GROUP BY 1",
    "p2_story": f"SELECT story_id, count(DISTINCT user_id) AS n_distinct FROM {_FACTS} GROUP BY 1",
    "p2_returning": f"""SELECT a.day, count(DISTINCT a.user_id) AS n_returning FROM {_FACTS} a
JOIN {_FACTS} b ON b.user_id = a.user_id AND b.d + 1 = a.d GROUP BY 1""",
}
