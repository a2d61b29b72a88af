"""Queries that run a stream to its end into a stored view and return the view; their SQL computes it in one go."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.plans import delta
from stewardry.runtime import ensure_checkpoint_dir, read
from stewardry.streaming.maintain import StoredView, maintain, maintain_aggregate


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4()}"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment as an addition, and every deleted one as a retraction as well."""
    path = f"{sf_dir}/comments.parque[t]"  # as a pattern the source takes a file as well as a folder
    rows = spark.readStream.schema(read(spark, sf_dir, "comments").schema).parquet(path)
    signs = F.when(F.col("is_deleted") == 1, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))).cast("array<bigint>")
    return rows.withColumn(delta.W, F.explode(signs)).select("id", "user_id", "upvotes", delta.W)


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    view = StoredView(spark, f"{folder}/view", "id bigint, user_id bigint")
    maintain(_changes(spark, sf_dir), view, f"{folder}/checkpoint", lambda df: delta.select(df.where("upvotes > 2"), "id", "user_id")).awaitTermination()
    return view.rows()


def stream_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    view = StoredView(spark, f"{folder}/view", "user_id bigint, n bigint, total bigint, known bigint")
    maintain_aggregate(_changes(spark, sf_dir), view, ["user_id"], "upvotes", f"{folder}/checkpoint").awaitTermination()
    return view.rows()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"STREAM_rows": stream_rows, "STREAM_aggregate": stream_aggregate}

SQL = {
    "STREAM_rows": "SELECT id, user_id FROM comments WHERE is_deleted IS DISTINCT FROM 1 AND upvotes > 2",
    "STREAM_aggregate": "SELECT user_id, count(*) AS n, CAST(sum(upvotes) AS BIGINT) AS total, count(upvotes) AS known FROM comments WHERE is_deleted IS DISTINCT FROM 1 GROUP BY 1",
}
