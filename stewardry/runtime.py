"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a folder of our own is set; on a
    cluster an unset folder is an error, as a local one would not survive the
    loss of an executor.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = os.path.join(tempfile.gettempdir(), f"stewardry-checkpoints-{os.getpid()}")
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (never local blocks)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_bare(df: DataFrame) -> DataFrame:
    """``cut`` for rows that one plan uses several times: without what the optimiser knows of their values, which it cannot carry over to a second use of a checkpoint."""
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that does not clash with the input's own columns."""
    taken = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in taken:
        name += "_"
    return name


def sha_key(col: Column | str) -> Column:
    """A 128-bit text key for equality of long texts."""
    return F.md5(F.encode(F.col(col) if isinstance(col, str) else col, "utf-8"))


#: Rows that ``join_hot`` broadcasts: a fixed number, so that no other key can hold more than 1/HOT of the left side.
HOT = 2048


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], heat: str, hot: int = HOT) -> DataFrame:
    """Inner join with a table of one short row per key that also counts, as ``heat``, how often the left side has it.

    The ``hot`` most frequent keys, which would fill single tasks, are broadcast; the rest is joined by shuffle.
    """
    values = [c for c in right.columns if c not in {*keys, heat}]
    top = cut(right.orderBy(F.col(heat).desc(), *keys).limit(hot).select(*keys, *values))
    mark = free_name(left, "hot_")
    marked = left.join(F.broadcast(top.withColumn(mark, F.lit(True))), keys, "left")
    near = marked.where(F.col(mark)).select(*left.columns, *values)
    rest = right.join(F.broadcast(top.select(*keys)), keys, "left_anti").select(*keys, *values)
    far = marked.where(F.col(mark).isNull()).select(*left.columns).join(rest, keys)
    return near.unionByName(far.select(*near.columns))
