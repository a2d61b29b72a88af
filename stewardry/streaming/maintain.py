"""Continuous maintenance of a stored view from a stream of weighted changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stewardry.plans import delta
from stewardry.plans.catalog import Column, Table
from stewardry.sources.store import Store

_KINDS = {"bigint": "INT", "int": "INT", "string": "TEXT", "timestamp_ntz": "DATETIME"}


class StoredView:
    """Rows of a view in a versioned store, in buckets by the first column; a batch rewrites the buckets it touches, and applying it twice changes nothing."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.store = Store(spark, root)
        if "rows" not in self.store.catalog.tables:
            fields = spark.createDataFrame([], schema).dtypes
            self.store.catalog.tables["rows"] = Table("rows", [Column(n, _KINDS[t]) for n, t in fields], fields[0][0])
            self.store.save_catalog()

    def rows(self) -> DataFrame:
        return self.store.table("rows")

    def apply(self, change: DataFrame, batch: int) -> None:
        if batch <= self.store.counters.get("batch", -1):
            return  # replayed after a failure
        self.store.commit({"rows": change}, {"batch": batch})


def maintain(changes: DataFrame, view: StoredView, checkpoint: str, plan: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Starts a query that applies each micro-batch of a weighted stream, after a linear ``plan`` (filter, projection), to a stored view."""

    def batch(df: DataFrame, number: int) -> None:
        view.apply(plan(df) if plan else df, number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def maintain_aggregate(changes: DataFrame, view: StoredView, groups: list[str], value: str | None, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps (groups, n[, total, known]) of a weighted stream; COUNT, SUM and AVG follow from a row."""

    def batch(df: DataFrame, number: int) -> None:
        _, moved = delta.aggregate(view.rows(), df, groups, value)
        view.apply(moved, number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
