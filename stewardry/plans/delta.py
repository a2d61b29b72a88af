"""Incremental maintenance of views over weighted rows: ``_w`` counts how often a row is added (or, negative, taken away)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.operators.relational import top_per_key

W = "_w"


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(W, F.lit(weight).cast("bigint"))


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != W]


def consolidate(delta: DataFrame) -> DataFrame:
    """One row per distinct row with its summed weight; zero weights vanish, whatever the order of additions and retractions."""
    return delta.groupBy(*columns(delta)).agg(F.sum(W).cast("bigint").alias(W)).where(F.col(W) != 0)


def expand(delta: DataFrame) -> DataFrame:
    """Plain rows, each as often as its weight says."""
    return delta.where(F.col(W) > 0).withColumn(W, F.explode(F.sequence(F.lit(1), F.col(W).cast("int")))).drop(W)


def apply(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """A view's rows after a delta."""
    return expand(consolidate(weighted(rows).unionByName(delta.withColumn(W, F.col(W).cast("bigint")))))


def where(delta: DataFrame, condition: Column) -> DataFrame:
    return delta.where(condition)


def select(delta: DataFrame, *exprs: Column | str) -> DataFrame:
    return delta.select(*exprs, W)


def union(*deltas: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, deltas)


def join(left: DataFrame, left_delta: DataFrame, right: DataFrame, right_delta: DataFrame, key: str) -> DataFrame:
    """The delta of an inner join on ``key``: changes meet the old other side and each other, weights multiply."""

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.withColumnRenamed(W, "w_right_")
        return a.join(other, key).withColumn(W, F.col(W) * F.col("w_right_")).drop("w_right_")

    return union(product(left_delta, weighted(right)), product(weighted(left), right_delta), product(left_delta, right_delta))


def _affected(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return delta.select(*keys).distinct()


def _matching(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns, nulls included, are among ``keys``."""
    named = keys.select(*[F.col(c).alias(f"{c}_key_") for c in keys.columns])
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"{c}_key_"]) for c in keys.columns])
    return rows.join(named, on, "left_semi")


def recompute(rows: DataFrame, delta: DataFrame, keys: Sequence[str], plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The delta of any per-key plan: old result out and new result in, for the keys that the delta touches only."""
    touched = _affected(delta, keys)
    old = _matching(rows, touched)
    new = apply(old, _matching(delta, touched))
    return consolidate(union(weighted(plan(old), -1), weighted(plan(new), 1)))


def outer_join(left: DataFrame, left_delta: DataFrame, right: DataFrame, right_delta: DataFrame, key: str, how: str = "left") -> DataFrame:
    """The delta of an outer join, by recomputing the keys that either side's delta touches."""
    touched = _affected(union(left_delta.select(key, W), right_delta.select(key, W)), [key])
    old_left, old_right = _matching(left, touched), _matching(right, touched)
    new_left, new_right = apply(old_left, left_delta), apply(old_right, right_delta)
    return consolidate(union(weighted(old_left.join(old_right, key, how), -1), weighted(new_left.join(new_right, key, how), 1)))


def aggregate_state(rows: DataFrame, groups: Sequence[str], value: str | None = None) -> DataFrame:
    """(groups, n, total, known): what COUNT, SUM and AVG of a group follow from, also after retractions."""
    made = [F.count(F.lit(1)).alias("n")]
    made += [F.sum(value).cast("bigint").alias("total"), F.count(value).alias("known")] if value else []
    return rows.groupBy(*groups).agg(*made)


def aggregate(state: DataFrame, delta: DataFrame, groups: Sequence[str], value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, delta of the state): only changed groups are emitted, (old, -1) before (new, +1); groups without rows vanish."""
    made = [F.sum(W).cast("bigint").alias("n")]
    if value:
        made += [F.sum(F.col(value) * F.col(W)).cast("bigint").alias("total"), F.sum(F.when(F.col(value).isNotNull(), F.col(W))).cast("bigint").alias("known")]
    changes = delta.groupBy(*groups).agg(*made)
    merged = [F.sum(c).cast("bigint").alias(c) for c in changes.columns if c not in groups]
    touched = changes.select(*groups)
    old = _matching(state, touched)
    new = old.unionByName(changes).groupBy(*groups).agg(*merged).where(F.col("n") > 0)
    if value:
        new = new.withColumn("known", F.coalesce("known", F.lit(0).cast("bigint"))).withColumn("total", F.when(F.col("known") > 0, F.col("total")))
    moved = consolidate(union(weighted(old, -1), weighted(new, 1)))
    return apply(state, moved), moved


def distinct(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """The delta of DISTINCT: rows that appear for the first time or vanish altogether."""
    names = columns(delta)
    touched = _affected(delta, names)
    old = weighted(_matching(rows, touched)).groupBy(*names).agg(F.sum(W).alias(W))
    both = union(old.withColumn("was_", F.lit(1)), consolidate(delta).withColumn("was_", F.lit(0)))
    total = both.groupBy(*names).agg(F.sum(F.col(W) * F.col("was_")).alias("before_"), F.sum(W).alias("after_"))
    change = (F.col("after_") > 0).cast("bigint") - (F.col("before_") > 0).cast("bigint")
    return total.select(*names, change.alias(W)).where(F.col(W) != 0)


def top(rows: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The delta of the first ``limit`` rows per key: exact also after many deletions."""
    return recompute(rows, delta, keys, lambda df: top_per_key(df, keys, order, limit))
