"""Relational operators of views, over DataFrames; Catalyst plans them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.functions.compat import equals, int_avg
from stewardry.runtime import free_name


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", compat: bool = False) -> DataFrame:
    """Equi-join on one column per side (inner, left or right); the right key is dropped.

    An unmatched right row keeps its key in the left key column; in the
    compatible mode it loses it, and null keys meet.
    """
    if how not in {"inner", "left", "right"}:
        raise ValueError(f"no such join: {how}")
    key = free_name(left, right_key) if right_key in left.columns else right_key
    renamed = right.withColumnRenamed(right_key, key) if key != right_key else right
    joined = left.join(renamed, equals(left[left_key], renamed[key], compat), how)
    if how == "right" and not compat:
        joined = joined.withColumn(left_key, F.coalesce(left[left_key], renamed[key]))
    return joined.drop(key)


def aggregate(df: DataFrame, groups: Sequence[str], function: str | None = None, column: str | None = None, name: str | None = None) -> DataFrame:
    """Group columns and COUNT, SUM or AVG (integer), by default named Count, Sum or Avg; without a function the distinct groups."""
    if function is None:
        return df.select(*groups).distinct()
    made = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(column).cast("bigint"), "avg": lambda: int_avg(column)}
    if function.lower() not in made:
        raise ValueError(f"Invalid aggregate function: {function}")
    return df.groupBy(*groups).agg(made[function.lower()]().alias(name or function.capitalize()))


def union(*inputs: DataFrame, distinct: bool = False) -> DataFrame:
    """All rows of inputs of equal column names and types."""
    first = inputs[0]
    for other in inputs[1:]:
        if other.dtypes != first.dtypes:
            raise ValueError(f"schemas differ: {first.dtypes} and {other.dtypes}")
        first = first.unionByName(other)
    return first.distinct() if distinct else first


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """At most ``limit`` rows per key in the given order. Every task keeps its own first rows before the shuffle."""
    rank = free_name(df, "rank")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where((F.col(rank) > offset) & (F.col(rank) <= offset + limit)).drop(rank)


def lookup(df: DataFrame, keys: dict[str, list]) -> DataFrame:
    """Rows whose key columns take any combination of the listed values."""
    for name, values in keys.items():
        df = df.where(F.col(name).isin([v for v in values if v is not None]) if None not in values else F.col(name).isNull() | F.col(name).isin([v for v in values if v is not None]))
    return df


def lookup_greater(df: DataFrame, bounds: dict[str, object], order: Sequence[str], limit: int | None = None, offset: int = 0, signs: dict[str, str] | None = None) -> DataFrame:
    """Rows beyond the bounds, in order: a bound from below (``>`` and ``>=``) is included, one from above is by its sign."""
    for name, value in bounds.items():
        c, v = F.col(name), F.lit(value)
        df = df.where({"<": c < v, "<=": c <= v}.get((signs or {}).get(name, ">="), c >= v))
    df = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).offset(offset)
    return df if limit is None else df.limit(limit)


def first_copies(df: DataFrame, key: str) -> DataFrame:
    """One row per key of a scan over several copies; of differing copies the least row counts."""
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row_"))
    return one.select(*[F.col(key) if c == key else F.col("row_")[c].alias(c) for c in df.columns])
