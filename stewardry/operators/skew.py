"""Per-key results without imbalance.

``tree_aggregate`` and ``tree_latest`` combine fixed-size chunks of the input
locally and merge the states through rounds of logarithmic fan-in, so that no
task ever receives more than about ``fan_in`` states of one key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.runtime import free_name

#: How the state of each kind of aggregate starts and merges.
_START = {"count": lambda c: F.count(F.lit(1)) if c is None else F.count(c), "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def rounds_for(chunks: int, fan_in: int) -> int:
    """Merging rounds needed to bring so many chunk states to one: two at least, so that no key ever has all its states in one place."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 at least")
    return max(2, math.ceil(math.log(max(chunks, 1)) / math.log(fan_in) - 1e-9))


def _rows(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()  # answered from the file footers where the source keeps them


def chunk_count(df: DataFrame, chunk_rows: int = 65536, per_row: int = 1, rows: int | None = None) -> int:
    """At least as many as the chunks of a table, or of what has ``per_row`` rows for each of its rows."""
    return per_row * (_rows(df) if rows is None else rows) // chunk_rows + df.rdd.getNumPartitions()


def _slot(chunk_rows: int, leaves: int) -> Column:
    """The leaf of the merging tree of a row's chunk; a chunk is a run of ``chunk_rows`` rows of one input split."""
    run = F.floor(F.monotonically_increasing_id() / F.lit(chunk_rows))
    return F.pmod(F.xxhash64(run), F.lit(leaves))


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, Column | str | None]],
    chunk_rows: int = 65536,
    fan_in: int = 32,
    chunks: int | None = None,
) -> DataFrame:
    """One row per key with mergeable aggregates (count, sum, min, max).

    Defined cases: a null key is a key of its own; repeated rows all count; null
    values are skipped by sum, min, max and count of a column; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    rounds = rounds_for(chunk_count(df, chunk_rows) if chunks is None else chunks, fan_in)
    slot = free_name(df, "slot")
    leaf = [F.col(k) for k in keys]
    values = {n: (kind, None if c is None else (F.col(c) if isinstance(c, str) else c)) for n, (kind, c) in aggregates.items()}
    state = df.withColumn(slot, _slot(chunk_rows, fan_in ** (rounds - 1))).groupBy(*leaf, F.col(slot))
    state = state.agg(*[_START[kind](c).alias(n) for n, (kind, c) in values.items()])
    for left in range(rounds - 2, -1, -1):
        state = state.withColumn(slot, F.floor(F.col(slot) / fan_in) if left else F.lit(0))
        state = state.groupBy(*leaf, slot).agg(*[_MERGE[kind](n).alias(n) for n, (kind, _) in values.items()])
    return state.drop(slot)


def tree_latest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    k: int = 1,
    chunk_rows: int = 65536,
    fan_in: int = 32,
    chunks: int | None = None,
) -> DataFrame:
    """The ``k`` last rows of each key by ``order`` with their ``rank``, through the same tree.

    In each round every task keeps ``k`` rows per key and slot before it sends
    anything, so a slot receives ``fan_in * k`` rows of a key. Ties are broken by
    all remaining columns; nulls in ``order`` come last; whole repeats keep a rank each.
    """
    rounds = rounds_for(chunk_count(df, chunk_rows) if chunks is None else chunks, fan_in)
    slot, rank = free_name(df, "slot"), free_name(df, "rank")
    ties = [c for c in df.columns if c not in {*order, *keys}]
    last = [F.col(c).desc_nulls_last() for c in [*order, *ties]]
    state = df.withColumn(slot, _slot(chunk_rows, fan_in ** (rounds - 1)))
    for left in range(rounds - 1, -1, -1):
        if left < rounds - 1:
            state = state.withColumn(slot, F.floor(F.col(slot) / fan_in) if left else F.lit(0)).drop(rank)
        within = Window.partitionBy(*keys, slot).orderBy(*last)
        state = state.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= k)
    return state.drop(slot)


def unpivot_keys(df: DataFrame, fields: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """A row (key_field, key_value, ...) per row and key field, in one pass over the input."""
    pairs = F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("bigint").alias("key_value")) for f in fields])
    return df.select(F.explode(pairs).alias("k"), *keep).select("k.key_field", "k.key_value", *[c for c in df.select(*keep).columns])


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float, fan_in: int = 32, chunk_rows: int = 65536) -> DataFrame:
    """The non-null key values that hold at least ``share`` of all rows: (key_field, key_value, n_rows)."""
    total = _rows(df)
    rows = unpivot_keys(df, fields, [])
    counts = tree_aggregate(rows, ["key_field", "key_value"], {"n_rows": ("count", None)}, chunk_rows, fan_in, chunk_count(df, chunk_rows, len(fields), total))
    return counts.where(F.col("key_value").isNotNull() & (F.col("n_rows") >= total * share))
