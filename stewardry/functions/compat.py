"""Column expressions whose meaning differs from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _arith(a: Column | str | int, b: Column | str | int, sign: int) -> Column:
    left, right = _col(a), _col(b)
    zero = F.lit(0).cast("bigint")
    total = F.coalesce(left, zero) + F.coalesce(right, zero) * F.lit(sign).cast("bigint")
    return F.when(left.isNull() & right.isNull(), F.lit(None).cast("bigint")).otherwise(total.cast("bigint"))


def plus(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer sum in which one null counts as zero and two give null."""
    return _arith(a, b, 1)


def minus(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer difference in which one null counts as zero and two give null."""
    return _arith(a, b, -1)


def int_avg(x: Column | str) -> Column:
    """Integer average, truncated toward zero; nulls are skipped, no values give null."""
    # null, not zero, as the divisor of an empty group: it has no average, and no error
    return F.call_function("div", F.sum(_col(x)).cast("bigint"), F.call_function("nullif", F.count(_col(x)), F.lit(0)))


def text_order(x: Column | str, compat: bool = False) -> list[Column]:
    """Sort keys of a text column, nulls first; the compatible order puts shorter texts first."""
    own = _col(x).asc_nulls_first()
    return [F.length(_col(x)).asc_nulls_first(), own] if compat else [own]


def equals(a: Column, b: Column, compat: bool = False) -> Column:
    """Equality of join keys; in the compatible mode null meets null."""
    return a.eqNullSafe(b) if compat else a == b


def is_in(x: Column | str, values: list) -> Column:
    """Membership by value, in which a null in the list matches null; without one, a null is neither in nor out, so that the scan can filter."""
    known = [v for v in values if v is not None]
    if None not in values:
        return _col(x).isin(known) if known else F.lit(False)
    return _col(x).isin(known) | _col(x).isNull() if known else _col(x).isNull()
