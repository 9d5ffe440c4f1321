"""Windows over ordered series, with pandas-like minimum periods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Names = str | Sequence[str]


def names(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def series(key: Names = "symbol", order: Names = "ts") -> WindowSpec:
    return Window.partitionBy(*names(key)).orderBy(*names(order))


def last_rows(n: int, key: Names = "symbol", order: Names = "ts") -> WindowSpec:
    """The row and the n - 1 before it."""
    return series(key, order).rowsBetween(1 - n, 0)


def so_far(key: Names = "symbol", order: Names = "ts") -> WindowSpec:
    return series(key, order).rowsBetween(Window.unboundedPreceding, 0)


def rolling(f: Callable[[Column], Column], x: Column, n: int, least: int = 1, key: Names = "symbol", order: Names = "ts") -> Column:
    """``f(x)`` over the last n rows, null where fewer than ``least`` of them have a value."""
    w = last_rows(n, key, order)
    value = f(x).over(w)
    return value if least <= 1 else F.when(F.count(x).over(w) >= least, value)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return a / F.nullif(b, F.lit(0.0))


def yes(condition: Column) -> Column:
    """A condition where missing values say no."""
    return F.coalesce(condition, F.lit(False))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
