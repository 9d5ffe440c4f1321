"""Running values and frames of a key without its rows in one task.

Rows are dealt out by (key, cell), a cell being a stretch of the order: of time, or of numbers. Each cell comes to a few figures (a
row), a window over these rows says what all earlier cells come to, and a cell's rows add what lies before them in the cell.
What is sorted together is a cell, or a row for each cell of a key.

Frames of a fixed number of rows go by blocks of row numbers instead; a block also gets the last rows of the one before it, by
count, so gaps of any length make no difference.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import Names, names

#: Lengths of a cell where none is given: seconds, or units of a number.
SECONDS, UNITS = 7 * 86_400, 8192
#: Rows of a block of frames.
BLOCK = 65_536


def cell_number(df: DataFrame, order: Names, width: float | None = None) -> Column:
    """The cell of a row by the first column of the order, a time or a number; of another kind each value is a stretch of its
    own, which the next column divides."""
    first, *rest = names(order)
    kind = df.schema[first].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.floor(F.unix_micros(F.col(first).cast("timestamp")) / F.lit(1e6 * (width or SECONDS)))
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(first) / F.lit(width or UNITS)).cast("long")
    return F.struct(F.col(first).alias("value"), (cell_number(df, rest, width) if rest else F.lit(0).cast("long")).alias("cell"))


def in_cells(df: DataFrame, order: Names, width: float | None = None) -> DataFrame:
    """``df`` with ``_cell``, if it has none of its own."""
    return df if "_cell" in df.columns else df.withColumn("_cell", cell_number(df, order, width))


def within(keys: Names, order: Names) -> WindowSpec:
    """A cell's rows in order."""
    return Window.partitionBy(*names(keys), "_cell").orderBy(*names(order))


def within_so_far(keys: Names, order: Names) -> WindowSpec:
    return within(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def cells_of(rows: DataFrame, keys: Names, **figures: Column) -> DataFrame:
    """A row for each (key, cell) with aggregates of its rows."""
    return rows.groupBy(*names(keys), "_cell").agg(*(c.alias(n) for n, c in figures.items()))


def earlier(keys: Names) -> WindowSpec:
    """Of cells, those before."""
    return Window.partitionBy(*names(keys)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)


def with_borders(rows: DataFrame, cells: DataFrame, keys: Names, *columns: str) -> DataFrame:
    """``rows`` with columns of their cells; a missing key is a key."""
    return with_columns_of(rows, cells, [*names(keys), "_cell"], *columns)


def with_columns_of(rows: DataFrame, side: DataFrame, on: Names, *columns: str) -> DataFrame:
    """``rows`` with columns of the one row of ``side`` that has the same ``on``; a missing value equals a missing value."""
    on = names(on)
    side = side.select(*(F.col(c).alias(f"__on_{c}") for c in on), *columns)
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return rows.join(side, match).drop(*(f"__on_{c}" for c in on))


def plus(before: Column, here: Column) -> Column:
    """Sum of two running sums, either of which may still be missing."""
    return F.coalesce(before + here, before, here)


def running(df: DataFrame, keys: Names, order: Names, number: str | None = None, sums: dict[str, Column] | None = None, width: float | None = None) -> DataFrame:
    """``df`` with ``number``, the row's number within its key from 1, and sums so far, as a whole-key window has them."""
    sums = sums or {}
    rows = in_cells(df.select("*", *(x.alias(f"__x_{n}") for n, x in sums.items())), order, width)
    w, e = within_so_far(keys, order), earlier(keys)
    rows = rows.select("*", F.row_number().over(within(keys, order)).alias("__number"), *(F.sum(f"__x_{n}").over(w).alias(f"__l_{n}") for n in sums))
    cells = cells_of(rows, keys, __n=F.count(F.lit(1)), **{f"__s_{n}": F.sum(f"__x_{n}") for n in sums})
    cells = cells.select("*", F.coalesce(F.sum("__n").over(e), F.lit(0)).alias("__before"), *(F.sum(f"__s_{n}").over(e).alias(f"__b_{n}") for n in sums))
    out = with_borders(rows, cells, keys, "__before", *(f"__b_{n}" for n in sums))
    added = [*([(F.col("__before") + F.col("__number")).alias(number)] if number else []), *(plus(F.col(f"__b_{n}"), F.col(f"__l_{n}")).alias(n) for n in sums)]
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *added)


def numbered(df: DataFrame, keys: Names, order: Names, to: str = "_i", width: float | None = None) -> DataFrame:
    """``df`` with ``to``: the row's number within its key, from 0."""
    return running(df, keys, order, to, width=width).withColumn(to, F.col(to) - 1)


def islands(df: DataFrame, label: str, keys: Names, order: Names, width: float | None = None) -> DataFrame:
    """``df`` with ``island``, a number that grows with each change of label, ``_number`` (the row's, from 1) and ``_start``, the
    number of the island's first row."""
    w, up = within(keys, order), within_so_far(keys, order)
    rows = in_cells(df, order, width)
    rows = rows.select("*", F.row_number().over(w).alias("__in"), ((F.row_number().over(w) > 1) & ~F.lag(label).over(w).eqNullSafe(F.col(label))).alias("__new"))
    rows = rows.select("*", F.sum(F.col("__new").cast("int")).over(up).alias("__changes"), F.max(F.when(F.col("__new"), F.col("__in"))).over(up).alias("__from"))
    at = F.struct(*names(order))
    cells = cells_of(rows, keys, __n=F.count(F.lit(1)), __all=F.max("__changes"), __tail=F.max("__from"), _first=F.min_by(F.struct(F.col(label).alias("x")), at), __last=F.max_by(F.struct(F.col(label).alias("x")), at))
    e, one_before = earlier(keys), Window.partitionBy(*names(keys)).orderBy("_cell")
    ended = F.lag("__last").over(one_before)
    cells = cells.withColumn("__turn", (~F.coalesce(ended["x"].eqNullSafe(F.col("_first.x")) & ended.isNotNull(), F.lit(False))).cast("int")).withColumn("__n0", F.coalesce(F.sum("__n").over(e), F.lit(0)))
    # where the island began that is open at the cell's end: at its last change, at its begin, or before it
    began = F.when(F.col("__tail").isNotNull(), F.col("__n0") + F.col("__tail")).when(F.col("__turn") == 1, F.col("__n0") + 1)
    cells = cells.withColumn("__began", began).withColumn("__island0", F.coalesce(F.sum(F.col("__all") + F.col("__turn")).over(e), F.lit(0)) + F.col("__turn"))
    cells = cells.withColumn("__start0", F.when(F.col("__turn") == 1, F.col("__n0") + 1).otherwise(F.max("__began").over(e)))
    out = with_borders(rows, cells, keys, "__n0", "__island0", "__start0")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__island0") + F.col("__changes")).alias("island"), (F.col("__n0") + F.col("__in")).alias("_number"), F.coalesce(F.col("__n0") + F.col("__from"), F.col("__start0")).alias("_start"))


def since(df: DataFrame, condition: Column, keys: Names, order: Names, to: str, before: str | None = None, width: float | None = None) -> DataFrame:
    """``df`` with ``to``: rows since the last one where the condition held, this one counted (0 where it holds), or since the key's
    begin; ``before``: the same of the row before, 0 for the first."""
    rows = in_cells(df.withColumn("__hit", F.coalesce(condition, F.lit(False))), order, width)
    w = within(keys, order)
    rows = rows.withColumn("__in", F.row_number().over(w)).withColumn("__at", F.max(F.when(F.col("__hit"), F.col("__in"))).over(within_so_far(keys, order)))
    rows = rows.withColumn("__at_before", F.lag("__at").over(w))
    cells = cells_of(rows, keys, __n=F.count(F.lit(1)), __hit_at=F.max("__at")).withColumn("__n0", F.coalesce(F.sum("__n").over(earlier(keys)), F.lit(0)))
    cells = cells.withColumn("__hit0", F.coalesce(F.max(F.col("__n0") + F.col("__hit_at")).over(earlier(keys)), F.lit(0)))
    out = with_borders(rows, cells, keys, "__n0", "__hit0")
    number = F.col("__n0") + F.col("__in")
    added = [(number - F.coalesce(F.col("__n0") + F.col("__at"), F.col("__hit0"))).alias(to)]
    if before:
        added.append((number - 1 - F.coalesce(F.col("__n0") + F.col("__at_before"), F.col("__hit0"))).alias(before))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *added)


def lagged(df: DataFrame, columns: dict[str, Column], keys: Names, order: Names, width: float | None = None) -> DataFrame:
    """``df`` with the values that the row before has, and ``_first``: whether there is none."""
    there = F.struct(*(c.alias(n) for n, c in columns.items()))
    rows = in_cells(df.withColumn("__there", there), order, width)
    cells = cells_of(rows, keys, __last=F.max_by("__there", F.struct(*names(order)))).withColumn("__before", F.lag("__last").over(Window.partitionBy(*names(keys)).orderBy("_cell")))
    w = within(keys, order)
    out = with_borders(rows, cells, keys, "__before").withColumn("__lag", F.when(F.row_number().over(w) > 1, F.lag("__there").over(w)).otherwise(F.col("__before")))
    return out.select(*df.columns, *(F.col(f"__lag.{n}").alias(n) for n in columns), F.col("__lag").isNull().alias("_first"))


def running_last(df: DataFrame, values: dict[str, Column], keys: Names, order: Names, width: float | None = None, until_before: bool = False) -> DataFrame:
    """``df`` with the last value so far that is not null (``until_before``: of the rows before this one)."""
    rows = in_cells(df.select("*", *(c.alias(f"__x_{n}") for n, c in values.items())), order, width)
    w = within(keys, order).rowsBetween(Window.unboundedPreceding, -1 if until_before else 0)
    at = F.struct(*names(order))
    rows = rows.select("*", *(F.last(f"__x_{n}", ignorenulls=True).over(w).alias(f"__l_{n}") for n in values))
    cells = cells_of(rows, keys, **{f"__c_{n}": F.max_by(f"__x_{n}", F.when(F.col(f"__x_{n}").isNotNull(), at)) for n in values})
    cells = cells.select("*", *(F.last(f"__c_{n}", ignorenulls=True).over(earlier(keys)).alias(f"__b_{n}") for n in values))
    out = with_borders(rows, cells, keys, *(f"__b_{n}" for n in values))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.coalesce(f"__l_{n}", f"__b_{n}").alias(n) for n in values))


#: Cells that a key's values are cut to.
VALUE_CELLS = 64


def value_counts(df: DataFrame, keys: Names, value: str, cells: int = VALUE_CELLS, **figures: Column) -> DataFrame:
    """(keys, value, figures, ``_cell``): a row for each value of a key, values alike combined before they shuffle, in cells that are
    ranges of values of about equal numbers of rows. Where the ranges lie is estimated; what follows from them is not."""
    keys = names(keys)
    rows = df.groupBy(*keys, value).agg(*(c.alias(n) for n, c in figures.items()))
    marks = rows.groupBy(*keys).agg(F.percentile_approx(value, [k / cells for k in range(1, cells)], 10 * cells).alias("__marks"))
    place = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("__marks", lambda m: m < F.col(value)))).cast("long")
    return with_columns_of(rows, marks, keys, "__marks").withColumn("_cell", place).drop("__marks")


def counted_below(df: DataFrame, keys: Names, value: str, cells: int = VALUE_CELLS) -> DataFrame:
    """(keys, value, ``_n``, ``_upto``): rows with that value, and with no larger one; missing values come first."""
    rows = running(value_counts(df, keys, value, cells, _n=F.count(F.lit(1))), keys, value, sums={"_upto": F.col("_n")})
    return rows.drop("_cell")


def average_ranks(df: DataFrame, keys: Names, value: str, to: str, cells: int = VALUE_CELLS) -> DataFrame:
    """(keys, value, ``to``): the average rank of rows with that value."""
    return counted_below(df, keys, value, cells).select(*names(keys), value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(to))


def exact_quantiles(df: DataFrame, keys: Names, value: str, chances: Sequence[float], to: str, cells: int = VALUE_CELLS) -> DataFrame:
    """(keys, ``to``): an array of quantiles with linear interpolation, as ``percentile`` has them; its places are found from counts
    of ranges and then of values, so no task sorts a key or holds its values."""
    keys = names(keys)
    counts = counted_below(df.filter(F.col(value).isNotNull()), keys, value, cells)
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("__total"))
    counts = with_columns_of(counts, total, keys, "__total")
    at = [F.lit(float(p)) * (F.col("__total") - 1) for p in chances]
    has = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
    found = counts.groupBy(*keys).agg(F.max("__total").alias("__total"), *(F.max(F.when(has(edge(x)), F.col(value).cast("double"))).alias(f"__{side}{k}") for k, x in enumerate(at) for side, edge in (("low", F.floor), ("high", F.ceil))))
    between = [F.col(f"__low{k}") + (F.col(f"__high{k}") - F.col(f"__low{k}")) * (x - F.floor(x)) for k, x in enumerate(at)]
    return found.select(*keys, F.array(*between).alias(to))


def by_blocks(df: DataFrame, f: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, keys: Names = "symbol", order: Names = "ts", block: int = BLOCK, width: float | None = None) -> DataFrame:
    """``f(df)`` for an ``f`` whose rows look at most ``back`` rows of their key back, and ``ahead`` rows on, over blocks of ``block``
    rows.

    ``f`` sees each block as a key of its own (the first key column tells): the last ``back`` rows of the block before, its own, and
    the first ``ahead`` of the next. What it makes of the borrowed rows is left out. ``f`` keeps the columns it doesn't know."""
    first = names(keys)[0]
    block = max(block, back, ahead, 1)
    rows = numbered(df, keys, order, "__i", width)
    place, own = F.pmod("__i", F.lit(block)), F.floor(F.col("__i") / block)
    lent = F.array_compact(F.array(F.lit(0), F.when(place >= block - back, 1) if back else F.lit(None).cast("int"), F.when((place < ahead) & (own > 0), -1) if ahead else F.lit(None).cast("int")))
    rows = rows.withColumn("__block", own).withColumn("__lent", F.explode(lent))
    name = F.concat_ws("\x01", F.to_json(F.struct(F.col(first))), (F.col("__block") + F.col("__lent")).cast("string"))
    rows = rows.withColumn("__own", F.col(first)).withColumn(first, name).drop("__i", "__block")
    return f(rows).filter("__lent = 0").withColumn(first, F.col("__own")).drop("__own", "__lent")
