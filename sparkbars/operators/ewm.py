"""Exponential recurrences y = a * x + (1 - a) * y_before, exact, for many columns in one pass.

As windows: y_t is the sum of a * (1 - a)**(t - j) * x_j. The sum runs over stretches of values, each so long that what
came before it has faded to 1e-200; so a stretch needs the value at which the one before ended, and nothing earlier. All
of it is a frame over the key's rows, in the order that other frames have: no Python and no further shuffle.

A key with very many rows can be dealt out in blocks of time instead: within a block the same frames run from its first value,
which gives its last value and, from the number of its values, the factor by which what came before has faded; a fold over these
few rows carries values forward, and each row adds its share. Missing x keep y; y begins with the first x.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import with_columns_of


def _by_frames(df: DataFrame, columns: dict[str, tuple[str, float]], key: str, order: str) -> DataFrame:
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_{kind}_{name}" for name in columns for kind in ("i", "s", "y", "e")]
    out, plan = df, []
    for name, (x, a) in columns.items():
        keep = 1 - a
        length = 1 << 30 if keep <= 0 else max(1, int(200 * math.log(10) / -math.log(keep))) if keep < 1 else 1 << 30
        plan.append((name, F.col(x).cast("double"), a, keep, length))
    # the place of each value among those that are not missing, and its stretch
    count = {name: F.count(x).over(upto) - 1 for name, x, *_ in plan}
    out = out.select("*", *(F.pmod(count[name], F.lit(n)).alias(f"_i_{name}") for name, _, _, _, n in plan), *(F.floor(count[name] / n).alias(f"_s_{name}") for name, _, _, _, n in plan))
    # what a stretch gives from zero
    def local(name: str, x: Column, a: float, keep: float) -> Column:
        i = F.col(f"_i_{name}")
        if keep <= 0:
            return x
        own = Window.partitionBy(key, f"_s_{name}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.lit(a) * F.pow(F.lit(keep), i) * F.sum(x * F.pow(F.lit(keep), -i)).over(own)

    out = out.select("*", *(F.when(x.isNotNull(), local(name, x, a, keep)).alias(f"_y_{name}") for name, x, a, keep, _ in plan))
    # where the stretch before it ended; before the first, the first value stands in
    ended = lambda name, n: F.last(F.when(F.col(f"_i_{name}") == n - 1, F.col(f"_y_{name}")), ignorenulls=True).over(before)
    first = lambda x: F.first(x, ignorenulls=True).over(upto)
    out = out.select("*", *((F.col(f"_y_{name}") + F.pow(F.lit(max(keep, 0.0)), F.col(f"_i_{name}") + 1) * F.coalesce(ended(name, n), first(x))).alias(f"_e_{name}") for name, x, _, keep, n in plan))
    return out.select(*df.columns, *(F.last(f"_e_{name}", ignorenulls=True).over(upto).alias(name) for name in columns)).drop(*names)


def _by_blocks(df: DataFrame, columns: dict[str, tuple[str, float]], key: str, order: str, block: Column) -> DataFrame:
    rows = df.withColumn("_block", block).withColumn("_own", F.concat_ws("\x01", F.to_json(F.struct(key)), F.col("_block").cast("string")))
    rows = _by_frames(rows, {f"_own_{n}": x for n, x in columns.items()}, "_own", order)
    upto = Window.partitionBy("_own").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.count(x).over(upto).alias(f"_at_{n}") for n, (x, _) in columns.items()))
    figures = [c for n, (x, _) in columns.items() for c in (F.min_by(F.col(x).cast("double"), F.when(F.col(x).isNotNull(), F.col(order))).alias(f"_first_{n}"), F.max_by(f"_own_{n}", order).alias(f"_end_{n}"), F.max(f"_at_{n}").alias(f"_n_{n}"))]
    cells = rows.groupBy(key, "_block").agg(*figures)
    every = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", *(c for c in cells.columns if c not in (key, "_block"))))).alias("_cells"))

    def before(n: str, a: float) -> Column:
        """For each block the value that the one before it ended with, null before the first."""
        none = F.lit(None).cast("double")

        def step(acc: Column, c: Column) -> Column:
            first, y = c[f"_first_{n}"], acc["y"]
            after = F.when(c[f"_n_{n}"] == 0, y).otherwise(c[f"_end_{n}"] + F.pow(F.lit(1 - a), c[f"_n_{n}"]) * (F.coalesce(y, first) - first))
            return F.struct(after.alias("y"), F.concat(acc["all"], F.array(y)).alias("all"))

        return F.aggregate("_cells", F.struct(none.alias("y"), F.array().cast("array<double>").alias("all")), step, lambda acc: acc["all"])

    zipped = F.explode(F.arrays_zip(F.col("_cells").alias("c"), *(before(n, a).alias(f"_before_{n}") for n, (_, a) in columns.items())))
    borders = every.select(key, zipped.alias("z")).select(key, F.col("z.c._block").alias("_block"), *(F.col(f"z.c._first_{n}").alias(f"_first_{n}") for n in columns), *(F.col(f"z._before_{n}").alias(f"_before_{n}") for n in columns))
    out = with_columns_of(rows, borders, [key, "_block"], *(f"_{k}_{n}" for n in columns for k in ("first", "before")))

    def value(n: str, a: float) -> Column:
        own, y = F.col(f"_own_{n}"), F.col(f"_before_{n}")
        return F.when(own.isNull(), y).when(y.isNull(), own).otherwise(own + F.pow(F.lit(1 - a), F.col(f"_at_{n}")) * (y - F.col(f"_first_{n}")))

    return out.select(*df.columns, *(value(n, a).alias(n) for n, (_, a) in columns.items()))


def ewm(df: DataFrame, columns: dict[str, tuple[str, float]], key: str = "symbol", order: str = "ts", block: Column | None = None) -> DataFrame:
    """``df`` with a column for each name in ``columns``: (column of x, alpha). block: a number that grows with time."""
    return _by_frames(df, columns, key, order) if block is None else _by_blocks(df, columns, key, order, block)


def seeded(x: Column, n: int, key: str = "symbol", order: str = "ts") -> Column:
    """x for a Wilder mean that begins with the plain mean of the first n values: null before, that mean at the n-th."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    count = F.count(x).over(w)
    return F.when(count > n, x).when((count == n) & x.isNotNull(), F.avg(x).over(w))
