"""Stops and targets over long horizons, by an index of highs and lows.

``joins.resolve_barriers`` meets a trade with every bar of its horizon, which is right for short ones. Here each symbol's bars have
an index: the highest high and lowest low of stretches of ``RADIX`` bars, of ``RADIX`` such stretches, and so on. A horizon is cut to
the largest stretches that fit into it, about 2 * RADIX for each level; the first of them that reaches stop or target is opened into its parts,
level by level, down to the bar. So the rows that meet grow with the logarithm of the horizon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import yes
from .joins import asof

#: Parts of a stretch.
RADIX = 8


def range_index(bars: DataFrame, levels: int, radix: int = RADIX) -> DataFrame:
    """(symbol, ``level``, ``cell``, ``hi``, ``lo``): cell c of level k has the bars with idx from c * radix**k on."""
    level = bars.select("symbol", F.lit(0).alias("level"), F.col("idx").cast("long").alias("cell"), F.col("high").alias("hi"), F.col("low").alias("lo"))
    out = level
    for k in range(1, levels + 1):
        level = level.groupBy("symbol", F.floor(F.col("cell") / radix).alias("cell")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo")).select("symbol", F.lit(k).alias("level"), "cell", "hi", "lo")
        out = out.unionByName(level)
    return out


def stretches(first, end, levels: int, radix: int = RADIX):
    """array<struct<level, cell>> of the largest stretches that make up the numbers from ``first`` to before ``end``."""
    cells = lambda k, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda c: F.struct(F.lit(k).alias("level"), c.cast("long").alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))
    a, b, out = first.cast("long"), end.cast("long"), []
    for k in range(levels):
        up, down = F.ceil(a / radix), F.floor(b / radix)
        whole = up < down  # a larger stretch fits between
        out += [cells(k, a, F.when(whole, up * radix).otherwise(b)), cells(k, F.when(whole, down * radix).otherwise(b), b)]
        a, b = F.when(whole, up).otherwise(F.lit(0)).cast("long"), F.when(whole, down).otherwise(F.lit(0)).cast("long")
    return F.concat(*out, cells(levels, a, b))


def resolve_barriers_by_index(trades: DataFrame, bars: DataFrame, max_bars: int = 5000, tie: str = "SL", radix: int = RADIX) -> DataFrame:
    """What ``joins.resolve_barriers`` gives: ``outcome``, ``exit_idx``, ``exit_price``."""
    levels = 0
    while radix ** (levels + 1) <= max_bars:
        levels += 1
    index = range_index(bars, levels, radix)
    up = F.col("direction") == 1
    stopped = yes(F.when(up, F.col("lo") <= F.col("sl")).otherwise(F.col("hi") >= F.col("sl")))
    reached = yes(F.when(up, F.col("hi") >= F.col("tp")).otherwise(F.col("lo") <= F.col("tp")))
    size = F.element_at(F.array(*(F.lit(radix**k).cast("long") for k in range(levels + 1))), F.col("level") + 1)
    key, asked = ["symbol", "trade_id"], ["symbol", "trade_id", "direction", "sl", "tp"]

    def first_hit(cells: DataFrame) -> DataFrame:
        """Of each trade's stretches the first that reaches a barrier."""
        met = cells.join(index, ["symbol", "level", "cell"]).filter(stopped | reached)
        best = F.min(F.struct((F.col("cell") * size).alias("start"), "level", "cell", stopped.alias("stopped"), reached.alias("reached"))).alias("m")
        return met.groupBy(*asked).agg(best).select(*asked, "m.level", "m.cell", "m.stopped", "m.reached")

    found = first_hit(trades.select(*asked, F.explode(stretches(F.col("entry_idx") + 1, F.col("entry_idx") + 1 + max_bars, levels, radix)).alias("s")).select(*asked, "s.level", "s.cell"))
    for k in range(levels, 0, -1):
        parts = F.sequence(F.col("cell") * radix, F.col("cell") * radix + radix - 1)
        opened = found.filter(F.col("level") == k).select(*asked, F.lit(k - 1).alias("level"), F.explode(parts).alias("cell"))
        found = found.filter(F.col("level") < k).unionByName(first_hit(opened))
    first, second = (("SL_HIT", "stopped"), ("TP_HIT", "reached")) if tie == "SL" else (("TP_HIT", "reached"), ("SL_HIT", "stopped"))
    hit = found.select(*key, F.when(F.col(first[1]), first[0]).otherwise(second[0]).alias("outcome"), F.col("cell").alias("exit_idx"))
    out = trades.join(hit, key, "left").withColumn("_end", (F.col("entry_idx") + max_bars).cast("long"))
    closes = bars.select("symbol", F.col("idx").cast("long").alias("_at"), F.col("close").alias("_close"))
    out = asof(out, closes, ["_close"], at="_end", right_at="_at", cell=65_536)
    there = yes(F.col("asof_ts") > F.col("entry_idx"))
    price = F.when(F.col("outcome") == "SL_HIT", F.col("sl")).when(F.col("outcome") == "TP_HIT", F.col("tp")).when(there, F.col("_close"))
    out = out.withColumn("exit_price", price).withColumn("exit_idx", F.coalesce("exit_idx", F.when(there, F.col("asof_ts"))))
    return out.withColumn("outcome", F.coalesce("outcome", F.when(there, "TIMEOUT"))).select(*trades.columns, "outcome", "exit_idx", "exit_price")
