"""As-of, barrier, interval and other joins. None is a raw theta join: each has an equality on a symbol or a time cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import series, yes
from . import blocks


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], key: str = "symbol", at: str = "ts", right_at: str = "ts", forward: bool = False, strict: bool = False, cell: int = 86_400) -> DataFrame:
    """``left`` with the values of the last row of ``right`` at or before its time (forward: the first at or after).

    Both sides go by key and cell of ``cell`` seconds (or, where times are numbers, units), so a key with many rows is sorted in many tasks: a row's match is the
    last row of the other side in its cell, or else the one that earlier cells ended with, carried over a row for each
    cell. strict: not at the same time. The match's own time comes as ``asof_ts``. Rows without a time match nothing.
    """
    match = F.struct(F.col(right_at).alias("asof_ts"), *values).alias("_m")
    # at equal times the right side comes first unless that would match strictly
    first = 0 if not strict else 2
    number = isinstance(right.schema[right_at].dataType, T.NumericType)
    in_cell = lambda t: F.floor((F.col(t) if number else F.unix_timestamp(t)) / cell)
    other = right.filter(F.col(right_at).isNotNull()).select(key, F.col(right_at).alias("_t"), F.lit(first).alias("_side"), match, in_cell(right_at).alias("_c"))
    rows = left.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), in_cell(at).alias("_c"))
    nothing = F.lit(None).cast(other.schema["_m"].dataType)
    rows = rows.withColumn("_m", nothing).unionByName(other.withColumn("_l", F.lit(None).cast(rows.schema["_l"].dataType)))
    order = [F.desc("_t"), F.col("_side")] if forward else [F.col("_t"), F.col("_side")]
    inside = Window.partitionBy(key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_m", F.last("_m", ignorenulls=True).over(inside)).filter("_side = 1")
    # cells of either side, with what each ends with; the last before a cell is what its rows begin with
    cells = other.groupBy(key, "_c").agg((F.min_by if forward else F.max_by)("_m", "_t").alias("_e")).unionByName(left.select(key, in_cell(at).alias("_c")).distinct().withColumn("_e", nothing)).groupBy(key, "_c").agg(F.first("_e", ignorenulls=True).alias("_e"))
    ahead = Window.partitionBy(key).orderBy(F.desc("_c") if forward else F.col("_c")).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(F.col(key).alias("_key"), F.col("_c").alias("_cell"), F.last("_e", ignorenulls=True).over(ahead).alias("_before")).filter("_cell IS NOT NULL AND _before IS NOT NULL")
    out = rows.join(carried, (F.col(key) == F.col("_key")) & (F.col("_c") == F.col("_cell")), "left").withColumn("_m", F.when(F.col("_t").isNotNull(), F.coalesce("_m", "_before")))
    return out.select("_l.*", *(F.col(f"_m.{c}").alias(c) for c in ("asof_ts", *values)))


def asof_features(trades: DataFrame, bars: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """The last bar at or before the hour of entry; defaults where there is none."""
    hour = trades.withColumn("_hour", F.date_trunc("hour", "entry_time").cast("timestamp_ntz"))
    out = asof(hour, bars, list(values), at="_hour").drop("_hour", "asof_ts")
    return out.select(*(c for c in out.columns if c not in values), *(F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in values.items()))


def alignment(df: DataFrame) -> DataFrame:
    d, b = F.col("direction"), F.coalesce(F.col("bias"), F.lit(0))
    return df.withColumn("alignment", F.when(b == 0, "NEUTRAL").when(d == b, "ALIGNED").otherwise("COUNTER")).withColumn("mr_setup", yes((F.abs("ema_distance") >= 1) & (F.signum("ema_distance") == -d)))


def resolve_barriers(trades: DataFrame, bars: DataFrame, max_bars: int = 48, tie: str = "SL") -> DataFrame:
    """Which of stop and target a trade's next ``max_bars`` bars touch first, and where it leaves.

    Trades have symbol, trade_id, entry_idx, direction, sl, tp; bars have idx. The bars a trade meets are reached through
    cells of ``max_bars`` indexes, so each trade reads two cells. A bar that touches both counts as ``tie``.
    """
    cell = lambda x: F.floor(x / max_bars)
    t = trades.withColumn("_cell", F.explode(F.array(cell(F.col("entry_idx") + 1), cell(F.col("entry_idx") + max_bars)))).dropDuplicates(["symbol", "trade_id", "_cell"])
    b = bars.select("symbol", "idx", F.col("high").alias("_h"), F.col("low").alias("_lo"), F.col("close").alias("_c"), cell(F.col("idx")).alias("_cell"))
    met = t.join(b, ["symbol", "_cell"]).filter(F.col("idx").between(F.col("entry_idx") + 1, F.col("entry_idx") + max_bars))
    up = F.col("direction") == 1
    sl = F.when(up, F.col("_lo") <= F.col("sl")).otherwise(F.col("_h") >= F.col("sl"))
    tp = F.when(up, F.col("_h") >= F.col("tp")).otherwise(F.col("_lo") <= F.col("tp"))
    first, second = (("SL_HIT", sl), ("TP_HIT", tp)) if tie == "SL" else (("TP_HIT", tp), ("SL_HIT", sl))
    met = met.withColumn("_hit", F.when(yes(first[1]), first[0]).when(yes(second[1]), second[0]))
    hit_idx = F.when(F.col("_hit").isNotNull(), F.col("idx"))
    out = met.groupBy("symbol", "trade_id").agg(F.min_by("_hit", hit_idx).alias("outcome"), F.min(hit_idx).alias("exit_idx"), F.max("idx").alias("_last"), F.max_by("_c", "idx").alias("_close"))
    out = trades.join(out, ["symbol", "trade_id"], "left")
    price = F.when(F.col("outcome") == "SL_HIT", F.col("sl")).when(F.col("outcome") == "TP_HIT", F.col("tp")).otherwise(F.col("_close"))
    return out.withColumn("exit_price", price).withColumn("exit_idx", F.coalesce("exit_idx", "_last")).withColumn("outcome", F.when(F.col("_last").isNotNull(), F.coalesce("outcome", F.lit("TIMEOUT")))).drop("_last", "_close")


def danger_zone(signals: DataFrame, events: DataFrame, seconds: int = 1800, at: str = "ts", key: str = "id") -> DataFrame:
    """Whether an event (``event_time``, ``title``) lies within so many seconds of a signal, and the nearest one's title.

    Rows don't grow with the events in a zone: those in it are the events up to its end less those before its begin, and the nearest
    is the last up to the signal or the first from it on (at equal distance the earlier; at equal times the smallest title).
    """
    us, width = lambda c: F.unix_micros(F.col(c).cast("timestamp")), seconds * 1_000_000
    cell = max(width, 3_600_000_000)
    times = events.filter("event_time IS NOT NULL").groupBy(us("event_time").alias("_at")).agg(F.min(F.struct("title")).alias("_l"), F.count(F.lit(1)).alias("_n")).select(F.lit(0).alias("_k"), "_at", "_l", "_n")
    counted = blocks.running(times, "_k", "_at", sums={"_upto": F.col("_n")}, width=cell)
    own = signals.select(key, F.lit(0).alias("_k"), us(at).alias("_t"))
    ends = F.explode(F.array(*(F.struct(F.lit(sign).alias("sign"), (F.col("_t") + d).alias("p")) for sign, d in ((0, 0), (1, width), (-1, -width - 1)))))
    before = asof(own.select("*", ends.alias("_s")).select(key, "_k", "_t", F.col("_s.sign").alias("_sign"), F.col("_s.p").alias("_p")), counted, ["_l", "_upto"], "_k", "_p", "_at", cell=cell)
    after = asof(own, times, ["_l"], "_k", "_t", "_at", forward=True, cell=cell).select(key, "_t", "asof_ts", "_l", F.lit(0).alias("_sign"), F.lit(0).cast("long").alias("_upto"))
    gap = F.abs(F.col("_t") - F.col("asof_ts"))
    nearest = F.when((F.col("_sign") == 0) & (gap <= width), F.struct(gap.alias("gap"), F.col("asof_ts").alias("at"), F.col("_l.title").alias("title")))
    found = before.select(*after.columns).unionByName(after).groupBy(key).agg(F.min(nearest).alias("_e"), F.sum(F.col("_sign") * F.col("_upto")).alias("events"))
    return signals.join(found, key, "left").withColumn("blocked", F.col("_e").isNotNull()).withColumn("title", F.col("_e.title")).withColumn("events", F.coalesce("events", F.lit(0))).drop("_e")


def upcoming_events(events: DataFrame, now: Column, n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    out = events.filter(F.col("event_time") >= now)
    if not keys:
        return out.orderBy("event_time", "title").limit(n)
    w = Window.partitionBy(*keys).orderBy("event_time", "title")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def trades_in_blocks(trades: DataFrame, blocks: DataFrame, at: str = "entry_time") -> DataFrame:
    """The block a trade lies in; blocks don't overlap, so the last that began is the only one."""
    out = asof(trades, blocks, ["end_ts", "island", "regime", "bars"], at=at, right_at="start_ts")
    return out.filter(F.col(at) <= F.col("end_ts")).withColumnRenamed("asof_ts", "start_ts")


def precursor_lookup(trades: DataFrame, bars: DataFrame, bucket: str = "B4", hours: float = 12) -> DataFrame:
    """The latest bar of a stretch bucket strictly before entry and at most so many hours before."""
    out = asof(trades, bars.filter(F.col("stretch_bucket") == bucket), ["close"], at="entry_time", strict=True)
    early = (F.unix_micros(F.col("entry_time").cast("timestamp")) - F.unix_micros(F.col("asof_ts").cast("timestamp"))) / 3.6e9
    fits = yes(early <= hours)
    return out.withColumn("hours_early", F.when(fits, early)).withColumn("early_entry", F.when(fits, F.col("close"))).drop("close", "asof_ts")


def early_trades(trades: DataFrame, bars: DataFrame, bucket: str = "B2", hours: float = 12, sl_atr: float = 1.5, tp_atr: float = 2.0, max_bars: int = 48) -> DataFrame:
    """Trades (symbol, trade_id, entry_time, direction, ...) as they had been if entered at the latest bar of a stretch bucket
    before them: ``hours_early``, ``early_entry``, ``early_sl`` and ``early_tp`` by that bar's ATR (0.0001 where it has none), and how
    that trade ends: ``early_outcome``, ``early_pnl``. Null where there is no such bar, the outcome then NO_PRECURSOR.

    bars: symbol, ts, idx, high, low, close, atr, stretch_bucket."""
    found = asof(trades, bars.filter(F.col("stretch_bucket") == bucket), ["close", "atr", "idx"], at="entry_time", strict=True)
    lead = (F.unix_micros(F.col("entry_time").cast("timestamp")) - F.unix_micros(F.col("asof_ts").cast("timestamp"))) / 3.6e9
    fits = yes(lead <= hours)
    size = F.when(F.col("atr") > 0, F.col("atr")).otherwise(0.0001) * F.col("direction")
    found = found.select(*trades.columns, *(F.when(fits, c).alias(n) for n, c in (("hours_early", lead), ("early_entry", F.col("close")), ("early_sl", F.col("close") - sl_atr * size), ("early_tp", F.col("close") + tp_atr * size), ("_early_idx", F.col("idx")))))
    legs = found.filter("early_entry IS NOT NULL").select("symbol", "trade_id", "direction", F.col("_early_idx").alias("entry_idx"), F.col("early_entry").alias("_from"), F.col("early_sl").alias("sl"), F.col("early_tp").alias("tp"))
    ends = resolve_barriers(legs, bars.select("symbol", "idx", "high", "low", "close"), max_bars).select("symbol", "trade_id", F.col("outcome").alias("early_outcome"), (F.col("direction") * (F.col("exit_price") - F.col("_from"))).alias("early_pnl"))
    out = found.drop("_early_idx").join(ends, ["symbol", "trade_id"], "left")
    return out.withColumn("early_outcome", F.when(F.col("early_entry").isNull(), "NO_PRECURSOR").otherwise(F.col("early_outcome")))


def fill_outcomes(signals: DataFrame, prices: DataFrame, horizons: Mapping[str, int], now: Column, at: str = "ts", key: str = "id") -> DataFrame:
    """Return in percent at the first price at or after each horizon (seconds); null until due; filled cells stay."""
    due = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(s).alias("s")) for h, s in horizons.items())))
    rows = signals.select(key, "symbol", at, "price", due.alias("d")).select(key, "symbol", "price", "d.h", F.timestamp_add("SECOND", F.col("d.s"), F.col(at)).alias("_due"))
    found = asof(rows.filter(F.col("_due") <= now), prices.withColumnRenamed("price", "later"), ["later"], at="_due", forward=True)
    wide = found.withColumn("r", (F.col("later") / F.nullif("price", F.lit(0.0)) - 1) * 100).groupBy(key).pivot("h", list(horizons)).agg(F.max("r"))
    new = signals.join(wide, key, "left")
    for h in horizons:
        new = new.withColumn(f"outcome_{h}", F.coalesce(F.col(f"outcome_{h}"), F.col(h)) if f"outcome_{h}" in signals.columns else F.col(h)).drop(h)
    return new


def exit_after(df: DataFrame, n: int, cost: float = 0.0, signal: str = "signal") -> DataFrame:
    """What a signal would have made n bars later; signals without that many bars go."""
    return df.withColumn("pnl", F.col(signal) * (F.lead("close", n).over(series()) - F.col("close")) - cost).filter((F.col(signal) != 0) & F.col("pnl").isNotNull())


def reindex_fill(bars: DataFrame, other: DataFrame, column: str) -> DataFrame:
    return bars.join(other.select("symbol", "ts", F.col(column).alias("_o")), ["symbol", "ts"], "left").withColumn(column, F.coalesce("_o", column)).drop("_o")


def with_baseline(df: DataFrame, baseline: DataFrame, keys: Sequence[str], default: Mapping[str, float]) -> DataFrame:
    out = df.join(baseline, list(keys), "left")
    return out.na.fill(dict(default))


def training_set(bars: DataFrame, signals: DataFrame, sentiment: str = "sentiment_score") -> DataFrame:
    return bars.join(signals, ["symbol", "ts"]).withColumn(sentiment, F.coalesce(sentiment, F.lit(0.0)))


def align_pairs(bars: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Closes of two symbols on their common times, for the ``pairs`` (``a``, ``b``) named; without these for every two, which
    grows with the square of the symbols and is for short lists of them."""
    a = bars.select("ts", F.col("symbol").alias("a"), F.col("close").alias("close_a"))
    b = bars.select("ts", F.col("symbol").alias("b"), F.col("close").alias("close_b"))
    if pairs is not None:
        return a.join(pairs.select("a", "b").distinct(), "a").join(b, ["ts", "b"]).select("a", "b", "ts", "close_a", "close_b")
    return a.join(b, "ts").filter("a < b").select("a", "b", "ts", "close_a", "close_b")


def param_grid(df: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Each row with each combination of parameters; the grid is part of the plan, nothing shuffles."""
    structs = [F.struct(F.lit(k).alias("combo"), *(F.lit(v).alias(c) for c, v in zip(grid, values))) for k, values in enumerate(product(*grid.values()))]
    return df.select("*", F.explode(F.array(*structs)).alias("_g")).select(*df.columns, "_g.*")


def exclude_listed(df: DataFrame, listed: DataFrame, key: str = "symbol") -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_anti")
