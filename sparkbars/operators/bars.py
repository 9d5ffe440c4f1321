"""Bars from ticks, periods, cleaning, freshness, direction, and aligned windows of two timeframes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, ratio, series, yes


def resample_bars(df: DataFrame, width: str = "1 hour", price: str | None = None, tie: str | None = None) -> DataFrame:
    """Bars of a fixed width from ticks (``price``) or from finer bars. Open and close are by time, then by ``tie``."""
    first, last = ((price, price) if price else ("open", "close"))
    high, low = ((price, price) if price else ("high", "low"))
    order = F.struct("ts", tie) if tie else F.col("ts")
    volume = F.count(F.lit(1)).cast("double") if price else F.sum("volume")
    out = df.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by(first, order).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(last, order).alias("close"), volume.alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def filter_period(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def tag_period(df: DataFrame, periods: DataFrame, ts: str = "ts") -> DataFrame:
    """A row for each period (``period``, ``start``, ``end``, both ends included) that it falls in. They meet by day."""
    days = periods.select("period", "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_day"))
    out = df.withColumn("_day", F.to_date(ts)).join(days, "_day").filter(F.col(ts).between(F.col("start"), F.col("end")))
    return out.drop("start", "end", "_day")


def period_coverage(df: DataFrame, periods: DataFrame) -> DataFrame:
    return tag_period(df, periods).groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("bars"))


def clean_bars(df: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Without rows that miss a price or close at zero or below; infinite or missing features are null."""
    out = df.na.drop(subset=["open", "high", "low", "close"]).filter("NOT isnan(close) AND close > 0")
    for c in features:
        out = out.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)))
    return out


def freshness(df: DataFrame, now: Column, hours: float = 72, key: str = "symbol", ts: str = "ts") -> DataFrame:
    out = df.groupBy(key).agg(F.max(ts).alias("last"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("last")) / 3600.0
    return out.select(key, "last", age.alias("age_hours"), F.coalesce(age > hours, F.lit(True)).alias("stale"))


def direction(df: DataFrame, most_doji: float = 0.5) -> DataFrame:
    """Sign of a bar's body; in a series where more bars than that have none, the sign of the step between closes."""
    body = F.signum(F.col("close") - F.col("open"))
    step = F.signum(F.col("close") - F.lag("close").over(series()))
    doji = F.avg((F.col("close") == F.col("open")).cast("double")).over(Window.partitionBy("symbol"))
    return df.withColumn("direction", F.when(doji > most_doji, F.coalesce(step, F.lit(0.0))).otherwise(body))


def pips(df: DataFrame, multipliers: DataFrame, a: str, b: str) -> DataFrame:
    """(a - b) times the symbol's multiplier (``symbol``, ``multiplier``: one row for each), 10000 where there is none."""
    return df.join(multipliers, "symbol", "left").withColumn("pips", (F.col(a) - F.col(b)) * F.coalesce("multiplier", F.lit(10_000.0))).drop("multiplier")


def pair_windows(micro: DataFrame, macro: DataFrame, width: str = "15 minutes", how: str = "inner") -> DataFrame:
    """Fine and coarse bars (both with ``direction`` and ``atr``) put into the same windows and joined on them."""
    fine = micro.withColumn("flip", F.when((F.col("direction") != 0) & (F.lag("direction").over(series()) != 0), (F.col("direction") != F.lag("direction").over(series())).cast("double")))
    body = F.abs(F.col("close") - F.col("open"))
    weighted = ratio(F.sum(F.col("direction") * body), F.sum(body))
    fine = fine.groupBy("symbol", F.window("ts", width)["start"].alias("start")).agg(
        F.count(F.lit(1)).alias("n"), weighted.alias("lean"), F.stddev_samp("direction").alias("spread"), F.avg("flip").alias("flips"), F.avg("atr").alias("micro_atr"),
        F.sum((F.col("direction") > 0).cast("int")).alias("ups"), F.sum((F.col("direction") < 0).cast("int")).alias("downs"),
    )
    coarse = macro.groupBy("symbol", F.window("ts", width)["start"].alias("start")).agg(F.max_by("close", "ts").alias("macro_close"), F.min_by("open", "ts").alias("macro_open"), F.avg("atr").alias("macro_atr"))
    return fine.join(coarse, ["symbol", "start"], how)


def coherence_scores(windows: DataFrame, least: int = 3) -> DataFrame:
    """Windows whose coarse bar has a body and whose fine bars lean to a side; score 0..1."""
    sign = F.signum(F.col("macro_close") - F.col("macro_open"))
    agree = ratio(F.when(sign > 0, F.col("ups")).otherwise(F.col("downs")).cast("double"), (F.col("ups") + F.col("downs")).cast("double"))
    score = 0.6 * F.coalesce(agree, F.lit(0.0)) + 0.4 * F.greatest(F.lit(0.0), 1 - F.coalesce("spread", F.lit(0.0)))
    return windows.filter((F.col("n") >= least) & (sign != 0) & (F.abs("lean") > 0.05)).select("symbol", "start", score.alias("score"))


def disorder_scores(windows: DataFrame, least: int = 3) -> DataFrame:
    sign = F.signum(F.col("macro_close") - F.col("macro_open"))
    against = ratio(F.when(sign > 0, F.col("downs")).when(sign < 0, F.col("ups")).cast("double"), (F.col("ups") + F.col("downs")).cast("double"))
    wild = clip((ratio(F.col("micro_atr"), F.col("macro_atr")) - 0.5) / 1.5, 0, 1)
    score = 0.40 * F.coalesce("flips", F.lit(0.0)) + 0.25 * F.coalesce(wild, F.lit(0.5)) + 0.35 * F.coalesce(against, F.lit(0.5))
    return windows.filter(F.col("n") >= least).select("symbol", "start", score.alias("score"))


def score_summary(scores: DataFrame) -> DataFrame:
    p = F.percentile("score", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    return scores.groupBy("symbol").agg(F.count(F.lit(1)).alias("windows"), (F.avg("score") * 100).alias("mean_score"), p.alias("p")).select("symbol", "windows", "mean_score", *(F.col("p")[k].alias(f"p{n}") for k, n in enumerate((10, 25, 50, 75, 90))))


def period_diagnostics(bars: DataFrame, blocks: int = 5) -> DataFrame:
    """Each symbol's bars in equal blocks of time: runs of one direction, reversals, ranges, the largest one-way move, volume
    by session; with ``adx`` or ``ema<n>`` among the columns also the share of bars with ADX above 35, and the averages' mean
    step."""
    emas = [c for c in bars.columns if c.startswith("ema") and c[3:].isdigit()]
    span = Window.partitionBy("symbol")
    t = F.unix_timestamp("ts")
    out = bars.withColumn("block", F.least(F.lit(blocks - 1), F.floor((t - F.min(t).over(span)) * blocks / F.greatest(F.lit(1), F.max(t).over(span) - F.min(t).over(span)))).cast("int"))
    w = Window.partitionBy("symbol", "block").orderBy("ts")
    sign = F.signum(F.col("close") - F.col("open"))
    out = out.withColumn("sign", sign).withColumn("turn", F.when(F.lag("sign").over(w).isNull() | (F.lag("sign").over(w) != F.col("sign")), 1).otherwise(0)).withColumn("run", F.sum("turn").over(w))
    h = F.hour("ts")
    sessions = {"asia": (0, 8), "london": (8, 17), "ny": (13, 21), "overlap": (13, 17)}
    more = [F.avg(F.when((h >= a) & (h < b), F.col("volume"))).alias(f"volume_{k}") for k, (a, b) in sessions.items()]
    if "adx" in bars.columns:
        more.append(F.avg(yes(F.col("adx") > 35).cast("double")).alias("adx_above_35"))
    out = out.select("*", *((F.col(c) - F.lag(c).over(w)).alias(f"_step_{c}") for c in emas))
    more += [F.avg(f"_step_{c}").alias(f"{c}_step") for c in emas]
    runs = out.groupBy("symbol", "block", "run").agg(F.count(F.lit(1)).alias("length"), F.sum(F.col("close") - F.col("open")).alias("move"))
    runs = runs.groupBy("symbol", "block").agg(F.avg(F.when(F.col("length") > 1, F.col("length"))).alias("mean_run"), F.max(F.abs("move")).alias("largest_move"))
    rest = out.groupBy("symbol", "block").agg(F.count(F.lit(1)).alias("bars"), F.avg(F.col("high") - F.col("low")).alias("mean_range"), F.avg(F.col("turn").cast("double")).alias("reversals"), F.avg(yes(F.col("sign") == 0).cast("double")).alias("doji"), *more)
    return rest.join(runs, ["symbol", "block"])
