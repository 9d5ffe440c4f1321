"""Signals: votes, scores, gates, entry rules compiled from configurations, stops and targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import series, share, yes

def votes(df: DataFrame, buy: float = 35, sell: float = 75, tolerance: float = 0.002) -> DataFrame:
    """Two of three: RSI extreme, MACD cross, touch of a band. A sell overrides a buy."""
    c = F.col("close")
    n_buy = sum(yes(x).cast("int") for x in (F.col("rsi_w") < buy, F.col("cross") == 1, c <= F.col("bb_lower") * (1 + tolerance)))
    n_sell = sum(yes(x).cast("int") for x in (F.col("rsi_w") > sell, F.col("cross") == -1, c >= F.col("bb_upper") * (1 - tolerance)))
    return df.withColumn("buy_votes", n_buy).withColumn("sell_votes", n_sell).withColumn("signal", F.when(F.col("sell_votes") >= 2, -1).when(F.col("buy_votes") >= 2, 1).otherwise(0))


def weighted_score(df: DataFrame, buy: float = 35, sell: float = 75, p: Sequence[tuple[str, float]] = (("lstm_prob", 20), ("xgboost_prob", 21))) -> DataFrame:
    """Seven parts for each side, 0..100; rounded where a signal fired, else 0."""
    zero = F.lit(0.0)
    rsi, k = F.col("rsi_w"), F.coalesce(F.col("stoch_k"), F.lit(50.0))
    pct = F.greatest(zero, F.least(F.lit(1.0), F.coalesce(F.col("bb_pct"), F.lit(0.5))))
    adx = F.greatest(zero, F.least(F.lit(50.0), F.coalesce(F.col("adx"), zero))) / 50 * 10
    up = [F.coalesce(F.greatest(buy - rsi, zero), zero) / buy * 14, F.when(F.col("cross") == 1, 14.0).when(yes(F.col("macd") > F.col("macd_signal")), 7.0).otherwise(0.0), (1 - pct) * 11, adx, F.greatest(25 - k, zero) / 25 * 10]
    down = [F.coalesce(F.greatest(rsi - sell, zero), zero) / (100 - sell) * 14, F.when(F.col("cross") == -1, 14.0).when(yes(F.col("macd") < F.col("macd_signal")), 7.0).otherwise(0.0), pct * 11, adx, F.greatest(k - 75, zero) / 25 * 10]
    for name, w in p:
        x = F.coalesce(F.col(name), F.lit(50.0))
        up.append(F.greatest(x - 50, zero) / 50 * w)
        down.append(F.greatest(50 - x, zero) / 50 * w)
    total = lambda parts: F.greatest(zero, F.least(F.lit(100.0), sum(parts[1:], parts[0])))
    out = df.withColumn("buy_score", total(up)).withColumn("sell_score", total(down))
    return out.withColumn("score", F.when(F.col("signal") == 1, F.round("buy_score", 1)).when(F.col("signal") == -1, F.round("sell_score", 1)).otherwise(0.0))


def apply_gates(df: DataFrame, block_range: bool = True, consensus: bool = True, adx_atr: bool = True, adx_min: float = 20, atr_min: float = 0.8) -> DataFrame:
    """Signals that pass: not in a range, both models on the signal's side, enough trend and movement."""
    s, ok = F.col("signal"), F.lit(True)
    if block_range:
        ok = ok & yes(F.col("adx_regime") != "RANGE")
    if consensus:
        ok = ok & (((s == 1) & yes((F.col("lstm_prob") > 50) & (F.col("xgboost_prob") > 50))) | ((s == -1) & yes((F.col("lstm_prob") < 50) & (F.col("xgboost_prob") < 50))))
    if adx_atr:
        ok = ok & yes((F.col("adx") >= adx_min) & (F.coalesce(F.col("atr_ratio"), F.lit(0.0)) >= atr_min))
    return df.withColumn("gated", F.when(ok, s).otherwise(0))


def ensemble(df: DataFrame, adjustment: str = "adjustment") -> DataFrame:
    """Blend of two models and the votes 40/40/20; the final score only where a signal fired."""
    lean = F.when(F.col("signal") == 1, 100.0).when(F.col("signal") == -1, 0.0).otherwise(50.0)
    out = df.withColumn("ensemble_prob", 0.4 * F.coalesce("lstm_prob", F.lit(50.0)) + 0.4 * F.coalesce("xgboost_prob", F.lit(50.0)) + 0.2 * lean)
    final = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") + F.coalesce(F.col(adjustment), F.lit(0.0))))
    return out.withColumn("final_score", F.when(F.col("signal") != 0, final).otherwise(0.0))


RULES = ("feature_threshold", "multi_condition", "mean_reversion", "trend_follow", "crossover", "breakout", "oscillator_extremes", "ema_slope", "momentum", "momentum_atr", "volatility_breakout", "range_breakout")


def _compare(c: Mapping) -> Column:
    x, v = F.col(c["feature"]), F.lit(float(c["value"]))
    return {">": x > v, "<": x < v, ">=": x >= v, "<=": x <= v, "==": x == v}[c["op"]]


def entry_rule(config: Mapping) -> Column:
    """A rule as a column of 1, -1 and 0; missing values give 0."""
    kind, th = config.get("type"), float(config.get("threshold", 0))
    col = lambda name, default: F.col(config.get(name, default))
    if kind == "feature_threshold":
        return F.when(yes(_compare(config)), int(config.get("direction", 1))).otherwise(0)
    if kind == "multi_condition":
        every = F.lit(True)
        for c in config["conditions"]:
            every = every & yes(_compare(c))
        return F.when(every, int(config.get("direction", 1))).otherwise(0)
    if kind == "mean_reversion":
        x = col("feature", "ema_distance")
        up, down = x < -th, x > th
    elif kind == "trend_follow":
        up, down = F.col("bias") == 1, F.col("bias") == -1
    elif kind == "crossover":
        x = col("feature", "ema20_slope")
        before = F.lag(x).over(series())
        up, down = (x > th) & (before <= th), (x < -th) & (before >= -th)
    elif kind == "breakout":
        up, down = F.col("close") > F.col("prior_max"), F.col("close") < F.col("prior_min")
    elif kind == "oscillator_extremes":
        x = col("feature", "rsi")
        up, down = x < float(config.get("low", 30)), x > float(config.get("high", 70))
    elif kind == "ema_slope":
        slope, dist = col("slope", "ema20_slope"), col("distance", "ema20_distance")
        up, down = (slope > th) & (dist > 0), (slope < -th) & (dist < 0)
    elif kind in ("momentum", "momentum_atr"):
        x = col("feature", "mom10")
        size = F.col("atr") * float(config.get("k", 1.0)) if kind == "momentum_atr" else F.lit(th)
        up, down = x > size, x < -size
    elif kind == "volatility_breakout":
        up, down = (F.col("atr_ratio") > th) & (F.col("bias") == 1), (F.col("atr_ratio") > th) & (F.col("bias") == -1)
    elif kind == "range_breakout":
        up, down = (F.col("atr_ratio") < th) & (F.col("bias") == 1), (F.col("atr_ratio") < th) & (F.col("bias") == -1)
    else:
        raise ValueError(f"unknown rule {kind!r}; one of {RULES}")
    return F.when(yes(up), 1).when(yes(down), -1).otherwise(0)


#: Eight named rules with their exits (ATR multiples) and the direction they take.
CATALOGUE = {
    "stretch_reversion": ({"type": "mean_reversion", "threshold": 1.5}, {"sl_atr": 1.5, "tp_atr": 2.0}),
    "trend": ({"type": "trend_follow"}, {"sl_atr": 2.0, "tp_atr": 3.0}),
    "slope_cross": ({"type": "crossover"}, {"sl_atr": 1.5, "tp_atr": 2.5}),
    "breakout": ({"type": "breakout"}, {"sl_atr": 2.0, "tp_atr": 4.0}),
    "rsi_extremes": ({"type": "oscillator_extremes", "low": 30, "high": 70}, {"sl_atr": 1.5, "tp_atr": 2.0}),
    "slope_distance": ({"type": "ema_slope"}, {"sl_atr": 2.0, "tp_atr": 3.0}),
    "momentum": ({"type": "momentum_atr", "k": 1.0}, {"sl_atr": 2.0, "tp_atr": 3.0}),
    "volatility": ({"type": "volatility_breakout", "threshold": 1.2}, {"sl_atr": 2.5, "tp_atr": 4.0}),
}


def stop_target(df: DataFrame, exits: Mapping, signal: str = "signal", entry: str = "close") -> DataFrame:
    """Stop and target by ATR multiples, or by fixed pips."""
    s, e = F.col(signal), F.col(entry)
    if "sl_pips" in exits:
        size = float(exits.get("pip", 0.0001))
        down, up = F.lit(exits["sl_pips"] * size), F.lit(exits["tp_pips"] * size)
    else:
        down, up = F.col("atr") * float(exits["sl_atr"]), F.col("atr") * float(exits["tp_atr"])
    return df.withColumn("sl", F.when(s != 0, e - s * down)).withColumn("tp", F.when(s != 0, e + s * up))


def mtf_confluence(frames: Mapping[str, DataFrame]) -> DataFrame:
    """The last completed bar (the second to last) of each timeframe; two of three agree."""
    last_two = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    parts = [df.withColumn("_n", F.row_number().over(last_two)).filter("_n = 2").select("symbol", F.lit(name).alias("timeframe"), "signal") for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    up, down = (F.sum((F.col("signal") == x).cast("int")) for x in (1, -1))
    return out.groupBy("symbol").agg(up.alias("ups"), down.alias("downs"), F.when(up >= 2, 1).when(down >= 2, -1).otherwise(0).alias("confluence"))


def sentiment_adjustment(df: DataFrame, sentiment: DataFrame) -> DataFrame:
    """signal x direction x confidence x 15. sentiment: ``symbol``, ``sentiment``, ``confidence``, a row for each symbol."""
    lean = F.when(F.col("sentiment") == "positive", 1).when(F.col("sentiment") == "negative", -1).otherwise(0)
    return df.join(sentiment, "symbol", "left").withColumn("adjustment", F.coalesce(F.col("signal") * lean * F.col("confidence") * 15, F.lit(0.0))).drop("sentiment", "confidence")


def macro_adjustment(df: DataFrame, tone: str, symbols: Sequence[str], size: float = 10) -> DataFrame:
    """A hawkish tone helps sells of the listed symbols and hurts buys; a dovish one the other way."""
    lean = F.when(F.col(tone) == "hawkish", -1).when(F.col(tone) == "dovish", 1).otherwise(0)
    return df.withColumn("macro_adjustment", F.when(F.col("symbol").isin(*symbols), size * lean * F.col("signal")).otherwise(0.0))


def confirmation_filter(df: DataFrame, adx_min: float = 25, stoch: float = 25) -> DataFrame:
    s = F.col("signal")
    ok = yes(F.col("adx") >= adx_min) & (((s == 1) & yes(F.col("stoch_k") < 100 - stoch)) | ((s == -1) & yes(F.col("stoch_k") > stoch)))
    return df.withColumn("confirmed", F.when(ok, s).otherwise(0))


def threshold_survival(df: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Count and share of scores at or above each threshold, in one pass."""
    counts = df.groupBy("symbol").agg(F.count(score).alias("n"), *(F.sum((F.col(score) >= t).cast("int")).alias(f"_{k}") for k, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{k}").alias("kept")) for k, t in enumerate(thresholds))))
    return counts.select("symbol", "n", rows.alias("r")).select("symbol", "r.threshold", "r.kept", (F.col("r.kept") / F.col("n")).alias("share"))


def latest_signal(df: DataFrame) -> DataFrame:
    return df.filter("signal != 0").groupBy("symbol").agg(F.max_by(F.struct("ts", "signal", "close"), "ts").alias("x")).select("symbol", "x.*")


def signal_rates(df: DataFrame) -> DataFrame:
    s = F.col("signal")
    return df.groupBy("symbol").agg(share(s == 1).alias("buy"), share(s == -1).alias("sell"))
