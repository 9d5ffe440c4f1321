"""Indicators and features over each symbol's bars. All frames share one partitioning by symbol, so one shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, last_rows, ratio, rolling, series, so_far, yes
from . import blocks
from .ewm import ewm, seeded



@dataclass(frozen=True)
class Indicator:
    """An indicator with recurrences: columns before them, the recurrences, columns from these, recurrences of those, and
    the results. Several are computed together, with one pass over each symbol for all recurrences of a step."""

    inputs: dict[str, Column] = field(default_factory=dict)
    first: dict[str, tuple[str, float]] = field(default_factory=dict)
    between: dict[str, Column] = field(default_factory=dict)
    second: dict[str, tuple[str, float]] = field(default_factory=dict)
    results: dict[str, Column] = field(default_factory=dict)


def with_indicators(df: DataFrame, *indicators: Indicator, block: Column | None = None) -> DataFrame:
    """``df`` with the columns of the indicators; names that begin with ``_`` are left out. block: deals the recurrences of a hot
    symbol out by a number that grows with time."""
    def columns(out: DataFrame, part: str) -> DataFrame:
        for one in indicators:
            for name, c in getattr(one, part).items():
                out = out.withColumn(name, c)
        return out

    def recurrences(out: DataFrame, part: str) -> DataFrame:
        every = {name: x for one in indicators for name, x in getattr(one, part).items()}
        return ewm(out, every, block=block) if every else out

    out = columns(recurrences(columns(recurrences(columns(df, "inputs"), "first"), "between"), "second"), "results")
    return out.drop(*(c for c in out.columns if c.startswith("_") and c not in df.columns))


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr_sma(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("tr", true_range()).withColumn("atr", rolling(F.avg, F.col("tr"), n))


def atr_wilder_parts(n: int = 14, to: str = "atr_w") -> Indicator:
    return Indicator({"_tr_seeded": seeded(true_range(), n)}, {to: ("_tr_seeded", 1 / n)})


def atr_wilder(df: DataFrame, n: int = 14, to: str = "atr_w") -> DataFrame:
    """The plain mean of the first n true ranges, then Wilder's; null before."""
    return with_indicators(df, atr_wilder_parts(n, to))


def atr_ratio(df: DataFrame, n: int = 20, least: int = 5, low: float = 0.2, high: float = 4.0) -> DataFrame:
    return df.withColumn("atr_ratio", clip(ratio(F.col("atr"), rolling(F.avg, F.col("atr"), n, least)), low, high))


def ema(df: DataFrame, column: str, *spans: int, block: Column | None = None) -> DataFrame:
    return ewm(df, {f"ema{s}": (column, 2 / (s + 1)) for s in spans}, block=block)


def rsi_wilder_parts(n: int = 14) -> Indicator:
    step = F.coalesce(F.col("close") - F.lag("close").over(series()), F.lit(0.0))
    value = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.nullif("_l", F.lit(0.0)))).when(F.col("_g") > 0, 100.0).otherwise(50.0)
    return Indicator(
        {"_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0)), "_bar": F.row_number().over(series())},
        {"_g": ("_up", 1 / n), "_l": ("_down", 1 / n)},
        results={"rsi_w": F.when(F.col("_bar") >= n, value)},
    )


def rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    """100 - 100 / (1 + G / L) by Wilder means of gains and losses (0 at the first bar); null for the first n - 1 rows."""
    return with_indicators(df, rsi_wilder_parts(n))


def rsi_sma(df: DataFrame, n: int = 14) -> DataFrame:
    step = F.col("close") - F.lag("close").over(series())
    out = df.withColumn("_s", step)
    up, down = rolling(F.avg, F.greatest(F.col("_s"), F.lit(0.0)), n), rolling(F.avg, F.greatest(-F.col("_s"), F.lit(0.0)), n)
    return out.withColumn("rsi", F.when(down > 0, 100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))).drop("_s")


def macd_parts(fast: int = 12, slow: int = 26, signal: int = 9) -> Indicator:
    return Indicator(
        first={"_fast": ("close", 2 / (fast + 1)), "_slow": ("close", 2 / (slow + 1))},
        between={"macd": F.col("_fast") - F.col("_slow")},
        second={"macd_signal": ("macd", 2 / (signal + 1))},
        results={"macd_hist": F.col("macd") - F.col("macd_signal")},
    )


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return with_indicators(df, macd_parts(fast, slow, signal))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    c = F.col("close")
    mid, sd = rolling(F.avg, c, n, n), rolling(F.stddev_pop, c, n, n)
    out = df.withColumn("bb_mid", mid).withColumn("bb_upper", mid + k * sd).withColumn("bb_lower", mid - k * sd)
    return out.withColumn("bb_pct", ratio(c - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))


def bb_width_position(df: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    c = F.col("close")
    mid, sd = rolling(F.avg, c, n, least), rolling(F.stddev_samp, c, n, least)
    return df.withColumn("bb_width", ratio(4 * sd, mid)).withColumn("bb_position", clip(ratio(c - (mid - 2 * sd), 4 * sd), 0, 1))


def adx_parts(n: int = 14) -> Indicator:
    up, down = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    plus, minus = 100 * ratio(F.col("_sp"), F.col("_st")), 100 * ratio(F.col("_sm"), F.col("_st"))
    return Indicator(
        {"_p": F.when(yes((up > down) & (up > 0)), up).otherwise(0.0), "_m": F.when(yes((down > up) & (down > 0)), down).otherwise(0.0), "_t": true_range(), "_bar": F.row_number().over(series())},
        {"_sp": ("_p", 1 / n), "_sm": ("_m", 1 / n), "_st": ("_t", 1 / n)},
        {"plus_di": F.when(F.col("_bar") >= n, plus), "minus_di": F.when(F.col("_bar") >= n, minus), "_dx": 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))},
        {"_adx": ("_dx", 1 / n)},
        {"adx": F.when(F.col("_bar") >= 2 * n - 1, F.col("_adx"))},
    )


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder means of the movements and the true range, then of DX; null for the first 2n - 2 rows (DI: the first n - 1)."""
    return with_indicators(df, adx_parts(n))


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    low, high = rolling(F.min, F.col("low"), n, n), rolling(F.max, F.col("high"), n, n)
    out = df.withColumn("stoch_k", 100 * ratio(F.col("close") - low, high - low))
    return out.withColumn("stoch_d", rolling(F.avg, F.col("stoch_k"), smooth, smooth))


def ema_distance_parts(span: int = 50, low: float = -10, high: float = 10) -> Indicator:
    return Indicator(first={"_e_far": ("close", 2 / (span + 1))}, results={"ema_distance": clip(ratio(F.col("close") - F.col("_e_far"), F.col("atr")), low, high), "stretch_abs": F.abs("ema_distance")})


def ema_distance(df: DataFrame, span: int = 50, low: float = -10, high: float = 10) -> DataFrame:
    """Distance of the close from its EMA in ATRs (needs ``atr``), and its size."""
    return with_indicators(df, ema_distance_parts(span, low, high))


def dual_slope_bias_parts(span: int = 200, near: int = 5, far: int = 20) -> Indicator:
    e = lambda k: F.lag("_e_slow", k).over(series())
    up, down = (F.col("slope_near") > 0) & (F.col("slope_far") > 0), (F.col("slope_near") < 0) & (F.col("slope_far") < 0)
    return Indicator(first={"_e_slow": ("close", 2 / (span + 1))}, results={"slope_near": e(1) - e(near + 1), "slope_far": e(1) - e(far + 1), "bias": F.when(yes(up), 1).when(yes(down), -1).otherwise(0)})


def dual_slope_bias(df: DataFrame, span: int = 200, near: int = 5, far: int = 20) -> DataFrame:
    return with_indicators(df, dual_slope_bias_parts(span, near, far))


def ema20_parts(span: int = 20, back: int = 5) -> Indicator:
    return Indicator(first={"_e_near": ("close", 2 / (span + 1))}, results={"ema20_slope": F.col("_e_near") - F.lag("_e_near", back).over(series()), "ema20_distance": ratio(F.col("close") - F.col("_e_near"), F.col("atr"))})


def ema20_features(df: DataFrame, span: int = 20, back: int = 5) -> DataFrame:
    return with_indicators(df, ema20_parts(span, back))


def returns(df: DataFrame, steps: Sequence[int] = (1, 5, 20), momenta: Sequence[int] = (10,)) -> DataFrame:
    c = F.col("close")
    out = df.select("*", *((ratio(c, F.lag(c, n).over(series())) - 1).alias(f"ret{n}") for n in steps), *((c - F.lag(c, n).over(series())).alias(f"mom{n}") for n in momenta))
    return out.withColumn("log_ret", F.when((c > 0) & (F.lag(c).over(series()) > 0), F.log(c / F.lag(c).over(series()))))


def realized_vol(df: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    return df.withColumn("rvol", rolling(F.stddev_samp, F.col("ret1"), n, least))


def rolling_mean_deviation(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("mean_dev", F.abs(F.col("close") - rolling(F.avg, F.col("close"), n)))


def body_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("body_ratio", clip(ratio(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")), 0, 1))


def disorder_proxy(df: DataFrame, n: int = 12, least: int = 4) -> DataFrame:
    """Share of turns between bars that both have a direction."""
    sign = F.signum(F.col("close") - F.col("open"))
    out = df.withColumn("_d", sign).withColumn("_before", F.lag("_d").over(series()))
    out = out.withColumn("_flip", F.when((F.col("_d") != 0) & (F.col("_before") != 0), (F.col("_d") != F.col("_before")).cast("double")))
    return out.withColumn("disorder", rolling(F.avg, F.col("_flip"), n, least)).drop("_d", "_before", "_flip")


def coherence_proxy(df: DataFrame, n: int = 8, least: int = 3, width: str = "4 hours", causal: bool = True) -> DataFrame:
    """Share of bars that go the way of their bucket. causal: the bucket as far as it has come; else all of it."""
    out = df.withColumn("_b", F.window("ts", width)["start"])
    w = Window.partitionBy("symbol", "_b")
    first = F.min_by("open", "ts").over(w)
    last = F.col("close") if causal else F.max_by("close", "ts").over(w)
    out = out.withColumn("_agree", (F.signum(F.col("close") - F.col("open")) == F.signum(last - first)).cast("double"))
    return out.withColumn("coherence", rolling(F.avg, F.col("_agree"), n, least)).drop("_b", "_agree")


def zscore(df: DataFrame, column: str, n: int, to: str) -> DataFrame:
    x = F.col(column)
    return df.withColumn(to, F.coalesce(ratio(x - rolling(F.avg, x, n), rolling(F.stddev_samp, x, n)), F.lit(0.0)))


def feature_matrix(df: DataFrame, base: Sequence[str], n: int = 5) -> DataFrame:
    """Each feature, its rolling mean and its rolling deviation (0 where there is none)."""
    return df.select("symbol", "ts", *base, *(rolling(F.avg, F.col(c), n).alias(f"{c}_mean{n}") for c in base), *(F.coalesce(rolling(F.stddev_samp, F.col(c), n), F.lit(0.0)).alias(f"{c}_std{n}") for c in base))


def lookback_sequences(df: DataFrame, columns: Sequence[str], n: int = 60) -> DataFrame:
    """The last n rows as an array of structs; rows with fewer before them go. Bounded by n."""
    w = last_rows(n)
    return df.withColumn("seq", F.collect_list(F.struct(*columns)).over(w)).filter(F.size("seq") == n)


def window_normalize(df: DataFrame, column: str, to: str) -> DataFrame:
    """One column of each row's sequence as its own z-scores (population deviation)."""
    x = F.transform("seq", lambda s: s[column])
    n = F.size("seq")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    out = df.withColumn("_m", mean)
    sd = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / n)
    out = out.withColumn("_s", sd)
    return out.withColumn(to, F.transform(x, lambda v: F.coalesce(ratio(v - F.col("_m"), F.col("_s")), F.lit(0.0)))).drop("_m", "_s")


def breakout_levels(df: DataFrame, n: int = 20) -> DataFrame:
    w = series().rowsBetween(-n, -1)
    full = F.count("close").over(w) >= n
    return df.withColumn("prior_max", F.when(full, F.max("close").over(w))).withColumn("prior_min", F.when(full, F.min("close").over(w)))


def next_bar_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.lead("close").over(series()) > F.col("close")).cast("int"))


def barrier_label(df: DataFrame, n: int = 2, k: float = 0.7, normalize: bool = False) -> DataFrame:
    """1 or 0 where the move n bars ahead goes beyond k ATRs up or down; null between."""
    move = F.lead("close", n).over(series()) - F.col("close")
    size = F.col("atr")
    if normalize:
        move, size = ratio(move, F.col("close")), ratio(F.col("atr"), F.col("close"))
    return df.withColumn("label", F.when(move > k * size, 1).when(move < -k * size, 0))


def label_balance(df: DataFrame) -> DataFrame:
    n = lambda c: F.sum(yes(c).cast("int"))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), n(F.col("label") == 1).alias("ones"), n(F.col("label") == 0).alias("zeros"), n(F.col("label").isNull()).alias("neutral"))


def rolling_corr(df: DataFrame, a: str, b: str, n: int, key: Sequence[str] | str, order: str = "ts") -> DataFrame:
    w = last_rows(n, key, order)
    return df.withColumn("corr", F.when(F.count(F.lit(1)).over(w) >= n, F.corr(a, b).over(w)))


def corr_summary(df: DataFrame, key: Sequence[str]) -> DataFrame:
    s = F.stddev_samp("corr")
    band = F.when(s < 0.1, "STABLE").when(s < 0.25, "MODERATE").otherwise("UNSTABLE")
    return df.filter("corr IS NOT NULL AND NOT isnan(corr)").groupBy(*key).agg(F.avg("corr").alias("mean"), s.alias("std"), F.min("corr").alias("low"), F.max("corr").alias("high"), band.alias("band"))


def rolling_ols(df: DataFrame, y: str, x: str, n: int, key: Sequence[str] | str, order: str = "ts") -> DataFrame:
    """beta and alpha of y on x over full windows; null where x hardly varies."""
    w = last_rows(n, key, order)
    out = df.withColumn("_v", F.var_pop(x).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    fine = (F.col("_n") >= n) & (F.col("_v") >= 1e-12)
    out = out.withColumn("beta", F.when(fine, F.covar_pop(y, x).over(w) / F.nullif("_v", F.lit(0.0))))
    return out.withColumn("alpha", F.avg(y).over(w) - F.col("beta") * F.avg(x).over(w)).drop("_v", "_n")


def spread_zscore(df: DataFrame, y: str, x: str, n: int, key: Sequence[str] | str, order: str = "ts") -> DataFrame:
    out = df.withColumn("spread", F.col(y) - (F.col("beta") * F.col(x) + F.col("alpha")))
    s = F.col("spread")
    return out.withColumn("z", ratio(s - rolling(F.avg, s, n, n, key, order), rolling(F.stddev_samp, s, n, n, key, order)))


def cross_detect(df: DataFrame, a: str = "macd", b: str = "macd_signal") -> DataFrame:
    above, before = F.col(a) > F.col(b), F.lag(F.col(a) <= F.col(b)).over(series())
    below, after = F.col(a) < F.col(b), F.lag(F.col(a) >= F.col(b)).over(series())
    return df.withColumn("cross", F.when(yes(above & before), 1).when(yes(below & after), -1).otherwise(0))


def cumulative_drawdown(df: DataFrame, pnl: str, key: Sequence[str] | str, order: Sequence[str] | str, from_zero: bool = False, width: float | None = None) -> DataFrame:
    """Running sum, and its distance below its peak. The peak starts at the first sum, or at zero. By cells of the order."""
    w, e = blocks.within_so_far(key, order), blocks.earlier(key)
    rows = blocks.in_cells(df, order, width).withColumn("_local", F.sum(pnl).over(w)).withColumn("_top", F.max("_local").over(w))
    cells = blocks.cells_of(rows, key, _sum=F.sum(pnl), _most=F.max("_local")).withColumn("_s0", F.sum("_sum").over(e))
    cells = cells.withColumn("_p0", F.max(blocks.plus(F.col("_s0"), F.col("_most"))).over(e))
    out = blocks.with_borders(rows, cells, key, "_s0", "_p0").withColumn("cum", blocks.plus(F.col("_s0"), F.col("_local")))
    peak = F.greatest("_p0", blocks.plus(F.col("_s0"), F.col("_top")))
    return out.withColumn("drawdown", (F.greatest(peak, F.lit(0.0)) if from_zero else peak) - F.col("cum")).drop("_cell", "_local", "_top", "_s0", "_p0")


def lab_features(df: DataFrame) -> DataFrame:
    """The features that regimes and rules read: frames, and one pass for all recurrences."""
    out = with_indicators(atr_ratio(atr_sma(df)), ema_distance_parts(), ema20_parts(), dual_slope_bias_parts())
    out = realized_vol(returns(out))
    return coherence_proxy(disorder_proxy(body_ratio(rsi_sma(bb_width_position(rolling_mean_deviation(out))))))


def live_indicators(df: DataFrame) -> DataFrame:
    """RSI, MACD, ADX and ATR by two passes for all their recurrences; bands and stochastics by frames."""
    out = with_indicators(df, rsi_wilder_parts(), macd_parts(), adx_parts(), atr_wilder_parts())
    return cross_detect(stochastic(bollinger(out)))
