"""Profit factors, in three conventions, and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import yes


def gains(pnl: Column) -> Column:
    return F.sum(F.when(pnl > 0, pnl).otherwise(0.0))


def losses(pnl: Column) -> Column:
    return F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))


def profit_factor(pnl: Column, convention: str = "infinite") -> Column:
    """Gains over losses. Without losses: ``infinite`` gives infinity (0 without gains), ``null`` null, ``floor`` divides
    by 1e-9. An aggregate: also good over a window through ``profit_factor_over``."""
    return _factor(gains(pnl), losses(pnl), convention)


def _factor(g: Column, l: Column, convention: str) -> Column:
    if convention == "floor":
        return g / F.greatest(l, F.lit(1e-9))
    if convention == "null":
        return F.when(l > 0, g / F.nullif(l, F.lit(0.0)))
    if convention != "infinite":
        raise ValueError("convention is infinite, null or floor")
    return F.when(l > 0, g / F.nullif(l, F.lit(0.0))).when(g > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def profit_factor_over(pnl: Column, window, convention: str = "infinite") -> Column:
    return _factor(gains(pnl).over(window), losses(pnl).over(window), convention)


def profit_factor_udaf(df: DataFrame, keys: Sequence[str], pnl: str = "pnl", to: str = "pf") -> DataFrame:
    """The same by a pandas function of each key's gains and losses; these sum in Spark, before the shuffle."""

    @F.pandas_udf("double")
    def factor(g: pd.Series, l: pd.Series) -> pd.Series:
        return pd.Series([a / b if b > 0 else float("inf") if a > 0 else 0.0 for a, b in zip(g, l)], dtype=float)

    sums = df.groupBy(*keys).agg(gains(F.col(pnl)).alias("_g"), losses(F.col(pnl)).alias("_l"))
    return sums.select(*keys, factor("_g", "_l").alias(to))


def research_verdict(test_pf: Column, oos_pf: Column, trades: Column, robustness: Column) -> Column:
    return (
        F.when(yes(trades == 0) | trades.isNull(), "NO_TRADES")
        .when(yes((test_pf > 1.3) & (oos_pf > 1) & (robustness >= 0.6)), "PASS")
        .when(yes((test_pf > 1) & (oos_pf > 1)), "OOS_PASS")
        .when(yes((test_pf > 1) & ((oos_pf < 1) | oos_pf.isNull())), "DEGRADED")
        .when(yes((test_pf >= 1) & (test_pf <= 1.3)), "WEAK_EDGE")
        .otherwise("FAIL")
    )


def robustness_band(score: Column) -> Column:
    return F.when(score >= 0.7, "ROBUST").when(score >= 0.5, "MODERATE").when(score >= 0.3, "WEAK").otherwise("FRAGILE")


def scenario_criteria(pf: Column, pf_without_best: Column, win_rate: Column, drawdown: Column, n: Column) -> dict[str, Column]:
    """Each criterion of a promotion, met or not; missing figures meet none."""
    return {"enough_trades": yes(n >= 30), "pf_ok": yes(pf >= 1.3), "pf_without_best_ok": yes(pf_without_best >= 1.1), "drawdown_ok": yes(drawdown <= 500), "win_rate_ok": yes(win_rate >= 40)}


def scenario_verdict(pf: Column, pf_without_best: Column, win_rate: Column, drawdown: Column, n: Column) -> Column:
    return (
        F.when(n < 30, "TOO_FEW").when(yes((pf >= 1.3) & (pf_without_best >= 1.1) & (drawdown <= 500) & (win_rate >= 40)), "PROMOTE")
        .when(yes((pf >= 1.1) & (pf_without_best >= 1.0)), "EXTEND").when(yes(pf >= 1.0), "WATCH").otherwise("STOP")
    )


def cluster_name(test_pf: Column, oos_pf: Column, degradation: Column, robustness: Column, trending: Column, high_vol: Column, mc_prob: Column) -> Column:
    """What a cluster of failures is, from its mean figures; the first that fits. Missing figures are 0, a chance of profit 0.5."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    test, oos, worse, sound, trend, wild, chance = zero(test_pf), zero(oos_pf), zero(degradation), zero(robustness), zero(trending), zero(high_vol), F.coalesce(mc_prob, F.lit(0.5))
    kinds = (
        ("DATA_MINING_OVERFIT", (test > 1.1) & (oos < 0.95) & (worse < -0.10)), ("VOLATILITY_TRAP", (wild > 0.45) & (test < 0.95)), ("TREND_CHASING_TRAP", (trend > 0.60) & (test < 0.90)),
        ("SIGNAL_DROUGHT", (sound < 0.15) & (chance < 0.45)), ("REGIME_NOISE", (F.abs(trend - wild) < 0.15) & (test < 1.0)),
    )
    return F.coalesce(*(F.when(c, name) for name, c in kinds), F.lit("STRUCTURAL_FAILURE"))
