"""Top-k, capped selections, unions with precedence, set operations, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import factors
from ..functions.frames import yes
from . import blocks


def top_parameters(results: DataFrame, k: int = 10, win_rate: float = 45, trades: int = 50) -> DataFrame:
    return results.filter((F.col("win_rate") >= win_rate) & (F.col("trades") >= trades)).orderBy(F.desc("sharpe"), "combo").limit(k)


def select_targets(results: DataFrame, score: str, n: int = 12, per_asset: int = 2, tie: str = "hypothesis") -> DataFrame:
    w = Window.partitionBy("asset").orderBy(F.desc(score), tie)
    return results.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_asset).drop("_r").orderBy(F.desc(score), "asset", tie).limit(n)


def top_by(df: DataFrame, column: str, ties: Sequence[str], n: int = 5, worst: bool = False) -> DataFrame:
    return df.orderBy(F.asc(column) if worst else F.desc(column), *ties).limit(n)


def top_combinations(folds: DataFrame, keys: Sequence[str], n: int = 3, least: int = 30) -> DataFrame:
    """By mean expectancy over folds with enough trades."""
    return folds.filter(F.col("trades") >= least).groupBy(*keys).agg(F.avg("expectancy").alias("mean_expectancy"), F.count(F.lit(1)).alias("folds")).orderBy(F.desc("mean_expectancy"), *keys).limit(n)


def first_valid_filter(candidates: DataFrame, keys: Sequence[str], retention: float = 0.6) -> DataFrame:
    """The first candidate (by ``place``) that keeps enough and beats the baseline, else the one with the best factor.

    Factors that differ by no more than the order of their sums can make them differ are equal: one that removes nothing
    doesn't beat the baseline."""
    fits = yes((F.col("retention") >= retention) & (F.col("pf") > F.col("baseline_pf") * (1 + 1e-9)))
    w = Window.partitionBy(*keys).orderBy(F.when(fits, F.col("place")).asc_nulls_last(), F.round("pf", 9).desc_nulls_last(), "place")
    return candidates.withColumn("valid", fits).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def union_chunks(parts: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(list(keys))


def union_with_precedence(primary: DataFrame, fallback: DataFrame, key: str = "symbol") -> DataFrame:
    """Keys that the primary source lacks come from the other, whole."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti").select(*primary.columns))


def common_timestamps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ts").intersect(b.select("ts"))


def missing_timestamps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ts").exceptAll(b.select("ts"))


#: Filters (most ADX, least and most ATR ratio, all exclusive), the most permissive first.
FILTERS = tuple((adx, low, high) for adx in (35.0, 30.0, 25.0, 20.0) for low, high in ((0.9, 1.8), (0.8, 1.5), (0.7, 1.3)))


def inner_split(folds: DataFrame, share: float = 0.7, keys: Sequence[str] = ("symbol", "fold"), order: str = "ts") -> DataFrame:
    """The training rows of each fold in time's order: ``inner`` is fit for the first ``share`` of each key's, select for the rest."""
    train = folds.filter("part = 'train'")
    rows = blocks.numbered(train, list(keys), order, "_i")
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = blocks.with_columns_of(rows, sizes, list(keys), "_n")
    return out.withColumn("inner", F.when(F.col("_i") < F.floor(F.col("_n") * share), "fit").otherwise("select")).drop("_i", "_n")


def nested_filters(trades: DataFrame, keys: Sequence[str] = ("horizon", "fold"), filters: Sequence[tuple[float, float, float]] = FILTERS, retention: float = 0.6, least: int = 5) -> DataFrame:
    """The filter that each fold's ``select`` trades choose, and its ``test`` trades without and with it.

    trades: the keys (a grouping and ``fold`` last), ``part`` (select or test), ``pnl``, ``adx``, ``atr_ratio``. A filter is a candidate
    if it keeps ``retention`` of the select trades and ``least`` of them; the first that beats all trades is chosen
    (``valid``), else the best candidate, and without a candidate none (``place`` null; the fold's trades stay as they are). A missing
    ADX or ATR ratio passes no filter. ``usual``: the place chosen most often over the folds, of equals the one met first.
    A row for each fold that has select trades."""
    keys, p = list(keys), F.col("pnl")
    grid = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(a).alias("adx_max"), F.lit(b).alias("low"), F.lit(c).alias("high")) for k, (a, b, c) in enumerate(filters)))
    kept = trades.select("*", F.explode(grid).alias("_f")).select(*keys, "part", "pnl", "adx", "atr_ratio", "_f.*")
    kept = kept.filter(yes((F.col("adx") < F.col("adx_max")) & (F.col("atr_ratio") > F.col("low")) & (F.col("atr_ratio") < F.col("high"))))
    figures = lambda part, names: [f(F.when(F.col("part") == part, p)).alias(n) for n, f in zip(names, (F.count, lambda x: factors.profit_factor(x, "floor"), F.avg))]
    whole = trades.groupBy(*keys).agg(*figures("select", ("n", "baseline_pf")), *figures("test", ("trades_before", "pf_before", "expectancy_before"))).filter("n > 0")
    each = kept.groupBy(*keys, "place", "adx_max", "low", "high").agg(*figures("select", ("k", "pf")), *figures("test", ("trades_after", "pf_after", "expectancy_after")))
    each = each.join(whole.select(*keys, "n", "baseline_pf"), keys).withColumn("retention", F.col("k") / F.col("n")).filter((F.col("retention") >= retention) & (F.col("k") >= least))
    chosen = first_valid_filter(each, keys, retention).drop("n", "k", "baseline_pf")
    out = whole.join(chosen, keys, "left").drop("n")
    none = F.col("place").isNull()
    out = out.select(*(F.when(none, F.col(c.replace("_after", "_before"))).otherwise(F.col(c)).alias(c) if c.endswith("_after") else F.coalesce(c, F.lit(False)).alias(c) if c == "valid" else F.col(c) for c in out.columns))
    group, fold = keys[:-1], keys[-1]
    often = out.filter("place IS NOT NULL").groupBy(*group, "place").agg(F.count(F.lit(1)).alias("_n"), F.min(fold).alias("_first"))
    often = often.groupBy(*group).agg(F.max_by("place", F.struct("_n", -F.col("_first"))).alias("usual"))
    out = out.join(often, group, "left") if group else out.crossJoin(F.broadcast(often))
    return out.withColumn("test_retention", F.when(F.col("trades_before") > 0, F.col("trades_after") / F.col("trades_before")))


def walk_forward_folds(df: DataFrame, folds: int = 3, test_share: float = 0.4, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Equal stretches of rows; the last part of each is its test."""
    w, every = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    n, i = F.count(F.lit(1)).over(every), F.row_number().over(w) - 1
    out = df.withColumn("_n", n).withColumn("_i", i).withColumn("fold", F.least(F.lit(folds - 1), F.floor(F.col("_i") * folds / F.col("_n"))).cast("int"))
    inside = Window.partitionBy(key, "fold")
    out = out.withColumn("_a", F.min("_i").over(inside)).withColumn("_b", F.max("_i").over(inside))
    return out.withColumn("part", F.when(F.col("_i") - F.col("_a") >= (F.col("_b") - F.col("_a") + 1) * (1 - test_share), "test").otherwise("train")).drop("_n", "_i", "_a", "_b")


def expanding_folds(df: DataFrame, folds: int = 3, start: float = 0.4, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Fold k trains on all before its test; a row comes once for each fold it is in."""
    every = Window.partitionBy(key)
    t = F.unix_timestamp(order)
    at = (t - F.min(t).over(every)) / F.greatest(F.lit(1), F.max(t).over(every) - F.min(t).over(every))
    step = (1 - start) / folds
    out = df.withColumn("_at", at).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    low, high = F.lit(start) + F.col("fold") * step, F.lit(start) + (F.col("fold") + 1) * step
    part: Column = F.when(F.col("_at") < low, "train").when((F.col("_at") < high) | ((F.col("fold") == folds - 1) & (F.col("_at") <= 1)), "test")
    return out.withColumn("part", part).filter("part IS NOT NULL").drop("_at")
