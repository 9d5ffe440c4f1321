"""End-to-end jobs: compositions of the operators, from the driver's tables to result tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import factors, scalars
from ..functions.frames import series, yes
from ..operators import bars as B
from ..operators import blocks, engines, joins, metrics, ml, regimes, rules, selection
from ..operators import indicators as I
from ..sources import io
from ..sources.io import settled
from .inputs import features, hourly, stamped, ticks, trades


#: What the two models read: features of the bar, and the course of the last returns.
BAR_FEATURES, COURSE = ("ret1", "ret5", "z20", "atr_ratio"), tuple(f"r{k}" for k in range(10))


def _models(df: DataFrame, learn: float = 0.4) -> DataFrame:
    """The bars after the first ``learn`` of each symbol's, with two models' probabilities (0..100) that the next bar closes
    higher: boosted trees on the bar's features, a logistic regression on its last ten returns. Both are fitted on the bars
    before, so nothing looks ahead."""
    w, every = series(), Window.partitionBy("symbol")
    b = I.next_bar_label(I.zscore(I.returns(df), "close", 20, "z20"))
    b = b.select("*", *(F.lag("ret1", k).over(w).alias(f"r{k}") for k in range(len(COURSE)))).withColumn("learns", F.row_number().over(w) <= learn * F.count(F.lit(1)).over(every))
    b = settled(b.na.drop(subset=[*BAR_FEATURES, *COURSE]), "bars")
    known = b.filter("learns AND label IS NOT NULL")
    out = ml.gbt_predict(b.filter("NOT learns"), BAR_FEATURES, ml.gbt_train(known, BAR_FEATURES)).withColumnRenamed("prob", "xgboost_prob")
    return ml.gbt_predict(out, COURSE, ml.logistic_train(known, COURSE)).withColumnRenamed("prob", "lstm_prob").drop("label", "learns", *COURSE)


def _live(s: SparkSession, d: str) -> DataFrame:
    return I.live_indicators(I.atr_ratio(I.atr_sma(hourly(s, d)), 50, 10, 0, 99)).withColumn("adx_regime", regimes.adx_regime())


def signal_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Bars to indicators, models, signals, gates, trades on closes, and equity figures of each symbol."""
    b = rules.apply_gates(rules.weighted_score(rules.votes(_models(_live(s, d)), 48, 52, 0.05)), adx_min=10, atr_min=0.5)
    t = engines.close_only_trades(b, signal="gated")
    w = t.withColumn("equity", 10_000 + F.sum("pnl").over(series("symbol", "exit_idx")))
    return metrics.equity_metrics(w, ["symbol"], ["exit_idx"])


#: The grid of 432 combinations for hourly prices; and as many for the driver's ticks, which have no trends and
#: hardly reach the thresholds of the first.
GRID = {"rsi_buy": [25, 30, 35, 40], "rsi_sell": [70, 75], "sl_mult": [2.0, 2.5, 3.0], "tp_mult": [3.0, 4.0, 5.0], "adx_min": [20, 25, 30], "stoch": [20, 25]}
TICK_GRID = GRID | {"rsi_buy": [44, 46, 48, 50], "rsi_sell": [52, 54], "adx_min": [4, 6, 8], "stoch": [40, 50]}


def grid_search(s: SparkSession, d: str, grid: dict = TICK_GRID) -> DataFrame:
    """432 parameters against one featured table, which is written once; the grid is part of the plan. A vote of two of
    three (RSI by its thresholds, MACD, bands), confirmed by ADX and stochastics; trades on closes; the best by Sharpe."""
    b = settled(_live(s, d).select("symbol", "ts", "close", "atr", "rsi_w", "cross", "bb_lower", "bb_upper", "adx", "stoch_k"), "featured")
    c = F.col("close")
    fixed = lambda x, y: yes(x).cast("int") + yes(y).cast("int")
    b = b.select("symbol", "ts", "close", "atr", "rsi_w", "adx", "stoch_k", fixed(F.col("cross") == 1, c <= F.col("bb_lower") * 1.002).alias("up"), fixed(F.col("cross") == -1, c >= F.col("bb_upper") * 0.998).alias("down"))
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    every = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in x.items() if not k.endswith("_mult"))) for x in combos))

    def side(g):
        buys, sells = F.col("up") + yes(F.col("rsi_w") < g["rsi_buy"]).cast("int"), F.col("down") + yes(F.col("rsi_w") > g["rsi_sell"]).cast("int")
        trend = yes(F.col("adx") >= g["adx_min"])
        return F.when((sells >= 2) & trend & yes(F.col("stoch_k") > 100 - g["stoch"]), -1).when((sells < 2) & (buys >= 2) & trend & yes(F.col("stoch_k") < g["stoch"]), 1).otherwise(0)

    t = engines.close_only_grid(b, F.transform(every, side), [(x["sl_mult"], x["tp_mult"]) for x in combos])
    m = metrics.trade_metrics(t, ["combo"], ["symbol", "exit_idx"])
    return selection.top_parameters(m, 10, 20, 3).select("combo", "trades", "win_rate", "profit_factor", "sharpe")


def batch_research(s: SparkSession, d: str) -> DataFrame:
    """Rules of the catalogue over all symbols: trades that don't overlap (written once), metrics, folds, 500 bootstrap
    replicates, robustness, verdict; and of each rule its rank, survivors, group figures and results by symbol."""
    b = I.breakout_levels(I.lab_features(hourly(s, d))).withColumn("regime", regimes.regime3())
    b = b.select("*", *(rules.entry_rule(config).alias(f"rule_{name}") for name, (config, _) in rules.CATALOGUE.items()))
    t = engines.sequential_trades_by_rule(b, {name: (f"rule_{name}", exits) for name, (_, exits) in rules.CATALOGUE.items()})
    t = settled(t.withColumnRenamed("symbol", "asset").withColumn("fold", F.floor(F.dayofmonth("entry_time") / 11)), "trades")
    by = ["asset", "hypothesis"]
    m = metrics.trade_metrics(t, by, ["entry_idx"])
    fold = t.groupBy(*by, "fold").agg(factors.profit_factor(F.col("pnl"), "floor").alias("pf"), F.count("pnl").alias("trades"))
    mc = metrics.bootstrap(t, by, ["entry_idx"], 500)
    fold = fold.join(mc.select(*by, "mc_prob", "mean_dd", "dd95"), by, "left").na.fill({"mc_prob": 0.0, "mean_dd": 0.0, "dd95": 0.0})
    oos = t.filter("dayofmonth(entry_time) >= 20").groupBy(*by).agg(factors.profit_factor(F.col("pnl"), "floor").alias("oos_pf"))
    mix = metrics.regime_mix_of_trades(t, by).groupBy(*by).agg(F.max("dominant").alias("dominant_regime"))
    r = m.join(metrics.robustness_score(fold, by), by).join(oos, by, "left").join(mix, by, "left")
    r = settled(r.withColumn("band", factors.robustness_band(F.col("robustness"))).withColumn("verdict", factors.research_verdict(F.col("profit_factor"), F.col("oos_pf"), F.col("trades"), F.col("robustness"))), "results")
    named = r.withColumnsRenamed({"profit_factor": "test_pf", "sharpe": "test_sharpe", "verdict": "oos_verdict"})
    rank = metrics.result_ranking(named).select("hypothesis", F.col("avg_robustness").alias("rule_robustness"), F.col("n_assets").alias("rule_assets"))
    alive = metrics.survival(named).select("hypothesis", F.col("passing").alias("rule_passing"))
    fell = metrics.group_degradation(named, "hypothesis").select("hypothesis", F.col("degradation").alias("rule_degradation"))
    across = metrics.heatmap(named.select(F.col("hypothesis").alias("asset"), F.col("asset").alias("hypothesis"), "test_pf"), "test_pf", ("click", "error", "purchase", "signup", "view")).withColumnRenamed("asset", "hypothesis")
    across = across.select("hypothesis", *(F.col(c).alias(f"pf_{c}") for c in across.columns if c != "hypothesis"))
    out = r
    for part in (rank, alive, fell, across):
        out = out.join(part, "hypothesis", "left")
    return out


def behavioural_map(s: SparkSession, d: str) -> DataFrame:
    """Each symbol's trades against its regimes: cascades and what follows losses, decay, how long regimes last against what
    they earn, and figures at and away from changes."""
    b = settled(features(s, d).withColumn("regime", regimes.regime3()).select("symbol", "ts", "regime"), "regimes")
    t = ticks(s, d).select("symbol", "event_id", F.col("ts").alias("entry_time"), (F.col("price") - 35).alias("pnl"))
    order = ["entry_time", "event_id"]
    cascades = metrics.loss_cascades(t, ["symbol"], order)
    summary = metrics.cascade_summary(metrics.cascade_recovery(t, cascades, ["symbol"], order), ["symbol"])
    loss = metrics.conditional_loss_prob(t, ["symbol"], order).groupBy("symbol").agg(F.max_by("p", "p").alias("worst_loss_prob"), F.sum(F.col("flagged").cast("int")).alias("flagged_runs"))
    zone = metrics.zone_verdict(joins.asof(t, regimes.transition_zone(b).select("symbol", "ts", "in_zone"), ["in_zone"], at="entry_time"), ["symbol"])
    decay = metrics.edge_decay(t, ["symbol"], order).select("symbol", F.col("type").alias("decay"), "baseline", "final")
    placed = settled(joins.trades_in_blocks(t, regimes.regime_blocks(b)), "placed")
    lasting = metrics.duration_pf_correlation(placed, ["symbol"]).select("symbol", F.round("corr", 5).alias("duration_corr"))
    change = metrics.per_transition_pf(placed, "symbol", order)
    # the change that each symbol made last, and what such changes cost
    w = Window.partitionBy("symbol").orderBy("island")
    last = regimes.regime_blocks(b).withColumn("from", F.lag("regime").over(w)).groupBy("symbol").agg(F.max_by(F.struct("from", F.col("regime").alias("to")), "island").alias("x")).select("symbol", "x.*")
    last = last.join(change, ["from", "to"], "left").select("symbol", "from", "to", F.col("delta").alias("last_change_delta"))
    out = summary.join(zone, "symbol")
    for part in (decay, loss, lasting, last):
        out = out.join(part, "symbol", "left")
    return out


def variant_comparison(s: SparkSession, d: str) -> DataFrame:
    """The same signals under different gates, how each fares after costs, and how many of its scores are how high."""
    b = settled(rules.weighted_score(rules.votes(_models(_live(s, d)), 48, 52, 0.05)), "scored")
    out = None
    for name, flags in (("none", (False, False, False)), ("range", (True, False, False)), ("consensus", (False, True, False)), ("all", (True, True, True))):
        v = rules.apply_gates(b, *flags, adx_min=10, atr_min=0.5).drop("signal").withColumnRenamed("gated", "signal").withColumn("variant", F.lit(name))
        out = v if out is None else out.unionByName(v)
    t = engines.close_only_trades(out, keys=("variant", "symbol"))
    fares = metrics.net_profit_factor(t, ["variant"], 0.5)
    kept = rules.threshold_survival(out.filter("signal != 0").select(F.col("variant").alias("symbol"), "score"), "score", (20.0, 40.0, 60.0))
    kept = kept.groupBy(F.col("symbol").alias("variant")).agg(*(F.max(F.when(F.col("threshold") == x, F.col("kept"))).alias(f"scores_{x}") for x in (20, 40, 60)))
    return kept.join(fares, "variant", "left")


def walk_forward_experiment(s: SparkSession, d: str) -> DataFrame:
    """Features, pruning, labels; for each of three folds that expand, boosted trees fitted on what comes before and trades
    on the fold; the best symbols by mean expectation are marked; then a last fit on all but the holdout (the last fifth of
    time), judged there, and on a symbol that no fit has seen."""
    b = I.barrier_label(features(s, d), 2, 0.7).na.fill(0.0, ["disorder"])  # null where no two bars have a direction
    ways = ["ret1", "ret5", "ret20", "mom10", "log_ret", "z20", "atr_ratio", "disorder"]
    more = I.feature_matrix(b, ways)
    base = [c for c in more.columns if c not in ("symbol", "ts")]  # each, and its mean and deviation of five bars: 24
    b = settled(b.join(more.drop(*ways), ["symbol", "ts"]).na.drop(subset=base), "labelled")
    cols = metrics.prune_correlated(b, base)
    every = Window.partitionBy("symbol")
    t = F.unix_timestamp("ts")
    b = b.withColumn("late", (t - F.min(t).over(every)) > 0.8 * (F.max(t).over(every) - F.min(t).over(every)))
    stranger = b.agg(F.min("symbol")).first()[0]
    seen = b.filter((F.col("symbol") != stranger) & ~F.col("late"))
    folds = settled(selection.expanding_folds(seen), "folds")

    def judged(model, rows: DataFrame, name: str) -> DataFrame:
        p = ml.gbt_predict(rows, cols, model).withColumn("signal", scalars.probability_signal(F.col("prob") / 100)).withColumn("p", F.col("prob") / 100).withColumn("part", F.lit(name))
        trades_ = joins.exit_after(p, 2)
        m = metrics.trade_metrics(trades_, ["part", "symbol"], ["ts"]).select("part", "symbol", "trades", "profit_factor", "expectancy")
        return m.join(metrics.classification_metrics(p.filter("label IS NOT NULL"), ["part", "symbol"]).select("part", "symbol", "accuracy", "auc"), ["part", "symbol"], "left")

    out = None
    for k in range(3):
        mine = folds.filter(F.col("fold") == k)
        r = judged(ml.gbt_train(mine.filter("part = 'train'"), cols), mine.filter("part = 'test'"), f"fold{k}")
        out = r if out is None else out.unionByName(r)
    last = ml.gbt_train(seen, cols)
    out = settled(out.unionByName(judged(last, b.filter((F.col("symbol") != stranger) & F.col("late")), "holdout")).unionByName(judged(last, b.filter(F.col("symbol") == stranger), "transfer")), "judged")
    best = selection.top_combinations(out.filter("part LIKE 'fold%'"), ["symbol"], 3, 10).select("symbol", F.lit(True).alias("chosen"))
    return out.join(best, "symbol", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def nested_filter_selection(s: SparkSession, d: str) -> DataFrame:
    """The filter that is chosen on the first part of each fold, and what it does on the second."""
    b = selection.walk_forward_folds(features(s, d).withColumn("signal", rules.entry_rule({"type": "mean_reversion", "feature": "z20", "threshold": 1.0})))
    t = joins.exit_after(b, 3)
    p = F.col("pnl")
    base = t.filter("part = 'train'").groupBy("fold").agg(factors.profit_factor(p, "null").alias("baseline_pf"), F.count(p).alias("n"))
    g = joins.param_grid(t, {"most": [1.5, 1.2, 1.0]}).filter(yes(F.col("atr_ratio") <= F.col("most")))
    train = g.filter("part = 'train'").groupBy("fold", F.col("combo").alias("place"), "most").agg(factors.profit_factor(p, "null").alias("pf"), F.count(p).alias("k"))
    chosen = selection.first_valid_filter(train.join(base, "fold").withColumn("retention", F.col("k") / F.col("n")), ["fold"])
    test = g.filter("part = 'test'").groupBy("fold", F.col("combo").alias("place")).agg(factors.profit_factor(p, "null").alias("test_pf"))
    return chosen.join(test, ["fold", "place"], "left").select("fold", "place", "most", "retention", "pf", "test_pf", "valid")


def nested_model_selection(s: SparkSession, d: str, labels: tuple = ((2, 0.7), (3, 0.5))) -> DataFrame:
    """For each labelling (bars ahead, ATRs) and each of three folds that expand: boosted trees fitted on all before the fold
    trade the fold; others, fitted on the first 70 % of what comes before, trade the rest of it, and there the filter by ADX and
    ATR ratio is chosen; then the fold's trades with and without that filter, and the filter chosen most often."""
    cols = ["ret1", "ret5", "ret20", "z20", "disorder", "atr_ratio", "adx", "rsi_w", "bb_pct", "stoch_k"]
    b = I.disorder_proxy(I.zscore(I.returns(_live(s, d)), "close", 20, "z20")).na.fill(0.0, ["disorder"]).na.drop(subset=cols)
    b = settled(b.select("symbol", "ts", "close", "atr", *cols), "bars")

    def traded(model, rows: DataFrame, n: int, k: int, part: str) -> DataFrame:
        t = joins.exit_after(ml.gbt_predict(rows, cols, model).withColumn("signal", scalars.probability_signal(F.col("prob") / 100)), n)
        return t.select(F.lit(n).alias("horizon"), F.lit(k).alias("fold"), F.lit(part).alias("part"), "pnl", "adx", "atr_ratio")

    out = None
    for n, atrs in labels:
        folds = settled(selection.expanding_folds(I.barrier_label(b, n, atrs)), "folds")
        inner = settled(selection.inner_split(folds), "inner")
        for k in range(3):
            mine, before = folds.filter(F.col("fold") == k), inner.filter(F.col("fold") == k)
            tests = traded(ml.gbt_train(mine.filter("part = 'train'"), cols), mine.filter("part = 'test'"), n, k, "test")
            chooses = traded(ml.gbt_train(before.filter("inner = 'fit'"), cols), before.filter("inner = 'select'"), n, k, "select")
            both = tests.unionByName(chooses)
            out = both if out is None else out.unionByName(both)
    return selection.nested_filters(settled(out, "trades"))


def regime_separability(s: SparkSession, d: str) -> DataFrame:
    """Trades by the regime of their bar: how far apart the regimes' results are."""
    b = features(s, d).withColumn("regime", regimes.regime3())
    t = joins.asof(ticks(s, d).withColumn("pnl", F.col("price") - 35), b, ["regime"]).filter("regime IS NOT NULL")
    ks = metrics.ks_two_sample(t, "regime", "pnl", [("STRESS", "COMPRESSED"), ("STRESS", "STRUCTURED"), ("COMPRESSED", "STRUCTURED")])
    return metrics.separability_score(ks, t.groupBy("symbol", "regime").agg(F.avg("pnl").alias("expectancy")))


#: What results are broken down by, next to the symbol.
CUTS = (("regime",), ("regime", "aligned"), ("bucket", "regime"), ("bucket",), ("mr_setup",), ())


def barrier_separability(s: SparkSession, d: str) -> DataFrame:
    """Signals that leave by stop or target within 48 bars (a bar that touches both is a target), each tagged as its bar was:
    results by regime, by regime and alignment with the slow average's slopes, by stretch and regime, by stretch, by setup, and in
    all; with the symbol's separability of regimes, and how far apart aligned and other trades under stress are (null if
    either has under ten)."""
    b = I.dual_slope_bias(I.ema_distance(features(s, d))).withColumn("regime", regimes.regime3()).withColumn("signal", rules.entry_rule({"type": "mean_reversion", "feature": "z20", "threshold": 1.0}))
    b = settled(blocks.numbered(b, "symbol", "ts", "idx").select("symbol", "ts", "idx", "high", "low", "close", "atr", "signal", "regime", "bias", "ema_distance"), "bars")
    t = rules.stop_target(b, {"sl_atr": 1.5, "tp_atr": 2.0}).filter("signal != 0")
    t = t.select("symbol", F.col("idx").alias("trade_id"), F.col("ts").alias("entry_time"), F.col("idx").alias("entry_idx"), F.col("signal").alias("direction"), F.col("close").alias("entry"), "sl", "tp")
    t = joins.resolve_barriers(t, b.select("symbol", "idx", "high", "low", "close"), 48, "TP").filter("outcome IS NOT NULL")
    t = joins.asof_features(t, b.select("symbol", "ts", "regime", "bias", "ema_distance"), {"regime": "STRUCTURED", "bias": 0, "ema_distance": 0.0})
    t = joins.alignment(t).withColumn("aligned", F.col("alignment") == "ALIGNED").withColumn("bucket", scalars.stretch_bucket(F.col("ema_distance"))).withColumn("pnl", F.col("direction") * (F.col("exit_price") - F.col("entry")))
    t = settled(t.select("symbol", "regime", "aligned", "bucket", "mr_setup", "outcome", "pnl"), "tagged")
    cuts = metrics.breakdown(t, ["symbol", "regime", "aligned", "bucket", "mr_setup"], sets=[("symbol", *x) for x in CUTS])
    ks = metrics.ks_two_sample(t, "regime", "pnl", [("STRESS", "COMPRESSED"), ("STRESS", "STRUCTURED"), ("COMPRESSED", "STRUCTURED")])
    apart = metrics.separability_score(ks, t.groupBy("symbol", "regime").agg(F.avg("pnl").alias("expectancy")))
    stress = metrics.ks_two_sample(t.filter("regime = 'STRESS'").withColumn("side", F.col("aligned").cast("string")), "side", "pnl", [("true", "false")])
    return cuts.join(apart.select("symbol", "mean_ks", "significant", "spread", "score"), "symbol", "left").join(stress.select("symbol", F.col("ks").alias("stress_ks"), F.col("p").alias("stress_p")), "symbol", "left")


def pairs_research(s: SparkSession, d: str) -> DataFrame:
    """Every two symbols: rolling correlation and regression, spreads, their mean reversion, and trades of them."""
    k = ["a", "b"]
    c = settled(I.rolling_corr(joins.align_pairs(hourly(s, d)), "close_a", "close_b", 60, k), "pairs")
    p = settled(I.spread_zscore(I.rolling_ols(c, "close_a", "close_b", 60, k), "close_a", "close_b", 60, k), "spreads")
    t = engines.signal_pair_trades(p, k)
    m = metrics.trade_metrics(t, k, ["entry_idx"]).select(*k, "trades", "win_rate", "total")
    m = m.join(t.groupBy(*k).agg(factors.profit_factor(F.col("pnl"), "null").alias("profit_factor")), k)
    corr = I.corr_summary(c, k).select(*k, F.col("mean").alias("mean_corr"), F.col("band").alias("corr_band"))
    return metrics.mean_reversion_stats(p.filter("spread IS NOT NULL"), "spread", k, ["ts"]).join(corr, k, "left").join(m, k, "left")


def incubation_review(s: SparkSession, d: str) -> DataFrame:
    t = trades(s, d)
    a = metrics.net_profit_factor(t, ["hypothesis"], 0.5).join(metrics.pf_without_best(t, ["hypothesis"], "event_id").drop("pf"), "hypothesis")
    m = metrics.trade_metrics(t, ["hypothesis"], ["ts", "event_id"]).select("hypothesis", "trades", "win_rate", "max_drawdown")
    out = a.join(m, "hypothesis").join(metrics.daily_sharpe_sortino(t, ["hypothesis"]), "hypothesis")
    return out.withColumn("verdict", factors.scenario_verdict(F.col("net_pf"), F.col("pf_without_best"), F.col("win_rate"), F.col("max_drawdown"), F.col("trades")))


#: Horizons of logged signals, in seconds.
LOGGED = {"5min": 300, "30min": 1800, "1h": 3600, "4h": 14400}


def signal_review(s: SparkSession, d: str, cost: float = 0.5) -> DataFrame:
    """A log of signals with nested features, appended as JSON in two parts and read back: each symbol's results in per cent an
    hour on, after costs and without its best signal, drawdown, daily ratios, how much of each horizon is filled and its factor, the
    factor of scores from 50 on, its best hour of the day, each criterion and the verdict."""
    t = ticks(s, d).select(F.col("event_id").alias("id"), "symbol", "ts", "price")
    filled = joins.fill_outcomes(t, t.select("symbol", "ts", "price"), LOGGED, F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"))
    side = F.when(F.col("id") % 2 == 0, "BUY").otherwise("SELL")
    found = F.struct(*(F.when(F.lit(c == "score"), F.col("id") % 100).cast("double").alias(c) for c in io.FEATURES), F.lit("neutral").alias("sentiment"))
    log = filled.select("id", io.signal_id(F.col("symbol"), F.col("ts")).alias("signal_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_utc"), "symbol", side.alias("signal"), F.col("price").alias("price_at_signal"), found.alias("features"), *(F.col(f"outcome_{h}").cast("string").alias(f"outcome_{h}") for h in LOGGED))
    log, path = settled(log, "signals"), io.scratch(s, "log")
    for part in (0, 1):
        io.append_signal_log(log.filter(F.col("id") % 2 == part).drop("id"), path)
    log = io.read_signal_log(s, path)
    key = ["symbol"]
    t = settled(io.flatten_signal_log(log).select("symbol", "signal_id", F.col("timestamp_utc").cast("timestamp_ntz").alias("ts"), "feat_score", (F.when(F.col("signal") == "BUY", 1).otherwise(-1) * F.col("outcome")).alias("pnl")), "outcomes")
    out = metrics.net_profit_factor(t, key, cost).join(metrics.pf_without_best(t, key, "signal_id").drop("pf"), key)
    out = out.join(metrics.trade_metrics(t, key, ["ts", "signal_id"]).select("symbol", "trades", "win_rate", "max_drawdown"), key).join(metrics.daily_sharpe_sortino(t, key), key)
    held = log.groupBy("symbol").agg(*(f(F.expr(f"try_cast(outcome_{h} AS double)")).alias(f"{n}_{h}") for h in LOGGED for n, f in (("filled", lambda c: F.avg(c.isNotNull().cast("double"))), ("pf", lambda c: factors.profit_factor(c, "null")))))
    sound = metrics.pf_by_score_bucket(t, "feat_score", key, (50,)).filter("symbol IS NOT NULL").select("symbol", F.col("pf").alias("pf_high_score"))
    hours = t.groupBy(*key, F.hour("ts").alias("h")).agg(factors.profit_factor(F.col("pnl"), "null").alias("pf")).filter("pf IS NOT NULL")
    hours = hours.groupBy(*key).agg(F.max_by("h", F.struct(F.round("pf", 9), -F.col("h"))).alias("best_hour"), F.max("pf").alias("best_hour_pf"))
    out = out.join(held, key, "left").join(sound, key, "left").join(hours, key, "left")
    figures = [F.col(c) for c in ("net_pf", "pf_without_best", "win_rate", "max_drawdown", "trades")]
    return out.select("*", *(c.alias(n) for n, c in factors.scenario_criteria(*figures).items()), factors.scenario_verdict(*figures).alias("verdict"))


#: Notes on regimes and changes, for ``risk_context``.
REGIME_RISKS = (("STRESS", "WARNING", "stress: moves are large and turn often"), ("COMPRESSED", "INFO", "compressed: moves are small"))


def observed(s: SparkSession, d: str) -> DataFrame:
    """What the health score of each symbol reads: how unusual its regime's length is, its last change and what such changes
    have cost, its edge against its baseline, its streak of losses, and notes on all of these."""
    b = settled(features(s, d).withColumn("regime", regimes.regime3()).select("symbol", "ts", "regime"), "regimes")
    t = settled(ticks(s, d).select("symbol", "ts", "event_id", (F.col("price") - 35).alias("pnl")), "trades")
    order = ["ts", "event_id"]
    runs = regimes.regime_blocks(b)
    run = regimes.persistence_anomaly(b, regimes.duration_stats(runs)).withColumn("over", F.col("bars_in_regime") / F.col("p95"))
    run = run.select("symbol", F.when(F.col("over") > 3, 3).when(F.col("over") > 2, 2).when(F.col("over") > 1.5, 1).otherwise(0).alias("anomaly_level"))
    now = regimes.transition_zone(b).groupBy("symbol").agg(F.max_by(F.struct("regime", "in_zone"), "ts").alias("x")).select("symbol", "x.*")
    before = runs.withColumn("from_regime", F.lag("regime").over(Window.partitionBy("symbol").orderBy("island"))).groupBy("symbol").agg(F.max_by("from_regime", "island").alias("from_regime"))
    placed = joins.trades_in_blocks(t.withColumnRenamed("ts", "entry_time"), runs)
    change = settled(metrics.per_transition_pf(placed, "symbol", ["entry_time", "event_id"]), "changes")
    level = F.when(F.col("delta") < -0.5, "CRITICAL").when(F.col("delta") < 0, "WARNING").otherwise("INFO")
    change = change.select(F.col("from").alias("from_regime"), F.col("to").alias("regime"), level.alias("level"), F.concat_ws(" to ", "from", "to").alias("message"), F.col("delta").alias("delta_pf"))
    early = t.filter(F.dayofmonth("ts") <= 15)
    base = early.groupBy("symbol").agg(factors.profit_factor(F.col("pnl"), "null").alias("baseline_pf"))
    edge = metrics.edge_health(t, base, ["symbol"], order)
    decay = metrics.edge_decay(t, ["symbol"], order).select("symbol", F.col("type").alias("decay"))
    fading = metrics.degradation_status(t, base, ["symbol"], order).select("symbol", "evenness", "degradation_status")
    out = edge.join(now, "symbol", "left").join(before, "symbol", "left").join(decay, "symbol", "left").join(fading, "symbol", "left").join(run, "symbol", "left").join(metrics.trailing_losses(t, ["symbol"], order), "symbol", "left")
    out = out.withColumn("from_regime", F.when(F.col("in_zone"), F.col("from_regime")))
    risks = s.createDataFrame(list(REGIME_RISKS), "regime string, level string, message string")
    out = metrics.risk_context(out, risks, change)
    steps = F.when(~F.col("in_zone") | F.col("expected_pf_delta").isNull(), 0).when(F.col("expected_pf_delta") < -0.5, 3).when(F.col("expected_pf_delta") < 0, 2).otherwise(1)
    return out.withColumn("transition_level", steps).na.fill({"anomaly_level": 0, "streak": 0})


def observer_cycle(s: SparkSession, d: str) -> DataFrame:
    """The observed state of each symbol, with its health and the mean of all."""
    out = metrics.health_score(observed(s, d))
    return out.crossJoin(F.broadcast(out.agg(F.avg("health").alias("mean_health"))))


def coherence_report(s: SparkSession, d: str) -> DataFrame:
    micro, macro = B.direction(I.atr_sma(hourly(s, d, "5 minutes"))), B.direction(I.atr_sma(hourly(s, d, "4 hours")))
    return B.score_summary(B.coherence_scores(B.pair_windows(micro, macro, "4 hours"), 2))


def snapshot(s: SparkSession, d: str, path: str) -> None:
    io.save_table(observer_cycle(s, d), path)


def _rounded(f):
    return lambda s, d: stamped(f(s, d))


JOBS = {f"job_{f.__name__}": _rounded(f) for f in (signal_pipeline, grid_search, batch_research, behavioural_map, variant_comparison, walk_forward_experiment, nested_filter_selection, nested_model_selection, regime_separability, barrier_separability, pairs_research, incubation_review, signal_review, observer_cycle)}
