"""Properties on seeded bars, cases by hand, causality, round trips of sources, and streams against their batch twins."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.functions import factors, scalars
from sparkbars.operators import bars, engines, ewm, indicators, joins, metrics, regimes, rules, selection
from sparkbars.sources import io
from sparkbars.streaming import stateful, windows

START = dt.datetime(2024, 1, 1)


def seeded_bars(n=200, seed=42, symbols=("A", "B")):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(0, 0.5, n))
        noise = rng.uniform(0, 0.01, n).tolist()
        for k in range(n):
            c = float(close[k])
            rows.append((s, START + dt.timedelta(hours=k), c * (1 - noise[k] / 2), c * (1 + noise[k]), c * (1 - noise[k]), c, float(rng.integers(1, 100))))
    return rows


SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(seeded_bars(), SCHEMA).cache()


def live(df):
    out = indicators.live_indicators(indicators.atr_ratio(indicators.atr_sma(df), 50, 10, 0, 99))
    return out.withColumn("lstm_prob", F.lit(60.0)).withColumn("xgboost_prob", F.lit(55.0)).withColumn("adx_regime", regimes.adx_regime())


def test_indicator_properties(frame):
    out = rules.weighted_score(rules.votes(live(frame))).toPandas()
    assert len(out) == 400
    rsi = out.rsi_w.dropna()
    assert rsi.between(0, 100).all() and out.rsi_w.isna().sum() == 2 * 13
    ok = out.dropna(subset=["bb_mid"])
    assert (ok.bb_lower <= ok.bb_mid).all() and (ok.bb_mid <= ok.bb_upper).all()
    assert (out.atr_w.dropna() >= 0).all() and out.signal.isin([-1, 0, 1]).all() and out.score.between(0, 100).all()
    assert out.adx.dropna().between(0, 100).all() and out.stoch_k.dropna().between(0, 100).all()


def test_features_look_at_the_past_alone(spark, frame):
    whole = indicators.lab_features(frame).withColumn("regime", regimes.regime4())
    cut = indicators.lab_features(frame.filter(F.col("ts") < F.lit(START + dt.timedelta(hours=120)))).withColumn("regime", regimes.regime4())
    cols = ["symbol", "ts", "atr", "atr_ratio", "ema_distance", "bias", "rsi", "disorder", "coherence", "bb_position", "rvol", "regime"]
    a = whole.select(cols).filter(F.col("ts") < F.lit(START + dt.timedelta(hours=120))).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    b = cut.select(cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_ewm_blocks_equal_one_pass(frame):
    gaps = frame.withColumn("x", F.when(F.col("volume") > 20, F.col("close")))
    one = ewm.ewm(gaps, {"y": ("x", 0.1), "z": ("close", 0.3)})
    parts = ewm.ewm(gaps, {"y": ("x", 0.1), "z": ("close", 0.3)}, block=F.floor(F.unix_timestamp("ts") / 36000))
    both = one.select("symbol", "ts", "y", "z").join(parts.select("symbol", "ts", F.col("y").alias("y2"), F.col("z").alias("z2")), ["symbol", "ts"]).toPandas()
    assert len(both) == 400 and np.allclose(both.y, both.y2, equal_nan=True) and np.allclose(both.z, both.z2)


def test_wilder_and_macd_by_blocks(spark, frame):
    """All recurrences of a step, seeds and second steps with blocks of a few bars, of one block, and of blocks without a value."""
    day = F.floor(F.unix_timestamp("ts") / 86_400)
    parts = (indicators.rsi_wilder_parts(), indicators.macd_parts(), indicators.adx_parts(), indicators.atr_wilder_parts(30))
    one = indicators.with_indicators(frame, *parts).orderBy("symbol", "ts").toPandas()
    for block in (day, F.floor(F.unix_timestamp("ts") / 10_000), F.lit(0)):
        got = indicators.with_indicators(frame, *parts, block=block).orderBy("symbol", "ts").toPandas()
        pd.testing.assert_frame_equal(one, got[one.columns], rtol=1e-9, atol=1e-9)
    plan = ewm.ewm(frame, {"e": ("close", 0.1)}, block=day)._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("alpha", [0.02, 0.5, 0.9, 0.99, 1.0])
def test_ewm_over_many_stretches(frame, alpha):
    """The frames equal the recurrence, also where stretches of values end within the series, and after missing values."""
    gaps = frame.withColumn("x", F.when(F.col("volume") > 20, F.col("close")))
    got = ewm.ewm(gaps, {"y": ("x", alpha)}).toPandas().sort_values(["symbol", "ts"])
    for _, part in got.groupby("symbol"):
        want = part.x.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        assert np.allclose(part.y, want, rtol=1e-12, atol=0, equal_nan=True)


def test_close_only_scan_bar_by_bar():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(2, 300))
        close, signal, atr = 50 + rng.normal(size=n).cumsum(), rng.choice([0, 0, 0, 1, -1], n), rng.choice([0.0, 1.0, 2.0], n)
        want, side, capital = [], 0, 1000.0
        for i in range(1, n):
            c, s = close[i], signal[i - 1]
            if side:
                reason = "SL" if side * (c - stop) <= 0 else "TP" if side * (c - goal) >= 0 else "OPPOSITE" if s == -side else None  # noqa: F821
                if reason:
                    pnl = side * (c - entry) / entry * capital * 0.1  # noqa: F821
                    capital += pnl
                    want.append((at, i, side, entry, c, pnl, reason))  # noqa: F821
                    side = 0
            if not side and s and atr[i] > 0:
                side, entry, at = int(s), c, i
                stop, goal = c - side * 1.5 * atr[i], c + side * 2.5 * atr[i]
        assert engines.close_only_scan(close, signal, atr, 1.5, 2.5, 1000.0, 0.1) == want


@pytest.mark.parametrize("cell", [600, 3600 * 7, 10**9])
@pytest.mark.parametrize("forward,strict", [(False, False), (True, False), (False, True)])
def test_asof_by_cells(spark, cell, forward, strict):
    rng = random.Random(6)
    when = lambda: START + dt.timedelta(seconds=rng.randrange(0, 400_000, 100))
    left = [(k, rng.choice("ab"), when()) for k in range(120)] + [(900, "c", when()), (901, "a", None), (902, None, when())]
    right = [(s, t, k) for k, (s, t) in enumerate({(rng.choice("ab"), when()) for _ in range(60)})] + [("a", None, -1)]
    a, b = spark.createDataFrame(left, "id int, symbol string, ts timestamp"), spark.createDataFrame(right, "symbol string, ts timestamp, v int")
    got = {r.id: r.v for r in joins.asof(a, b, ["v"], forward=forward, strict=strict, cell=cell).collect()}
    for i, s, t in left:
        fit = [(x, v) for y, x, v in right if t and x and y == s and ((x >= t) if forward else x < t or (x == t and not strict))]
        assert got[i] == ((min(fit) if forward else max(fit))[1] if fit else None)
    assert len(got) == len(left)


@pytest.mark.parametrize("block", [7, 8192])
def test_cascade_recovery_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    rows = [(k, n, float(x)) for k in "ab" for n, x in enumerate(rng.normal(0.05, 1, 150))]
    t = spark.createDataFrame(rows, "key string, n int, pnl double")
    got = metrics.cascade_recovery(t, metrics.loss_cascades(t, ["key"], ["n"]), ["key"], ["n"], block=block).collect()
    assert len(got) > 20
    for r in got:
        cum = np.cumsum([x for k, _, x in rows if k == r.key])
        want = next((k - r.end_idx for k in range(r.end_idx + 1, 151) if cum[k - 1] >= round(cum[r.end_idx - 1] - r.cum_pnl, 9) - 1e-9), None)
        assert r.recovery == want


def test_trailing_losses(spark):
    t = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -1.0), ("a", 3, -2.0), ("b", 1, -1.0), ("b", 2, 0.0), ("c", 1, -1.0)], "key string, n int, pnl double")
    assert {r.key: r.streak for r in metrics.trailing_losses(t, ["key"], ["n"]).collect()} == {"a": 2, "b": 0, "c": 1}


def test_short_and_flat_series(spark):
    flat = spark.createDataFrame([("F", START + dt.timedelta(hours=k), 5.0, 5.0, 5.0, 5.0, 1.0) for k in range(30)] + [("S", START, 1.0, 2.0, 0.5, 1.5, 1.0)], SCHEMA)
    out = live(indicators.lab_features(flat)).toPandas()
    assert len(out) == 31 and not np.isinf(out.select_dtypes(float).to_numpy()).any()
    assert bars.clean_bars(spark.createDataFrame([("X", START, None, 1.0, 1.0, 1.0, 0.0), ("X", START, 1.0, 1.0, 1.0, -1.0, 0.0)], SCHEMA)).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert indicators.lab_features(empty).count() == 0 and regimes.regime_blocks(empty.withColumn("regime", F.lit("x"))).count() == 0


def test_all_rule_types(frame):
    b = indicators.breakout_levels(indicators.lab_features(frame))
    configs = [c for c, _ in rules.CATALOGUE.values()] + [{"type": "feature_threshold", "feature": "rsi", "op": ">", "value": 50}, {"type": "multi_condition", "direction": -1, "conditions": [{"feature": "rsi", "op": "<", "value": 60}, {"feature": "atr", "op": ">=", "value": 0}]}, {"type": "momentum", "threshold": 0.5}, {"type": "range_breakout", "threshold": 1.0}]
    assert {c["type"] for c in configs} == set(rules.RULES)
    out = b.select(*(rules.entry_rule(c).alias(f"r{k}") for k, c in enumerate(configs))).toPandas()
    assert out.isin([-1, 0, 1]).all().all() and (out != 0).any().sum() >= 9
    with pytest.raises(ValueError):
        rules.entry_rule({"type": "other"})


def bar(k, low, high, close, o=None):
    return ("A", k, float(high), float(low), float(close), START + dt.timedelta(hours=k), float(o if o is not None else close))


def barrier_bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, idx int, high double, low double, close double, ts timestamp, open double")


@pytest.mark.parametrize("tie, want", [("SL", "SL_HIT"), ("TP", "TP_HIT")])
def test_barrier_ties_and_timeouts(spark, tie, want):
    b = barrier_bars(spark, [bar(0, 9, 11, 10), bar(1, 7, 13, 10), *[bar(k, 9, 11, 10) for k in range(2, 8)]])
    t = spark.createDataFrame([("A", 1, 0, 1, 8.0, 12.0), ("A", 2, 1, 1, 8.0, 12.0), ("A", 3, 7, 1, 8.0, 12.0), ("A", 4, 0, -1, 12.5, 7.5)], "symbol string, trade_id long, entry_idx int, direction int, sl double, tp double")
    got = {r.trade_id: r for r in joins.resolve_barriers(t, b, 3, tie).collect()}
    assert got[1].outcome == want and got[1].exit_idx == 1 and got[4].outcome == want
    assert got[2].outcome == "TIMEOUT" and got[2].exit_idx == 4 and got[2].exit_price == 10
    assert got[3].outcome is None


def test_sequential_trades_by_hand(spark):
    rows = [("A", START + dt.timedelta(hours=k), 10.0, float(h), float(l), float(c), 1.0, 1.0, sig) for k, (h, l, c, sig) in enumerate([(10, 10, 10, 1), (10, 10, 10, 1), (10.5, 9.5, 10, 1), (12.5, 10, 12, 1), (12, 11, 11, 0), (10, 10, 10, 0), (10.2, 8.0, 9, 0), (10, 10, 10, 0)])]
    b = spark.createDataFrame(rows, SCHEMA + ", atr double, signal int")
    got = engines.sequential_trades(b, {"sl_atr": 1.5, "tp_atr": 2.0}, 48).orderBy("entry_idx").collect()
    # signal on bar 0 enters at 1, target at 3; that bar opens none; the signal on 3 enters at 4 and stops at 6
    assert [(r.entry_idx, r.exit_idx, r.outcome) for r in got] == [(1, 3, "TP_HIT"), (4, 6, "SL_HIT")]


def test_close_only_scan():
    got = engines.close_only_scan(np.array([10.0, 10, 12, 12, 9, 9]), np.array([1, 0, 0, -1, 0, 0]), np.ones(6), 1.0, 2.0, 1000.0, 0.5)
    assert [(g[0], g[1], g[6]) for g in got] == [(1, 2, "TP"), (4, 5, "SL")] or got[0][6] == "TP"
    assert got[0][5] == pytest.approx(100.0)


def test_hysteresis_and_cooldown(spark):
    labels, conf = list("AABBABBBCA"), [0.9] * 5 + [0.9, 0.5, 0.9, 0.9, 0.9]
    assert "".join(regimes.hysteresis_scan(labels, conf)) == "A" * 10
    assert "".join(regimes.hysteresis_scan("ABBBB", [0.9] * 5)) == "AAABB"
    at = [0, 10, 47, 48, 95, 96]
    e = spark.createDataFrame([("A", START + dt.timedelta(hours=h)) for h in at], "symbol string, ts timestamp")
    hours = lambda df: sorted((r.ts - START).total_seconds() / 3600 for r in df.collect())
    assert hours(engines.cooldown(e, 48 * 3600)) == [0, 48, 96] == hours(stateful.entry_cooldown(e))


def test_asof_edges(spark):
    t = spark.createDataFrame([("A", 5), ("A", 10), ("A", 11), ("B", 3)], "symbol string, ts int")
    b = spark.createDataFrame([("A", 10, "x"), ("A", 10, "x"), ("A", 20, "y")], "symbol string, ts int, v string")
    get = lambda **k: {(r.symbol, r.ts): r.v for r in joins.asof(t, b, ["v"], **k).collect()}
    assert get() == {("A", 5): None, ("A", 10): "x", ("A", 11): "x", ("B", 3): None}
    assert get(strict=True)["A", 10] is None and get(strict=True)["A", 11] == "x"
    assert get(forward=True) == {("A", 5): "x", ("A", 10): "x", ("A", 11): "y", ("B", 3): None}


def test_danger_zone_edges(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    s = spark.createDataFrame([(1, at(0)), (2, at(60)), (3, at(200))], "id long, ts timestamp")
    e = spark.createDataFrame([(at(30), "exactly"), (at(91), "late"), (at(29), "near")], "event_time timestamp, title string")
    got = {r.id: (r.blocked, r.title, r.events) for r in joins.danger_zone(s, e).collect()}
    assert got == {1: (True, "near", 2), 2: (True, "exactly", 1), 3: (False, None, 0)}


def test_fill_outcomes_by_hand(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    s = spark.createDataFrame([(1, "A", at(0), 65.0, None), (2, "A", at(0), 65.0, 7.0)], "id long, symbol string, ts timestamp, price double, outcome_5min double")
    p = spark.createDataFrame([("A", at(3), 60.0), ("A", at(6), 66.3), ("A", at(20), 70.0)], "symbol string, ts timestamp, price double")
    got = {r.id: r for r in joins.fill_outcomes(s, p, {"5min": 300, "1h": 3600}, F.lit(at(10))).collect()}
    assert got[1].outcome_5min == pytest.approx(2.0) and got[1].outcome_1h is None and got[2].outcome_5min == 7.0


def test_factors_and_cascades(spark):
    t = spark.createDataFrame([("k", n, float(p)) for n, p in enumerate([5, -1, -2, 1, -1, -1, -1, 10, -3])], "key string, n int, pnl double")
    c = metrics.loss_cascades(t, ["key"], ["n"])
    got = sorted(tuple(r) for r in metrics.cascade_recovery(t, c, ["key"], ["n"]).collect())
    assert got == [("k", 2, 3, 2, -3.0, 5), ("k", 5, 7, 3, -3.0, 1)]
    pf = lambda rows, c: spark.createDataFrame([(float(x),) for x in rows], "p double").agg(factors.profit_factor(F.col("p"), c)).first()[0]
    assert pf([1, 2], "infinite") == float("inf") and pf([1, 2], "null") is None and pf([2, -1], "floor") == 2 and pf([-1], "infinite") == 0
    m = metrics.trade_metrics(t, ["key"], ["n"]).first()
    assert m.trades == 9 and m.wins == 3 and m.max_drawdown == 5.0 and m.total == 7.0


def test_first_at_least():
    rng = np.random.default_rng(0)
    v = rng.normal(size=200).cumsum()
    ends, levels = rng.integers(0, 199, 60), rng.normal(0, 8, 60)
    want = [next((k for k in range(e + 1, 200) if v[k] >= x), -1) for e, x in zip(ends, levels)]
    assert metrics.first_at_least(v, ends, levels).tolist() == want


def test_bootstrap_is_repeatable(spark):
    t = spark.createDataFrame([("a", n, float(n % 5 - 2)) for n in range(40)] + [("b", n, 1.0) for n in range(3)], "key string, n int, pnl double")
    a, b = (metrics.bootstrap(t.repartition(k), ["key"], ["n"], 60).collect() for k in (1, 4))
    assert a == b and [r.key for r in a] == ["a"] and 0 <= a[0].mc_prob <= 1 and a[0].p5 <= a[0].p50 <= a[0].p95


def test_bootstrap_of_groups(spark):
    """Without drift, where the order of draws shows: figures of many groups are those of one, within the sampling error of
    the replicates, and those of plain resampling."""
    rng = np.random.default_rng(3)
    pnl = rng.normal(0, 1, 1200)
    pnl = np.sort(pnl - pnl.mean())  # a trend within the series; draws must not keep it
    t = spark.createDataFrame([("a", n, float(x)) for n, x in enumerate(pnl)], "key string, n int, pnl double")
    n = 600
    plain = metrics.resampled_paths(pnl, 4000, rng)
    dd, final = plain[:, 3], plain[:, 0]
    for group in (1 << 18, 500, 100):
        got = metrics.bootstrap(t, ["key"], ["n"], n, group=group, draws=100_000).first()
        assert got.replicates == n
        assert abs(got.mean_dd - dd.mean()) < 4 * dd.std() * (1 / n + 1 / 4000) ** 0.5, group
        assert abs(got.mean_final) < 4 * final.std() * (1 / n + 1 / 4000) ** 0.5, group
        low, high = np.quantile(dd, [0.92, 0.98])
        assert low < got.dd95 < high and abs(got.mc_prob - 0.5) < 4 * 0.5 / n**0.5, group
    again = [metrics.bootstrap(t.repartition(k), ["key"], ["n"], 40, group=300, draws=5000).first() for k in (1, 3)]
    assert again[0] == again[1]
    paths = metrics.resampled_paths(np.array([1.0, -2.0, 3.0]), 50, np.random.default_rng(0))
    cum = np.array([1.0, -2.0, 3.0])[np.random.default_rng(0).integers(0, 3, (50, 3))].cumsum(1)
    assert np.allclose(paths, np.column_stack([cum[:, -1], cum.max(1), cum.min(1), [max(max(c[: k + 1]) - c[k] for k in range(3)) for c in cum]]))


def test_a_filter_that_removes_nothing_is_not_valid(spark):
    """Its factor differs from the baseline by the order of summation alone."""
    rows = [("a", 0, 1.0, 2.0 * (1 + 1e-15), 2.0), ("a", 1, 0.9, 2.0 * (1 - 1e-15), 2.0), ("b", 0, 1.0, 2.0 * (1 + 1e-15), 2.0), ("b", 1, 0.7, 2.1, 2.0), ("b", 2, 0.5, 9.0, 2.0)]
    frame = spark.createDataFrame(rows, "fold string, place int, retention double, pf double, baseline_pf double")
    got = {r.fold: (r.place, r.valid) for r in selection.first_valid_filter(frame, ["fold"]).collect()}
    assert got == {"a": (0, False), "b": (1, True)}


def one_pass(x, model):
    """Forward-backward over a whole series, step by step."""
    b, log = regimes.emissions((x - model["shift"]) / model["scale"], model)
    n, k = b.shape
    alpha, scale, beta, moves = np.zeros((n, k)), np.zeros(n), np.ones((n, k)), np.zeros((k, k))
    for t in range(n):
        a = (model["start"] if t == 0 else alpha[t - 1] @ model["trans"]) * b[t]
        scale[t] = a.sum()
        alpha[t] = a / scale[t]
    for t in range(n - 2, -1, -1):
        ahead = b[t + 1] * beta[t + 1] / scale[t + 1]
        moves += model["trans"] * np.outer(alpha[t], ahead)
        beta[t] = model["trans"] @ ahead
    return alpha * beta, moves, np.log(scale).sum() + log


def test_hmm_is_that_of_one_pass_for_any_segment(spark):
    rng = np.random.default_rng(1)
    states = np.repeat(rng.integers(0, 3, 12), 25)
    x = {s: rng.normal(size=(len(states), 2)) * (1 + states[:, None]) + states[:, None] for s in "AB"}
    rows = [(s, START + dt.timedelta(hours=h), float(a), float(b)) for s in "AB" for h, (a, b) in enumerate(x[s])]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, log_ret double, atr_ratio double")
    fits = [regimes.hmm_fit(frame, 3, 3, ("log_ret", "atr_ratio"), segment=n) for n in (7, 64, 4096)]
    for other in fits[:2]:
        for part in ("mean", "var", "start", "trans", "loglik"):
            assert np.allclose(other[part], fits[2][part], rtol=1e-9, atol=1e-9), part
    m = {**fits[2], "loglik": []}
    total = sum(one_pass(x[s], m)[2] for s in "AB")
    again = regimes.hmm_fit(frame, 3, 4, ("log_ret", "atr_ratio"), segment=50)
    assert again["loglik"][3] == pytest.approx(total, rel=1e-9) and again["loglik"] == sorted(again["loglik"])
    want = {(s, h): p for s in "AB" for h, p in enumerate(one_pass(x[s], m)[0])}
    for segment in (5, 4096):
        got = regimes.hmm_tag(frame, m, segment).collect()
        assert len(got) == len(rows)
        for r in got:
            p = want[r.symbol, int((r.ts - START).total_seconds()) // 3600]
            assert r.confidence == pytest.approx(p.max(), abs=1e-9) and (r.state == p.argmax() or p.max() - np.sort(p)[-2] < 1e-9)
    assert regimes.hmm_tag(frame.limit(0), m).count() == 0


def test_steady_state(spark):
    m = spark.createDataFrame([("s", "A", 0.5, 0.5), ("s", "B", 0.25, 0.75)], "symbol string, from string, to_A double, to_B double")
    got = {r.regime: r.p for r in regimes.steady_state(m, ["A", "B"]).collect()}
    assert got["A"] == pytest.approx(1 / 3) and got["B"] == pytest.approx(2 / 3)


def test_sources_round_trip(spark, frame, tmp_path):
    io.write_bars(frame, f"{tmp_path}/bars")
    assert io.read_bars(spark, f"{tmp_path}/bars", ["A"]).count() == 200
    (tmp_path / "b.csv").write_text("Datetime,Open,HIGH,low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 01:00:00,1,2,,1.5,10\n")
    assert [r.close for r in io.read_bars_csv(spark, f"{tmp_path}/b.csv", "X").collect()] == [1.5]
    record = {"signal_id": "X_1", "symbol": "X", "signal": "BUY", "regime": None, "timestamp_utc": "2024-01-01T00:00:00+00:00", "price_at_signal": 65.0, "features": {"rsi": 30.0, "sentiment": "neutral"}, "outcome_1h": "2.0"}
    log = spark.createDataFrame([record, record | {"signal_id": "X_2", "outcome_1h": "ERROR: none"}], io.SIGNAL_LOG, verifySchema=False)
    io.append_signal_log(log, f"{tmp_path}/log")
    flat = io.flatten_signal_log(io.read_signal_log(spark, f"{tmp_path}/log")).collect()
    assert [(r.signal_id, r.feat_rsi, r.outcome) for r in flat] == [("X_1", 30.0, 2.0)]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    io.save_table(df.limit(1).filter("k = 1"), f"{tmp_path}/t")
    assert io.insert_or_ignore(df, f"{tmp_path}/t", ["k"]) == 1 and io.load_table(spark, f"{tmp_path}/t").count() == 2
    io.write_event_log(frame.select("symbol", "ts"), f"{tmp_path}/events")
    assert spark.read.json(f"{tmp_path}/events").count() == 400
    for run, v in (("r1", 1), ("r2", 2)):
        spark.createDataFrame([("a", "h", v)], "asset string, hypothesis string, v int").coalesce(1).write.json(f"{tmp_path}/runs/{run}")
    assert [(r.v, r.run_id) for r in io.load_latest_results(spark, f"{tmp_path}/runs").collect()] == [(2, "r2")]


def test_text_rules(spark):
    row = spark.createDataFrame([("Good good bad", "1.234,56")], "t string, n string")
    c = scalars.keyword_sentiment(F.col("t"), ["good", "great"], ["bad"])
    got = row.select(*(v.alias(k) for k, v in c.items())).first()
    assert (got.n_good, got.n_bad, got.sentiment) == (1, 1, "neutral")
    tone = row.select(scalars.phrase_tone(F.lit("rise rise rise fall"), ["rise"], ["fall"])).first()[0]
    assert tone == "hawkish"


def test_selection(spark):
    df = spark.createDataFrame([("a", f"h{k}", float(k)) for k in range(5)] + [("b", "h0", 2.5)], "asset string, hypothesis string, s double")
    got = [(r.asset, r.s) for r in selection.select_targets(df, "s", 3, 2).collect()]
    assert got == [("a", 4.0), ("a", 3.0), ("b", 2.5)]


# streams


def streamed(spark, df, f, tmp_path, files=3, order="ts"):
    """Run f over a stream that reads df's rows in order, some files at a time, and a last row that moves the watermark."""
    rows = df.orderBy(order).toPandas()
    folder = tmp_path / "in"
    for k, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        spark.createDataFrame(rows.iloc[part], df.schema).coalesce(1).write.mode("overwrite").parquet(str(folder / f"part={k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    name = "s" + str(random.randrange(10**9))
    query = f(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def same(a, b):
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    return key(a) == key(b)


@pytest.fixture(scope="module")
def signals(frame):
    return frame.withColumn("signal", F.when(F.col("volume") > 70, 1).when(F.col("volume") < 20, -1).otherwise(0)).withColumn("sl", F.col("close") - F.col("signal")).withColumn("tp", F.col("close") + F.col("signal"))


@pytest.mark.parametrize("name", ["signal_changes", "position_ledger", "pending_resolution", "entry_cooldown", "regime_change_events", "hysteresis_stream", "rolling_pf_state", "daily_kill_switch"])
def test_stateful_streams_equal_their_batch_twins(spark, signals, tmp_path, name):
    df = signals.withColumn("regime", F.when(F.col("volume") > 50, "A").otherwise("B")).withColumn("confidence", F.col("volume") / 100).withColumn("pnl", F.col("close") - F.col("open")).withColumn("equity", F.col("close")).withColumn("atr", F.lit(0.2))
    f = getattr(stateful, name)
    got = streamed(spark, df, f, tmp_path)
    assert got.count() > 0 and same(got, f(df))


@pytest.mark.parametrize("name", ["signal_changes", "position_ledger", "rolling_pf_state"])
def test_streams_wait_for_late_rows(spark, signals, tmp_path, name):
    """Rows that come up to a day late, and out of order, are taken in their order once the watermark has passed them."""
    df = signals.withColumn("pnl", F.col("close") - F.col("open")).select("symbol", "ts", "high", "low", "close", "signal", "sl", "tp", "pnl")
    f = getattr(stateful, name)
    hours = (F.unix_timestamp("ts") - F.lit(int(START.replace(tzinfo=dt.timezone.utc).timestamp()))) / 3600
    mixed = df.withColumn("came", hours + F.pmod(F.xxhash64("symbol", "ts"), F.lit(20)))
    end = spark.createDataFrame([("end", START + dt.timedelta(days=40 + k), 1.0, 1.0, 1.0, 0, 0.0, 0.0, 0.0, 1e6 + k) for k in range(2)], mixed.schema)
    got = streamed(spark, mixed.unionByName(end), lambda s: f(s, late="1 day"), tmp_path, files=6, order="came").filter("symbol != 'end'")
    assert got.count() > 0 and same(got, f(df))


def test_window_streams(spark, frame, tmp_path):
    ticks = frame.select("symbol", "ts", F.col("volume").cast("long").alias("event_id"), F.col("close").alias("price"))
    got = streamed(spark, ticks, lambda s: windows.stream_bars(s, "4 hours"), tmp_path)
    batch = windows.stream_bars(ticks, "4 hours")
    out = {(r.symbol, r.ts): tuple(r) for r in got.collect()}
    full = {(r.symbol, r.ts): tuple(r) for r in batch.collect()}
    assert len(full) - 4 <= len(out) <= len(full) and all(full[k] == v for k, v in out.items())


def test_stream_joins(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    e = spark.createDataFrame([(k, "A" if k % 2 else "B", at(7 * k), 10.0 + k) for k in range(60)], "id long, symbol string, ts timestamp, price double")
    f = lambda s: windows.stream_outcomes(s, s, {"30min": 1800})
    assert same(streamed(spark, e, f, tmp_path / "a"), f(e))
    zone = lambda s: windows.stream_danger_zone(s.filter("symbol = 'A'").select("id", "ts"), s.filter("symbol = 'B'").select(F.col("ts").alias("event_time"), F.col("id").cast("string").alias("title")))
    assert same(streamed(spark, e, zone, tmp_path / "b"), zone(e))


def test_alert_handlers(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    a = spark.createDataFrame([("a", "h", "t", "WARNING", at(h), pf) for h, pf in ((0, 2.0), (1, 1.9), (2, 1.5), (5, 1.5), (6, 1.5))], "asset string, hypothesis string, type string, severity string, ts timestamp, pf double")
    assert sorted((r.ts - START).total_seconds() / 3600 for r in stateful.alert_throttle(a).collect()) == [0, 2, 6]
    t = spark.createDataFrame([("a", "h", at(k), float(p)) for k, p in enumerate([-1, -1, -1, -1, -1, 2, -1, 1])], "asset string, hypothesis string, ts timestamp, pnl double")
    assert [(r.severity, r.depth) for r in stateful.loss_streak_alerts(t).orderBy("ts").collect()] == [("WARNING", 2), ("WARNING", 4), ("CRITICAL", 5), ("RECOVERED", 5)]
    k = spark.createDataFrame([("s", at(h), e, 1.0, 100.0) for h, e in ((0, 100.0), (1, 97.0), (2, 90.0), (24, 90.0), (25, 89.9))], "symbol string, ts timestamp, equity double, atr double, close double")
    assert [(r.ts - START).total_seconds() / 3600 for r in stateful.daily_kill_switch(k).collect()] == [1]
    d = spark.createDataFrame([("a", at(k), "INFO" if k else "CRITICAL", f"m{k % 7}") for k in range(14)], "asset string, ts timestamp, severity string, message string")
    got = windows.alert_digest(d).first()
    assert got.digest.startswith("m0; m1") and got.more == 2


def test_dbscan_with_a_hot_point(spark):
    """Against brute force, with a fifth of a million rows on one point: all their pairs would not end."""
    import numpy as np

    from sparkbars.operators import ml

    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal((1, 1), 0.15, (60, 2)), rng.normal((2.5, 0), 0.3, (40, 2)), rng.uniform(-2, 4, (60, 2)), [[0.2, 0.0], [0.4, 0.0]]])
    hot = 200_000
    few = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "k long, x double, y double")
    frame = few.union(spark.range(1000, 1000 + hot).selectExpr("id", "0D", "0D"))
    every, w = np.concatenate([xy, [[0.0, 0.0]]]), np.array([1] * len(xy) + [hot])
    near = ((every[:, None] - every[None]) ** 2).sum(-1) <= 0.2 * 0.2
    n = (near * w).sum(1)
    core = n >= 4
    label = np.where(core, np.arange(len(every)), len(every))
    for _ in range(len(every)):
        label = np.where(core, np.where(near & core, label, len(every)).min(1), label)
    got = {r.k: r for r in ml.dbscan(frame, ["x", "y"], 0.2, 4, "k").filter("k <= 1000").collect()}
    keys = [*range(len(xy)), 1000]
    assert [got[k].neighbours for k in keys] == n.tolist()
    assert [got[k].kind for k in keys] == ["core" if c else "border" if (r & core).any() else "noise" for c, r in zip(core, near)]
    pairs = {(got[k].cluster, int(x)) for k, x, c in zip(keys, label, core) if c}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1
    assert all(got[k].cluster in {got[j].cluster for j, x, c in zip(keys, r, core) if x and c} for k, r in zip(keys, near) if got[k].kind == "border")
    assert all((got[k].cluster is None) == (got[k].kind == "noise") for k in keys)


def test_profit_factor_udaf_sums_before_python(spark, small):
    from sparkbars.functions import factors
    from sparkbars.plans import queries

    plan = queries.QUERIES["profit_factor_udaf"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    t = spark.createDataFrame([("a", 3.0), ("a", -2.0), ("a", None), ("b", 1.0), ("c", 0.0), ("d", None)], "k string, pnl double")
    assert dict(factors.profit_factor_udaf(t, ["k"]).collect()) == {"a": 1.5, "b": float("inf"), "c": 0.0, "d": 0.0}
