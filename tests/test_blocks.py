"""Cells and blocks against whole-key windows and scans in Python, for cells of any width."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkbars.operators import blocks, engines, indicators, metrics, regimes
from sparkbars.streaming import stateful

START = dt.datetime(2024, 1, 1)
WIDTHS = (3600, 50_000, 10**9)


def moments(rng, n):
    """Times with gaps of up to weeks."""
    t, out = START, []
    for _ in range(n):
        t += dt.timedelta(seconds=rng.choice([60, 600, 3600, 7200, 3600, 900_000 if rng.random() < 0.1 else 60]))
        out.append(t)
    return out


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(5)
    rows = [(k, i, t, rng.choice([None, -2.0, -1.0, -0.5, 1.0, 1.5, rng.gauss(0.1, 1)]), rng.choice("AABC") if i % 7 else None, rng.choice(["TP_HIT", "SL_HIT", None]), rng.randint(1, 9)) for k in ("x", "y", None) for i, t in enumerate(moments(rng, 120))]
    return spark.createDataFrame(rows, "key string, i int, ts timestamp, pnl double, regime string, outcome string, bars_held int").repartition(5).cache()


def series_of(df):
    return {k if isinstance(k, str) else None: p.sort_values("ts").reset_index(drop=True) for k, p in df.toPandas().groupby("key", dropna=False)}


def same(a, b):
    return (a is None or a != a) and (b is None or b != b) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("width", WIDTHS)
def test_running_values(trades, width):
    out = series_of(indicators.cumulative_drawdown(trades, "pnl", "key", "ts", width=width))
    run = series_of(blocks.running(trades, "key", "ts", "_number", {"_sum": F.col("pnl")}, width))
    lag = series_of(blocks.lagged(trades, {"was": F.col("pnl"), "at": F.col("i")}, "key", "ts", width))
    last = series_of(blocks.running_last(trades, {"seen": F.when(F.col("pnl") > 1, F.col("i"))}, "key", "ts", width, until_before=True))
    assert len(out) == 3
    for key, p in series_of(trades).items():
        total, peak, seen = None, None, None
        for n, x in enumerate(p.pnl):
            assert run[key]._number[n] == n + 1 and out[key].i[n] == n
            assert same(lag[key].was[n], None if n == 0 else p.pnl[n - 1]) and lag[key]._first[n] == (n == 0)
            assert same(last[key].seen[n], seen)
            if x == x:
                total = (total or 0.0) + x
                peak = total if peak is None else max(peak, total)
                seen = n if x > 1 else seen
            assert same(out[key].cum[n], total) and same(run[key]._sum[n], total) and same(out[key].drawdown[n], None if total is None else peak - total)


@pytest.mark.parametrize("width", WIDTHS)
def test_metrics_by_cells(trades, width):
    got = {r.key: r for r in metrics.trade_metrics(trades, ["key"], ["ts"], width=width).collect()}
    cascades = {(r.key, r.start_idx, r.end_idx, r.depth, round(r.cum_pnl, 9)) for r in metrics.loss_cascades(trades.fillna("null", ["key"]), ["key"], ["ts"], width=width).collect()}
    chances = {(r.key, r.n): (r.cases, r.losses) for r in metrics.conditional_loss_prob(trades, ["key"], ["ts"], width=width).collect()}
    for key, p in series_of(trades).items():
        x = p.pnl.dropna().to_numpy()
        r, cum = got[key], np.cumsum(x)
        assert (r.trades, r.wins, r.losses) == (len(x), (x > 0).sum(), (x <= 0).sum())
        assert same(r.sharpe, x.mean() / x.std(ddof=1)) and same(r.max_drawdown, (np.maximum.accumulate(cum) - cum).max()) and same(r.total, x.sum()) and same(r.expectancy, x.mean())
        assert same(r.profit_factor, x[x > 0].sum() / -x[x < 0].sum()) and same(r.payoff, x[x > 0].mean() / -x[x < 0].mean()) and same(r.recovery, r.total / r.max_drawdown)
        assert same(r.avg_bars, p.bars_held.mean()) and r.tp_hits == (p.outcome == "TP_HIT").sum() and (r.timeouts or 0) == 0
        if key is None:
            continue
        wanted, run = {}, 0
        for v in p.pnl:
            for n in range(1, min(run, 7) + 1):
                a, b = wanted.get((key, n), (0, 0))
                wanted[key, n] = (a + 1, b + (v < 0))
            run = run + 1 if v < 0 else 0 if v == v else run + 1
        assert {k: v[0] for k, v in chances.items() if k[0] == key} == {k: v[0] for k, v in wanted.items()}
    frame = [(k, i, v) for k, p in series_of(trades.fillna("null", ["key"]).dropna(subset=["pnl"])).items() for i, v in zip(p.i, p.pnl)]
    assert {c[0] for c in cascades} == {"x", "y", "null"} and sum(c[3] for c in cascades) <= sum(v < 0 for *_, v in frame)


@pytest.mark.parametrize("width", WIDTHS)
def test_islands(trades, width):
    out = series_of(blocks.islands(trades, "regime", "key", "ts", width))
    for p in out.values():
        island, start = 0, 0
        for n, x in enumerate(p.regime):
            if n == 0 or not (x == p.regime[n - 1] or (pd.isna(x) and pd.isna(p.regime[n - 1]))):
                island, start = island + 1, n + 1
            assert (p.island[n], p._number[n], p._start[n]) == (island, n + 1, start)
    found = {(r.symbol, r.start_idx): (r.end_idx, r.bars, r.regime) for r in regimes.regime_blocks(trades.withColumnRenamed("key", "symbol"), width=width).collect()}
    assert sum(b for _, b, _ in found.values()) == trades.count()


@pytest.mark.parametrize("width", WIDTHS)
def test_peaks_and_returns(spark, width):
    rng = random.Random(1)
    rows = [(k, t, 100 + 10 * rng.random(), 100 + 5 * rng.random()) for k in "ab" for t in moments(rng, 90)]
    frame = spark.createDataFrame(rows, "key string, ts timestamp, equity double, balance double")
    got = {r.key: r for r in metrics.equity_metrics(frame, ["key"], ["ts"], width=width).collect()}
    for key, p in series_of(frame).items():
        r = (p.equity / p.equity.shift() - 1).dropna().to_numpy()
        dd = (1 - p.equity / p.equity.cummax()).max()
        assert got[key].n == len(r) and same(got[key].max_drawdown, dd) and same(got[key].sharpe, r.mean() / r.std() * 6240**0.5) and same(got[key].total_return, p.equity.iloc[-1] / p.equity.iloc[0] - 1)


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_frames_by_blocks(spark, trades, block):
    """Equal to frames over whole keys, with gaps longer than cells and blocks."""
    rng = random.Random(2)
    rows = [(s, t, c := 100 + rng.random(), c + rng.random(), c - rng.random(), c + rng.random() - 0.5, 1.0) for s in ("A", "B", None) for t in moments(rng, 60)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")

    def every(df):
        return indicators.barrier_label(indicators.breakout_levels(indicators.stochastic(indicators.bollinger(indicators.rsi_sma(indicators.atr_ratio(indicators.atr_sma(df))))), 10))

    want, got = (df.orderBy("symbol", "ts").toPandas() for df in (every(bars), blocks.by_blocks(bars, every, back=34, ahead=2, block=block, width=7200)))
    assert set(want.columns) == set(got.columns)
    pd.testing.assert_frame_equal(want, got[want.columns], rtol=1e-9)
    rolled = [metrics.rolling_trade_metrics(trades, ["key"], ["ts"], (5, 12), block=b).orderBy("key", "ts").toPandas() for b in (block, 10**6)]
    pd.testing.assert_frame_equal(*rolled, rtol=1e-9)


def brute_chain(rows):
    out, free = [], None
    for a, b in sorted(rows):
        if free is None or a > free:
            out.append((a, b))
            free = b
    return out


@pytest.mark.parametrize("width", [1, 7, 50, 10**6])
def test_chains_across_cells(spark, width):
    rng = random.Random(width)
    rows = [(k, a, a + rng.choice([0, 1, 5, 40, 300])) for k in ("a", "b", None) for a in sorted(rng.sample(range(2000), 400))]
    rows += [("long", 0, 5000), *(("long", a, a + 1) for a in range(1, 900))]  # a trade that spans all cells
    frame = spark.createDataFrame(rows, "key string, a long, b long").repartition(4)
    got = engines.without_overlaps(frame, ["key"], "a", "b", width).collect()
    for key in ("a", "b", None, "long"):
        assert sorted((r.a, r.b) for r in got if r.key == key) == brute_chain([(a, b) for k, a, b in rows if k == key]), key
    short = [(k, a, b) for k, a, b in rows if b - a <= 40]
    got = engines.without_overlaps(frame.filter("b - a <= 40"), ["key"], "a", "b", width, reach=40).collect()
    for key in ("a", "b", None, "long"):
        assert sorted((r.a, r.b) for r in got if r.key == key) == brute_chain([(a, b) for k, a, b in short if k == key]), key
    assert engines.without_overlaps(frame.limit(0), ["key"], "a", "b", width).count() == 0


@pytest.mark.parametrize("width", [600, 20_000, None])
def test_cooldown_across_cells(spark, width):
    rng = random.Random(3)
    rows = [(s, t) for s in "ab" for t in moments(rng, 150)]
    got = {(r.symbol, r.ts) for r in engines.cooldown(spark.createDataFrame(rows, "symbol string, ts timestamp"), 5000, width=width).collect()}
    want, last = set(), {}
    for s, t in sorted(rows):
        if s not in last or (t - last[s]).total_seconds() >= 5000:
            want.add((s, t))
            last[s] = t
    assert got == want


@pytest.mark.parametrize("width", WIDTHS)
def test_hysteresis_as_frames(spark, width):
    rng = random.Random(4)
    rows = [(s, t, rng.choice("AAAB") if k % 40 < 20 else rng.choice("BBC"), rng.choice([0.9, 0.9, 0.9, 0.5, None])) for s in "xy" for k, t in enumerate(moments(rng, 200))]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, regime string, confidence double")
    got = {(r.symbol, r.ts): r.regime_final for r in regimes.hysteresis(frame, "regime", "confidence", 3, width=width).collect()}
    for s in "xy":
        own = [r for r in rows if r[0] == s]
        want = regimes.hysteresis_scan([r[2] for r in own], [float("nan") if r[3] is None else r[3] for r in own], 3, 0.55)
        assert [got[s, r[1]] for r in own] == want
        assert len(set(want)) > 1


def test_stretches_of_ledger_throttle_and_pairs(spark):
    """The batch twins, dealt out by stretches, against one scan of each key."""
    rng = random.Random(6)
    rows, price = [], 100.0
    for t in moments(rng, 600):
        price += rng.gauss(0, 0.5)
        rows.append(("s", t, price + 0.4, price - 0.4, price, rng.choice([0, 0, 0, 1, -1, None]), price - rng.choice([1, -1, 0.5]), rng.choice([None, price + 1, price - 1])))
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double, signal int, sl double, tp double")
    got = sorted(tuple(r) for r in stateful.position_ledger(frame).collect())
    whole = frame.withColumn("_stretch", F.lit(0))  # one stretch: the scan itself
    import unittest.mock

    with unittest.mock.patch.object(stateful, "running_last", lambda df, *a, **k: df.withColumn("_side", F.lit(None).cast("double"))), unittest.mock.patch.object(stateful, "running", lambda df, *a, **k: df.withColumn("_turn", F.lit(False)).withColumn("_turns", F.lit(1))):
        want = sorted(tuple(r) for r in stateful.position_ledger(whole).collect())
    assert got == want and len(got) > 50

    alerts = [("a", "h", "t", rng.choice(["INFO", "CRITICAL", "odd"]), t, rng.choice([None, 1.0, 1.2, 0.9])) for t in moments(rng, 300)]
    frame = spark.createDataFrame(alerts, "asset string, hypothesis string, type string, severity string, ts timestamp, pf double")
    got = sorted(str(tuple(r)) for r in stateful.alert_throttle(frame).collect())
    with unittest.mock.patch.object(stateful, "running", lambda df, *a, **k: df.withColumn("_stretch", F.lit(0))):
        assert got == sorted(str(tuple(r)) for r in stateful.alert_throttle(frame).collect())

    z, spread = [], []
    for _ in range(500):
        z.append(rng.choice([None, float("nan"), rng.gauss(0, 2), (z[-1] or 0.5) * 0.9 if z else 1.0]))
        spread.append(rng.random())
    frame = spark.createDataFrame([("p", t, v, s) for t, v, s in zip(moments(rng, 500), z, spread)], "a string, ts timestamp, z double, spread double")
    kept = [(v, s) for v, s in zip(z, spread) if v is not None]
    want = [(a, b, side, pnl, why) for a, b, side, pnl, why in engines.pair_scan(np.array([v for v, _ in kept]), np.array([s for _, s in kept]), 2.0, 3.5)]
    for width in WIDTHS:
        got = sorted((r.entry_idx, r.exit_idx, r.direction, r.pnl, r.reason) for r in engines.signal_pair_trades(frame, ["a"], width=width).collect())
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_a_key_is_many_tasks(spark):
    """The five keys of the events at sf0.1 are cells, and no window holds a key's rows."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select(F.col("event_type").alias("key"), "ts", (F.col("value") - 35).alias("pnl"))
    assert blocks.in_cells(events, "ts").select("key", "_cell").distinct().count() > 20
    plan = metrics.trade_metrics(events, ["key"], ["ts"])._jdf.queryExecution().optimizedPlan().toString()
    frames = [x for x in plan.split("\n") if "Window" in x and "_local" in x and "sum(pnl" in x]
    assert frames and all("_cell" in x for x in frames)


@pytest.mark.parametrize("cells", [2, 64])
def test_ranks_and_quantiles_without_a_sort_of_a_key(spark, cells):
    """All values in one key, a third of them equal, some missing; and a key of one row."""
    rng = random.Random(8)
    x = [rng.choice([None, 7.0, 7.0, float(rng.randint(0, 30)), rng.gauss(0, 100)]) for _ in range(900)]
    frame = spark.createDataFrame([("k", v, n % 3) for n, v in enumerate(x)] + [("one", 4.0, 1), (None, 2.0, 1), (None, 1.0, 0)], "key string, x double, y int").repartition(4)
    ranks = {(r.key, r.x): r.r for r in blocks.average_ranks(frame, "key", "x", "r", cells).collect()}
    s = pd.Series(x).rank(method="average", na_option="top")
    assert all(ranks["k", v] == s[n] for n, v in enumerate(x)) and ranks["one", 4.0] == 1 and ranks[None, 2.0] == 2
    chances = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r.key: r.q for r in blocks.exact_quantiles(frame, "key", "x", chances, "q", cells).collect()}
    want = {r.key: r.q for r in frame.groupBy("key").agg(F.percentile("x", F.array(*map(F.lit, chances))).alias("q")).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    w = blocks.Window.partitionBy("key").orderBy("x")
    old = frame.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(blocks.Window.partitionBy("key", "x")) - 1) / 2).groupBy("key").agg(F.corr("r", "y").alias("c")).collect()
    new = metrics.correlation_matrix(frame.withColumn("y", F.col("y").cast("double")), ["x", "y"], spearman=True, key="key").filter("key = 'k'").first()["corr"]
    assert new == pytest.approx(pd.Series(x).rank(method="average", na_option="top").corr(pd.Series([n % 3 for n in range(900)]).rank())) and len(old) == 3
    plan = blocks.counted_below(frame, "key", "x", cells)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_cell" in line for line in plan.split("\n") if "Window" in line and "sum(" in line and "__x" in line)


def test_auc_and_ks_by_counts(spark):
    rng = random.Random(9)
    rows = [("k", round(rng.random(), 2), rng.choice([0, 1, 1, None])) for _ in range(500)] + [("one", 0.4, 1)]
    frame = spark.createDataFrame(rows, "key string, p double, label int")
    got = {r.key: r for r in metrics.classification_metrics(frame, ["key"]).collect()}
    pos, neg = ([p for k, p, y in rows if k == "k" and y == v] for v in (1, 0))
    assert got["one"].auc == 0.5 and got["k"].n == 500
    ranks = pd.Series([p for k, p, _ in rows if k == "k"]).rank()
    at = [r for r, (k, _, y) in zip(ranks, rows) if y == 1]
    assert got["k"].auc == pytest.approx((sum(at) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * len(neg)))
    two = spark.createDataFrame([("s", g, float(v)) for g, v in [("a", rng.gauss(0, 1)) for _ in range(80)] + [("b", rng.gauss(1, 1)) for _ in range(90)] + [("c", 1.0)] * 3], "symbol string, g string, v double")
    rows = metrics.ks_two_sample(two, "g", "v", [("a", "b"), ("a", "c")]).collect()
    a, b = (np.sort([r.v for r in two.collect() if r.g == g]) for g in "ab")
    every = np.concatenate([a, b])
    ks = np.abs(np.searchsorted(a, every, "right") / len(a) - np.searchsorted(b, every, "right") / len(b)).max()
    assert [(r.a, r.b, r.n, r.m) for r in rows] == [("a", "b", 80, 90)] and rows[0].ks == pytest.approx(ks)
