"""Early entries, cluster names, criteria and importances by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbars.functions import factors
from sparkbars.operators import joins, metrics, ml

START = dt.datetime(2024, 1, 1)
at = lambda h: START + dt.timedelta(hours=h)


def test_early_trades_and_deltas(spark):
    close = [100, 101, 102, 103, 104, 103, 99, 98, 100, 110]
    buckets = ["B1", "B2", "B1", "B2", "B1", "B1", "B1", "B1", "B1", "B1"]
    bars = spark.createDataFrame([("A", at(h), h, c + 0.5, c - 0.5, float(c), None if h == 1 else 1.0, b) for h, (c, b) in enumerate(zip(close, buckets))], "symbol string, ts timestamp, idx long, high double, low double, close double, atr double, stretch_bucket string")
    trades = spark.createDataFrame([("A", "t1", at(2), 1, 2.0, 2), ("A", "t2", at(5), 1, -1.0, 5), ("A", "t3", at(1), -1, 4.0, 1), ("A", "t4", at(5), -1, 1.0, 6)], "symbol string, trade_id string, entry_time timestamp, direction int, pnl double, entry_idx int")
    out = joins.early_trades(trades, bars, hours=2)
    got = {r.trade_id: r for r in out.collect()}
    assert (got["t3"].early_outcome, got["t3"].early_entry, got["t3"].early_pnl) == ("NO_PRECURSOR", None, None)
    assert (got["t1"].hours_early, got["t1"].early_entry, got["t1"].early_sl) == (1, 101, pytest.approx(101 - 1.5e-4)) and got["t1"].early_outcome == "TP_HIT"
    assert (got["t2"].hours_early, got["t2"].early_sl, got["t2"].early_tp, got["t2"].early_outcome) == (2, 101.5, 105, "SL_HIT") and got["t2"].early_pnl == -1.5
    assert (got["t4"].early_sl, got["t4"].early_tp, got["t4"].early_outcome) == (104.5, 101, "SL_HIT")
    r = metrics.early_entry_deltas(out, ["symbol"], ["entry_idx"]).first()
    early = [got[t].early_pnl for t in ("t1", "t2", "t4")]
    assert r.actual_trades == r.early_trades == 3 and r["lead 0-2h"] == 1 and r["lead 2-5h"] == 2 and r["lead >10h"] == 0
    assert r.delta_expectancy == pytest.approx(np.mean(early) - np.mean([2.0, -1.0, 1.0])) and r.delta_win_rate == pytest.approx(100 / 3 - 200 / 3)
    assert r.avg_hours == pytest.approx(5 / 3) and r.actual_max_drawdown == 1.0


def test_names_and_criteria(spark):
    rows = [(1.2, 0.9, -0.2, 0.5, 0.1, 0.1, 0.6), (0.9, 1.0, 0.0, 0.5, 0.1, 0.5, 0.6), (0.8, 1.0, 0.0, 0.5, 0.7, 0.1, 0.6), (1.0, 1.0, 0.0, 0.1, 0.5, 0.1, 0.4), (0.9, 1.0, 0.0, 0.5, 0.3, 0.3, 0.6), (1.5, 1.2, 0.0, 0.5, 0.5, 0.1, None)]
    names = ["test_pf", "oos_pf", "degradation", "robustness", "trending", "high_vol", "mc_prob"]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(factors.cluster_name(*map(F.col, names))).collect()]
    assert got == ["DATA_MINING_OVERFIT", "VOLATILITY_TRAP", "TREND_CHASING_TRAP", "SIGNAL_DROUGHT", "REGIME_NOISE", "STRUCTURAL_FAILURE"]
    met = factors.scenario_criteria(F.lit(1.4), F.lit(None).cast("double"), F.lit(39.0), F.lit(500.0), F.lit(30))
    assert spark.range(1).select(*(c.alias(k) for k, c in met.items())).first().asDict() == {"enough_trades": True, "pf_ok": True, "pf_without_best_ok": False, "drawdown_ok": True, "win_rate_ok": False}


def test_importances(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    rows = [("s", n, float(a), float(b), int(a > 0)) for n, (a, b) in enumerate(x)]
    frame = spark.createDataFrame(rows, "symbol string, ts long, a double, b double, label int")
    got = ml.importances(ml.gbt_train(frame, ["a", "b"], trees=3), ["a", "b"])
    assert got[0][0] == "a" and got[0][1] > 0.9 and sum(v for _, v in got) == pytest.approx(1)
