"""Filters chosen on an inner part of each fold, against a plain version."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbars.operators import selection

KINDS = "horizon int, fold int, part string, pnl double, adx double, atr_ratio double"


def chosen(rows, filters):
    """Each fold's filter and figures, row by row; None where there is none."""
    factor = lambda x: sum(v for v in x if v > 0) / max(-sum(v for v in x if v < 0), 1e-9)
    fits = lambda r, f: r[4] is not None and r[5] is not None and r[4] < f[0] and f[1] < r[5] < f[2]
    out = {}
    for key in sorted({r[:2] for r in rows}):
        select, test = ([r for r in rows if r[:2] == key and r[2] == part] for part in ("select", "test"))
        if not select:
            continue
        base, best = factor([r[3] for r in select]), None
        for place, f in enumerate(filters):
            kept = [r[3] for r in select if fits(r, f)]
            if len(kept) < 5 or len(kept) / len(select) < 0.6:
                continue
            if factor(kept) > base * (1 + 1e-9):
                best = (place, factor(kept), True)
                break
            if best is None or round(factor(kept), 9) > round(best[1], 9):
                best = (place, factor(kept), False)
        after = [r[3] for r in test if best is None or fits(r, filters[best[0]])]
        out[key] = (best and best[0], bool(best and best[2]), len(test), len(after), factor(after) if after else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_filters_of_folds(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for horizon in (2, 3):
        for fold in range(4):
            for part, n in (("select", 40), ("test", 30)):
                adx, ratio = rng.uniform(10, 33, n), rng.uniform(0.75, 1.35, n)
                pnl = rng.normal(size=n) + (adx < 26) * 0.4 * (seed - 1)
                rows += [(horizon, fold, part, round(float(p), 3), None if rng.random() < 0.03 else float(a), float(x)) for p, a, x in zip(pnl, adx, ratio)]
    filters = [(35.0, 0.7, 1.5), (30.0, 0.7, 1.5), (28.0, 0.7, 1.3), (15.0, 0.9, 1.0)]
    got = {(r.horizon, r.fold): r for r in selection.nested_filters(spark.createDataFrame(rows, KINDS), filters=filters).collect()}
    want = chosen(rows, filters)
    assert got.keys() == want.keys()
    for key, (place, valid, before, after, pf) in want.items():
        r = got[key]
        assert (r.place, r.valid, r.trades_before, r.trades_after) == (place, valid, before, after)
        assert r.pf_after == pytest.approx(pf) and r.test_retention == pytest.approx(after / before)
    for horizon in (2, 3):
        places = [want[k][0] for k in sorted(want) if k[0] == horizon and want[k][0] is not None]
        usual = {got[k].usual for k in got if k[0] == horizon}
        assert usual == {Counter(places).most_common(1)[0][0] if places else None}


def test_folds_without_candidates(spark):
    """Too few trades for any filter, no trades to test on, none to choose on; and no rows at all."""
    few = [(2, 0, "select", 1.0, 10.0, 1.0)] * 4 + [(2, 0, "test", 2.0, 50.0, 1.0), (2, 0, "test", -1.0, 10.0, 1.0)]
    rows = few + [(2, 1, "select", 1.0, 10.0, 1.0)] * 9 + [(2, 2, "test", 1.0, 10.0, 1.0)]
    got = {r.fold: r for r in selection.nested_filters(spark.createDataFrame(rows, KINDS)).collect()}
    assert got.keys() == {0, 1}
    assert (got[0].place, got[0].valid, got[0].trades_after, got[0].pf_after, got[0].test_retention) == (None, False, 2, 2.0, 1.0)
    assert (got[1].place, got[1].valid, got[1].trades_before, got[1].test_retention, got[1].usual) == (0, False, 0, None, 0)
    assert selection.nested_filters(spark.createDataFrame([], KINDS)).collect() == []


def test_inner_split(spark):
    start = dt.datetime(2024, 1, 1)
    bars = spark.createDataFrame([(s, start + dt.timedelta(hours=h)) for s, n in (("a", 50), ("b", 21), ("c", 1)) for h in range(n)], "symbol string, ts timestamp_ntz")
    folds = selection.expanding_folds(bars)
    inner = selection.inner_split(folds, 0.7)
    assert inner.count() == folds.filter("part = 'train'").count()
    for r in inner.groupBy("symbol", "fold").agg(F.count_if(F.col("inner") == "fit").alias("fit"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("inner") == "fit", F.col("ts"))).alias("a"), F.min(F.when(F.col("inner") == "select", F.col("ts"))).alias("b")).collect():
        assert r.fit == int(r.n * 0.7 + 1e-9) and (r.a is None or r.a < r.b)
