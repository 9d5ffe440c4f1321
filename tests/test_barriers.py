"""The index of highs and lows against the bars one by one."""

import random

import pytest
from pyspark.sql import functions as F

from sparkbars.operators import barriers, joins


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(3)
    bars, trades = [], []
    for s, n in (("A", 700), ("B", 90)):
        c = 100.0
        for i in range(n):
            c = round(c + rng.gauss(0, 0.5), 1)
            bars.append((s, i, c + rng.choice([0.1, 0.5]), c - rng.choice([0.1, 0.5]), c))
    at = {(s, i): c for s, i, *_, c in bars}
    for k in range(150):
        s = rng.choice("AB")
        i = rng.randrange(700 if s == "A" else 90)
        side, wide = rng.choice([1, -1]), rng.choice([0.2, 1, 5, 12, 500])
        trades.append((s, f"t{k}", i, side, round(at[s, i] - side * wide, 1) if k % 11 else None, round(at[s, i] + side * wide, 1)))
    return spark.createDataFrame(trades, "symbol string, trade_id string, entry_idx long, direction int, sl double, tp double"), spark.createDataFrame(bars, "symbol string, idx long, high double, low double, close double")


def test_stretches_cover_a_range_once(spark):
    for a, b, levels in ((0, 1, 2), (5, 5, 2), (3, 40, 2), (63, 65, 2), (0, 512, 3), (7, 601, 2), (1, 9, 0)):
        got = spark.range(1).select(barriers.stretches(F.lit(a), F.lit(b), levels).alias("s")).first().s
        assert sorted(i for r in got for i in range(r.cell * 8**r.level, (r.cell + 1) * 8**r.level)) == list(range(a, b))
        assert len(got) <= 16 * (levels + 1)


@pytest.mark.parametrize("horizon, tie", [(5, "SL"), (48, "TP"), (600, "SL")])
def test_the_index_finds_what_the_bars_tell(market, horizon, tie):
    trades, bars = market
    want, got = ({r.trade_id: (r.outcome, r.exit_idx, r.exit_price) for r in f(trades, bars, horizon, tie).collect()} for f in (joins.resolve_barriers, barriers.resolve_barriers_by_index))
    assert got == want and {v[0] for v in want.values()} >= {"SL_HIT", "TP_HIT", "TIMEOUT"}


def test_rows_do_not_grow_with_the_horizon(market):
    trades, _ = market
    rows = lambda h, levels: trades.select(F.explode(barriers.stretches(F.col("entry_idx") + 1, F.col("entry_idx") + 1 + h, levels))).count() / trades.count()
    assert rows(48, 1) < 20 and rows(5000, 4) < 45
