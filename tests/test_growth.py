"""Work that grows with the rows and not with their pairs or groups, and results that no order of rows changes."""

import datetime as dt
import math
import random
import re
import unittest.mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbars.operators import indicators, joins, metrics, ml, regimes
from sparkbars.plans import queries, streams
from sparkbars.streaming import stateful, windows
from tests.test_operators import START

hours = lambda h: START + dt.timedelta(hours=h)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(df) -> int:
    """The most rows that an operator of the plan, run here, put out."""
    def nodes(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            return nodes(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            return nodes(p.plan())
        kids = p.children()
        return [p, *(n for k in range(kids.size()) for n in nodes(kids.apply(k)))]

    rows = df._jdf.queryExecution()
    rows.toRdd().count()
    counts = [n.metrics().get("numOutputRows") for n in nodes(rows.executedPlan())]
    return max(c.get().value() for c in counts if c.isDefined())


def test_throttle_walks_its_stretches_in_one_pass(spark):
    """Of stretches that are many and short none is a group of its own, and one goes on over batches; missing keys are keys."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 2**60 + 1, 7]), f"h{k % 3}", "t", "INFO", hours(20 * k * rng.random()), rng.choice([None, 1.0, 1.2, 0.9])) for k in range(300)]
    frame = spark.createDataFrame(rows, "asset long, hypothesis string, type string, severity string, ts timestamp, pf double")
    want, state = [], {}
    for r in sorted(rows, key=lambda r: r[4]):
        at, pf = state.get(r[:4], (None, None))
        if at is None or (pf and r[5] is not None and (pf - r[5]) / pf > 0.15) or r[4] - at >= dt.timedelta(hours=12):
            state[r[:4]] = r[4], r[5]
            want.append(r)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = stateful.alert_throttle(frame)
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "FlatMapGroupsInPandas" not in plan(out)


def test_first_outcomes_of_tables_make_no_pairs(spark):
    """Many prices in the slack are not paired with each signal, and missing symbols meet nothing."""
    rows = [(k, [None, "A", "B"][k % 3], START + dt.timedelta(seconds=7 * k), 10.0 + k) for k in range(900)]
    frame = spark.createDataFrame(rows, "id long, symbol string, ts timestamp, price double")
    out = windows.stream_first_outcomes(frame, frame, {"1min": 60, "1h": 3600}, 900)
    want = {}
    for i, s, t, p in rows:
        for h, n in (("1min", 60), ("1h", 3600)):
            later = [(u, q) for _, x, u, q in rows if x == s and s and n <= (u - t).total_seconds() <= n + 900]
            want[i, h] = ((min(later)[1] / p - 1) * 100, min(later)[0]) if later else (None, None)
    got = {(r.id, r.horizon): (r.outcome, r["at"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    assert "at#" in plan(out) and not re.search(r"Join .*(>=|<=)", plan(out))


def test_outcomes_meet_by_cells(spark, small):
    """Pairs have an equality on a cell of time, and the query makes none."""
    at = lambda m: START + dt.timedelta(minutes=m)
    frame = spark.createDataFrame([(k, "A" if k % 2 else "B", at(7 * k), 10.0 + k) for k in range(60)], "id long, symbol string, ts timestamp, price double")
    pairs = windows.stream_outcomes(frame, frame, {"30min": 1800}, 1200)
    assert pairs.count() == sum(1800 <= 420 * (b - a) <= 3000 for a in range(60) for b in range(60) if (a - b) % 2 == 0)
    assert "pcell" in plan(pairs)
    least = pairs.groupBy("id", "horizon").agg(F.min("at").alias("at"))
    first = windows.stream_outcomes(frame, frame, {"30min": 1800}, 1200, first=True)
    assert sorted(map(tuple, first.select("id", "horizon", "at").collect())) == sorted(map(tuple, least.collect()))
    assert not re.search(r"Join .*(>=|<=)", plan(streams.QUERIES["stream_outcomes"](spark, small)))


def test_danger_zone_makes_no_pairs(spark):
    """Counts and the nearest event's title against each pair, with equal times, ids that repeat, and missing times."""
    rng = random.Random(5)
    moment = lambda: rng.choice([None, *[START + dt.timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(2)) for _ in range(9)]])
    signals = [(rng.randrange(80), moment()) for _ in range(90)] + [(None, START)]
    events = [(moment(), f"e{k}") for k in range(60)]
    events += [(t, f"d{k}") for k, (t, _) in enumerate(events[:20])]
    out = joins.danger_zone(spark.createDataFrame(signals, "id long, ts timestamp"), spark.createDataFrame(events, "event_time timestamp, title string"), 900)
    near = {}
    for i, t in signals:
        if i is not None and t:
            near.setdefault(i, []).extend((abs(u - t), u, x) for u, x in events if u and abs(u - t) <= dt.timedelta(seconds=900))
    want = sorted(((i, t, bool(near.get(i)), min(near[i])[2] if near.get(i) else None, len(near.get(i, []))) for i, t in signals), key=str)
    assert sorted(((r.id, r.ts, r.blocked, r.title, r.events) for r in out.collect()), key=str) == want and any(w[4] > 2 for w in want)
    # 400 events in each of 400 zones: a join of theirs would have 160,000 rows
    many = spark.range(400).select("id", (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    dense = joins.danger_zone(many, many.select(F.col("ts").alias("event_time"), F.concat(F.lit("e"), "id").alias("title")))
    assert {(r.events, r.title == f"e{r.id}") for r in dense.collect()} == {(400, True)}
    assert most_rows(dense) < 4_000


def test_labels_without_a_move_count_as_none(spark):
    """A symbol whose labels are all missing has 0 of each kind, not a missing count."""
    frame = spark.createDataFrame([("A", None), ("A", None), ("B", 1), ("B", None)], "symbol string, label int")
    assert {tuple(r) for r in indicators.label_balance(frame).collect()} == {("A", 2, 0, 0, 2), ("B", 2, 1, 0, 1)}


def test_stability_of_one_known_factor(spark):
    """With one known profit factor, or a mean of 0, the stability is 0 and not missing."""
    frame = spark.createDataFrame([("a", "A", 20, 1.5), ("a", "B", 20, None), ("b", "A", 20, 0.0), ("b", "B", 20, 0.0), ("c", "A", 20, 2.0), ("c", "B", 20, 2.0)], "asset string, regime string, n long, pf double")
    assert {r.asset: r.stability for r in metrics.regime_stability(frame, ["asset"]).collect()} == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_steady_state_that_is_not_the_only_one(spark):
    """Where a label never occurs, or two never lead to each other, no distribution is the stationary one."""
    rows = [("one", "A", 1.0, 0.0), ("apart", "A", 1.0, 0.0), ("apart", "B", 0.0, 1.0), ("left", "A", 0.5, 0.5), ("left", "B", 0.0, 1.0)]
    m = spark.createDataFrame(rows, "symbol string, from string, to_A double, to_B double")
    got = {(r.symbol, r.regime): r.p for r in regimes.steady_state(m, ["A", "B"]).collect()}
    assert all(math.isnan(got[s, x]) for s in ("one", "apart") for x in "AB")
    assert got["left", "A"] == pytest.approx(0) and got["left", "B"] == pytest.approx(1)


def test_results_do_not_depend_on_how_rows_are_dealt_out(spark, tmp_path):
    """Gains that equal losses to the cent give the same factors to the last bit whatever the partitions."""
    rng, rows = random.Random(9), []
    for user in range(150):
        cents = [rng.randrange(1, 6000) for _ in range(7)]
        values = [35 + c / 100 for c in cents] + [35 - c / 100 for c in rng.sample(cents, 7)]
        rows += [(len(rows) + k, hours(24 * 29 * rng.random()), user, "view", v) for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/a/events.parquet")
    frame.repartition(9, F.rand(1)).write.parquet(f"{tmp_path}/b/events.parquet")
    a, b = (sorted(map(tuple, queries.results(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == 150


def test_rolling_factor_of_trades_at_the_same_time(spark, tmp_path):
    """The query takes trades of one time by their numbers, whatever the order they are read in."""
    rows = [(k, START, k, "view", 35.0 + (k * 37 % 23) - 11) for k in range(40)]
    frame = spark.createDataFrame(rows[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    frame.repartition(3, "value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.trades, r.pf) for r in streams.QUERIES["rolling_pf_state"](spark, str(tmp_path)).collect() if 5 <= r.trades < 20)
    pnl = [r[4] - 35 for r in rows]
    want = [(n, round(sum(x for x in pnl[:n] if x > 0) / -sum(x for x in pnl[:n] if x < 0), 5)) for n in range(5, 20)]
    assert [n for n, _ in got] == [n for n, _ in want] and [p for _, p in got] == pytest.approx([p for _, p in want])


def test_bootstrap_of_few_values_shuffles_no_draws(spark):
    """A large key whose values repeat is resampled from counts of values: the figures of plain resampling, and no draws in a plan's rows."""
    rng = np.random.default_rng(4)
    pnl = np.sort(rng.integers(-20, 21, 3000) / 2.0)
    pnl -= pnl.mean().round(1)
    t = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(pnl)] + [("b", k, float(k)) for k in range(3)], "key string, n int, pnl double")
    plain = metrics.resampled_paths(pnl, 3000, rng)
    out = metrics.bootstrap(t, ["key"], ["n"], 400, group=500, draws=20_000)
    got = out.collect()
    assert [r.key for r in got] == ["a"] and got[0].replicates == 400
    for mine, want in ((got[0].mean_final, plain[:, 0]), (got[0].mean_dd, plain[:, 3])):
        assert abs(mine - want.mean()) < 4 * want.std() * (1 / 400 + 1 / 3000) ** 0.5
    assert got == metrics.bootstrap(t.repartition(3), ["key"], ["n"], 400, group=500, draws=20_000).collect()
    assert most_rows(out) <= 3_003  # the trades; draws would be 400 * 7 stretches of values
    v, c = np.array([-1.0, 2.0]), np.array([30, 20])
    stretches = np.array([metrics.path_of_counts(v, c, np.random.default_rng(k), most=7) for k in range(2000)])
    once = np.array([metrics.path_of_counts(v, c, np.random.default_rng(k)) for k in range(2000)])
    assert np.abs(stretches.mean(0) - once.mean(0)).max() < 4 * once.std(0).max() * (2 / 2000) ** 0.5


def test_neighbours_of_dense_cells_are_no_rows(spark):
    """Blocks of many pairs are compared as arrays: the counts of every pair, with weights, and no join that puts out pairs."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(0, 0.15, (1500, 2)), rng.normal(2, 1, (200, 2))])
    xy = np.concatenate([xy, xy[:50]])
    frame = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "k long, x double, y double")
    want = {k: int(((xy - p) ** 2).sum(1).__le__(0.2 * 0.2).sum()) for k, p in enumerate(xy)}
    with unittest.mock.patch.object(ml, "DENSE", 2000):
        out = ml.neighbours(frame, ["x", "y"], 0.2, "k")
        assert dict(map(tuple, out.collect())) == want
        assert most_rows(out) < 100_000  # of 500,000 pairs and more in cells that are near in part
        both = ml.dbscan_core(frame, ["x", "y"], 0.2, 4, "k")
        assert {r.k: r.neighbours for r in both.collect()} == want
