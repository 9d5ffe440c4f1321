"""First matches, silences, sessions and batches of streams that fail and come again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkbars.sources import io
from sparkbars.streaming import stateful, windows
from tests.test_operators import START, streamed

hours = lambda h: START + dt.timedelta(hours=h)


def test_first_outcomes_come_once(spark, tmp_path):
    """Each signal and horizon once: the first price at or after it, also where many are near; null where none is."""
    rng = random.Random(1)
    rows = [("A", hours(k / 4 + rng.random() / 10), k, 100 + rng.random()) for k in range(60) if k not in (20, 21, 22, 23, 24, 25, 26)]
    end = [("end", hours(60 + k), -1 - k, 1.0) for k in range(3)]
    frame = spark.createDataFrame(rows + end, "symbol string, ts timestamp, id int, price double")
    f = lambda s: windows.stream_first_outcomes(s, s, {"30min": 1800, "1h": 3600}, 1800)
    got = streamed(spark, frame, f, tmp_path, files=5).filter("symbol = 'A'").collect()
    want = {}
    for _, t, i, p in rows:
        for h, s in (("30min", 1800), ("1h", 3600)):
            later = [(u, q) for _, u, _, q in rows if t + dt.timedelta(seconds=s) <= u <= t + dt.timedelta(seconds=s + 1800)]
            want[i, h] = (min(later)[1] / p - 1) * 100 if later else None
    assert len(got) == len(want) == 2 * len(rows)
    assert {(r.id, r.horizon): r.outcome for r in got} == pytest.approx(want) and None in want.values()
    batch = {(r.id, r.horizon): r.outcome for r in f(frame).filter("symbol = 'A'").collect()}
    assert batch == pytest.approx(want)


def test_silence_is_told_again_after_the_cooldown(spark, tmp_path):
    rows = [("A", hours(0)), ("A", hours(0.2)), ("B", hours(0.3)), *(("C", hours(k / 5)) for k in range(80))]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp")
    f = lambda cooldown: lambda s: stateful.staleness_timeout(s.withWatermark("ts", "1 minute"), 1800, cooldown)
    once = streamed(spark, frame, f(0), tmp_path / "a", files=40).collect()
    assert sorted((r.symbol, r.last) for r in once if r.symbol != "C") == [("A", hours(0.2)), ("B", hours(0.3))]
    again = [r for r in streamed(spark, frame, f(3600), tmp_path / "b", files=40).collect() if r.symbol == "A"]
    assert len(again) > 5 and {r.last for r in again} == {hours(0.2)}
    silent = sorted(r.silent_for for r in again)
    assert silent[0] == 1800 and all(b - a > 3600 - 1 for a, b in zip(silent, silent[1:]))


def test_silences(spark, tmp_path):
    rows = [("A", hours(h)) for h in (0, 0.1, 1, 1.1, 5)] + [("B", hours(2)), ("end", hours(90)), ("end", hours(91))]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp")
    want = [("A", hours(1), hours(0.1), 3240.0), ("A", hours(5), hours(1.1), 14040.0)]
    assert sorted(tuple(r) for r in stateful.silences(frame).filter("symbol = 'A'").collect()) == want
    got = streamed(spark, frame, lambda s: stateful.silences(s, late="10 minutes"), tmp_path).filter("symbol = 'A'")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_state_goes_after_silence(spark, tmp_path):
    """A key's count begins anew when it was silent for longer than ``idle``; stretches of late rows don't hold it."""
    rows = [("A", hours(h)) for h in (0, 1, 2, 100, 101)] + [("B", hours(h)) for h in (0, 50, 102, 150, 200, 201)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp")
    step = lambda state, r: ({"n": state.get("n", 0) + 1}, [(r["ts"], state.get("n", 0) + 1)])
    got = streamed(spark, frame, lambda s: stateful.run(s, ["symbol"], step, "ts timestamp, n int", "n int", late="10 minutes", idle=36 * 3600), tmp_path, files=11)
    assert {(r.symbol, r.ts): r.n for r in got.collect() if r.symbol == "A"} == {("A", hours(h)): n for h, n in ((0, 1), (1, 2), (2, 3), (100, 1), (101, 2))}


def test_activity_of_sessions(spark):
    rows = [("A", hours(h), p) for h, p in ((12.9, 1.0), (13.1, -1.0), (13.2, 2.0))]
    out = windows.stream_activity(spark.createDataFrame(rows, "symbol string, ts timestamp, pnl double"), sessions=True).filter(F.col("start") == hours(12.5)).collect()
    assert {(r.session, r.trades, r.wins) for r in out} == {("London", 1, 1), ("Overlap", 2, 1)}


@pytest.mark.parametrize("upsert", [False, True])
def test_a_batch_that_fails_half_way_counts_once(spark, tmp_path, upsert, monkeypatch):
    kind = "k string, n int, v int"
    batches = [[("a", 1, 1), ("b", 1, 2), ("a", 1, 0)], [("a", 1, 9), ("c", 2, 3), (None, 1, 4)], [("c", 2, 7), (None, 1, 8), ("d", 1, 1)]]
    frames = [spark.createDataFrame(b, kind) for b in batches]
    path = str(tmp_path / "sink")
    sink = io.batch_sink(path, ["k", "n"], upsert, buckets=4)
    sink(frames[0], 0)
    read = lambda: sorted((io.latest_rows if upsert else lambda s, p, c, _: io.read_batches(s, p, c).select("k", "n", "v"))(spark, path, frames[0].schema, ["k", "n"]).collect(), key=str)
    first = read()
    assert [tuple(r) for r in first] == [("a", 1, 0), ("b", 1, 2)]

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # between write and commit
        m.setattr(io, "commit_batch", broken)
        with pytest.raises(OSError):
            sink(frames[1], 1)
    assert read() == first
    for batch in (1, 1, 2, 2, 1):
        sink(frames[batch], batch)
    want = {"a": 9 if upsert else 0, "b": 2, "c": 7 if upsert else 3, None: 8 if upsert else 4, "d": 1}
    assert {r.k: r.v for r in read()} == want and len(read()) == 5


def test_a_stream_into_the_sink(spark, tmp_path):
    rows = [(k % 7, k) for k in range(40)]
    frame = spark.createDataFrame(rows, "k int, v int")
    for n in range(4):
        frame.filter(F.col("v") % 4 == n).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    start = lambda: source.writeStream.foreachBatch(io.batch_sink(f"{tmp_path}/out", ["k"])).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    start()
    start()
    out = io.read_batches(spark, f"{tmp_path}/out", frame.schema)
    assert sorted(r.k for r in out.collect()) == list(range(7)) and io.committed_batches(spark, f"{tmp_path}/out") == [0, 1, 2, 3]
    plan = io.read_batches(spark, f"{tmp_path}/out", frame.schema).filter("_bucket IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket#", "_bucket#") or "_bucket" in plan.split("PartitionFilters")[1][:200]
