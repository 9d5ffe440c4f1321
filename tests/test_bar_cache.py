"""The bar cache loads only what it lacks; the bar table needs no shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from sparkbars.operators import ewm
from sparkbars.sources import io

START = dt.datetime(2024, 1, 20)
day = lambda k: START + dt.timedelta(days=k)


def test_only_gaps_are_loaded(spark, tmp_path):
    rows = [(s, START + dt.timedelta(hours=h), float(h), 1.0, 1.0, 1.0, 1.0, "1h") for s in "AB" for h in range(24 * 30)]
    source = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, interval string")
    loads = []

    def load(gaps):
        loads.append({(r.symbol, r.start, r.end) for r in gaps.collect()})
        return source

    def ask(*ranges):
        wanted = spark.createDataFrame([(s, "1h", day(a), day(z)) for s, a, z in ranges], io.RANGES)
        return sorted((r.symbol, r.open) for r in io.cached_bars(spark, str(tmp_path), wanted, load).collect())

    hours = lambda s, a, z: [(s, float(h)) for h in range(24 * a, 24 * z)]
    assert ask(("A", 2, 4)) == hours("A", 2, 4) and loads == [{("A", day(2), day(4))}]
    assert ask(("A", 6, 8)) == hours("A", 6, 8) and len(loads) == 2
    assert ask(("A", 3, 4)) == hours("A", 3, 4) and len(loads) == 2  # a part: no load
    assert ask(("A", 0, 10), ("B", 1, 2)) == hours("A", 0, 10) + hours("B", 1, 2)
    assert loads[2:] == [{("A", day(0), day(2)), ("A", day(4), day(6)), ("A", day(8), day(10)), ("B", day(1), day(2))}]
    assert ask(("A", 1, 9)) == hours("A", 1, 9) and len(loads) == 3

    def fails(gaps):
        return source.withColumn("open", F.raise_error(F.lit("lost")).cast("double"))

    wanted = spark.createDataFrame([("B", "1h", day(0), day(5))], io.RANGES)
    try:
        io.cached_bars(spark, str(tmp_path), wanted, fails)
        raise AssertionError
    except Exception as e:
        assert "lost" in str(e)
    assert ask(("B", 0, 5)) == hours("B", 0, 5) and loads[-1] == {("B", day(0), day(1)), ("B", day(2), day(5))}
    assert ask(("C", 0, 1)) == [] and len(loads) == 5


def test_frames_over_the_bar_table_shuffle_nothing(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS bars_by_symbol")
    bars = spark.range(400).select((F.col("id") % 3).cast("string").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.rand(1).alias("close"))
    io.write_bar_table(bars, "bars_by_symbol", 4)
    try:
        table = spark.table("bars_by_symbol")
        assert "Exchange" in ewm.ewm(bars, {"e": ("close", 0.1)})._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.sources.v2.bucketing.enabled", "true")
        plan = ewm.ewm(table, {"e": ("close", 0.1)})._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and ewm.ewm(table, {"e": ("close", 0.1)}).count() == 400
    finally:
        spark.sql("DROP TABLE IF EXISTS bars_by_symbol")
