"""Batch twins of the streaming operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import series
from ..operators import regimes
from ..operators import rules
from ..sources import io
from ..streaming import stateful, windows
from .inputs import FEATURES, LABELLED, PART, TRADES, bars_sql, features, lag, stamp, stamped, table, ticks, trades, TICKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder: stamped(f(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


SIGNAL = "CASE WHEN z20 < -1 THEN 1 WHEN z20 > 1 THEN -1 ELSE 0 END"


def signals(s: SparkSession, d: str) -> DataFrame:
    out = features(s, d).withColumn("signal", rules.entry_rule({"type": "mean_reversion", "feature": "z20", "threshold": 1.0}))
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def pnl(s: SparkSession, d: str) -> DataFrame:
    return trades(s, d).select("asset", "hypothesis", F.col("hypothesis").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "pnl")


@query("stream_bars", f"WITH {TICKS}, {bars_sql()} SELECT symbol, {stamp()}, open, high, low, close, volume::BIGINT AS volume FROM bars")
def _(s, d):
    return windows.stream_bars(ticks(s, d))


@query("stream_activity", f"WITH {TRADES}, x AS (SELECT hypothesis AS symbol, pnl, unnest([0, 15, 30, 45]) AS back, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM trades) SELECT symbol, strftime(b - to_minutes(back), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS trades, round(sum(pnl), 6) + 0.0::DOUBLE AS pnl, sum((pnl > 0)::INT)::BIGINT AS wins FROM x GROUP BY 1, 2")
def _(s, d):
    return windows.stream_activity(pnl(s, d))


@query("stream_sessions", "WITH x AS (SELECT event_type AS symbol, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS f FROM events), y AS (SELECT symbol, ts, sum(f) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM x) SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS events FROM y GROUP BY symbol, k")
def _(s, d):
    return windows.stream_sessions(ticks(s, d))


@query("stream_dedup", "SELECT DISTINCT event_type AS symbol, user_id FROM events")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("symbol"), "user_id", "ts")
    return windows.stream_dedup(e, ["symbol", "user_id"]).select("symbol", "user_id")


@query("stream_danger_zone", "SELECT a.event_id AS id, 'e' || b.event_id AS title FROM events a JOIN events b ON b.ts BETWEEN a.ts - INTERVAL 1800 SECOND AND a.ts + INTERVAL 1800 SECOND WHERE a.event_type = 'purchase' AND b.event_type = 'error'")
def _(s, d):
    e = table(s, d, "events")
    cal = e.filter("event_type = 'error'").select(F.col("ts").alias("event_time"), F.concat(F.lit("e"), "event_id").alias("title"))
    return windows.stream_danger_zone(e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ts"), cal).select("id", "title")


@query("stream_outcomes", "WITH s AS (SELECT event_id AS id, event_type AS symbol, ts, value AS price, unnest([1800, 3600]) AS h FROM events) SELECT s.id, CASE h WHEN 1800 THEN '30min' ELSE '1h' END AS horizon, round((arg_min(p.value, p.ts) / nullif(any_value(s.price), 0) - 1) * 100, 6) + 0.0::DOUBLE AS outcome FROM s JOIN events p ON p.event_type = s.symbol AND p.ts >= s.ts + to_seconds(h) AND p.ts <= s.ts + to_seconds(h + 7200) GROUP BY s.id, h")
def _(s, d):
    t = ticks(s, d).withColumnRenamed("event_id", "id")
    return windows.first_outcomes(windows.stream_outcomes(t, t, {"30min": 1800, "1h": 3600}, first=True))


@query("alert_digest")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("asset"), "ts", F.when(F.col("value") > 80, "CRITICAL").when(F.col("value") > 50, "WARNING").otherwise("INFO").alias("severity"), F.concat("event_type", F.lit(" at "), F.floor("value").cast("string")).alias("message"))
    return windows.alert_digest(e)


@query("signal_changes", f"WITH {FEATURES}, x AS (SELECT *, {SIGNAL} AS signal FROM features), y AS (SELECT *, {lag('signal')} AS before FROM x) SELECT symbol, {stamp()}, signal FROM y WHERE signal <> 0 AND signal IS DISTINCT FROM before")
def _(s, d):
    return stateful.signal_changes(signals(s, d).select("symbol", "ts", "signal"))


@query("position_ledger")
def _(s, d):
    b = rules.stop_target(signals(s, d), {"sl_atr": 1.5, "tp_atr": 2.0})
    return stateful.position_ledger(b.select("symbol", "ts", "high", "low", "close", "signal", "sl", "tp"))


@query("daily_kill_switch", f"WITH {FEATURES}, x AS (SELECT *, 100 + sum(close - open) OVER ({PART}) AS equity FROM features), y AS (SELECT *, first(equity) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS st FROM x), z AS (SELECT symbol, ts, (equity - st) / st AS loss, -2.0 * (atr / 10000) / close AS f FROM y WHERE close > 0) SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM z WHERE f < 0 AND loss < f GROUP BY symbol, z.ts::DATE")
def _(s, d):
    b = signals(s, d).withColumn("equity", 100 + F.sum(F.col("close") - F.col("open")).over(series()))
    return stateful.daily_kill_switch(b.select("symbol", "ts", "equity", (F.col("atr") / 10_000).alias("atr"), "close")).select("symbol", "ts")


@query("loss_streak_alerts")
def _(s, d):
    return stateful.loss_streak_alerts(pnl(s, d).select("hypothesis", "ts", "pnl"), ["hypothesis"])


@query("regime_change_events", f"WITH {LABELLED}, x AS (SELECT *, {lag('regime')} AS before FROM labelled) SELECT symbol, {stamp()}, before AS from_regime, regime AS to_regime FROM x WHERE before <> regime")
def _(s, d):
    b = signals(s, d).withColumn("regime", regimes.regime3())
    return stateful.regime_change_events(b.select("symbol", "ts", "regime"))


@query("alert_throttle")
def _(s, d):
    p = pnl(s, d).select(F.col("asset").cast("string").alias("asset"), "hypothesis", F.lit("edge").alias("type"), F.when(F.col("pnl") > 20, "CRITICAL").otherwise("INFO").alias("severity"), "ts", (1 + F.col("pnl") / 100).alias("pf"))
    return stateful.alert_throttle(p)


@query("rolling_pf_state")
def _(s, d):
    t = trades(s, d).select(F.col("hypothesis").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "pnl")
    return stateful.rolling_pf_state(t, order=("ts", "event_id")).withColumn("pf", F.round("pf", 5))


@query("pending_resolution", f"WITH {FEATURES}, x AS (SELECT *, {SIGNAL} AS signal, lead(close, 4) OVER ({PART}) AS later, lead(ts, 4) OVER ({PART}) AS resolved FROM features) SELECT symbol, {stamp()}, {stamp('resolved')}, signal AS direction, round(signal * (later - close), 6) + 0.0::DOUBLE AS pnl FROM x WHERE signal <> 0 AND later IS NOT NULL")
def _(s, d):
    return stateful.pending_resolution(signals(s, d).select("symbol", "ts", "close", "signal"))


@query("entry_cooldown_state", f"WITH RECURSIVE {FEATURES}, e AS MATERIALIZED (SELECT symbol, ts FROM features WHERE abs(z20) > 1), r AS (SELECT symbol, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT r.symbol, (SELECT min(e.ts) FROM e WHERE e.symbol = r.symbol AND e.ts >= r.ts + INTERVAL 48 HOUR) FROM r WHERE r.ts IS NOT NULL) SELECT symbol, {stamp()} FROM r WHERE ts IS NOT NULL")
def _(s, d):
    return stateful.entry_cooldown(signals(s, d).filter("signal != 0").select("symbol", "ts"))


@query("hysteresis_stream")
def _(s, d):
    b = signals(s, d).withColumn("regime", regimes.regime3())
    return stateful.hysteresis_stream(b.select("symbol", "ts", "regime", F.least(F.lit(1.0), 0.5 + F.abs("z20") / 4).alias("confidence")))


@query("staleness_timeout")
def _(s, d):
    return stateful.staleness_timeout(ticks(s, d).select("symbol", F.col("ts").cast("timestamp").alias("ts")), 900)


@query("silences", "WITH x AS (SELECT event_type AS symbol, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS since FROM events) SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, round((epoch_us(ts) - epoch_us(since)) / 1e6, 6) + 0.0::DOUBLE AS seconds FROM x WHERE epoch_us(ts) - epoch_us(since) > 900 * 1000000")
def _(s, d):
    return stateful.silences(ticks(s, d).select("symbol", "ts"), 900)


_SESSION = "CASE WHEN hour(ts) BETWEEN 13 AND 16 THEN 'Overlap' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'NY' WHEN hour(ts) BETWEEN 8 AND 12 THEN 'London' ELSE 'Asia' END"


@query("stream_activity_by_session", f"WITH {TRADES}, x AS (SELECT hypothesis AS symbol, pnl, {_SESSION} AS session, unnest([0, 15, 30, 45]) AS back, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM trades) SELECT symbol, strftime(b - to_minutes(back), '%Y-%m-%d %H:%M:%S') AS start, session, count(*) AS trades, round(sum(pnl), 6) + 0.0::DOUBLE AS pnl, sum((pnl > 0)::INT)::BIGINT AS wins FROM x GROUP BY symbol, start, session")
def _(s, d):
    return windows.stream_activity(pnl(s, d), sessions=True)


@query("stream_first_outcomes", "WITH s AS (SELECT event_id AS id, event_type AS symbol, ts, value AS price, unnest([1800, 3600]) AS h FROM events) SELECT s.id, s.symbol, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE h WHEN 1800 THEN '30min' ELSE '1h' END AS horizon, round((arg_min(p.value, p.ts) / nullif(any_value(s.price), 0) - 1) * 100, 6) + 0.0::DOUBLE AS outcome, strftime(min(p.ts), '%Y-%m-%d %H:%M:%S') AS at FROM s LEFT JOIN events p ON p.event_type = s.symbol AND p.ts BETWEEN s.ts + to_seconds(h) AND s.ts + to_seconds(h + 900) GROUP BY s.id, s.symbol, s.ts, h")
def _(s, d):
    t = ticks(s, d).withColumnRenamed("event_id", "id")
    return windows.stream_first_outcomes(t, t, {"30min": 1800, "1h": 3600}, 900)


@query("batch_sink", "WITH x AS (SELECT event_type, user_id, min(event_id % 5) AS batch FROM events GROUP BY 1, 2) SELECT event_type, user_id, min(event_id) AS event_id FROM events JOIN x USING (event_type, user_id) WHERE event_id % 5 = x.batch GROUP BY 1, 2")
def _(s, d):
    """The events as five batches, the third twice, of which the first row of each key stays."""
    e = table(s, d, "events").select("event_type", "user_id", "event_id")
    path = io.scratch(s, "sink")
    for batch in (0, 1, 2, 2, 3, 4):
        io.write_batch(e.filter(F.col("event_id") % 5 == batch), batch, path, ["event_type", "user_id"])
    return io.read_batches(s, path, e.schema).select("event_type", "user_id", "event_id")
