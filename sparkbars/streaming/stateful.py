"""Streams with a state of their own for each key.

A handler is one function of (state, row) to (state, rows out). Over a stream the state is a typed value in RocksDB. With ``late``,
a stream's rows wait in a map by stretch of event time; a timer at each stretch's end takes its rows in order of their times, as a
finished table's are, once the watermark has passed it. So a batch reads and writes the stretches it has rows for, and no more. A
key that is silent for ``idle`` seconds beyond its last row loses its state, by a timer too. Without ``late`` rows are taken as they
come.

Over a finished table, handlers that only look back by a row, a run or a frame are windows, with no Python; the others
run the same function over stretches of a key after which nothing of the state before matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.factors import profit_factor_over
from ..functions.frames import last_rows, series, so_far, yes
from ..operators.blocks import lagged, running, running_last, since
from ..operators.engines import cooldown
from ..operators.regimes import hysteresis

#: (state, row as a dict) to (new state, rows as tuples without the key)
Step = Callable[[dict, dict], tuple[dict, list[tuple]]]
#: Seconds of silence after which a key's state goes, and of a stretch of waiting rows.
IDLE, STRETCH = 30 * 86_400, 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_states(spark: SparkSession) -> None:
    """Typed states need the RocksDB store; a session that has chosen another of its own keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, ROCKSDB)


class Handler(StatefulProcessor):
    """Runs a step over a stream's keys. columns: of the rows; state, names: columns of the state and of what comes out."""

    def __init__(self, keys: list[str], columns: T.StructType, step: Step, state: T.StructType, names: list[str], at: str, ordered: bool, idle: int, stretch: int):
        self.keys, self.columns, self.step, self.state, self.names, self.at, self.ordered, self.idle, self.stretch = keys, columns, step, state, names, at, ordered, idle, stretch

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("state", self.state)
        if self.ordered:
            self.last = handle.getValueState("last", "ms long")
            self.waiting = handle.getMapState("waiting", "stretch long", T.StructType([T.StructField("rows", T.ArrayType(self.columns))]))

    def _walk(self, key: tuple, rows: list[dict]) -> pd.DataFrame:
        state = dict(zip(self.state.names, self.kept.get())) if self.kept.exists() else {}
        before, out = dict(state), []
        for r in rows:
            state, new = self.step(state, r)
            out += [(*key, *x) for x in new]
        if state and state != before:
            self.kept.update(tuple(state.get(c) for c in self.state.names))
        elif not state and before:
            self.kept.clear()
        return pd.DataFrame(out, columns=self.names)

    def _stretch_of(self, x) -> int:
        return int(pd.Timestamp(x).timestamp() // self.stretch)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken = [r for pdf in rows for r in pdf[self.columns.names].astype(object).where(pdf[self.columns.names].notna(), None).to_dict("records")]
        if not self.ordered:
            yield self._walk(key, sorted(taken, key=lambda r: r[self.at]))
            return
        by: dict[int, list[dict]] = {}
        for r in taken:
            by.setdefault(self._stretch_of(r[self.at]), []).append(r)
        plain = lambda r: tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in (r[c] for c in self.columns.names))
        for n, new in by.items():
            old = [tuple(r) for r in self.waiting.getValue((n,))[0]] if self.waiting.containsKey((n,)) else []
            if not old:
                self.handle.registerTimer((n + 1) * self.stretch * 1000)
            self.waiting.updateValue((n,), ([*old, *map(plain, new)],))
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        n = end // (self.stretch * 1000) - 1
        if end % (self.stretch * 1000) == 0 and self.waiting.containsKey((n,)):
            rows = [dict(zip(self.columns.names, r)) for r in self.waiting.getValue((n,))[0]]
            self.waiting.removeKey((n,))
            rows = [{c: pd.Timestamp(v) if hasattr(v, "isoformat") else v for c, v in r.items()} for r in rows]
            yield self._walk(key, sorted(rows, key=lambda r: r[self.at]))
            if self.last.exists():
                self.handle.deleteTimer(self.last.get()[0] + self.idle * 1000 + 1)
            ms = int(max(r[self.at] for r in rows).timestamp() * 1000)
            self.last.update((ms,))
            self.handle.registerTimer(ms + self.idle * 1000 + 1)
        elif self.last.exists() and end >= self.last.get()[0] + self.idle * 1000:
            self.kept.clear()
            self.last.clear()

    def close(self) -> None:
        pass


def run(df: DataFrame, keys: Sequence[str], step: Step, out: str, state: str, at: str = "ts", late: str | None = None, idle: int = IDLE, stretch: int = STRETCH) -> DataFrame:
    """out, state: the output columns (without the keys) and those of the state as DDL. late: how far rows of a stream may
    come after their time; stretch: seconds of event time whose rows wait together."""
    keys = list(keys)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + out
    names = [*keys, *T._parse_datatype_string(out).names]

    if not df.isStreaming:  # a stretch begins without a state
        own = [*keys, *(["_stretch"] if "_stretch" in df.columns else [])]
        columns = [*own, *(c for c in df.columns if c not in own)]
        whole = [k for k in keys if isinstance(df.schema[k].dataType, T.IntegralType)]  # text on the way: pandas has no missing integers

        def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, now = None, {}
            for pdf in parts:
                rows = []
                for values in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in columns)):
                    if values[: len(own)] != last:
                        last, now = values[: len(own)], {}
                    now, new = step(now, dict(zip(columns, values)))
                    rows += [(*values[: len(keys)], *x) for x in new]
                yield pd.DataFrame(rows, columns=names)

        # stretches are many and short: a task has its own one after another, in one pass over its sorted rows
        rows = df.select(*(F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in columns))
        there = ", ".join(f"{k} {'string' if k in whole else kinds[k]}" for k in keys) + ", " + out
        walked = rows.repartition(*own).sortWithinPartitions(*own, at).mapInPandas(walk, there)
        return walked.select(*(F.col(c).cast(kinds[c]).alias(c) if c in whole else F.col(c) for c in names))

    typed_states(df.sparkSession)
    columns = T.StructType([f for f in df.schema.fields if f.name not in keys])
    handler = Handler(keys, columns, step, T._parse_datatype_string(state), names, at, late is not None, idle, stretch)
    marked = df.withWatermark(at, late) if late else df
    return marked.groupBy(*keys).transformWithStateInPandas(handler, schema, "append", "EventTime" if late else "None")


def _seconds(ts) -> float:
    return pd.Timestamp(ts).timestamp()


def signal_changes(df: DataFrame, late: str | None = None) -> DataFrame:
    """(symbol, ts, signal): only where the signal is not zero and differs from the one before."""
    if not df.isStreaming:
        changed = ~F.col("signal").eqNullSafe(F.lag("signal").over(series()))
        return df.withColumn("_new", changed).filter("_new AND signal != 0").select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("signal").cast("int").alias("signal"))

    def step(state, r):
        new = [(r["ts"], int(r["signal"]))] if r["signal"] and r["signal"] != state.get("last") else []
        return {"last": None if r["signal"] is None else int(r["signal"])}, new

    return run(df, ["symbol"], step, "ts timestamp, signal int", "last int", late=late)


def position_ledger(df: DataFrame, commission: float = 0.001, late: str | None = None) -> DataFrame:
    """(symbol, ts, high, low, close, signal, sl, tp) to closed trades: one position a symbol; the stop is tested before the
    target, on bars after the entry; the same side is ignored, the other side closes and opens."""

    def step(state, r):
        out, side = [], state.get("side", 0)

        def close(price, reason):
            e = state["entry"]
            out.append((pd.Timestamp(state["at"]), r["ts"], side, e, price, side * (price - e) - commission * (price + e), reason))

        if side:
            stop, goal = state["sl"], state["tp"]
            if stop is not None and (r["low"] <= stop if side > 0 else r["high"] >= stop):
                close(stop, "SL")
                side, state = 0, {}
            elif goal is not None and (r["high"] >= goal if side > 0 else r["low"] <= goal):
                close(goal, "TP")
                side, state = 0, {}
        s = int(r["signal"] or 0)
        if s and s != side:
            if side:
                close(r["close"], "REVERSED")
            state = {"side": s, "entry": r["close"], "at": str(r["ts"]), "sl": r["sl"], "tp": r["tp"]}
        return state, out

    if not df.isStreaming:
        # a signal that differs from the one before it (not counting zeros) surely opens a position there, whatever was open: a
        # stretch begins with it, and ends with the next such row, which may still close what the stretch has open
        side = F.when(F.col("signal") != 0, F.signum(F.col("signal").cast("double")))
        df = running_last(df, {"_side": side}, "symbol", "ts", until_before=True)
        df = df.withColumn("_turn", yes(F.col("signal") != 0) & ~side.eqNullSafe(F.col("_side")))
        df = running(df, "symbol", "ts", sums={"_turns": F.col("_turn").cast("int")})
        df = df.withColumn("_stretch", F.explode(F.when(F.col("_turn"), F.array("_turns", F.col("_turns") - 1)).otherwise(F.array("_turns")))).filter("_stretch > 0").drop("_side", "_turn", "_turns")
    return run(df, ["symbol"], step, "entry_time timestamp, exit_time timestamp, direction int, entry_price double, exit_price double, pnl double, reason string", "side int, entry double, at string, sl double, tp double", late=late)


def daily_kill_switch(df: DataFrame, factor: float = 2.0, late: str | None = None) -> DataFrame:
    """(symbol, ts, equity, atr, close): trips once a day when the day's loss, as a share, is beyond so many ATRs of the
    close; off again on the next UTC day."""
    if not df.isStreaming:
        day = ["symbol", "_day"]
        out = df.withColumn("_day", F.to_date("ts")).withColumn("_start", F.first("equity").over(so_far(day)))
        loss = F.coalesce((F.col("equity") - F.col("_start")) / F.nullif("_start", F.lit(0.0)), F.lit(0.0))
        floor = F.coalesce(-factor * F.coalesce("atr", F.lit(0.0)) / F.nullif("close", F.lit(0.0)), F.lit(0.0))
        out = out.withColumn("loss", loss).withColumn("floor", floor).filter("floor < 0 AND loss < floor")
        return out.withColumn("_n", F.row_number().over(series(day))).filter("_n = 1").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "loss", "floor")

    def step(state, r):
        day = str(r["ts"])[:10]
        if state.get("day") != day:
            state = {"day": day, "start": r["equity"], "off": False}
        loss = (r["equity"] - state["start"]) / state["start"] if state["start"] else 0.0
        limit = -factor * (r["atr"] or 0.0) / r["close"] if r["close"] else 0.0
        out = []
        if not state["off"] and limit < 0 and loss < limit:
            state["off"] = True
            out.append((r["ts"], loss, limit))
        return state, out

    return run(df, ["symbol"], step, "ts timestamp, loss double, floor double", "day string, start double, off boolean", late=late)


def loss_streak_alerts(df: DataFrame, keys: Sequence[str] = ("asset", "hypothesis"), late: str | None = None) -> DataFrame:
    """Alerts at a depth of 2 and each even depth, critical from 5 on; an event when the streak ends."""
    if not df.isStreaming:
        rows = df.withColumn("_lost", yes(F.col("pnl") < 0))
        out = since(rows, ~F.col("_lost"), keys, "ts", "_n", "_before")
        level = F.when(F.col("_lost") & (F.col("_n") >= 5), "CRITICAL").when(F.col("_lost") & (F.col("_n") % 2 == 0), "WARNING").when(~F.col("_lost") & (F.col("_before") >= 2), "RECOVERED")
        return out.select(*keys, F.col("ts").cast("timestamp").alias("ts"), level.alias("severity"), F.when(F.col("_lost"), F.col("_n")).otherwise(F.col("_before")).cast("int").alias("depth")).filter("severity IS NOT NULL")

    def step(state, r):
        n, out = state.get("n", 0), []
        if r["pnl"] is not None and r["pnl"] < 0:
            n += 1
            if n >= 5 or n % 2 == 0:
                out.append((r["ts"], "CRITICAL" if n >= 5 else "WARNING", n))
        elif n >= 2:
            out.append((r["ts"], "RECOVERED", n))
            n = 0
        else:
            n = 0
        return {"n": n}, out

    return run(df, keys, step, "ts timestamp, severity string, depth int", "n int", late=late)


def regime_change_events(df: DataFrame, risks: DataFrame | None = None, late: str | None = None) -> DataFrame:
    """(symbol, ts, regime) to (from, to) at each change; risks: ``from_regime``, ``to_regime``, ``risk``, joined."""

    def step(state, r):
        last = state.get("regime")
        return {"regime": r["regime"]}, [(r["ts"], last, r["regime"])] if last is not None and last != r["regime"] else []

    if df.isStreaming:
        out = run(df, ["symbol"], step, "ts timestamp, from_regime string, to_regime string", "regime string", late=late)
    else:
        out = df.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lag("regime").over(series()).alias("from_regime"), F.col("regime").alias("to_regime")).filter("from_regime IS NOT NULL AND NOT from_regime <=> to_regime")
    return out.join(risks, ["from_regime", "to_regime"], "left") if risks is not None else out


#: Hours between alerts of one kind, by severity.
COOLDOWN_HOURS = {"INFO": 12, "WARNING": 4, "CRITICAL": 2}


def alert_throttle(df: DataFrame, worse: float = 0.15, late: str | None = None) -> DataFrame:
    """(asset, hypothesis, type, severity, ts, pf) to those that are sent: the first, those after the cooldown, and any
    whose profit factor fell by more than ``worse`` of the last one sent. Only sent ones count."""

    def step(state, r):
        hours = COOLDOWN_HOURS.get(r["severity"], 12)
        last, pf = state.get("pf"), r["pf"]
        fell = last is not None and pf is not None and last > 0 and (last - pf) / last > worse
        if not state or fell or _seconds(r["ts"]) - state["at"] >= hours * 3600:
            return {"at": _seconds(r["ts"]), "pf": pf}, [(r["ts"], pf)]
        return state, []

    keys = ["asset", "hypothesis", "type", "severity"]
    if not df.isStreaming:  # after a silence as long as the cooldown an alert is sent in any case
        hours = F.coalesce(*(F.when(F.col("severity") == x, F.lit(h)) for x, h in COOLDOWN_HOURS.items()), F.lit(12))
        df = lagged(df, {"_before": F.col("ts")}, keys, "ts")
        silent = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) >= hours * 3_600_000_000
        df = running(df, keys, "ts", sums={"_stretch": yes(silent).cast("int")}).drop("_before", "_first")
    return run(df, keys, step, "ts timestamp, pf double", "at double, pf double", late=late)


def rolling_pf_state(df: DataFrame, keys: Sequence[str] = ("symbol",), n: int = 20, least: int = 5, alert: int = 10, late: str | None = None, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Profit factor of the last n trades at each trade: null under ``least``; alert below 1 from ``alert`` trades on. order: of a
    finished table, by which trades of the same time follow one another."""

    def step(state, r):
        last = [*(state.get("last") or []), r["pnl"]][-n:]
        won, lost = sum(x for x in last if x > 0), -sum(x for x in last if x < 0)
        pf = (won / lost if lost > 0 else None) if len(last) >= least else None
        return {"last": last}, [(r["ts"], len(last), pf, bool(pf is not None and pf < 1 and len(last) >= alert))]

    df = df.filter("pnl IS NOT NULL")
    if not df.isStreaming:
        w = last_rows(n, keys, order)
        out = df.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.count(F.lit(1)).over(w).cast("int").alias("trades"), profit_factor_over(F.col("pnl"), w, "null").alias("pf"))
        return out.withColumn("pf", F.when(F.col("trades") >= least, F.col("pf"))).withColumn("alert", yes((F.col("pf") < 1) & (F.col("trades") >= alert)))
    return run(df, keys, step, "ts timestamp, trades int, pf double, alert boolean", "last array<double>", late=late)


def pending_resolution(df: DataFrame, n: int = 4, late: str | None = None) -> DataFrame:
    """(symbol, ts, close, signal): each signal's result n bars later; what is pending at the end stays so."""
    if not df.isStreaming:
        w = series()
        out = df.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lead("ts", n).over(w).cast("timestamp").alias("resolved"), F.col("signal").cast("int").alias("direction"), (F.col("signal") * (F.lead("close", n).over(w) - F.col("close"))).alias("pnl"))
        return out.filter("direction != 0 AND resolved IS NOT NULL")

    def step(state, r):
        waiting, out = [], []
        for at, side, price, left in (w.values() if isinstance(w, dict) else w for w in state.get("waiting") or []):
            if left == 1:
                out.append((pd.Timestamp(at), r["ts"], side, side * (r["close"] - price)))
            else:
                waiting.append((at, side, price, left - 1))
        if r["signal"]:
            waiting.append((str(r["ts"]), int(r["signal"]), r["close"], n))
        return {"waiting": waiting}, out

    return run(df, ["symbol"], step, "ts timestamp, resolved timestamp, direction int, pnl double", "waiting array<struct<at:string,side:int,price:double,left:int>>", late=late)


def entry_cooldown(df: DataFrame, seconds: int = 48 * 3600, late: str | None = None) -> DataFrame:
    if not df.isStreaming:
        return cooldown(df.select("symbol", F.col("ts").cast("timestamp").alias("ts")), seconds)

    def step(state, r):
        now = _seconds(r["ts"])
        if state and now - state["at"] < seconds:
            return state, []
        return {"at": now}, [(r["ts"],)]

    return run(df, ["symbol"], step, "ts timestamp", "at double", late=late)


def hysteresis_stream(df: DataFrame, bars: int = 3, least: float = 0.55, late: str | None = None) -> DataFrame:
    """(symbol, ts, regime, confidence): a new regime counts after so many confident bars in a row."""
    if not df.isStreaming:
        return hysteresis(df, "regime", "confidence", bars, least).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "regime_final")

    def step(state, r):
        now, pending, n = state.get("now"), state.get("pending"), state.get("n", 0)
        x, c = r["regime"], r["confidence"]
        if now is None:
            now = x
        elif c is None or c < least or x == now:
            pending, n = None, 0
        else:
            n = n + 1 if x == pending else 1
            pending = x
            if n >= bars:
                now, pending, n = x, None, 0
        return {"now": now, "pending": pending, "n": n}, [(r["ts"], now)]

    return run(df, ["symbol"], step, "ts timestamp, regime_final string", "now string, pending string, n int", late=late)


class Silence(StatefulProcessor):
    """The last row of each key, and a timer that speaks when it has been silent for so long, at most once in a cooldown."""

    def __init__(self, key: str, at: str, seconds: int, cooldown: int):
        self.key, self.at, self.seconds, self.cooldown = key, at, seconds, cooldown

    def init(self, handle) -> None:
        self.handle = handle
        self.seen, self.said = handle.getValueState("seen", "us long"), handle.getValueState("said", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = max(int(round(pdf[self.at].max().timestamp() * 1e6)) for pdf in rows)
        old = self.seen.get()[0] if self.seen.exists() else None
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old // 1000 + self.seconds * 1000)
            self.seen.update((new,))
            self.handle.registerTimer(new // 1000 + self.seconds * 1000)
        yield pd.DataFrame([], columns=[self.key, "last", "silent_for"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, last = expiredTimerInfo.getExpiryTimeInMs(), self.seen.get()[0]
        if now < last // 1000 + self.seconds * 1000:
            return
        if not self.cooldown or not self.said.exists() or now - self.said.get()[0] > self.cooldown * 1000:
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="us"), (now - last // 1000) // 1000)], columns=[self.key, "last", "silent_for"])
            self.said.update((now,))
        if self.cooldown:  # while it stays silent it is told again
            self.handle.registerTimer(now + self.cooldown * 1000 + 1)

    def close(self) -> None:
        pass


def staleness_timeout(df: DataFrame, seconds: int = 1800, cooldown: int = 0) -> DataFrame:
    """(symbol, ts), a stream with a watermark: a row when a key has been silent for so long, by event time. With a cooldown
    it is told again, while the silence lasts, each time that the cooldown is over, and no two alerts of a key are nearer. On a
    finished table: a row for each gap."""
    if not df.isStreaming:
        gap = F.unix_micros("ts") - F.unix_micros("last")
        rows = lagged(df.select("symbol", F.col("ts").cast("timestamp").alias("ts")), {"last": F.col("ts")}, "symbol", "ts")
        return rows.filter(gap > seconds * 1_000_000).select("symbol", "last", F.floor(gap / 1_000_000).alias("silent_for"))
    typed_states(df.sparkSession)
    return df.groupBy("symbol").transformWithStateInPandas(Silence("symbol", "ts", seconds, cooldown), "symbol string, last timestamp, silent_for long", "append", "EventTime")


def silences(df: DataFrame, seconds: int = 600, late: str | None = None) -> DataFrame:
    """(symbol, ts) to (symbol, ts, since, seconds): each row that ends a silence of more than so many seconds, and its length."""
    if not df.isStreaming:
        rows = lagged(df.select("symbol", F.col("ts").cast("timestamp").alias("ts")), {"since": F.col("ts")}, "symbol", "ts")
        gap = (F.unix_micros("ts") - F.unix_micros("since")) / 1e6
        return rows.filter(gap > seconds).select("symbol", "ts", "since", gap.alias("seconds"))

    def step(state, r):
        last, now = state.get("last"), _seconds(r["ts"])
        new = [(r["ts"], pd.Timestamp(round(last * 1e6), unit="us"), round(now - last, 6))] if last is not None and now - last > seconds else []
        return {"last": now}, new

    return run(df, ["symbol"], step, "ts timestamp, since timestamp, seconds double", "last double", late=late)
