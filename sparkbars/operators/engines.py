"""Sequential trade engines: one position at a time. Work is dealt by key and cell or stretch; only scans are Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import series, yes
from ..sources.io import settled
from . import blocks
from .joins import resolve_barriers


def greedy(entries: np.ndarray, exits: np.ndarray, free: int | None = None) -> np.ndarray:
    """Of candidate trades by entry, those that begin after the one before has ended, the first after ``free``."""
    keep, nexts = np.zeros(len(entries), bool), np.searchsorted(entries, exits, "right")
    k = 0 if free is None else int(np.searchsorted(entries, free, "right"))
    while k < len(entries):
        keep[k] = True
        k = max(int(nexts[k]), k + 1)
    return keep


def chain_ends(entries: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """The last exit of the chain of trades that begins with each candidate."""
    nexts, out = np.maximum(np.searchsorted(entries, exits, "right"), np.arange(1, len(entries) + 1)).tolist(), exits.tolist()
    for k in range(len(out) - 1, -1, -1):
        if nexts[k] < len(out):
            out[k] = out[nexts[k]]
    return np.array(out, np.int64)


def without_overlaps(trades: DataFrame, keys: Sequence[str], entry: str, exit_: str, width: float | None = None, reach: int | None = None) -> DataFrame:
    """Of a key's candidates, one at a time: each begins after the exit of the one kept before.

    By cells of the entry. What a cell does depends on the exit that is open when it begins, which lies no further than the
    furthest exit of earlier candidates (``reach`` after the cell's begin, where that is known: the longest trade); so a cell gives, for its entries up to there, where the chain from each would end.
    A walk over these lists, cell by cell, tells each cell its open exit, and cells then choose on their own. trades: read three
    times, so best a written table. Entries and exits are whole numbers or timestamps, no nulls. Of equal entries one is kept."""
    keys = list(keys)
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if trades.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("long")
    rows = blocks.in_cells(trades, entry, width).withColumn("_a", number(entry)).withColumn("_b", number(exit_))
    kinds = dict(rows.dtypes)
    named = "".join(f"{k} {kinds[k]}, " for k in keys)
    narrow = rows.select(*keys, "_cell", "_a", "_b")
    if reach is None:
        cells = blocks.cells_of(rows, keys, _far=F.max("_b")).withColumn("_limit", F.max("_far").over(blocks.earlier(keys)))
        narrow = blocks.with_borders(narrow, cells, keys, "_limit")
    else:
        unit = 1e6 * (width or blocks.SECONDS) if trades.schema[entry].dataType.typeName().startswith("timestamp") else width or blocks.UNITS
        narrow = narrow.withColumn("_limit", F.ceil(F.col("_cell") * F.lit(unit)) + F.lit(reach))

    def ends(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_a", "_b"])
        a, b, limit = pdf["_a"].to_numpy("int64"), pdf["_b"].to_numpy("int64"), pdf["_limit"].iloc[0]
        n = 1 if pd.isna(limit) else min(len(a), int(np.searchsorted(a, int(limit), "right")) + 1)
        out = chain_ends(a, b)[:n]
        keep = np.r_[out[1:] != out[:-1], True]  # of starts with one end the last
        return pd.DataFrame([(*key, a[:n][keep], out[keep])], columns=[*keys, "_cell", "_starts", "_ends"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_cell")
        free, open_ = None, []
        for starts, last in zip(pdf["_starts"], pdf["_ends"]):
            open_.append(free)
            k = 0 if free is None else int(np.searchsorted(starts, free, "right"))
            free = int(last[k]) if k < len(last) else free
        return pdf[[*keys, "_cell"]].assign(_free=pd.array(open_, "Int64"))

    lists = narrow.groupBy(*keys, "_cell").applyInPandas(ends, f"{named}_cell long, _starts array<long>, _ends array<long>")
    free = lists.groupBy(*keys).applyInPandas(walk, f"{named}_cell long, _free long") if keys else lists.groupBy(F.lit(1)).applyInPandas(walk, "_cell long, _free long")
    schema = trades.schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_a", "_b"], kind="stable")
        free = pdf["_free"].iloc[0]
        return pdf[greedy(pdf["_a"].to_numpy("int64"), pdf["_b"].to_numpy("int64"), None if pd.isna(free) else int(free))][schema.names]

    return blocks.with_borders(rows, free, keys, "_free").groupBy(*keys, "_cell").applyInPandas(choose, schema)


def sequential_trades_by_rule(bars: DataFrame, rules: Mapping[str, tuple[str, Mapping[str, float]]], max_bars: int = 48) -> DataFrame:
    """Trades that don't overlap, of each symbol and rule (name: signal column, exits in ATRs).

    A signal on a bar enters at the next one's open, with that bar's ATR; exits are tested from the bar after entry, the
    stop first; after ``max_bars`` it closes at the close; a bar that closes a trade opens none; a trade that is open at
    the end is dropped. All rules share the bars: only signal rows are multiplied, their exits come from one bounded
    join, and what drops overlaps sees signal rows alone, by cells of bars.
    """
    w = series("symbol", "ts")
    before = {"_a": F.lag("atr").over(w), "_r": F.lag("regime").over(w) if "regime" in bars.columns else F.lit(None).cast("string")}
    signals = {f"_s{k}": F.lag(signal).over(w) for k, (signal, _) in enumerate(rules.values())}
    b = bars.select("symbol", "ts", "open", "high", "low", "close", (F.row_number().over(w) - 1).alias("idx"), *(c.alias(n) for n, c in (before | signals).items()))
    every = F.array(*(F.struct(F.lit(name).alias("hypothesis"), F.col(s).alias("direction"), F.lit(float(x["sl_atr"])).alias("_sl"), F.lit(float(x["tp_atr"])).alias("_tp")) for (name, (_, x)), s in zip(rules.items(), signals)))
    t = b.filter("_a > 0").select("symbol", F.col("ts").alias("entry_time"), F.col("idx").alias("entry_idx"), F.col("open").alias("entry_price"), "_a", F.col("_r").alias("regime"), F.explode(every).alias("_e")).select("*", "_e.*").filter("direction != 0")
    move = F.col("direction") * F.col("_a")
    t = t.withColumn("sl", F.col("entry_price") - move * F.col("_sl")).withColumn("tp", F.col("entry_price") + move * F.col("_tp")).withColumn("trade_id", F.concat_ws("|", "hypothesis", "entry_idx")).drop("_a", "_e", "_sl", "_tp")
    met = resolve_barriers(t, b.select("symbol", "idx", "high", "low", "close"), max_bars)
    met = met.filter((F.col("outcome") != "TIMEOUT") | (F.col("exit_idx") - F.col("entry_idx") >= max_bars)).withColumn("pnl", F.col("direction") * (F.col("exit_price") - F.col("entry_price")))

    return without_overlaps(settled(met, "candidates"), ["symbol", "hypothesis"], "entry_idx", "exit_idx", reach=max_bars).withColumn("bars_held", F.col("exit_idx") - F.col("entry_idx"))


def sequential_trades(bars: DataFrame, exits: Mapping[str, float], max_bars: int = 48, signal: str = "signal") -> DataFrame:
    """The same for one rule."""
    return sequential_trades_by_rule(bars, {"rule": (signal, exits)}, max_bars).drop("hypothesis")


def _first(hit, begin: int, end: int, width: int = 64) -> int:
    """The first place from ``begin`` where ``hit(a, b)``, an array for that stretch, holds; -1 if none. Stretches double."""
    while begin < end:
        stop = min(end, begin + width)
        found = np.flatnonzero(hit(begin, stop))
        if len(found):
            return begin + int(found[0])
        begin, width = stop, 2 * width
    return -1


def close_only_scan(close: np.ndarray, signal: np.ndarray, atr: np.ndarray, sl: float, tp: float, capital: float, part: float) -> list[tuple]:
    """(entry, exit, direction, entry price, exit price, pnl, reason) on closes: stop, target, or the previous bar's
    opposite signal; then the same bar may enter by the previous bar's signal. Profits compound. The scan goes from entry
    to exit and from there to the next signal; bars between are compared as arrays."""
    out: list[tuple] = []
    entries = np.flatnonzero((signal[:-1] != 0) & (atr[1:] > 0)) + 1
    i = 0
    while (k := np.searchsorted(entries, i)) < len(entries):
        at = int(entries[k])
        side, entry = int(signal[at - 1]), close[at]
        stop, goal = entry - side * sl * atr[at], entry + side * tp * atr[at]
        left = _first(lambda a, b: (side * (close[a:b] - stop) <= 0) | (side * (close[a:b] - goal) >= 0) | (signal[a - 1 : b - 1] == -side), at + 1, len(close))  # noqa: B023
        if left < 0:
            break
        c = close[left]
        reason = "SL" if side * (c - stop) <= 0 else "TP" if side * (c - goal) >= 0 else "OPPOSITE"
        pnl = side * (c - entry) / entry * capital * part
        capital += pnl
        out.append((at, left, side, entry, c, pnl, reason))
        i = left
    return out


def close_only_trades(bars: DataFrame, sl: float = 2.5, tp: float = 4.0, capital: float = 10_000.0, part: float = 0.1, keys: Sequence[str] = ("symbol",), signal: str = "signal") -> DataFrame:
    key = list(keys)
    params = {"sl_mult", "tp_mult"} <= set(bars.columns)
    rows = bars.select(*key, "ts", "close", "atr", F.col(signal).alias("_s"), *(("sl_mult", "tp_mult") if params else ())).na.drop()
    kinds = dict(rows.dtypes)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        a, b = (float(pdf["sl_mult"].iloc[0]), float(pdf["tp_mult"].iloc[0])) if params else (sl, tp)
        got = close_only_scan(pdf["close"].to_numpy(float), pdf["_s"].to_numpy(int), pdf["atr"].to_numpy(float), a, b, capital, part)
        out = pd.DataFrame(got, columns=["entry_idx", "exit_idx", "direction", "entry_price", "exit_price", "pnl", "reason"])
        for k in reversed(key):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*key).applyInPandas(scan, ", ".join(f"{k} {kinds[k]}" for k in key) + ", entry_idx long, exit_idx long, direction int, entry_price double, exit_price double, pnl double, reason string")


def close_only_grid(bars: DataFrame, sides: Column, exits: Sequence[tuple[float, float]], capital: float = 10_000.0, part: float = 0.1, block: int = 54) -> DataFrame:
    """``close_only_trades`` for many combinations at once: ``sides`` is an array with each combination's signal on the bar,
    ``exits`` their stops and targets in ATRs. A task has one symbol's bars, and the signals of ``block`` combinations."""
    blocks = -(-len(exits) // block)
    rows = bars.select("symbol", "ts", "close", "atr", sides.alias("_all")).na.drop()
    rows = rows.select("symbol", "ts", "close", "atr", "_all", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    rows = rows.select("symbol", "ts", "close", "atr", "_b", F.slice("_all", F.col("_b") * block + 1, F.lit(block)).alias("_s"))

    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        close, atr, signals = pdf["close"].to_numpy(float), pdf["atr"].to_numpy(float), np.stack(pdf["_s"].to_numpy())
        out = [(key[0], k, *trade) for j in range(signals.shape[1]) for k in [key[1] * block + j] for trade in close_only_scan(close, signals[:, j], atr, *exits[k], capital, part)]
        return pd.DataFrame(out, columns=["symbol", "combo", "entry_idx", "exit_idx", "direction", "entry_price", "exit_price", "pnl", "reason"])

    return rows.groupBy("symbol", "_b").applyInPandas(scan, "symbol string, combo int, entry_idx long, exit_idx long, direction int, entry_price double, exit_price double, pnl double, reason string")


def pair_scan(z: np.ndarray, spread: np.ndarray, enter: float, stop: float) -> list[tuple]:
    out, side, at = [], 0, 0
    for i, v in enumerate(z):
        if np.isnan(v):
            continue
        if side:
            reason = "STOP" if abs(v) >= stop else "REVERT" if side * v >= 0 else None
            if reason:
                out.append((at, i, side, side * (spread[i] - spread[at]), reason))
                side = 0
        elif enter <= abs(v) < stop:
            side, at = (-1 if v > 0 else 1), i
    if side:
        out.append((at, len(z) - 1, side, side * (spread[-1] - spread[at]), "END"))
    return out


def signal_pair_trades(df: DataFrame, keys: Sequence[str], enter: float = 2.0, stop: float = 3.5, width: float | None = None) -> DataFrame:
    """Trades of spreads: in beyond ``enter``, out at zero, at ``stop``, or at the end; one at a time.

    No trade is open after a row at or beyond ``stop``, nor after one that comes to the other side of zero without reaching
    ``enter``; what lies between two such rows is a stretch that is scanned on its own."""
    key = list(keys)
    kinds = dict(df.dtypes)
    rows = blocks.running(df.select(*key, "ts", "z", "spread").filter("z IS NOT NULL"), key, "ts", "_at", width=width).filter("NOT isnan(z)")
    rows = blocks.lagged(rows, {"_z": F.col("z")}, key, "ts", width).drop("_first")
    z = F.col("z")
    flat = (F.abs(z) >= stop) | ((F.abs(z) < enter) & ((F.signum(z) != F.signum(F.col("_z"))) | (z == 0)))
    rows = blocks.running(rows.withColumn("_flat", yes(flat).cast("int")), key, "ts", sums={"_flats": F.col("_flat")}, width=width)
    rows = rows.withColumn("_stretch", F.col("_flats") - F.col("_flat"))
    rows = rows.select(*key, "_stretch", "_at", "z", "spread")

    def scan(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        at = pdf["_at"].to_numpy() - 1
        out = [(*group[:-1], int(at[a]), int(at[b]), side, pnl, reason) for a, b, side, pnl, reason in pair_scan(pdf["z"].to_numpy(float), pdf["spread"].to_numpy(float), enter, stop)]
        return pd.DataFrame(out, columns=[*key, "entry_idx", "exit_idx", "direction", "pnl", "reason"])

    return rows.groupBy(*key, "_stretch").applyInPandas(scan, ", ".join(f"{k} {kinds[k]}" for k in key) + ", entry_idx long, exit_idx long, direction int, pnl double, reason string")


def cooldown(df: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), at: str = "ts", width: float | None = None) -> DataFrame:
    """Entries less than ``seconds`` after the last accepted one of their key go. By cells of 32 times as long."""
    rows = df.withColumn("_until", F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + F.lit(seconds * 1_000_000 - 1)))
    return without_overlaps(rows, keys, at, "_until", width or max(32 * seconds, blocks.SECONDS), seconds * 1_000_000).drop("_until")
