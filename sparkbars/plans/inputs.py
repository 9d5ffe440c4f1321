"""The driver's tables as ticks, bars, trades and the like; in Spark, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import indicators as I


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str, symbol: str = "event_type") -> DataFrame:
    return table(spark, folder, "events").select(F.col(symbol).cast("string").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))


def hourly(spark: SparkSession, folder: str, width: str = "1 hour") -> DataFrame:
    return B.resample_bars(ticks(spark, folder), width, "price", "event_id")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("asset"), F.col("event_type").alias("hypothesis"), "event_id", "ts", (F.col("value") - 35).alias("pnl"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with the features that need no recurrence."""
    out = I.atr_ratio(I.atr_sma(hourly(spark, folder)))
    return I.disorder_proxy(I.zscore(I.returns(out), "close", 20, "z20"))


def stamped(df: DataFrame) -> DataFrame:
    """For comparison: doubles to six places, times as text."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c, 6) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(name))
    return df.select(*cols)


TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id, value AS price FROM events)"


def bars_sql(name: str = "bars", bucket: str = "date_trunc('hour', ts)") -> str:
    return (
        f"{name} AS (SELECT symbol, {bucket} AS ts, first(price ORDER BY ticks.ts, event_id) AS open, max(price) AS high, min(price) AS low, "
        "last(price ORDER BY ticks.ts, event_id) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY 1, 2)"
    )


BARS = f"{TICKS}, {bars_sql()}"
TRADES = "trades AS (SELECT user_id AS asset, event_type AS hypothesis, event_id, ts, value - 35 AS pnl, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction FROM events)"
PART = "PARTITION BY symbol ORDER BY ts"


def frame(n: int, part: str = PART) -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int = 1, part: str = PART) -> str:
    value = f"{f}({x}) {frame(n, part)}"
    return value if least <= 1 else f"CASE WHEN count({x}) {frame(n, part)} >= {least} THEN {value} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({PART})"


def stamp(x: str = "ts") -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {x.split('.')[-1]}"


def six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n.split('.')[-1]}" for n in names)


FEATURES = f"""{BARS},
f1 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, sign(close - open) AS d FROM bars),
f2 AS (SELECT *, {roll('avg', 'tr', 14)} AS atr, {lag('d')} AS d0 FROM f1),
f3 AS (SELECT *, CASE WHEN d <> 0 AND d0 <> 0 THEN (d <> d0)::INT::DOUBLE END AS flip, {roll('avg', 'atr', 20, 5)} AS atr20,
  close / nullif({lag('close')}, 0) - 1 AS ret1, close / nullif({lag('close', 5)}, 0) - 1 AS ret5, close / nullif({lag('close', 20)}, 0) - 1 AS ret20, close - {lag('close', 10)} AS mom10,
  CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END AS log_ret,
  coalesce((close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_samp', 'close', 20)}, 0), 0) AS z20 FROM f2),
features AS (SELECT *, CASE WHEN atr20 <> 0 THEN least(greatest(atr / atr20, 0.2), 4.0) END AS atr_ratio, {roll('avg', 'flip', 12, 4)} AS disorder FROM f3)"""
REGIME3 = """CASE WHEN coalesce(disorder > 0.5, false) OR coalesce(atr_ratio > 1.5, false) THEN 'STRESS' WHEN coalesce(atr_ratio < 0.8, false) THEN 'COMPRESSED' ELSE 'STRUCTURED' END"""
LABELLED = f"{FEATURES}, labelled AS (SELECT *, {REGIME3} AS regime FROM features)"
BLOCKS = f"""{LABELLED},
i1 AS (SELECT *, CASE WHEN row_number() OVER ({PART}) = 1 OR {lag('regime')} <> regime THEN 1 ELSE 0 END AS fresh, row_number() OVER ({PART}) - 1 AS idx FROM labelled),
islands AS (SELECT *, sum(fresh) OVER ({PART})::BIGINT AS island FROM i1),
blocks AS (SELECT symbol, island, min(regime) AS regime, min(ts) AS start_ts, max(ts) AS end_ts, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS bars FROM islands GROUP BY 1, 2)"""


def ewm_sql(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """A recursive table (symbol, n, columns) over ``source`` (symbol, n, and x of each)."""
    first = ", ".join(f"{x}::DOUBLE AS {c}" for c, (x, _) in columns.items())
    step = ", ".join(f"CASE WHEN s.{x} IS NULL THEN r.{c} WHEN r.{c} IS NULL THEN s.{x} ELSE {a!r}::DOUBLE * s.{x} + (1 - {a!r}::DOUBLE) * r.{c} END" for c, (x, a) in columns.items())
    return f"{name} AS (SELECT symbol, n, {first} FROM {source} WHERE n = 1 UNION ALL SELECT s.symbol, s.n, {step} FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.n = r.n + 1)"
