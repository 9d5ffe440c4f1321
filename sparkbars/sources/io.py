"""Bars, signal logs, tables, reports and event logs, in and out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
FEATURES = ("rsi", "adx", "atr", "bb_pct", "stoch_k", "macd", "score", "final_score", "lstm_prob", "xgboost_prob", "ensemble_prob")
HORIZONS = ("5min", "30min", "1h", "4h", "1d")
SIGNAL_LOG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("signal_id", "timestamp_utc", "symbol", "signal", "regime")]
    + [T.StructField("price_at_signal", T.DoubleType()), T.StructField("features", T.StructType([*(T.StructField(c, T.DoubleType()) for c in FEATURES), T.StructField("sentiment", T.StringType())]))]
    + [T.StructField("metadata", T.StructType([*(T.StructField(c, T.StringType()) for c in ("source", "timeframe", "strategy_version")), T.StructField("final_score", T.DoubleType()), T.StructField("passed_threshold", T.BooleanType()), T.StructField("is_benchmark", T.BooleanType()), T.StructField("threshold_value", T.IntegerType())]))]
    + [T.StructField(f"outcome_{h}", T.StringType()) for h in HORIZONS]
)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By symbol and day, so that a read of some symbols or days skips the rest."""
    bars.withColumn("date", F.to_date("ts")).write.mode(mode).partitionBy("symbol", "date").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None) -> DataFrame:
    out = spark.read.parquet(path).select("symbol", "ts", "open", "high", "low", "close", "volume", "date")
    return out.filter(F.col("symbol").isin(*symbols)) if symbols else out


RANGES = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("interval", T.StringType()), T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())])


def held_ranges(spark: SparkSession, root: str) -> DataFrame:
    """What a bar cache holds: (symbol, interval, start, end) and the folder where it lies."""
    files, at = _files(spark, f"{root}/catalogue")
    schema = T.StructType([*RANGES.fields, T.StructField("folder", T.StringType())])
    return spark.read.schema(schema).parquet(f"{root}/catalogue") if files.exists(at) else spark.createDataFrame([], schema)


def missing_ranges(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The parts of wanted ranges that no held range covers, or several together; ends are exclusive."""
    w = wanted.select("symbol", "interval", F.col("start").alias("a"), F.col("end").alias("z")).filter("a < z")
    h = held.select(F.col("symbol").alias("s"), F.col("interval").alias("i"), "start", "end")
    inside = w.join(h, (F.col("symbol") == F.col("s")) & (F.col("interval") == F.col("i")) & (F.col("start") < F.col("z")) & (F.col("end") > F.col("a")))
    edges = [inside.select("symbol", "interval", "a", "z", F.greatest("start", "a").alias("b"), F.least("end", "z").alias("e")), *(w.select("symbol", "interval", "a", "z", F.col(c).alias("b"), F.col(c).alias("e")) for c in ("a", "z"))]
    before = F.max("e").over(Window.partitionBy("symbol", "interval", "a", "z").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1))
    gaps = edges[0].unionByName(edges[1]).unionByName(edges[2]).withColumn("upto", before).filter("upto < b")
    return gaps.select("symbol", "interval", F.col("upto").alias("start"), F.col("b").alias("end")).distinct()


def cached_bars(spark: SparkSession, root: str, wanted: DataFrame, load: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bars (with ``interval``) of the wanted ranges (``RANGES``): what the cache holds is read, and only gaps are loaded.

    ``load`` gets the gaps and returns their bars. A load has a folder of its own, by interval, symbol and month, and counts once
    the catalogue names it, so one that failed leaves nothing that is read. Reads skip other symbols and months."""
    gaps = missing_ranges(wanted, held_ranges(spark, root))
    found = gaps.collect()  # rows of a request
    if found:
        gaps = spark.createDataFrame(found, RANGES)
        folder = f"{root}/bars/{uuid.uuid4().hex}"
        kept = _within(load(gaps), gaps)
        kept.withColumn("month", F.date_format("ts", "yyyy-MM")).write.partitionBy("interval", "symbol", "month").parquet(folder)
        gaps.withColumn("folder", F.lit(folder)).coalesce(1).write.mode("append").parquet(f"{root}/catalogue")
    kinds = T.StructType([*BARS.fields[1:], T.StructField("interval", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("month", T.StringType())])
    near = held_ranges(spark, root).join(wanted.select(F.col("symbol").alias("s"), F.col("interval").alias("i"), F.col("start").alias("a"), F.col("end").alias("z")), (F.col("symbol") == F.col("s")) & (F.col("interval") == F.col("i")) & (F.col("start") < F.col("z")) & (F.col("end") > F.col("a")))
    lies = [(r.folder, r.symbol, r.interval) for r in near.select("folder", "symbol", "interval").distinct().collect()]
    files, path = _files(spark, root)
    at = lambda x: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
    folders = sorted({f for f, *_ in lies if files.exists(at(f)) and len(files.listStatus(at(f))) > 1})
    if not folders:
        return spark.createDataFrame([], BARS).withColumn("interval", F.lit(None).cast("string"))
    span = wanted.agg(F.min("start").alias("a"), F.max("end").alias("z")).first()
    every = None
    for f in folders:
        one = spark.read.schema(kinds).parquet(f)
        every = one if every is None else every.unionByName(one)
    every = every.filter(F.col("symbol").isin(*{s for _, s, _ in lies}) & F.col("interval").isin(*{i for *_, i in lies}) & (F.col("month") >= f"{span.a:%Y-%m}") & (F.col("month") <= f"{span.z:%Y-%m}"))
    return _within(every, wanted).select("symbol", "ts", "open", "high", "low", "close", "volume", "interval")


def _within(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    r = ranges.select(F.col("symbol").alias("s"), F.col("interval").alias("i"), "start", "end")
    return bars.join(r, (F.col("symbol") == F.col("s")) & (F.col("interval") == F.col("i")) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")), "left_semi")


def write_bar_table(bars: DataFrame, table: str, buckets: int = 64) -> None:
    """A table in the warehouse, bucketed by symbol and sorted by time: frames and joins by symbol need no shuffle."""
    bars.repartition(buckets, "symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "ts").saveAsTable(table)


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """CSV with a header in any case; rows without all prices go."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.lower().strip() for c in raw.columns))
    when = next(c for c in raw.columns if c in ("datetime", "date", "ts", "time"))
    name = F.lit(symbol) if symbol else F.col("symbol") if "symbol" in raw.columns else F.lit(None).cast("string")
    prices = [F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in ("open", "high", "low", "close")]
    volume = F.expr("try_cast(volume AS double)") if "volume" in raw.columns else F.lit(0.0)
    return raw.select(name.alias("symbol"), F.expr(f"try_cast(`{when}` AS timestamp)").alias("ts"), *prices, volume.alias("volume")).na.drop(subset=["ts", "open", "high", "low", "close"])


def signal_id(symbol: Column, ts: Column) -> Column:
    return F.concat_ws("_", symbol, F.date_format(ts, "yyyyMMddHHmmssSSSSSS"))


def append_signal_log(signals: DataFrame, path: str) -> None:
    signals.write.mode("append").json(path)


def read_signal_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNAL_LOG).json(path)


def flatten_signal_log(log: DataFrame, outcome: str = "outcome_1h") -> DataFrame:
    """Features as columns ``feat_*``; rows whose outcome is a number."""
    fields = log.schema["features"].dataType.names
    return log.select("*", *(F.col(f"features.{c}").alias(f"feat_{c}") for c in fields), F.expr(f"try_cast({outcome} AS double)").alias("outcome")).filter("outcome IS NOT NULL").drop("features")


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def new_rows(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key ``target`` doesn't have; one for each key, the smallest row."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else df.select(*keys).distinct()
    return one.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*df.columns)


def insert_or_ignore(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the new rows; returns how many."""
    spark = df.sparkSession
    new = new_rows(df, spark.read.schema(df.schema).parquet(path), keys).persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def commit_batch(spark: SparkSession, path: str, batch: int) -> None:
    """What a batch wrote counts from here on: one file that is there or not."""
    files, at = _files(spark, f"{path}/commits/{batch}")
    files.create(at, True).close()


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, f"{path}/commits")
    return sorted(int(x.getPath().getName()) for x in files.listStatus(at)) if files.exists(at) else []


def read_batches(spark: SparkSession, path: str, schema: T.StructType, batches: Sequence[int] | None = None) -> DataFrame:
    """Rows of committed batches, with ``batch`` and ``_bucket``."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])
    wanted = committed_batches(spark, path) if batches is None else batches
    if not wanted:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*(f"{path}/data/batch={b}" for b in wanted))


def write_batch(df: DataFrame, batch: int, path: str, keys: Sequence[str], upsert: bool = False, buckets: int = 64) -> None:
    """Writes a stream's batch so that doing it again, also after a failure half-way, leaves the same rows.

    A batch has a folder of its own, which it overwrites, and counts when its commit file is there. A key's rows lie in a bucket of
    the key: without ``upsert``, rows whose key an earlier batch has are left out, and only the buckets that the batch touches are
    looked at; with it, the last batch's row of a key counts (``latest_rows``). Of equal keys within a batch the smallest row stays."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*df.columns) if rest else df.select(*keys).distinct()
    rows = one.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    before = [b for b in committed_batches(spark, path) if b < batch]
    if not upsert and before:
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
        there = read_batches(spark, path, df.schema, before).filter(F.col("_bucket").isin(*touched)).select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
        rows = rows.join(there, match, "left_anti")
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/batch={batch}")
    commit_batch(spark, path, batch)


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of the last committed batch."""
    rest = [c for c in schema.names if c not in keys]
    rows = read_batches(spark, path, schema)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*schema.names)


def batch_sink(path: str, keys: Sequence[str], upsert: bool = False, buckets: int = 64):
    """For ``foreachBatch``."""
    return lambda df, batch: write_batch(df, batch, path, keys, upsert, buckets)


def exported_signals(signals: DataFrame) -> DataFrame:
    out = signals.filter("signal != 0")
    rounded = {"entry": 5, "sl": 5, "tp": 5, "score": 1, "atr": 5}
    return out.select("ts", "symbol", "timeframe", "signal", *(F.round(c, n).alias(c) for c, n in rounded.items()))


def export_signals(signals: DataFrame, path: str) -> None:
    out = exported_signals(signals)
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    out.write.mode("overwrite").json(f"{path}/json")


def journal(trades: DataFrame, day: str | Column) -> DataFrame:
    """Trades that were entered or left on a day."""
    day = F.to_date(F.lit(day)) if isinstance(day, str) else day
    return trades.filter((F.to_date("entry_time") == day) | (F.to_date("exit_time") == day)).orderBy("entry_time")


def export_journal(trades: DataFrame, path: str) -> None:
    days = F.array_distinct(F.array_compact(F.array(F.to_date("entry_time"), F.to_date("exit_time"))))
    trades.withColumn("day", F.explode(days)).write.mode("overwrite").partitionBy("day").option("header", True).csv(path)


def latest_results(runs: DataFrame, keys: Sequence[str] = ("asset", "hypothesis"), run: str = "run_id") -> DataFrame:
    """The newest run of each key alone."""
    w = Window.partitionBy(*keys).orderBy(F.desc(run))
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def load_latest_results(spark: SparkSession, root: str) -> DataFrame:
    """Many run folders of JSON; a run's id is its folder's name."""
    runs = spark.read.option("basePath", root).json(f"{root}/*/*.json").withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return latest_results(runs)


def report_rows(reports: DataFrame, key: str, at: str) -> DataFrame:
    """Reports with the whole row as a JSON payload beside the columns that are searched."""
    return reports.select(key, at, F.to_json(F.struct("*")).alias("payload"))


def list_reports(reports: DataFrame, at: str, key: str | None = None, value=None, n: int = 50) -> DataFrame:
    chosen = reports.filter(F.col(key) == value) if key else reports
    return chosen.orderBy(F.desc(at), F.desc("payload")).limit(n)


def load_report(reports: DataFrame, schema: T.StructType | str) -> DataFrame:
    return reports.select(F.from_json("payload", schema).alias("r")).select("r.*")


def write_event_log(events: DataFrame, path: str, at: str = "ts") -> None:
    events.withColumn("event_date", F.to_date(at)).write.mode("append").partitionBy("event_date").json(path)


def macro_wide(long: DataFrame, series: Sequence[str] | None = None) -> DataFrame:
    """(date, series, value) to a column for each series; all dates stay. Named series need no pass to find them."""
    return long.groupBy("date").pivot("series", list(series) if series else None).agg(F.max("value"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which driver and executors share; only a local master does without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkbars-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for what several branches use."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_event_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
