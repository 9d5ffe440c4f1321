"""What the corpus operators share: ASCII lower-casing, word counts, tables written between steps, and a Bloom filter."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import scratch

#: A word: characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` would also change other scripts."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and a lost executor loses nothing. The table
    goes when the driver ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the filter for each key, and the least number of bits.
BITS_PER_KEY, LEAST_BITS = 16, 1 << 16


def bloom_bits(count: int, most_bytes: int) -> int:
    """Bits of a filter of ``count`` keys: a power of two, so many that about 1.5 % of other keys pass, but never more than
    ``most_bytes`` hold. A filter at that bound lets more pass, and still every key that is in it."""
    wanted = 1 << (max(BITS_PER_KEY * count, 1) - 1).bit_length()
    return max(LEAST_BITS, min(wanted, 1 << (max(8 * most_bytes, 1).bit_length() - 1)))


def _bit(key: Column, k: int, bits: int) -> Column:
    """Numbers from 1, as Spark's bitmap functions count them."""
    return F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits)) + 1


def bloom_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmaps (``bucket``, ``bits``) of the two bits that each key sets; at most ``bits`` / 8 bytes in all."""
    bit = keys.select(F.explode(F.array(_bit(F.col(key), 1, bits), _bit(F.col(key), 2, bits))).alias("bit"))
    return bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def maybe_in(rows: DataFrame, key: str, bitmaps: DataFrame, bits: int, to: str) -> DataFrame:
    """``rows`` with ``to``: false only where the key is not in the filter, whose size is bounded, so it is broadcast."""
    out = rows
    for k in (1, 2):
        part = bitmaps.select(F.col("bucket").alias(f"__bucket{k}"), F.col("bits").alias(f"__bits{k}"))
        bit = _bit(F.col(key), k, bits)
        out = out.withColumn(f"__bucket{k}", F.bitmap_bucket_number(bit)).withColumn(f"__at{k}", F.bitmap_bit_position(bit)).join(F.broadcast(part), f"__bucket{k}", "left")
    there = " AND ".join(f"coalesce((cast(conv(hex(substring(__bits{k}, cast(__at{k} div 8 as int) + 1, 1)), 16, 10) as int) >> cast(__at{k} % 8 as int)) & 1, 0) = 1" for k in (1, 2))
    return out.withColumn(to, F.expr(there)).drop(*[f"__{x}{k}" for x in ("bucket", "bits", "at") for k in (1, 2)])


#: The most bytes of a filter that is broadcast.
FILTER_BYTES = 32 << 20


def among(rows: DataFrame, key: str, keys: DataFrame, most_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key is surely not in ``keys`` (a settled table with that column alone), and all others, of which
    few are not. Neither shuffles."""
    bits = bloom_bits(keys.count(), most_bytes)
    flagged = maybe_in(rows, key, settled(bloom_filter(keys, key, bits), "filter"), bits, "__maybe")
    return flagged.filter("NOT __maybe").drop("__maybe"), flagged.filter("__maybe").drop("__maybe")
