"""Connected components of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import discard, scratch


def _same(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (``a``, ``b``: longs) to (``node``, ``component``): the smallest node that each linked node reaches.

    Alternates large-star and small-star steps until nothing changes; each round is written to the shared folder, and the
    one before it deleted. Nodes without a link, and the smallest of each component, have no row.
    """
    spark = links.sparkSession

    def written(df: DataFrame) -> str:
        path = scratch(spark, "links")
        df.write.parquet(path)
        return path

    read = spark.read.schema("lo long, hi long").parquet
    here = written(links.filter("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    state, before = _same(read(here)), None
    while state != before:
        edges = read(here)
        # large star: each node's larger neighbours link to the smallest of its neighbours and itself
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small star: each node and its smaller neighbours link to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo != hi").union(least.select("m", "hi")).distinct()
        old, here = here, written(small)
        discard(spark, old)
        before, state = state, _same(read(here))
    return read(here).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
