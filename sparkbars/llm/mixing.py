"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents all expect ``target / source_size`` copies. In the order (size class, salt, doc_id) these add up
along the source; with one random offset for the source, a document is emitted once for each integer its stretch of
the sum crosses. Ranks come from counts of cells (source, size class, salt), so no source passes through one task.

Size is the number of words; null text has none. Rows of an empty source (all sizes 0) take nothing. A null source is a
source of its own, ordered last. Rows that repeat a doc_id, and rows without one, count as documents of their own; such
ties are ordered by size, then by a hash of the text. Empty tables give empty results. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, word_count

#: Documents of a source with a like size that one window sorts, about.
CELL_ROWS = 50_000


def source_targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); a row for each source, so one task holds them.

    Targets share all sizes by weight 1, 2, 3, repeating; none is above ``most`` times its source, and what is above is
    shared again. That settles at ``least(most * size, level * weight)``: sources in the order of their limit for each
    weight stop at their limit until the level that the others share falls below it.
    """
    everything, by_name, by_limit = Window.partitionBy(), Window.partitionBy().orderBy(F.col("source").asc_nulls_last()), Window.partitionBy().orderBy("ratio", "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    out = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long")).withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    out = out.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)))
    out = out.withColumn("shares", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level if this source and all after it are below their limits; the first that fits is the true one, later ones are lower
    out = out.withColumn("level", F.max(F.when(F.col("rest") / F.col("shares") <= F.col("ratio"), F.col("rest") / F.col("shares"))).over(everything))
    return out.select("source", "source_size", "weight", F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _plan(rows: DataFrame, seed: str, cell_rows: int) -> DataFrame:
    """rows (``doc_id``, ``source``, ``size``, ``tie``, others) with ``source_size``, ``target``, ``copies``."""
    salts = max(1, -(-rows.count() // cell_rows))
    # size class: the number of binary digits, and the three digits after the first
    cls = F.expr("cast(length(bin(size)) * 8 + (shiftright(size, cast(greatest(length(bin(size)) - 4, 0) as int)) & 7) as int)")
    # rows without an id, of which there may be many, are dealt out by their text
    salt = F.pmod(F.pmod(F.coalesce("doc_id", "tie"), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32)) % F.lit(salts)
    rows = rows.withColumn("cls", cls).withColumn("salt", salt)
    cells = settled(rows.groupBy("source", "cls", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "cells")

    classes = cells.groupBy("source", "cls").agg(F.sum("n").alias("m"))
    above = Window.partitionBy("source").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("source", "cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source joins too
    classes = classes.select(key.alias("key"), "cls", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("below"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"))).select(key.alias("key"), "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "key").cast("binary")), 1, 4), 16, 10).cast("long") / F.lit(65536)
    starts = cells.select(key.alias("key"), "cls", "salt", F.coalesce(F.sum("n").over(beside), F.lit(0)).alias("left")).join(classes, ["key", "cls"]).join(targets, "key").select("key", "cls", "salt", "source_size", "target", (F.col("below") + F.col("left")).alias("start"), offset.alias("offset"))

    ranked = rows.withColumn("key", key).withColumn("rank", F.row_number().over(Window.partitionBy("key", "cls", "salt").orderBy("doc_id", "size", "tie"))).join(starts, ["key", "cls", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(rate * n + F.col("offset"))
    return ranked.withColumn("copies", upto(F.col("start") + F.col("rank")) - upto(F.col("start") + F.col("rank") - 1))


def _sized(id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie")]


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a row for each row of ``docs``."""
    rows = settled(docs.select(*_sized(id_col, text_col, source_col)), "sizes")
    return _plan(rows, seed, cell_rows).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with their columns.

    The plan is carried back to its very row by a number written with it, whatever ids repeat or are missing."""
    kept = settled(docs.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__n"), F.struct(*_sized(id_col, text_col, source_col)).alias("__size")), "numbered")
    plan = _plan(kept.select("__n", "__size.*"), seed, cell_rows).filter("copies > 0").select("__n", F.col("copies").cast("int").alias("__copies"))
    return kept.join(plan, "__n").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
