"""Exact duplicates by a two-pass Bloom filter, in DataFrame operations only.

Pass 1 counts, for a single cell of each text's digest, the rows that set it; counts combine before the shuffle, and
nothing but cell numbers shuffles. The cells that more than one row set make a Bloom filter. Pass 2 looks every row up:
one that the filter does not know is the only one of its text and passes straight through, without a shuffle. The rest
shuffle, and are grouped by their digest.

The filter holds repeated cells alone, and is broadcast. Its size is bounded: at the bound it lets more rows through to
the exact grouping, so neither results nor the plan depend on it.

Null text counts as empty. Empty tables give empty results. Of rows that repeat a doc_id with an equal text one is
kept; a null doc_id counts as smaller than any other. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bloom_bits, bloom_filter, maybe_in, settled

#: Cells for each row: by so many, a row that is alone shares its cell with chance 1 / 64.
CELLS_PER_ROW, LEAST_CELLS = 64, 1 << 16
#: The most bytes of the filter's bitmaps.
BROADCAST_BYTES = 32 << 20


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def flag_possible_repeats(rows: DataFrame, digest: str, narrow: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with ``__repeat``: false only where no other row has the same digest. narrow: the digests of all rows."""
    cells = max(LEAST_CELLS, CELLS_PER_ROW * narrow.count())
    cell = F.pmod(F.xxhash64(F.col(digest)), F.lit(cells))
    often = settled(narrow.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell"), "repeated-cells")
    bits = bloom_bits(often.count(), broadcast_bytes)
    bitmaps = settled(bloom_filter(often, "cell", bits), "repeat-filter")
    return maybe_in(rows.withColumn("__cell", cell), "__cell", bitmaps, bits, "__repeat").drop("__cell")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    narrow = settled(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    rows = flag_possible_repeats(narrow, "text_sha256", narrow, broadcast_bytes)
    alone = rows.filter("NOT __repeat").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.filter("__repeat")
    groups = maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last"))
    groups = settled(groups, "groups")  # a table of its own: Spark can then split the rows of a hot group in the join
    marked = maybe.join(groups, "text_sha256").select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")
    return alone.unionByName(marked)


def split_repeats(docs: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (``__row``) that no other row equals, and (``__row``, ``__digest``) that another may equal."""
    rows = docs.select(F.struct("*").alias("__row"), text_digest(F.col(text_col)).alias("__digest"))
    rows = flag_possible_repeats(rows, "__digest", settled(rows.select("__digest"), "digests"), broadcast_bytes)
    return rows.filter("NOT __repeat").select("__row"), rows.filter("__repeat").select("__row", "__digest")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows of possibly repeated texts combine before they shuffle."""
    alone, maybe = split_repeats(docs, text_col, broadcast_bytes)
    one = F.max_by("__row", F.coalesce(F.col(f"__row.{id_col}"), F.lit(-(1 << 63)))).alias("__row")
    return alone.unionByName(maybe.groupBy("__digest").agg(one).select("__row")).select("__row.*")
