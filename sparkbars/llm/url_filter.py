"""URL rules by host and path, and a list of canonical URLs behind a blocked Bloom filter; DataFrame operations only.

The filter has 256-bit blocks (a row each: four 64-bit words). A URL's hash chooses one block and one bit in each word,
so a look-up reads one block. Rows that pass are possible hits and go to an exact join on the canonical URL, which
removes false positives; all other rows pass without that join, and without a shuffle. The filter is broadcast; its size
is bounded, and at the bound it lets more rows through to the exact join, so results don't depend on it.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule, are on no list, and so are allowed.
Repeated pages are judged each; of rules of one length the first named wins. Empty tables give empty results. Other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settled

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Listed URLs for each block, bytes of a block's row in memory, and the most bytes of blocks.
PER_BLOCK, BLOCK_BYTES, BROADCAST_BYTES = 16, 96, 32 << 20
#: Query parameters that say where a visitor came from, not what is shown.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without closing slashes, query without tracking; null if there is no host."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(TRACKING) & (x != "")), "&")
    return F.when(url_host(url) != "", F.concat(host, F.regexp_replace(url_path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one stands further out
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _places(url: str, blocks: int) -> list[Column]:
    """Block number and the four one-bit words of a canonical URL."""
    bits = F.xxhash64(F.lit("bits"), F.col(url))
    return [F.pmod(F.xxhash64(F.col(url)), F.lit(blocks)).alias("__block"), *(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__bits, {6 * i}) & 63 as int))").alias(f"__bit{i}") for i in range(4)), bits.alias("__bits")]


def _placed(df: DataFrame, url: str, blocks: int) -> DataFrame:
    block, *words, bits = _places(url, blocks)
    return df.withColumn("__bits", bits).select("*", block, *words).drop("__bits")


def bloom_blocks(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(``__block``, ``__word0`` .. ``__word3``): the filter, a row for each block that is not empty."""
    return _placed(listed.select(url), url, blocks).groupBy("__block").agg(*(F.bit_or(f"__bit{i}").alias(f"__word{i}") for i in range(4)))


def listed_urls(pages: DataFrame, listed: DataFrame, url: str = "__canonical", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``__listed``: whether its canonical URL (a column) is in ``listed`` (distinct, not null, the same column)."""
    listed = settled(listed.select(url).filter(F.col(url).isNotNull()).distinct(), "listed-urls")
    blocks = max(1, min(-(-listed.count() // PER_BLOCK), broadcast_bytes // BLOCK_BYTES))
    kept = F.broadcast(bloom_blocks(listed, url, blocks))
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.col(f"__word{i}").bitwiseAND(F.col(f"__bit{i}")) != 0)
    rows = _placed(pages, url, blocks).join(kept, "__block", "left").withColumn("__maybe", F.coalesce(hit & F.col(url).isNotNull(), F.lit(False)))
    rows = rows.drop("__block", *[f"__{x}{i}" for x in ("word", "bit") for i in range(4)])
    missed = rows.filter("NOT __maybe").withColumn("__listed", F.lit(False))
    exact = rows.filter("__maybe").join(listed.withColumn("__listed", F.lit(True)), url, "left").withColumn("__listed", F.coalesce("__listed", F.lit(False)))
    return missed.unionByName(exact).drop("__maybe")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed. A fitting rule decides; else listed URLs are blocked, others allowed.

    listed: a column ``url`` of listed URLs, as written anywhere; both sides are made canonical.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), canonical_url(F.col(url_col)).alias("__canonical"))
    rows = listed_urls(rows, listed.select(canonical_url(F.col("url")).alias("__canonical")))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"), F.col("__listed").alias("listed"))
