"""Removal of repeated passages: every byte covered by a string of ``length`` bytes that starts anywhere else too.

A window is ``length`` bytes of one document. Its anchor is the gram of a third of its length with the smallest hash (the leftmost of
equal ones), so equal windows have equal anchors at the same place within them. A document's windows fall into runs of the same
anchor, about one for every ``length`` / 3 bytes, and only runs whose anchor occurs elsewhere can hold repeats.

1. One pass over the texts gives the runs; anchors are counted, with counts combined before the shuffle.
2. Runs of equal bytes are one; if two documents or places have it, all its windows are repeated.
3. Where an anchor has several different runs, these meet in a shard. It takes a few anchors at a time (a megabyte of runs, or one
   anchor's) and sorts all their suffixes by induced sorting: suffixes are classified, leftmost smaller substrings sorted and
   named, their order found from the names, and that of all suffixes induced in linear time. Common prefixes are computed in
   text order (permuted): where the character before differs they are measured, elsewhere one less than the one before. A
   window is repeated if it shares ``length`` bytes with a neighbour.
4. Texts meet their repeated spans again, and lose them. Texts without any never shuffle.

An anchor with more than ``CELL`` different runs (a passage in very many documents) is split: its windows by their distance from the
anchor into ``WAYS`` ranges, and each range by the bytes that all its windows share. Runs that are then alone go, equal ones become
one, and cells that are still too large are split again, down to a single window. So no key is too large for a task.

Null text is empty. Every row is a document, also where ids repeat. Texts shorter than ``length`` and empty tables lose nothing.
Which of equal strings comes first plays no part: all go. Cuts may split a character, so what stays is bytes. Other columns may have any name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, settled

#: Bytes of a repeated string; different runs of a cell before it is split, and into how many; bytes of a shard, and of the whole
#: cells in it that are sorted together, unless one has more.
LENGTH, CELL, WAYS, SHARD, TOGETHER = 400, 4096, 8, 2 << 20, 1 << 20
#: Window starts that a task looks at together, some 100 bytes of memory each; they number positions with so many bits.
PIECE, POSITION_BITS = 512 << 10, 23
#: Base of the grams' hash, modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


# runs of a text


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: by blocks, from minima up to each place and from each place on."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    up_to = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], up_to[width - 1 : width - 1 + n])


def window_runs(text: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, hash of the anchor, its place, first and last window of the run), all places in ``text``.

    text: bytes of documents; offsets: their beginnings, and the end of the last. They are looked at in pieces, which cut only
    documents longer than a piece; so equal documents have equal runs."""
    step = min(PIECE, (1 << POSITION_BITS) - length)
    powers, inverses = (_powers(b, step + length) for b in (BASE, INVERSE))
    p = end = 0
    while (p := end) + length <= len(text):
        whole = int(offsets[np.searchsorted(offsets, p + step, "right") - 1])
        end = whole if whole > p else p + step
        part = text[p : end + length - 1]
        n = len(part) - length + 1
        ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[: len(part)])])
        h = (ahead[gram:] - ahead[:-gram]) * inverses[: len(part) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        place = np.uint64((1 << POSITION_BITS) - 1)
        least = (_window_minima((h & ~place) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & place).astype(np.int64)
        # the last length - 1 starts of each document are no windows
        change = np.zeros(n + 1, np.int32)
        ends = offsets[1:] - p
        begins = np.maximum(offsets[:-1], offsets[1:] - length + 1) - p
        np.add.at(change, np.clip(begins, 0, n), 1)
        np.add.at(change, np.clip(ends, 0, n), -1)
        fine = np.cumsum(change[:n]) == 0
        at = np.flatnonzero(fine)
        if not len(at):
            continue
        anchor = least[at]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
        begin = np.flatnonzero(new)
        first, last = at[begin], at[np.r_[begin[1:], len(at)] - 1]
        anchor = anchor[begin]
        yield np.searchsorted(offsets, first + p, "right") - 1, h[anchor].view(np.int64), anchor + p, first + p, last + p


def text_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(``h``, ``id``, ``at``, ``x0``, ``x1``, ``digest``) for each run of rows (id, text): the anchor's hash and place, the
    least and largest distance from a window's start to it, and a digest of the bytes of all its windows."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            view = memoryview(raw)
            for doc, h, anchor, first, last in window_runs(raw, offsets, length, gram):
                digest = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())]
                arrays = [pa.array(h), pa.array(ids[doc]), pa.array((anchor - offsets[doc]).astype(np.int32)), pa.array((anchor - last).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "id", "at", "x0", "x1", "digest"])

    return rows.mapInArrow(runs, "h long, id long, at int, x0 int, x1 int, digest binary")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of text, so that what goes back to Spark is cut as well."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = np.flatnonzero(np.diff(np.r_[-1, ends // (4 * PIECE)])) if len(ends) else np.zeros(0, int)
        for a, b in zip(np.r_[0, cut[1:]], np.r_[cut[1:], len(batch)]):
            yield batch.slice(int(a), int(b - a))


# suffix arrays


def _induce(t: np.ndarray, smaller: np.ndarray, count: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the order of the leftmost smaller ones: larger suffixes bucket by bucket upwards, then
    smaller ones downwards. A bucket is a character; what one bucket sends to itself is taken up until nothing is new."""
    k, n = len(count), len(t)
    ends = np.cumsum(count)
    starts = ends - count
    sa = np.full(n, -1, np.int32)
    by_char = np.searchsorted(t[lms], np.arange(k + 1))

    def send(suffixes: np.ndarray, wanted: bool, edge: np.ndarray, step: int, c: int) -> np.ndarray:
        """Put the suffixes one longer into their buckets, in this order from the edge. Returns those of bucket c."""
        before = suffixes[suffixes > 0] - 1
        before = before[smaller[before] == wanted]
        char = t[before]
        order = np.argsort(char, kind="stable")
        sorted_, char_ = before[order], char[order].astype(np.int64)
        n_char = np.bincount(char_, minlength=k)
        rank = np.arange(len(char_)) - (np.cumsum(n_char) - n_char)[char_]
        sa[edge[char_] + rank if step > 0 else edge[char_] - 1 - rank] = sorted_
        edge += step * n_char
        return before[char == c]

    heads = starts.copy()
    for c in range(k):
        front = sa[starts[c] : heads[c]].copy()
        while len(front):
            front = send(front, False, heads, 1, c)
        send(lms[by_char[c] : by_char[c + 1]], False, heads, 1, c)
    tails = ends.copy()
    sa[0] = n - 1
    for c in range(k - 1, -1, -1):
        front = sa[tails[c] : ends[c]][::-1].copy()
        while len(front):
            front = send(front, True, tails, -1, c)
        send(sa[starts[c] : heads[c]][::-1], True, tails, -1, c)
    return sa


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names. Names are too many for buckets, so ranks of twice as many names are found
    from those of so many, for suffixes that are not yet told apart."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    alone = np.empty(m, bool)
    alone[order] = new & np.r_[new[1:], True]
    todo, h = np.flatnonzero(~alone), 1
    while len(todo):
        beyond = np.where(todo + h < m, rank[np.minimum(todo + h, m - 1)], -1)
        order = np.lexsort((beyond, rank[todo]))
        todo, beyond = todo[order], beyond[order]
        old = rank[todo]
        head = np.r_[True, old[1:] != old[:-1]]
        new = head | np.r_[True, beyond[1:] != beyond[:-1]]
        place = np.arange(len(todo))
        rank[todo] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        todo = np.sort(todo[~(new & np.r_[new[1:], True])])
        h *= 2
    return rank


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes in order, by induced sorting. t: characters from 0; the last is 0 and the only one."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.uint16)
    count = np.bincount(t)
    differs = np.flatnonzero(t[:-1] != t[1:])  # never empty: the last character is alone
    ahead = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
    smaller = np.r_[t[ahead + 1] > t[ahead], True]
    del ahead, differs
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce(t, smaller, count, lms[np.argsort(t[lms], kind="stable")])
    by_substring = sa[is_lms[sa]]
    del sa, is_lms
    number = np.empty(n, np.int32)
    number[lms] = np.arange(len(lms))
    size = np.r_[np.diff(lms) + 1, 1][number[by_substring]]
    a, b = by_substring[:-1], by_substring[1:]
    same = size[:-1] == size[1:]
    active, k = np.flatnonzero(same), 0
    while len(active):
        equal = t[a[active] + k] == t[b[active] + k]
        same[active[~equal]] = False
        k += 1
        active = active[equal & (size[active] > k)]
    names = np.empty(len(lms), np.int64)
    names[number[by_substring]] = np.cumsum(np.r_[0, ~same])
    ranks = _rank_names(names)
    del number, by_substring, a, b
    in_order = np.empty(len(lms), np.int64)
    in_order[ranks] = lms
    return _induce(t, smaller, count, in_order)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the text what its suffix has in common with the one before it in order."""
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n, dtype=np.int32)
    chained = (place > 0) & (before > 0)
    chained[chained] = t[place[chained] - 1] == t[before[chained] - 1]
    start = np.flatnonzero(~chained & (before >= 0))
    padded = np.concatenate([t.astype(np.uint16), np.zeros(4, np.uint16)])
    four = np.lib.stride_tricks.sliding_window_view(padded, 4)
    common = np.zeros(n, np.int32)
    active, k = start, 0
    while len(active):  # four characters at a time
        equal = (four[active + k] == four[before[active] + k])
        run = np.where(equal.all(1), 4, equal.argmin(1))
        common[active] += run
        active, k = active[run == 4], k + 4
    last = np.maximum.accumulate(np.where(chained, 0, place))
    return np.maximum(common[last] - (place - last), 0)


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part the starts of windows that also start anywhere else in the parts."""
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(np.r_[0, sizes[:-1] + 1])
    t = np.zeros(int((sizes + 1).sum()) + 1, np.uint16)
    body = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + 2
    t[:-1] = body
    t[begins + sizes] = 1  # between parts; the end is 0
    sa = suffix_array(t)
    common = permuted_prefixes(t, sa)[sa]
    often = np.zeros(len(t), bool)
    often[sa] = (common >= length) | np.r_[common[1:] >= length, False]
    return [np.flatnonzero(often[b : b + max(0, s - length + 1)]) for b, s in zip(begins.tolist(), sizes.tolist())]


def cells_together(cell: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, which are in order of their cell: whole cells of at most ``most`` bytes in all, or one cell."""
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]) if len(cell) else np.zeros(1, np.int64)
    ahead = np.r_[0, np.cumsum(size)][edges]
    k = 0
    while k < len(edges) - 1:
        to = max(k + 1, int(np.searchsorted(ahead, ahead[k] + most, "right")) - 1)
        yield int(edges[k]), int(edges[to])
        k = to


def repeated_in_cells(pdf: pd.DataFrame, length: int, most: int = TOGETHER) -> pd.DataFrame:
    """(``id``, ``at``, ``x0``, ``x1``) of repeated windows of a shard's rows. Equal windows are in one cell, so a few cells at
    a time are sorted, whatever the shard's size."""
    pdf, out = pdf.sort_values("cell", kind="stable"), []
    for a, b in cells_together(pdf.cell.to_numpy(), pdf.bytes.map(len).to_numpy(), most):
        some = pdf.iloc[a:b]
        for row, at in zip(some.itertuples(index=False), repeated_windows(some.bytes.tolist(), length)):
            if len(at):
                begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
                out += [(row.id, row.at, row.x1 - int(b), row.x1 - int(a)) for a, b in zip(at[begin], at[np.r_[begin[1:], len(at)] - 1])]
    return pd.DataFrame(out, columns=["id", "at", "x0", "x1"])


# the operator


def _split(cells: DataFrame, length: int, ways: int) -> DataFrame:
    """Rows of cells by range of distance from the anchor, with the part of their bytes that has the windows of the range."""
    width = F.expr(f"greatest(1, (hi - lo + {ways}) div {ways})").cast("int")
    parts = cells.withColumn("width", width).select("*", F.explode(F.expr("sequence(lo, hi, width)")).alias("lo_")).withColumn("hi_", F.expr("least(hi, lo_ + width - 1)"))
    parts = parts.withColumn("z0", F.greatest("x0", "lo_")).withColumn("z1", F.least("x1", "hi_")).filter("z0 <= z1")
    parts = parts.withColumn("bytes", F.expr(f"substring(bytes, x1 - z1 + 1, {length} + z1 - z0)"))
    shared = F.expr(f"substring(bytes, z1 - lo_ + 1, {length} - hi_ + lo_)")
    return parts.select(F.xxhash64("cell", "lo_", "hi_", shared).alias("cell"), F.col("lo_").alias("lo"), F.col("hi_").alias("hi"), "id", "at", F.col("z0").alias("x0"), F.col("z1").alias("x1"), "bytes")


def _refine(cells: DataFrame, length: int, cell: int, ways: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Cells of at most ``cell`` rows, and rows all of whose windows were found repeated on the way."""
    ready, repeated = [], []
    while True:
        size = settled(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "cell-sizes")
        ready.append(cells.join(size.filter(F.col("rows") <= cell).select("cell"), "cell", "left_semi"))
        large = size.filter(F.col("rows") > cell).select("cell")
        if not large.head(1):
            return ready, repeated
        parts = settled(_split(cells.join(large, "cell", "left_semi"), length, ways).withColumn("digest", F.md5("bytes")), "cell-parts")
        key = ["cell", "x0", "x1", "digest"]
        equal = settled(parts.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "at")).alias("one")), "equal-parts")
        repeated.append(parts.join(equal.filter("rows > 1").select(*key), key, "left_semi").select("id", "at", "x0", "x1"))
        cells = settled(parts.join(equal.select(*key, "one"), key).filter("id = one.id AND at = one.at").select("cell", "lo", "hi", "id", "at", "x0", "x1", "bytes"), "cells")


def repeated_ranges(rows: DataFrame, length: int = LENGTH, cell: int = CELL, ways: int = WAYS, shard: int = SHARD) -> DataFrame:
    """(``id``, ``start``, ``end``) of spans of repeated windows, which may overlap. rows: a settled table of id and text."""
    gram = max(1, length // 3)
    runs = settled(text_runs(rows, length, gram), "runs")
    often = settled(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "anchors")
    runs = settled(among(runs, "h", often)[1].join(often, "h", "left_semi"), "repeated-anchors")
    key = ["h", "x0", "x1", "digest"]
    different = settled(runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("one")), "different-runs")
    whole = runs.join(different.filter("n > 1").select(*key), key, "left_semi").select("id", "at", "x0", "x1")

    several = settled(different.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "several-runs")
    compared = different.join(several, "h", "left_semi").select(F.col("one.id").alias("id"), F.struct("h", "one.at", "x0", "x1").alias("run"))
    by_text = settled(compared.groupBy("id").agg(F.collect_list("run").alias("runs")), "runs-of-texts")  # as many as a text has
    texts = among(rows, "id", settled(by_text.select("id"), "compared-texts"))[1]
    cut = texts.join(by_text, "id").select("id", F.encode("text", "utf-8").alias("text"), F.explode("runs").alias("run"))
    cells = cut.select(F.xxhash64("run.h").alias("cell"), F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"), "id", "run.at", "run.x0", "run.x1", F.expr(f"substring(text, run.at - run.x1 + 1, {length} + run.x1 - run.x0)").alias("bytes"))
    cells = settled(cells, "compared-runs")
    ready, repeated = _refine(cells, length, cell, ways)
    ready_cells = ready[0]
    for more in ready[1:]:
        ready_cells = ready_cells.unionByName(more)
    ready_cells = settled(ready_cells, "ready-cells")
    total = ready_cells.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return repeated_in_cells(pdf, length)

    shards = F.pmod(F.col("cell"), F.lit(max(1, -(-int(total) // shard))))
    found = ready_cells.select("cell", "id", "at", "x0", "x1", "bytes", shards.alias("shard")).groupBy("shard").applyInPandas(compare, "id long, at int, x0 int, x1 int")
    for part in (whole, *repeated):
        found = found.unionByName(part)
    return found.select("id", (F.col("at") - F.col("x1")).alias("start"), (F.col("at") - F.col("x0") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, ways: int = WAYS, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, spans (``start``, ``end``: the removed bytes, in order and apart), kept (binary): a row per document."""
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "texts")
    ranges = settled(repeated_ranges(rows.select("id", "text"), length, cell, ways, shard), "ranges")
    by_text = settled(ranges.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "spans")  # bounded by the text
    clean, others = among(rows, "id", settled(by_text.select("id"), "repeating-texts"))
    raw, kind = F.encode("text", "utf-8"), "array<struct<start:int,end:int>>"
    others = others.join(by_text, "id", "left").select("doc_id", raw.alias("text"), "ranges")
    id_kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sizes, all_spans, kept = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                text, spans = text.as_py(), []
                for r in sorted((r["start"], r["end"]) for r in ranges.as_py() or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], r[1]))
                    else:
                        spans.append(r)
                edges = [0, *(x for s in spans for x in s), len(text)]
                sizes.append(len(text))
                all_spans.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    done = others.mapInArrow(cut, f"doc_id {id_kind}, n_bytes long, spans {kind}, kept binary")
    return clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(kind).alias("spans"), raw.alias("kept")).unionByName(done)
