"""Source divergence audit: how each source's terms differ from its language's and from the other sources'.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A task takes its documents in shards of
``SHARD`` bytes of Arrow's text buffers and never makes strings of them: it points at the start of every term, sorts the pointers
by multikey quicksort (three-way partition by eight bytes at a time; small slices are finished by one sort), and reads from each run
of equal terms its occurrences and its documents for each (language, source). A row for each of these leaves the task; Spark adds
them up, first by (language, source, term), so that no term's rows meet in one task.

The sums over all pairs of sources are taken over slices of ``SLICE`` terms of a language; a slice and the language's list of
sources (a row each) meet in one task, which returns a sum for each pair. All arithmetic is in integers.

Null text, lang and source are empty. Every row counts as a document, also where ids repeat. Ties go to the smaller term or source
in UTF-8. Texts may be of any length. Empty tables give empty results. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Bytes of text that are sorted at once, terms of a language that are compared at once, and a slice that one sort finishes.
SHARD, SLICE, SMALL = 16 << 20, 1 << 13, 2048
#: What a probability is counted in.
UNIT = 1_000_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[97:123] = _IN_TERM[128:] = True


def term_pointers(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where terms begin, their bytes and their document. text: lower-cased bytes; starts: where documents begin."""
    inside = _IN_TERM[text]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(text))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return at, end - at, np.searchsorted(starts, at, "right") - 1


def _keys(windows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes as a number, zero beyond the term's end (no term holds a zero byte)."""
    key = windows[at].view(">u8").ravel().astype(np.uint64)
    drop = (8 * np.clip(8 - left, 0, 8)).astype(np.uint64)
    return np.where(drop >= 64, np.uint64(0), (key >> (drop % 64)) << (drop % 64))


def multikey_sort(text: np.ndarray, at: np.ndarray, length: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """The order of terms by their bytes, and where in it each run of equal terms begins.

    text has eight bytes more than the terms need."""
    windows = np.lib.stride_tricks.sliding_window_view(text, 8)
    order = np.arange(len(at))
    runs = np.zeros(len(at), bool)
    keys = _keys(windows, at, length) if len(at) else np.zeros(0, np.uint64)
    todo = [(0, len(at), 0)] if len(at) else []
    while todo:
        a, b, depth = todo.pop()
        here, key = order[a:b].copy(), keys[a:b].copy()
        if b - a <= small and length[here].max() <= depth + 8 * 16:
            width = max(1, int(length[here].max()) - depth)
            across = np.arange(width)
            rest = np.where(across < (length[here] - depth)[:, None], text[np.minimum((at[here] + depth)[:, None] + across, len(text) - 1)], 0).astype(np.uint8)
            rest = np.ascontiguousarray(rest).view(f"S{width}").ravel()
            by = np.argsort(rest, kind="stable")
            order[a:b], rest = here[by], rest[by]
            runs[a] = True
            runs[a + 1 : b] = rest[1:] != rest[:-1]
            continue
        pivot = np.partition(key[:: max(1, len(key) // 63)], len(key[:: max(1, len(key) // 63)]) // 2)[len(key[:: max(1, len(key) // 63)]) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        n, m = int(less.sum()), int(same.sum())
        order[a:b] = np.concatenate([here[less], here[same], here[more]])
        keys[a : a + n], keys[a + n + m : b] = key[less], key[more]
        if n:
            todo.append((a, a + n, depth))
        if a + n + m < b:
            todo.append((a + n + m, b, depth))
        if int(pivot) & 255 == 0:  # the terms end here: a run
            runs[a + n] = True
        else:
            equal = order[a + n : a + n + m]
            keys[a + n : a + n + m] = _keys(windows, np.minimum(at[equal] + depth + 8, len(text) - 8), length[equal] - depth - 8)
            todo.append((a + n, a + n + m, depth + 8))
    return order, np.flatnonzero(runs)


def count_shard(text: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each (group, term): the group, occurrences, documents, and the terms. group: of each document, a number."""
    at, length, doc = term_pointers(text, starts)
    text = np.concatenate([text, np.zeros(8, np.uint8)])
    order, begin = multikey_sort(text, at, length)
    run = np.zeros(len(at), np.int64)
    run[begin] = 1
    run = np.cumsum(run) - 1
    in_doc, n = np.unique(run * (len(starts) + 1) + doc[order], return_counts=True)  # a run's documents
    of_run, of_doc = np.divmod(in_doc, len(starts) + 1)
    most = int(group.max(initial=0)) + 1
    in_group, where, docs = np.unique(of_run * most + group[of_doc], return_inverse=True, return_counts=True)
    occurrences = np.bincount(where, weights=n, minlength=len(in_group)).astype(np.int64)
    of_run, of_group = np.divmod(in_group, most)
    first = order[begin]
    size = length[first]
    offsets = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(at[first] - offsets[:-1], size) + np.arange(offsets[-1])
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[source].tobytes()))
    return of_group, occurrences, docs, terms.take(pa.array(of_run)).cast(pa.string())


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard: int = SHARD) -> DataFrame:
    """(``lang``, ``source``, ``term``, ``n``, ``docs``) of all documents, added up. An empty term stands for the group itself."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches, shard):
            keys = pd.MultiIndex.from_arrays([table.column(0).to_pandas(), table.column(1).to_pandas()])
            group, names = pd.factorize(keys)
            column = table.column(2).cast(pa.large_string()).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            own, n, documents, terms = count_shard(_LOWER[raw], offsets[:-1] - offsets[0], group)
            langs, sources = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
            own = pa.array(np.concatenate([np.arange(len(names)), own]))
            zeros = np.zeros(len(names), np.int64)
            out = [langs.take(own), sources.take(own), pa.concat_arrays([pa.array([""] * len(names), pa.string()), terms]), pa.array(np.concatenate([zeros, n])), pa.array(np.concatenate([zeros, documents]))]
            out = pa.RecordBatch.from_arrays(out, ["lang", "source", "term", "n", "docs"])
            yield from (out.slice(k, 20_000) for k in range(0, len(out), 20_000))

    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.Table]:
    """The documents of a task, in tables of about ``shard`` bytes of text; a longer text is one alone."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(batch):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + shard - size, "right")))
            held.append(batch.slice(a, b - a))
            size += int(ends[min(b, len(batch)) - 1] - before)
            a = b
            if size >= shard or a < len(batch):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _share(n, total, kept) -> Column:
    """1 + floor(UNIT (n + 1) / (total + kept)), exact at any size."""
    of = F.col(total).cast("decimal(19,0)") + F.col(kept).cast("decimal(17,0)")
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (F.col(n).cast("decimal(19,0)") + 1), of)).cast("long")


def _pair_sums(slice_: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """For each ordered pair of the language's sources, what the slice's terms add to its sum."""
    columns = ["lang", "source", "item", "value"]
    if not len(sources):
        return pd.DataFrame(columns=columns)
    names = np.sort(sources.source.to_numpy(object))
    total = sources.set_index("source").total.reindex(names).to_numpy(np.int64)
    kept = int(sources.kept.iloc[0])
    sums = np.zeros((len(names), len(names)), np.int64)
    if len(slice_):
        term, terms = pd.factorize(slice_.term)
        at = pd.Index(names).get_indexer(slice_.source)
        wide = int(slice_.n.max()) + 1 > (1 << 63) // UNIT - 1
        step = max(1, (1 << 20) // len(names))
        order = np.argsort(term, kind="stable")
        term, at, n = term[order], at[order], slice_.n.to_numpy(np.int64)[order]
        for a in range(0, len(terms), step):
            here = slice(*np.searchsorted(term, [a, a + step]))
            count = np.zeros((min(step, len(terms) - a), len(names)), object if wide else np.int64)
            count[term[here] - a, at[here]] = n[here]
            p = (1 + UNIT * (count + 1) // (total + kept)).astype(np.int64)
            for k in range(len(names)):
                gap = p[:, k, None] - p
                sums[k] += (gap * gap // p).sum(0)
    row, other = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": sources.lang.iloc[0], "source": names[row], "item": names[other], "value": sums[row, other]})


def audit_sources(docs: DataFrame, least_docs: int = 3, ranks: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shard: int = SHARD, slice_: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank.

    A language keeps the terms in at least ``least_docs`` of its documents. Part ``pair`` has every other source of the language,
    part ``term`` the ``ranks`` kept terms that the source uses most above its language."""
    counts = settled(term_counts(docs, text_col, lang_col, source_col, shard), "counts")
    by_term = Window.partitionBy("lang", "term")
    kept = counts.filter("term != ''").withColumn("in_docs", F.sum("docs").over(by_term)).withColumn("lang_n", F.sum("n").over(by_term)).withColumn("first", F.row_number().over(by_term.orderBy("source")) == 1)
    kept = settled(kept.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = settled(groups.withColumn("slices", F.greatest(F.ceil(F.col("kept") / slice_), F.lit(1)).cast("int")), "groups")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept")).withColumn("q", _share("lang_n", "lang_total", "kept")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= ranks)

    number = groups.select("lang", "slices").distinct()
    cut = kept.join(number, "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"))
    lists = groups.select("lang", "source", "total", "kept", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    sums = cut.groupBy("lang", "slice").cogroup(lists.groupBy("lang", "slice")).applyInPandas(_pair_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    out = terms.unionByName(pairs.withColumn("rank", F.row_number().over(best)))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
