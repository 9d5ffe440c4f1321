"""Near duplicates by SimHash and a Gray-order hierarchical index.

The upper nodes of the index are cells of fingerprints that share a masked bit pattern; Spark deals these out. Within a
cell, fingerprints are sorted by Gray rank and cut into nodes. A node has a mask of the bits in which its fingerprints
agree, and their pattern there. A search adds up the differences to the nodes' patterns on its way down and leaves
whole groups out as soon as they exceed the limit. A cell of more than ``CELL`` fingerprints is dealt to pairs of its
parts, so that no task gets more than two parts and no link is lost. Equal fingerprints are one entry.

``near_duplicates`` links 64-bit fingerprints within two bits: such a pair agrees in two of four blocks of 16 bits, which
make six masks of 32 bits, so the result is exact, and a cell stays small up to some 2**32 different fingerprints.

``drop_near_duplicates`` is for shingles of five words and a similarity (Jaccard, of distinct shingles) of 0.8. There
distances are much larger, so candidates come from 1024-bit fingerprints of the distinct shingles (two texts of similarity
J differ in about acos(2J / (1 + J)) / pi of the bits, and the more bits, the closer to that), in cells of texts whose
smallest shingles agree under the hashes of a band. Two texts agree in a band with chance J ** ROWS, whichever words
differ and however large the table is, and there are so many bands that a pair at 0.8 shares none with chance MISSED.
What candidate links connect is compared again by the shingles themselves: pairs at 0.8 or more are linked, others not.

Null and empty texts have fingerprint zero. A document of fewer words than a shingle has its whole sequence as one.
Repeated rows have equal fingerprints, and so one component. A null doc_id takes no part in choosing the smallest, but
such a row can be dropped for another. Empty tables give empty results. Other columns may have any name.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import among, settled

BITS = 64
#: Blocks of bits, by their lowest bit and width; two differing bits leave two of four alone. Masks are pairs of blocks.
BLOCKS = ((48, 16), (32, 16), (16, 16), (0, 16))
MASKS = tuple(sum(((1 << width) - 1) << low for low, width in pair) for pair in itertools.combinations(BLOCKS, 2))
#: Fingerprints in a part of a large cell, and in a node of the index.
CELL, NODE = 2048, 16
#: For ``drop_near_duplicates``: 64-bit words of a code; differing bits of candidates (155 on average at 0.8, 190 are three
#: standard deviations more); distinct shingles of a part of a large group, and of a row that carries them.
CODE_WORDS, CODE_LIMIT, PART_SHINGLES, ROW_SHINGLES = 16, 190, 1 << 20, 1024
#: The similarity that copies have at least, the hashes of a band, the chance that copies share no band, and so the bands.
SIMILARITY, ROWS, MISSED = 0.8, 5, 0.002
BANDS = math.ceil(math.log(MISSED) / math.log(1 - SIMILARITY**ROWS))
#: Each row's hash of a shingle's hash h is ``_ODD * h + _ADD`` (mod 2**64).
_ODD, _ADD = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def _majority(h: np.ndarray) -> np.ndarray:
    """For each row of 64-bit hashes, the bits that are set in over half of them, as one number."""
    rows, n = h.shape
    ones = np.zeros((rows, BITS), np.int64)
    for part in range(0, n, 4080):  # bounded memory for long texts
        some = np.ascontiguousarray(h[:, part : part + 4080]).astype(">u8")
        bits = np.unpackbits(some.view(np.uint8)).view(np.uint64).reshape(rows, -1, 8)  # eight bits in the bytes of a number
        counts = np.add.reduceat(bits, np.arange(0, some.shape[1], 255), axis=1)  # up to 255 of these add up without a carry
        ones += counts.view(np.uint8).reshape(rows, -1, BITS).sum(1, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1).view(">u8").astype(np.uint64)[:, 0]


def _words(text: str | None) -> list[bytes]:
    """Runs of bytes other than white space (as ``bytes.split`` has it), A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(parts) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in parts], np.uint64)


def _shingles(w: list[bytes], words: int):
    return map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]


def simhash(text: str | None, words: int = 3) -> int:
    w = _words(text)
    return int(_majority(_hashes(_shingles(w, words))[None])[0]) if w else 0


def _mixed(h: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Other 64 bits from the same hash (a finalizer with an odd step added)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15) * np.asarray(k, np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def band_keys(h: np.ndarray) -> np.ndarray:
    """For each band, one number of its rows' smallest hashes over the hashes ``h``."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(h), 1 << 12):  # bounded memory for long texts
        least = np.minimum(least, (_ODD * h[part : part + (1 << 12)] + _ADD).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys ^ row, 1)
    return keys


def wide_simhash(text: str | None, words: int = 5) -> tuple[list[int], list[int]]:
    """1024 bits of the distinct shingles, and their key in each band, as signed 64-bit numbers."""
    w = _words(text)
    if not w:
        return [0] * CODE_WORDS, [0] * BANDS
    h = _hashes(set(_shingles(w, words)))
    code = _majority(_mixed(h, np.arange(1, CODE_WORDS + 1)[:, None]))
    return code.view(np.int64).tolist(), band_keys(h).view(np.int64).tolist()


def with_fingerprint(docs: DataFrame, words: int = 3, text_col: str = "text", to: str = "__fp") -> DataFrame:
    """``docs`` with its fingerprint as a long (the same 64 bits, signed)."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(to, fingerprint(F.col(text_col)))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the binary-reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class GrayIndex:
    """Codes (n rows of 64-bit words) in Gray order, under levels of nodes: mask of agreed bits, pattern."""

    def __init__(self, codes: np.ndarray, node: int = NODE):
        self.order = np.argsort(gray_rank(codes[:, 0]), kind="stable")
        self.codes, self.node = codes[self.order], node
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves' parents up
        both, some = self.codes, self.codes
        while len(both) > node:
            at = np.arange(0, len(both), node)
            both, some = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(some, at)
            self.levels.append((~(both ^ some), both))

    def search(self, code: np.ndarray, limit: int, live: np.ndarray) -> np.ndarray:
        """Places (in Gray order) of live codes within ``limit`` bits of ``code``."""
        sizes = [len(self.codes), *(len(mask) for mask, _ in self.levels)]
        found = np.arange(sizes[-1])
        counted, apart = np.zeros((len(found), code.shape[0]), np.uint64), np.zeros(len(found), np.int64)
        for level in range(len(self.levels), 0, -1):
            mask, pattern = (x[found] for x in self.levels[level - 1])
            apart = apart + np.bitwise_count((pattern ^ code) & mask & ~counted).sum(-1, dtype=np.int64)  # bits that agree here, not yet above
            keep = apart <= limit
            below = (found[keep, None] * self.node + np.arange(self.node)).ravel()
            counted, apart = np.repeat(mask[keep], self.node, 0), np.repeat(apart[keep], self.node)
            there = below < sizes[level - 1]
            found, counted, apart = below[there], counted[there], apart[there]
        found = found[live[found]]
        return found[_differ(self.codes[found], code) <= limit]


def spanning_links(codes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (places in ``codes``) of a spanning forest of all pairs within ``limit`` bits: fewer than there are codes."""
    if len(codes) == 2:
        return [(0, 1)] if _differ(codes[0], codes[1]) <= limit else []
    index = GrayIndex(codes)
    live, links = np.ones(len(codes), bool), []
    for root in range(len(codes)):
        if not live[root]:
            continue
        live[root], todo = False, [root]
        while todo:
            at = todo.pop()
            near = index.search(index.codes[at], limit, live)
            live[near] = False
            links += [(int(index.order[at]), int(index.order[x])) for x in near]
            todo += near.tolist()
    return links


def near_links(entries: DataFrame, limit: int, cell: int = CELL) -> DataFrame:
    """Links (``a``, ``b``: representatives) that connect what pairs within ``limit`` bits in a common cell connect.

    entries: ``mask`` (number of the mask), ``value`` (the pattern under it), ``rep`` (long), ``code`` (array<long>); a
    row for each cell that a distinct code is in.
    """
    large = entries.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    large = large.select("mask", "value", F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("parts"))
    entries = entries.join(large, ["mask", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a large cell: part i goes to the pairs (i, j) and (j, i), so each two parts meet once
    entries = entries.withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j")))
    entries = entries.select("mask", "value", F.explode(pairs).alias("pair"), "rep", "code").select("mask", "value", "pair.i", "pair.j", "rep", "code")
    entries = entries.repartition("mask", "value", "i", "j").sortWithinPartitions("mask", "value", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            out: list[tuple[int, int]] = []
            starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(rows)]])
            for k in np.flatnonzero(stops - starts > 1):
                part = rows[starts[k] : stops[k]]
                reps = part[:, 4]
                out += [(int(reps[x]), int(reps[y])) for x, y in spanning_links(part[:, 5:].view(np.uint64), limit)]
            return pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.asarray(pa.array(batch.column(5)).flatten()).reshape(batch.num_rows, -1)
            held.append(np.column_stack([*(np.asarray(c).astype(np.int64) for c in batch.columns[:5]), codes]))
            if (held[-1][0, :4] == held[-1][-1, :4]).all() and len(held) < 64:
                continue  # all in one cell, which may go on
            rows = np.concatenate(held)
            new = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))  # all before the last, open cell
            cut = int(new[-1]) + 1 if len(new) else 0
            held = [rows[cut:]]
            if cut:
                yield links(rows[:cut])
        if held:
            yield links(np.concatenate(held))

    return entries.mapInArrow(task, "a long, b long")


def mask_cells(fp: str) -> Column:
    """array<struct<mask, value>>: the cells of a fingerprint, by number of the mask and the pattern under it."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in MASKS]
    return F.array(*(F.struct(F.lit(k).cast("long").alias("mask"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(signed)))


def exact_links(doc: np.ndarray, shingles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs of documents of at least ``similarity``. doc: whose (from 0) each of the
    shingles is; a document has none twice."""
    size = np.bincount(doc)
    _, shingle = np.unique(shingles, return_inverse=True)
    shared = np.bincount(shingle)[shingle] > 1
    doc, shingle = doc[shared], shingle[shared]
    order = np.argsort(doc, kind="stable")
    doc, shingle = doc[order], shingle[order]
    edges = np.searchsorted(doc, np.arange(len(size) + 1))
    mark, live, links = np.zeros(shingle.max(initial=-1) + 1, bool), np.ones(len(size), bool), []
    for root in range(len(size)):
        if not live[root]:
            continue
        live[root], todo = False, [root]
        while todo and live.any():
            at = todo.pop()
            own = shingle[edges[at] : edges[at + 1]]
            mark[own] = True
            both = np.bincount(doc[mark[shingle]], minlength=len(size))
            mark[own] = False
            near = np.flatnonzero(live & (both > 0) & (both >= similarity * (size + size[at] - both)))
            live[near] = False
            links += [(at, int(x)) for x in near]
            todo += near.tolist()
    return links


def verified_links(members: DataFrame, similarity: float = SIMILARITY, most: int = PART_SHINGLES, cell: int = CELL) -> DataFrame:
    """Links (``a``, ``b``) that connect what pairs of at least ``similarity`` within a group connect.

    members: ``component`` (the group), ``rep`` (long), ``h`` (array<long>: its distinct shingles' hashes). A group of more
    than ``cell`` members or ``most`` shingles is dealt to pairs of its parts.
    """
    sizes = settled(members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("h")).alias("w")).filter("n > 1"), "sizes")
    parts = F.greatest(F.ceil(F.col("n") / F.lit(cell)), F.ceil(F.col("w") / F.lit(most))).cast("int")
    rows = members.join(sizes, "component").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / F.lit(ROW_SHINGLES)).cast("int")), lambda k: F.slice("h", k * ROW_SHINGLES + 1, ROW_SHINGLES))
    rows = rows.filter(F.size("h") > 0).select("component", F.explode(pairs).alias("pair"), "rep", pieces.alias("pieces")).select("component", "pair.i", "pair.j", "rep", F.explode("pieces").alias("h"))
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps, held = [], [], []  # of the group that is open

        def links() -> pa.RecordBatch:
            names, doc = np.unique(np.concatenate([np.repeat(r, len(h)) for r, h in zip(reps, held)]), return_inverse=True)
            out = exact_links(doc, np.concatenate(held), similarity) if len(names) > 1 else []
            return pa.RecordBatch.from_pydict({"a": [int(names[x]) for x, _ in out], "b": [int(names[y]) for _, y in out]}, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([np.asarray(c).astype(np.int64) for c in batch.columns[:3]])
            rep, lists = np.asarray(batch.column(3)), batch.column(4)
            flat, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))
            for k in range(batch.num_rows):
                if keys and (key[k] != keys[-1]).any():
                    yield links()
                    keys, reps, held = [], [], []
                keys[:] = [key[k]]
                reps.append(rep[k])
                held.append(flat[ends[k - 1] if k else 0 : ends[k]])
        if held:
            yield links()

    return rows.mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    if limit > len(BLOCKS) - 2:
        raise ValueError("pairs of four blocks find pairs within two bits")
    rows = settled(with_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words, "text", "fp").select("doc_id", "fp"), "fingerprints")
    prints = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "prints")
    entries = prints.filter("rep IS NOT NULL").select(F.explode(mask_cells("fp")).alias("cell"), "rep", F.array("fp").alias("code")).select("cell.mask", "cell.value", "rep", "code")
    found = components(near_links(entries, limit))
    labels = prints.join(found, prints["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``n``, ``doc_id``, ``row``): written with a number for each row, so that decisions hold for that row alone."""
    return settled(docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row")), "numbered")


def _grouped(kept: DataFrame, words: int, limit: int, similarity: float, text_col: str) -> DataFrame:
    """(``n``, ``doc_id``, ``group``) of rows (``n``, ``doc_id``, ``row``): near duplicates have one group."""

    @F.pandas_udf("struct<code: array<long>, bands: array<long>>")
    def wide(texts: pd.Series) -> pd.DataFrame:
        pairs = [wide_simhash(t, words) for t in texts]
        return pd.DataFrame({"code": [a for a, _ in pairs], "bands": [b for _, b in pairs]})

    @F.pandas_udf("array<long>")
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([_hashes(set(_shingles(w, words))).view(np.int64) if (w := _words(t)) else np.zeros(0, np.int64) for t in texts])

    text = F.col("row")[text_col]
    rows = settled(kept.select("n", "doc_id", wide(text).alias("w")).select("n", "doc_id", "w.code", "w.bands"), "wide")
    # texts of one code have all but the same shingles, and so the same bands
    prints = settled(rows.groupBy("code").agg(F.min("n").alias("rep"), F.min_by("bands", "n").alias("bands")), "prints")
    entries = prints.select(F.posexplode("bands").alias("mask", "value"), "rep", "code").select(F.col("mask").cast("long").alias("mask"), "value", "rep", "code")
    candidates = settled(components(near_links(entries, limit)), "candidates")
    members = candidates.select(F.col("node").alias("rep"), "component").union(candidates.select("component", "component").distinct())
    members = settled(members, "members")
    _, maybe = among(kept.select("n", text.alias("text")), "n", settled(members.select(F.col("rep").alias("n")), "linked"))
    texts = maybe.join(members, maybe["n"] == members["rep"])
    found = components(verified_links(settled(texts.select("component", "rep", shingled("text").alias("h")), "shingles"), similarity))
    labels = prints.join(found, prints["rep"] == found["node"], "left").select("code", F.coalesce("component", "rep").alias("group"))
    return settled(rows.join(labels, "code").select("n", "doc_id", "group"), "groups")


def _first(rows: DataFrame) -> DataFrame:
    """(``group``, ``first``): of groups of several rows, the row that stays: the smallest doc_id, null ones last."""
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first")).filter("rows > 1").select("group", "first")


def near_groups(docs: DataFrame, words: int = 5, limit: int = CODE_LIMIT, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, component_id (the smallest doc_id of its group of near duplicates)."""
    rows = _grouped(_numbered(docs, id_col, text_col), words, limit, similarity, text_col)
    return rows.join(_first(rows), "group", "left").select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, limit: int = CODE_LIMIT, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, but of each group of near duplicates the one with the smallest doc_id alone."""
    kept = _numbered(docs, id_col, text_col)
    rows = _grouped(kept, words, limit, similarity, text_col)
    gone = settled(rows.join(_first(rows), "group").filter("n != first.n").select("n"), "gone")
    stay, maybe = among(kept.select("n", "row"), "n", gone)
    return stay.unionByName(maybe.join(gone, "n", "left_anti")).select("row.*")
