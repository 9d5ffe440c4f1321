"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, as flat neighbour arrays.

Equal vectors are one node with the smallest ids of its rows, so that copies don't crowd a graph; a query needs no more
of them than it has places. Nodes are dealt to shards of about ``SHARD``, those of each length apart. A task builds its
shard's graph in growing batches: each batch searches the graph so far, chooses neighbours that are nearer to the new node
than to each other, and links back. A block of up to ``BLOCK`` queries goes to every shard of their length, which gets its
index once for them all; a shard's nearest are scored again in double precision, and the shards' results are merged.

Rows with a null, empty or zero vector, or one with null or non-finite components, take no part; neither do null ids. A
query's candidates are the vectors of its own length, as cosine is defined for no others. Repeated rows count once. Of
different vectors under one id, the one whose digest is smallest stands for it. Ties go to the smaller id. Empty tables
give empty results. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Vectors of a shard; queries of a block; neighbours on upper levels (twice as many on the lowest); beam widths.
SHARD, BLOCK, LINKS, BUILD_BEAM, SEARCH_BEAM = 32_768, 65_536, 16, 64, 128
#: Rows of equal vectors are cut to their smallest ids in so many parts first.
SALTS = 64


def _dots(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarities of each row of nodes to the row's query."""
    return np.matmul(x[nodes], q[:, :, None])[:, :, 0]


def _search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step. Returns nodes (-1: none) and similarities, nearest first.

    links: neighbours of each node, -1 where there are fewer. entries: a start for each query, or several.
    """
    n, m = len(q), links.shape[1]
    rows = np.arange(n)
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # where -1 points
    entries = entries.reshape(n, -1)
    node = np.full((n, beam), -1)
    sim = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    first = entries[:, :beam]
    node[:, : first.shape[1]] = first
    sim[:, : first.shape[1]] = _dots(x, first, q)
    done[:, : first.shape[1]] = False
    seen[rows[:, None], first] = True
    active = rows
    while len(active):
        s = np.where(done[active], -np.inf, sim[active])
        pick = np.argpartition(-s, wide - 1, axis=1)[:, :wide] if beam > wide else np.argsort(-s, axis=1)
        open_ = np.take_along_axis(s, pick, 1) > -np.inf
        more = open_.any(1)
        active, pick, open_ = active[more], pick[more], open_[more]
        if not len(active):
            break
        done[active[:, None], pick] = True
        near = np.where(open_[:, :, None], links[node[active[:, None], pick]], -1).reshape(len(active), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], near]] = -1
        seen[active[:, None], near] = True
        fresh = np.where(near >= 0, _dots(x, near, q[active]), -np.inf).astype(np.float32)
        every = np.concatenate([sim[active], fresh], 1)
        keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        node[active] = np.take_along_axis(np.concatenate([node[active], near], 1), keep, 1)
        sim[active] = np.take_along_axis(every, keep, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], near < 0], 1), keep, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    node, sim = np.take_along_axis(node, order, 1), np.take_along_axis(sim, order, 1)
    return np.where(np.isfinite(sim), node, -1), sim


def _diverse(x: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates, up to ``most``: those nearer to the node than to any chosen before, then the nearest."""
    b, c = near.shape
    sim = np.where(near >= 0, _dots(x, near, x[own]), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")
    near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
    v = x[near]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((b, c), bool)
    for k in range(c):
        closer = (np.where(chosen, between[:, k], -np.inf) > sim[:, k, None]).any(1)
        chosen[:, k] = ~closer & (near[:, k] >= 0) & (chosen.sum(1) < most)
    rank = np.argsort(np.where(chosen, 0, 1) + np.where(near >= 0, 0, 2), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, rank, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _link(x: np.ndarray, links: np.ndarray, new: np.ndarray, near: np.ndarray) -> None:
    """Link new nodes to chosen candidates, and these back; full lists are chosen again."""
    most = links.shape[1]
    links[new] = _diverse(x, new, near, most)
    source, target = np.repeat(new, most), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, at, count = np.unique(target, return_index=True, return_counts=True)
    width = int(count.max()) if len(count) else 0
    for part in range(0, len(touched), 2048):
        nodes, begin, k = touched[part : part + 2048], at[part : part + 2048], count[part : part + 2048]
        w = min(width, int(k.max()))
        extra = np.where(np.arange(w) < k[:, None], source[np.minimum(begin[:, None] + np.arange(w), len(source) - 1)], -1)
        every = np.concatenate([links[nodes], extra], 1)
        full = (every >= 0).sum(1) > most
        packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
        links[nodes[~full]] = packed[~full, :most]
        if full.any():
            links[nodes[full]] = _diverse(x, nodes[full], packed[full][:, : most * 3], most)


def build_graph(x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 42) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Levels from the lowest: the nodes of each level, and their flat neighbours (rows of nodes of that level, -1: none).

    x: unit vectors. A level holds a share of 1 / links of the one below.
    """
    order = np.random.default_rng(seed).permutation(len(x))
    levels, flat = [], []
    size, most = len(x), 2 * links
    while True:
        nodes = np.sort(order[:size])
        own = x[nodes]
        near = np.full((size, most), -1)
        begun = 0
        while begun < size:
            batch = np.arange(begun, min(size, begun + max(32, min(512, begun))))
            inside = own[batch] @ own[batch].T
            np.fill_diagonal(inside, -np.inf)
            beside = batch[np.argpartition(-inside, min(most, len(batch)) - 1, axis=1)[:, : min(most, len(batch) - 1)]] if len(batch) > 1 else np.zeros((1, 0), int)
            if begun:
                starts = np.linspace(0, begun - 1, min(8, begun)).astype(int)
                found, _ = _search(own[:begun], near[:begun], own[batch], np.tile(starts, (len(batch), 1)), beam)
                beside = np.concatenate([found, beside], 1)
            _link(own, near, batch, beside)
            begun = int(batch[-1]) + 1
        levels.append(nodes)
        flat.append(near)
        if size <= 4 * links:
            return levels, flat
        size, most = size // links, links


def search_graph(x: np.ndarray, levels: list[np.ndarray], flat: list[np.ndarray], q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest nodes of each query (-1: none) and their similarities: down the levels, wider on the lowest."""
    entries = np.zeros((len(q), 1), int)
    for level in range(len(levels) - 1, -1, -1):
        lowest = level == 0
        own = x[levels[level]]
        width = min(beam if lowest else 8, len(own))
        found, sim = _search(own, flat[level], q, np.where(entries < 0, entries[:, :1], entries), max(width, 1))
        if lowest:
            return found[:, :k], sim[:, :k]
        entries = np.searchsorted(levels[level - 1], levels[level][np.where(found < 0, found[:, :1], found)])
    raise ValueError("a graph has at least one level")


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def build_index(nodes: DataFrame) -> DataFrame:
    """A row for each shard: its vectors and graph. nodes: ``node`` long, ``dim`` and ``shard`` int, ``vector``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        raw = _stacked(pdf.vector)
        levels, flat = build_graph(_unit(raw))
        return pd.DataFrame({
            "dim": [pdf.dim.iloc[0]], "shard": [pdf.shard.iloc[0]], "nodes": [pdf.node.to_numpy()], "vectors": [raw.ravel()],
            "level_sizes": [[len(x) for x in levels]], "level_nodes": [np.concatenate(levels).astype(np.int32)],
            "neighbours": [np.concatenate([x.ravel() for x in flat]).astype(np.int32)], "widths": [[x.shape[1] for x in flat]],
        })

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.groupBy("dim", "shard").applyInPandas(build, f"dim int, shard int, nodes array<long>, vectors {kind}, level_sizes array<int>, level_nodes array<int>, neighbours array<int>, widths array<int>")


def usable(vector) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, one of them not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def one_vector_each(rows: DataFrame) -> DataFrame:
    """``rows`` (id, key) without those whose id also has a smaller key: an id stands for one vector."""
    clash = settled(rows.groupBy("id").agg(F.min("key").alias("own"), F.max("key").alias("other")).filter("own != other").select("id", "own"), "clashes")
    return rows.join(clash, "id", "left").filter("own IS NULL OR key = own").drop("own")


def least_ids(rows: DataFrame, most: int) -> DataFrame:
    """(``node``, ``ids``): for each key its smallest id, and up to ``most`` of its smallest. A key with very many ids is
    cut in ``SALTS`` parts first."""
    part = Window.partitionBy("key", "salt").orderBy("id")
    pairs = rows.groupBy("key", "id").agg(F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    least = pairs.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= most)
    least = least.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("n") <= most)
    return least.groupBy("key").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids")).select("node", "ids")


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine, ties to the smaller vec_id.

    is_query: a condition on ``vectors``. The query's own id is left out, other ids with an equal vector are not.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & usable("vector"))
    plain = F.transform("vector", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 equals 0.0
    rows = settled(rows.withColumn("key", F.sha2(F.array_join(plain, ",").cast("binary"), 256)), "vectors")
    rows = one_vector_each(rows)
    ids = settled(least_ids(rows.select("key", "id"), k + 1), "ids")
    nodes = settled(rows.groupBy("key").agg(F.min("id").alias("node"), F.min_by("vector", "id").alias("vector")).select("node", F.size("vector").alias("dim"), "vector"), "nodes")
    shards = settled(nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("shards")), "shards")
    index = settled(build_index(nodes.join(shards, "dim").select("node", "dim", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), "vector")), "index")

    queries = settled(rows.filter("q").groupBy("id").agg(F.min_by("vector", "key").alias("vector")).withColumn("dim", F.size("vector")), "queries")
    blocks = max(1, -(-queries.count() // block))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.join(shards, "dim").select("id", "vector", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    wanted = k + 1  # one may be the query's own node

    def find(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if not len(index) or not len(queries):
            return parts[0]
        g = index.iloc[0]
        nodes = np.asarray(g.nodes)
        raw = np.asarray(g.vectors).reshape(len(nodes), -1)
        levels, flat, a, b = [], [], 0, 0
        for size, width in zip(g.level_sizes, g.widths):
            levels.append(np.asarray(g.level_nodes[a : a + size], int))
            flat.append(np.asarray(g.neighbours[b : b + size * width], int).reshape(size, width))
            a, b = a + size, b + size * width
        unit = _unit(raw.astype(np.float64))
        for part in range(0, len(queries), 256):
            some = queries.iloc[part : part + 256]
            q = _stacked(some.vector)
            found, _ = search_graph(unit, levels, flat, _unit(q), wanted + 4, beam)
            who, place = np.nonzero(found >= 0)
            at = found[who, place]
            a, b = q[who], raw[at].astype(np.float64)
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            parts.append(pd.DataFrame({"query_id": some.id.to_numpy()[who], "node": nodes[at], "score": score}))
        return pd.concat(parts[1:])

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(find, "query_id long, node long, score double")
    by_node = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    found = found.withColumn("n", F.row_number().over(by_node)).filter(F.col("n") <= wanted).drop("n")
    near = found.join(ids, "node").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(nearest_first).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
