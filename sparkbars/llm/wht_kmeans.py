"""Centroid clustering: nearest centroids by a Walsh-Hadamard progressive search in exact integers.

A vector of 64 components becomes integers, floor(1024 x), and these their 64 Walsh-Hadamard coefficients in order of sign
changes, coarse ones first. Squared distances between coefficients are 64 times those between vectors, and a sum over the first
coefficients never exceeds the whole. So a task adds up coefficient differences in blocks from coarse to fine: the centroid that
looks nearest after the coarse ones is finished, those whose sum is then strictly more are given up, and what is left is finished
over all 64. Nothing is rounded, so the result is that of comparing all.

The table is written once as coefficients. A round is one pass over it: each task gets the centroids (``k`` x 64 numbers, the
bound of what goes to and from the driver) and returns a sum for each of them; rows don't shuffle.

Rows whose vector is null, has another length or null or non-finite components take no part; neither do those with a component
beyond ``MOST`` / 1024 in size, whose squared distances may not fit a long. Repeated rows count each. A null id stands for an
empty one in the draw of the start. Equal distances go to the smaller number. Fewer vectors than ``k`` give as many centroids,
none give an empty result. A sum that does not fit a long is null. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

DIM, SCALE = 64, 1024
#: The largest integer component: 64 squared differences of up to twice as much fit a long.
MOST = 1 << 27
#: Ends of the blocks of coefficients, coarse to fine; after the second a centroid is finished.
BLOCKS = (1, 4, 16, DIM)
#: Coefficients up to this size are compared in 64-bit integers, others in Python's.
NARROW = 1 << 27


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row (64 integers), in natural order. Applied twice it gives 64 times the row."""
    h = 1
    while h < DIM:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(len(x), DIM)


#: Natural order to order of sign changes.
BY_CHANGES = np.argsort((np.diff(hadamard(np.eye(DIM, dtype=np.int64)), axis=1) != 0).sum(1), kind="stable")


def coefficients(x: np.ndarray) -> np.ndarray:
    return hadamard(x)[:, BY_CHANGES]


def components(c: np.ndarray) -> np.ndarray:
    """Of coefficients (or sums of them) the integers that have them."""
    natural = np.empty_like(c)
    natural[:, BY_CHANGES] = c
    return hadamard(natural) // DIM


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of coefficients the nearest centroid (ties: the smaller number), its squared distance between the vectors,
    and how many squared differences were added up in all."""
    wide = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > NARROW
    x, centroids = (a.astype(object if wide else np.int64) for a in (x, centroids))
    n, k = len(x), len(centroids)
    added = 0

    def part(row: np.ndarray, centroid: np.ndarray, a: int, b: int) -> np.ndarray:
        nonlocal added
        added += len(row) * (b - a)
        return ((x[row, a:b] - centroids[centroid, a:b]) ** 2).sum(1)

    row, centroid = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    so_far = part(row, centroid, 0, BLOCKS[1]).reshape(n, k)
    first = so_far.argmin(1) if n else np.zeros(0, int)
    bound = so_far[np.arange(n), first] + part(np.arange(n), first, BLOCKS[1], DIM)
    so_far = so_far.ravel()
    for a, b in zip(BLOCKS[1:], BLOCKS[2:]):
        left = so_far <= bound[row]  # strictly worse ones go
        row, centroid, so_far = row[left], centroid[left], so_far[left]
        so_far = so_far + part(row, centroid, a, b)
    order = np.lexsort((centroid, so_far.astype(np.int64) if not wide else _ranks(so_far), row))
    row, centroid, so_far = row[order], centroid[order], so_far[order]
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, int)
    return centroid[at], (so_far[at] // DIM).astype(np.int64), added


def _ranks(values: np.ndarray) -> np.ndarray:
    place = {v: k for k, v in enumerate(sorted(set(values.tolist())))}
    return np.array([place[v] for v in values.tolist()], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def coefficient_table(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``id``, ``c``: coefficients) of the rows that take part, written once."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST / SCALE)).alias("fine"))
    rows = rows.filter(F.col("fine") & (F.size("v") == DIM) & fine).select("id", F.transform("v", lambda x: x.cast("long")).alias("v"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = coefficients(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, DIM, dtype=np.int32)), pa.array(c.ravel()))], ["id", "c"])

    return settled(rows.mapInArrow(transform, "id long, c array<long>"), "coefficients")


def _round(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids' components: floor of the mean of each one's vectors; one without any stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), DIM), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            c = _matrix(batch.column(0))
            cluster = nearest_centroid(c, centroids)[0]
            count += np.bincount(cluster, minlength=len(centroids))
            for k in np.unique(cluster):
                total[k] += c[cluster == k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = rows.select("c").mapInArrow(sums, "cluster int, n long, total array<long>")
    exact = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), object)
    for r in exact.collect():  # k x 64 rows
        total[r.cluster, r["at"]], count[r.cluster] = int(r.x), r.n
    new = components(total) // np.where(count == 0, 1, count)[:, None]
    return np.where((count == 0)[:, None], components(centroids.astype(object)), new)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: k-means of a fixed number of rounds.

    It starts from the ``k`` vectors with the smallest sha256 of ``seed:id``, in that order."""
    spark = vectors.sparkSession
    rows = coefficient_table(vectors, id_col, vector_col)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = rows.select(draw.alias("draw"), "c").orderBy("draw", "c").limit(k).collect()
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], kind)
    centroids = np.array([r.c for r in start], np.int64)
    for _ in range(rounds):
        centroids = coefficients(_round(rows, centroids)).astype(np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _ = nearest_centroid(_matrix(batch.column(1)), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = settled(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.x) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in components(centroids).tolist()]
    of_cluster = spark.createDataFrame([(c, fits(x), fits(sum(inertia.values())), digest[c]) for c, x in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
