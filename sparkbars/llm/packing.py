"""Order-preserving packing of token streams into windows, by dynamic programming.

Each task packs its documents in the order in which it reads them, so nothing shuffles. Cuts may fall after a document,
after a sentence, or, where neither comes for ``GAP`` tokens, within one. The programme chooses the cuts whose padding
and penalties add up to the least; the best cut before each is found with a monotone queue, as a window's padding is
linear in where it begins. Windows of a power of two need no padding, and cost ``SHORT`` instead.

A cut within a document costs as little as ``SENTENCE`` tokens of padding, so a document is rather cut after a sentence
than padded, even one that would fit a window alone; a higher penalty keeps more documents whole and pads more.

Null text counts as empty: such a document is its closing id alone. Repeated rows are packed as often as they come. Of
cuts that cost the same the window that is filled first wins. Empty tables give empty results. Other columns may have any
name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Penalties, in tokens of padding: a cut after a sentence, one within a sentence, a window of a power of two.
SENTENCE, INSIDE, SHORT = 4.0, 48.0, 32.0
#: No two possible cuts are further apart.
GAP = 128
POWERS = (64, 128, 256, 512, 1024)
#: Tokens that are planned at once; the last window is planned again with those that follow.
PLANNED = 96 * WINDOW

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


Encode = Callable[[list[str | None]], list[np.ndarray]]


def best_cuts(places: Sequence[int], penalties: Sequence[float], window: int = WINDOW, powers: Sequence[int] = POWERS, short: float = SHORT) -> tuple[list[int], float]:
    """Of ``places`` (increasing, the first where the stream begins, the last where it ends), those to cut at, both ends
    included, and what they cost: the padding of each window, or ``short``, and the penalty of each cut."""
    n = len(places)
    best, back, key, at = [0.0] * n, [0] * n, [0.0] * n, dict(zip(places, range(n)))
    queue: deque[int] = deque()
    for j in range(1, n):
        i = j - 1
        key[i] = v = best[i] + places[i]
        while queue and key[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
        here = places[j]
        while places[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - here
        for p in powers:
            k = at.get(here - p)
            if k is not None and best[k] + short < cost:
                cost, i = best[k] + short, k
        best[j], back[j] = cost + penalties[j], i
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(places[j])
        j = back[j]
    return [places[0], *reversed(cuts)], best[-1]


def _possible(ids: np.ndarray, bounds: np.ndarray, ends: np.ndarray, gap: int) -> tuple[list[int], list[float]]:
    """Places to cut and their penalties. bounds: where documents or parts of them end."""
    sentence = np.flatnonzero(ends[ids]) + 1
    known = np.unique(np.concatenate([[0], sentence, bounds]))
    steps = np.diff(known)
    wide = np.flatnonzero(steps > gap)
    inside = [np.arange(known[k] + gap, known[k + 1], gap) for k in wide]
    places = np.unique(np.concatenate([known, *inside]))
    penalties = np.full(len(places), INSIDE)
    penalties[np.searchsorted(places, sentence)] = SENTENCE
    penalties[np.searchsorted(places, bounds)] = 0.0
    return places.tolist(), penalties.tolist()


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], ends: np.ndarray, first_id: int = 0, window: int = WINDOW, planned: int = PLANNED) -> Iterator[dict[str, list]]:
    """Columns of pieces. docs: id and token ids of each document, in order; held are about ``planned`` tokens and one document."""
    sequence = first_id
    parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, tokens of the document, ids
    held = 0

    def emit(last: bool) -> dict[str, list]:
        nonlocal parts, held, sequence
        ids = np.concatenate([p[3] for p in parts])
        bounds = np.cumsum([len(p[3]) for p in parts])
        cuts, _ = best_cuts(*_possible(ids, bounds, ends, GAP), window)
        if not last and len(cuts) > 2:
            cuts.pop()
        out: dict[str, list] = {name: [] for name in PIECES.names}
        edges = np.unique(np.concatenate([cuts, bounds[bounds < cuts[-1]]])).tolist()
        starts, raw, k, w = [0, *bounds.tolist()], memoryview(ids.tobytes()), 0, 0
        for a, b in zip(edges, edges[1:]):
            while starts[k + 1] <= a:
                k += 1
            while cuts[w + 1] <= a:
                w += 1
            doc_id, begun, tokens, _ = parts[k]
            for name, value in zip(PIECES.names, (doc_id, begun + a - starts[k], b - a, zlib.crc32(raw[4 * a : 4 * b]), tokens, sequence + w, a - cuts[w])):
                out[name].append(value)
        sequence += len(cuts) - 1
        k = bisect_left(starts, cuts[-1] + 1) - 1
        rest = [(parts[k][0], parts[k][1] + cuts[-1] - starts[k], parts[k][2], parts[k][3][cuts[-1] - starts[k] :]), *parts[k + 1 :]] if cuts[-1] < len(ids) else []
        parts, held = rest, len(ids) - cuts[-1]
        return out

    for doc_id, ids in docs:
        parts.append((doc_id, 0, len(ids), ids))
        held += len(ids)
        if held >= planned:
            yield emit(False)
    while parts:
        yield emit(True)


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def pack_documents(docs: DataFrame, encoder: Callable[[], tuple[Encode, np.ndarray]], end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    encoder: gives, in a task, a function from texts to their ids and a table of ids that may end a sentence.
    Sequence ids are unique over all tasks: the task's number in the upper bits, a count in the lower 33.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, ends = encoder()
        ends = ends.copy()
        ends[end_id] = False
        close = np.array([end_id], "<u4")
        docs = ((i, np.concatenate([ids, close])) for batch in batches for part in _parts(batch) for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())))
        for columns in pack_stream(docs, ends, TaskContext.get().partitionId() << 33, window):
            yield pa.RecordBatch.from_pydict(columns, PIECES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def word_bpe_encoder(path: str) -> Callable[[], tuple[Encode, np.ndarray]]:
    def ready():
        from .wordbpe import word_bpe

        bpe = word_bpe(path)
        return bpe.ids, bpe.ends

    return ready
