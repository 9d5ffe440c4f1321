"""Token counts of sections by attribution: a document is encoded once, and its tokens are dealt to its sections.

A byte-level BPE covers a text without gaps, so the lengths of the tokens give their byte spans, and these their spans
of characters. The interval join of token spans and section spans is a merge of two sorted lists within a document. A
token that lies in several sections is allocated by the rule named:

* ``first``, ``last``: to the section of its first or last character;
* ``most``: to the section with most of its characters, the earlier one in a tie;
* ``share``: to each section by its share of the characters.

Tokens outside all sections are given as section -1, name null. Null text counts as empty. Sections are cut to the
text and to where the section before them ended; null or empty ones count no tokens. A document without sections (null,
or an empty list) returns section -1 alone. Repeated rows are counted each. Empty tables give empty results. Other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most", "share")
COUNTS = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64()), ("doc_tokens", pa.int64())])
_READY: dict[str, tuple] = {}


def byte_bpe(ranks_path: str, tokenizer_path: str):
    """A function from text to the byte lengths of its tokens; ready once for each worker process."""
    if ranks_path not in _READY:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            widths[k] = len(token)
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(tokenizer_path)  # the same vocabulary, without a limit to the length of a run
        slow.encode_special_tokens = True

        def lengths(text: str) -> np.ndarray:
            try:
                return widths[fast.encode_to_numpy(text)]
            except ValueError:
                return widths[np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)]

        _READY[ranks_path] = (lengths,)
    return _READY[ranks_path][0]


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; one that holds part of a character spans it whole."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        return starts, ends
    first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    char = np.cumsum(first) - 1
    return char[starts], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section [a, b) (sorted, disjoint), how many of those that touch it lie across an edge of it, and
    the tokens outside."""
    n, tokens = len(a), len(starts)
    out, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not tokens:
        return out, crossing, float(tokens)
    lo, hi = np.searchsorted(b, starts, "right"), np.searchsorted(a, ends, "left") - 1  # sections that a token touches
    touch = lo <= hi
    whole = touch & (lo == hi) & (a[np.minimum(lo, n - 1)] <= starts) & (ends <= b[np.minimum(lo, n - 1)])
    out += np.bincount(lo[whole], minlength=n)
    outside = float(np.count_nonzero(~touch))
    for t in np.flatnonzero(touch & ~whole):
        s = np.arange(lo[t], hi[t] + 1)
        over = np.minimum(b[s], ends[t]) - np.maximum(a[s], starts[t])
        crossing[s] += 1
        if rule == "share":
            width = ends[t] - starts[t]
            out[s] += over / width
            outside += 1 - over.sum() / width
            continue
        if rule == "most":
            gap = ends[t] - starts[t] - over.sum()
            k = s[np.argmax(over)] if over.max() >= gap else -1
        elif rule == "first":
            k = s[0] if a[s[0]] <= starts[t] else -1
        else:
            k = s[-1] if ends[t] <= b[s[-1]] else -1
        if k < 0:
            outside += 1
        else:
            out[k] += 1
    return out, crossing, outside


def _lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines, each with the line feed that ends it."""
    edges = [0]
    while (k := text.find("\n", edges[-1])) >= 0:
        edges.append(k + 1)
    if edges[-1] < len(text):
        edges.append(len(text))
    edges = np.array(edges, np.int64)
    return edges[:-1], edges[1:]


def attribute_tokens(docs: DataFrame, ranks_path: str, tokenizer_path: str, rule: str = "most", sections_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each section: doc_id, section (from 0), name, start, end (characters), tokens, crossing, doc_tokens.

    sections_col: array<struct<name string, start, end>>; without it a document's lines are its sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    given = sections_col is not None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = byte_bpe(ranks_path, tokenizer_path)
        for batch in batches:
            parts: dict[str, list] = {name: [] for name in COUNTS.names}
            for row in range(batch.num_rows):
                doc_id, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py() or ""
                starts, ends = token_spans(text, lengths(text)) if text else (np.zeros(0, np.int64),) * 2
                if given:
                    spans = sorted((max(0, x["start"]), min(len(text), x["end"]), x["name"]) for x in batch.column(2)[row].as_py() or [] if x and x["start"] is not None and x["end"] is not None)
                    names = [x[2] for x in spans]
                    b = np.array([x[1] for x in spans], np.int64)
                    a = np.array([x[0] for x in spans], np.int64)
                    if len(b):
                        before = np.concatenate([[0], np.maximum.accumulate(b)[:-1]])
                        a = np.maximum(a, before)
                        b = np.maximum(a, b)
                else:
                    a, b = _lines(text)
                    names = ["line"] * len(a)
                full = np.flatnonzero(a < b)  # empty sections take no part in the join
                tokens, crossing = np.zeros(len(a)), np.zeros(len(a), np.int64)
                tokens[full], crossing[full], outside = allocate(starts, ends, a[full], b[full], rule)
                rows = [*zip(range(len(a)), names, a.tolist(), b.tolist(), tokens.tolist(), crossing.tolist())]
                if outside or not rows:
                    rows.append((-1, None, None, None, outside, 0))
                for values in rows:
                    for name, value in zip(COUNTS.names, (doc_id, *values, len(starts))):
                        parts[name].append(value)
            yield pa.RecordBatch.from_pydict(parts, COUNTS)

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if given:
        columns.append(F.transform(sections_col, lambda x: F.struct(x["name"].alias("name"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))).alias("sections"))
    return docs.select(*columns).mapInArrow(task, "doc_id long, section int, name string, start long, end long, tokens double, crossing long, doc_tokens long")
