"""Secrets in texts: three fixed kinds, and runs that a character model finds random; DataFrame operations only.

The fixed kinds are the leftmost matches, not overlapping, of a pattern for each kind; matches that are too short are
dropped. Places come from the pieces between matches (``split``) and the matches themselves (``regexp_extract_all``),
whose lengths add up; they count code points, the end is exclusive.

The method: two first-order Markov chains over characters, one of random strings and one of ordinary identifiers,
trained on labelled samples of the whole corpus. A candidate run is a secret, kind ``random``, if the log-likelihood ratio for each of its
steps and in all is large enough. The table of ratios has a fixed size (the alphabet squared), whatever the input.

Null and empty texts have no spans, empty tables give empty results, and a model without samples finds nothing. Repeated
rows are scanned each; ties between kinds are ordered as the kinds are listed. Work grows with the length of a text and
of a run, and with the number of matches nearly so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Kind, pattern, and the least length of the group named.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: For ``hex`` and ``access`` a match goes on as far as its letters do, so the least length can stand in the pattern.
PLACED = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Runs that the model judges: of the alphabet, with a digit and a letter, so long.
CANDIDATE, LEAST_RUN = r"[A-Za-z0-9+/_=-]{16,}", 16
#: Runs that training takes for ordinary: shorter than those judged, or without a digit; not what is assigned to a name.
ORDINARY = r"""(?<![A-Za-z0-9+/_=.:"'-])(?:[A-Za-z0-9/_-]{6,15}|[A-Za-z_-]{16,})(?![A-Za-z0-9+/_=-])"""
#: Nats for each step, and in all, from which a run is taken for random.
STEP_NATS, ALL_NATS = 0.5, 12.0


_SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def running(values: Column, op, zero: Column) -> Column:
    """``op`` over all values up to each. Values go in pieces of about their count's square root, so that no long array is
    copied for each element: work grows with the count to the power 1.5, and that in copies of references alone."""

    def scan(x: Column, begin: Column) -> Column:
        return F.aggregate(x, F.struct(begin.alias("last"), F.array().cast("array<int>").alias("all")), lambda acc, v: F.struct(op(acc["last"], v).alias("last"), F.concat(acc["all"], F.array(op(acc["last"], v))).alias("all")), lambda acc: acc["all"])

    def pieces(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int")), lambda k: scan(F.slice(x, k * w + 1, w), zero)))

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(zero), scan(F.transform(parts, lambda p: F.element_at(p, -1)), zero))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, first: F.transform(p, lambda v: op(first, v))))

    return let(values, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(pieces(x), joined)))


def _places(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, end, kind, value>> of the matches. Matches and the pieces between them are found once each."""

    def spans(m: Column, gaps: Column) -> Column:
        ends = running(F.zip_with(m, gaps, lambda x, gap: F.char_length(gap) + F.char_length(x)), lambda a, b: a + b, F.lit(0))
        return F.zip_with(m, ends, lambda x, end: F.struct((end - F.char_length(x)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x.alias("value")))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: spans(m, F.slice(F.split(text, pattern, -1), 1, F.size(m)))).cast(_SPANS)
    return F.filter(found, keep) if keep is not None else found


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind; empty where the text has none of its letters."""
    none = F.array().cast(_SPANS)
    group, least = KINDS[0][2], KINDS[0][3]
    long_enough = lambda s: F.char_length(F.regexp_extract(s["value"], KINDS[0][1], group)) >= least
    keep = {"assign": long_enough}
    return {kind: F.when(text.rlike(PLACED[kind]), _places(text, PLACED[kind], kind, keep.get(kind))).otherwise(none) for kind, *_ in KINDS}


def _steps(value: Column) -> Column:
    """Cells of the table that a string's steps fall on; characters outside the alphabet share one place."""
    n = len(ALPHABET) + 1
    places = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(places, lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: a * n + b))


def train_markov(samples: DataFrame, prior: float = 1.0, share: float = 0.1) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each step. samples: ``value`` string, ``random`` boolean.

    Random samples are few, so each step counts ``prior`` more. Ordinary ones are many but mostly prose, where a step that
    identifiers often have (to or from a separator or a digit) may be missing: a ``share`` of each row is spread over all
    steps, so that no single one can speak for a random string by more than about log(1 / share).

    Counts of steps are summed in Spark; what reaches the driver is at most the alphabet squared, for each label.
    """
    n = len(ALPHABET) + 1
    counts = samples.select("random", F.explode(_steps(F.col("value"))).alias("cell")).groupBy("random", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    table = {True: [0] * (n * n), False: [0] * (n * n)}
    for label, cell, k in counts:
        if label is not None:
            table[label][cell] += k
    ratio = []
    for row in range(n):
        a, b = (table[x][row * n : row * n + n] for x in (True, False))
        chance = lambda y: (1 - share) * y / sum(b) + share / n if sum(b) else 1 / n  # noqa: E731, B023
        ratio += [math.log((x + prior) / (sum(a) + prior * n)) - math.log(chance(y)) for x, y in zip(a, b)]
    return ratio


def random_spans(text: Column, ratio: Sequence[float]) -> Column:
    """Candidate runs that the model takes for random, kind ``random``."""
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(repr(float(x)) for x in ratio)), ",").cast("array<double>")  # folded into one literal

    def taken(span: Column) -> Column:
        nats = F.aggregate(_steps(span["value"]), F.lit(0.0), lambda acc, cell: acc + F.element_at(table, cell + 1))
        steps = F.char_length(span["value"]) - 1
        return (nats >= ALL_NATS) & (nats >= STEP_NATS * steps) & span["value"].rlike("[0-9]") & span["value"].rlike("[A-Za-z]")

    none = F.array().cast(_SPANS)
    return F.when(text.rlike(CANDIDATE) & text.rlike("[0-9]"), _places(text, CANDIDATE, "random", taken)).otherwise(none)


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = {kind: k for k, (kind, *_) in enumerate(KINDS)} | {"random": len(KINDS)}
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*(F.lit(k) for k in rank)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def clear_of(spans: Column, base: Column) -> Column:
    """The ``spans`` (disjoint) that overlap none of ``base``, by one sort of both: what began before has ended, and what
    comes after has not begun."""
    tagged = lambda x, own: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    far = F.lit((1 << 31) - 1)

    def judged(every: Column) -> Column:
        ended = running(F.transform(every, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"])), F.greatest, F.lit(0))
        begun = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["own"], far).otherwise(s["start"]))), F.least, far))
        kept = F.filter(F.arrays_zip(every.alias("s"), ended.alias("e"), begun.alias("b")), lambda x: x["s"]["own"] & (x["e"] <= x["s"]["start"]) & (x["b"] >= x["s"]["end"]))
        return F.transform(kept, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["kind"].alias("kind"), x["s"]["value"].alias("value"))).cast(_SPANS)

    return F.when(F.size(spans) == 0, F.array().cast(_SPANS)).otherwise(let(F.array_sort(F.concat(tagged(base, False), tagged(spans, True))), judged))


def scan_secrets(docs: DataFrame, ratio: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans: a row for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    base = base_spans(F.col("__text"))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in base.items()), random_spans(F.col("__text"), ratio).alias("random"))
    every = [k for k, *_ in KINDS]
    clear = clear_of(F.col("random"), F.concat(*every))
    rows = rows.withColumn("random", clear)
    out = rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in [*every, "random"]), _written(F.concat(*every)).alias("base"), _written(F.concat(*every, "random")).alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Training samples (``value``, ``random``) of the whole corpus, each value once: values of the fixed kinds are random.
    Ordinary are runs too short to be judged (so with digits too) and longer ones of letters alone, as written and in upper
    case, as constants are. No run that is judged is its own label. Values combine before
    they shuffle; nothing is capped, and what training gathers grows with the corpus."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base_spans(F.col("t"))
    values = F.concat(F.transform(base["assign"], lambda s: F.regexp_extract(s["value"], KINDS[0][1], 2)), F.transform(base["access"], lambda s: s["value"]), F.transform(base["hex"], lambda s: s["value"]))
    words = F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))
    words = F.array_distinct(F.concat(words, F.transform(words, F.upper)))
    both = texts.select(F.explode(F.concat(F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(True).alias("random"))), F.transform(words, lambda v: F.struct(v.alias("value"), F.lit(False).alias("random"))))).alias("s"))
    return both.select("s.value", "s.random").distinct()
