"""A quality classifier of sparse rules, compiled into a Spark column.

Trees are grown on labelled rows' statistics; each path from a root is a conjunctive rule ("symbols > 0.04 and lines
<= 3"); a lasso logistic regression gives most rules no weight; the rest become one column expression. Statistics come
from texts alone. The fit takes at most ``rows`` labelled documents (those with the smallest hash of doc_id); every
document is scored.

Null text counts as empty. Without labels of both kinds the score is the labels' mean, 0.5 without any. Repeated rows are
scored each, and weigh in the fit as often as they come; empty tables give empty results. Other columns may have any name.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

STATISTICS = ("words", "word_length", "upper", "symbols", "bars", "stops", "digits", "other_script", "new_words", "new_lines", "line_words", "longest")
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_SYMBOLS, _STOPS = b"#$%&*@^~<>{}[]\\_=+!", b".,;:?"
_PLAIN = bytes(range(128))


#: Words of a block whose distinct words are counted: over whole texts the share would fall with their length.
BLOCK = 50


def text_statistics(text: str | None) -> tuple[float, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    share = lambda letters: (len(raw) - len(raw.translate(None, letters))) / size
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, m = max(len(words), 1), max(len(lines), 1)
    distinct = sum(len(set(words[k : k + BLOCK])) for k in range(0, len(words), BLOCK))
    return (
        math.log1p(len(words)), sum(map(len, words)) / n, share(_UPPER), share(_SYMBOLS), share(b"|"), share(_STOPS), share(_DIGITS),
        1 - share(_PLAIN) if raw else 0.0, distinct / n, len(set(lines)) / m, len(words) / m, math.log1p(max(map(len, words), default=0)),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", to: str = "__stats") -> DataFrame:
    @F.pandas_udf("array<double>")
    def statistics(texts: pd.Series) -> pd.Series:
        return pd.Series([list(text_statistics(t)) for t in texts])

    return docs.withColumn(to, statistics(F.col(text_col)))


#: A rule: conditions (statistic, whether above, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(debug: str) -> list[Rule]:
    """The paths of a tree as its ``toDebugString`` writes it, whole and up to each inner node."""
    path: list[tuple[int, bool, float]] = []
    rules: list[Rule] = []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            depth = path_depth(m[1], debug)
            del path[depth:]
            path.append((int(m[2]), m[3] == ">", float(m[4])))
            rules.append(tuple(path))
    return rules


def path_depth(indent: str, debug: str) -> int:
    first = re.search(r"^( *)If ", debug, re.M)
    return len(indent) - len(first[1]) if first else 0


def rule_column(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for k, above, at in rule:
        x = F.element_at(stats, k + 1)
        out = out & ((x > at) if above else (x <= at))
    return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.when(rule_column(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def text(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {at:.4g}" for k, above, at in rule) for w, rule in self.rules]


def fit_rules(samples: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 42) -> RuleModel:
    """samples: ``id`` long, ``stats`` array<double>, ``label`` double (0 or 1)."""
    # in one order, however the rows came: the forest draws its samples by partition and place
    samples = settled(samples, "samples").repartition(8, "id", "stats").sortWithinPartitions("stats", "label")
    n, ones = samples.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = min(max(0.5 if not n else ones / n, 1e-3), 1 - 1e-3)
        return RuleModel(math.log(share / (1 - share)), ())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="x", labelCol="label", subsamplingRate=0.8).fit(samples.select(array_to_vector("stats").alias("x"), "label"))
    rules = sorted({tuple(sorted(set(r))) for tree in forest.trees for r in tree_rules(tree.toDebugString)})
    if not rules:
        return RuleModel(math.log(ones / (n - ones)), ())
    fired = settled(samples.select(F.array(*(rule_column(r, F.col("stats")).cast("double") for r in rules)).alias("fired"), "label"), "fired").select(array_to_vector("fired").alias("x"), "label")
    fit = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(fired.persist())
    fired.unpersist()
    return RuleModel(float(fit.intercept), tuple((float(w), r) for w, r in zip(fit.coefficients.toArray(), rules) if w))


def labelled_rows(labels: DataFrame, rows: int) -> DataFrame:
    """(``__id``, ``label``), at most ``rows`` of them; a doc_id that has several labels takes their mean, rounded up at a half."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    return usable.select(F.col("doc_id").alias("__id"), "label").orderBy(F.xxhash64("__id"), "__id").limit(rows)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Learns from ``labels`` (doc_id, quality) that are not held out. Statistics are taken of the sampled rows alone;
    the sample, of at most ``rows`` short rows, is broadcast."""
    some = labelled_rows(labels.filter(~held_out(F.col("doc_id"))), rows)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(some), "__id")
    return fit_rules(with_statistics(sample, "text", "stats").select(F.col("__id").alias("id"), "stats", "label"))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document."""
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "stats").select("doc_id", "stats")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns."""
    rows = with_statistics(docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text")), "__text")
    return rows.filter(model.score(F.col("__stats")) >= 0.5).select("__row.*")
