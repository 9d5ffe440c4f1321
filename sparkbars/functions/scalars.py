"""Scalar rules: sessions, dates, sentiment, tones, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import yes

#: Sessions by UTC hour (from, before).
SESSIONS = {"asia": (0, 8), "london": (8, 17), "new_york": (13, 21), "overlap": (13, 17)}


def session_flags(ts: Column) -> dict[str, Column]:
    h = F.hour(ts)
    return {f"in_{name}": ((h >= a) & (h < b)).cast("int") for name, (a, b) in SESSIONS.items()}


def calendar_features(ts: Column) -> dict[str, Column]:
    angle = F.hour(ts) * F.lit(2 * 3.141592653589793 / 24)
    return {"hour": F.hour(ts), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle)} | session_flags(ts)


def session_name(ts: Column) -> Column:
    """One session for each hour."""
    h = F.hour(ts)
    return F.when((h >= 13) & (h < 17), "Overlap").when((h >= 17) & (h < 21), "NY").when((h >= 8) & (h < 13), "London").otherwise("Asia")


def date_parts(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "weekday": F.date_format(ts, "EEEE"), "half": F.when(F.dayofmonth(ts) <= 15, "first").otherwise("second")}


def stretch_bucket(x: Column) -> Column:
    """B1..B5 by size; missing is B1."""
    x = F.abs(x)
    return F.when(x.isNull() | (x < 0.5), "B1").when(x < 1.0, "B2").when(x < 1.5, "B3").when(x < 2.0, "B4").otherwise("B5")


def probability_signal(p: Column, high: float = 0.55, low: float = 0.45) -> Column:
    return F.when(yes(p > high), 1).when(yes(p < low), -1).otherwise(0)


def keyword_sentiment(text: Column, good: Sequence[str], bad: Sequence[str]) -> dict[str, Column]:
    """Distinct lower-case words that either lexicon has; one side leads if it has 1.3 times the other's."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+"), F.lit(0)))
    up, down = (F.size(F.array_intersect(words, F.array(*map(F.lit, x)))) for x in (good, bad))
    label = F.when(up > down * 1.3, "positive").when(down > up * 1.3, "negative").otherwise("neutral")
    return {"n_good": up, "n_bad": down, "sentiment": label, "confidence": F.least(F.lit(0.55), F.greatest(up, down) / (up + down + 1))}


def blend_sentiment(a: Column, confidence_a: Column, b: Column, confidence_b: Column, weight: float = 0.7, dead: float = 0.05) -> dict[str, Column]:
    sign = lambda x: F.when(x == "positive", 1.0).when(x == "negative", -1.0).otherwise(0.0)
    score = sign(a) * F.coalesce(confidence_a, F.lit(0.0)) * weight + sign(b) * F.coalesce(confidence_b, F.lit(0.0)) * (1 - weight)
    return {"blend": score, "blend_label": F.when(score > dead, "positive").when(score < -dead, "negative").otherwise("neutral")}


def phrase_tone(text: Column, tight: Sequence[str], loose: Sequence[str], margin: int = 2) -> Column:
    """Which phrases a text has more of, by a margin."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda phrases: sum((((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("int") for p in phrases), F.lit(0))
    a, b = count(tight), count(loose)
    return F.when(a >= b + margin, "hawkish").when(b >= a + margin, "dovish").otherwise("neutral")


def decimal_comma(x: Column) -> Column:
    """Text such as 1.234,56 as a number; null where it is none."""
    return F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def rate_tone(df: DataFrame, rate: str, key: str, order: str) -> DataFrame:
    """Tone and confidence of a rate's course: the mean of the last three against the three before, then its level.
    Neutral until there are six."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.avg(rate).over(w.rowsBetween(-2, 0)) - F.avg(rate).over(w.rowsBetween(-5, -3))
    r, n = F.col(rate), F.count(rate).over(w.rowsBetween(-5, 0))
    out = df.withColumn("delta", F.when(n >= 6, step))
    d = F.col("delta")
    tone = F.when(d.isNull(), "neutral").when(d < -0.3, "dovish").when(d > 0.3, "hawkish").when(r >= 13, "hawkish").when(r <= 7, "dovish").otherwise("neutral")
    sure = F.when(F.abs(d) > 0.8, "high").when(F.abs(d) > 0.3, "medium").when(d.isNotNull() & ((r >= 13) | (r <= 7)), "medium").otherwise("low")
    return out.withColumn("tone", tone).withColumn("confidence", sure)


def symbol_match(name: Column, symbol: Column) -> Column:
    """Whether either contains the other, letters and digits alone."""
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in (name, symbol))
    return yes((a != "") & (b != "") & (a.contains(b) | b.contains(a)))
