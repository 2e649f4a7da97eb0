"""Timeline functions over an ordered array of segments (start, end, words, complete, narration, is_summary)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorepool.constants import CONTROL_CATEGORIES, DURATION_SEC, REWARD_WEIGHTS, SEGMENTS, WORDS_MAX, WORDS_MIN, WORDS_TARGET
from scorepool.functions.vectors import clip01


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def readability(segments: Column) -> Column:
    """Closeness of word counts to the target, their share in range, and the share of complete sentences."""
    near = 1 - _mean(F.transform(segments, lambda s: F.least(F.lit(1.0), F.abs(s["words"] - WORDS_TARGET) / float(WORDS_TARGET))))
    inside = _mean(F.transform(segments, lambda s: s["words"].between(WORDS_MIN, WORDS_MAX).cast("double")))
    whole = _mean(F.transform(segments, lambda s: s["complete"].cast("double")))
    return F.when(F.size(segments) == 0, F.lit(0.0)).otherwise(clip01(0.60 * near + 0.25 * inside + 0.15 * whole))


def rhythm(segments: Column) -> Column:
    """Evenness of segment lengths and boundaries against equal parts, less a share for surplus segments."""
    part = DURATION_SEC / SEGMENTS
    length = lambda s: F.when(_finite(s["start"]) & _finite(s["end"]), F.greatest(F.lit(0.0), s["end"] - s["start"])).otherwise(0.0)
    observed = [F.coalesce(length(F.get(segments, F.lit(i))), F.lit(0.0)) for i in range(SEGMENTS)]
    profile, boundary, total = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i, x in enumerate(observed):
        total = total + x
        profile = profile + F.abs(x - part)
        boundary = boundary + F.abs(total - part * (i + 1))
    surplus = F.greatest(F.lit(0), F.size(segments) - SEGMENTS) / float(SEGMENTS)
    score = 0.55 * clip01(1 - profile / (2 * DURATION_SEC)) + 0.45 * clip01(1 - 2 * (boundary / SEGMENTS) / DURATION_SEC) - surplus
    return F.when(F.size(segments) == 0, F.lit(0.0)).otherwise(clip01(score))


def timestamps_valid(segments: Column) -> Column:
    """Finite, non-negative, of positive length, and in order up to 1e-6."""
    alone = F.forall(segments, lambda s: _finite(s["start"]) & _finite(s["end"]) & (s["start"] >= 0) & (s["end"] > s["start"]))
    ordered = F.forall(_pairs(segments), lambda p: p["b"]["start"] >= p["a"]["end"] - 1e-6)
    return F.coalesce((F.size(segments) > 0) & alone & ordered, F.lit(False))


def _pairs(segments: Column) -> Column:
    n = F.greatest(F.size(segments) - 1, F.lit(0))
    return F.arrays_zip(F.slice(segments, F.lit(1), n).alias("a"), F.slice(segments, F.lit(2), n).alias("b"))


def duration_coverage(segments: Column) -> Column:
    """Starts within 1.5 s, ends within 15 % of the target, and gaps of at most 15 %."""
    first, last = F.get(segments, F.lit(0))["start"], F.element_at(segments, -1)["end"]
    gaps = F.aggregate(_pairs(segments), F.lit(0.0), lambda s, p: s + F.greatest(F.lit(0.0), p["b"]["start"] - p["a"]["end"]))
    fits = (F.abs(first) <= max(0.5, 0.05 * DURATION_SEC)) & (F.abs(last - DURATION_SEC) / DURATION_SEC <= 0.15) & (gaps / DURATION_SEC <= 0.15)
    return F.when(timestamps_valid(segments), fits).otherwise(F.lit(False))


def violations(segments: Column, missing_fields: Column | None = None) -> Column:
    """The control categories that fail, in fixed order."""
    no_missing = F.lit(True) if missing_fields is None else F.size(missing_fields) == 0
    present = (F.size(segments) > 0) & no_missing & F.forall(segments, lambda s: F.regexp_replace(F.coalesce(s["narration"], F.lit("")), r"\s+", "") != "")
    summaries = F.filter(F.transform(segments, lambda s, i: F.when(s["is_summary"], i)), lambda i: i.isNotNull())
    placed = (F.size(summaries) == 1) & (F.get(summaries, F.lit(0)) == SEGMENTS - 1)
    density = F.when(F.size(segments) == 0, F.lit(0.0)).otherwise(_mean(F.transform(segments, lambda s: s["words"].cast("double"))))
    checks = (F.size(segments) == SEGMENTS, timestamps_valid(segments), duration_coverage(segments), present, placed, density.between(WORDS_MIN, WORDS_MAX))
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in zip(CONTROL_CATEGORIES, checks, strict=True)]))


def control_score(found: Column) -> Column:
    return clip01(1 - F.size(F.array_distinct(found)) / float(len(CONTROL_CATEGORIES)))


def total_reward(**parts: Column) -> Column:
    """The weighted sum of alignment, readability, rhythm, control and risk."""
    out = F.lit(0.0)
    for name, weight in REWARD_WEIGHTS.items():
        out = out + weight * parts[name]
    return clip01(out)
