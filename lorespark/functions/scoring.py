"""Scores: relevance, importance, feedback and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import keyword_hits, overlap

# --- fixed values
IMPORTANT_WORDS = ("important", "critical", "key", "essential", "remember", "decision", "agreed", "confirmed", "final", "conclusion")
TYPE_IMPORTANCE = {"semantic": 0.8, "procedural": 0.7, "episodic": 0.6}
SOURCE_WEIGHTS = {"graph": 1.2, "database": 1.1}
# --- end of fixed values


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def importance(content: Column, kind: Column) -> Column:
    """By type, with a bonus for telling words (0.3 at most) and for length (0.1 at most)."""
    base = F.lit(0.5)
    for name, v in TYPE_IMPORTANCE.items():
        base = F.when(kind == name, v).otherwise(base)
    words = F.least(keyword_hits(content, IMPORTANT_WORDS) * 0.1, F.lit(0.3))
    return F.least(base + words + F.least(F.length(content) / 1000.0, F.lit(0.1)), F.lit(1.0))


def recency(at: Column, now: Column) -> Column:
    """Halves with every day; 0.5 where the time is unknown."""
    return F.coalesce(F.least(F.lit(1.0), F.pow(F.lit(2.0), -(F.unix_seconds(now) - F.unix_seconds(at)) / 86400.0)), F.lit(0.5))


def relevance(query: Column, authority: Column, recent: Column, confidence: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * query + 0.2 * authority + 0.1 * recent + 0.1 * confidence)


def source_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, v in SOURCE_WEIGHTS.items():
        out = F.when(kind == name, v).otherwise(out)
    return out


def rerank_score(query: Column, content: Column, score: Column) -> Column:
    """Word overlap, the query as a part of the text, brevity and the earlier score; a score of 0 counts as missing."""
    inside = F.when(F.contains(F.lower(content), F.lower(query)), 0.2).otherwise(0.0)
    short = F.greatest(F.lit(0.0), 1 - F.length(content) / 2000.0)
    old = F.when(F.coalesce(score, F.lit(0.0)) == 0, 0.5).otherwise(score)
    return 0.4 * overlap(query, content) + 0.3 * inside + 0.1 * short + 0.2 * old


def feedback_score(kind: Column, value: Column) -> Column:
    rating = clamp((value - 1) / 4.0)
    return F.when(kind == "positive", 1.0).when(kind == "negative", 0.0).when((kind == "explicit_rating") & value.isNotNull(), rating).otherwise(0.5)


def implied_feedback(response_s: Column, follow_up: Column, engaged_s: Column, quick: float = 2.0, engaged: float = 30.0) -> Column:
    """(feedback_type, confidence) from a user's behaviour."""
    some = F.coalesce(engaged_s, F.lit(0.0)) != 0
    points = lambda *rules: sum((F.when(test, v).otherwise(0.0) for test, v in rules), F.lit(0.0))
    asked = F.coalesce(F.length(follow_up), F.lit(0))
    good = points((response_s < quick, 0.3), (some & (engaged_s > engaged), 0.7), ((asked == 0) & engaged_s.isNull(), 0.2))
    bad = points((some & (engaged_s < 5.0), 0.4), (asked > 10, 0.5))
    kind = F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
    return F.struct(kind.alias("feedback_type"), F.when(good > bad, F.least(good, F.lit(1.0))).when(bad > good, F.least(bad, F.lit(1.0))).otherwise(0.5).alias("confidence"))


def translation_confidence(template_score: Column, errors: Column, patterns: Column, aligned: Column) -> Column:
    return clamp(0.5 + F.coalesce(template_score, F.lit(0.0)) * 0.3 - errors * 0.1 + F.least(patterns * 0.05, F.lit(0.2)) + F.when(aligned, 0.1).otherwise(0.0))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def conflict_severity(n: Column) -> Column:
    return F.when(n > 10, "high").when(n > 3, "medium").otherwise("low")


def node_size(complexity: Column, lines: Column, any_complexity: bool, any_lines: bool) -> Column:
    """Display size by complexity if the column has any, else by lines, else 10."""
    if any_complexity:
        return clamp(F.coalesce(complexity, F.lit(0)) * 2 + 5, 5, 30)
    return clamp(F.coalesce(lines, F.lit(0)) / 10 + 5, 5, 30) if any_lines else F.lit(10.0)
