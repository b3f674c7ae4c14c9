"""Fusion of results of several sources: duplicates, relevance, strategies and diversity.

Items are rows (query_id, position, content, source_type, source_id, confidence, authority, at, embedding, ...). The
greedy parts depend on the order of items, which is that of position, and hold one query's items, whose number the
sources' limits bound, in one group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.scoring import recency, relevance, source_weight
from lorespark.functions.text import strip
from lorespark.functions.vector import cosine
from lorespark.operators.documents import first_of

STRATEGIES = ("balanced", "weighted_fusion", "ranked_merge", "diversity_first", "relevance_first")


@dataclass(frozen=True)
class FusionConfig:
    max_items: int = 10
    similarity_threshold: float = 0.85
    diversity_weight: float = 0.3


def extracted(sources: DataFrame) -> DataFrame:
    """Items of sources (query_id, source_order, source_type, source_id, source_reliability, items, error_message) that did not fail."""
    rows = sources.filter("error_message is null").select("query_id", "source_order", "source_type", "source_id", F.col("source_reliability").alias("authority"), F.posexplode("items").alias("k", "item"))
    position = F.struct("source_order", "k")
    return rows.select("query_id", position.alias("position"), "source_type", "source_id", "authority", "item.*")


def without_copies(items: DataFrame) -> DataFrame:
    """The first item of each trimmed text stays."""
    keyed = items.withColumn("__text", strip(F.col("content")))
    return first_of(keyed, ["query_id", "__text"], [F.col("position")]).drop("__text")


def without_near_copies(items: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedy by position: an item goes when its cosine with one that stays reaches the threshold. Items without vectors stay."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        kept: list[int] = []
        vectors: list[np.ndarray] = []
        for i, v in enumerate(pdf.embedding):
            if v is None:
                kept.append(i)
                continue
            v = np.asarray(v, float)
            n = np.linalg.norm(v)
            if n and any(float(v @ u) / n >= threshold for u in vectors):
                continue
            kept.append(i)
            if n:
                vectors.append(v / n)
        return pdf.iloc[kept]

    return items.groupBy("query_id").applyInPandas(greedy, items.schema)


def scored(items: DataFrame, query_vector: Column, now: Column) -> DataFrame:
    """Adds query_score, recency and relevance_score; without vectors the query score is 0.5."""
    q = F.coalesce(cosine(F.col("embedding"), query_vector), F.lit(0.5))
    out = items.withColumn("query_score", q).withColumn("recency", recency(F.col("at"), now))
    return out.withColumn("relevance_score", relevance(F.col("query_score"), F.col("authority"), F.col("recency"), F.col("confidence")))


def _top(items: DataFrame, score: Column, n: int) -> DataFrame:
    ordered = items.withColumn("final_score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "position")
    return ordered.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def diversified(items: DataFrame, score: str, weight: float, n: int) -> DataFrame:
    """Greedy: the best item, then whichever loses least by its likeness to those chosen; with weight 0 the best by score.

    An item's final score is its own less weight times its greatest cosine with those chosen before; items whose
    final score would be -1 or less are never chosen.
    """
    if weight == 0:
        return _top(items, F.col(score), n)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, "position"], ascending=[False, True]).reset_index(drop=True)
        own = pdf[score].to_numpy(float)
        vectors = [None if v is None else np.asarray(v, float) for v in pdf.embedding]
        units = [None if v is None or not np.linalg.norm(v) else v / np.linalg.norm(v) for v in vectors]
        chosen, final, likeness = [0], [own[0]], np.zeros(len(pdf))
        free = np.ones(len(pdf), bool)
        free[0] = False
        while len(chosen) < n:
            last = units[chosen[-1]]
            if last is not None:
                for i in np.flatnonzero(free):
                    if units[i] is not None:
                        likeness[i] = max(likeness[i], float(units[i] @ last))
            adjusted = np.where(free, own - weight * likeness, -np.inf)
            best = int(adjusted.argmax()) if len(adjusted) else -1
            if best < 0 or not adjusted[best] > -1:
                break
            chosen.append(best)
            final.append(float(adjusted[best]))
            free[best] = False
        out = pdf.iloc[chosen].copy()
        out["final_score"] = final
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    schema = items.withColumn("final_score", F.lit(0.0)).withColumn("rank", F.lit(0)).schema
    return items.groupBy("query_id").applyInPandas(greedy, schema)


def fused(items: DataFrame, strategy: str = "balanced", config: FusionConfig = FusionConfig()) -> DataFrame:
    """Scored items of each query by one of the strategies, ranked from 1."""
    n, w = config.max_items, config.diversity_weight
    if strategy == "balanced":
        return diversified(items, "relevance_score", w, n)
    if strategy == "weighted_fusion":
        weighed = items.withColumn("relevance_score", F.least(F.lit(1.0), F.col("relevance_score") * source_weight(F.col("source_type")) * F.col("authority")))
        return _top(weighed, F.col("relevance_score"), n)
    if strategy == "ranked_merge":
        return _top(items, F.col("relevance_score"), n)
    if strategy == "diversity_first":
        return diversified(items, "relevance_score", min(w + 0.3, 0.8), n)
    if strategy == "relevance_first":
        return _top(items, F.col("query_score"), n)
    raise ValueError(f"unknown strategy {strategy!r}")


def diversity(items: DataFrame) -> DataFrame:
    """1 less the mean cosine of all pairs of a query's (chosen) items, within 0 and 1; 1 for fewer than two."""
    # The cosines of all pairs of unit vectors add up to half of what the square of their sum has over their number.
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: F.try_divide(x.cast("double"), size))
    parts = items.select("query_id", F.posexplode(F.when(size > 0, unit)).alias("at", "x")).groupBy("query_id", "at").agg(F.sum("x").alias("x"))
    squares = parts.groupBy("query_id").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    counts = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(size > 0).alias("sound"))
    pairs = counts.join(squares, "query_id").select("query_id", F.try_divide(F.col("square") - F.col("sound"), F.col("n") * (F.col("n") - 1)).alias("mean"))
    return items.select("query_id").distinct().join(pairs, "query_id", "left").select("query_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("mean", F.lit(0.0)))).alias("diversity"))
