"""Session memory, sessions and learning from feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.scoring import feedback_score, implied_feedback, importance
from lorespark.functions.text import overlap, short_hash, tokens
from lorespark.operators.documents import first_of, top_rows

SESSION_SECONDS = 24 * 3600
#: How long entries stay in the short-term layer.
SHORT_SECONDS = 3600


def memories(entries: DataFrame, now: Column) -> DataFrame:
    """Entries (session_id, type, content) as stored: with an id of session, content and time, importance and expiry."""
    return entries.withColumn("importance", importance(F.col("content"), F.col("type"))).withColumn("stored_at", now).withColumn("id", short_hash(F.concat_ws(":", "session_id", "content", now.cast("string"))))


def text_matches(entries: DataFrame, query: str) -> DataFrame:
    """Entries that share a word with the query."""
    return entries.filter(F.arrays_overlap(tokens(F.col("content")), tokens(F.lit(query))))


def retrieve(short_term: DataFrame, long_term: DataFrame, session, query: str, limit: int = 10) -> DataFrame:
    """Half of the results from either layer, the short-term copy of doubles, by importance and then by words shared."""
    near = overlap(F.lit(query), F.col("content"))
    mine = lambda df: df.filter(F.col("session_id") == session)
    recent = text_matches(mine(short_term), query).withColumn("likeness", near).orderBy(F.desc("likeness"), "id").limit(limit // 2)
    old = mine(long_term).withColumn("likeness", near).orderBy(F.desc("importance"), F.desc("likeness"), "id").limit(limit // 2)
    columns = ["id", "content", "importance", "likeness"]
    both = recent.select(*columns, F.lit(0).alias("layer")).unionByName(old.select(*columns, F.lit(1).alias("layer")))
    return first_of(both, ["id"], [F.col("layer")]).orderBy(F.desc("importance"), F.desc("likeness"), "id").limit(limit)


def short_term(entries: DataFrame, now: Column, most: int = 50, seconds: int = SHORT_SECONDS) -> DataFrame:
    """The short-term layer of stored entries (…, session_id, id, stored_at): of each session the last ones that have not expired."""
    fresh = entries.filter(F.unix_millis("stored_at") + seconds * 1000 > F.unix_millis(now))
    return top_rows(fresh, ["session_id"], [F.desc("stored_at"), F.asc("id")], most).drop("rank")


def recalled(entries: DataFrame, questions: DataFrame, now: Column, limit: int = 10, most: int = 50, seconds: int = SHORT_SECONDS) -> DataFrame:
    """retrieve() for many sessions at once: questions (session_id, query); rows (session_id, rank, id, layer, importance, likeness).

    Half of the results come from the session's short-term layer, by words shared with the query, half from all of its
    entries, by importance; what both have counts once, as short-term.
    """
    asked = questions.select("session_id", "query")
    near = lambda df: df.join(asked, "session_id").withColumn("likeness", overlap(F.col("query"), F.col("content")))
    matching = near(short_term(entries, now, most, seconds)).filter(F.arrays_overlap(tokens(F.col("content")), tokens(F.col("query"))))
    recent = top_rows(matching, ["session_id"], [F.desc("likeness"), F.asc("id")], limit // 2).withColumn("layer", F.lit("short"))
    old = top_rows(near(entries), ["session_id"], [F.desc("importance"), F.desc("likeness"), F.asc("id")], limit // 2).withColumn("layer", F.lit("long"))
    columns = ["session_id", "id", "layer", "importance", "likeness"]
    both = first_of(recent.select(*columns).unionByName(old.select(*columns)), ["session_id", "id"], [F.when(F.col("layer") == "short", 0).otherwise(1)])
    return top_rows(both, ["session_id"], [F.desc("importance"), F.desc("likeness"), F.asc("id")], limit)


def cleared(entries: DataFrame, session) -> DataFrame:
    return entries.filter(F.col("session_id") != session)


def live_sessions(sessions: DataFrame, now: Column, least_seconds: int = 60) -> DataFrame:
    """Sessions live for 24 hours from their creation, and are kept where a minute or more is left."""
    left = SESSION_SECONDS - (F.unix_seconds(now) - F.unix_seconds("created_at"))
    return sessions.withColumn("seconds_left", left).filter(F.col("seconds_left") >= least_seconds)


def last_interactions(interactions: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(interactions, ["session_id"], [F.desc("ts"), F.desc("id")], n)


def feedback_ratios(interactions: DataFrame, least: int = 5, poor: float = 0.3) -> DataFrame:
    """Positive over positive and negative feedback of each session, whether it should adapt, and how."""
    good, bad = F.count_if(F.col("feedback_type") == "positive"), F.count_if(F.col("feedback_type") == "negative")
    out = interactions.groupBy("session_id").agg(F.count(F.lit(1)).alias("interactions"), F.try_divide(good, good + bad).alias("ratio"))
    ratio = F.coalesce("ratio", F.lit(0.5))
    how = F.when(ratio < 0.2, "pattern_based").when(ratio < 0.4, "context_aware").when(F.col("interactions") > 20, "hybrid").otherwise("feature_based")
    return out.withColumn("should_adapt", (F.col("interactions") >= least) & (ratio < poor)).withColumn("strategy", how)


def with_scores(interactions: DataFrame) -> DataFrame:
    return interactions.withColumn("score", feedback_score(F.col("feedback_type"), F.col("feedback_value")))


def with_implied_feedback(interactions: DataFrame, query: str = "query", limit_s: int | None = None) -> DataFrame:
    """What the next query of a session and the time until it imply about this one; after limit_s seconds it counts as none."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    after = F.lead("ts").over(w)
    near = F.lit(True) if limit_s is None else F.unix_millis(after) - F.unix_millis("ts") <= limit_s * 1000
    nxt = interactions.withColumn("follow_up", F.when(near, F.lead(query).over(w))).withColumn("engaged_s", F.when(near, F.unix_seconds(after) - F.unix_seconds("ts")).cast("double"))
    return nxt.withColumn("implied", implied_feedback(F.col("response_ms") / 1000, F.col("follow_up"), F.col("engaged_s"))).select("*", "implied.*").drop("implied")


def fingerprint(context: dict[str, Column]) -> Column:
    """A session id for those who give none: from what is known of the client, written as sorted pairs; texts hold no quotes or backslashes."""
    known = F.array_compact(F.array(*(F.concat(F.lit(f"('{name}', '"), value.cast("string"), F.lit("')")) for name, value in sorted(context.items()))))
    return F.concat(F.lit("auto_"), F.left(F.sha2(F.concat(F.lit("["), F.array_join(known, ", "), F.lit("]")), 256), F.lit(16)))


def strategy_success(history: DataFrame) -> DataFrame:
    """Of each strategy the share of uses with a ratio over 0.5, within 0.5 and 1.5."""
    share = F.count_if(F.coalesce("feedback_ratio", F.lit(0.5)) > 0.5) / F.count(F.lit(1))
    return history.groupBy("strategy").agg(F.greatest(F.lit(0.5), F.least(F.lit(1.5), share)).alias("success"))
