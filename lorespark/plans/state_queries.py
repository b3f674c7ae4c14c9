"""Registered queries over lifecycles, layers of memory, and models that are judged on other rows than they learn from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.scoring import importance
from lorespark.operators import lifecycle, memory, records
from lorespark.plans.document_queries import _IMPORTANCE, _TOKENS
from lorespark.sources.catalog import AS_OF, Catalog

Query = Callable[[SparkSession, str], DataFrame]


def _history(spark: SparkSession, sf: str) -> DataFrame:
    e = Catalog(spark, sf).table("events")
    kind = F.when(F.col("event_id") % 10 == 0, "switch_or_create")
    for event, operation in (("purchase", "create"), ("view", "switch"), ("signup", "create_and_switch"), ("error", "delete")):
        kind = kind.when(F.col("event_type") == event, operation)
    branch = F.element_at(F.array(*map(F.lit, ("main", "dev", "fix", "rel"))), (F.floor("value").cast("int") % 4 + 1))
    return lifecycle.branch_history(e.select(F.concat(F.lit("r"), "user_id").alias("repository_url"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.otherwise("archive").alias("operation"), branch.alias("branch_name")))


def _recalled(spark: SparkSession, sf: str) -> DataFrame:
    m = Catalog(spark, sf).memory
    minutes = (F.col("session_id") * 7 + F.col("position") * 11) % 90
    entries = m.withColumn("importance", F.round(importance(F.col("content"), F.col("type")), 6)).withColumn("stored_at", F.to_timestamp(F.lit(AS_OF)) + F.make_dt_interval(mins=minutes.cast("int")))
    query = F.element_at(F.array(F.lit("the and of"), F.lit("in To"), F.lit("zzz")), (F.col("session_id") % 3 + 1).cast("int"))
    asked = m.select("session_id").distinct().withColumn("query", query)
    now = F.to_timestamp(F.lit(AS_OF)) + F.make_dt_interval(mins=F.lit(90))
    out = memory.recalled(entries, asked, now, limit=6, most=3)
    return out.select("session_id", F.col("rank").cast("int").alias("rank"), "id", "layer", "importance", F.round("likeness", 6).alias("likeness"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    t = Catalog(spark, sf).table
    d = t("documents").select("doc_id", F.log1p(F.length("text").cast("double")).alias("size"), (F.length("text") - F.length(F.replace("text", F.lit(" ")))).alias("spaces"))
    return records.cross_validated(t("labels").join(d, "doc_id"), "doc_id", "quality", ["size", "spaces"])


def _generations(spark: SparkSession, sf: str) -> DataFrame:
    e = Catalog(spark, sf).table("events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = lifecycle.session_generations(e, F.to_timestamp(F.lit(AS_OF)))
    return out.select("session_id", "generation", F.unix_millis("started_at").alias("started_ms"), F.unix_millis("expires_at").alias("expires_ms"), "touches", "live")


_FOLD = "('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % 5"

QUERIES: dict[str, Query] = {
    "branch_history": _history,
    "session_generations": _generations,
    "memory_recalled": _recalled,
    "cross_validated": lambda spark, sf: _judged(spark, sf).select("doc_id", "fold", "guess"),
    "cross_validation": lambda spark, sf: records.accuracy_by_fold(_judged(spark, sf), "doc_id", "quality", "guess").select("fold", "n", F.round("accuracy", 6).alias("accuracy")),
}

_CROSS = f"""d AS (SELECT l.doc_id, l.quality, ({_FOLD.replace("doc_id", "l.doc_id")})::INT AS fold, ln(1 + length(text)::DOUBLE) AS size, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces FROM labels l JOIN documents USING (doc_id)),
    f AS (SELECT DISTINCT fold FROM d),
    m AS (SELECT f.fold, d.quality AS class, avg(size) AS size, avg(spaces) AS spaces FROM f JOIN d ON d.fold <> f.fold WHERE size IS NOT NULL AND quality IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT d.doc_id, d.fold, d.quality, arg_min(m.class, struct_pack(d := pow(d.size - m.size, 2) + pow(d.spaces - m.spaces, 2), c := m.class)) AS guess FROM d JOIN m ON m.fold = d.fold WHERE d.size IS NOT NULL AND d.quality IS NOT NULL GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "branch_history": """WITH RECURSIVE e AS (
        SELECT 'r' || user_id AS repo, event_id AS id, ['main', 'dev', 'fix', 'rel'][floor(value)::INT % 4 + 1] AS b,
            CASE WHEN event_id % 10 = 0 THEN 'switch_or_create' WHEN event_type = 'purchase' THEN 'create' WHEN event_type = 'view' THEN 'switch' WHEN event_type = 'signup' THEN 'create_and_switch' WHEN event_type = 'error' THEN 'delete' ELSE 'archive' END AS op,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        s AS (
            SELECT repo, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS error, ['main'] AS live, []::VARCHAR[] AS gone, 'main' AS active FROM e GROUP BY repo
            UNION ALL SELECT repo, k, id, error,
                CASE WHEN error IS NOT NULL THEN live WHEN op IN ('delete', 'archive') THEN list_filter(live, lambda x: x <> b) ELSE list_distinct(list_append(live, b)) END,
                CASE WHEN error IS NOT NULL THEN gone WHEN op = 'archive' THEN list_distinct(list_append(gone, b)) ELSE list_filter(gone, lambda x: x <> b) END,
                CASE WHEN error IS NULL AND op IN ('switch', 'switch_or_create', 'create_and_switch') THEN b ELSE active END
            FROM (SELECT e.*, s.live, s.gone, s.active,
                CASE WHEN e.op IN ('create', 'create_and_switch') AND list_contains(s.live, e.b) THEN 'it already exists' WHEN e.op IN ('switch', 'delete', 'archive') AND NOT list_contains(s.live, e.b) THEN 'it does not exist'
                    WHEN e.op IN ('delete', 'archive') AND e.b = s.active THEN 'it is active' END AS error
                FROM s JOIN e ON e.repo = s.repo AND e.k = s.k + 1))
        SELECT repo AS repository_url, id, error IS NULL AS accepted, error, active AS active_branch, len(live)::INT AS live, len(gone)::INT AS archived FROM s WHERE k > 0""",
    "session_generations": f"""WITH a AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
        b AS (SELECT *, sum((before IS NULL OR ms - before >= 86400000)::INT) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS generation FROM a)
        SELECT user_id AS session_id, generation::BIGINT AS generation, min(ms) AS started_ms, max(ms) + 86400000 AS expires_ms, count(*) AS touches, max(ms) + 86400000 - epoch_ms(TIMESTAMP '{AS_OF}') >= 60000 AS live FROM b GROUP BY 1, 2""",
    "memory_recalled": f"""WITH e AS (SELECT conv_id AS session_id, left(sha256(conv_id || ':' || turn), 16) AS id, round({_IMPORTANCE}, 6) AS importance, (conv_id * 7 + turn * 11) % 90 AS minute, {_TOKENS.format(c='text')} AS words,
            [['the', 'and', 'of'], ['in', 'to'], ['zzz']][conv_id % 3 + 1] AS q FROM conversations),
        m AS (SELECT *, len(list_intersect(q, words)) / len(q)::DOUBLE AS likeness FROM e),
        s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY minute DESC, id) AS k FROM m WHERE minute + 60 > 90),
        a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY likeness DESC, id) AS j FROM s WHERE k <= 3 AND likeness > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, likeness DESC, id) AS j FROM m),
        u AS (SELECT session_id, id, 'short' AS layer, importance, likeness FROM a WHERE j <= 3 UNION ALL SELECT session_id, id, 'long', importance, likeness FROM o WHERE j <= 3 AND (session_id, id) NOT IN (SELECT (session_id, id) FROM a WHERE j <= 3))
        SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, likeness DESC, id))::INT AS rank, id, layer, importance, round(likeness, 6) AS likeness FROM u""",
    "cross_validated": f"WITH {_CROSS} SELECT doc_id, fold, guess FROM g",
    "cross_validation": f"WITH {_CROSS} SELECT fold, count(*) AS n, round(avg((guess = quality)::INT), 6) AS accuracy FROM g GROUP BY fold",
    "accuracy_by_fold": f"SELECT ({_FOLD})::INT AS fold, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels GROUP BY 1",
}
