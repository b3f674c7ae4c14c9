"""Registered queries over indexes that are kept up to date, and over streams with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import memory
from lorespark.operators.relink import LinkedIndex, replayed
from lorespark.sources.catalog import Catalog
from lorespark.sources.tables import new_path
from lorespark.streaming import stateful, sync

Query = Callable[[SparkSession, str], DataFrame]

COMMITS = 4


def _commits(spark: SparkSession, sf: str) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Events as commits: each writes the file of its user anew, an error deletes it. Ids cut them into commits in order; the last event of a file counts."""
    e = Catalog(spark, sf).table("events").select("event_id", "event_type", F.format_string("src/u%08d.py", "user_id").alias("path"))
    last = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    out = []
    for k in range(COMMITS):
        inside = e.filter((F.col("event_id") >= last * k // COMMITS) & (F.col("event_id") < last * (k + 1) // COMMITS))
        net = inside.groupBy("path").agg(F.max(F.struct("event_id", "event_type")).alias("x")).select("path", "x.*")
        changes = net.select(F.when(F.col("event_type") == "error", "D").otherwise("M").alias("change_type"), F.lit(None).cast("string").alias("old_path"), "path")
        n = F.col("event_id")
        names = F.array(F.concat(F.lit("f"), n % 211), F.concat(F.lit("g"), n % 17), F.lit("main"))
        entities = net.select("path", F.explode(names).alias("name"), F.lit("function").alias("entity_type"))
        uses = F.array(F.concat(F.lit("f"), n * 7 % 223), F.concat(F.lit("g"), n % 19), F.lit("main"), F.lit("print"))
        references = net.select("path", F.lit("main").alias("source"), F.lit("calls").alias("type"), F.explode(uses).alias("target_name"))
        out.append((changes, entities, references))
    return out


def _relinked(spark: SparkSession, sf: str) -> LinkedIndex:
    return replayed(LinkedIndex(spark, new_path(spark, "linked-index")), _commits(spark, sf))


def _followed(spark: SparkSession, sf: str) -> DataFrame:
    e = Catalog(spark, sf).table("events")
    stream = sync.event_stream(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "view", "short").otherwise("a longer follow-up").alias("query"), (F.col("value") * 40).alias("response_ms")))
    out = sync.run_to_end(stateful.follow_up_feedback(stream), "follow-ups")
    return out.select("session_id", "id", "follow_up", "engaged_s", "feedback_type", F.round("confidence", 6).alias("confidence"))


def _ring(spark: SparkSession, sf: str) -> DataFrame:
    e = Catalog(spark, sf).table("events")
    stream = sync.event_stream(e.select(F.col("event_type").alias("container"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 13 != 0, F.round(F.col("value") * 100)).alias("value")))
    out = sync.run_to_end(stateful.polled_metrics(stream), "polls")
    return out.select("container", "id", "polls", "least", F.round("mean", 6).alias("mean"), "most")


def _bulk(spark: SparkSession, sf: str) -> DataFrame:
    """Triple documents in the order of their times, in four runs of which the first three are bounded."""
    c = Catalog(spark, sf).table("customer")
    k = F.col("c_custkey")
    docs = c.select(k.cast("string").alias("id"), F.when(k % 13 != 0, k * 7919 % 1009).alias("_ts"), F.when(k % 9 == 4, "other").otherwise("rdf_triple").alias("type"), F.concat(F.lit("http://x/c"), k % 400).alias("subject"), F.when(k % 11 != 5, "http://x/segment").alias("predicate"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')).alias("object"))
    folder, n = new_path(spark, "bulk-sync"), c.count()
    for most in (n // 4, n // 4, n // 4, None):
        sync.bulk_sync(docs, folder, most)
    return sync.synced(spark, folder).select("s", "p", "o", "o_kind")


_LAST_FILES = """e AS (SELECT event_id AS n, event_type, printf('src/u%08d.py', user_id) AS path FROM events),
    f AS (SELECT path, max(n) AS n, arg_max(event_type, n) AS event_type FROM e GROUP BY path HAVING arg_max(event_type, n) <> 'error'),
    ent AS (SELECT path, unnest(['f' || n % 211, 'g' || n % 17, 'main']) AS name FROM f),
    ref AS (SELECT path, unnest(['f' || n * 7 % 223, 'g' || n % 19, 'main', 'print']) AS target_name FROM f)"""

QUERIES: dict[str, Query] = {
    "incremental_links": lambda spark, sf: _relinked(spark, sf).links(),
    "incremental_entities": lambda spark, sf: _relinked(spark, sf).entities(),
    "bulk_sync": _bulk,
    "stream_follow_ups": _followed,
    "stream_poll_ring": _ring,
    "implicit_feedback_limited": lambda spark, sf: memory.with_implied_feedback(
        Catalog(spark, sf).interactions.drop("feedback_type").withColumn("query", F.when(F.col("event_type") == "view", "short").otherwise("a longer follow-up")), "query", stateful.FOLLOW_UP_SECONDS
    ).select("id", "follow_up", "engaged_s", "feedback_type", F.round("confidence", 6).alias("confidence")),
    "session_fingerprint": lambda spark, sf: Catalog(spark, sf).table("customer").select(
        "c_custkey", memory.fingerprint({"user_id": F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), "ip_address": F.concat(F.lit("10.0.0."), F.col("c_nationkey")), "user_agent": F.col("c_mktsegment"), "client_id": F.lit(None).cast("string")}).alias("session_id")
    ),
}


def _feedback(source: str) -> str:
    """SQL of follow-ups within the limit, and of what they imply, for source (session_id, id, ms, query, response_ms)."""
    return f"""n AS (SELECT *, lead(ms) OVER w AS after_ms, lead(query) OVER w AS after_query FROM {source} WINDOW w AS (PARTITION BY session_id ORDER BY ms, id)),
        m AS (SELECT *, CASE WHEN after_ms - ms <= 300000 THEN after_query END AS follow_up, CASE WHEN after_ms - ms <= 300000 THEN (after_ms // 1000 - ms // 1000)::DOUBLE END AS engaged_s FROM n),
        p AS (SELECT *, (response_ms / 1000 < 2)::INT * 0.3::DOUBLE + coalesce((engaged_s > 30)::INT, 0) * 0.7::DOUBLE + (follow_up IS NULL AND engaged_s IS NULL)::INT * 0.2::DOUBLE AS good,
            coalesce((engaged_s <> 0 AND engaged_s < 5)::INT, 0) * 0.4::DOUBLE + (coalesce(length(follow_up), 0) > 10)::INT * 0.5::DOUBLE AS bad FROM m),
        done AS (SELECT *, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS feedback_type,
            round(CASE WHEN good > bad THEN least(good, 1) WHEN bad > good THEN least(bad, 1) ELSE 0.5 END, 6) AS confidence FROM p)"""


_QUERY = "CASE WHEN event_type = 'view' THEN 'short' ELSE 'a longer follow-up' END"

ORACLE_SQL: dict[str, str] = {
    "incremental_links": f"""WITH {_LAST_FILES}, first AS (SELECT name, min(path) AS path FROM ent GROUP BY name)
        SELECT r.path, 'main' AS source, 'calls' AS type, r.target_name, coalesce(own.path, first.path) AS target_path
        FROM (SELECT DISTINCT * FROM ref) r LEFT JOIN (SELECT DISTINCT * FROM ent) own ON own.path = r.path AND own.name = r.target_name LEFT JOIN first ON first.name = r.target_name""",
    "incremental_entities": f"WITH {_LAST_FILES} SELECT DISTINCT path, name, 'function' AS entity_type FROM ent",
    "bulk_sync": "SELECT DISTINCT 'http://x/c' || c_custkey % 400 AS s, 'http://x/segment' AS p, c_mktsegment AS o, 'literal' AS o_kind FROM customer WHERE c_custkey % 9 <> 4 AND c_custkey % 11 <> 5",
    "stream_follow_ups": f"""WITH e AS (SELECT user_id AS session_id, event_id AS id, epoch_us(ts) // 1000 AS ms, {_QUERY} AS query, value * 40 AS response_ms FROM events), {_feedback("e")}
        SELECT session_id, id, follow_up, engaged_s, feedback_type, confidence FROM done WHERE ms + 300000 <= (SELECT max(ms) FROM e) - 600000""",
    "stream_poll_ring": """WITH e AS (SELECT event_type AS container, event_id AS id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 13 <> 0 THEN round(value * 100) END AS value FROM events),
        r AS (SELECT container, id, ms, list({'ms': ms, 'value': value}) OVER (PARTITION BY container ORDER BY ms, id ROWS BETWEEN 287 PRECEDING AND CURRENT ROW) AS ring FROM e),
        k AS (SELECT container, id, ms, list_filter(ring, lambda p: p.ms > ms - 86400000) AS ring FROM r),
        v AS (SELECT *, list_filter(list_transform(ring, lambda p: p.value), lambda x: x IS NOT NULL) AS vals FROM k)
        SELECT container, id, len(ring)::INT AS polls, list_min(vals) AS least, round(list_avg(vals), 6) AS mean, list_max(vals) AS most FROM v WHERE ms <= (SELECT max(ms) FROM e) - 600000""",
    "implicit_feedback_limited": f"""WITH e AS (SELECT user_id AS session_id, event_id AS id, epoch_us(ts) // 1000 AS ms, {_QUERY} AS query, value AS response_ms FROM events), {_feedback("e")}
        SELECT id, follow_up, engaged_s, feedback_type, confidence FROM done""",
    "session_fingerprint": """SELECT c_custkey, 'auto_' || left(sha256('[' || concat_ws(', ', '(''ip_address'', ''10.0.0.' || c_nationkey || ''')', '(''user_agent'', ''' || c_mktsegment || ''')',
        CASE WHEN c_custkey % 3 <> 0 THEN '(''user_id'', ''' || c_name || ''')' END) || ']'), 16) AS session_id FROM customer""",
}
