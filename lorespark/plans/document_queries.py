"""Registered queries over documents, vectors, memories, interactions and versions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import scoring as s
from lorespark.functions import text as t
from lorespark.operators import documents as d
from lorespark.operators import extraction, fusion, graph, memory, ontology, retrieval, routing, versioning
from lorespark.sources.catalog import AS_OF, Catalog
from lorespark.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]

#: A fixed query vector of 64 components.
VECTOR = [((i * 37) % 11 - 5) / 40.0 for i in range(64)]
_V = "[" + ", ".join(f"{v!r}::DOUBLE" for v in VECTOR) + "]"
_COS = f"coalesce(list_cosine_similarity(embedding::DOUBLE[], {_V}), 0)"


def _now() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return Catalog(spark, sf).knowledge


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return Catalog(spark, sf).golden_nodes


def _scores(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, _r("score").alias("score"))


def _with_content(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a vector: those whose id an embedding shares."""
    c = Catalog(spark, sf)
    return c.knowledge.select("id", "content").join(c.golden_nodes.select("id", "embedding"), "id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion items: for each of ten queries the embeddings of one label, from three kinds of sources, with some equal texts."""
    n = _nodes(spark, sf)
    kind = F.element_at(F.array(F.lit("graph"), F.lit("vector"), F.lit("database")), (F.col("id") % 3 + 1).cast("int"))
    at = F.to_timestamp(F.lit("2024-01-25 00:00:00")) + F.make_dt_interval(hours=(F.col("id") % 140).cast("int"))
    return n.select(F.col("entity_type").cast("long").alias("query_id"), F.col("id").alias("position"), F.concat(F.lit("text "), F.col("id") % 37).alias("content"), kind.alias("source_type"), F.col("id").cast("string").alias("source_id"), (0.5 + (F.col("id") % 5) / 10.0).alias("confidence"), (0.6 + (F.col("id") % 4) / 10.0).alias("authority"), at.alias("at"), F.col("embedding").cast("array<double>").alias("embedding"))


_ITEMS = f"""items AS (SELECT label::BIGINT AS query_id, vec_id AS position, 'text ' || (vec_id % 37) AS content, ['graph', 'vector', 'database'][vec_id % 3 + 1] AS source_type,
    0.5 + (vec_id % 5) / 10.0::DOUBLE AS confidence, 0.6 + (vec_id % 4) / 10.0::DOUBLE AS authority, TIMESTAMP '2024-01-25' + to_hours((vec_id % 140)::INT) AS seen, {_COS} AS query_score FROM embeddings),
    scored AS (SELECT *, least(1, pow(2, -(epoch(TIMESTAMP '{AS_OF}') - epoch(seen)) / 86400.0)) AS recency FROM items),
    rated AS (SELECT *, least(1, 0.4 * query_score + 0.2 * authority + 0.1 * recency + 0.1 * confidence) AS relevance_score FROM scored)"""


def _ontology(spark: SparkSession, sf: str) -> ontology.Ontology:
    """Vectors as classes, each below the one whose number lacks its last digit; parts as properties, those of size 1 as transitive ones."""
    c = Catalog(spark, sf)
    name = lambda kind, k: F.concat(F.lit(f"urn:x#{kind}"), k.cast("string"))
    owl, rdf, rdfs = ("http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#subClassOf")
    say = lambda df, s_, p, o: df.select(s_.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    nodes, part = c.golden_nodes.select("id", "parent_id"), c.table("part").select(F.col("p_partkey").alias("k"), "p_size")
    me, prop = name("C", F.col("id")), name("has_part", F.col("k"))
    triples = [
        say(nodes, me, rdf, F.lit(owl + "Class")), say(nodes.filter("parent_id is not null"), me, rdfs, name("C", F.col("parent_id"))),
        say(part, prop, rdf, F.when(F.col("k") % 3 == 0, owl + "DatatypeProperty").otherwise(owl + "ObjectProperty")), say(part.filter("p_size = 1"), prop, rdf, F.lit(owl + "TransitiveProperty")),
        say(part.filter("k % 3 = 1"), prop, owl + "inverseOf", name("has_part", F.col("k") + 1)),
    ]
    return ontology.Ontology.of_triples(reduce(DataFrame.unionByName, triples))


def _greedy(weight: float) -> str:
    """SQL of the greedy choice of ten items a query, each step in one round of a recursion."""
    return f"""WITH RECURSIVE {_ITEMS}, r AS (SELECT query_id, position, relevance_score AS own, embedding::DOUBLE[] AS v FROM rated JOIN embeddings ON vec_id = position),
        b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, position) AS j FROM r),
        g AS (
            SELECT query_id, 1 AS step, [position] AS chosen, [v] AS vectors, position, own AS final FROM b WHERE j = 1
            UNION ALL SELECT query_id, step + 1, list_append(chosen, position), list_append(vectors, v), position, adjusted
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, own DESC, position) AS j
                FROM (SELECT g.query_id, g.step, g.chosen, g.vectors, r.position, r.v, r.own, r.own - {weight} * greatest(0, list_max(list_transform(g.vectors, lambda u: list_cosine_similarity(u, r.v)))) AS adjusted
                    FROM g JOIN r ON r.query_id = g.query_id WHERE g.step < 10 AND NOT list_contains(g.chosen, r.position)))
            WHERE j = 1 AND adjusted > -1)
        SELECT query_id, position, step::INT AS rank, round(final, 6) AS final_score FROM g"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.scored(_items(spark, sf), F.array(*map(F.lit, VECTOR)), _now())


def _fused(strategy: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fusion.fused(_scored(spark, sf), strategy).select("query_id", "position", F.col("rank").cast("int").alias("rank"), _r("final_score").alias("final_score"))

    return run


def _interactions(spark: SparkSession, sf: str) -> DataFrame:
    return Catalog(spark, sf).interactions


_FEEDBACK = """i AS (SELECT event_id AS id, user_id AS session_id, ts, event_type, value AS response_ms,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'positive' WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'view' THEN 'neutral' ELSE 'explicit_rating' END AS feedback_type,
    CASE WHEN event_type = 'signup' THEN event_id % 5 + 1 END AS feedback_value FROM events)"""


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with telling words, made from the ids of benchmark items."""
    words = ("What are the dependencies of Flask?", "Find code similar to Django views", "list all records", 'who calls "parse_tree" in class AuthService', "Show the function that invokes camelCase and snake_case", "which package imports depends_on module")
    return Catalog(spark, sf).table("benchmark").select("item_id", F.element_at(F.array(*map(F.lit, words)), (F.col("item_id") % 6 + 1).cast("int")).alias("question"))


_QUESTIONS = """q AS (SELECT item_id, ['What are the dependencies of Flask?', 'Find code similar to Django views', 'list all records', 'who calls "parse_tree" in class AuthService', 'Show the function that invokes camelCase and snake_case', 'which package imports depends_on module'][item_id % 6 + 1] AS question FROM benchmark)"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """File paths made from page ids."""
    names = ("src/app/test_main.py", "docs/guide.md", "web/index.spec.ts", "config/settings.py", "lib/Core.java", "docker-compose.yml", "a/b/style.scss", "README", "cmd/server.go", ".claude/notes.txt", "x/pkg\\win.cpp", "package.json")
    return Catalog(spark, sf).table("pages").select("page_id", F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % 12 + 1).cast("int")).alias("path"))


_PATHS = r"""f AS (SELECT page_id, ['src/app/test_main.py', 'docs/guide.md', 'web/index.spec.ts', 'config/settings.py', 'lib/Core.java', 'docker-compose.yml', 'a/b/style.scss', 'README', 'cmd/server.go', '.claude/notes.txt', 'x/pkg\win.cpp', 'package.json'][page_id % 12 + 1] AS path FROM pages)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return Catalog(spark, sf).versions


_VERSIONS = "v AS (SELECT doc_id AS id, source AS branch_name, 'entity_' || (doc_id % 50) AS entity_name, md5(text) AS content_hash, lang AS entity_type, doc_id AS updated_at FROM documents)"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    e = Catalog(spark, sf).table("events")
    kind = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "R").when(F.col("event_type") == "purchase", "A").otherwise("M")
    return e.select(F.col("event_type").alias("branch_name"), kind.alias("change_type"), F.concat(F.lit("f"), "user_id").alias("path"), F.concat(F.lit("old"), "user_id").alias("old_path"), "event_id", "ts")


_CHANGES = "c AS (SELECT event_type AS branch_name, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'R' WHEN 'purchase' THEN 'A' ELSE 'M' END AS change_type, 'f' || user_id AS path, 'old' || user_id AS old_path, event_id, ts FROM events)"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as stored records with a state and times."""
    o = Catalog(spark, sf).table("orders")
    state = F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "O", "active").otherwise("stale")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=(F.col("o_orderkey") % 720).cast("int"))
    return o.select(F.lit("repo").alias("repository_url"), F.col("o_orderpriority").alias("branch_name"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_version_id"), state.alias("state"), at.alias("updated_at"), at.alias("created_at"), versioning.ttl_of(state).alias("ttl"))


_RECORDS = """r AS (SELECT o_orderpriority AS branch_name, o_orderkey AS id, o_custkey AS file_version_id, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'active' ELSE 'stale' END AS state,
    TIMESTAMP '2024-01-01' + to_hours((o_orderkey % 720)::INT) AS updated_at, CASE WHEN o_orderstatus IN ('F', 'O') THEN 30 * 86400 ELSE 7 * 86400 END AS ttl FROM orders)"""


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    table = _records(spark, sf)
    new = table.filter("id % 10 = 0").withColumn("state", F.lit("deleted")).drop("created_at", "updated_at")
    more = new.filter("id % 100 = 0").withColumn("id", F.col("id") + 10_000_000)
    out = versioning.upsert(table, new.unionByName(more), _now(), ttl=86400)
    return out.select("id", "state", "ttl", (F.col("updated_at") == _now()).alias("new"), (F.col("created_at") == _now()).alias("created_now"))


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    lines = Catalog(spark, sf).table("lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")).distinct()
    gone = Catalog(spark, sf).table("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    entities, edges = versioning.cascade(gone, _records(spark, sf).select("id", "file_version_id"), lines)
    return entities.select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.col("file_version_id").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b")))


def _stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    events = Catalog(spark, sf).table("events").select("user_id", "event_type", "ts")
    return sync.run_to_end(sync.deduplicated(sync.event_stream(events), ["user_id", "event_type"]).select("user_id", "event_type"), "dedup")


def _stream_window(spark: SparkSession, sf: str) -> DataFrame:
    stream = sync.event_stream(Catalog(spark, sf).table("events"))
    return sync.run_to_end(sync.tumbling(stream), "tumbling", "complete").select(F.col("start").cast("date").cast("string").alias("start"), "event_type", "n", _r("total", 2).alias("total"))


def _stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    stream = sync.event_stream(Catalog(spark, sf).table("events").select("user_id", "ts"))
    out = sync.run_to_end(sync.sessions(stream, "30 minutes"), "sessions", "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


def _stream_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Triple documents with doubles and broken rows, synchronised in two runs."""
    from lorespark.sources.tables import new_path

    c = Catalog(spark, sf).table("customer")
    docs = c.select(F.when(F.col("c_custkey") % 9 == 4, "other").otherwise("rdf_triple").alias("type"), F.concat(F.lit("http://x/c"), F.pmod("c_custkey", F.lit(1000))).alias("subject"), F.when(F.col("c_custkey") % 11 != 5, "http://x/segment").alias("predicate"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')).alias("object"))
    path, target, checkpoint = (new_path(spark, n) for n in ("docs", "synced", "sync-checkpoint"))
    docs.filter("rand(1) < 0.5").write.parquet(path)
    sync.sync_triples(spark, path, docs.schema.simpleString()[7:-1].replace(":", " "), target, checkpoint)
    docs.write.mode("append").parquet(path)
    return sync.sync_triples(spark, path, docs.schema.simpleString()[7:-1].replace(":", " "), target, checkpoint).select("s", "p", "o", "o_kind")


def _backup(spark: SparkSession, sf: str) -> DataFrame:
    from lorespark.sources.formats import backup
    from lorespark.sources.tables import new_path

    c = Catalog(spark, sf)
    return backup({n: c.table(n) for n in ("region", "nation", "supplier")}, new_path(spark, "backup"))


def _percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return d.floor_percentiles(_interactions(spark, sf), ["event_type"], "response_ms", {"median": 0.5, "p95": 0.95, "p99": 0.99}).select("event_type", "n", _r("mean").alias("mean"), "least", "most", "median", "p95", "p99")


def _intents(spark: SparkSession, sf: str) -> DataFrame:
    model = routing.IntentModel().fit(routing.training_set(spark))
    return model.classify(_questions(spark, sf).withColumnRenamed("question", "text")).select("item_id", "intent", _r("confidence").alias("confidence"), "level")


QUERIES: dict[str, Query] = {
    # documents
    "doc_projection": lambda spark, sf: _docs(spark, sf).select("id", F.col("lang").alias("language"), F.length("content").alias("size")),
    "doc_filters": lambda spark, sf: d.filtered(_docs(spark, sf), lang=["en", "fr"], source="src3").filter("n_chars >= 500").select("id", "lang"),
    "doc_point_read": lambda spark, sf: d.point_read(_docs(spark, sf), "id", 17, source="src17").select("id", "lang"),
    "keyword_search": lambda spark, sf: retrieval.keyword_search(_docs(spark, sf), "the").select("id"),
    "keyword_ci_multi": lambda spark, sf: retrieval.keyword_search_any(_docs(spark, sf), "SRC1", ["lang", "source"], 100).select("id"),
    "doc_counts": lambda spark, sf: _docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")),
    "doc_exact_dedup": lambda spark, sf: d.first_of(_docs(spark, sf).select("id", F.md5("content").alias("hash"), "source"), ["hash"], [F.col("id")]),
    "doc_keep_last": lambda spark, sf: d.last_of(_versions(spark, sf).select("branch_name", "entity_name", "id", "updated_at"), ["branch_name", "entity_name"], [F.col("updated_at"), F.col("id")]).select("branch_name", "entity_name", "id"),
    "doc_preferred": lambda spark, sf: d.first_of(_versions(spark, sf).select("entity_name", "entity_type", "id"), ["entity_name"], [F.when(F.col("entity_type") == "fr", 0).otherwise(1), F.when(F.col("entity_type") == "de", 0).otherwise(1), -F.col("id")]).select("entity_name", "entity_type", "id"),
    "doc_partial_object": lambda spark, sf: Catalog(spark, sf).table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("items")).filter(F.exists("items", lambda x: (x["l_partkey"] == 7) & (x["l_quantity"] > 10))).select("l_orderkey", F.size("items").alias("n")),
    "doc_semi_join": lambda spark, sf: _docs(spark, sf).select("id", "lang").join(Catalog(spark, sf).table("labels").filter("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi"),
    "doc_union_dedup": lambda spark, sf: d.first_of(_docs(spark, sf).filter("lang = 'en'").select("id", F.lit(0).alias("part")).unionByName(_docs(spark, sf).filter("n_chars > 2000").select("id", F.lit(1).alias("part"))), ["id"], [F.col("part")]),
    "name_resolution": lambda spark, sf: d.resolved(Catalog(spark, sf).table("nation").select("n_nationkey", F.concat(F.lit("../pkg."), F.col("n_name")).alias("name")), Catalog(spark, sf).table("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("entity_id")), extraction.import_candidates(F.col("name"))),
    "hot_cold_partitions": lambda spark, sf: d.balance(_interactions(spark, sf), "event_type"),
    "balance_score": lambda spark, sf: d.balance_score(_docs(spark, sf), "lang"),
    "latency_percentiles": _percentiles,
    "ema_stats": lambda spark, sf: d.moving_average(_interactions(spark, sf), ["session_id"], ["ts", "id"], "response_ms").select("session_id", _r("average").alias("average")),
    "running_mean": lambda spark, sf: d.running_mean(_interactions(spark, sf), ["session_id"], [F.col("ts"), F.col("id")], "response_ms").select("id", _r("running_mean", 10).alias("running_mean")),
    "error_rate": lambda spark, sf: _interactions(spark, sf).groupBy("session_id").agg(_r(d.rate(F.col("event_type") == "error", 100.0), 4).alias("error_rate")),
    "same_group_pairs": lambda spark, sf: d.same_group_pairs(Catalog(spark, sf).table("nation").withColumn("g", F.col("n_regionkey")), "g", "n_nationkey", 100),
    "classification_report": lambda spark, sf: d.classification_report(Catalog(spark, sf).table("labels").withColumn("guess", (F.col("doc_id") % 3 == 0).cast("int")), "quality", "guess").select("class", "support", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1")),
    # vectors
    "vector_topk": lambda spark, sf: _scores(retrieval.vector_search(_nodes(spark, sf), VECTOR, 25, None), "id"),
    "vector_threshold": lambda spark, sf: _scores(retrieval.vector_search(_nodes(spark, sf), VECTOR, None, 0.1), "id"),
    "hierarchical_vector": lambda spark, sf: _scores(retrieval.hierarchical_search(_nodes(spark, sf), VECTOR, parent=3, max_depth=2, limit=15, threshold=-0.5), "id", "hierarchy_level"),
    "hybrid_search": lambda spark, sf: retrieval.hybrid_search(_with_content(spark, sf), "the", VECTOR).select("id", _r("score").alias("score"), "found_by"),
    "rerank_fallback": lambda spark, sf: retrieval.rerank(_docs(spark, sf).select("id", "content", (F.col("id") % 4 / 4.0).alias("score")), "the of and", 20).select("id", _r("rerank_score").alias("rerank_score")),
    "similarity_join": lambda spark, sf: retrieval.similarity_join(_nodes(spark, sf).select("id", "embedding"), 0.3).select("a", "b", _r("similarity", 5).alias("similarity")),
    "cluster_similarity": lambda spark, sf: retrieval.similarity_join(_nodes(spark, sf), -1.0, by="entity_type").select("a", "b", _r("similarity", 5).alias("cosine")),
    "hashed_embeddings": lambda spark, sf: _docs(spark, sf).select("id", F.posexplode(retrieval.hashed_embeddings()(F.col("content"))).alias("position", "value")).filter("value <> 0").select("id", "position", _r(F.col("value").cast("double"), 4).alias("value")),
    # fusion
    "fusion_exact_dedup": lambda spark, sf: fusion.without_copies(_items(spark, sf)).select("query_id", "position", "content"),
    "fusion_scores": lambda spark, sf: _scored(spark, sf).select("query_id", "position", _r("query_score").alias("query_score"), _r("recency").alias("recency"), _r("relevance_score").alias("relevance_score")),
    "fusion_ranked_merge": _fused("ranked_merge"),
    "fusion_relevance_first": _fused("relevance_first"),
    "fusion_weighted": _fused("weighted_fusion"),
    "fusion_balanced": _fused("balanced"),
    "fusion_diversity_first": _fused("diversity_first"),
    "fusion_near_dedup": lambda spark, sf: fusion.without_near_copies(_items(spark, sf), 0.25).select("query_id", "position"),
    "diversity_score": lambda spark, sf: fusion.diversity(_items(spark, sf)).select("query_id", _r("diversity").alias("diversity")),
    # memory and learning
    "memory_importance": lambda spark, sf: Catalog(spark, sf).memory.select("session_id", "position", _r(s.importance(F.col("content"), F.col("type"))).alias("importance")),
    "memory_text_match": lambda spark, sf: memory.text_matches(Catalog(spark, sf).memory, "the of zzz").select("session_id", "position"),
    "memory_retrieve": lambda spark, sf: memory.retrieve(*(Catalog(spark, sf).memory.withColumn("importance", s.importance(F.col("content"), F.col("type"))),) * 2, 3, "the and of", 8).select("id", _r("importance").alias("importance"), _r("likeness").alias("likeness")),
    "session_feedback_ratio": lambda spark, sf: memory.feedback_ratios(_interactions(spark, sf)).select("session_id", "interactions", _r("ratio").alias("ratio"), "should_adapt", "strategy"),
    "session_last_n": lambda spark, sf: memory.last_interactions(_interactions(spark, sf), 5).select("session_id", "id", F.col("rank").cast("int").alias("rank")),
    "explicit_rating_score": lambda spark, sf: memory.with_scores(_interactions(spark, sf)).select("id", "score"),
    "implicit_feedback": lambda spark, sf: memory.with_implied_feedback(_interactions(spark, sf).drop("feedback_type").withColumn("query", F.when(F.col("event_type") == "view", "short").otherwise("a longer follow-up")), "query").select("id", "feedback_type", _r("confidence").alias("confidence")),
    # routing
    "router_keywords": lambda spark, sf: _questions(spark, sf).select("item_id", routing.route(F.col("question")).alias("route")),
    "entity_extraction": lambda spark, sf: _questions(spark, sf).select("item_id", F.array_join(t.entity_names(F.col("question")), ",").alias("names")),
    "keyword_extraction": lambda spark, sf: _questions(spark, sf).select("item_id", F.array_join(t.keywords(F.col("question")), ",").alias("keywords")),
    "template_match": lambda spark, sf: routing.translations(_questions(spark, sf)).select("item_id", "template", _r("template_score").alias("template_score"), _r("confidence").alias("confidence")),
    "strategy_selection": lambda spark, sf: Catalog(spark, sf).table("labels").select("doc_id", routing.strategy_column(F.when(F.col("quality") == 1, "GRAPH_RAG").when(F.col("toxic") == 1, "HYBRID").otherwise("OTHER"), (F.col("doc_id") % 10 / 10.0)).alias("strategies")),
    "intent_model": _intents,
    "diagram_type": lambda spark, sf: _questions(spark, sf).select("item_id", routing.diagram_type(F.col("question")).alias("type")),
    "question_entities": lambda spark, sf: _questions(spark, sf).select("item_id", F.array_join(routing.named_things(F.col("question"), routing.ENTITY_WORDS), ",").alias("entities"), F.array_join(routing.named_things(F.col("question"), routing.RELATION_WORDS), ",").alias("relations")),
    "containing_join": lambda spark, sf: d.containing_join(Catalog(spark, sf).table("nation").select(F.col("n_nationkey").alias("part_id"), F.concat(F.lit("#"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("part")).withColumn("part", F.substring("part", 3, 2)), Catalog(spark, sf).table("supplier").select(F.col("s_suppkey").alias("whole_id"), F.col("s_name").alias("whole"))),
    "ontology_search": lambda spark, sf: _ontology(spark, sf).search("*T1?"),
    "ontology_subclasses": lambda spark, sf: _ontology(spark, sf).subclasses("urn:x#C1"),
    "ontology_info": lambda spark, sf: _ontology(spark, sf).info(),
    "backup": _backup,
    # versions
    "branch_query": lambda spark, sf: versioning.on_branch(_versions(spark, sf), "repo", "src4", "entity_type = 'en'").select("id"),
    "cross_branch_query": lambda spark, sf: versioning.across_branches(_versions(spark, sf), "repo", ["src1", "src2"]).select("id", "branch_name"),
    "merge_conflicts": lambda spark, sf: graph.divergences(_versions(spark, sf), "src1", "src11").select("entity_name", "source_id", "target_id"),
    "changed_both_sides": lambda spark, sf: versioning.merge_conflicts(_changes(spark, sf), "signup", "error"),
    "conflict_summary": lambda spark, sf: versioning.conflict_summary(_changes(spark, sf), "signup", "error"),
    "changed_paths": lambda spark, sf: versioning.changed_paths(_changes(spark, sf)),
    "soft_delete": lambda spark, sf: versioning.soft_deleted(_records(spark, sf).withColumn("path", F.concat(F.lit("f"), "file_version_id")), _changes(spark, sf).filter("change_type = 'D'"), _now())[0].groupBy((F.col("deleted_at").isNotNull()).alias("deleted")).agg(F.count(F.lit(1)).alias("n")),
    "cascade_delete": _cascade,
    "ttl_expired": lambda spark, sf: versioning.unexpired(_records(spark, sf), _now()).select("id", "state"),
    "purge_branch": lambda spark, sf: versioning.purged(_records(spark, sf), "repo", "1-URGENT").select("id"),
    "upsert": _upserted,
    "commit_latest": lambda spark, sf: versioning.latest_commits(_changes(spark, sf).select(F.lit("repo").alias("repository_url"), "branch_name", F.col("ts").alias("committed_at"), F.col("event_id").alias("sha"))).select("branch_name", "sha"),
    "commits_since": lambda spark, sf: versioning.commits_since(Catalog(spark, sf).table("events").select(F.col("event_id").cast("string").alias("sha"), F.struct("ts", "event_id").alias("sequence"), "event_id"), "500").select("event_id"),
    # text
    "language_detect": lambda spark, sf: _files(spark, sf).select("page_id", t.language(F.col("path")).alias("language"), t.extension(F.col("path")).alias("extension"), t.file_name(F.col("path")).alias("name")),
    "file_roles": lambda spark, sf: _files(spark, sf).select("page_id", *(t.file_role(F.col("path"), role).alias(role) for role in ("test", "config", "documentation"))),
    "backup_tags": lambda spark, sf: _files(spark, sf).select("page_id", F.array_join(t.path_tags(F.col("path")), ",").alias("tags")),
    "line_counts": lambda spark, sf: _docs(spark, sf).select("id", *(c.alias(n) for n, c in zip(("lines", "full_lines"), t.line_counts(F.col("content")), strict=True))),
    "term_overlap": lambda spark, sf: _docs(spark, sf).select("id", _r(t.overlap(F.lit("the of and les der"), F.col("content"))).alias("share")),
    "jaccard": lambda spark, sf: _docs(spark, sf).select("id", _r(t.jaccard(F.lit("the of and les der"), F.col("content"))).alias("jaccard")),
    "truncate_ellipsis": lambda spark, sf: _docs(spark, sf).select("id", t.shortened(F.col("content"), 30).alias("short"), t.cut_with_mark(F.col("content"), 100).alias("cut")),
    "sha_ids": lambda spark, sf: _docs(spark, sf).select("id", t.short_hash(F.col("content")).alias("sha"), F.left(F.md5("content"), F.lit(8)).alias("md5"), t.file_identity(F.col("source"), F.concat(F.lit("/a\\b"), F.col("id"))).alias("identity")),
    "partition_key": lambda spark, sf: _docs(spark, sf).select("id", t.partition_key(F.col("source"), F.col("lang")).alias("key")),
    "uri_generation": lambda spark, sf: _files(spark, sf).select("page_id", t.entity_iri("urn:x#", F.lit("Class"), F.col("path"), F.concat(F.lit("My Name/"), F.col("page_id"))).alias("iri")),
    "call_parse": lambda spark, sf: _files(spark, sf).select("page_id", F.array_join(t.called_names(F.concat(F.lit("a.b"), F.col("page_id"), F.lit(".run(x, y)"))), "|").alias("names")),
    "parse_analysis": lambda spark, sf: _docs(spark, sf).select("id", t.labelled_reply(F.concat(F.lit("SUMMARY: doc "), F.col("id"), F.lit("\nCOMPLEXITY: High\nDEPENDENCIES: a, b ,none\nTAGS: x,y"))).alias("r")).select("id", "r.summary", "r.complexity", F.array_join("r.dependencies", "|").alias("dependencies"), F.array_join("r.tags", "|").alias("tags")),
    "embedding_text": lambda spark, sf: Catalog(spark, sf).table("part").select("p_partkey", t.embedding_text(F.col("p_name"), F.lit("function"), F.col("p_brand"), F.col("p_size") % 12, F.array(F.col("p_type")), F.array().cast("array<string>"), F.lit("")).alias("text")),
    "page_links": lambda spark, sf: extraction.page_links(Catalog(spark, sf).pages).groupBy("source_id").agg(F.count(F.lit(1)).alias("links")),
    "regex_entities": lambda spark, sf: extraction.pattern_entities(Catalog(spark, sf).table("nation").select(F.col("n_name").alias("path"), F.concat(F.lit("import x\n  def f_"), F.col("n_nationkey"), F.lit("(a):\nclass A:\n")).alias("content")), "python"),
    "python_entities": lambda spark, sf: extraction.python_entities(Catalog(spark, sf).table("nation").select(F.col("n_name").alias("path"), F.concat(F.lit("import os\nclass A:\n    def f(self):\n        return g("), F.col("n_nationkey"), F.lit(")\n")).alias("content"))).select("path", "name", "entity_type", "parent_entity"),
    # streams
    "stream_dedup": _stream_dedup,
    "window_tumbling": _stream_window,
    "window_session": _stream_sessions,
    "stream_sync_dedup": _stream_sync,
    "stream_ttl": lambda spark, sf: sync.run_to_end(sync.unexpired(sync.event_stream(Catalog(spark, sf).table("events")), 86400 * 3, _now()).select("event_id"), "ttl"),
}

_TOKENS = "CASE WHEN trim({c}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN [] ELSE list_distinct(regexp_split_to_array(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '\\s+')) END"
_QUERY_WORDS = "['the', 'of', 'and', 'les', 'der']"
_IMPORTANCE = "least(1, CASE role WHEN 'assistant' THEN 0.8 WHEN 'user' THEN 0.6 ELSE 0.7 END + least(0.3, 0.1 * (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in s.IMPORTANT_WORDS) + ")) + least(length(text) / 1000.0, 0.1))"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _ranked(score: str, n: int = 10) -> str:
    return f"WITH {_ITEMS}, x AS (SELECT query_id, position, {score} AS final_score FROM rated) SELECT query_id, position, rank::INT AS rank, round(final_score, 6) AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, position) AS rank FROM x) WHERE rank <= {n}"


_TEMPLATES = " ".join(f"WHEN best = {i} THEN '{n}'" for i, n in enumerate(routing.TEMPLATE_WORDS))
_TEMPLATE_SCORES = [" + ".join(f"contains(lower(question), '{w}')::INT" for w in words) for words, _ in routing.TEMPLATE_WORDS.values()]

def _things(words: dict[str, tuple[str, ...]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any('question', w)} THEN '{k}' END" for k, w in words.items()) + "], lambda x: x IS NOT NULL), ',')"


_DIAGRAMS = [(k, " + ".join(f"contains(lower(question), '{x}')::INT" for x in w)) for k, w in routing.DIAGRAM_WORDS.items()]

ORACLE_SQL: dict[str, str] = {
    "diagram_type": f"WITH {_QUESTIONS}, x AS (SELECT item_id, [{', '.join(n for _, n in _DIAGRAMS)}] AS n FROM q) SELECT item_id, CASE WHEN list_max(n) = 0 THEN 'flowchart TD' ELSE [{', '.join(repr(k) for k, _ in _DIAGRAMS)}][list_position(n, list_max(n))] END AS type FROM x",
    "question_entities": f"WITH {_QUESTIONS} SELECT item_id, {_things(routing.ENTITY_WORDS)} AS entities, {_things(routing.RELATION_WORDS)} AS relations FROM q",
    "containing_join": "WITH p AS (SELECT n_nationkey AS part_id, substr('#' || lpad(n_nationkey::VARCHAR, 3, '0'), 3, 2) AS part FROM nation) SELECT part_id, part, min(s_suppkey) AS whole_id FROM p JOIN supplier ON contains(s_name, part) GROUP BY part_id, part",
    "ontology_search": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'data property' ELSE 'object property' END AS kind, 'urn:x#has_part' || p_partkey AS iri FROM part WHERE p_partkey BETWEEN 10 AND 19",
    "ontology_subclasses": "SELECT 'urn:x#C' || vec_id AS iri, (length(vec_id::VARCHAR) - 1)::INT AS depth FROM embeddings WHERE starts_with(vec_id::VARCHAR, '1') AND vec_id > 1",
    "ontology_info": """SELECT count(*) AS classes, count(*) FILTER (vec_id < 10) AS roots, any_value(o) AS object_properties, any_value(d) AS data_properties, any_value(t) AS transitive_properties
        FROM embeddings, (SELECT count(*) FILTER (p_partkey % 3 <> 0) AS o, count(*) FILTER (p_partkey % 3 = 0) AS d, count(*) FILTER (p_size = 1) AS t FROM part)""",
    "backup": "SELECT 'region' AS name, count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier",
    "doc_projection": "SELECT doc_id AS id, lang AS language, length(text) AS size FROM documents",
    "doc_filters": "SELECT doc_id AS id, lang FROM documents WHERE lang IN ('en', 'fr') AND source = 'src3' AND n_chars >= 500",
    "doc_point_read": "SELECT doc_id AS id, lang FROM documents WHERE doc_id = 17 AND source = 'src17'",
    "keyword_search": "SELECT doc_id AS id FROM documents WHERE contains(text, 'the') ORDER BY id LIMIT 25",
    "keyword_ci_multi": "SELECT doc_id AS id FROM documents WHERE lower(lang) LIKE '%src1%' OR lower(source) LIKE '%src1%' ORDER BY id LIMIT 100",
    "doc_counts": "SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang",
    "doc_exact_dedup": "SELECT id, hash, source FROM (SELECT doc_id AS id, md5(text) AS hash, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    "doc_keep_last": f"WITH {_VERSIONS} SELECT branch_name, entity_name, max(id) AS id FROM v GROUP BY ALL",
    "doc_preferred": f"WITH {_VERSIONS} SELECT entity_name, entity_type, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY entity_type = 'fr' DESC, entity_type = 'de' DESC, id DESC) AS k FROM v) WHERE k = 1",
    "doc_partial_object": "SELECT l_orderkey, count(*)::INT AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7 AND l_quantity > 10) GROUP BY l_orderkey",
    "doc_semi_join": "SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "doc_union_dedup": "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS part FROM documents WHERE lang = 'en' OR n_chars > 2000",
    "name_resolution": "SELECT n_nationkey, '../pkg.' || n_name AS name, n_regionkey AS entity_id FROM nation",
    "hot_cold_partitions": "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), m AS (SELECT avg(n) AS mean FROM c) SELECT event_type, n, CASE WHEN n > 2 * mean THEN 'hot' WHEN n < 0.5 * mean THEN 'cold' ELSE 'normal' END AS state FROM c, m",
    "balance_score": "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT avg(n) AS mean FROM c) SELECT 1 - count(*) FILTER (n > 2 * mean OR n < 0.5 * mean) / count(*)::DOUBLE AS balance_score FROM c, m",
    "latency_percentiles": "WITH g AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n, round(list_avg(v), 6) AS mean, v[1] AS least, v[-1] AS most, v[floor(0.5 * n)::INT + 1] AS median, v[floor(0.95 * n)::INT + 1] AS p95, v[floor(0.99 * n)::INT + 1] AS p99 FROM g",
    "ema_stats": "WITH g AS (SELECT user_id AS session_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT session_id, round(list_reduce(v, lambda a, x: 0.1 * x + 0.9 * a), 6) AS average FROM g",
    "running_mean": "SELECT event_id AS id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 10) AS running_mean FROM events",
    "error_rate": "SELECT user_id AS session_id, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate FROM events GROUP BY user_id",
    "same_group_pairs": "SELECT a.n_regionkey AS g, a.n_nationkey, b.n_nationkey AS other_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "classification_report": "WITH x AS (SELECT quality AS y, (doc_id % 3 = 0)::INT AS g FROM labels), c AS (SELECT c AS class, count(*) FILTER (y = c) AS support, count(*) FILTER (g = c) AS predicted, count(*) FILTER (y = c AND g = c) AS hits FROM x, (VALUES (0), (1)) AS k(c) GROUP BY c) SELECT class, support, round(hits / predicted::DOUBLE, 6) AS precision, round(hits / support::DOUBLE, 6) AS recall, round(2 * (hits / predicted::DOUBLE) * (hits / support::DOUBLE) / (hits / predicted::DOUBLE + hits / support::DOUBLE), 6) AS f1 FROM c",
    "vector_topk": f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, id LIMIT 25",
    "vector_threshold": f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} > 0.1",
    "hierarchical_vector": f"SELECT vec_id AS id, length(vec_id::VARCHAR) - 1 AS hierarchy_level, round({_COS}, 6) AS score FROM embeddings WHERE vec_id::VARCHAR LIKE '3_%' AND length(vec_id::VARCHAR) <= 3 AND {_COS} > -0.5 ORDER BY {_COS} DESC, id LIMIT 15",
    "hybrid_search": f"""WITH c AS (SELECT doc_id AS id, text, {_COS} AS score FROM documents JOIN embeddings ON doc_id = vec_id), v AS (SELECT id, score FROM c ORDER BY score DESC, id LIMIT 25), k AS (SELECT id FROM c WHERE contains(text, 'the') ORDER BY id LIMIT 25)
        SELECT id, round(score, 6) AS score, 'vector' AS found_by FROM v UNION ALL SELECT id, NULL, 'keyword' FROM k WHERE id NOT IN (SELECT id FROM v)""",
    "rerank_fallback": f"""WITH x AS (SELECT doc_id AS id, text, doc_id % 4 / 4.0::DOUBLE AS score, {_TOKENS.format(c="text")} AS w FROM documents),
        y AS (SELECT id, 0.4 * (list_contains(w, 'the')::INT + list_contains(w, 'of')::INT + list_contains(w, 'and')::INT) / 3.0::DOUBLE + 0.3 * CASE WHEN contains(lower(text), 'the of and') THEN 0.2 ELSE 0 END + 0.1 * greatest(0, 1 - length(text) / 2000.0::DOUBLE) + 0.2 * CASE WHEN score = 0 THEN 0.5 ELSE score END AS z FROM x)
        SELECT id, round(z, 6) AS rerank_score FROM y ORDER BY z DESC, id LIMIT 20""",
    "similarity_join": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3",
    "cluster_similarity": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id",
    "hashed_embeddings": r"""WITH w AS (SELECT doc_id AS id, md5(unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'))) AS m FROM documents),
        v AS (SELECT id, ('0x' || substr(m, 1, 8))::BIGINT % 64 AS position, sum(CASE WHEN substr(m, 9, 1) < '8' THEN -1 ELSE 1 END)::DOUBLE AS value FROM w GROUP BY 1, 2)
        SELECT id, position, round((value / sqrt(sum(value * value) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 4) AS value FROM v WHERE value <> 0""",
    "fusion_exact_dedup": f"WITH {_ITEMS} SELECT query_id, min(position) AS position, content FROM items GROUP BY query_id, content",
    "fusion_scores": f"WITH {_ITEMS} SELECT query_id, position, round(query_score, 6) AS query_score, round(recency, 6) AS recency, round(relevance_score, 6) AS relevance_score FROM rated",
    "fusion_ranked_merge": _ranked("relevance_score"),
    "fusion_relevance_first": _ranked("query_score"),
    "fusion_weighted": _ranked("least(1, relevance_score * CASE source_type WHEN 'graph' THEN 1.2 WHEN 'database' THEN 1.1 ELSE 1 END * authority)"),
    "diversity_score": "SELECT a.label::BIGINT AS query_id, round(greatest(0, least(1, 1 - avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))), 6) AS diversity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label",
    "memory_importance": f"SELECT conv_id AS session_id, turn AS position, round({_IMPORTANCE}, 6) AS importance FROM conversations",
    "memory_text_match": f"SELECT conv_id AS session_id, turn AS position FROM conversations WHERE list_has_any({_TOKENS.format(c='text')}, ['the', 'of', 'zzz'])",
    "memory_retrieve": f"""WITH m AS (SELECT left(sha256(conv_id || ':' || turn), 16) AS id, {_IMPORTANCE} AS importance, len(list_intersect(['the', 'and', 'of'], {_TOKENS.format(c='text')})) / 3.0::DOUBLE AS likeness FROM conversations WHERE conv_id = 3),
        a AS (SELECT * FROM m WHERE likeness > 0 ORDER BY likeness DESC, id LIMIT 4), b AS (SELECT * FROM m ORDER BY importance DESC, likeness DESC, id LIMIT 4)
        SELECT id, round(importance, 6) AS importance, round(likeness, 6) AS likeness FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "session_feedback_ratio": f"""WITH {_FEEDBACK}, g AS (SELECT session_id, count(*) AS interactions, count(*) FILTER (feedback_type = 'positive') / nullif(count(*) FILTER (feedback_type IN ('positive', 'negative')), 0)::DOUBLE AS ratio FROM i GROUP BY session_id), h AS (SELECT *, coalesce(ratio, 0.5) AS k FROM g)
        SELECT session_id, interactions, round(ratio, 6) AS ratio, interactions >= 5 AND k < 0.3 AS should_adapt, CASE WHEN k < 0.2 THEN 'pattern_based' WHEN k < 0.4 THEN 'context_aware' WHEN interactions > 20 THEN 'hybrid' ELSE 'feature_based' END AS strategy FROM h""",
    "session_last_n": "SELECT * FROM (SELECT user_id AS session_id, event_id AS id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS rank FROM events) WHERE rank <= 5",
    "explicit_rating_score": f"WITH {_FEEDBACK} SELECT id, CASE feedback_type WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN 0.0 WHEN 'explicit_rating' THEN (feedback_value - 1) / 4.0 ELSE 0.5 END AS score FROM i",
    "implicit_feedback": """WITH n AS (SELECT event_id AS id, value / 1000 AS response_s, lead(CASE WHEN event_type = 'view' THEN 'short' ELSE 'a longer follow-up' END) OVER w AS follow_up, (floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)))::DOUBLE AS engaged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        p AS (SELECT id, (response_s < 2)::INT * 0.3::DOUBLE + CASE WHEN engaged > 30 THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN follow_up IS NULL AND engaged IS NULL THEN 0.2::DOUBLE ELSE 0 END AS good, CASE WHEN engaged <> 0 AND engaged < 5 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN length(follow_up) > 10 THEN 0.5::DOUBLE ELSE 0 END AS bad FROM n)
        SELECT id, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS feedback_type, round(CASE WHEN good > bad THEN least(good, 1) WHEN bad > good THEN least(bad, 1) ELSE 0.5 END, 6) AS confidence FROM p""",
    "router_keywords": f"WITH {_QUESTIONS} SELECT item_id, CASE WHEN {_any('question', routing.GRAPH_WORDS)} THEN 'graph_rag' WHEN {_any('question', routing.VECTOR_WORDS)} THEN 'vector_rag' ELSE 'database_rag' END AS route FROM q",
    "keyword_extraction": f"WITH {_QUESTIONS} SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(question), '\\b[a-zA-Z][a-zA-Z0-9_]*\\b'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in t.STOP_WORDS)}))[1:3], ',') AS keywords FROM q",
    "template_match": f"""WITH {_QUESTIONS}, x AS (SELECT item_id, ({_TEMPLATE_SCORES[0]}) / 5.0::DOUBLE * 0.9 AS a, ({_TEMPLATE_SCORES[1]}) / 6.0::DOUBLE * 0.85 AS b, ({_TEMPLATE_SCORES[2]}) / 6.0::DOUBLE * 0.8 AS c FROM q),
        y AS (SELECT item_id, greatest(a, b, c) AS m, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS best FROM x)
        SELECT item_id, CASE {_TEMPLATES} END AS template, CASE WHEN best IS NOT NULL THEN round(m, 6) END AS template_score, round(0.5 + 0.3 * CASE WHEN best IS NULL THEN 0 ELSE m END + 0.05 + CASE WHEN best IS NULL THEN 0 ELSE 0.1 END, 6) AS confidence FROM y""",
    "strategy_selection": "SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 10 < 8 THEN 'graph,vector,database' ELSE 'graph' END WHEN toxic = 1 THEN 'graph,vector,database' WHEN doc_id % 10 < 8 THEN 'vector,graph,database' ELSE 'vector' END AS strategies FROM labels",
    "branch_query": "SELECT doc_id AS id FROM documents WHERE source = 'src4' AND lang = 'en'",
    "cross_branch_query": "SELECT doc_id AS id, source AS branch_name FROM documents WHERE source IN ('src1', 'src2')",
    "merge_conflicts": f"WITH {_VERSIONS}, l AS (SELECT branch_name, entity_name, max(id) AS id, arg_max(content_hash, id) AS h FROM v GROUP BY ALL) SELECT a.entity_name, a.id AS source_id, b.id AS target_id FROM l a JOIN l b USING (entity_name) WHERE a.branch_name = 'src1' AND b.branch_name = 'src11' AND a.h <> b.h",
    "changed_both_sides": f"WITH {_CHANGES} SELECT path FROM c WHERE branch_name = 'signup' INTERSECT SELECT path FROM c WHERE branch_name = 'error'",
    "conflict_summary": f"WITH {_CHANGES}, x AS (SELECT path FROM c WHERE branch_name = 'signup' INTERSECT SELECT path FROM c WHERE branch_name = 'error') SELECT count(*) AS conflicts, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS severity FROM x",
    "changed_paths": f"WITH {_CHANGES} SELECT path, CASE WHEN change_type = 'D' THEN 'delete' ELSE 'update' END AS action FROM c UNION SELECT old_path, 'delete' FROM c WHERE change_type = 'R'",
    "soft_delete": f"WITH {_CHANGES}, {_RECORDS} SELECT 'f' || file_version_id IN (SELECT path FROM c WHERE change_type = 'D') AS deleted, count(*) AS n FROM r GROUP BY 1",
    "cascade_delete": f"WITH {_RECORDS}, g AS (SELECT id, file_version_id FROM r WHERE file_version_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) SELECT 'entity' AS kind, id AS a, file_version_id AS b FROM g UNION ALL SELECT DISTINCT 'edge', l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM g) OR l_partkey IN (SELECT id FROM g)",
    "ttl_expired": f"WITH {_RECORDS} SELECT id, state FROM r WHERE updated_at + to_seconds(ttl) > TIMESTAMP '{AS_OF}'",
    "purge_branch": "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "upsert": f"WITH {_RECORDS} SELECT id, CASE WHEN id % 10 = 0 THEN 'deleted' ELSE state END AS state, CASE WHEN id % 10 = 0 THEN 86400 ELSE ttl END AS ttl, id % 10 = 0 AS new, FALSE AS created_now FROM r UNION ALL SELECT id + 10000000, 'deleted', 86400, TRUE, TRUE FROM r WHERE id % 100 = 0",
    "commit_latest": "SELECT event_type AS branch_name, arg_max(event_id, (ts, event_id)) AS sha FROM events GROUP BY event_type",
    "commits_since": "SELECT event_id FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_id = 500)",
    "language_detect": rf"""WITH {_PATHS}, n AS (SELECT page_id, regexp_extract(replace(path, '\', '/'), '[^/]*$') AS name FROM f), e AS (SELECT *, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS extension FROM n)
        SELECT page_id, CASE {" ".join(f"WHEN extension IN ({', '.join(repr(x) for x in known)}) THEN '{k}'" for k, known in t.EXTENSIONS.items())} END AS language, extension, name FROM e""",
    "file_roles": rf"""WITH {_PATHS}, n AS (SELECT page_id, lower(path) AS low, lower(regexp_extract(replace(path, '\', '/'), '[^/]*$')) AS name FROM f)
        SELECT page_id, contains(low, 'test') OR contains(name, 'spec') AS test, {_any("name", t.CONFIG_NAMES)} AS config, regexp_matches(name, '^.+\.(md|rst|txt|adoc)$') OR name IN ('readme', 'changelog', 'license', 'contributing', 'authors') OR contains(low, 'docs') AS documentation FROM n""",
    "backup_tags": rf"""WITH {_PATHS}, n AS (SELECT page_id, lower(path) AS low, lower(regexp_extract(replace(path, '\', '/'), '[^/]*$')) AS name FROM f), x AS (SELECT *, regexp_extract(name, '^.+\.([^.]+)$', 1) AS ext FROM n)
        SELECT page_id, array_to_string(list_concat(
            CASE ext WHEN 'py' THEN ['python'] WHEN 'js' THEN ['javascript'] WHEN 'jsx' THEN ['javascript'] WHEN 'ts' THEN ['typescript'] WHEN 'tsx' THEN ['typescript'] WHEN 'java' THEN ['java'] WHEN 'go' THEN ['go'] WHEN 'rs' THEN ['rust']
                WHEN 'c' THEN ['c'] WHEN 'h' THEN ['c'] WHEN 'cpp' THEN ['cpp'] WHEN 'hpp' THEN ['cpp'] WHEN 'cs' THEN ['csharp'] ELSE [] END,
            CASE WHEN contains(low, 'test') THEN ['test', 'testing'] ELSE [] END, CASE WHEN contains(low, 'config') OR name = 'settings.py' THEN ['config', 'configuration'] ELSE [] END, CASE WHEN ext IN ('md', 'rst', 'txt') THEN ['documentation', 'docs'] ELSE [] END,
            CASE WHEN contains(low, '.claude') THEN ['ai-tool', 'claude'] ELSE [] END, CASE WHEN contains(low, '.cursor') OR contains(low, '.vscode') THEN ['ide-config', 'development-tool'] ELSE [] END,
            CASE WHEN contains(name, 'dockerfile') OR contains(name, 'docker-compose') THEN ['docker', 'containerization'] ELSE [] END, CASE WHEN ext IN ('json', 'yaml', 'yml') THEN ['config', 'data'] ELSE [] END), ',') AS tags FROM x""",
    "entity_extraction": rf"""WITH {_QUESTIONS} SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(question, '"([^"]*)"', 1),
        list_filter(regexp_split_to_array(trim(question), '\s+'), lambda w: regexp_matches(w, '^[A-Z]') AND length(w) > 2 AND w NOT IN {t.QUESTION_WORDS}),
        regexp_extract_all(question, '\b([a-z_][a-z0-9_]*[a-z0-9]|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*)\b', 1)))), ',') AS names FROM q""",
    "fusion_balanced": _greedy(0.3),
    "fusion_diversity_first": _greedy(0.6),
    "fusion_near_dedup": """WITH RECURSIVE i AS (SELECT label::BIGINT AS query_id, vec_id AS position, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
        g AS (
            SELECT query_id, k, position, true AS kept, [v] AS vectors FROM i WHERE k = 1
            UNION ALL SELECT query_id, k, position, NOT hit, CASE WHEN hit THEN vectors ELSE list_append(vectors, v) END
            FROM (SELECT i.query_id, i.k, i.position, i.v, g.vectors, len(list_filter(g.vectors, lambda u: list_cosine_similarity(u, i.v) >= 0.25)) > 0 AS hit FROM g JOIN i ON i.query_id = g.query_id AND i.k = g.k + 1))
        SELECT query_id, position FROM g WHERE kept""",
    "line_counts": r"SELECT doc_id AS id, len(string_split(text, chr(10)))::INT AS lines, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '\s*')))::INT AS full_lines FROM documents",
    "term_overlap": f"SELECT doc_id AS id, round(len(list_intersect({_QUERY_WORDS}, {_TOKENS.format(c='text')})) / 5.0::DOUBLE, 6) AS share FROM documents",
    "jaccard": f"WITH x AS (SELECT doc_id AS id, {_TOKENS.format(c='text')} AS w FROM documents) SELECT id, round(len(list_intersect({_QUERY_WORDS}, w)) / len(list_distinct(list_concat({_QUERY_WORDS}, w)))::DOUBLE, 6) AS jaccard FROM x",
    "truncate_ellipsis": "SELECT doc_id AS id, CASE WHEN length(text) > 30 THEN left(text, 27) || '...' ELSE text END AS short, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS cut FROM documents",
    "sha_ids": "SELECT doc_id AS id, left(sha256(text), 16) AS sha, left(md5(text), 8) AS md5, md5(source || ':a/b' || doc_id) AS identity FROM documents",
    "partition_key": "SELECT doc_id AS id, source || '#' || lang AS key FROM documents",
    "uri_generation": rf"WITH {_PATHS} SELECT page_id, 'urn:x#class/' || replace(path, '\', '/') || '/My_Name%2F' || page_id AS iri FROM f",
    "call_parse": "SELECT page_id, 'run|a.b' || page_id || '.run' AS names FROM pages",
    "parse_analysis": "SELECT doc_id AS id, 'doc ' || doc_id AS summary, 'high' AS complexity, 'a|b' AS dependencies, 'x|y' AS tags FROM documents",
    "embedding_text": "SELECT p_partkey, 'function ' || p_name || ' | ' || p_brand || ' | Complexity: ' || CASE WHEN p_size % 12 >= 8 THEN 'high' WHEN p_size % 12 >= 4 THEN 'medium' ELSE 'low' END || ' | Dependencies: ' || p_type AS text FROM part",
    "page_links": "SELECT page_id AS source_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS links FROM pages WHERE links > 0",
    "regex_entities": "SELECT n_name AS path, 'function' AS type, 2 AS line, 'def f_' || n_nationkey || '(a):' AS content FROM nation UNION ALL SELECT n_name, 'class', 3, 'class A:' FROM nation",
    "python_entities": "SELECT n_name AS path, 'A' AS name, 'class' AS entity_type, NULL AS parent_entity FROM nation UNION ALL SELECT n_name, 'f', 'method', 'A' FROM nation",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "window_tumbling": "SELECT ts::DATE::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "window_session": "WITH g AS (SELECT user_id, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE)::INT AS same FROM events) SELECT user_id, count(*) FILTER (coalesce(same, 0) = 0) AS sessions, count(*) AS events FROM g GROUP BY user_id",
    "stream_sync_dedup": "SELECT DISTINCT 'http://x/c' || c_custkey % 1000 AS s, 'http://x/segment' AS p, c_mktsegment AS o, 'literal' AS o_kind FROM customer WHERE c_custkey % 9 <> 4 AND c_custkey % 11 <> 5",
    "stream_ttl": f"SELECT event_id FROM events WHERE floor(epoch(ts)) + 86400 * 3 > epoch(TIMESTAMP '{AS_OF}')",
}
