import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import scoring, text
from lorespark.operators import documents, extraction, fusion, graph, memory, retrieval, routing, versioning
from lorespark.operators.online import OnlineModel
from lorespark.plans.registry import QUERIES
from lorespark.sources import formats


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_hybrid_merge_keeps_the_vector_copy(spark):
    vector = spark.createDataFrame([("doc1", "a", 0.95), ("doc2", "b", 0.88)], "id string, content string, score double")
    keyword = spark.createDataFrame([("doc1", "a", 0.92), ("doc3", "c", 0.85)], "id string, content string, score double")
    assert [(r.id, r.score) for r in retrieval.merged(vector, keyword).collect()] == [("doc1", 0.95), ("doc2", 0.88), ("doc3", 0.85)]


def test_scores(spark):
    ratings = [("positive", None, 1.0), ("negative", None, 0.0), ("neutral", None, 0.5), ("explicit_rating", 5.0, 1.0), ("explicit_rating", 1.0, 0.0), ("explicit_rating", 3.0, 0.5)]
    df = spark.createDataFrame(ratings, "k string, v double, want double").select(scoring.feedback_score(F.col("k"), F.col("v")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    assert one(spark, scoring.importance(F.col("c"), F.col("k")), c="Hello there", k="episodic") == pytest.approx(0.611)


def test_feedback_ratio_and_adaptation(spark):
    rows = [("a", "positive"), ("a", "negative")] + [("b", "negative")] * 6
    out = {r.session_id: r for r in memory.feedback_ratios(spark.createDataFrame(rows, "session_id string, feedback_type string")).collect()}
    assert out["a"].ratio == 0.5 and not out["a"].should_adapt
    assert out["b"].should_adapt and out["b"].strategy == "pattern_based"


def test_file_identity_and_keywords(spark):
    ids = {one(spark, text.file_identity(F.lit("r"), F.col("p")), p=p) for p in ("src/models/base.py", "src\\models\\base.py", "/src/models/base.py")}
    assert len(ids) == 1 and len(ids.pop()) == 32
    assert one(spark, text.keywords(F.col("q")), q="show me the Flask application components") == ["flask", "application", "components"]
    assert one(spark, text.keywords(F.col("q")), q="") == []
    assert {"Flask", "Django"} <= set(one(spark, text.entity_names(F.col("q")), q="Find dependencies of Flask and Django classes"))


def _mmr(scores, vectors, weight, n):
    unit = [v / np.linalg.norm(v) for v in vectors]
    chosen = [int(np.argmax(scores))]
    final = [scores[chosen[0]]]
    while len(chosen) < n:
        best, value = None, -1.0
        for i in range(len(scores)):
            if i not in chosen:
                v = scores[i] - weight * max(0.0, *(float(unit[i] @ unit[j]) for j in chosen)) if len(chosen) > 1 else scores[i] - weight * max(0.0, float(unit[i] @ unit[chosen[0]]))
                if v > value + 1e-12:
                    best, value = i, v
        if best is None:
            break
        chosen.append(best)
        final.append(value)
    return chosen, final


def test_diversity_equals_a_plain_greedy_loop(spark):
    rng = np.random.default_rng(3)
    scores, vectors = rng.random(12), rng.normal(size=(12, 5))
    rows = [("q", i, float(scores[i]), vectors[i].tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id string, position int, relevance_score double, embedding array<double>")
    out = sorted(fusion.diversified(df, "relevance_score", 0.4, 6).collect(), key=lambda r: r["rank"])
    chosen, final = _mmr(scores, vectors, 0.4, 6)
    assert [r.position for r in out] == chosen
    assert [r.final_score for r in out] == pytest.approx(final)


def test_near_copies_go_greedily(spark):
    rows = [("q", 0, [1.0, 0.0]), ("q", 1, [0.99, 0.05]), ("q", 2, [0.0, 1.0]), ("q", 3, None)]
    df = spark.createDataFrame(rows, "query_id string, position int, embedding array<double>")
    once = fusion.without_near_copies(df, 0.9)
    assert sorted(r.position for r in once.collect()) == [0, 2, 3]
    assert fusion.without_near_copies(once, 0.9).count() == 3


def test_vector_search_without_a_limit_returns_every_row_over_the_threshold(spark):
    df = spark.range(1500).select("id", F.array(F.lit(1.0), F.when(F.col("id") % 3 == 0, 50.0).otherwise(0.1)).alias("embedding"))
    assert retrieval.vector_search(df, [1.0, 0.0], None, 0.5).count() == 1000
    assert retrieval.vector_search(df, [1.0, 0.0], None, 0.01).count() == 1500
    from lorespark.plans.document_queries import QUERIES

    assert "Limit" not in QUERIES["vector_threshold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_join_is_exact_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {(r.a, r.b) for r in retrieval.similarity_join(df, 0.5, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.5}


def test_similarity_join_sends_a_row_to_a_bounded_number_of_strips(spark):
    df = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id")).alias("embedding"), (F.col("id") % 2).alias("kind"))
    for by, groups in ((None, 1), ("kind", 2)):
        joined = retrieval.similarity_join(df, -1.0, block=2, by=by)
        assert joined.select("a", "b").distinct().count() == joined.count() == groups * (300 // groups) * (300 // groups - 1) // 2
        assert retrieval._strips(df, 2, by).count() == 300 * retrieval.STRIPS


def test_similarity_join_deals_the_pairs_of_a_kind_to_all_tasks(spark):
    df = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.lit(1).alias("kind"))
    joined = retrieval.similarity_join(df, -1.0, block=2, by="kind")
    assert joined.count() == 300 * 299 // 2 and joined.select(F.spark_partition_id()).distinct().count() == 4


def test_triples_of_entities_are_dealt_by_their_number(spark):
    none = F.array().cast("array<string>")
    name = F.concat(F.lit("f"), "id")
    e = spark.range(1 << 18).select(name.alias("name"), F.lit("function").alias("entity_type"), F.lit("python").alias("language"), F.lit("a.py").alias("file_path"), F.lit(None).cast("string").alias("parent_entity"), F.lit(None).cast("string").alias("signature"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), none.alias("calls"), none.alias("imports"))
    out = graph.entity_triples(e, "urn:b#", "urn:c#", "urn:p#")
    assert out.count() == 5 * (1 << 18) and out.select(F.spark_partition_id()).distinct().count() == 8


def test_triple_documents_are_parsed(spark):
    rows = [("rdf_triple", "http://a", "http://p", "http://b"), ("rdf_triple", "http://a", "http://p", '"main"'), ("rdf_triple", "http://a", "http://p", '"3"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("other", "http://a", "http://p", "x"), ("rdf_triple", None, "http://p", "x")]
    out = [(r.o, r.o_kind, r.o_type) for r in formats.from_documents(spark.createDataFrame(rows, "type string, subject string, predicate string, object string")).collect()]
    assert out == [("http://b", "uri", None), ("main", "literal", None), ("3", "literal", "http://www.w3.org/2001/XMLSchema#integer")]


def test_hierarchy_skips_cycles(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, parent_id long")
    out = {r.id: (r.hierarchy_level, r.hierarchy_path) for r in graph.build_hierarchy(links).collect()}
    assert out == {1: (0, []), 2: (1, [1]), 3: (2, [1, 2])}


def test_python_entities(spark):
    code = "import os\nfrom a.b import c\n\nclass A(Base):\n    'doc'\n    async def f(self):\n        return g(os.path)\n\ndef h(x):\n    A()\n"
    out = {r.name: r for r in extraction.python_entities(spark.createDataFrame([("m.py", code), ("bad.py", "def (")], "path string, content string")).collect()}
    assert set(out) == {"A", "f", "h"} and out["f"].is_async and out["f"].parent_entity == "A" and out["A"].has_docstring
    assert out["h"].calls == ["A"] and out["f"].imports == ["a.b", "os"]


def test_source_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.py").write_bytes(b"\x00\x01\x02")
    (tmp_path / "c.unknown").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.js").write_text("x")
    (tmp_path / "e.py").write_bytes("é = 'ü'".encode("latin-1") + b" " * 40)
    out = {r.path.rsplit("/", 1)[1]: r.content for r in formats.source_files(spark, str(tmp_path)).collect()}
    assert set(out) == {"a.py", "e.py"} and out["e.py"].startswith("é")


def test_serialisations_escape(spark):
    t = spark.createDataFrame([("http://a", "http://p#q", 'x "y"\n', "literal", None, "en")], "s string, p string, o string, o_kind string, o_type string, o_lang string")
    assert formats.n_triples(t).first()[0] == '<http://a> <http://p#q> "x \\"y\\"\\n"@en .'
    assert formats.turtle(t).first()[0] == '<http://a> <http://p#q> "x \\"y\\"\\n"@en .'
    assert '"@language":"en"' in formats.json_ld(t).first()[0]
    assert "&quot;" in formats.rdf_xml(t).first()[0]


def test_graph_stats_are_counted_in_partitions_by_the_number_of_triples(spark, monkeypatch):
    rows = [(f"s{i % 40}", f"p{i % 3}", str(i % 25), "literal" if i % 2 else "uri", None, "en" if i % 4 == 1 else None) for i in range(300)] + [(None, "p", None, "uri", None, None)]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_type string, o_lang string")
    dealt = []
    monkeypatch.setattr(graph, "spread", lambda df, n, *keys: dealt.append((n, keys)) or df.repartition(7, *keys))
    want = (len(rows), 40, 4, len({(o, kind, lang) for _, _, o, kind, _, lang in rows[:-1]}))
    assert tuple(graph.graph_stats(t).first()) == want
    assert dealt == [(len(rows), ("term",))] * 2
    assert tuple(graph.graph_stats(t.limit(0)).first()) == (0, 0, 0, 0)


def test_turtle_blocks_over_many_batches(spark, sf_dir):
    rows = [("http://a", "http://p", f"http://o{i % 70}") for i in range(200)] + [(f"http://b{i % 9}", "http://p", f"http://o{i}") for i in range(90)] + [(None, "http://p", "http://o")]
    want = {}
    for s, p, o in rows:
        want.setdefault(s, set()).add(f"<{p}> <{o}>")
    want = {s and f"<{s}> " + " ;\n    ".join(sorted(x)) + " ." for s, x in want.items()}
    t = spark.createDataFrame([(*r, "uri", None, None) for r in rows], "s string, p string, o string, o_kind string, o_type string, o_lang string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [r[0] for r in formats.turtle(t.repartition(3)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and set(got) == want
    plan = QUERIES["serialize_turtle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan


def test_conflicts_and_commits(spark):
    c = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", "c")], "branch_name string, path string")
    assert [r.path for r in versioning.merge_conflicts(c, "x", "y").collect()] == ["b"]
    log = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "sha string, sequence int")
    assert [r.sha for r in versioning.commits_since(log, "s2").collect()] == ["s3"]
    assert versioning.commits_since(log, "gone").count() == 3


def test_routing_and_translation(spark):
    assert routing.strategies("VECTOR_RAG", 0.9) == ["vector"]
    assert routing.strategies("GRAPH_RAG", 0.5) == ["graph", "vector", "database"]
    t = routing.Translator({"ex": "http://example.org/"})
    found = t.translate("which function calls the method")
    assert found.template == "function_calls" and found.executable
    assert not t.translate("hello").executable
    assert t.batch(["function calls", "hello"])[1] == 0.5


def test_training_set_is_balanced(spark):
    counts = {r.intent: r["count"] for r in routing.training_set(spark, 50).groupBy("intent").count().collect()}
    assert set(counts.values()) == {50} and len(counts) == 4


def test_online_model_learns(spark):
    rows = [("good great fine", "pos"), ("bad awful poor", "neg"), ("great good", "pos"), ("awful bad", "neg")]
    df = spark.createDataFrame(rows, "text string, label string")
    model = OnlineModel(features=500)
    for _ in range(3):
        model.partial_fit(df)
    assert model.predict("great fine") == "pos" and model.predict("poor awful") == "neg"


def test_floor_percentiles_follow_the_index(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 11)], "k string, v double")
    r = documents.floor_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (r.p50, r.p99, r.n) == (6.0, 10.0, 10)


def test_engine(spark):
    from lorespark.engine import Engine

    triples = spark.createDataFrame([("http://example.org/a", "http://example.org/contains", "http://example.org/b", "uri", None, None)], "s string, p string, o string, o_kind string, o_type string, o_lang string")
    docs = spark.createDataFrame([("1", "the function calls"), ("2", "nothing")], "id string, content string").withColumn("embedding", retrieval.hashed_embeddings()(F.col("content")))
    e = Engine(spark, {"triples": triples, "documents": docs}, {"ex": "http://example.org/"})
    q = "SELECT ?x WHERE { ?x ex:contains ?y }"
    assert e.sparql(q).count() == 1 and e.sparql(q).count() == 1 and e.stats.hits == 1
    assert e.sparql(q, form="csv").first()[0] == "http://example.org/a"
    assert e.validate("SELECT") and not e.validate(q)
    assert {r.strategy for r in e.process_query("which function calls what").collect()} == {"graph", "vector", "database"}
    assert e.hybrid_search("function").first().id == "1"
    assert e.clear_cache() >= 2


def test_strategies_stop_early_time_out_and_report_errors(spark, monkeypatch):
    import time

    from lorespark.engine import Engine

    rows = [(str(i), f"Flask function {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "id string, content string").withColumn("embedding", retrieval.hashed_embeddings()(F.col("content")))
    e = Engine(spark, {"documents": docs})
    out = e.process_query("where is Flask used", "DATABASE_RAG", 0.5, enough=5, parallel=False).collect()
    assert {r.strategy for r in out} == {"database"} and len(out) == 5 and [r.strategy for r in e.outcomes().collect()] == ["database"]
    e.process_query("where is Flask used", "HYBRID")
    state = {r.strategy: (r.success, r.n, r.confidence) for r in e.outcomes().collect()}
    assert state == {"graph": (False, 0, 0.0), "vector": (True, 10, 0.9), "database": (True, 10, 0.85)}
    one = e._run
    monkeypatch.setattr(e, "_run", lambda name, text, n: time.sleep(5) if name == "vector" else one(name, text, n))
    began = time.time()
    out = e.process_query("where is Flask used", "HYBRID", timeout=3).collect()
    errors = {r.strategy: r.error for r in e.outcomes().collect()}
    assert time.time() - began < 5 and errors["vector"] == "not done in 3 s" and {r.strategy for r in out} == {"database"}
