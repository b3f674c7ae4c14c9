"""Questions with the entities that they name: linking, ways through the schema, texts of queries, answers and errors."""

import os

import pytest
from pyspark.sql import functions as F

from lorespark.engine import Engine
from lorespark.operators.questions import Schema, SelectText, answered, label_index, linked, plan, query_text, suggestions, translated
from lorespark.plans.code_queries import ORACLE_SQL, QUERIES, SCHEMA
from lorespark.sources.catalog import Catalog
from lorespark.sparql.compiler import Graph
from lorespark.sparql.parser import parse
from tests.oracle import assert_same

EX = "http://example.org/"
TINY = Schema(EX, (("wrote", "Author", "Book"), ("edited", "Author", "Book"), ("about", "Book", "Topic"), ("bornIn", "Author", "City")), {"Author": ("author", "authors", "who"), "Book": ("book", "books"), "City": ("city", "cities")}, {"wrote": ("wrote", "written"), "edited": ("edited",)})


def triples(spark):
    things = [("a1", "Author", 'Ann "A." Lee'), ("a2", "Author", "Bob"), ("b1", "Book", "War and  Peace"), ("b2", "Book", "War"), ("b3", "Book", "Bob"), ("t1", "Topic", "peace"), ("c1", "City", "Oslo"), ("c2", "City", "New\\York")]
    rows = [(EX + i, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", EX + c, "uri", None, None) for i, c, _ in things] + [(EX + i, EX + "name", n, "literal", None, None) for i, _, n in things]
    links = [("a1", "wrote", "b1"), ("a2", "wrote", "b2"), ("a2", "edited", "b1"), ("a1", "edited", "b2"), ("b1", "about", "t1"), ("a1", "bornIn", "c1"), ("a2", "bornIn", "c2"), ("a2", "wrote", "b3")]
    rows += [(EX + s, EX + p, EX + o, "uri", None, None) for s, p, o in links]
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_type string, o_lang string")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, {"triples": triples(spark)}, {"ex": EX})


#: Where several predicates would do and none is mentioned, the first of the schema counts.
ASKED = {
    "Who wrote War and Peace?": ["a1"],
    "who edited WAR AND   PEACE": ["a2"],
    "who wrote War": ["a2"],
    "Which books are written by Ann \"A.\" Lee?": ["b1"],
    "books edited by bob": ["b1"],
    "authors about peace, please": ["a1"],
    "who was born in New\\York": ["a2"],
    "How many books are by Bob?": "2",
    "number of authors of Oslo": "1",
    "how many cities are about Peace": "1",
    "Who wrote War and lives in Oslo": [],
    "Who wrote Nothing": "it names nothing that the graph has",
    "why Oslo": "it asks for no kind of thing that the graph has",
    "": "it asks for no kind of thing that the graph has",
    None: "it asks for no kind of thing that the graph has",
}


def test_answers_and_errors_as_rows(spark, engine):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "id int, question string")
    got = {}
    for r in engine.answer_batch(asked, TINY).collect():
        got.setdefault(r.id, []).append(r.error or r.answer.removeprefix(EX))
    for i, (q, want) in enumerate(ASKED.items()):
        assert sorted(got.get(i, [])) == ([want] if isinstance(want, str) else want), q


def test_each_translation_is_sparql_with_the_same_answer(spark, engine):
    asked = spark.createDataFrame([(i, q) for i, (q, want) in enumerate(ASKED.items()) if q and not (isinstance(want, str) and " " in want)], "id int, question string")
    rows = engine.translate_batch(asked, TINY).collect()
    assert all(r.error is None and 0.7 <= r.confidence <= 1 for r in rows) and len(rows) == asked.count()
    for r in rows:
        want = ASKED[r.question]
        found = [x[0].removeprefix(EX) for x in engine.graph.values(r.sparql).collect()]
        assert sorted(found) == ([want] if isinstance(want, str) else want), r.sparql


def test_the_longest_names_stay(spark):
    index = label_index(triples(spark), TINY)
    r = linked(spark.createDataFrame([(1, "Does 'War and Peace' speak of war, and Bob of peace?")], "id int, question string"), index).first()
    assert [(e.label, e.at, [k["class"] for k in e.kinds]) for e in r.entities] == [("war and peace", 1, ["Book"]), ("war", 6, ["Book"]), ("bob", 8, ["Author", "Book"]), ("peace", 10, ["Topic"])]
    assert [(r.label, r["class"]) for r in suggestions(index, "War", 5).collect()] == [("war", "Book"), ("war and peace", "Book")]


def test_ways_and_plans():
    assert TINY.way("Author", "Book", "the author who edited it") == [("edited", True)]
    assert TINY.way("City", "Topic", "written") == [("bornIn", False), ("wrote", True), ("about", True)]
    assert TINY.way("Author", "Author") == [] and TINY.way("Author", "Nowhere") is None
    lonely = Schema(EX, (), {"Author": ("who",)})
    entity = {"at": 1, "n": 1, "label": "x", "kinds": [{"class": "Book", "texts": ["X"]}]}
    assert plan(["who", "x"], [entity], lonely) == {"error": "nothing links Author with x"}
    text = query_text(plan(["who", "x"], [entity], TINY), TINY, limit=3)
    assert text.endswith("LIMIT 3") and parse(text, {}).limit == 3


def test_texts_are_escaped():
    nasty = 'a"b\\c\nd\te'
    q = parse(SelectText().triple("?s", "?p", "?o").values("?o", [SelectText.literal(nasty)]).filter("?s != ?p").text("?s", distinct=True), {})
    assert [p for p in q.where[1] if p[0] == "values"][0][2][0][0][1] == nasty and q.distinct
    with pytest.raises(ValueError, match="IRI"):
        SelectText.iri("x> . ?a ?b ?c . <y")


def test_the_schema_of_the_tables_is_what_their_triples_have(spark, sf_dir):
    found = Schema.discovered(Catalog(spark, sf_dir).triples, EX)
    assert found == set(SCHEMA.edges)
    assert Catalog(spark, sf_dir).triples.filter(F.col("p") == EX + "inNation").count() > 0


def test_suppliers_that_share_a_name_are_asked_for_once(spark, sf_dir, tmp_path):
    for f in os.listdir(sf_dir):
        if f != "supplier.parquet":
            os.symlink(f"{sf_dir}/{f}", tmp_path / f)
    shared = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("s_name", F.concat(F.lit("Supplier#"), (F.col("s_suppkey") % 3).cast("string")))
    shared.toPandas().to_parquet(tmp_path / "supplier.parquet")
    assert_same(QUERIES["question_answers"](spark, str(tmp_path)), str(tmp_path), ORACLE_SQL["question_answers"])


def test_questions_are_translated_by_several_tasks(spark):
    index = label_index(triples(spark), TINY)
    asked = spark.range(3000).select("id", F.concat(F.lit("who wrote War "), F.col("id").cast("string")).alias("question")).coalesce(1)
    got = translated(asked, index, TINY).select("id", "target", F.spark_partition_id().alias("task")).collect()
    assert len({r.id for r in got}) == len(got) == 3000 and {r.target for r in got} == {"Author"}
    assert len({r.task for r in got}) >= 3


def test_answers_stay_where_triples_repeat_and_joins_are_dealt(spark):
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "id int, question string")
    many = 9 << 19  # more than the session's partitions are meant for
    graph = Graph(triples(spark).union(triples(spark)), {"ex": EX}, rows={EX + "wrote": many, EX + "edited": many})
    got = {}
    for r in answered(graph, asked, TINY).collect():
        got.setdefault(r.question, []).append(r.error or r.answer.removeprefix(EX))
    for q, want in ASKED.items():
        assert sorted(got.get(q, [])) == ([want] if isinstance(want, str) else want), q
    joined = graph.query("SELECT ?a ?n WHERE { ?b ex:name ?n . ?a ex:wrote ?b }")
    assert "hashpartitioning(b" in (plan_ := joined._jdf.queryExecution().toString()) and ", 9)" in plan_ and "BroadcastHashJoin" not in plan_
