import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lorespark.sparql import Graph, SparqlError, parse

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SCHEMA = "s string, p string, o string, o_kind string, o_type string, o_lang string"
INT = "http://www.w3.org/2001/XMLSchema#integer"


def uri(s, p, o):
    return (s, p, o, "uri", None, None)


def lit(s, p, o, type_=None, lang=None):
    return (s, p, o, "literal", type_, lang)


@pytest.fixture(scope="module")
def people(spark):
    rows = [uri(f"urn:{n}", RDF + "type", "urn:Person") for n in ("john", "jane", "bob")]
    rows += [lit(f"urn:{n}", "urn:name", n.title()) for n in ("john", "jane", "bob")]
    rows += [lit(f"urn:{n}", "urn:age", str(a), INT) for n, a in (("john", 30), ("jane", 25), ("bob", 35))]
    rows += [uri("urn:john", "urn:knows", "urn:jane"), uri("urn:jane", "urn:knows", "urn:bob"), lit("urn:bob", "urn:motto", "hello, you", None, "en")]
    return Graph(spark.createDataFrame(rows, SCHEMA), {"": "urn:", "rdf": RDF})


def texts(graph, query, **bindings):
    return sorted(tuple(r) for r in graph.values(query, bindings or None).collect())


def test_names_and_typed_filter(people):
    assert len(texts(people, "SELECT ?n WHERE { ?p a :Person ; :name ?n }")) == 3
    assert texts(people, "SELECT ?n WHERE { ?p :age ?a ; :name ?n FILTER(?a > 26) }") == [("Bob",), ("John",)]


def test_join_order_does_not_matter(people):
    patterns = ["?a :knows ?b", "?a :name ?x", "?b :name ?y"]
    results = {str(texts(people, "SELECT ?x ?y WHERE { " + " . ".join(p) + " }")) for p in itertools.permutations(patterns)}
    assert results == {str([("Jane", "Bob"), ("John", "Jane")])}


def test_optional_keeps_unbound_and_joins_with_them(people):
    assert texts(people, "SELECT ?n ?k WHERE { ?p :name ?n OPTIONAL { ?p :knows ?k } FILTER(!bound(?k)) }") == [("Bob", None)]
    q = "SELECT ?n ?x WHERE { ?p :name ?n OPTIONAL { ?p :knows ?x } OPTIONAL { ?x :age ?a FILTER(?a < 30) } } "
    assert len(texts(people, q)) == 3
    q = "SELECT ?p ?x ?m WHERE { ?p a :Person OPTIONAL { ?p :knows ?x } { ?x :motto ?m } }"
    assert texts(people, q) == [("urn:bob", "urn:bob", "hello, you"), ("urn:jane", "urn:bob", "hello, you")]


def test_union_minus_exists(people):
    assert texts(people, "SELECT ?p WHERE { { ?p :age 30 } UNION { ?p :age 25 } }") == [("urn:jane",), ("urn:john",)]
    assert texts(people, "SELECT ?p WHERE { ?p a :Person MINUS { ?p :knows ?q } }") == [("urn:bob",)]
    assert texts(people, "SELECT ?p WHERE { ?p a :Person FILTER EXISTS { ?q :knows ?p FILTER(?q != :john) } }") == [("urn:bob",)]


def test_aggregates_and_order(people):
    q = "SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) (AVG(?a) AS ?m) (GROUP_CONCAT(?x; SEPARATOR=\"/\") AS ?g) WHERE { ?p :age ?a ; :name ?x }"
    assert texts(people, q) == [("3", "90", "30", "Bob/Jane/John")]
    assert [tuple(r) for r in people.values("SELECT ?n WHERE { ?p :name ?n ; :age ?a } ORDER BY DESC(?a) LIMIT 2").collect()] == [("Bob",), ("John",)]
    assert texts(people, "SELECT (COUNT(?x) AS ?n) WHERE { ?x :nothing ?y }") == [("0",)]


def test_bindings_values_bind_and_functions(people):
    assert texts(people, "SELECT ?n WHERE { ?p :name ?n }", p="urn:bob") == [("Bob",)] or texts(people, "SELECT ?n WHERE { ?p :name ?n }", p="urn:bob") == [("Bob",)]
    q = 'SELECT ?l (IF(?a >= 30, "old", "young") AS ?k) WHERE { ?p :age ?a ; :name ?n BIND(STRLEN(?n) + 1 AS ?l) FILTER(?n IN ("Bob", "Jane")) }'
    assert texts(people, q) == [("4", "old"), ("5", "young")]
    assert texts(people, 'SELECT ?m WHERE { ?p :motto ?m FILTER(lang(?m) = "en" && isLiteral(?m) && regex(?m, "HELLO", "i")) }') == [("hello, you",)]


def test_ask_construct_describe(people):
    assert people.query("ASK { :john :knows :jane }").first()[0] is True
    assert people.query("ASK { :john :knows :bob }").first()[0] is False
    assert people.query("CONSTRUCT { ?b :knownBy ?a } WHERE { ?a :knows ?b }").count() == 2
    assert people.query("DESCRIBE :bob").count() == 4


def test_paths(people):
    assert texts(people, "SELECT ?x WHERE { :john :knows+ ?x }") == [("urn:bob",), ("urn:jane",)]
    assert texts(people, "SELECT ?x WHERE { :john :knows* ?x }") == [("urn:bob",), ("urn:jane",), ("urn:john",)]
    assert texts(people, "SELECT ?x WHERE { ?x :knows/:knows :bob }") == [("urn:john",)]
    assert texts(people, "SELECT ?x WHERE { :bob ^:knows ?x }") == [("urn:jane",)]
    assert texts(people, "SELECT ?x WHERE { :john (:knows|:age)? ?x }") == [("30",), ("urn:jane",), ("urn:john",)]
    assert ("Bob",) in texts(people, "SELECT ?x WHERE { :bob !(:age|rdf:type) ?x }")


def test_query_type_follows_the_prologue_and_comments_stay_comments():
    q = parse("PREFIX a: <urn:a#> # SELECT ?x\nSELECT ?s WHERE { ?s a:b 'x#y' } # end")
    assert q.kind == "SELECT" and q.where[1][0][1][0][2] == ("lit", "x#y", None, None)


@pytest.mark.parametrize("bad", ["", "SELECT", "SELECT ?x { ?x ?y }", "INSERT { ?s ?p ?o }", "SELECT ?x WHERE { ?x nope:p ?y }", "SELECT ?x WHERE { ?x ?p ?y"])
def test_bad_queries_are_refused(bad):
    with pytest.raises(SparqlError):
        parse(bad)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_closure_equals_breadth_first_search(spark, edges):
    g = Graph(spark.createDataFrame([uri(f"n:{a}", "p:e", f"n:{b}") for a, b in edges], SCHEMA))
    expected = set()
    for start in {a for a, _ in edges}:
        todo, seen = [start], set()
        while todo:
            for b in {b for a, b in edges if a in todo} - seen:
                seen.add(b)
            todo = [b for b in {b for a, b in edges if a in todo} if (start, b) not in expected]
            expected |= {(start, b) for b in seen}
    assert {(r[0], r[1]) for r in g.query("SELECT ?a ?b WHERE { ?a <p:e>+ ?b }").collect()} == {(f"n:{a}", f"n:{b}") for a, b in expected}


def test_reach_by_joins_equals_reach_in_a_task(spark, monkeypatch):
    from lorespark.sparql import compiler

    steps = spark.createDataFrame([(f"n{i}", f"n{(i * 3 + 1) % 40}") for i in range(40)], "s string, o string")
    few = {tuple(r) for r in compiler.reach(steps, "n2").collect()}
    monkeypatch.setattr(compiler, "FEW_STEPS", 0)
    assert {tuple(r) for r in compiler.reach(steps, "n2").collect()} == few


def test_variables_left_unbound_on_either_side_join_by_cases(spark):
    rows = [uri(f"urn:p{i}", "urn:type", "urn:P") for i in range(4)] + [uri(f"urn:q{i}", "urn:kind", "urn:Q") for i in range(4)]
    rows += [lit("urn:p0", "urn:nick", "a"), lit("urn:p1", "urn:nick", "b"), lit("urn:p1", "urn:tag", "x"), lit("urn:p2", "urn:tag", "y")]
    rows += [lit("urn:q0", "urn:alias", "a"), lit("urn:q1", "urn:alias", "c"), lit("urn:q1", "urn:tag", "x"), lit("urn:q3", "urn:tag", "y")]
    g = Graph(spark.createDataFrame(rows, SCHEMA), {"": "urn:"})
    left = {"p0": ("a", None), "p1": ("b", "x"), "p2": (None, "y"), "p3": (None, None)}
    right = {"q0": ("a", None), "q1": ("c", "x"), "q2": (None, None), "q3": (None, "y")}
    for shared in (1, 2):
        more = lambda p, names: " ".join(f"OPTIONAL {{ ?{p} :{n} ?v{i} }}" for i, n in enumerate(names[:shared]))  # noqa: B023, E731
        query = f"SELECT ?p ?q WHERE {{ {{ ?p :type :P {more('p', ('nick', 'tag'))} }} {{ ?q :kind :Q {more('q', ('alias', 'tag'))} }} }}"
        agree = lambda a, b: all(x is None or y is None or x == y for x, y in list(zip(a, b, strict=True))[:shared])  # noqa: B023, E731
        assert texts(g, query) == sorted((f"urn:{p}", f"urn:{q}") for p, a in left.items() for q, b in right.items() if agree(a, b))


def test_named_graphs_and_marks(spark):
    rows = [("a", "p", "b"), ("b", "p", "c"), ("c", "q", "a"), ("d", "q", "d")]
    kind = "s string, p string, o string, o_kind string, o_type string, o_lang string"
    iri = lambda x: f"http://x/{x}"
    triples = spark.createDataFrame([(*map(iri, r), "uri", None, None) for r in rows], kind)
    quads = spark.createDataFrame([(*map(iri, r), "uri", None, None, iri(g)) for r, g in zip(rows, ("g1", "g2", "g1", "g2"), strict=True)], kind + ", g string")
    graph = Graph(triples, {"x": "http://x/"}, quads=quads)
    rows_of = lambda text: sorted(tuple((v or "-").removeprefix("http://x/") for v in r) for r in graph.query(text).collect())
    assert rows_of("SELECT ?g ?s WHERE { GRAPH ?g { ?s x:p ?o } }") == [("g1", "a"), ("g2", "b")]
    assert rows_of("SELECT ?g WHERE { GRAPH ?g { } }") == [("g1",), ("g2",)]
    assert rows_of("SELECT ?s WHERE { GRAPH ?g { ?s x:p ?m . ?m x:p ?o } }") == []  # both patterns must be in one graph
    assert rows_of("SELECT ?s ?o WHERE { GRAPH x:g1 { ?s x:p+ ?o } ?o x:p ?e }") == [("a", "b")]
    assert rows_of("SELECT ?g ?s ?t WHERE { GRAPH ?g { ?s x:q ?o OPTIONAL { ?t x:p ?u } } }") == [("g1", "c", "a"), ("g2", "d", "b")]
    for bad in ("SELECT ?s WHERE { GRAPH ?g { ?s x:p+ ?o } }", "SELECT ?s WHERE { ?s x:p ?o FILTER(NOW() = ?o) }"):
        with pytest.raises(SparqlError):
            graph.query(bad)
    with pytest.raises(SparqlError, match="no named graphs"):
        Graph(triples).query("SELECT ?s WHERE { GRAPH ?g { ?s ?p ?o } }")
    assert rows_of("SELECT ?s WHERE { ?s ?p ?o FILTER(?s = x:d || EXISTS { ?o x:p ?z }) }") == [("a",), ("c",), ("d",)]
    assert rows_of("SELECT ?s ?t WHERE { ?s x:p ?o OPTIONAL { ?t x:q ?s } FILTER(!EXISTS { ?t x:q ?z } || ?s = x:c) }") == []
    assert rows_of("SELECT ?s WHERE { ?s x:q ?o FILTER(EXISTS { ?a x:p ?b } && NOT EXISTS { ?s x:p ?e }) }") == [("c",), ("d",)]
    assert rows_of("SELECT ?s WHERE { ?s x:q ?o FILTER(EXISTS { ?o x:p ?b FILTER(?b != ?s) } || EXISTS { ?none x:none ?c }) }") == [("c",)]


def test_closure_deals_its_sets_by_their_rows_and_finds_a_way_by_one_split(spark, monkeypatch):
    import random

    from lorespark.sparql import compiler

    rng, sent = random.Random(4), []
    spread = compiler.spread
    monkeypatch.setattr(compiler, "spread", lambda df, rows, *keys, **kw: sent.append((df.count(), rows)) or spread(df, rows, *keys, **kw))
    for edges in ({(i, i + 1) for i in range(20)}, {(i, (i + 1) % 13) for i in range(13)}, {(rng.randrange(12), rng.randrange(12)) for _ in range(15)}):
        want = set(edges)
        while (more := want | {(a, d) for a, b in want for c, d in edges if b == c}) != want:
            want = more
        got = compiler.closure(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "s string, o string")).collect()
        assert sorted((r.s, r.o) for r in got) == sorted((f"n{a}", f"n{b}") for a, b in want)
        if len(edges) == 20:
            assert max(n for n, _ in sent) <= len(want)
