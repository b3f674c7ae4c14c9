"""Registered SPARQL and graph queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import graph as g
from lorespark.sources import formats
from lorespark.sources.catalog import EX, GROUP, Catalog, imported
from lorespark.sparql.parser import RDF_TYPE, XSD

P = f"PREFIX ex: <{EX}> "

#: name: (query, {column: SQL type of its texts}, SQL)
_IMPORTED = f"p_partkey - p_partkey % {GROUP} + (p_partkey % {GROUP} * 6 + 1) % {GROUP}"

SPARQL: dict[str, tuple[str, dict[str, str], str]] = {
    "sparql_fanout": (
        "SELECT ?order (COUNT(?part) AS ?n) WHERE { ?order ex:contains ?part } GROUP BY ?order ORDER BY DESC(?n) ?order", {"n": "bigint"},
        f"SELECT '{EX}order/' || l_orderkey AS \"order\", count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey",
    ),
    "sparql_functions_in_module": (
        "SELECT ?c ?name WHERE { ?c a ex:Customer ; ex:name ?name ; ex:inNation ?n . ?n ex:name ?nation . FILTER(regex(?nation, \"nation_1$\", \"i\")) }", {},
        f"SELECT '{EX}customer/' || c_custkey AS c, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%nation_1'",
    ),
    "sparql_calls": (
        "SELECT ?order ?part ?name WHERE { ?order ex:contains ?part . ?part ex:name ?name ; ex:size ?s . FILTER(?s = 1) }", {},
        f"SELECT DISTINCT '{EX}order/' || l_orderkey AS \"order\", '{EX}part/' || l_partkey AS part, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1",
    ),
    "sparql_inheritance": (
        "SELECT ?s ?name ?region WHERE { ?s a ex:Supplier ; ex:name ?name ; ex:inNation ?n . ?n ex:inRegion ?r . ?r ex:name ?region }", {},
        f"SELECT '{EX}supplier/' || s_suppkey AS s, s_name AS name, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "sparql_unused": (
        "SELECT ?part WHERE { ?part a ex:Part . FILTER NOT EXISTS { ?s ex:imports ?part } }", {},
        f"SELECT '{EX}part/' || p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT {_IMPORTED} FROM part)",
    ),
    "sparql_transitive": (
        "SELECT ?a ?b WHERE { ?a ex:imports+ ?b }", {},
        f"WITH RECURSIVE e AS (SELECT p_partkey AS a, {_IMPORTED} AS b FROM part), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT '{EX}part/' || a AS a, '{EX}part/' || b AS b FROM r",
    ),
    "sparql_transitive_from": (
        "SELECT ?b WHERE { ex:part%2F1 ex:imports+ ?b }".replace("ex:part%2F1", f"<{EX}part/1>"), {},
        f"WITH RECURSIVE e AS (SELECT p_partkey AS a, {_IMPORTED} AS b FROM part), r AS (SELECT b FROM e WHERE a = 1 UNION SELECT e.b FROM r JOIN e ON r.b = e.a) SELECT '{EX}part/' || b AS b FROM r",
    ),
    "sparql_optional": (
        "SELECT ?n ?name ?c WHERE { ?n a ex:Nation ; ex:name ?name . OPTIONAL { ?s ex:inNation ?n ; a ex:Supplier ; ex:name ?c } }", {},
        f"SELECT '{EX}nation/' || n_nationkey AS n, n_name AS name, s_name AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "sparql_union": (
        "SELECT ?x ?name WHERE { { ?x a ex:Nation } UNION { ?x a ex:Region } ?x ex:name ?name }", {},
        f"SELECT '{EX}nation/' || n_nationkey AS x, n_name AS name FROM nation UNION ALL SELECT '{EX}region/' || r_regionkey, r_name FROM region",
    ),
    "sparql_minus": (
        "SELECT ?n WHERE { ?n a ex:Nation MINUS { ?n ex:inRegion " + f"<{EX}region/1>" + " } }", {},
        f"SELECT '{EX}nation/' || n_nationkey AS n FROM nation WHERE n_regionkey <> 1",
    ),
    "sparql_graph_variable": (
        "SELECT ?g ?s ?name WHERE { GRAPH ?g { ?s ex:inNation ?n ; ex:name ?name } }", {},
        f"""SELECT '{EX}graph/' || n_regionkey AS g, '{EX}supplier/' || s_suppkey AS s, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT '{EX}graph/' || n_regionkey, '{EX}customer/' || c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "sparql_graph_iri": (
        f"SELECT ?s ?region WHERE {{ GRAPH <{EX}graph/1> {{ ?s ex:inNation ?n OPTIONAL {{ ?s ex:name ?name FILTER(STRSTARTS(?name, \"Sup\")) }} FILTER(BOUND(?name)) }} ?n ex:inRegion ?r . GRAPH <{EX}graph/regions> {{ ?r ex:name ?region }} }}", {},
        f"SELECT '{EX}supplier/' || s_suppkey AS s, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1",
    ),
    "sparql_exists_or": (
        "SELECT ?p WHERE { ?p a ex:Part ; ex:size ?z . FILTER(?z < 5 || EXISTS { ?q ex:imports ?p . ?q ex:size ?y FILTER(?y > 25) }) }", {},
        f"SELECT '{EX}part/' || p_partkey AS p FROM part WHERE p_size < 5 OR p_partkey IN (SELECT {_IMPORTED} FROM part WHERE p_size > 25)",
    ),
    "sparql_exists_correlated": (
        "SELECT ?p ?q WHERE { ?p ex:imports ?q . ?p ex:size ?z OPTIONAL { ?q ex:brand ?b FILTER(?b = \"Brand#3\") } FILTER(BOUND(?b) || !EXISTS { ?q ex:size ?y FILTER(?y < ?z) }) }", {},
        f"""WITH e AS (SELECT p_partkey AS a, p_size AS z, {_IMPORTED} AS b FROM part)
        SELECT '{EX}part/' || a AS p, '{EX}part/' || b AS q FROM e JOIN part q ON q.p_partkey = e.b WHERE q.p_brand = 'Brand#3' OR q.p_size >= z""",
    ),
    "sparql_exists_bind": (
        "SELECT ?p ?used WHERE { ?p a ex:Part BIND(EXISTS { ?q ex:imports ?p } AS ?used) }", {},
        f"SELECT '{EX}part/' || p_partkey AS p, (p_partkey IN (SELECT {_IMPORTED} FROM part))::VARCHAR AS used FROM part",
    ),
    "sparql_hashes_and_times": (
        "SELECT ?c (MD5(?name) AS ?m) (SHA256(?name) AS ?h) (YEAR(NOW()) AS ?y) (MINUTES(\"2024-05-06T07:08:09.5Z\") AS ?i) (SECONDS(\"2024-05-06T07:08:09.5Z\") AS ?s) WHERE { ?c a ex:Customer ; ex:name ?name }", {"y": "bigint", "i": "bigint", "s": "double"},
        f"SELECT '{EX}customer/' || c_custkey AS c, md5(c_name) AS m, sha256(c_name) AS h, 2024 AS y, 8 AS i, 9.5::DOUBLE AS s FROM customer",
    ),
    "sparql_filter_numeric": (
        "SELECT ?o ?t WHERE { ?o ex:totalPrice ?t . FILTER(?t > 300000) }", {"t": "double"},
        f"SELECT '{EX}order/' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 300000",
    ),
    "sparql_filter_not_equal": (
        "SELECT ?o ?st WHERE { ?o ex:status ?st ; ex:totalPrice ?t . FILTER(?st != \"F\" && ?t * 2 >= 700000) }", {},
        f"SELECT '{EX}order/' || o_orderkey AS o, o_orderstatus AS st FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice * 2 >= 700000",
    ),
    "sparql_regex": (
        "SELECT ?p ?name WHERE { ?p a ex:Part ; ex:name ?name . FILTER(regex(str(?name), \"^blue\", \"i\") && strlen(?name) > 8) }", {},
        f"SELECT '{EX}part/' || p_partkey AS p, p_name AS name FROM part WHERE p_name ILIKE 'blue%' AND length(p_name) > 8",
    ),
    "sparql_string_functions": (
        "SELECT ?p (UCASE(?name) AS ?up) (STRLEN(?name) AS ?n) (CONCAT(STR(?b), \"/\", ?name) AS ?both) WHERE { ?p ex:name ?name ; ex:brand ?b . FILTER(CONTAINS(?name, \"ring\") || STRSTARTS(?name, \"red\")) }", {"n": "bigint"},
        f"SELECT '{EX}part/' || p_partkey AS p, upper(p_name) AS up, length(p_name) AS n, p_brand || '/' || p_name AS both FROM part WHERE contains(p_name, 'ring') OR starts_with(p_name, 'red')",
    ),
    "sparql_distinct_predicates": (
        "SELECT DISTINCT ?p WHERE { ?s ?p ?o }", {},
        "SELECT * FROM (VALUES " + ", ".join(f"('{EX}{p}')" for p in ("placedBy", "status", "totalPrice", "contains", "suppliedBy", "name", "brand", "size", "imports", "inNation", "inRegion")) + f", ('{RDF_TYPE}')) AS t(p)",
    ),
    "sparql_having": (
        "SELECT ?c (COUNT(?o) AS ?n) (SUM(?t) AS ?total) WHERE { ?o ex:placedBy ?c ; ex:totalPrice ?t } GROUP BY ?c HAVING (COUNT(?o) > 12)", {"n": "bigint", "total": "rounded"},
        f"SELECT '{EX}customer/' || o_custkey AS c, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    ),
    "sparql_aggregates": (
        "SELECT ?st (MIN(?t) AS ?low) (MAX(?t) AS ?high) (AVG(?t) AS ?mean) (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o ex:status ?st ; ex:totalPrice ?t ; ex:placedBy ?c } GROUP BY ?st", {"low": "double", "high": "double", "mean": "rounded", "n": "bigint"},
        "SELECT o_orderstatus AS st, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 2) AS mean, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    ),
    "sparql_order_limit": (
        "SELECT ?o ?t WHERE { ?o ex:totalPrice ?t } ORDER BY DESC(?t) ?o LIMIT 25 OFFSET 5", {"t": "double"},
        f"SELECT '{EX}order/' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o LIMIT 25 OFFSET 5",
    ),
    "sparql_path_star": (
        "SELECT ?x WHERE { " + f"<{EX}part/7>" + " ex:imports* ?x }", {},
        f"WITH RECURSIVE e AS (SELECT p_partkey AS a, {_IMPORTED} AS b FROM part), r AS (SELECT 7::BIGINT AS b UNION SELECT e.b FROM r JOIN e ON r.b = e.a) SELECT '{EX}part/' || b AS x FROM r",
    ),
    "sparql_path_inverse_seq": (
        "SELECT ?s ?name WHERE { ?s ^ex:suppliedBy/ex:name ?name . ?s ex:name \"Supplier#000000001\" }", {},
        f"SELECT '{EX}supplier/' || s_suppkey AS s, p_name AS name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_name = 'Supplier#000000001'",
    ),
    "sparql_path_alternative": (
        "SELECT ?x ?y WHERE { ?x ex:inNation/ex:inRegion|ex:inRegion ?y . ?x a ex:Supplier }", {},
        f"SELECT '{EX}supplier/' || s_suppkey AS x, '{EX}region/' || n_regionkey AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "sparql_count_all": (
        "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", {"n": "bigint"},
        """SELECT 4 * (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
            + 4 * (SELECT count(*) FROM part) + (SELECT count(*) FROM part) + 3 * (SELECT count(*) FROM customer) + 3 * (SELECT count(*) FROM supplier) + 3 * (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) AS n""",
    ),
    "sparql_inequality_join": (
        "SELECT ?a ?b WHERE { ?a a ex:Nation ; ex:inRegion ?r . ?b a ex:Nation ; ex:inRegion ?r . FILTER(?a != ?b) }", {},
        f"SELECT '{EX}nation/' || a.n_nationkey AS a, '{EX}nation/' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "sparql_bind_values": (
        "SELECT ?n ?twice WHERE { VALUES ?size { 1 2 3 } ?p ex:size ?size ; ex:name ?n . BIND(?size * 2 AS ?twice) }", {"twice": "bigint"},
        "SELECT p_name AS n, p_size * 2 AS twice FROM part WHERE p_size IN (1, 2, 3)",
    ),
}


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cast = lambda c: F.round(F.col(f"`{c}`").try_cast("double"), 2) if types[c] == "rounded" else F.col(f"`{c}`").try_cast(types[c])
    return df.select(*(cast(c).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))


def _sparql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, types, _ = SPARQL[name]
    return lambda spark, sf: _typed(Catalog(spark, sf).graph.values(P + text), types)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return Catalog(spark, sf).golden_nodes.drop("embedding").withColumn("hierarchy_path", F.col("hierarchy_path"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return Catalog(spark, sf).table("part").select(F.col("p_partkey").alias("source_id"), imported(F.col("p_partkey")).alias("target_id"))


_EDGES = f"edges AS (SELECT p_partkey AS source_id, {_IMPORTED} AS target_id FROM part)"
_NODES = "nodes AS (SELECT vec_id AS id, label AS entity_type, length(vec_id::VARCHAR) - 1 AS hierarchy_level, CASE WHEN vec_id >= 10 THEN vec_id // 10 END AS parent_id, 'node_' || vec_id AS name FROM embeddings)"
_TRIPLES = f"""triples AS (
    SELECT '{EX}order/' || o_orderkey AS s, '{RDF_TYPE}' AS p, '{EX}Order' AS o FROM orders
    UNION ALL SELECT '{EX}order/' || o_orderkey, '{EX}placedBy', '{EX}customer/' || o_custkey FROM orders
    UNION ALL SELECT '{EX}order/' || o_orderkey, '{EX}status', '"' || o_orderstatus || '"' FROM orders
    UNION ALL SELECT '{EX}order/' || o_orderkey, '{EX}totalPrice', '"' || o_totalprice || '"d' FROM orders
    UNION ALL SELECT DISTINCT '{EX}order/' || l_orderkey, '{EX}contains', '{EX}part/' || l_partkey FROM lineitem
    UNION ALL SELECT DISTINCT '{EX}part/' || l_partkey, '{EX}suppliedBy', '{EX}supplier/' || l_suppkey FROM lineitem
    UNION ALL SELECT '{EX}part/' || p_partkey, '{RDF_TYPE}', '{EX}Part' FROM part
    UNION ALL SELECT '{EX}part/' || p_partkey, '{EX}name', '"' || p_name || '"' FROM part
    UNION ALL SELECT '{EX}part/' || p_partkey, '{EX}brand', '"' || p_brand || '"' FROM part
    UNION ALL SELECT '{EX}part/' || p_partkey, '{EX}size', '"' || p_size || '"i' FROM part
    UNION ALL SELECT '{EX}part/' || p_partkey, '{EX}imports', '{EX}part/' || ({_IMPORTED}) FROM part
    UNION ALL SELECT '{EX}customer/' || c_custkey, '{RDF_TYPE}', '{EX}Customer' FROM customer
    UNION ALL SELECT '{EX}customer/' || c_custkey, '{EX}name', '"' || c_name || '"' FROM customer
    UNION ALL SELECT '{EX}customer/' || c_custkey, '{EX}inNation', '{EX}nation/' || c_nationkey FROM customer
    UNION ALL SELECT '{EX}supplier/' || s_suppkey, '{RDF_TYPE}', '{EX}Supplier' FROM supplier
    UNION ALL SELECT '{EX}supplier/' || s_suppkey, '{EX}name', '"' || s_name || '"' FROM supplier
    UNION ALL SELECT '{EX}supplier/' || s_suppkey, '{EX}inNation', '{EX}nation/' || s_nationkey FROM supplier
    UNION ALL SELECT '{EX}nation/' || n_nationkey, '{RDF_TYPE}', '{EX}Nation' FROM nation
    UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}name', '"' || n_name || '"' FROM nation
    UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}inRegion', '{EX}region/' || n_regionkey FROM nation
    UNION ALL SELECT '{EX}region/' || r_regionkey, '{RDF_TYPE}', '{EX}Region' FROM region
    UNION ALL SELECT '{EX}region/' || r_regionkey, '{EX}name', '"' || r_name || '"' FROM region)"""

#: Predicate and object of a triple as they are serialised.
_PAIR = f"""('<' || p || '> ' || CASE WHEN o LIKE '"%"d' THEN left(o, -1) || '^^<{XSD}double>' WHEN o LIKE '"%"i' THEN left(o, -1) || '^^<{XSD}integer>' WHEN starts_with(o, '"') THEN o ELSE '<' || o || '>' END)"""


def _graph(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: Catalog(spark, sf).graph.query(P + text)


def _columns(df: DataFrame) -> DataFrame:
    return df.select("id", "entity_type", "hierarchy_level", "parent_id", "name")


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of nations, some with a blank literal, a literal subject or no predicate."""
    n = Catalog(spark, sf).table("nation")
    s = F.when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(F.concat(F.lit(f"{EX}nation/"), "n_nationkey"))
    p = F.when(F.col("n_nationkey") % 7 != 2, f"{EX}name")
    return n.select(s.alias("s"), p.alias("p"), F.when(F.col("n_nationkey") % 4 == 3, " ").otherwise(F.col("n_name")).alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_type"), F.lit(None).cast("string").alias("o_lang"))


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Entities for triple generation: parts as functions of files named by their brand."""
    p = Catalog(spark, sf).table("part")
    calls = F.array(F.concat(F.lit("f"), F.pmod(F.col("p_partkey") * 7 + 3, F.lit(500))))
    none = F.array().cast("array<string>")
    return p.select(F.concat(F.lit("f"), "p_partkey").alias("name"), F.lit("function").alias("entity_type"), F.lit("python").alias("language"), F.lit("src/all parts.py").alias("file_path"), F.lit(None).cast("string").alias("parent_entity"), F.lit(None).cast("string").alias("signature"), F.col("p_size").alias("line_start"), (F.col("p_size") + 10).alias("line_end"), calls.alias("calls"), none.alias("imports"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sparql(name) for name in SPARQL} | {
    "sparql_ask": _graph("ASK { ?a ex:imports ?b . ?b ex:imports ?a }"),
    "sparql_construct": _graph("CONSTRUCT { ?r ex:hasNation ?n } WHERE { ?n ex:inRegion ?r }"),
    "sparql_describe": _graph(f"DESCRIBE <{EX}nation/3>"),
    "sparql_csv": lambda spark, sf: formats.csv_lines(Catalog(spark, sf).graph.query(P + "SELECT ?n ?name WHERE { ?n a ex:Region ; ex:name ?name }")),
    "sparql_tsv": lambda spark, sf: formats.tsv_lines(Catalog(spark, sf).graph.query(P + "SELECT ?n ?name WHERE { ?n a ex:Region ; ex:name ?name }")),
    "sparql_json": lambda spark, sf: formats.sparql_json(Catalog(spark, sf).graph.query(P + "SELECT ?n ?name WHERE { ?n a ex:Region ; ex:name ?name }")),
    "serialize_ntriples": lambda spark, sf: formats.n_triples(Catalog(spark, sf).triples),
    "serialize_turtle": lambda spark, sf: formats.turtle(Catalog(spark, sf).statements),
    "graph_stats": lambda spark, sf: g.graph_stats(Catalog(spark, sf).triples),
    "schema_discovery": lambda spark, sf: g.type_counts(Catalog(spark, sf).triples),
    "schema_predicates": lambda spark, sf: g.predicate_counts(Catalog(spark, sf).triples),
    "schema_properties_of_type": lambda spark, sf: g.properties_of_type(Catalog(spark, sf).triples, EX + "Part"),
    "consistency_orphans": lambda spark, sf: g.consistency(_broken(spark, sf)),
    "graph_repair": lambda spark, sf: g.repaired(_broken(spark, sf)).select("s", "p", "o"),
    "ontology_unknown_terms": lambda spark, sf: g.unknown_terms(Catalog(spark, sf).triples, spark.createDataFrame([(EX + c,) for c in ("Order", "Part", "Nation")], "iri string"), spark.createDataFrame([(EX + p,) for p in ("name", "contains")] + [(RDF_TYPE,)], "iri string")),
    "triple_generation": lambda spark, sf: g.entity_triples(_people(spark, sf), "urn:base#", "urn:code#", "urn:python#").select("s", "p", "o"),
    "one_hop_dependencies": lambda spark, sf: g.neighbours(_edges(spark, sf), 5, "dependencies"),
    "one_hop_dependents": lambda spark, sf: g.neighbours(_edges(spark, sf), 17, "dependents"),
    "one_hop_all": lambda spark, sf: g.neighbours(_edges(spark, sf), 17, "all"),
    "children": lambda spark, sf: _columns(g.children(_nodes(spark, sf), 3)),
    "descendants": lambda spark, sf: _columns(g.descendants(_nodes(spark, sf), 3, 0, 2)),
    "ancestors": lambda spark, sf: _columns(g.ancestors(_nodes(spark, sf), 345)),
    "siblings": lambda spark, sf: _columns(g.siblings(_nodes(spark, sf), 42)),
    "siblings_of_root": lambda spark, sf: _columns(g.siblings(_nodes(spark, sf), 4)),
    "build_hierarchy": lambda spark, sf: g.build_hierarchy(_nodes(spark, sf).select("id", "parent_id")).select("id", "hierarchy_level", F.array_join(F.col("hierarchy_path").cast("array<string>"), "/").alias("path")),
    "induced_subgraph": lambda spark, sf: g.induced(Catalog(spark, sf).table("part").filter("p_size > 25").select(F.col("p_partkey").alias("id")), _edges(spark, sf)),
    "repo_entities_sized": lambda spark, sf: g.sized_entities(Catalog(spark, sf).table("part").filter(F.col("p_type").isin("STANDARD", "PROMO")), "p_size", None).select("p_partkey", "p_name", F.col("size").cast("double").alias("size")),
    "repo_stats": lambda spark, sf: g.repository_stats(Catalog(spark, sf).table("part").select(F.col("p_brand").alias("entity_type")), _edges(spark, sf)),
}

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, _, sql) in SPARQL.items()} | {
    "sparql_ask": f"WITH {_EDGES} SELECT count(*) > 0 AS answer FROM edges a JOIN edges b ON a.target_id = b.source_id AND b.target_id = a.source_id",
    "sparql_construct": f"SELECT '{EX}region/' || n_regionkey AS s, '{EX}hasNation' AS p, '{EX}nation/' || n_nationkey AS o FROM nation",
    "sparql_describe": f"WITH {_TRIPLES} SELECT * FROM triples WHERE s = '{EX}nation/3'",
    "sparql_csv": f"SELECT '{EX}region/' || r_regionkey || ',' || r_name AS value FROM region",
    "sparql_tsv": f"SELECT '{EX}region/' || r_regionkey || chr(9) || r_name AS value FROM region",
    "sparql_json": f"""SELECT '{{"n":{{"type":"uri","value":"{EX}region/' || r_regionkey || '"}},"name":{{"type":"literal","value":"' || r_name || '"}}}}' AS value FROM region""",
    "serialize_ntriples": f"WITH {_TRIPLES} SELECT '<' || s || '> ' || {_PAIR} || ' .' AS value FROM triples",
    "serialize_turtle": f"WITH {_TRIPLES} SELECT '<' || s || '> ' || string_agg(DISTINCT {_PAIR}, ' ;' || chr(10) || '    ' ORDER BY {_PAIR}) || ' .' AS value FROM triples GROUP BY s",
    "graph_stats": f"WITH {_TRIPLES} SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) AS objects FROM triples",
    "schema_discovery": f"WITH {_TRIPLES} SELECT o AS type, count(*) AS n FROM triples WHERE p = '{RDF_TYPE}' GROUP BY o",
    "schema_predicates": f"WITH {_TRIPLES} SELECT p, count(*) AS n FROM triples GROUP BY p",
    "schema_properties_of_type": f"WITH {_TRIPLES} SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM triples WHERE s IN (SELECT s FROM triples WHERE p = '{RDF_TYPE}' AND o = '{EX}Part') GROUP BY p",
    "consistency_orphans": "SELECT count(*) FILTER (n_nationkey % 5 = 1) AS bad_subjects, count(*) FILTER (n_nationkey % 7 = 2) AS bad_predicates, count(*) AS untyped_subjects FROM nation",
    "graph_repair": f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}name' AS p, n_name AS o FROM nation WHERE n_nationkey % 5 <> 1 AND n_nationkey % 7 <> 2 AND n_nationkey % 4 <> 3",
    "ontology_unknown_terms": f"""WITH {_TRIPLES} SELECT 'class' AS kind, o AS term, count(*) AS n FROM triples WHERE p = '{RDF_TYPE}' AND o NOT IN ('{EX}Order', '{EX}Part', '{EX}Nation') GROUP BY o
        UNION ALL SELECT 'property', p, count(*) FROM triples WHERE p NOT IN ('{EX}name', '{EX}contains', '{RDF_TYPE}') GROUP BY p""",
    "triple_generation": f"""WITH f AS (SELECT p_partkey AS k, 'urn:base#function/src/all_parts.py/f' || p_partkey AS s, (p_partkey * 7 + 3) % 500 AS t, p_size FROM part),
        c AS (SELECT f.s, coalesce(o.s, 'urn:base#external/function/src/all_parts.py/f' || f.t) AS o, o.s IS NULL AS outside FROM f LEFT JOIN f o ON f.t = o.k)
        SELECT s, '{RDF_TYPE}' AS p, 'urn:python#PythonFunction' AS o FROM f UNION SELECT s, 'urn:code#name', 'f' || k FROM f UNION SELECT s, 'urn:code#file_path', 'src/all parts.py' FROM f
        UNION SELECT s, 'urn:code#start_line', p_size::VARCHAR FROM f UNION SELECT s, 'urn:code#end_line', (p_size + 10)::VARCHAR FROM f
        UNION SELECT s, 'urn:code#calls', o FROM c UNION SELECT o, 'urn:code#calledBy', s FROM c UNION SELECT o, '{RDF_TYPE}', 'urn:code#Function' FROM c WHERE outside""",
    "one_hop_dependencies": f"WITH {_EDGES} SELECT DISTINCT target_id AS id FROM edges WHERE source_id = 5",
    "one_hop_dependents": f"WITH {_EDGES} SELECT DISTINCT source_id AS id FROM edges WHERE target_id = 17",
    "one_hop_all": f"WITH {_EDGES} SELECT source_id AS id FROM edges WHERE target_id = 17 UNION SELECT target_id FROM edges WHERE source_id = 17",
    "children": f"WITH {_NODES} SELECT id, entity_type, hierarchy_level, parent_id, name FROM nodes WHERE parent_id = 3",
    "descendants": f"WITH {_NODES} SELECT id, entity_type, hierarchy_level, parent_id, name FROM nodes WHERE id::VARCHAR LIKE '3_%' AND hierarchy_level <= 2",
    "ancestors": f"WITH {_NODES} SELECT id, entity_type, hierarchy_level, parent_id, name FROM nodes WHERE id IN (3, 34)",
    "siblings": f"WITH {_NODES} SELECT id, entity_type, hierarchy_level, parent_id, name FROM nodes WHERE parent_id = 4 AND id <> 42",
    "siblings_of_root": f"WITH {_NODES} SELECT id, entity_type, hierarchy_level, parent_id, name FROM nodes WHERE parent_id IS NULL AND id <> 4",
    "build_hierarchy": f"""WITH RECURSIVE {_NODES}, r AS (SELECT id, 0 AS hierarchy_level, '' AS path FROM nodes WHERE parent_id IS NULL
        UNION ALL SELECT n.id, r.hierarchy_level + 1, CASE WHEN r.path = '' THEN '' ELSE r.path || '/' END || n.parent_id FROM nodes n JOIN r ON n.parent_id = r.id) SELECT * FROM r""",
    "induced_subgraph": f"WITH {_EDGES}, n AS (SELECT p_partkey AS id FROM part WHERE p_size > 25) SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)",
    "repo_entities_sized": "SELECT p_partkey, p_name, greatest(5, least(30, p_size * 2 + 5))::DOUBLE AS size FROM part WHERE p_type IN ('STANDARD', 'PROMO')",
    "repo_stats": f"WITH {_EDGES} SELECT count(*) AS total_entities, count(DISTINCT p_brand) AS entity_types, (SELECT count(*) FROM edges) AS total_relationships, (SELECT count(*) FROM edges)::DOUBLE / count(*) AS density FROM part",
}
