"""Hierarchies, property graphs and triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.scoring import node_size
from lorespark.functions.text import entity_iri, external_iri
from lorespark.sources.tables import spread, written
from lorespark.sparql.compiler import object_term
from lorespark.sparql.parser import RDF_TYPE, XSD

# --- hierarchies over (id, parent_id, hierarchy_level, hierarchy_path, name)


def children(nodes: DataFrame, node) -> DataFrame:
    return nodes.filter(F.col("parent_id") == node).orderBy("name", "id")


def descendants(nodes: DataFrame, node, level: int, max_depth: int | None = None) -> DataFrame:
    """By the stored path: all below node that are at most max_depth levels deeper."""
    below = (F.col("parent_id") == node) | F.array_contains("hierarchy_path", node)
    return nodes.filter(below & (F.col("hierarchy_level") <= level + (max_depth or 999))).orderBy("hierarchy_level", "name", "id")


def ancestors(nodes: DataFrame, node, max_depth: int | None = None) -> DataFrame:
    """The nearest first; the path of one node is short, so it is joined as a small frame."""
    path = F.col("hierarchy_path")
    wanted = nodes.filter(F.col("id") == node).select(F.explode(path if max_depth is None else F.slice(path, -F.least(F.lit(max_depth), F.size(path)), F.least(F.lit(max_depth), F.size(path)))).alias("id"))
    return nodes.join(wanted, "id", "left_semi").orderBy(F.desc("hierarchy_level"), "id")


def siblings(nodes: DataFrame, node) -> DataFrame:
    """Others with the same parent; of a root the other nodes without a parent on its level."""
    own = nodes.filter(F.col("id") == node).select(F.col("parent_id").alias("__p"), F.col("hierarchy_level").alias("__l"))
    match = F.col("parent_id").eqNullSafe(F.col("__p")) & (F.col("__p").isNotNull() | (F.col("hierarchy_level") == F.col("__l")))
    return nodes.join(F.broadcast(own.limit(1)), match).filter(F.col("id") != node).drop("__p", "__l").orderBy("name", "id")


def build_hierarchy(links: DataFrame) -> DataFrame:
    """(id, hierarchy_level, hierarchy_path) from (id, parent_id): a round for each level; nodes on a cycle, or below one or a missing parent, get none."""
    done = links.filter(F.col("parent_id").isNull()).select("id", F.lit(0).alias("hierarchy_level"), F.array().cast("array<bigint>").alias("hierarchy_path"))
    level, parts = written(done, "hierarchy"), []
    while not level.isEmpty():
        parts.append(level)
        up = level.select(F.col("id").alias("parent_id"), "hierarchy_level", "hierarchy_path")
        level = written(links.join(up, "parent_id").select("id", (F.col("hierarchy_level") + 1).alias("hierarchy_level"), F.concat("hierarchy_path", F.array("parent_id")).alias("hierarchy_path")).filter(~F.array_contains("hierarchy_path", F.col("id"))), "hierarchy")
    return reduce(DataFrame.unionByName, parts, level)


# --- property graphs


def neighbours(edges: DataFrame, node, direction: str = "all") -> DataFrame:
    """(id) one step away: what node points to (dependencies), what points to it (dependents), or both."""
    out = edges.filter(F.col("source_id") == node).select(F.col("target_id").alias("id"))
    back = edges.filter(F.col("target_id") == node).select(F.col("source_id").alias("id"))
    return {"dependencies": out, "dependents": back, "all": out.unionByName(back)}[direction].distinct()


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    keys = nodes.select("id").distinct()
    return edges.join(keys.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(keys.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*edges.columns)


def sized_entities(entities: DataFrame, complexity: str | None, lines: str | None) -> DataFrame:
    empty = F.lit(None).cast("double")
    return entities.withColumn("size", node_size(F.col(complexity) if complexity else empty, F.col(lines) if lines else empty, complexity is not None, lines is not None))


def semantic_edges(nodes: DataFrame, edges: DataFrame, most: int, threshold: float) -> DataFrame:
    """Similarity edges over a threshold among the most important nodes that have vectors."""
    top = nodes.filter(F.col("embedding").isNotNull()).orderBy(F.desc("importance"), "id").limit(most).select("id")
    return induced(top, edges.filter(F.col("similarity") >= threshold))


def repository_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities, relationships and relationships per entity (null without entities)."""
    n = entities.agg(F.count(F.lit(1)).alias("total_entities"), F.count_distinct("entity_type").alias("entity_types"))
    m = edges.agg(F.count(F.lit(1)).alias("total_relationships"))
    return n.crossJoin(F.broadcast(m)).withColumn("density", F.try_divide("total_relationships", "total_entities"))  # one row each


def divergences(versions: DataFrame, source: str, target: str) -> DataFrame:
    """Entities of the same name whose latest contents on two branches differ."""
    from lorespark.operators.documents import last_of

    side = lambda b, c: last_of(versions.filter(F.col("branch_name") == b).select("entity_name", "content_hash", "id", "updated_at"), ["entity_name"], [F.col("updated_at"), F.col("id")]).select("entity_name", F.col("id").alias(f"{c}_id"), F.col("content_hash").alias(f"{c}_hash"))
    return side(source, "source").join(side(target, "target"), "entity_name").filter("source_hash <> target_hash")


# --- triples (s, p, o, o_kind, o_type, o_lang)


def graph_stats(triples: DataFrame) -> DataFrame:
    """One row: triples, and how many different subjects, predicates and objects they have.

    Subjects and objects are each dealt by themselves to partitions whose number grows with the triples, so that a task
    holds a bounded number of them; together they would be spread out threefold and held at once.
    """
    n, predicates = triples.agg(F.count(F.lit(1)), F.count_distinct("p")).first()
    several = lambda c, name: spread(triples.select(c.alias("term")), n, "term").distinct().agg(F.count("term").alias(name))
    counts = several(F.col("s"), "subjects").crossJoin(F.broadcast(several(object_term(), "objects")))  # one row each
    return counts.select(F.lit(n).cast("long").alias("triples"), "subjects", F.lit(predicates).cast("long").alias("predicates"), "objects")


def type_counts(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def properties_of_type(triples: DataFrame, type_: str) -> DataFrame:
    of_type = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == type_)).select("s")
    return triples.join(of_type, "s", "left_semi").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


def untyped_subjects(triples: DataFrame) -> DataFrame:
    return triples.select("s").distinct().join(triples.filter(F.col("p") == RDF_TYPE).select("s"), "s", "left_anti")


def consistency(triples: DataFrame) -> DataFrame:
    uri = lambda c: F.col(c).isNotNull() & ~F.col(c).startswith("_:") & ~F.col(c).startswith('"')
    bad = triples.agg(F.count_if(~uri("s")).alias("bad_subjects"), F.count_if(~uri("p")).alias("bad_predicates"))
    return bad.crossJoin(F.broadcast(untyped_subjects(triples).agg(F.count(F.lit(1)).alias("untyped_subjects"))))


def repaired(triples: DataFrame) -> DataFrame:
    """Without triples that have no proper subject or predicate, or a blank literal."""
    uri = lambda c: F.col(c).isNotNull() & ~F.col(c).startswith("_:") & ~F.col(c).startswith('"') & (F.trim(c) != "")
    return triples.filter(uri("s") & uri("p") & F.col("o").isNotNull() & ((F.col("o_kind") != "literal") | (F.trim("o") != "")))


def unknown_terms(triples: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(kind, term, n): classes and properties that the ontology, frames of (iri), does not have."""
    c = type_counts(triples).select(F.lit("class").alias("kind"), F.col("type").alias("term"), "n").join(classes.select(F.col("iri").alias("term")), "term", "left_anti")
    p = predicate_counts(triples).select(F.lit("property").alias("kind"), F.col("p").alias("term"), "n").join(properties.select(F.col("iri").alias("term")), "term", "left_anti")
    return c.select("kind", "term", "n").unionByName(p.select("kind", "term", "n"))


# --- fixed values: classes of entity types
PYTHON_CLASSES = {"function": "PythonFunction", "class": "PythonClass", "module": "PythonModule", "method": "PythonMethod", "property": "PythonProperty"}
GENERIC_CLASSES = {"function": "Function", "class": "Class", "module": "Module", "library": "Library", "variable": "Variable", "interface": "Class", "enum": "Class", "struct": "Class", "method": "Function", "property": "Variable"}
# --- end of fixed values


def ontology_class(kind: Column, language: Column, code: str, python: str) -> Column:
    out = F.lit(code + "CodeEntity")
    for k, v in GENERIC_CLASSES.items():
        out = F.when(kind == k, code + v).otherwise(out)
    special = F.lit(None).cast("string")
    for k, v in PYTHON_CLASSES.items():
        special = F.when(kind == k, python + v).otherwise(special)
    return F.when((language == "python") & special.isNotNull(), special).otherwise(out)


def entity_triples(entities: DataFrame, base: str, code: str, python: str) -> DataFrame:
    """Triples of entities (name, entity_type, language, file_path, parent_entity, signature, line_start, line_end, calls, imports).

    Calls and imports of names that the same file defines point to those entities, with an inverse edge; other names
    become external nodes. The graph is a set, formed in partitions whose number grows with the entities.
    """
    who = entity_iri(base, F.col("entity_type"), F.col("file_path"), F.col("name"), F.col("parent_entity"))
    e = entities.withColumn("s", who)

    def triple(p: str, o: Column, kind: str, type_: str | None = None) -> Column:
        return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(None if type_ is None else XSD + type_).cast("string").alias("o_type"))

    own = F.array(
        triple(RDF_TYPE, ontology_class(F.col("entity_type"), F.col("language"), code, python), "uri"),
        triple(code + "name", F.col("name"), "literal", "string"),
        triple(code + "signature", F.col("signature"), "literal", "string"),
        triple(code + "file_path", F.col("file_path"), "literal", "string"),
        triple(code + "start_line", F.col("line_start"), "literal", "integer"),
        triple(code + "end_line", F.col("line_end"), "literal", "integer"),
    )
    plain = e.select("s", F.explode(own).alias("t")).select("s", "t.*").filter("o is not null")
    named = e.select("file_path", F.col("name").alias("target"), F.col("s").alias("found"))
    edges = [("calls", "calledBy", "calls", "Function"), ("imports", "importedBy", "imports", "Module")]
    parts = [plain]
    for forward, inverse, column, kind in edges:
        uses = e.select("s", "file_path", F.explode(column).alias("target"))
        uses = uses.join(named, ["file_path", "target"], "left").withColumn("o", F.coalesce("found", external_iri(base, F.lit(kind), F.col("file_path"), F.col("target"))))
        uri = lambda s, p, o: uses.select(s.alias("s"), F.lit(code + p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))  # noqa: B023, E731
        parts += [uri(F.col("s"), forward, F.col("o")), uri(F.col("o"), inverse, F.col("s"))]
        outside = uses.filter("found is null").select(F.col("o").alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(code + kind).alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_type")).distinct()
        parts.append(outside)
    parents = e.filter("parent_entity is not null").join(named.withColumnRenamed("target", "parent_entity"), ["file_path", "parent_entity"])
    link = lambda s, p, o: parents.select(s.alias("s"), F.lit(code + p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))
    parts += [link(F.col("found"), "contains", F.col("s")), link(F.col("s"), "containedIn", F.col("found"))]
    return spread(reduce(DataFrame.unionByName, parts), entities.count(), "s", "p", "o", each=1 << 15).distinct().withColumn("o_lang", F.lit(None).cast("string"))
