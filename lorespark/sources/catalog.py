"""The logical tables of the knowledge base, bound to the test tables.

The test tables hold no code base, so orders stand for functions, parts for what they call, nations and regions for
what things inherit from, documents for knowledge entries, embeddings for entities with vectors, conversations for
memories and events for interactions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.tables import spread
from lorespark.sparql.compiler import Graph
from lorespark.sparql.parser import RDF_TYPE, XSD

EX = "http://example.org/"
PREFIXES = {"ex": EX, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": XSD}
TRIPLE = "s string, p string, o string, o_kind string, o_type string, o_lang string"
#: Days after the first event that queries take as now, so that results do not depend on the clock.
AS_OF = "2024-01-31 00:00:00"
#: Parts import one another within groups of so many.
GROUP = 200


def iri(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{EX}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def imported(part: Column) -> Column:
    """The part that a part imports."""
    place = F.pmod(part, F.lit(GROUP))
    return part - place + F.pmod(place * 6 + 1, F.lit(GROUP))


def resource(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(EX + p if ":" not in p else p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"), F.lit(None).cast("string").alias("o_lang"))


def value(df: DataFrame, s: Column, p: str, o: Column, type_: str = "string") -> DataFrame:
    return df.select(s.alias("s"), F.lit(EX + p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD + type_).alias("o_type"), F.lit(None).cast("string").alias("o_lang"))


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def triples(self) -> DataFrame:
        """A union of selections with a constant predicate each, so a query reads the tables of its predicates only."""
        rows = self.table("lineitem").count()
        return self._stated(lambda pairs: spread(pairs, rows, *pairs.columns).distinct())

    @cached_property
    def statements(self) -> DataFrame:
        """The triples, some of them repeated, for what forms sets itself."""
        return self._stated(lambda pairs: pairs)

    def _stated(self, once: Callable[[DataFrame], DataFrame]) -> DataFrame:
        t = self.table
        order, part, supplier, customer, nation, region = (t(n) for n in ("orders", "part", "supplier", "customer", "nation", "region"))
        line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        parts = [
            resource(order, iri("order", "o_orderkey"), RDF_TYPE, F.lit(EX + "Order")),
            resource(order, iri("order", "o_orderkey"), "placedBy", iri("customer", "o_custkey")),
            value(order, iri("order", "o_orderkey"), "status", F.col("o_orderstatus")),
            value(order, iri("order", "o_orderkey"), "totalPrice", F.col("o_totalprice"), "double"),
            resource(once(line.select("l_orderkey", "l_partkey")), iri("order", "l_orderkey"), "contains", iri("part", "l_partkey")),
            resource(once(line.select("l_partkey", "l_suppkey")), iri("part", "l_partkey"), "suppliedBy", iri("supplier", "l_suppkey")),
            resource(part, iri("part", "p_partkey"), RDF_TYPE, F.lit(EX + "Part")),
            value(part, iri("part", "p_partkey"), "name", F.col("p_name")),
            value(part, iri("part", "p_partkey"), "brand", F.col("p_brand")),
            value(part, iri("part", "p_partkey"), "size", F.col("p_size"), "integer"),
            resource(part, iri("part", "p_partkey"), "imports", iri("part", imported(F.col("p_partkey")))),
            resource(customer, iri("customer", "c_custkey"), RDF_TYPE, F.lit(EX + "Customer")),
            value(customer, iri("customer", "c_custkey"), "name", F.col("c_name")),
            resource(customer, iri("customer", "c_custkey"), "inNation", iri("nation", "c_nationkey")),
            resource(supplier, iri("supplier", "s_suppkey"), RDF_TYPE, F.lit(EX + "Supplier")),
            value(supplier, iri("supplier", "s_suppkey"), "name", F.col("s_name")),
            resource(supplier, iri("supplier", "s_suppkey"), "inNation", iri("nation", "s_nationkey")),
            resource(nation, iri("nation", "n_nationkey"), RDF_TYPE, F.lit(EX + "Nation")),
            value(nation, iri("nation", "n_nationkey"), "name", F.col("n_name")),
            resource(nation, iri("nation", "n_nationkey"), "inRegion", iri("region", "n_regionkey")),
            resource(region, iri("region", "r_regionkey"), RDF_TYPE, F.lit(EX + "Region")),
            value(region, iri("region", "r_regionkey"), "name", F.col("r_name")),
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def graph(self) -> Graph:
        return self._graph(self.triples)

    @cached_property
    def stated(self) -> Graph:
        """The graph of the statements, for queries whose results are sets."""
        rows = self.table("lineitem").count()
        return self._graph(self.statements, {EX + "contains": rows, EX + "suppliedBy": rows})

    def _graph(self, triples: DataFrame, rows: dict[str, int] | None = None) -> Graph:
        # Relative sizes of the predicates, by which the compiler orders joins.
        sizes = {"contains": 60, "suppliedBy": 8, "placedBy": 15, "status": 15, "totalPrice": 15, "name": 4, "brand": 2, "size": 2, "imports": 2, "inNation": 1.6, "inRegion": 0.02}
        return Graph(triples, PREFIXES, {EX + k: int(v * 1000) for k, v in sizes.items()} | {RDF_TYPE: 20_000}, lambda: self.quads, F.to_timestamp(F.lit(AS_OF)), rows)

    @cached_property
    def quads(self) -> DataFrame:
        """Suppliers and customers in a named graph for each region, and the names of regions in one of their own."""
        nation, region = self.table("nation"), self.table("region")
        none = F.lit(None).cast("string")

        def quad(rows: DataFrame, s: Column, p: str, o: Column, kind: str, g: Column) -> DataFrame:
            return rows.select(s.alias("s"), F.lit(EX + p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_type"), none.alias("o_lang"), g.alias("g"))

        parts = [quad(region, iri("region", "r_regionkey"), "name", F.col("r_name"), "literal", F.lit(EX + "graph/regions"))]
        for kind, key, at, name in (("supplier", "s_suppkey", "s_nationkey", "s_name"), ("customer", "c_custkey", "c_nationkey", "c_name")):
            rows = self.table(kind).join(nation, F.col(at) == F.col("n_nationkey"))
            s, g = iri(kind, key), iri("graph", "n_regionkey")
            parts += [quad(rows, s, "inNation", iri("nation", at), "uri", g), quad(rows, s, "name", F.col(name), "literal", g)]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def knowledge(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source", "n_chars")

    @cached_property
    def golden_nodes(self) -> DataFrame:
        """Entities with vectors in a hierarchy: the parent of 1234 is 123, and the path holds all ancestors from the root."""
        e = self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("entity_type"))
        digits = F.length(F.col("id").cast("string"))
        path = F.expr("transform(sequence(1, length(cast(id as string)) - 1), k -> cast(substring(cast(id as string), 1, k) as bigint))")
        return e.withColumn("hierarchy_level", digits - 1).withColumn("parent_id", F.when(digits > 1, F.floor(F.col("id") / 10))).withColumn("hierarchy_path", F.when(digits > 1, path).otherwise(F.array().cast("array<bigint>"))).withColumn("name", F.concat(F.lit("node_"), F.col("id")))

    @cached_property
    def versions(self) -> DataFrame:
        """Entities on branches: documents on the branch of their source, named by doc_id modulo 50."""
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("id"), F.lit("repo").alias("repository_url"), F.col("source").alias("branch_name"), F.concat(F.lit("entity_"), F.pmod("doc_id", F.lit(50))).alias("entity_name"), F.md5("text").alias("content_hash"), F.col("lang").alias("entity_type"), F.col("doc_id").alias("updated_at"))

    @cached_property
    def memory(self) -> DataFrame:
        c = self.table("conversations")
        kind = F.when(F.col("role") == "user", "episodic").when(F.col("role") == "assistant", "semantic").otherwise("procedural")
        return c.select(F.left(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256), F.lit(16)).alias("id"), F.col("conv_id").alias("session_id"), kind.alias("type"), F.col("text").alias("content"), F.col("turn").alias("position"))

    @cached_property
    def interactions(self) -> DataFrame:
        e = self.table("events")
        feedback = F.when(F.col("event_type").isin("purchase", "click"), "positive").when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "view", "neutral").otherwise("explicit_rating")
        rating = F.when(F.col("event_type") == "signup", F.pmod("event_id", F.lit(5)) + 1)
        return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), feedback.alias("feedback_type"), rating.cast("double").alias("feedback_value"), F.col("value").alias("response_ms"), "event_type")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")
