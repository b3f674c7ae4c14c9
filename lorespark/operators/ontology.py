"""Ontologies: classes and properties as small tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.tables import written

# --- fixed values: (class, parent) and (property, inverse, transitive)
CLASSES = (
    ("CodeEntity", None), ("Container", "CodeEntity"), ("Class", "Container"), ("Library", "Container"), ("Module", "Container"), ("Project", "Container"), ("Function", "CodeEntity"), ("Variable", "CodeEntity"), ("DataType", "CodeEntity"),
    ("Decorator", None), ("PythonCallable", None), ("PythonClass", None), ("PythonFunction", "PythonCallable"), ("PythonMethod", "PythonFunction"), ("PythonImport", None), ("PythonModule", None), ("PythonPackage", None), ("PythonProperty", None),
)
PROPERTIES = (
    ("contains", "containedIn", False), ("hasType", None, False), ("decoratedBy", None, False), ("hasBaseClass", None, True), ("calls", "calledBy", False), ("defines", "definedIn", False), ("dependsOn", "dependencyOf", True),
    ("inheritsFrom", "inheritedBy", True), ("imports", "importedBy", False), ("implements", "implementedBy", False), ("uses", "usedBy", False),
)
DATA_PROPERTIES = ("complexity", "file_path", "line_count", "name", "start_line", "end_line", "signature", "is_async", "is_generator", "has_docstring", "import_alias")
# --- end of fixed values
_OWL, _RDF, _RDFS = "{http://www.w3.org/2002/07/owl#}", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}"


class Ontology:
    """classes: (iri, parent); properties: (iri, inverse_of, transitive, kind)."""

    def __init__(self, classes: DataFrame, properties: DataFrame):
        self.classes, self.properties = classes, properties

    @staticmethod
    def built_in(spark: SparkSession, base: str = "urn:code#") -> Ontology:
        classes = [(base + c, p and base + p) for c, p in CLASSES]
        both = [(base + a, b and base + b, t, "object") for a, b, t in PROPERTIES] + [(base + b, base + a, False, "object") for a, b, _ in PROPERTIES if b]
        data = [(base + d, None, False, "data") for d in DATA_PROPERTIES]
        return Ontology(spark.createDataFrame(classes, "iri string, parent string"), spark.createDataFrame(both + data, "iri string, inverse_of string, transitive boolean, kind string"))

    @staticmethod
    def load(spark: SparkSession, xml: str) -> Ontology:
        """From the text of an OWL document in RDF/XML."""
        root = ET.fromstring(xml)
        about = lambda e: e.get(_RDF + "about")
        target = lambda e, tag: next((x.get(_RDF + "resource") for x in e.iter(tag) if x.get(_RDF + "resource")), None)
        classes = [(about(e), target(e, _RDFS + "subClassOf")) for e in root.iter(_OWL + "Class") if about(e)]
        properties = [(about(e), target(e, _OWL + "inverseOf"), any((x.get(_RDF + "resource") or "").endswith("TransitiveProperty") for x in e.iter(_RDF + "type")), kind) for kind, tag in (("object", "ObjectProperty"), ("data", "DatatypeProperty")) for e in root.iter(_OWL + tag) if about(e)]
        return Ontology(spark.createDataFrame(classes, "iri string, parent string"), spark.createDataFrame(properties, "iri string, inverse_of string, transitive boolean, kind string"))

    @staticmethod
    def of_triples(triples: DataFrame) -> Ontology:
        """From a graph (s, p, o) that declares classes and properties in OWL terms. A class with several parents has a row for each."""
        at = lambda ns, name: (ns + name).translate(str.maketrans("", "", "{}"))
        said = lambda p, name: triples.filter(F.col("p") == p).select(F.col("s").alias("iri"), F.col("o").alias(name)).distinct()
        kinds = said(at(_RDF, "type"), "kind")
        classes = kinds.filter(F.col("kind") == at(_OWL, "Class")).select("iri").join(said(at(_RDFS, "subClassOf"), "parent"), "iri", "left")
        kind = F.when(F.col("kind") == at(_OWL, "ObjectProperty"), "object").when(F.col("kind") == at(_OWL, "DatatypeProperty"), "data")
        named = kinds.select("iri", kind.alias("kind"), (F.col("kind") == at(_OWL, "TransitiveProperty")).alias("transitive"))
        properties = named.groupBy("iri").agg(F.max("kind").alias("kind"), F.max("transitive").alias("transitive")).filter("kind is not null")
        return Ontology(classes, properties.join(said(at(_OWL, "inverseOf"), "inverse_of"), "iri", "left").select("iri", "inverse_of", "transitive", "kind"))

    def search(self, pattern: str) -> DataFrame:
        """(kind, iri) of classes and properties whose local name matches a pattern with * and ?."""
        like = pattern.lower().replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
        rows = self.classes.select(F.lit("class").alias("kind"), "iri").unionByName(self.properties.select(F.concat("kind", F.lit(" property")).alias("kind"), "iri"))
        return rows.filter(F.lower(F.element_at(F.split("iri", "[#/]"), -1)).like(like)).orderBy("kind", "iri")

    def subclasses(self, iri: str) -> DataFrame:
        """All below a class, with their depth."""
        level = self.classes.filter(F.col("parent") == iri).select("iri", F.lit(1).alias("depth"))
        out, depth = level, 1
        while not level.isEmpty():  # what has been found before is on a cycle, or found by a shorter way
            depth += 1
            below = self.classes.join(level.select(F.col("iri").alias("parent")), "parent", "left_semi").select("iri", F.lit(depth).alias("depth"))
            level = written(below.join(out.select("iri"), "iri", "left_anti").distinct(), "subclasses")
            out = out.unionByName(level)
        return out

    def info(self) -> DataFrame:
        n = self.properties.agg(F.count_if(F.col("kind") == "object").alias("object_properties"), F.count_if(F.col("kind") == "data").alias("data_properties"), F.count_if("transitive").alias("transitive_properties"))
        return self.classes.agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("parent").isNull()).alias("roots")).crossJoin(F.broadcast(n))  # one row each
