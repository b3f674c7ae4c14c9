import pytest

from lorespark.operators.documents import checked_uuid, containing_join
from lorespark.operators.ontology import Ontology
from lorespark.operators.resilience import CircuitOpen, Guarded

OWL = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
<owl:Class rdf:about="urn:A"/><owl:Class rdf:about="urn:B"><rdfs:subClassOf rdf:resource="urn:A"/></owl:Class>
<owl:ObjectProperty rdf:about="urn:p"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#TransitiveProperty"/></owl:ObjectProperty>
<owl:ObjectProperty rdf:about="urn:q"><owl:inverseOf rdf:resource="urn:p"/></owl:ObjectProperty><owl:DatatypeProperty rdf:about="urn:d"/></rdf:RDF>"""


def test_ontology_from_xml(spark):
    o = Ontology.load(spark, OWL)
    assert [r.iri for r in o.subclasses("urn:A").collect()] == ["urn:B"]
    assert {(r.iri, r.inverse_of, r.transitive, r.kind) for r in o.properties.collect()} == {("urn:p", None, True, "object"), ("urn:q", "urn:p", False, "object"), ("urn:d", None, False, "data")}


def test_circuit_breaker():
    now, naps, fail = [0.0], [], [True]

    def call():
        if fail[0]:
            raise OSError
        return 1

    g = Guarded(call, attempts=3, clock=lambda: now[0], sleep=naps.append)
    for _ in range(2):
        with pytest.raises(OSError):
            g()
    assert naps[:2] == [1.0, 2.0]
    with pytest.raises(CircuitOpen):
        g()
    now[0], fail[0] = 61.0, False
    assert g() == 1 and g.failed == 0 and g.error_rate == pytest.approx(5 / 6)


def test_uuid():
    assert checked_uuid("{12345678-1234-5678-1234-567812345678}") == "12345678-1234-5678-1234-567812345678"
    with pytest.raises(ValueError):
        checked_uuid("x")


def test_containing_join(spark):
    parts = spark.createDataFrame([(1, "os"), (2, "zz"), (3, "")], "part_id int, part string")
    wholes = spark.createDataFrame([(7, "chaos"), (5, "os.path"), (6, "x")], "whole_id int, whole string")
    assert [(r.part_id, r.whole_id) for r in containing_join(parts, wholes).collect()] == [(1, 5)]
    assert containing_join(parts.limit(0), wholes).count() == 0
