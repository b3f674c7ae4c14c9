"""SPARQL 1.1 queries compiled to DataFrame plans over a table of triples."""

from lorespark.sparql.compiler import Graph, Solutions
from lorespark.sparql.parser import SparqlError, parse

__all__ = ["Graph", "Solutions", "SparqlError", "parse"]
