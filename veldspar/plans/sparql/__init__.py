"""SPARQL SELECT compiled to one DataFrame plan."""

from veldspar.plans.sparql.compiler import select
from veldspar.plans.sparql.syntax import SparqlSyntaxError, parse

__all__ = ["SparqlSyntaxError", "parse", "select"]
