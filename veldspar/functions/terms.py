"""RDF terms as text: local names, literals, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_FULL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def local_name(iri: Column) -> Column:
    """What follows the last #, else the last /, else the last colon."""
    return (
        F.when(iri.contains("#"), F.substring_index(iri, "#", -1))
        .when(iri.contains("/"), F.substring_index(iri, "/", -1))
        .when(iri.contains(":"), F.substring_index(iri, ":", -1))
        .otherwise(iri)
    )


def is_type(predicate: Column) -> Column:
    return (predicate == "rdf:type") | predicate.endswith("#type")


def is_sub_class_of(label: Column) -> Column:
    low = F.lower(label)
    return low.isin("subclassof", "rdfs:subclassof") | low.endswith("#subclassof") | low.endswith("/subclassof")


def literal(raw: Column) -> Column:
    """struct(lexical, datatype, language): by the last "^^, else the last "@, else by the quotes alone; a term
    without a leading quote is its own text."""
    typed, tagged = raw.contains('"^^'), raw.contains('"@')
    quoted = raw.startswith('"')
    upto = lambda mark: raw.substr(F.lit(2), F.length(raw) - F.length(F.substring_index(raw, mark, -1)) - len(mark) - 1)
    lexical = F.when(quoted & typed, upto('"^^')).when(quoted & tagged, upto('"@')).when(quoted & raw.endswith('"') & (F.length(raw) >= 2), raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)
    datatype = F.when(quoted & typed, F.regexp_replace(F.substring_index(raw, '"^^', -1), "^<+|>+$", "")).when(quoted & tagged, F.lit(None).cast("string")).otherwise("xsd:string")
    language = F.when(quoted & ~typed & tagged, F.substring_index(raw, '"@', -1))
    return F.struct(lexical.alias("lexical"), datatype.alias("datatype"), language.alias("language"))


def xsd_date(text: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy as a date; null for anything else."""
    t = F.trim(text)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    return full.try_cast("date")
