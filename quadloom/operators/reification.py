"""Reifiers of triples: nodes that rdf:reifies links to triple terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import K_BNODE, K_TRIPLE, Kind, Value, box, boxed_constant, same_term, struct, triple_part, triple_text
from quadloom.operators.setops import COLUMNS, REIFIES
from quadloom.sparql.ast import TripleTerm


def _matches(term: Column, s=None, p=None, o=None) -> Column:
    """Whether a boxed triple term has the given parts; None is a wildcard."""
    out = term["k"] == K_TRIPLE
    for i, part in enumerate((s, p, o)):
        if part is not None:
            out = out & same_term(triple_part(term, i), boxed_constant(part))
    return out


def term_column(s: str = "s", p: str = "p", o: str = "o") -> Column:
    """The triple term of a row of quads."""
    return triple_text(F.col(s), box(Value(F.col(p), Kind("iri"))), F.col(o))


def add_reification(quads: DataFrame, reifier, term: TripleTerm) -> DataFrame:
    """With one more link from a reifier to a triple term; the triple itself is not asserted."""
    new = quads.sparkSession.range(1).select(F.lit("").alias("g"), boxed_constant(reifier).alias("s"), F.lit(REIFIES).alias("p"), boxed_constant(term).alias("o"))
    return quads.select(COLUMNS).unionByName(new).distinct()


def reify(quads: DataFrame, triples: DataFrame) -> DataFrame:
    """With a reifier for each of the triples (g, s, p, o): a blank node named by a digest of the triple, the same in every run."""
    term = term_column()
    links = triples.select("g", struct(K_BNODE, F.concat(F.lit("r"), F.md5(F.concat_ws("\u0001", "g", term["v"])))).alias("s"), F.lit(REIFIES).alias("p"), term.alias("o"))
    return quads.select(COLUMNS).unionByName(links).distinct()


def remove_reification(quads: DataFrame, reifier, term: TripleTerm | None = None) -> DataFrame:
    """Without the link to a triple term, or all links of the reifier; what else is said of it stays."""
    link = (F.col("p") == REIFIES) & same_term(F.col("s"), boxed_constant(reifier))
    if term is not None:
        link = link & same_term(F.col("o"), boxed_constant(term))
    return quads.select(COLUMNS).where(~link)


def reifiers(quads: DataFrame, term: TripleTerm | None = None, predicate=None, object=None) -> DataFrame:
    """(reifier) that reify a term and have a triple with the predicate and object, each if given."""
    links = quads.where(F.col("p") == REIFIES)
    if term is not None:
        links = links.where(same_term(F.col("o"), boxed_constant(term)))
    out = links.select(F.col("s").alias("reifier")).distinct()
    if predicate is None and object is None:
        return out
    said = quads
    if predicate is not None:
        said = said.where(F.col("p") == predicate.v)
    if object is not None:
        said = said.where(same_term(F.col("o"), boxed_constant(object)))
    return out.join(said.select(F.col("s").alias("reifier")), "reifier", "left_semi")


def reifications(quads: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """(term) of the distinct triple terms with a reifier that match the pattern."""
    return quads.where((F.col("p") == REIFIES) & _matches(F.col("o"), s, p, o)).select(F.col("o").alias("term")).distinct()


def reified_triples(quads: DataFrame, reifier) -> DataFrame:
    """(term) that a reifier reifies."""
    links = quads.where((F.col("p") == REIFIES) & same_term(F.col("s"), boxed_constant(reifier)) & (F.col("o")["k"] == K_TRIPLE))
    return links.select(F.col("o").alias("term")).distinct()


def triple_terms(quads: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """(term) of the distinct triple terms that are objects, reified or not, and match the pattern."""
    return quads.where(_matches(F.col("o"), s, p, o)).select(F.col("o").alias("term")).distinct()


def has_triple_term(quads: DataFrame, s, p, o) -> bool:
    return not triple_terms(quads, s, p, o).isEmpty()


def parts(terms: DataFrame) -> DataFrame:
    """(term, s, p, o) of triple terms; p is an IRI."""
    of = lambda i: triple_part(F.col("term"), i)
    return terms.select("term", of(0).alias("s"), of(1)["v"].alias("p"), of(2).alias("o"))


__all__ = ["add_reification", "has_triple_term", "parts", "reifications", "reified_triples", "reifiers", "reify", "remove_reification", "term_column", "triple_terms"]
