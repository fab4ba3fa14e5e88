"""RDF, RDFS and OWL 2 RL entailment by materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import K_BNODE, K_IRI, struct
from quadloom.operators.closure import closure
from quadloom.plans.durable import durable
from quadloom.sparql.ast import OWL, RDF, RDFS

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"


def _pairs(triples: DataFrame, p: str) -> DataFrame:
    """(s, o) IRIs of a schema relation."""
    return triples.where((F.col("p") == p) & (F.col("s")["k"] == K_IRI) & (F.col("o")["k"] == K_IRI)).select(F.col("s")["v"].alias("s"), F.col("o")["v"].alias("o")).distinct()


def rdfs_closure(triples: DataFrame) -> DataFrame:
    """(s, p, o) with everything the RDFS rules for properties, classes, domains and ranges derive.

    The schema relations are closed first; then one pass over the data derives by joins with them
    (superproperties, then domains and ranges, then superclasses), so no loop runs over the data.
    """
    triples = triples.select("s", "p", "o").distinct()
    up_property = durable(closure(_pairs(triples, SUBPROPERTY)), "subproperty")
    up_class = durable(closure(_pairs(triples, SUBCLASS)), "subclass")
    data = triples.join(up_property.select(F.col("s").alias("p"), F.col("o").alias("q")), "p").select("s", F.col("q").alias("p"), "o")
    every = triples.unionByName(data)
    node = F.col("o")["k"].isin(K_IRI, K_BNODE)
    domain = every.join(_pairs(triples, DOMAIN).select(F.col("s").alias("p"), F.col("o").alias("c")), "p").select("s", F.col("c"))
    range_ = every.where(node).join(_pairs(triples, RANGE).select(F.col("s").alias("p"), F.col("o").alias("c")), "p").select(F.col("o").alias("s"), F.col("c"))
    stated = every.where((F.col("p") == TYPE) & (F.col("o")["k"] == K_IRI)).select("s", F.col("o")["v"].alias("c"))
    types = stated.unionByName(domain).unionByName(range_).distinct()
    above = types.join(up_class.select(F.col("s").alias("c"), F.col("o").alias("d")), "c").select("s", F.col("d").alias("c"))
    typed = types.unionByName(above).select("s", F.lit(TYPE).alias("p"), struct(K_IRI, F.col("c")).alias("o"))
    schema = up_property.select(struct(K_IRI, F.col("s")).alias("s"), F.lit(SUBPROPERTY).alias("p"), struct(K_IRI, F.col("o")).alias("o")).unionByName(up_class.select(struct(K_IRI, F.col("s")).alias("s"), F.lit(SUBCLASS).alias("p"), struct(K_IRI, F.col("o")).alias("o")))
    return every.unionByName(typed).unionByName(schema).distinct()


def rdf_closure(triples: DataFrame) -> DataFrame:
    """Every predicate is an rdf:Property."""
    properties = triples.select("p").distinct().select(struct(K_IRI, F.col("p")).alias("s"), F.lit(TYPE).alias("p"), struct(K_IRI, RDF + "Property").alias("o"))
    return triples.select("s", "p", "o").unionByName(properties).distinct()


def owl_rl_closure(triples: DataFrame, rounds: int = 64) -> DataFrame:
    """The OWL 2 RL rules on properties and equality of classes and properties, with RDFS, to a fixpoint.

    Covered: symmetric, transitive, inverse, equivalent property, equivalent class, sameAs (symmetric,
    transitive, replacement), functional and inverse functional properties. Class expressions are not.
    """
    now = durable(rdfs_closure(triples), "owl")
    size = now.count()
    for _ in range(rounds):
        is_a = lambda kind: now.where((F.col("p") == TYPE) & (F.col("o")["v"] == OWL + kind)).select(F.col("s")["v"].alias("p")).distinct()
        resource = now.where(F.col("o")["k"].isin(K_IRI, K_BNODE))
        flip = lambda df: df.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
        made = [flip(resource.join(is_a("SymmetricProperty"), "p"))]
        inverse = _pairs(now, OWL + "inverseOf")
        for a, b in (("s", "o"), ("o", "s")):
            made.append(flip(resource.join(inverse.select(F.col(a).alias("p"), F.col(b).alias("q")), "p").select("s", F.col("q").alias("p"), "o")))
        for same, below in (("equivalentClass", SUBCLASS), ("equivalentProperty", SUBPROPERTY)):
            e = _pairs(now, OWL + same)
            for a, b in (("s", "o"), ("o", "s")):
                made.append(e.select(struct(K_IRI, F.col(a)).alias("s"), F.lit(below).alias("p"), struct(K_IRI, F.col(b)).alias("o")))
        chain = resource.join(is_a("TransitiveProperty").unionByName(now.sparkSession.createDataFrame([(OWL + "sameAs",)], "p string")), "p")
        made.append(chain.alias("a").join(chain.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.s"))).select("a.s", "a.p", "b.o"))
        for kind, key, other in (("FunctionalProperty", "s", "o"), ("InverseFunctionalProperty", "o", "s")):
            own = resource.join(is_a(kind), "p")
            least = own.groupBy("p", key).agg(F.min(other).alias("m"))
            made.append(own.join(least, ["p", key]).where(F.col(other) != F.col("m")).select(F.col(other).alias("s"), F.lit(OWL + "sameAs").alias("p"), F.col("m").alias("o")))
        same = resource.where(F.col("p") == OWL + "sameAs").select("s", "o")
        made.append(flip(resource.where(F.col("p") == OWL + "sameAs")))
        eq = same.select(F.col("s").alias("x"), F.col("o").alias("y"))
        made.append(now.join(eq, F.col("s") == F.col("x")).select(F.col("y").alias("s"), "p", "o"))
        made.append(now.join(eq, F.col("o") == F.col("x")).select("s", "p", F.col("y").alias("o")))
        more = now
        for df in made:
            more = more.unionByName(df.select("s", "p", "o"))
        now = durable(rdfs_closure(durable(more.distinct(), "owl-round")), "owl")
        after = now.count()
        if after == size:
            return now
        size = after
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
