"""Set operations between graphs of quads, and graph utilities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.terms import DIR_STRING, K_BNODE, K_IRI, K_LITERAL, K_TRIPLE, LANG_STRING, nt_text, struct, triple_part, triple_text
from quadloom.operators.closure import closure
from quadloom.plans.durable import durable
from quadloom.sparql.ast import RDF

COLUMNS = ["g", "s", "p", "o"]
REIFIES = RDF + "reifies"


def graph_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(COLUMNS).unionByName(b.select(COLUMNS)).distinct()


def graph_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(COLUMNS).intersect(b.select(COLUMNS))


def graph_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(COLUMNS).subtract(b.select(COLUMNS))


def graph_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One pass over both: the quads that only one of them has."""
    tagged = a.select(*COLUMNS, F.lit(1).alias("w")).unionByName(b.select(*COLUMNS, F.lit(2).alias("w")))
    return tagged.groupBy(*COLUMNS).agg(F.min("w").alias("low"), F.max("w").alias("high")).where("low = high").select(COLUMNS)


def same_ground(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs without blank nodes are equal."""
    return graph_symmetric_difference(a, b).isEmpty()


def digest(quads: DataFrame) -> str:
    """SHA-256 of the sorted digests of the lines of a graph without blank nodes, as an order-free sum of parts."""
    from quadloom.sources.ntriples import lines

    parts = lines(quads).distinct().select(F.sha2("value", 256).alias("h"))
    sums = parts.agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)])
    return sums.select(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit(0)).cast("string") for c in sums.columns]), 256)).first()[0]


def skolemised(quads: DataFrame, prefix: str) -> DataFrame:
    """Blank nodes as IRIs under a prefix, also inside triple terms."""
    node = lambda c: F.when(F.col(c)["k"] == K_BNODE, struct(K_IRI, F.concat(F.lit(prefix), F.col(c)["v"]))).when(F.col(c)["k"] == K_TRIPLE, struct(K_TRIPLE, F.regexp_replace(F.col(c)["v"], r"(?<=[ (])_:(\S+)", f"<{prefix}$1>"))).otherwise(F.col(c))
    return quads.select("g", node("s").alias("s"), "p", node("o").alias("o"))


def deskolemised(quads: DataFrame, prefix: str) -> DataFrame:
    node = lambda c: F.when((F.col(c)["k"] == K_IRI) & F.col(c)["v"].startswith(prefix), struct(K_BNODE, F.substr(F.col(c)["v"], F.lit(len(prefix) + 1), F.length(F.col(c)["v"])))).when(F.col(c)["k"] == K_TRIPLE, struct(K_TRIPLE, F.regexp_replace(F.col(c)["v"], r"<\Q" + prefix + r"\E([^>]*)>", "_:$1"))).otherwise(F.col(c))
    return quads.select("g", node("s").alias("s"), "p", node("o").alias("o"))


def list_members(quads: DataFrame) -> DataFrame:
    """(head, position, member) of every RDF list cell reachable from a head that no other cell continues."""
    rest = quads.where(F.col("p") == RDF + "rest").select("s", "o")
    first = quads.where(F.col("p") == RDF + "first").select("s", F.col("o").alias("member"))
    heads = rest.select("s").join(rest.select(F.col("o").alias("s")), "s", "left_anti").distinct()
    reach = closure(rest, heads).unionAll(heads.select("s", F.col("s").alias("o"))).select(F.col("s").alias("head"), F.col("o").alias("s"))
    steps = closure(rest).groupBy("s").agg(F.count("*").alias("left"))
    cells = reach.join(first, "s").join(steps, "s")
    return cells.select("head", (F.max("left").over(Window.partitionBy("head")) - F.col("left")).cast("int").alias("position"), "member")


def reifier_annotations(quads: DataFrame) -> DataFrame:
    """(s, p, o, reifier, ap, ao): what reifiers say about the triples they reify."""
    reified = quads.where(F.col("p") == REIFIES).select("g", F.col("s").alias("reifier"), F.col("o").alias("t"))
    said = quads.where(F.col("p") != REIFIES).select("g", F.col("s").alias("reifier"), F.col("p").alias("ap"), F.col("o").alias("ao"))
    part = lambda i: triple_part(F.col("t"), i)
    return reified.join(said, ["g", "reifier"]).select(part(0).alias("s"), part(1)["v"].alias("p"), part(2).alias("o"), "reifier", "ap", "ao")


#: The vocabulary of the basic encoding (fixed values).
FORM = RDF + "PropositionForm"
FORM_PARTS = (RDF + "propositionFormSubject", RDF + "propositionFormPredicate", RDF + "propositionFormObject")


def to_basic(quads: DataFrame) -> DataFrame:
    """RDF 1.1 quads: each triple term of a graph becomes a blank node, named by a digest, that four triples describe.

    A term inside a term is described in turn, one round for each level of nesting. Quads that use the
    vocabulary beside triple terms are refused, as nothing could tell them from an encoding.
    """
    is_term = F.col("o")["k"] == K_TRIPLE
    if not quads.where(is_term).isEmpty() and not quads.where(F.col("p").isin(*FORM_PARTS) | (F.col("o")["v"] == FORM)).isEmpty():
        raise ValueError("quads with triple terms that use the vocabulary of their encoding")
    node = struct(K_BNODE, F.concat(F.lit("tt"), F.md5(F.concat_ws("\u0001", "g", F.col("o")["v"]))))
    out, work = None, quads.select(COLUMNS)
    while True:
        plain = work.select("g", "s", "p", F.when(is_term, node).otherwise(F.col("o")).alias("o"))
        out = plain if out is None else out.unionByName(plain)
        terms = work.where(is_term).select("g", node.alias("n"), F.col("o").alias("t")).distinct()
        pieces = F.array(F.struct(F.lit(RDF + "type").alias("p"), struct(K_IRI, FORM).alias("o")), *[F.struct(F.lit(p).alias("p"), triple_part(F.col("t"), i).alias("o")) for i, p in enumerate(FORM_PARTS)])
        work = terms.select("g", F.col("n").alias("s"), F.explode(pieces).alias("x")).select("g", "s", "x.p", "x.o")
        if work.isEmpty():
            return out.distinct()


def from_basic(quads: DataFrame) -> DataFrame:
    """The inverse: described blank nodes become triple terms again, innermost first; a node without all its parts is refused."""
    work = quads.select(COLUMNS)
    while True:
        forms = work.where((F.col("p") == RDF + "type") & (F.col("o")["v"] == FORM)).select("g", F.col("s").alias("n"))
        if forms.isEmpty():
            return work.distinct()
        parts = forms
        for i, p in enumerate(FORM_PARTS):
            parts = parts.join(work.where(F.col("p") == p).select("g", F.col("s").alias("n"), F.col("o").alias(f"o{i}")), ["g", "n"])
        inner = forms.select("g", F.col("n").alias("o2"))
        ready = parts.join(inner, ["g", "o2"], "left_anti").select("g", "n", triple_text(F.col("o0"), F.col("o1"), F.col("o2")).alias("t"))
        ready = durable(ready, "forms")
        if ready.isEmpty():
            raise ValueError("a description of a triple term lacks parts or holds itself")
        rest = work.join(ready.select("g", F.col("n").alias("s")), ["g", "s"], "left_anti")
        work = rest.join(ready.select("g", F.col("n").alias("o"), "t"), ["g", "o"], "left").select("g", "s", "p", F.coalesce("t", "o").alias("o"))


#: Datatypes that stand for a language and a direction in RDF 1.1: this, the language, "--" and the direction (fixed value).
DIRECTIONS = "https://www.w3.org/ns/i18n#"


def encode_directions(quads: DataFrame, policy: str = "datatype", space: str = DIRECTIONS) -> DataFrame:
    """Objects without base directions: in the datatype, left out ("drop"), or refused ("error")."""
    if policy not in ("datatype", "error", "drop"):
        raise ValueError(f"no policy {policy}")
    o = F.col("o")
    directed = (o["k"] == K_LITERAL) & (o["dir"] != "")
    if policy == "error" and not quads.where(directed).isEmpty():
        raise ValueError("literals with a base direction have no form in RDF 1.1")
    told = struct(K_LITERAL, o["v"], F.concat(F.lit(space), o["lang"], F.lit("--"), o["dir"])) if policy == "datatype" else struct(K_LITERAL, o["v"], LANG_STRING, o["lang"])
    return quads.select("g", "s", "p", F.when(directed, told).otherwise(o).alias("o"))


def decode_directions(quads: DataFrame, space: str = DIRECTIONS) -> DataFrame:
    """The inverse of encode_directions() with datatypes."""
    o, form = F.col("o"), "^" + re.escape(space) + r"([A-Za-z0-9-]+?)--(ltr|rtl)$"
    told = struct(K_LITERAL, o["v"], DIR_STRING, F.regexp_extract(o["dt"], form, 1), F.regexp_extract(o["dt"], form, 2))
    return quads.select("g", "s", "p", F.when((o["k"] == K_LITERAL) & o["dt"].rlike(form), told).otherwise(o).alias("o"))


def to_rdf11(quads: DataFrame, policy: str = "datatype") -> DataFrame:
    """Without triple terms and base directions, so that any reader of RDF 1.1 takes the quads."""
    return encode_directions(to_basic(quads), policy)


def coloured(quads: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, colour) of blank nodes: digests refined by the colours around them until the number of classes stands.

    Each round is one join and one aggregation; neighbours are hashed one by one and their digests summed, so
    that no node's neighbourhood is collected. Blank nodes inside triple terms are not followed.
    """
    blank = lambda c: F.col(c)["k"] == K_BNODE
    named = lambda c: F.when(blank(c), F.lit("_")).otherwise(nt_text(F.col(c)))
    edges = quads.select("g", "p", F.col("s"), F.col("o")).where(blank("s") | blank("o"))
    one = lambda me, other, way: edges.where(blank(me)).select(F.col(me)["v"].alias("node"), F.when(blank(other), F.col(other)["v"]).alias("next"), F.concat_ws("\u0001", F.lit(way), "g", "p", named(other), (F.col("s") == F.col("o")).cast("string")).alias("label"))
    links = durable(one("s", "o", ">").unionByName(one("o", "s", "<")), "links")
    colours, classes = durable(links.select("node").distinct().withColumn("colour", F.lit("")), "colours"), 1
    for _ in range(rounds):
        seen = links.join(colours.select(F.col("node").alias("next"), F.col("colour").alias("beside")), "next", "left")
        digest_ = F.xxhash64("label", F.coalesce("beside", F.lit(""))).cast("decimal(38,0)")
        again = F.xxhash64(F.coalesce("beside", F.lit("")), "label", F.lit("second")).cast("decimal(38,0)")
        sums = seen.groupBy("node").agg(F.sum(digest_).alias("a"), F.sum(again).alias("b"), F.count("*").alias("n"))
        colours = durable(sums.join(colours, "node").select("node", F.sha2(F.concat_ws("|", "colour", "a", "b", "n"), 256).alias("colour")), "colours")
        now = colours.select("colour").distinct().count()
        if now == classes:
            break
        classes = now
    return colours


def canonical(quads: DataFrame) -> DataFrame:
    """Quads with blank nodes named by their colours. Refused where refinement leaves two blank nodes of one colour: telling such nodes apart is a search, not a pass over data."""
    colours = coloured(quads)
    if not colours.groupBy("colour").count().where("count > 1").isEmpty():
        raise ValueError("blank nodes that refinement cannot tell apart")
    out = quads.select(COLUMNS)
    for c in ("s", "o"):
        name = colours.select(F.col("node").alias("~n"), "colour")
        joined = out.join(name, (F.col(c)["k"] == K_BNODE) & (F.col(c)["v"] == F.col("~n")), "left")
        out = joined.withColumn(c, F.when(F.col("colour").isNotNull(), struct(K_BNODE, F.concat(F.lit("c"), F.col("colour")))).otherwise(F.col(c))).select(COLUMNS)
    return out


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs are equal up to the names of blank nodes; canonical() says what is refused. Graphs whose colours differ are told apart at once."""
    if a.distinct().count() != b.distinct().count():
        return False
    x, y = (coloured(q).groupBy("colour").count() for q in (a, b))
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        return False
    return same_ground(canonical(a.distinct()), canonical(b.distinct()))
