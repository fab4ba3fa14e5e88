"""SHACL Core validation: one DataFrame of violations for each constraint of each shape."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.expressions import java_regex
from quadloom.functions.terms import BOX, BOXED, K_BNODE, K_IRI, K_LITERAL, K_TRIPLE, NATIVE, Kind, Value, box, boxed_constant, constant, equal, less, nt_text, parse_nt, same_term, struct
from quadloom.plans.durable import durable
from quadloom.plans.engine import Engine
from quadloom.plans.solution import Solution, column_name, join, left_join, semi_join, union
from quadloom.sources.graphs import MappedGraph, QuadGraph, bind, quads_frame, term_text
from quadloom.sparql.ast import RDF, RDFS, SH, XSD, Alt, BNode, Inv, IRI, Lit, Mod, Seq, Triple, TripleTerm, Var
from quadloom.sparql.parser import parse_query, parse_turtle


@dataclass
class Shape:
    node: object
    path: object = None
    facts: dict[str, list] = field(default_factory=dict)

    def get(self, name: str) -> list:
        return self.facts.get(SH + name, [])

    def one(self, name: str, default=None):
        return self.get(name)[0] if self.get(name) else default


class Shapes:
    """A shapes graph, held by the driver: it is small by nature."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.facts: dict[object, dict[str, list]] = {}
        self.prefixes = prefixes or {}
        for _, t in parse_turtle(text, {"sh": SH, "xsd": XSD, "rdf": RDF, "rdfs": RDFS} | (prefixes or {})):
            self.facts.setdefault(t.s, {}).setdefault(t.p.v, []).append(t.o)
        self.shapes: dict[object, Shape] = {}

    def shape(self, node) -> Shape:
        if node not in self.shapes:
            facts = self.facts.get(node, {})
            path = facts.get(SH + "path")
            self.shapes[node] = Shape(node, self.path(path[0]) if path else None, facts)
        return self.shapes[node]

    def items(self, head) -> list:
        out, seen = [], set()
        while head != IRI(RDF + "nil"):
            if head in seen or head not in self.facts:
                raise ValueError("an ill-formed list")
            seen.add(head)
            out.append(self.facts[head][RDF + "first"][0])
            head = self.facts[head][RDF + "rest"][0]
        return out

    def path(self, node):
        facts = self.facts.get(node, {})
        if isinstance(node, IRI):
            return node
        if RDF + "first" in facts:
            parts = [self.path(x) for x in self.items(node)]
            out = parts[0]
            for p in parts[1:]:
                out = Seq(out, p)
            return out
        for name, make in (("inversePath", Inv), ("zeroOrMorePath", lambda a: Mod(a, "*")), ("oneOrMorePath", lambda a: Mod(a, "+")), ("zeroOrOnePath", lambda a: Mod(a, "?"))):
            if SH + name in facts:
                return make(self.path(facts[SH + name][0]))
        if SH + "alternativePath" in facts:
            parts = [self.path(x) for x in self.items(facts[SH + "alternativePath"][0])]
            out = parts[0]
            for p in parts[1:]:
                out = Alt(out, p)
            return out
        raise ValueError(f"no path at {node}")

    def targeted(self) -> list[Shape]:
        names = [SH + n for n in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "targetWhere")]
        implicit = lambda f: IRI(RDFS + "Class") in f.get(RDF + "type", []) and any(t in f.get(RDF + "type", []) for t in (IRI(SH + "NodeShape"), IRI(SH + "PropertyShape")))
        return [self.shape(n) for n, f in list(self.facts.items()) if any(x in f for x in names) or implicit(f)]


    def declared(self) -> dict[str, str]:
        """Prefixes that sh:declare gives to embedded queries."""
        out = {}
        for facts in self.facts.values():
            if SH + "namespace" in facts and SH + "prefix" in facts:
                out[facts[SH + "prefix"][0].v] = facts[SH + "namespace"][0].v
        return self.prefixes | out

    def references(self, node) -> set:
        """Shapes that a shape's conformance looks at."""
        facts, out = self.facts.get(node, {}), set()
        for name in ("property", "node", "not", "someValue", "qualifiedValueShape", "memberShape", "reifierShape"):
            out |= set(facts.get(SH + name, []))
        for name in ("and", "or", "xone"):
            for head in facts.get(SH + name, []):
                out |= set(self.items(head))
        return out

    def on_cycle(self, node) -> set:
        """The shapes on a cycle of references through this one; empty if there is none."""
        reach, work = {}, [node]
        while work:
            at = work.pop()
            if at not in reach:
                reach[at] = self.references(at)
                work += reach[at]
        back = {n for n in reach if node in reach[n]}
        while True:
            more = {n for n in reach if reach[n] & back} - back
            if not more:
                return back
            back |= more

    def components(self) -> list[tuple[IRI, list[tuple[str, str, bool]]]]:
        """Declared constraint components: their IRI and parameters (predicate, name, whether optional)."""
        out = []
        for node, facts in self.facts.items():
            if SH + "parameter" in facts and isinstance(node, IRI):
                told = []
                for p in facts[SH + "parameter"]:
                    path = self.facts[p][SH + "path"][0].v
                    told.append((path, re.split("[#/]", path)[-1], self.facts[p].get(SH + "optional", [Lit("false")])[0].v == "true"))
                if all(optional for *_, optional in told):
                    raise ValueError(f"{node.v}: a component needs a parameter that is not optional")
                out.append((node, told))
        return out


def path_text(p) -> str:
    if isinstance(p, IRI):
        return f"<{p.v}>"
    if isinstance(p, Inv):
        return f"^{path_text(p.a)}"
    if isinstance(p, Mod):
        return f"({path_text(p.a)}){p.kind}"
    return f"({path_text(p.a)}{'/' if isinstance(p, Seq) else '|'}{path_text(p.b)})"


Found = list[tuple[str, Solution]]
#: The column that holds the numbers (see _at) of the violated components, where one pass finds those of several.
EACH = "~component"
#: The column that tells a violation's value apart without its text, made before any join moves the row.
DIGEST = "~digest"


class Validator:
    """violations(): focus, path, value, component, shape, severity as N-Triples text or IRIs; value is null for counts."""

    def __init__(self, engine: Engine, shapes: Shapes):
        self.engine, self.shapes, self.open = engine, shapes, []
        self.assumed: dict[object, Solution] = {}
        self.links: list[Shape] | None = None
        self.long, self.reported = False, []
        self.told: dict[tuple, int] = {}

    def violations(self) -> DataFrame:
        parts = []
        for shape in dict.fromkeys(s.node for s in self.shapes.targeted() + self.linked()):
            shape = self.shapes.shape(shape)
            if shape.one("deactivated") == Lit("true", XSD + "boolean"):
                continue
            parts += self.report(shape, self.targets(shape), self._only_class(shape))
        columns = ("focus", "path", "value", "component", "shape", "severity")
        if not parts:
            return self.engine.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # a shape that is reached twice may find a violation twice
        twice = len(set(self.reported)) < len(self.reported)
        out = out.withColumn("at", F.explode("at")) if twice else out
        if self.long:
            # values that may be whole texts are told apart by digests; where nothing reads them they are not moved at all
            out = out.groupBy("focus", "at", "digest").agg(F.max("value").alias("value"))
        else:
            out = out.select("focus", "at", "value").distinct()
        out = out if twice else out.withColumn("at", F.explode("at"))
        told = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("path", "component", "shape", "severity"), row, strict=True)]) for row in self.told])
        return out.withColumn("at", F.get(told, F.col("at"))).select("focus", "at.path", "value", "at.component", "at.shape", "at.severity")

    def linked(self) -> list[Shape]:
        """Shapes that nodes of the data name by sh:shape; a shapes graph holds few, so their names fit the driver."""
        if not isinstance(self.engine.graph, QuadGraph):
            return []
        if self.links is not None:
            return self.links
        links = self.engine.graph.scan([Triple(Var("focus"), IRI(SH + "shape"), Var("shape"))])
        names = [r[0] for r in links.df.where(box(links.value("shape"))["v"].isin(*[n.v for n in self.shapes.facts if isinstance(n, IRI)])).select(box(links.value("shape"))["v"]).distinct().collect()]
        self.links = [self.shapes.shape(IRI(n)) for n in sorted(names)]
        return self.links

    def report(self, shape: Shape, focus: Solution, of: IRI | None = None) -> list[DataFrame]:
        """Rows for the shape's own constraints and those of its property shapes: focus, value, numbers of what they violate.

        of: the class whose members the focus nodes are, if they are all of them and no other node.
        """
        self.reported.append(shape.node)
        out = []
        values = self.values(shape, focus, of)
        for component, s in self.constraints(shape, focus, values, of):
            text = lambda n, s=s: nt_text(box(s.value(n))) if n in s.kinds else F.lit(None).cast("string")
            digest = s.value(DIGEST).col if DIGEST in s.kinds else _digest(text("value"))
            self.long = self.long or "value" in s.kinds and s.kinds["value"].name in ("string", "box")
            at = s.value(EACH).col if EACH in s.kinds else F.array(F.lit(self._at(shape, component)))
            out.append(s.df.select(text("focus").alias("focus"), text("value").alias("value"), at.alias("at"), digest.alias("digest")))
        for node in shape.get("property"):
            inner = self.shapes.shape(node)
            if inner.one("deactivated") != Lit("true", XSD + "boolean"):
                out += self.report(inner, self._as_focus(values), of if shape.path is None else None)
        return out

    def _at(self, shape: Shape, component: str) -> int:
        """The number that stands for path, component, shape and severity in rows on their way."""
        name = shape.node.v if isinstance(shape.node, IRI) else f"_:{shape.node.v}"
        row = (path_text(shape.path) if shape.path else None, component if ":" in component else SH + component, name, shape.one("severity", IRI(SH + "Violation")).v)
        return self.told.setdefault(row, len(self.told))

    # targets and values
    def _focus(self, s: Solution, name: str) -> Solution:
        return s.select({"focus": s.value(name)}, {"focus"}).distinct()

    def _as_focus(self, values: Solution) -> Solution:
        return values.select({"focus": values.value("value")}, {"focus"}).distinct()

    def instances(self, c: IRI) -> Solution:
        """Members of a class or, in a quad graph, of its subclasses."""
        graph = self.engine.graph
        if isinstance(graph, QuadGraph):
            pairs = self.engine._path(Seq(IRI(RDF + "type"), Mod(IRI(RDFS + "subClassOf"), "*")), None)
            return bind(pairs.df, [(Var("focus"), pairs.value("s")), (c, pairs.value("o"))]).distinct()
        return self._focus(graph.scan([Triple(Var("s"), IRI(RDF + "type"), c)]), "s")

    def targets(self, shape: Shape) -> Solution:
        parts = [self.instances(c) for c in shape.get("targetClass")]
        if IRI(RDFS + "Class") in shape.facts.get(RDF + "type", []):
            parts.append(self.instances(shape.node))
        for p in shape.get("targetSubjectsOf"):
            parts.append(self._focus(self.engine.graph.scan([Triple(Var("s"), p, Var("o"))]), "s"))
        for p in shape.get("targetObjectsOf"):
            parts.append(self._focus(self.engine.graph.scan([Triple(Var("s"), p, Var("o"))]), "o"))
        for n in shape.get("targetNode"):
            parts.append(Solution(self.engine.spark.range(1).select(boxed_constant(n).alias("focus")), {"focus": BOXED}, {"focus"}))
        for node in shape.get("targetWhere"):
            every = self._every_node()
            parts.append(semi_join(every, self.failing(node, every), True))
        if shape.node in [s.node for s in self.linked()]:
            parts.append(self.engine.graph.scan([Triple(Var("focus"), IRI(SH + "shape"), shape.node)]))
        return parts[0] if len(parts) == 1 else union(parts).distinct()

    def _only_class(self, shape: Shape) -> IRI | None:
        """The class of a shape that has no other targets, where classes are mapped."""
        other = any(shape.get(n) for n in ("targetSubjectsOf", "targetObjectsOf", "targetNode", "targetWhere")) or IRI(RDFS + "Class") in shape.facts.get(RDF + "type", [])
        classes = shape.get("targetClass")
        return classes[0] if isinstance(self.engine.graph, MappedGraph) and len(classes) == 1 and not other else None

    def _star(self, path, of: IRI | None) -> Solution | None:
        """(focus, value) of a class's members and a predicate where both are of one table, so that one scan has them without a join."""
        if of is None or not isinstance(path, IRI):
            return None
        stars = self.engine.graph.stars([Triple(Var("focus"), IRI(RDF + "type"), of), Triple(Var("focus"), path, Var("value"))])
        return self.engine.graph.scan(stars[0]).keep(["focus", "value"]) if len(stars) == 1 else None

    def _every_node(self) -> Solution:
        nodes = self.engine.graph.nodes()
        return self._focus(nodes, "node")

    def values(self, shape: Shape, focus: Solution, of: IRI | None = None) -> Solution:
        """(focus, value) pairs as a set; a node shape's value is the focus itself."""
        if shape.path is None:
            return focus.select({"focus": focus.value("focus"), "value": focus.value("focus")}, {"focus", "value"})
        star = self._star(shape.path, of)
        found = self._pairs(shape.path, focus, "value") if star is None else star.distinct()
        if not shape.get("values") and not shape.get("defaultValue"):
            return found
        from quadloom.operators.node_expressions import values_of

        computed = lambda expr, nodes: Solution(values_of(self, expr, nodes).select("focus", F.col("node").alias("value")), {"focus": BOXED, "value": BOXED}, {"focus", "value"})
        parts = [found] + [computed(x, focus) for x in shape.get("values")]
        found = union(parts).distinct()
        without = semi_join(focus, found.keep(["focus"]), True)
        return union([found] + [computed(x, without) for x in shape.get("defaultValue")]).distinct()

    def _pairs(self, path, focus: Solution, name: str) -> Solution:
        return join(focus, self._read(path, name)).keep(["focus", name]).distinct()

    def _read(self, path, name: str) -> Solution:
        pairs = self.engine._path(path, None)
        return pairs.select({"focus": pairs.value("s"), name: pairs.value("o")}, {"focus", name})

    # conformance of values to other shapes
    def failing(self, node, nodes: Solution) -> Solution:
        """Those of the nodes (focus) that do not conform to a shape."""
        if node in self.assumed:
            return semi_join(nodes, self.assumed[node], False)
        if node not in self.open and self.shapes.on_cycle(node):
            return self._recursive(node, nodes)
        self.open.append(node)
        try:
            return self._failing_once(self.shapes.shape(node), nodes)
        finally:
            self.open.pop()

    def _failing_once(self, shape: Shape, nodes: Solution) -> Solution:
        if shape.one("deactivated") == Lit("true", XSD + "boolean"):
            return nodes.where(F.lit(False))
        values = self.values(shape, nodes)
        parts = [self._focus(s, "focus") for _, s in self.constraints(shape, nodes, values)]
        for p in shape.get("property"):
            bad = self.failing(p, self._as_focus(values))
            bad = bad.select({"value": bad.value("focus")}, {"value"})
            parts.append(self._focus(semi_join(values, bad, False), "focus"))
        return union(parts).distinct() if parts else nodes.where(F.lit(False))

    def _recursive(self, node, nodes: Solution) -> Solution:
        """Failures of a recursive shape: at first all nodes conform, then failures spread until none is new.

        Each round is a table. The result is the largest set of conforming nodes, which a cycle through
        sh:not, sh:xone or an upper bound on qualified values need not have, so that such a cycle is refused.
        """
        for n in self.shapes.on_cycle(node):
            if any(SH + x in self.shapes.facts.get(n, {}) for x in ("not", "xone", "qualifiedMaxCount")):
                raise ValueError(f"{node} is recursive through a negation")
        every = union([self._every_node(), nodes]).distinct().boxed({"focus"})
        every = Solution(durable(every.df, "nodes"), every.kinds, every.certain)
        known, bad, outer = -1, every.where(F.lit(False)), self.assumed
        try:
            while True:
                self.assumed = outer | {node: bad}
                found = self._failing_once(self.shapes.shape(node), every)
                bad = Solution(durable(found.boxed({"focus"}).df, "failing"), {"focus": BOXED}, {"focus"})
                n = bad.df.count()
                if n == known:
                    return semi_join(nodes, bad, False)
                known = n
        finally:
            self.assumed = outer

    def _bad_values(self, node, values: Solution) -> Solution:
        bad = self.failing(node, self._as_focus(values))
        return bad.select({"value": bad.value("focus")}, {"value"})

    # constraints
    def constraints(self, shape: Shape, focus: Solution, values: Solution, of: IRI | None = None) -> Found:
        """The violations of each component; those of single values may repeat."""
        out: Found = []
        # of one predicate, single values are judged as they are read, so that only violations meet the focus nodes
        star = read = None
        if isinstance(shape.path, IRI) and not shape.get("values") and not shape.get("defaultValue"):
            star = self._star(shape.path, of)
            read = star or self._read(shape.path, "value")
        value = (read or values).value("value")

        singles: list[tuple[str, Column]] = []
        bounds: list[tuple[str, Callable[[Column], Column]]] = []

        def each(component: str, bad: Column) -> None:
            singles.append((component, F.coalesce(bad, F.lit(True))))

        def whole(component: str, s: Solution) -> None:
            out.append((component + "ConstraintComponent", s))

        for c in shape.get("class"):
            inst = self.instances(c)
            whole("Class", semi_join(values, inst.select({"value": inst.value("focus")}, {"value"}), True))
        for d in shape.get("datatype"):
            each("Datatype", ~self._has_datatype(value, d.v))
        for k in shape.get("nodeKind"):
            each("NodeKind", ~self._node_kind(value, k.v.removeprefix(SH)))
        for name, good in (("minInclusive", lambda v, l: less(l, v) | equal(l, v)), ("minExclusive", lambda v, l: less(l, v)), ("maxInclusive", lambda v, l: less(v, l) | equal(v, l)), ("maxExclusive", lambda v, l: less(v, l))):
            for limit in shape.get(name):
                each(name[0].upper() + name[1:], ~good(value, constant(limit)))
        text = value.col["v"] if value.kind == BOXED else self._lexical(value)
        unwritten = value.col["k"].isin(K_BNODE, K_TRIPLE) if value.kind == BOXED else F.lit(False)
        for n in shape.get("minLength"):
            each("MinLength", unwritten | (F.length(text) < int(n.v)))
        for n in shape.get("maxLength"):
            each("MaxLength", unwritten | (F.length(text) > int(n.v)))
        for p in shape.get("pattern"):
            each("Pattern", unwritten | ~text.rlike(java_regex(shape.one("flags", Lit("")).v, p.v)))
        for line in shape.get("singleLine"):
            if line.v == "true":
                each("SingleLine", text.rlike(r"[\r\n]"))
        for head in shape.get("in"):
            options = self.shapes.items(head)
            each("In", ~self._any_of(value, options))
        for head in shape.get("languageIn"):
            tag = F.lower(box(value)["lang"])
            good = F.lit(False)
            for l in self.shapes.items(head):
                good = good | (tag == l.v.lower()) | tag.startswith(l.v.lower() + "-")
            each("LanguageIn", ~good)
        if singles and read is not None:
            marked = self._marked(shape, read, singles)
            marked = marked.select(marked.values() | {DIGEST: Value(_digest(nt_text(box(marked.value("value")))), Kind("string"))}, marked.certain)
            out.append(("", marked if star is not None else join(focus, marked)))
        elif singles:
            out.append(("", self._marked(shape, values, singles)))
        value = values.value("value")
        for n in shape.get("minCount"):
            if int(n.v) > 0:
                bounds.append(("MinCount", lambda c, k=int(n.v): c < k))
        for n in shape.get("maxCount"):
            bounds.append(("MaxCount", lambda c, k=int(n.v): c > k))
        if bounds:
            counted = self._counts(focus, values)
            n = F.coalesce(counted.value("n").col, F.lit(0))
            out.append(("", self._marked(shape, counted, [(name, wrong(n)) for name, wrong in bounds]).keep(["focus", EACH])))
        for v in shape.get("hasValue"):
            have = values.where(self._any_of(value, [v]))
            whole("HasValue", semi_join(focus, have.keep(["focus"]), True))
        for u in shape.get("uniqueLang"):
            if u.v == "true":
                tagged = values.where(box(value)["lang"] != "")
                key = F.lower(box(tagged.value("value"))["lang"])
                df = tagged.df.groupBy(tagged.value("focus").col.alias("focus"), key.alias("lang"), box(tagged.value("value"))["dir"].alias("dir")).count().where("count > 1").select("focus").distinct()
                whole("UniqueLang", Solution(df, {"focus": values.kinds["focus"]}, {"focus"}))
        for p in shape.get("equals"):
            other = self._pairs(p, focus, "value")
            whole("Equals", union([semi_join(values, other, True), semi_join(other, values, True)]))
        for p in shape.get("disjoint"):
            whole("Disjoint", semi_join(values, self._pairs(p, focus, "value"), False))
        for p in shape.get("subsetOf"):
            whole("SubsetOf", semi_join(values, self._pairs(p, focus, "value"), True))
        for name, good in (("lessThan", less), ("lessThanOrEquals", lambda a, b: less(a, b) | equal(a, b))):
            for p in shape.get(name):
                both = join(values, self._pairs(p, focus, "other"))
                whole(name[0].upper() + name[1:], both.where(F.coalesce(~good(both.value("value"), both.value("other")), F.lit(True))).keep(["focus", "value"]))
        for node in shape.get("node"):
            whole("Node", semi_join(values, self._bad_values(node, values), False))
        for node in shape.get("someValue"):
            whole("SomeValue", semi_join(focus, semi_join(values, self._bad_values(node, values), True).keep(["focus"]), True))
        for node in shape.get("not"):
            whole("Not", semi_join(values, self._bad_values(node, values), True))
        for head in shape.get("and"):
            bad = union([self._bad_values(n, values) for n in self.shapes.items(head)]).distinct()
            whole("And", semi_join(values, bad, False))
        for name, wrong in (("or", lambda failed, n: failed == n), ("xone", lambda failed, n: failed != n - 1)):
            for head in shape.get(name):
                nodes = self.shapes.items(head)
                whole(name.capitalize(), self._by_failures(values, nodes, lambda failed, n=len(nodes), wrong=wrong: wrong(failed, n)))
        for node in shape.get("qualifiedValueShape"):
            good = semi_join(values, self._bad_values(node, values), True)
            if shape.one("qualifiedValueShapesDisjoint") == Lit("true", XSD + "boolean"):
                for other in self._siblings(shape, node):
                    good = semi_join(good, self._bad_values(other, good), False)
            for n in shape.get("qualifiedMinCount"):
                if int(n.v) > 0:
                    whole("QualifiedMinCount", self._counted(focus, good, lambda c, k=int(n.v): c < k))
            for n in shape.get("qualifiedMaxCount"):
                whole("QualifiedMaxCount", self._counted(focus, good, lambda c, k=int(n.v): c > k))
        if shape.one("closed") == IRI(SH + "ByTypes"):
            whole("Closed", self._closed_by_types(shape, values))
        if shape.one("closed") == Lit("true", XSD + "boolean"):
            allowed = [self.shapes.shape(p).path for p in shape.get("property")] + [x for h in shape.get("ignoredProperties") for x in self.shapes.items(h)]
            every = self.engine.graph.scan([Triple(Var("focus"), Var("p"), Var("value"))])
            others = every.where(~self._lexical(every.value("p")).isin(*[a.v for a in allowed if isinstance(a, IRI)]))
            whole("Closed", join(focus, others.keep(["focus", "value"])))
        for c in shape.get("rootClass"):
            pairs = self.engine._path(Mod(IRI(RDFS + "subClassOf"), "*"), None)
            below = bind(pairs.df, [(Var("value"), pairs.value("s")), (c, pairs.value("o"))])
            same = values.where(self._any_of(value, [c])).keep(["value"])
            whole("RootClass", semi_join(values, union([below, same]), True))
        if any(shape.get(n) for n in ("minListLength", "maxListLength", "uniqueMembers", "memberShape")):
            out += self._list_constraints(shape, values)
        for expr in shape.get("expression"):
            from quadloom.operators.node_expressions import values_of

            nodes = values_of(self, expr, self._as_focus(values))
            node = F.col("node")
            good = nodes.groupBy("focus").agg(F.count("*").alias("n"), F.min((node["v"] == "true") & (node["dt"] == XSD + "boolean")).alias("yes")).where("n = 1 and yes").select(F.col("focus").alias("value"))
            whole("Expression", semi_join(values, Solution(good, {"value": BOXED}, {"value"}), True))
        for expr in shape.get("nodeByExpression"):
            from quadloom.operators.node_expressions import values_of

            # the shapes that the expression gives for each value; a shapes graph holds few, so their names fit the driver
            told = durable(values_of(self, expr, self._as_focus(values)).select(F.col("focus").alias("value"), F.col("node")["v"].alias("shape")), "shapes-of")
            for (name,) in told.select("shape").distinct().collect():
                mine = semi_join(values, Solution(told.where(F.col("shape") == name).select("value"), {"value": BOXED}, {"value"}), False)
                whole("NodeByExpression", semi_join(mine, self._bad_values(IRI(name), mine), False))
        for node in shape.get("reifierShape"):
            reifiers = self._reifiers(shape, values)
            bad = self.failing(node, self._focus(reifiers, "reifier"))
            bad = bad.select({"reifier": bad.value("focus")}, {"reifier"})
            whole("ReifierShape", semi_join(reifiers, bad, False).keep(["focus", "value"]))
        if shape.one("reificationRequired") == Lit("true", XSD + "boolean"):
            whole("ReificationRequired", semi_join(values, self._reifiers(shape, values).keep(["focus", "value"]), True))
        for head in shape.get("uniqueValuesFor"):
            whole("UniqueValuesFor", self._unique_values(focus, self.shapes.items(head)))
        for node in shape.get("sparql"):
            found = self._selected(node, shape, focus, {})
            whole("SPARQL", found)
        for component, parameters in self.shapes.components():
            if all(optional or p in shape.facts for p, _, optional in parameters):
                for bad in self._declared(component, parameters, shape, focus, values):
                    out.append((component.v, bad))
        return out

    def _siblings(self, shape: Shape, node) -> set:
        """Qualified value shapes of the other property shapes beside this one."""
        out = set()
        for facts in self.shapes.facts.values():
            beside = facts.get(SH + "property", [])
            if shape.node in beside:
                out |= {q for p in beside for q in self.shapes.facts.get(p, {}).get(SH + "qualifiedValueShape", [])}
        return out - {node}

    def _closed_by_types(self, shape: Shape, values: Solution) -> Solution:
        """Triples of the values whose predicate none of the value's types declares; the (type, predicate) table is small."""
        ignored = {RDF + "type"} | {x.v for h in shape.get("ignoredProperties") for x in self.shapes.items(h)}
        types = {o for f in self.shapes.facts.values() for o in f.get(SH + "targetClass", [])} | {n for n, f in self.shapes.facts.items() if RDFS + "subClassOf" in f or RDF + "type" in f}
        pairs = [(c, p) for c in types if isinstance(c, IRI) for p in self._properties_of(c, set())]
        graph, spark = self.engine.graph, self.engine.spark
        every = graph.scan([Triple(Var("value"), Var("p"), Var("o"))])
        mine = join(values, every.where(~self._lexical(every.value("p")).isin(*ignored)).boxed({"p"}))
        typed = graph.scan([Triple(Var("value"), IRI(RDF + "type"), Var("c"))]).boxed({"c"})
        told = spark.createDataFrame([(c.v, p) for c, p in pairs], "c string, p string")
        allowed = typed.df.withColumn("~c", typed.value("c").col["v"]).join(told.withColumnRenamed("p", "~p"), F.col("~c") == told["c"]).select(typed.value("value").col.alias("value"), F.col("~p"))
        allowed = Solution(allowed.select("value", boxed_iri(F.col("~p")).alias("p")).distinct(), {"value": typed.kinds["value"], "p": BOXED}, {"value", "p"})
        bad = semi_join(mine, allowed, True)
        return bad.select({"focus": bad.value("focus"), "value": bad.value("o")}, {"focus", "value"})

    def _properties_of(self, node, seen: set) -> set[str]:
        """Predicates that a class or node shape declares, by itself, its superclasses, the shapes that target it and its sh:node."""
        if node in seen:
            return set()
        seen.add(node)
        facts = self.shapes.facts.get(node, {})
        out = {x.v for p in facts.get(SH + "property", []) for x in self.shapes.facts[p].get(SH + "path", []) if isinstance(x, IRI)}
        near = facts.get(RDFS + "subClassOf", []) + facts.get(SH + "node", []) + [n for n, f in self.shapes.facts.items() if node in f.get(SH + "targetClass", [])]
        for n in near:
            out |= self._properties_of(n, seen)
        return out

    def _query(self, text: str, shape: Shape, bound: dict):
        from quadloom.graph import substituted

        return substituted(parse_query(text, self.engine.prefixes | self.shapes.declared()), bound | ({"PATH": shape.path} if shape.path is not None else {}))

    def _selected(self, node, shape: Shape, focus: Solution, bound: dict) -> Solution:
        """(focus, value) rows of a SELECT, run once with all focus nodes as $this."""
        q = self._query(self.shapes.facts[node][SH + "select"][0].v, shape, bound)
        given = focus.select({"this": focus.value("focus")}, {"this"})
        found = self.engine._modified(q, self.engine._group(q.pattern, None, given=given)[0])
        return found.select({"focus": found.value("this")} | ({"value": found.value("value")} if "value" in found.kinds else {}), {"focus"})

    def _declared(self, component: IRI, parameters: list, shape: Shape, focus: Solution, values: Solution) -> list[Solution]:
        """Violations of a declared component, for each choice of its parameters' values; an ASK runs once for all values."""
        own, out = self.shapes.facts[component], []
        validators = own.get(SH + ("propertyValidator" if shape.path is not None else "nodeValidator"), []) + own.get(SH + "validator", [])
        if not validators:
            return out
        facts = self.shapes.facts[validators[0]]
        for choice in product(*[shape.facts.get(p, [None]) for p, _, _ in parameters]):
            bound = {name: v for (_, name, _), v in zip(parameters, choice, strict=True) if v is not None}
            if SH + "select" in facts:
                out.append(self._selected(validators[0], shape, focus, bound))
                continue
            q = self._query(facts[SH + "ask"][0].v, shape, bound)
            given = values.select({"this": values.value("focus"), "value": values.value("value")}, {"this", "value"})
            good = self.engine._group(q.pattern, None, given=given)[0]
            good = good.select({"focus": good.value("this"), "value": good.value("value")}, {"focus", "value"})
            out.append(semi_join(values, good.distinct(), True))
        return out

    def _reifiers(self, shape: Shape, values: Solution) -> Solution:
        """(focus, value, reifier) of the triples that the shape's predicate makes."""
        term = TripleTerm(Var("focus"), shape.path, Var("value"))
        found = self.engine.graph.scan([Triple(Var("reifier"), IRI(RDF + "reifies"), term)])
        return join(values, found)

    def _list_constraints(self, shape: Shape, values: Solution) -> Found:
        """Values that are lists: their length, repeats and members. A value that is no list has no cells and violates."""
        from quadloom.operators.closure import closure

        engine, first, rest = self.engine, IRI(RDF + "first"), IRI(RDF + "rest")
        cells = engine.graph.scan([Triple(Var("s"), rest, Var("o"))])
        reach = closure(cells.df.select(box(cells.value("s")).alias("s"), box(cells.value("o")).alias("o")))
        heads = self._as_focus(values).df.select(box(Value(F.col("focus"), values.kinds["value"])).alias("s"))
        own = reach.join(heads, "s", "left_semi").unionByName(heads.select("s", F.col("s").alias("o"))).distinct()
        members = engine.graph.scan([Triple(Var("c"), first, Var("m"))])
        listed = own.join(members.df.select(box(members.value("c")).alias("o"), box(members.value("m")).alias("m")), "o").select("s", "o", "m")
        n = listed.groupBy("s").agg(F.count("*").alias("n"), F.count_distinct("m").alias("d"))
        nil = heads.where((F.col("s")["k"] == K_IRI) & (F.col("s")["v"] == RDF + "nil")).select("s", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("d"))
        sizes = n.unionByName(nil)
        sizes = join(values, Solution(sizes.select(F.col("s").alias("value"), "n", "d"), {"value": BOXED, "n": Kind("integer"), "d": Kind("integer")}, {"value", "n", "d"}))
        no_list = semi_join(values, sizes.keep(["value"]), True)
        out: Found = []

        def wrong(component: str, condition: Column) -> None:
            out.append((component + "ConstraintComponent", union([sizes.where(condition).keep(["focus", "value"]), no_list])))

        length, distinct = sizes.value("n").col, sizes.value("d").col
        for k in shape.get("minListLength"):
            wrong("MinListLength", length < int(k.v))
        for k in shape.get("maxListLength"):
            wrong("MaxListLength", length > int(k.v))
        if shape.one("uniqueMembers") == Lit("true", XSD + "boolean"):
            wrong("UniqueMembers", distinct < length)
        for node in shape.get("memberShape"):
            bad = self.failing(node, Solution(listed.select(F.col("m").alias("focus")).distinct(), {"focus": BOXED}, {"focus"}))
            hit = listed.join(bad.df.select(box(bad.value("focus")).alias("m")), "m", "left_semi").select(F.col("s").alias("value")).distinct()
            failing = semi_join(values, Solution(hit, {"value": BOXED}, {"value"}), False)
            out.append(("MemberShapeConstraintComponent", union([failing, no_list])))
        return out

    def _lexical(self, v: Value) -> Column:
        from quadloom.functions.terms import lexical

        return lexical(v)

    def _has_datatype(self, v: Value, dt: str) -> Column:
        if v.kind != BOXED:
            return F.lit(v.kind.name != "iri" and XSD + v.kind.name == dt)
        name = dt.removeprefix(XSD)
        well = v.col["v"].try_cast(NATIVE[name]).isNotNull() if dt.startswith(XSD) and name in NATIVE else F.lit(True)
        return (v.col["k"] == K_LITERAL) & (v.col["dt"] == dt) & well

    def _node_kind(self, v: Value, kind: str) -> Column:
        allowed = [k for k, name in ((K_IRI, "IRI"), (K_BNODE, "BlankNode"), (K_LITERAL, "Literal"), (K_TRIPLE, "TripleTerm")) if name in kind]
        if v.kind == BOXED:
            return v.col["k"].isin(*allowed)
        return F.lit((K_IRI if v.kind.name == "iri" else K_LITERAL) in allowed)

    def _any_of(self, v: Value, terms: list) -> Column:
        b, hit = box(v), F.lit(False)
        for t in terms:
            own = constant(t)
            hit = hit | (v.col == own.col if own.kind == v.kind and v.kind != BOXED and not v.kind.prefix else same_term(b, boxed_constant(t)))
        return hit

    def _marked(self, shape: Shape, s: Solution, wrong: list[tuple[str, Column]]) -> Solution:
        """The rows that violate a component, with the numbers of all those, in one pass."""
        numbers = F.array_distinct(F.array_compact(F.array(*[F.when(bad, F.lit(self._at(shape, name + "ConstraintComponent"))) for name, bad in wrong])))
        kept = s.select(s.values() | {EACH: Value(numbers, Kind("integer"))}, s.certain | {EACH})
        return kept.where(F.size(kept.value(EACH).col) > 0)

    def _counted(self, focus: Solution, values: Solution, wrong: Callable[[Column], Column]) -> Solution:
        """Focus nodes whose number of values, none included, is wrong."""
        both = self._counts(focus, values)
        return both.where(wrong(F.coalesce(both.value("n").col, F.lit(0)))).keep(["focus"])

    def _counts(self, focus: Solution, values: Solution) -> Solution:
        """Focus nodes with their number of values, unbound where there is none."""
        n = values.df.groupBy(values.value("focus").col).agg(F.count("*").alias("n"))
        return left_join(focus, Solution(n, {"focus": values.kinds["focus"], "n": Kind("integer")}, {"focus", "n"}))

    def _by_failures(self, values: Solution, nodes: list, wrong: Callable[[Column], Column]) -> Solution:
        """Values by how many of the shapes they fail; each failure is one row, counted before it is joined."""
        bad = union([self._bad_values(n, values).distinct() for n in nodes])
        n = bad.df.groupBy(bad.value("value").col).agg(F.count("*").alias("n"))
        both = left_join(values, Solution(n, {"value": bad.kinds["value"], "n": Kind("integer")}, {"value", "n"}))
        return both.where(wrong(F.coalesce(both.value("n").col, F.lit(0)))).keep(["focus", "value"])

    def _unique_values(self, focus: Solution, properties: list) -> Solution:
        """Focus nodes that share their values of all the properties (each a set, none missing) with another focus node."""
        key = None
        for i, p in enumerate(properties):
            pairs = self._pairs(p, focus, "value")
            own = pairs.df.groupBy(pairs.value("focus").col.alias("focus")).agg(F.md5(F.concat_ws("\u0001", F.array_sort(F.collect_set(nt_text(box(pairs.value("value"))))))).alias(f"k{i}"))
            s = Solution(own, {"focus": pairs.kinds["focus"], f"k{i}": Kind("string")}, {"focus", f"k{i}"})
            key = s if key is None else join(key, s)
        names = [n for n in key.kinds if n != "focus"]
        many = key.df.groupBy(*[key.value(n).col for n in names]).count().where("count > 1").select(*names)
        return semi_join(key, Solution(many, {n: key.kinds[n] for n in names}, set(names)), False).keep(["focus"])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def boxed_iri(text: Column) -> Column:
    return box(Value(text, Kind("iri")))


def report_graph(engine: Engine, shapes_text: str, prefixes: dict[str, str] | None = None, disallows: tuple[str, ...] | None = None) -> DataFrame:
    """The validation report as quads. disallows: severities that break conformance; by default any result does."""
    shapes = Shapes(shapes_text, prefixes or engine.prefixes)
    found = durable(Validator(engine, shapes).violations(), "results")
    spark, report = engine.spark, struct(K_BNODE, "report")
    told: list = []
    paths = {path_text(s.path): _path_node(s.path, told) for s in shapes.shapes.values() if s.path is not None}
    # both looked up in literals: a join by so few keys would bring the results of a path together in one task
    nodes = _looked_up(F.col("path"), {text: boxed_constant(node) for text, node in paths.items()}, BOX)
    messages = {n.v if isinstance(n, IRI) else f"_:{n.v}": F.array(*[boxed_constant(m) for m in dict.fromkeys(f[SH + "message"])]) for n, f in shapes.facts.items() if SH + "message" in f}
    said = _looked_up(F.col("shape"), messages, f"array<{BOX}>")
    node = struct(K_BNODE, F.concat(F.lit("r"), F.md5(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0002")) for c in found.columns]))))
    results = found.withColumn("r", node)
    shape = F.when(F.col("shape").startswith("_:"), struct(K_BNODE, F.substring("shape", 3, 1 << 30))).otherwise(boxed_iri(F.col("shape")))
    facts = [(RDF + "type", struct(K_IRI, SH + "ValidationResult")), (SH + "focusNode", parse_nt(F.col("focus"))), (SH + "resultPath", nodes), (SH + "value", parse_nt(F.col("value"))), (SH + "sourceConstraintComponent", boxed_iri(F.col("component"))), (SH + "sourceShape", shape), (SH + "resultSeverity", boxed_iri(F.col("severity")))]
    each = results.select("r", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in facts])).alias("x")).select(F.lit("").alias("g"), F.col("r").alias("s"), "x.p", "x.o")
    texts = results.select(F.lit("").alias("g"), F.col("r").alias("s"), F.lit(SH + "resultMessage").alias("p"), F.explode(said).alias("o"))
    links = results.select(F.lit("").alias("g"), report.alias("s"), F.lit(SH + "result").alias("p"), F.col("r").alias("o"))
    broken = found if disallows is None else found.where(F.col("severity").isin(*disallows))
    head = quads_frame(spark, [(None, Triple(BNode("report"), IRI(RDF + "type"), IRI(SH + "ValidationReport"))), (None, Triple(BNode("report"), IRI(SH + "conforms"), Lit(str(broken.isEmpty()).lower(), XSD + "boolean")))] + told)
    # the results are a set and each names its own node, so no quad comes twice
    return each.where("o is not null").unionByName(texts).unionByName(links).unionByName(head)


def _looked_up(key: Column, told: dict[str, Column], kind: str) -> Column:
    """What ``told``, which the driver holds, has for the key; null if nothing."""
    if not told:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)]), key)


def _path_node(p, told: list):
    """The term of a path in a report; the triples of a composed one are added to ``told``."""
    if isinstance(p, IRI):
        return p
    node = BNode(f"path{len(told)}")
    add = lambda s, name, o: told.append((None, Triple(s, IRI(name), o)))
    if isinstance(p, Inv):
        told.append(None)
        at = len(told) - 1
        told[at] = (None, Triple(node, IRI(SH + "inversePath"), _path_node(p.a, told)))
        return node
    if isinstance(p, Mod):
        name = {"*": "zeroOrMorePath", "+": "oneOrMorePath", "?": "zeroOrOnePath"}[p.kind]
        told.append(None)
        at = len(told) - 1
        told[at] = (None, Triple(node, IRI(SH + name), _path_node(p.a, told)))
        return node
    kind, parts, rest = type(p), [], p
    while isinstance(rest, kind):
        parts.insert(0, rest.b)
        rest = rest.a
    parts.insert(0, rest)
    head, last = (node, None) if kind is Seq else (BNode(node.v + "l"), None)
    if kind is Alt:
        add(node, SH + "alternativePath", head)
    for i, part in enumerate(parts):
        cell = head if i == 0 else BNode(f"{head.v}-{i}")
        if last is not None:
            add(last, RDF + "rest", cell)
        told.append(None)
        at = len(told) - 1
        told[at] = (None, Triple(cell, IRI(RDF + "first"), _path_node(part, told)))
        last = cell
    add(last, RDF + "rest", IRI(RDF + "nil"))
    return node


def validate_each(engines: dict[str, Engine], shapes: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Violations of several data graphs in one plan, with the name of the graph in the column data."""
    out = None
    for name, engine in engines.items():
        own = validate(engine, shapes, prefixes).withColumn("data", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def evaluate(engine: Engine, shapes_text: str, node, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(focus, path, value) of the property shapes of a shape: stored values, computed ones and defaults."""
    shapes = Shapes(shapes_text, prefixes or engine.prefixes)
    validator = Validator(engine, shapes)
    focus, out = validator.targets(shapes.shape(node)), None
    for p in shapes.shape(node).get("property"):
        shape = shapes.shape(p)
        s = validator.values(shape, focus)
        own = s.df.select(box(s.value("focus")).alias("focus"), F.lit(path_text(shape.path)).alias("path"), box(s.value("value")).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


#: Severities, from the least (fixed values).
SEVERITIES = ("Trace", "Debug", "Info", "Warning", "Violation")


def validate(engine: Engine, shapes: str, prefixes: dict[str, str] | None = None, only: list[str] | None = None, focus: list[str] | None = None, least: str | None = None, limit: int | None = None) -> DataFrame:
    """The violations of the shapes: of those shapes only, of those focus nodes only, from a severity on, so many at most."""
    known = Shapes(shapes, prefixes or engine.prefixes)
    if only is not None:
        for node, facts in known.facts.items():
            if not (isinstance(node, IRI) and node.v in only):
                for name in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "targetWhere"):
                    facts.pop(SH + name, None)
    found = Validator(engine, known).violations()
    if focus is not None:
        found = found.where(F.col("focus").isin([f"<{f}>" for f in focus]))
    if least is not None:
        low = {SH + s for s in SEVERITIES[: SEVERITIES.index(least)]}
        found = found.where(~F.col("severity").isin(*low))
    return found if limit is None else found.limit(limit)


def conforms(engine: Engine, shapes: str, prefixes: dict[str, str] | None = None) -> bool:
    return validate(engine, shapes, prefixes).isEmpty()
