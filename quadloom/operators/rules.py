"""Rule sets with stratified negation, evaluated to a fixpoint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import boxed_constant, nt_text, same_term
from quadloom.plans.durable import durable
from quadloom.plans.engine import Engine
from quadloom.sources.graphs import QuadGraph, quads_frame
from quadloom.sparql.ast import Agg, Bgp, Bind, BNode, Call, Exists, Filter, Group, IRI, Query, Service, SubSelect, Triple, TripleTerm, Var
from quadloom.sparql.parser import Parser, SyntaxProblem

COLUMNS = ["g", "s", "p", "o"]
#: The name under which a rule's patterns look only at the graph that the rules began with.
BASE = IRI("urn:quadloom:base")


@dataclass
class Rule:
    head: list[Triple]
    body: Group
    positive: list[Triple]
    negative: list[Triple]

    @property
    def once(self) -> bool:
        """A head with blank nodes would make new ones forever."""
        return any(isinstance(x, BNode) for t in self.head for x in (t.s, t.o))


def _named(x) -> set[str]:
    """The variables of a pattern or expression."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (Triple, TripleTerm)):
        return _named(x.s) | _named(x.p) | _named(x.o)
    if isinstance(x, Bgp):
        return set().union(*map(_named, x.triples))
    if isinstance(x, Group):
        return set().union(*map(_named, x.parts))
    if isinstance(x, Bind):
        return {x.var} | _named(x.expr)
    if isinstance(x, Service):
        return _named(x.pattern)
    if isinstance(x, (Filter, Agg)):
        return _named(x.expr) if x.expr is not None else set()
    if isinstance(x, Exists):
        return _named(x.pattern)
    if isinstance(x, Call):
        return set().union(*map(_named, x.args))
    return set()


class _RuleParser(Parser):
    """RULE { head } WHERE [DATA] { body }, DATA { triples }, IMPORTS <iri>; in a body: triples, FILTER, SET(?v := expr),
    NOT [DATA] { pattern } and GROUP [BY ?k ...] { pattern } [ ?v := AGGREGATE(...) , ... ]."""

    def rules(self) -> tuple[list[Rule], list[Triple], list[str]]:
        out, data, imports = [], [], []
        self.prologue()
        while self.kind != "end":
            if self.take_word("RULE"):
                head = self.template()
                self.need_word("WHERE")
                only_base = self.take_word("DATA")
                out.append(self.rule(head, only_base))
            elif self.take_word("DATA"):
                data += self.template()
            elif self.take_word("IMPORTS"):
                imports.append(self.iri())
            else:
                self.fail("RULE, DATA or IMPORTS")
            self.prologue()
        return out, data, imports

    def rule(self, head: list[Triple], only_base: bool) -> Rule:
        positive, negative, parts = [], [], []
        bound = self.elements(parts, positive, negative, set())
        for t in head:
            loose = _named(t) - bound
            if loose:
                raise SyntaxProblem(f"?{min(loose)} of a head is not bound by its body")
        if only_base:
            return Rule(head, Group([Service(False, BASE, Group([p for p in parts if not isinstance(p, Filter)])), *[p for p in parts if isinstance(p, Filter)]]), [], [])
        return Rule(head, Group(parts), positive, negative)

    def elements(self, parts: list, positive: list, negative: list, bound: set[str]) -> set[str]:
        """Reads { elements }; gives the variables bound at its end."""

        def known(x, what: str) -> None:
            loose = _named(x) - bound
            if loose:
                raise SyntaxProblem(f"?{min(loose)} of a {what} is not bound before it")

        self.need("{")
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take_word("NOT"):
                base = self.take_word("DATA")
                inner = self.group()
                if base:
                    inner = Group([Service(False, BASE, inner)])
                else:
                    negative += _patterns(inner)
                parts.append(Filter(Exists(inner, True)))
            elif self.take_word("FILTER"):
                parts.append(Filter(self.primary()))
                known(parts[-1], "FILTER")
            elif self.take_word("SET"):
                self.need("(")
                name = self.next()[1:]
                self.need(":=")
                expression = self.expression()
                self.need(")")
                known(expression, "SET")
                if name in bound:
                    raise SyntaxProblem(f"?{name} is already bound")
                # an error drops the row
                parts += [Bind(expression, name), Filter(Call("BOUND", (Var(name),)))]
                bound = bound | {name}
            elif self.take_word("GROUP"):
                bound = self.grouped(parts, negative, bound)
            else:
                triples = self.triples()
                positive += triples
                parts.append(Bgp(triples))
                bound = bound | set().union(*map(_named, triples))
        return bound

    def grouped(self, parts: list, negative: list, bound: set[str]) -> set[str]:
        """A group is a sub-select: one row a key, or one in all if there is no key; an aggregate that fails drops its row."""
        keys = []
        if self.take_word("BY"):
            while self.kind == "var":
                keys.append(self.next()[1:])
        inner, own = [], []
        within = self.elements(inner, own, negative, bound & set(keys))
        if not set(keys) <= within | bound:
            raise SyntaxProblem(f"?{min(set(keys) - within - bound)} of a GROUP BY is bound nowhere")
        negative += own
        self.need("[")
        projection: list = [(k, None) for k in keys]
        while not self.take("]"):
            if self.take(","):
                continue
            name = self.next()[1:]
            self.need(":=")
            if name in bound | within or name in dict(projection):
                raise SyntaxProblem(f"?{name} is already bound")
            projection.append((name, self.expression()))
        made = [n for n, e in projection if e is not None]
        parts.append(SubSelect(Query("SELECT", Group(inner), projection, group=[(Var(k), k) for k in keys])))
        parts += [Filter(Call("BOUND", (Var(n),))) for n in made]
        return bound | set(keys) | set(made)


def _patterns(p) -> list[Triple]:
    if isinstance(p, Bgp):
        return p.triples
    return [t for x in getattr(p, "parts", []) for t in _patterns(x)]


def _may_match(head: Triple, pattern: Triple) -> bool:
    """Whether a head may make what a pattern looks for: fixed predicates and fixed objects of types must agree."""
    ground = lambda x: isinstance(x, IRI)
    if ground(head.p) and ground(pattern.p) and head.p != pattern.p:
        return False
    if not isinstance(pattern.p, IRI) and not hasattr(pattern.p, "name"):
        return True  # a path may look for anything
    return not (ground(head.o) and ground(pattern.o) and head.o != pattern.o)


class RuleSet:
    """loader: gives the text of an imported rule set by its IRI; each is read once, whatever imports it."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, loader=None):
        self.prefixes = prefixes or {}
        self.base: QuadGraph | None = None
        self.rules, self.data, open_ = _RuleParser(text, prefixes).rules()
        self.imports: list[str] = []
        while open_:
            iri = open_.pop(0)
            if iri in self.imports:
                continue
            if loader is None:
                raise SyntaxProblem(f"no loader for the import <{iri}>")
            self.imports.append(iri)
            rules, data, more = _RuleParser(loader(iri), prefixes).rules()
            self.rules, self.data, open_ = self.rules + rules, self.data + data, open_ + more

    def query(self, graph: QuadGraph, text: str) -> DataFrame:
        """The answer of a SELECT query over the graph with all that the rules derive."""
        return Engine(QuadGraph(self.infer(graph)), self.prefixes).select(text, lexical_forms=True)

    def goal(self, graph: QuadGraph, s=None, p=None, o=None) -> DataFrame:
        """The given and derived quads of a pattern; None is a wildcard. Only rules that may lead to the pattern run."""
        wanted = [Triple(s if s is not None else Var("s"), p if p is not None else Var("p"), o if o is not None else Var("o"))]
        needed: list[Rule] = []
        while True:
            more = [r for r in self.rules if r not in needed and any(_may_match(h, t) for h in r.head for t in wanted)]
            if not more:
                break
            needed += more
            wanted += [t for r in more for t in (*r.positive, *r.negative)]
        own = RuleSet("", self.prefixes)
        own.rules, own.data = [r for r in self.rules if r in needed], self.data
        found = Engine(QuadGraph(own.infer(graph)), self.prefixes).graph.quads
        for name, term in (("s", s), ("o", o)):
            if term is not None:
                found = found.where(same_term(F.col(name), boxed_constant(term)))
        return found if p is None else found.where(F.col("p") == p.v)

    def plan(self) -> list[list[str]]:
        """The predicates that the rules of each stratum make, in the order they run."""
        return [[", ".join(sorted({t.p.v if isinstance(t.p, IRI) else "?" for t in r.head})) for r in rules] for rules in self.strata()]

    def strata(self) -> list[list[Rule]]:
        """Rules by level: no lower than the rules they use, higher than those they negate."""
        n = len(self.rules)
        level = [0] * n
        for _ in range(n + 1):
            moved = False
            for i, r in enumerate(self.rules):
                for j, other in enumerate(self.rules):
                    for triples, step in ((r.positive, 0), (r.negative, 1)):
                        if any(_may_match(h, t) for h in other.head for t in triples) and level[i] < level[j] + step:
                            level[i], moved = level[j] + step, True
            if not moved:
                return [[r for r, own in zip(self.rules, level, strict=True) if own == k] for k in sorted(set(level))]
        raise SyntaxProblem("a rule depends on its own negation")

    def infer(self, graph: QuadGraph, delta: bool = False) -> DataFrame:
        """Quads with all that the rules derive; only the derived ones with ``delta``.

        Within a level, a rule that uses recursive triples runs once for each such pattern, with that
        pattern over the triples found in the last round only; results are new triples, as a table.
        """
        base = graph.quads.select(COLUMNS)
        self.base = QuadGraph(base)
        made = quads_frame(graph.spark, [(None, t) for t in self.data]).join(base, COLUMNS, "left_anti") if self.data else base.where("false")
        made = durable(made.select(COLUMNS), "rules")
        for rules in self.strata():
            recursive = [[i for i, t in enumerate(r.positive) if any(_may_match(h, t) for o in rules if not o.once for h in o.head)] for r in rules]
            view = base.unionByName(made)
            new = self._new([self._run(r, view) for r in rules], view)
            made = made.unionByName(new)
            while any(recursive) and not new.isEmpty():
                view = base.unionByName(made)
                parts = [self._run(r, view, new, i) for r, own in zip(rules, recursive, strict=True) if not r.once for i in own]
                if not parts:
                    break
                new = self._new(parts, view)
                made = made.unionByName(new)
        self.base = None
        return made if delta else base.unionByName(made)

    def _new(self, parts: list[DataFrame], view: DataFrame) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return durable(out.distinct().join(view, COLUMNS, "left_anti").select(COLUMNS), "rules")

    def _run(self, rule: Rule, view: DataFrame, delta: DataFrame | None = None, at: int = -1) -> DataFrame:
        """The rule's heads; the pattern numbered ``at`` looks only at ``delta``."""
        if delta is None:
            engine = Engine(QuadGraph(view), self.prefixes, services={BASE.v: self.base})
            return engine.instantiate(engine._pattern(rule.body, None), [(None, t) for t in rule.head])
        engine = _DeltaEngine(QuadGraph(view), self.prefixes, services={BASE.v: self.base})
        engine.special = rule.positive[at], QuadGraph(delta)
        return engine.instantiate(engine._pattern(rule.body, None), [(None, t) for t in rule.head])


class _DeltaEngine(Engine):
    """One pattern (by identity) is answered by another graph."""

    special: tuple

    def _bgp(self, triples, graph):
        from quadloom.plans.solution import join

        pattern, source = self.special
        rest = [t for t in triples if t is not pattern]
        if len(rest) == len(triples):
            return super()._bgp(triples, graph)
        first = Engine(source, self.prefixes)._bgp([pattern], graph)
        return join(first, super()._bgp(rest, graph)) if rest else first


def transitive_pairs(quads: DataFrame, predicate: str) -> DataFrame:
    """(s, o) text of the transitive closure of one predicate."""
    from quadloom.operators.closure import closure

    return closure(quads.where(F.col("p") == predicate).select(nt_text(F.col("s")).alias("s"), nt_text(F.col("o")).alias("o")))
