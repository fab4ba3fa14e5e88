"""Queries over a graph as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.expressions import Scope, Unsupported
from quadloom.functions.terms import (
    BOX,
    BOXED,
    K_BNODE,
    K_IRI,
    K_LITERAL,
    NUMERIC,
    Kind,
    Value,
    box,
    box_order,
    boxed_constant,
    constant,
    equal,
    lexical,
    number,
    struct,
    triple_text,
)
from quadloom.operators.closure import closure
from quadloom.plans.durable import durable
from quadloom.plans.solution import Solution, column_name, join, left_join, minus, semi_join, union
from quadloom.sources.graphs import QUADS, MappedGraph, QuadGraph, bind, quads_frame, variable
from quadloom.sparql.ast import (
    XSD,
    Agg,
    Alt,
    Bgp,
    Bind,
    BNode,
    Call,
    Exists,
    Filter,
    Graph,
    Group,
    In,
    Inv,
    IRI,
    Lit,
    Minus,
    Mod,
    NegSet,
    Optional_,
    Query,
    Seq,
    Service,
    SubSelect,
    Triple,
    TripleTerm,
    Union_,
    Update,
    Values,
    Var,
)
from quadloom.sparql.parser import parse_query, parse_update


#: The variable that carries a path's graph.
HERE = "~g"


def variables_of(e) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*[variables_of(a) for a in e.args])
    if isinstance(e, In):
        return variables_of(e.expr).union(*[variables_of(a) for a in e.options])
    if isinstance(e, Agg) and e.expr is not None:
        return variables_of(e.expr)
    return set()


def reversed_path(p):
    """The path walked from its end to its beginning."""
    if isinstance(p, IRI):
        return Inv(p)
    if isinstance(p, Inv):
        return p.a
    if isinstance(p, Seq):
        return Seq(reversed_path(p.b), reversed_path(p.a))
    if isinstance(p, Alt):
        return Alt(reversed_path(p.a), reversed_path(p.b))
    if isinstance(p, NegSet):
        return NegSet(p.inverse, p.forward, p.has_inverse, p.has_forward)
    return Mod(reversed_path(p.a), p.kind)


class GraphError(ValueError):
    """An update of a graph that is not there, or is there already."""


class Engine:
    """Compiles queries for one graph. services: IRI of an endpoint to a graph that answers for it."""

    def __init__(self, graph: MappedGraph | QuadGraph, prefixes: dict[str, str] | None = None, functions: dict[str, Callable] | None = None, services: dict[str, MappedGraph | QuadGraph] | None = None, now: str = "2024-01-01 00:00:00", entailment: str | None = None):
        self.entailment = entailment
        self.graph, self.prefixes, self.functions, self.services, self.now = graph, prefixes or {}, functions or {}, services or {}, now
        self.spark = graph.spark
        self.paths = 0

    # entry points
    def solutions(self, text: str | Query) -> Solution:
        q = parse_query(text, self.prefixes) if isinstance(text, str) else text
        return self._over(q)._select(q)

    def select(self, text: str | Query, lexical_forms: bool = False) -> DataFrame:
        """Columns named as the variables: native values, IRIs as text, and boxed terms (or their lexical forms)."""
        s = self.solutions(text)
        show = lambda v: lexical(v) if v.kind.name == "iri" or (lexical_forms and v.kind == BOXED) else v.col
        return s.df.select(*[show(s.value(n)).alias(n) for n in s.kinds])

    def ask(self, text: str | Query) -> bool:
        q = parse_query(text, self.prefixes) if isinstance(text, str) else text
        return not self._over(q)._pattern(q.pattern, None).df.limit(1).isEmpty()

    def construct(self, text: str | Query) -> DataFrame:
        """The set of triples (g, s, p, o) of a CONSTRUCT or DESCRIBE query."""
        q = parse_query(text, self.prefixes) if isinstance(text, str) else text
        if q.form == "DESCRIBE":
            return self._over(q)._describe(q)
        if q.from_ or q.from_named:
            return self._over(q)._construct(q)
        return self._construct(q)

    def _over(self, q: Query) -> Engine:
        """For the dataset that the query names."""
        if not (q.from_ or q.from_named):
            return self
        return Engine(self.graph.dataset(q.from_, q.from_named), self.prefixes, self.functions, self.services, self.now, self.entailment)

    def _construct(self, q: Query) -> DataFrame:
        s = self._modified(q, self._pattern(q.pattern, None))
        return self.instantiate(s, [(None, t) for t in q.template])

    def instantiate(self, s: Solution, template: list) -> DataFrame:
        """Quads of a template for each solution; those with an unbound or ill-placed term are left out.

        A template's blank node is one node for each solution: its label with a digest of the solution.
        """
        row = F.md5(F.concat_ws("\u0001", *[F.coalesce(lexical(Value(box(v), BOXED)), F.lit("\u0002")) for v in s.values().values()], F.monotonically_increasing_id().cast("string"))) if s.kinds else F.lit("0")

        def made(term):
            if isinstance(term, Var):
                return box(s.value(term.name)) if term.name in s.kinds else F.lit(None).cast(BOX)
            if isinstance(term, BNode):
                return struct(K_BNODE, F.concat(F.lit(term.v), F.lit("-"), F.col("~row")))
            if isinstance(term, TripleTerm):
                return triple_text(made(term.s), made(term.p), made(term.o))
            return boxed_constant(term)

        quads = F.array(*[F.struct((F.lit("") if g is None else made(g)["v"]).alias("g"), made(t.s).alias("s"), made(t.p).alias("p"), made(t.o).alias("o")) for g, t in template])
        df = s.df.withColumn("~row", row) if any(isinstance(x, BNode) for _, t in template for x in (t.s, t.o)) else s.df
        out = df.select(F.explode(quads).alias("q")).select("q.g", "q.s", "q.p", "q.o")
        return out.where("g is not null and s.k in (1, 2) and p.k = 2 and o is not null").select("g", "s", F.col("p.v").alias("p"), "o").distinct()

    def _describe(self, q: Query) -> DataFrame:
        """The concise bounded descriptions of the resources: their triples, and those of blank nodes that these reach."""
        parts = []
        if q.pattern is not None:
            s = self._modified(q, self._pattern(q.pattern, None))
            names = [t.name for t in q.describe if isinstance(t, Var)] if q.describe else [n for n in s.kinds if n[:2] != "_:"]
            parts += [s.select({"node": Value(box(s.value(n)), BOXED)}).df for n in names]
        fixed = [t for t in q.describe if isinstance(t, IRI)]
        if isinstance(self.graph, MappedGraph) and not parts:
            # no blank nodes there, and a fixed subject narrows the scan to one row of one table
            own = [self.graph.scan([Triple(t, Var("p"), Var("o"))]) for t in fixed]
            out = [s.df.select(F.lit("").alias("g"), boxed_constant(t).alias("s"), lexical(s.value("p")).alias("p"), box(s.value("o")).alias("o")) for t, s in zip(fixed, own, strict=True)]
            for more in out[1:]:
                out[0] = out[0].unionByName(more)
            return out[0].distinct()
        parts += [self.spark.range(1).select(boxed_constant(t).alias("node")) for t in fixed]
        seeds = parts[0]
        for more in parts[1:]:
            seeds = seeds.unionAll(more)
        every = self.graph.scan([Triple(Var("s"), Var("p"), Var("o"))])
        triples = every.df.select(F.lit("").alias("g"), box(every.value("s")).alias("s"), lexical(every.value("p")).alias("p"), box(every.value("o")).alias("o"))
        inner = triples.where(f"s.k in ({K_BNODE}, {K_IRI}) and o.k = {K_BNODE}").select("s", "o")
        own = seeds.where("node is not null").select(F.col("node").alias("s")).distinct()
        blank = inner.where(f"s.k = {K_BNODE}")
        first = inner.join(own, "s", "left_semi").select(F.col("o").alias("s")).distinct()
        reach = closure(blank, first).select(F.col("o").alias("s")) if isinstance(self.graph, QuadGraph) else first
        nodes = own.unionAll(first).unionAll(reach).distinct()
        return triples.join(nodes, "s", "left_semi").select("g", "s", "p", "o").distinct()

    # query forms and modifiers
    def _unit(self) -> Solution:
        return Solution(self.spark.range(1).select(), {}, set())

    def _scope(self, s: Solution, graph=None) -> Scope:
        return Scope(s.values(), self.functions, None, self.now)

    def _select(self, q: Query, graph=None) -> Solution:
        return self._modified(q, self._pattern(q.pattern, graph), graph)

    def _modified(self, q: Query, s: Solution, graph=None) -> Solution:
        if q.values is not None:
            s = join(s, self._values(q.values))
        projection, having, order = q.projection, list(q.having), list(q.order)
        from quadloom.sparql.parser import aggregates_in

        if q.group or any(aggregates_in(e) for e in [e for _, e in projection or [] if e is not None] + having + [e for e, _ in order]):
            s, rename = self._grouped(q, s)
            projection = [(n, rename(e) if e is not None else None) for n, e in projection]
            having, order = [rename(e) for e in having], [(rename(e), d) for e, d in order]
        for e in having:
            s = self._filtered(s, e, graph)
        for n, e in projection or []:
            if e is not None:
                s = self._extended(s, n, e, graph)
        if order:
            keys = []
            flagged = []
            for e, down in order:
                s, e = self._flags(s, e, graph)
                flagged.append((e, down))
            order, scope = flagged, self._scope(s)
            for e, down in order:
                v = scope.eval(e)
                key = box_order(v.col) if v.kind == BOXED else v.col
                keys.append(key.desc_nulls_last() if down else key.asc_nulls_first())
            s = Solution(s.df.orderBy(*keys), s.kinds, s.certain)
        if q.form == "SELECT":
            names = [n for n, _ in projection] if projection is not None else [n for n in s.kinds if not n.startswith(("_:", "~"))]
            s = s.select({n: s.value(n) if n in s.kinds else Value(F.lit(None).cast(BOX), BOXED) for n in dict.fromkeys(names)})
        if q.distinct:
            keep_order = s.df
            s = Solution(keep_order.distinct(), s.kinds, s.certain)
            if order and all(isinstance(e, Var) and e.name in s.kinds for e, _ in order):
                keys = [(box_order(s.value(e.name).col) if s.kinds[e.name] == BOXED else s.value(e.name).col, d) for e, d in order]
                s = Solution(s.df.orderBy(*[k.desc_nulls_last() if d else k.asc_nulls_first() for k, d in keys]), s.kinds, s.certain)
        if q.offset:
            s = Solution(s.df.offset(q.offset), s.kinds, s.certain)
        if q.limit is not None:
            s = Solution(s.df.limit(q.limit), s.kinds, s.certain)
        return s

    def _extended(self, s: Solution, name: str, e, graph=None) -> Solution:
        if name in s.kinds:
            raise ValueError(f"?{name} is already bound")
        names = list(s.kinds)
        if _holds_exists(e):
            s, e = self._flags(s, e, graph)
            return self._extended(s, name, e).keep([*names, name])
        v = self._scope(s).eval(e)
        if v.own is not None:
            v = Value(v.own, BOXED)
        sure = {name} if isinstance(e, (Lit, IRI)) or (isinstance(e, Var) and e.name in s.certain) or (isinstance(e, Agg) and e.name == "COUNT") else set()
        return s.select(s.values() | {name: v}, s.certain | sure)

    def _grouped(self, q: Query, s: Solution):
        keys: dict[str, object] = {}
        for i, (e, n) in enumerate(q.group):
            name = n or f"~key{i}"
            if name not in s.kinds:
                s = self._extended(s, name, e)
            keys[name] = e
        found: dict[int, tuple[str, Agg]] = {}
        scope, columns, kinds = self._scope(s), [], {}

        def rename(e):
            if isinstance(e, Agg):
                for name, known in found.values():
                    if known == e:
                        return Var(name)
                name = f"~agg{len(found)}"
                found[len(found)] = name, e
                v = self._aggregate(scope, e, s)
                columns.append(v.col.alias(column_name(name)))
                kinds[name] = v.kind
                return Var(name)
            for name, k in keys.items():
                if e == k:
                    return Var(name)
            if isinstance(e, Call):
                return Call(e.name, tuple(rename(a) for a in e.args))
            if isinstance(e, In):
                return In(rename(e.expr), tuple(rename(a) for a in e.options), e.negated)
            return e

        for e in [e for _, e in q.projection or [] if e is not None] + list(q.having) + [e for e, _ in q.order]:
            rename(e)
        grouped = s.df.groupBy(*[s.value(n).col for n in keys])
        df = grouped.agg(*columns) if columns else s.df.select(*[s.value(n).col for n in keys]).distinct()
        certain = {n for n in keys if n in s.certain} | {n for n, a in found.values() if a.name in ("COUNT", "GROUP_CONCAT")}
        return Solution(df, {n: s.kinds[n] for n in keys} | kinds, certain), rename

    def _aggregate(self, scope: Scope, a: Agg, s: Solution) -> Value:
        integer = Kind("integer")
        if a.expr is None:
            whole = F.struct(*[v.col for v in s.values().values()])
            return Value((F.countDistinct(whole) if a.distinct else F.count(F.lit(1))).cast("bigint"), integer)
        v = scope.eval(a.expr)
        c = v.col
        if a.name == "COUNT":
            return Value((F.countDistinct(c) if a.distinct else F.count(c)).cast("bigint"), integer)
        if a.name == "SAMPLE":
            return Value(F.min(c) if v.kind != BOXED else F.min_by(c, box_order(c)), v.kind)
        if a.name in ("MIN", "MAX"):
            if v.kind == BOXED:
                return Value((F.min_by if a.name == "MIN" else F.max_by)(c, box_order(c)), BOXED)
            return Value((F.min if a.name == "MIN" else F.max)(c), v.kind)
        if a.name == "GROUP_CONCAT":
            text = scope._f_str(v).col
            parts = F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text))
            return Value(F.array_join(parts, a.separator), Kind("string"))
        # SUM and AVG: one value that is no number makes the aggregate an error
        total = F.sum_distinct if a.distinct else F.sum
        if v.kind.numeric:
            counted = F.count_distinct(c) if a.distinct else F.count(c)
            sure = isinstance(a.expr, Var) and a.expr.name in s.certain
            guard = lambda x: x if sure else F.when(F.count(c) == F.count(F.lit(1)), x)
            if a.name == "SUM":
                zero = F.lit(0).cast("double" if v.kind.name == "double" else "decimal(38,18)" if v.kind.name == "decimal" else "bigint")
                return Value(guard(F.coalesce(total(c), zero)), v.kind)
            if v.kind.name == "double":
                return Value(guard(F.coalesce(F.try_divide(total(c), counted), F.lit(0.0))), v.kind)
            return Value(guard(F.coalesce(F.try_divide(total(c.cast("decimal(38,6)")), counted).cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))), Kind("decimal"))
        b = box(v)
        n = number(b)
        good = F.count(n) == F.count(F.lit(1))
        inexact = F.max(b["dt"].isin(XSD + "double", XSD + "float"))
        whole = F.min(b["dt"].isin(*[x for x in NUMERIC if x not in (XSD + "decimal", XSD + "double", XSD + "float")]))
        value = total(n) if a.name == "SUM" else F.try_divide(total(n), F.count_distinct(n) if a.distinct else F.count(n))
        value = F.coalesce(value, F.lit(0.0))
        shown = F.when(inexact, struct(K_LITERAL, value.cast("string"), XSD + "double")).when(F.coalesce(whole, F.lit(True)) & F.lit(a.name == "SUM"), struct(K_LITERAL, value.cast("decimal(38,0)").cast("string"), XSD + "integer")).otherwise(struct(K_LITERAL, lexical(Value(value.cast("decimal(38,9)"), Kind("decimal"))), XSD + "decimal"))
        return Value(F.when(good, shown), BOXED)

    # patterns
    def _pattern(self, p, graph) -> Solution:
        if isinstance(p, Group):
            return self._group(p, graph)[0]
        if isinstance(p, Bgp):
            return self._bgp(p.triples, graph)
        if isinstance(p, Union_):
            return union([self._pattern(b, graph) for b in p.branches])
        if isinstance(p, SubSelect):
            return self._select(p.query, graph)
        if isinstance(p, Values):
            return self._values(p)
        if isinstance(p, Graph):
            return self._pattern(p.pattern, p.name)
        if isinstance(p, Service):
            return self._service(p)
        raise Unsupported(type(p).__name__)

    def _group(self, g: Group, graph, pull: bool = False, given: Solution | None = None) -> tuple[Solution, list]:
        """The group's solutions, joined with those ``given``; with ``pull``, filters that need variables from outside are handed back."""
        s = given
        filters = [f.expr for f in g.parts if isinstance(f, Filter)]
        parts = [p for p in g.parts if not isinstance(p, Filter)]
        # neighbouring basic patterns are one
        for p in parts:
            if isinstance(p, Optional_):
                s = s or self._unit()
                inner, outer = self._group(p.pattern, graph, pull=True)
                condition = None
                if outer:
                    condition = lambda seen, outer=outer: _all([Scope(seen, self.functions, None, self.now).ebv(e) for e in outer])
                s = left_join(s, inner, condition)
            elif isinstance(p, Minus):
                s = minus(s or self._unit(), self._pattern(p.pattern, graph))
            elif isinstance(p, Bind):
                s = self._extended(s or self._unit(), p.var, p.expr, graph)
            else:
                right = self._pattern(p, graph)
                s = right if s is None else join(s, right)
        s = s or self._unit()
        left = []
        for e in filters:
            if pull and not variables_of(e) <= set(s.kinds) and not isinstance(e, Exists):
                left.append(e)
            else:
                s = self._filtered(s, e, graph)
        return s, left

    def _filtered(self, s: Solution, e, graph) -> Solution:
        if isinstance(e, Call) and e.name == "&&":
            return self._filtered(self._filtered(s, e.args[0], graph), e.args[1], graph)
        if isinstance(e, Call) and e.name == "!" and isinstance(e.args[0], Exists):
            e = Exists(e.args[0].pattern, not e.args[0].negated)
        if isinstance(e, Exists):
            inner, outer = self._group(e.pattern, graph, pull=True)
            condition = None
            if outer:
                condition = lambda seen: F.coalesce(_all([Scope(seen, self.functions, None, self.now).ebv(x) for x in outer]), F.lit(False))
            return semi_join(s, inner, e.negated, condition)
        if _holds_exists(e):
            names = list(s.kinds)
            s, e = self._flags(s, e, graph)
            return s.where(self._scope(s).ebv(e)).keep(names)
        return s.where(self._scope(s).ebv(e))

    def _flags(self, s: Solution, e, graph) -> tuple[Solution, object]:
        """EXISTS inside an expression: a flag for each distinct binding of the variables that the pattern sees; and the
        expression with the flags in its place."""

        def replaced(x):
            nonlocal s
            if isinstance(x, Exists):
                inner, outer = self._group(x.pattern, graph, pull=True)
                seen = set(inner.kinds).union(*[variables_of(o) for o in outer])
                keys = s.keep([n for n in s.kinds if n in seen]).distinct() if seen & set(s.kinds) else self._unit()
                condition = None
                if outer:
                    condition = lambda seen, outer=outer: F.coalesce(_all([Scope(seen, self.functions, None, self.now).ebv(o) for o in outer]), F.lit(False))
                flag = f"~exists{len(s.kinds)}"
                s = _flagged(s, semi_join(keys, inner, False, condition), flag)
                found = Call("BOUND", (Var(flag),))
                return Call("!", (found,)) if x.negated else found
            if isinstance(x, Call):
                return Call(x.name, tuple(replaced(a) for a in x.args))
            if isinstance(x, In):
                return In(replaced(x.expr), tuple(replaced(a) for a in x.options), x.negated)
            return x

        e = replaced(e) if _holds_exists(e) else e
        return s, e

    def _values(self, v: Values) -> Solution:
        if not v.vars:
            return Solution(self.spark.range(len(v.rows)).select(), {}, set())
        columns: dict[str, list] = {n: [r[i] for r in v.rows] for i, n in enumerate(v.vars)}
        rows = []
        kinds = {}
        for n, terms in columns.items():
            told = [constant(t) for t in terms if t is not None]
            own = {BOXED if v.own is not None and v.kind.name != "double" else v.kind for v in told}
            kinds[n] = own.pop() if len(own) == 1 else BOXED
        for i in range(len(v.rows)):
            one = []
            for n in v.vars:
                t = columns[n][i]
                c = F.lit(None) if t is None else constant(t).col if kinds[n] != BOXED else boxed_constant(t)
                one.append(c.cast(BOX if kinds[n] == BOXED else "string" if kinds[n].name in ("iri", "string") else {"integer": "bigint", "decimal": "decimal(38,18)", "double": "double", "boolean": "boolean", "dateTime": "timestamp", "date": "date"}[kinds[n].name]).alias(column_name(n)))
            rows.append(F.struct(*one))
        if not rows:
            return Solution(self.spark.createDataFrame([], ", ".join(f"`{column_name(n)}` {BOX}" for n in v.vars)), dict.fromkeys(v.vars, BOXED), set(v.vars))
        df = self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return Solution(df, kinds, {n for n, terms in columns.items() if all(t is not None for t in terms)})

    def _service(self, p: Service) -> Solution:
        if isinstance(p.name, IRI) and p.name.v in self.services:
            return Engine(self.services[p.name.v], self.prefixes, self.functions, self.services, self.now)._pattern(p.pattern, None)
        if p.silent:
            return self._unit()
        raise Unsupported(f"no service {p.name}")

    def _bgp(self, triples: list[Triple], graph) -> Solution:
        if self.entailment:
            from quadloom.operators.query_entailment import widened

            plain = Engine(self.graph, self.prefixes, self.functions, self.services, self.now)
            return plain._pattern(widened(triples, self.entailment), graph)
        simple = [t for t in triples if isinstance(t.p, (IRI, Var))]
        parts = [self.graph.scan(star, graph) for star in self.graph.stars(simple)]
        for t in triples:
            if not isinstance(t.p, (IRI, Var)):
                parts.append(self._path_pattern(t, graph))
        if not parts:
            return self._unit()
        # join what shares a variable first; a product only where nothing is shared
        out, rest = parts[0], parts[1:]
        while rest:
            i = max(range(len(rest)), key=lambda i: (len(set(rest[i].kinds) & set(out.kinds)), -i))
            out = join(out, rest.pop(i))
        return out

    # property paths
    def _path_pattern(self, t: Triple, graph) -> Solution:
        if isinstance(graph, Var):
            seeds = None
            if variable(t.s) is None:
                every = self.graph.scan([Triple(Var("s"), Var("p"), Var("o"))], Var(HERE)).keep([HERE]).distinct()
                seeds = every.select({"s": Value(boxed_constant(t.s), BOXED)} | every.values(), {"s", HERE})
            pairs = self._path(t.p, Var(HERE), zero=[x for x in (t.s, t.o) if variable(x) is None], seeds=seeds)
            return bind(pairs.df, [(t.s, pairs.value("s")), (t.o, pairs.value("o")), (graph, pairs.value(HERE))])
        if variable(t.s) is not None and variable(t.o) is None:
            # only the end is known: walk back from it
            pairs = self._path(reversed_path(t.p), graph, t.o)
            return bind(pairs.df, [(t.o, pairs.value("s")), (t.s, pairs.value("o"))])
        start = t.s if variable(t.s) is None else None
        pairs = self._path(t.p, graph, start)
        return bind(pairs.df, [(t.s, pairs.value("s")), (t.o, pairs.value("o"))])

    def _path(self, p, graph, start=None, zero=(), seeds: Solution | None = None) -> Solution:
        """Pairs (s, o) of a path, as bags; ``start`` is the ground term it begins at, if there is one.

        Where graph is a variable, the pairs carry the graph they lie in, and every step stays in it;
        ``zero`` are ground terms that a path of no step reaches in every graph. Only pairs that begin at
        ``seeds`` are asked for; a closure grows from them alone, so that it costs what it reaches.
        """
        self.paths += 1
        inside = isinstance(graph, Var)
        ends = ["s", "o", HERE] if inside else ["s", "o"]
        step = lambda p, s=None: self.graph.scan([Triple(s if s is not None else Var("s"), p, Var("o"))], graph)
        if isinstance(p, IRI):
            return step(p) if start is None else self._from(start, step(p, start))
        if isinstance(p, Inv):
            if start is not None and isinstance(p.a, IRI):
                s = self.graph.scan([Triple(Var("s"), p.a, start)], graph)
                return s.select({"s": constant(start), "o": s.value("s")}, {"s", "o"})
            s = self._path(p.a, graph, zero=zero)
            return s.select({n: s.value({"s": "o", "o": "s"}.get(n, n)) for n in ends}, set(ends))
        if isinstance(p, Alt):
            return union([self._path(p.a, graph, start, zero, seeds), self._path(p.b, graph, start, zero, seeds)])
        if isinstance(p, Seq):
            a = self._path(p.a, graph, start, zero, seeds)
            middle = f"~m{self.paths}"
            reached = a.select({n: a.value("o" if n == "s" else n) for n in ["s", *ends[2:]]}, {"s", *ends[2:]}).distinct()
            b = self._path(p.b, graph, zero=zero, seeds=reached)
            first = {n: a.value("o" if n == middle else n) for n in ["s", middle, *ends[2:]]}
            then = {n: b.value("s" if n == middle else n) for n in [middle, *ends[1:]]}
            pairs = join(a.select(first, set(first)), b.select(then, set(then))).keep(ends)
            if start is not None and isinstance(p.b, Mod):
                # a closure from one end is a table already; so are these pairs, as their size is to be known when what
                # they join is planned: few keys would bring the other side together in few tasks
                pairs = Solution(durable(pairs.df, "path"), pairs.kinds, pairs.certain)
            return pairs
        if isinstance(p, NegSet):
            every = self._from(start, step(Var("p"), start)) if start is not None and not p.has_inverse else step(Var("p"))
            parts = []
            if p.has_forward:
                parts.append(every.where(~lexical(every.value("p")).isin(*p.forward)) if p.forward else every)
            if p.has_inverse:
                back = every.where(~lexical(every.value("p")).isin(*p.inverse))
                parts.append(back.select({n: back.value({"s": "o", "o": "s"}.get(n, n)) for n in ends}, set(ends)))
            return union([x.keep(ends) for x in parts])
        if isinstance(p, Mod):
            return self._repeated_inside(p, graph, zero, seeds) if inside else self._repeated(p, graph, start, seeds)
        raise Unsupported(f"path {p}")

    def _repeated(self, p: Mod, graph, start, seeds: Solution | None) -> Solution:
        step = self._path(p.a, graph)
        if step.kinds["s"] != step.kinds["o"] or seeds is not None and seeds.kinds["s"] != step.kinds["s"]:
            step = step.boxed({"s", "o"})
        kind = step.kinds["s"]
        first = None
        if seeds is not None:
            seeds = seeds.boxed({"s"} if kind == BOXED else set())
            seeds = Solution(durable(seeds.df, "seeds"), seeds.kinds, seeds.certain)
            first = seeds.df
        if start is not None:
            first = bind(step.df, [(start, step.value("s"))]).df.sparkSession.range(1).select(boxed_constant(start).alias("s")) if kind == BOXED else step.df.where(_starts(step.value("s"), start)).select("s")
        if p.kind == "?":
            pairs = step.df.select("s", "o").distinct() if first is None else step.df.select("s", "o").join(first.distinct(), "s", "left_semi").distinct()
        else:
            pairs = closure(step.df, first)
        found = Solution(pairs, {"s": kind, "o": kind}, {"s", "o"})
        if p.kind == "+":
            return found
        if start is not None:
            none = Solution(self.spark.range(1).select(boxed_constant(start).alias("s"), boxed_constant(start).alias("o")), {"s": BOXED, "o": BOXED}, {"s", "o"})
        elif seeds is not None:
            none = seeds.select({"s": seeds.value("s"), "o": seeds.value("s")}, {"s", "o"})
        else:
            nodes = self.graph.nodes(graph)
            none = nodes.select({"s": nodes.value("node"), "o": nodes.value("node")}, {"s", "o"})
        return union([found, none]).distinct()

    def _repeated_inside(self, p: Mod, graph: Var, zero, seeds: Solution | None) -> Solution:
        """The closure of nodes paired with their graph, so that no path leaves its graph."""

        def node(x: Solution, n: str):
            return F.struct(lexical(x.value(HERE)).alias("g"), x.value(n).col.alias("v"))

        step = self._path(p.a, graph, zero=zero).boxed({"s", "o"})
        edges = step.df.select(node(step, "s").alias("s"), node(step, "o").alias("o"))
        first = None
        if seeds is not None:
            seeds = seeds.boxed({"s"})
            first = durable(seeds.df.select(node(seeds, "s").alias("s")).distinct(), "seeds")
        if p.kind == "?":
            pairs = edges.distinct() if first is None else edges.join(first, "s", "left_semi").distinct()
        else:
            pairs = closure(edges, first)
        if p.kind != "+":
            none = first
            if first is None:
                nodes = self.graph.scan([Triple(Var("s"), Var("p"), Var("o"))], graph).boxed({"s", "o"})
                own = nodes.df.select(F.array(node(nodes, "s"), node(nodes, "o")).alias("n"), lexical(nodes.value(HERE)).alias("g"))
                none = own.select(F.explode("n").alias("s"))
                for t in zero:
                    none = none.unionByName(own.select("g").distinct().select(F.struct("g", boxed_constant(t).alias("v")).alias("s")))
            pairs = pairs.unionByName(none.select("s", F.col("s").alias("o"))).distinct()
        out = pairs.select(F.col("s.v").alias("s"), F.col("o.v").alias("o"), F.col("s.g").alias(column_name(HERE)))
        return Solution(out, {"s": BOXED, "o": BOXED, HERE: Kind("iri")}, {"s", "o", HERE})

    def _from(self, start, s: Solution) -> Solution:
        return s.select({"s": constant(start)} | s.values(), s.certain | {"s"})

    # updates
    def update(self, text: str) -> QuadGraph:
        """The graph after the updates; this one is not changed."""
        updates = parse_update(text, self.prefixes)
        if isinstance(self.graph, QuadGraph):
            return self._all_updated(self.graph, updates)
        # only the predicates that the updates name are read for them; the others go by
        named = _predicates(updates)
        after = self._all_updated(self.graph.as_quads(named), updates)
        return after if named is None else QuadGraph(after.quads.unionByName(self.graph.as_quads(without=named).quads))

    def _all_updated(self, graph: QuadGraph, updates: list[Update]) -> QuadGraph:
        quads = graph.quads
        for u in updates:
            quads = self._updated(quads, u, graph.default_union)
        return QuadGraph(quads, graph.default_union)

    def _updated(self, quads: DataFrame, u: Update, default_union: bool) -> DataFrame:
        less = lambda a, b: a.join(b.select(a.columns), ["g", "s", "p", "o"], "left_anti").select("g", "s", "p", "o")
        more = lambda a, b: a.unionByName(b).distinct()
        of = lambda ref: F.col("g") == "" if ref == "DEFAULT" else F.col("g") != "" if ref == "NAMED" else F.lit(True) if ref == "ALL" else F.col("g") == ref.v
        if u.op == "INSERT DATA":
            return more(quads, quads_frame(self.spark, u.insert))
        if u.op == "DELETE DATA":
            return less(quads, quads_frame(self.spark, u.delete))
        # a graph is there if it has a quad: without SILENT, one to be emptied or read must be, one to be made must not
        there = lambda name: not quads.where(F.col("g") == name).isEmpty()
        if u.op in ("CLEAR", "DROP"):
            if not u.silent and isinstance(u.graph, IRI) and not there(u.graph.v):
                raise GraphError(f"{u.op}: there is no graph <{u.graph.v}>")
            return quads.where(~of(u.graph))
        if u.op == "CREATE":
            if not u.silent and there(u.graph.v):
                raise GraphError(f"CREATE: there is a graph <{u.graph.v}>")
            return quads
        if u.op in ("ADD", "COPY", "MOVE"):
            source, target = ("" if r == "DEFAULT" else r.v for r in (u.graph, u.target))
            if not u.silent and source and not there(source):
                raise GraphError(f"{u.op}: there is no graph <{source}>")
            if source == target:
                return quads
            kept = quads.where(F.col("g") != target) if u.op != "ADD" else quads
            kept = kept.where(F.col("g") != source) if u.op == "MOVE" else kept
            return more(kept, quads.where(F.col("g") == source).withColumn("g", F.lit(target)))
        if u.op == "LOAD":
            from quadloom.sources.turtle import read

            try:
                return more(quads, read(self.spark, u.graph.v, self.prefixes).withColumn("g", F.lit(u.target.v if u.target else "")))
            except Exception:
                if u.silent:
                    return quads
                raise
        view = QuadGraph(quads, default_union)
        if u.using or u.using_named:
            view = QuadGraph(quads, False, u.using, u.using_named)
        elif u.with_:
            view = QuadGraph(quads, False, [u.with_], None)
        engine = Engine(view, self.prefixes, self.functions, self.services, self.now)
        s = engine._pattern(u.pattern, None)
        in_graph = lambda template: [(g if g is not None else IRI(u.with_) if u.with_ else None, t) for g, t in template]
        after = less(quads, engine.instantiate(s, in_graph(u.delete))) if u.delete else quads
        return more(after, engine.instantiate(s, in_graph(u.insert))) if u.insert else after


def _predicates(x) -> set[str] | None:
    """The predicates of all triples within; None if one is not fixed, or whole graphs are meant."""
    if isinstance(x, Update) and x.op in ("CLEAR", "DROP", "ADD", "COPY", "MOVE", "LOAD"):
        return None
    if isinstance(x, Triple):
        return {x.p.v} if isinstance(x.p, IRI) else None
    if isinstance(x, (list, tuple)):
        parts = [_predicates(y) for y in x]
    elif is_dataclass(x) and not isinstance(x, type):
        parts = [_predicates(getattr(x, f.name)) for f in fields(x)]
    else:
        return set()
    return None if any(p is None for p in parts) else set().union(*parts)


def _flagged(s: Solution, hit: Solution, flag: str) -> Solution:
    """s with a flag that is bound where its binding, unbound variables included, is one of ``hit``."""
    hit = hit.boxed({n for n in hit.kinds if hit.kinds[n] != s.kinds[n]})
    marks = hit.select({f"{n}~hit": v for n, v in hit.values().items()} | {flag: Value(F.lit(True), Kind("boolean"))}, {flag})
    on = F.lit(True)
    for n in hit.kinds:
        mine, theirs = s.value(n).col, marks.value(f"{n}~hit").col
        on = on & (mine == theirs if n in s.certain else mine.eqNullSafe(theirs))
    joined = s.df.join(marks.df, on, "left")
    return Solution(joined, s.kinds | {flag: Kind("boolean")}, s.certain)


def _starts(value: Value, term):
    from quadloom.sources.graphs import _is

    return _is(value, term)


def _all(columns: list):
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def _holds_exists(e) -> bool:
    if isinstance(e, In):
        return any(_holds_exists(a) for a in (e.expr, *e.options))
    return isinstance(e, Exists) or (isinstance(e, Call) and any(_holds_exists(a) for a in e.args))


__all__ = ["QUADS", "Engine", "equal"]
