"""SHACL node expressions, each evaluated for all focus nodes at once.

A result is (focus, pos, node): pos keeps the order of a focus node's list, repeats included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.expressions import Scope
from quadloom.functions.terms import BOX, BOXED, K_LITERAL, NUMERIC, Kind, Value, box, box_order, boxed_constant, number, struct
from quadloom.plans.solution import Solution
from quadloom.sparql.ast import IRI, RDF, SH, XSD, BNode, Call, Lit, Var
from quadloom.sparql.parser import parse_query

SHNEX = "http://www.w3.org/ns/shacl-node-expr#"
CALLS = "http://www.w3.org/ns/sparql#"
#: Calls whose name is not that of the function (fixed values).
OPERATORS = {"equals": "=", "sameValue": "=", "not-equals": "!=", "less-than": "<", "greater-than": ">", "less-than-or-equal": "<=", "greater-than-or-equal": ">=", "plus": "+", "subtract": "-", "multiply": "*", "divide": "/", "logical-not": "!", "unary-plus": "POS", "unary-minus": "NEG", "logical-or": "||", "logical-and": "&&", "encode": "ENCODE_FOR_URI"}
TRUE = Lit("true", XSD + "boolean")
BOOLEAN, INTEGER = XSD + "boolean", XSD + "integer"


class NodeExpressions:
    """validator: gives the graph, its shapes, and which nodes conform to a shape."""

    def __init__(self, validator, arguments: dict | None = None):
        self.v, self.facts, self.arguments = validator, validator.shapes.facts, arguments or {}

    def eval(self, expr, focus: DataFrame) -> DataFrame:
        """``focus`` has one distinct boxed column, focus."""
        if expr == IRI(SH + "this"):
            return focus.select("focus", F.lit(0).alias("pos"), F.col("focus").alias("node"))
        if not isinstance(expr, BNode) or not self.facts.get(expr):
            return focus.select("focus", F.lit(0).alias("pos"), boxed_constant(expr).alias("node"))
        facts = self.facts[expr]
        if RDF + "first" in facts:
            return self.concat([self.eval(x, focus) for x in self.v.shapes.items(expr)], focus)
        if SH + "path" in facts:
            return self.path(facts[SH + "path"][0], focus)
        keys = {k.removeprefix(SHNEX): o[0] for k, o in facts.items() if k.startswith(SHNEX)}
        for name in keys:
            made = getattr(self, "_" + name.lower(), None)
            if made:
                return made(keys, focus)
        for key, values in facts.items():
            if key.startswith(CALLS):
                return self._call(key.removeprefix(CALLS), self.v.shapes.items(values[0]), focus)
        if SH + "select" in facts or SH + "sparqlExpr" in facts:
            return self._query(facts, focus)
        for key in facts:
            if IRI(SH + "NamedParameterExpressionFunction") in self.facts.get(IRI(key), {}).get(RDF + "type", []):
                return self._custom(IRI(key), facts, focus)
        raise NotImplementedError(f"node expression {sorted(facts)}")

    # queries and calls
    def _single(self, expr, focus: DataFrame, name: str) -> DataFrame:
        """(focus, name): the only node of an expression; an expression of several nodes is a failure."""
        found = self.eval(expr, focus).groupBy("focus").agg(F.count("*").alias("n"), F.min("node").alias(name))
        return found.select("focus", F.when(F.col("n") > 1, F.raise_error(F.lit("an argument with more than one node"))).otherwise(F.col(name)).alias(name))

    def _call(self, name: str, args: list, focus: DataFrame) -> DataFrame:
        """A function of the query language. A missing argument gives no node, but for bound, coalesce and the logical ones."""
        rows = focus
        for i, a in enumerate(args):
            rows = rows.join(self._single(a, focus, f"a{i}"), "focus", "left")
        bound = {f"a{i}": Value(F.col(f"a{i}"), BOXED) for i in range(len(args))}
        names = tuple(Var(n) for n in bound)
        scope = Scope(bound, self.v.engine.functions, None, self.v.engine.now)
        if name == "bound":
            out = Value(F.col("a0").isNotNull(), Kind("boolean"))
        elif name == "hasLang" and len(args) == 2:
            out = Value(F.lower(scope._f_lang(bound["a0"]).col) == F.lower(scope._f_str(bound["a1"]).col), Kind("boolean"))
        else:
            out = scope.eval(Call(OPERATORS.get(name, name.upper()), names))
            if name not in ("coalesce", "if", "logical-or", "logical-and"):
                for n in bound:
                    rows = rows.where(F.col(n).isNotNull())
        return rows.select("focus", F.lit(0).alias("pos"), box(out).alias("node")).where("node is not null")

    def _query(self, facts: dict, focus: DataFrame) -> DataFrame:
        """A SELECT of one variable, or an expression, run once with all focus nodes as $this."""
        engine, prefixes = self.v.engine, self.v.engine.prefixes | self.v.shapes.declared()
        given = Solution(focus.select(F.col("focus").alias("this")), {"this": BOXED}, {"this"})
        if SH + "select" in facts:
            q = parse_query(facts[SH + "select"][0].v, prefixes)
            if q.projection is None or len(q.projection) != 1:
                raise ValueError("a select expression projects one variable")
            name = q.projection[0][0]
            found = engine._group(q.pattern, None, given=given)[0]
            q.projection = [("this", None), *q.projection] if name != "this" else q.projection
        else:
            q = parse_query(f"SELECT $this ({facts[SH + 'sparqlExpr'][0].v}\n AS ?value) WHERE {{}}", prefixes)
            name, found = "value", given
        found = engine._modified(q, found)
        pairs = found.df.select(box(found.value("this")).alias("focus"), box(found.value(name)).alias("node")).where("node is not null")
        return self._numbered(pairs, box_order(F.col("node")))

    def _custom(self, function: IRI, call: dict, focus: DataFrame) -> DataFrame:
        """A declared function with named parameters: its body, in which arguments stand for their expressions."""
        declared = [path for p in self.facts[function].get(SH + "parameter", []) for path in self.facts[p].get(SH + "path", [])]
        own = {path: call[path.v][0] for path in declared if path.v in call}
        return NodeExpressions(self.v, own).eval(self.facts[function][SH + "bodyExpression"][0], focus)

    def _arg(self, keys, focus):
        if keys["arg"] not in self.arguments:
            return self.concat([], focus)
        return NodeExpressions(self.v).eval(self.arguments[keys["arg"]], focus)

    def _conformstoshape(self, keys, focus):
        node, shape = self.v.shapes.items(keys["conformsToShape"])
        if not isinstance(shape, IRI) or shape == IRI(SH + "this"):
            raise NotImplementedError("conformsToShape of a computed shape")
        nodes = self._single(node, focus, "node")
        bad = self._failing(shape, nodes)
        good = nodes.join(bad, "node", "left_anti")
        return self._flag(nodes.select("focus"), good)

    # helpers
    def _nodes(self, keys: dict, focus: DataFrame) -> DataFrame:
        return self.eval(keys["nodes"], focus) if "nodes" in keys else self.eval(IRI(SH + "this"), focus)

    def _flag(self, focus: DataFrame, hits: DataFrame) -> DataFrame:
        """Per focus node, whether it is among the hits."""
        marked = focus.join(hits.select("focus").distinct().withColumn("hit", F.lit("true")), "focus", "left")
        return marked.select("focus", F.lit(0).alias("pos"), struct(K_LITERAL, F.coalesce("hit", F.lit("false")), BOOLEAN).alias("node"))

    def _numbered(self, df: DataFrame, *order) -> DataFrame:
        return df.withColumn("pos", F.row_number().over(Window.partitionBy("focus").orderBy(*order)) - 1).select("focus", "pos", "node")

    def _failing(self, shape, nodes: DataFrame) -> DataFrame:
        """(node) of the distinct nodes that do not conform."""
        asked = Solution(nodes.select(F.col("node").alias("focus")).distinct(), {"focus": BOXED}, {"focus"})
        bad = self.v.failing(shape, asked)
        return bad.df.select(box(bad.value("focus")).alias("node")).distinct()

    def concat(self, parts: list[DataFrame], focus: DataFrame) -> DataFrame:
        if not parts:
            return focus.where("false").select("focus", F.lit(0).alias("pos"), F.lit(None).cast(BOX).alias("node"))
        out = parts[0].withColumn("part", F.lit(0))
        for i, p in enumerate(parts[1:], 1):
            out = out.unionByName(p.withColumn("part", F.lit(i)))
        return self._numbered(out, "part", "pos")

    def path(self, path, focus: DataFrame) -> DataFrame:
        found = self.v._pairs(self.v.shapes.path(path), Solution(focus, {"focus": BOXED}, {"focus"}), "node")
        pairs = found.df.select(box(found.value("focus")).alias("focus"), box(found.value("node")).alias("node")).distinct()
        return self._numbered(pairs, box_order(F.col("node")))

    # expressions, by their key
    def _var(self, keys, focus):
        if keys["var"].v != "focusNode":
            raise NotImplementedError(f"variable {keys['var'].v}")
        return self.eval(IRI(SH + "this"), focus)

    def _pathvalues(self, keys, focus):
        if "focusNode" not in keys:
            return self.path(keys["pathValues"], focus)
        start = self.eval(keys["focusNode"], focus)
        inner = self.path(keys["pathValues"], start.select(F.col("node").alias("focus")).distinct()).withColumnRenamed("focus", "start").withColumnRenamed("node", "end")
        return start.join(inner.drop("pos"), F.col("node") == F.col("start")).select("focus", F.col("end").alias("node")).transform(lambda d: self._numbered(d, box_order(F.col("node"))))

    def _exists(self, keys, focus):
        return self._flag(focus, self.eval(keys["exists"], focus))

    def _if(self, keys, focus):
        said = self.eval(keys["if"], focus)
        yes = said.groupBy("focus").agg(F.count("*").alias("n"), F.min("node").alias("node")).where((F.col("n") == 1) & (F.col("node")["v"] == "true") & (F.col("node")["dt"] == BOOLEAN)).select("focus")
        out = [self.eval(keys["then"], focus.join(yes, "focus", "left_semi"))] if "then" in keys else []
        if "else" in keys:
            out.append(self.eval(keys["else"], focus.join(yes, "focus", "left_anti")))
        return self.concat(out, focus)

    def _distinct(self, keys, focus):
        first = self.eval(keys["distinct"], focus).groupBy("focus", "node").agg(F.min("pos").alias("pos"))
        return self._numbered(first, "pos")

    def _intersection(self, keys, focus):
        parts = [self.eval(x, focus) for x in self.v.shapes.items(keys["intersection"])]
        out = parts[0].groupBy("focus", "node").agg(F.min("pos").alias("pos"))
        for p in parts[1:]:
            out = out.join(p.select("focus", "node").distinct(), ["focus", "node"], "left_semi")
        return self._numbered(out, "pos")

    def _concat(self, keys, focus):
        return self.concat([self.eval(x, focus) for x in self.v.shapes.items(keys["concat"])], focus)

    def _remove(self, keys, focus):
        drop = self.eval(keys["remove"], focus).select("focus", "node").distinct()
        return self._numbered(self._nodes(keys, focus).join(drop, ["focus", "node"], "left_anti"), "pos")

    def _limit(self, keys, focus):
        return self._nodes(keys, focus).where(F.col("pos") < int(keys["limit"].v))

    def _offset(self, keys, focus):
        n = int(keys["offset"].v)
        return self._nodes(keys, focus).where(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)

    def _orderby(self, keys, focus):
        nodes = self._nodes(keys, focus)
        key = self.eval(keys["orderBy"], nodes.select(F.col("node").alias("focus")).distinct()).where("pos = 0").select(F.col("focus").alias("node"), F.col("node").alias("key"))
        down = "desc" in keys and keys["desc"].v in ("true", "1")
        order = box_order(F.col("key"))
        return self._numbered(nodes.join(key, "node", "left"), order.desc() if down else order.asc(), "pos")

    def _flatmap(self, keys, focus):
        nodes = self._nodes(keys, focus).withColumnRenamed("pos", "outer")
        inner = self.eval(keys["flatMap"], nodes.select(F.col("node").alias("focus")).distinct()).select(F.col("focus").alias("node"), F.col("pos").alias("inner"), F.col("node").alias("made"))
        return self._numbered(nodes.join(inner, "node").select("focus", "outer", "inner", F.col("made").alias("node")), "outer", "inner")

    def _filtershape(self, keys, focus):
        nodes = self._nodes(keys, focus)
        return self._numbered(nodes.join(self._failing(keys["filterShape"], nodes), "node", "left_anti"), "pos")

    def _findfirst(self, keys, focus):
        nodes = self._nodes(keys, focus)
        good = nodes.join(self._failing(keys["findFirst"], nodes), "node", "left_anti")
        return good.groupBy("focus").agg(F.min_by("node", "pos").alias("node")).select("focus", F.lit(0).alias("pos"), "node")

    def _matchall(self, keys, focus):
        nodes = self._nodes(keys, focus)
        bad = nodes.join(self._failing(keys["matchAll"], nodes), "node", "left_semi").select("focus").distinct()
        return self._flag(focus, focus.join(bad, "focus", "left_anti"))

    def _count(self, keys, focus):
        n = self.eval(keys["count"], focus).groupBy("focus").agg(F.count("*").alias("n"))
        return focus.join(n, "focus", "left").select("focus", F.lit(0).alias("pos"), struct(K_LITERAL, F.coalesce("n", F.lit(0)).cast("string"), INTEGER).alias("node"))

    def _extremum(self, expr, focus, pick):
        best = self.eval(expr, focus).groupBy("focus").agg(pick("node", box_order(F.col("node"))).alias("node"))
        return best.select("focus", F.lit(0).alias("pos"), "node")

    def _min(self, keys, focus):
        return self._extremum(keys["min"], focus, F.min_by)

    def _max(self, keys, focus):
        return self._extremum(keys["max"], focus, F.max_by)

    def _sum(self, keys, focus):
        nodes = self.eval(keys["sum"], focus)
        node = F.col("node")
        checked = F.when(number(node).isNotNull(), number(node)).otherwise(F.raise_error(F.lit("shnex:sum of a node that is no number")))
        whole = node["dt"].isin(*[n for n in NUMERIC if n.rpartition("#")[2] not in ("decimal", "double", "float")])
        total = nodes.groupBy("focus").agg(F.sum(checked).alias("t"), F.min(whole).alias("whole"))
        both = focus.join(total, "focus", "left")
        shown = F.when(F.coalesce("whole", F.lit(True)), struct(K_LITERAL, F.coalesce("t", F.lit(0.0)).cast("decimal(38,0)").cast("string"), INTEGER)).otherwise(struct(K_LITERAL, F.col("t").cast("string"), XSD + "double"))
        return both.select("focus", F.lit(0).alias("pos"), shown.alias("node"))

    def _instancesof(self, keys, focus):
        members = self.v.instances(keys["instancesOf"])
        return self._everywhere(focus, members.df.select(box(members.value("focus")).alias("node")).distinct())

    def _nodesmatching(self, keys, focus):
        every = self.v.engine.graph.nodes()
        nodes = every.df.select(box(every.value("node")).alias("node")).distinct()
        return self._everywhere(focus, nodes.join(self._failing(keys["nodesMatching"], nodes), "node", "left_anti"))

    def _everywhere(self, focus: DataFrame, nodes: DataFrame) -> DataFrame:
        """The same nodes for every focus node, as the expression says."""
        return self._numbered(focus.join(nodes), box_order(F.col("node")))


def values_of(validator, expr, focus: Solution) -> DataFrame:
    return NodeExpressions(validator).eval(expr, focus.df.select(box(Value(focus.value("focus").col, focus.kinds["focus"])).alias("focus")).distinct())
