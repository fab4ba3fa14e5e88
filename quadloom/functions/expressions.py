"""SPARQL expressions as columns; an error is null, which filters drop and BIND leaves unbound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions.terms import (
    BOXED,
    DIR_STRING,
    DURATION,
    DURATIONS,
    EXACT,
    INTEGERS,
    K_BNODE,
    K_IRI,
    K_LITERAL,
    K_TRIPLE,
    LANG_STRING,
    NATIVE,
    NUMERIC,
    STRING,
    Kind,
    Value,
    box,
    constant,
    double_text,
    ebv,
    equal,
    exact,
    instant,
    less,
    lexical,
    number,
    same_term,
    struct,
    text_of,
    triple_part,
    triple_text,
)
from quadloom.sparql.ast import XSD, Agg, Call, Exists, In, IRI, Lit, Var

#: A date or time as written: year, month, day, hours, minutes, seconds.
CLOCK = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(?:Z|[+-]\d\d:\d\d)?$"
#: Least and greatest values of the integer types (fixed values).
RANGES = {
    "long": (-(1 << 63), (1 << 63) - 1),
    "int": (-(1 << 31), (1 << 31) - 1),
    "short": (-(1 << 15), (1 << 15) - 1),
    "byte": (-(1 << 7), (1 << 7) - 1),
    "unsignedLong": (0, (1 << 64) - 1),
    "unsignedInt": (0, (1 << 32) - 1),
    "unsignedShort": (0, (1 << 16) - 1),
    "unsignedByte": (0, (1 << 8) - 1),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
}
BOOLEAN, TEXT, INTEGER, DECIMAL, DOUBLE = Kind("boolean"), Kind("string"), Kind("integer"), Kind("decimal"), Kind("double")


class Unsupported(NotImplementedError):
    pass


def java_regex(flags: str, pattern: str) -> str:
    """An XPath pattern with its flags for Java; class subtraction becomes an intersection."""
    import re

    if "q" in flags:
        pattern = r"\Q" + pattern + r"\E"
    pattern = re.sub(r"-\[([^\]]*)\]\]", r"&&[^\1]]", pattern)
    pattern = pattern.replace(r"\i", r"[_:A-Za-z]").replace(r"\c", r"[-._:A-Za-z0-9]")
    kept = "".join(f for f in flags if f in "ismx")
    return f"(?{kept}){pattern}" if kept else pattern


def java_regex_column(flags: Column, pattern: Column) -> Column:
    """The same for patterns and flags that rows give."""
    quoted = F.when(F.contains(flags, F.lit("q")), F.concat(F.lit("\\Q"), pattern, F.lit("\\E")))
    plain = F.regexp_replace(pattern, r"-\[([^\]]*)\]\]", r"&&[^$1]]")
    plain = F.replace(F.replace(plain, F.lit("\\i"), F.lit("[_:A-Za-z]")), F.lit("\\c"), F.lit("[-._:A-Za-z0-9]"))
    kept = F.regexp_replace(flags, "[^ismx]", "")
    return F.concat(F.when(kept != "", F.concat(F.lit("(?"), kept, F.lit(")"))).otherwise(""), F.coalesce(quoted, plain))


def quotient(x: Column, y: Column) -> Column:
    """Division of doubles, in which zero is a divisor like any other."""
    return F.when(y != 0, F.try_divide(x, y)).when(F.isnan(y), y).when(y == 0, F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan")))


def product(x: Column, y: Column) -> Column:
    """Of decimals (38,18): all 18 digits where the factors have 9 at most, else as many as fit."""
    a, b = x.try_cast("decimal(19,9)"), y.try_cast("decimal(19,9)")
    return F.when((a == x) & (b == y), F.try_multiply(a, b).try_cast("decimal(38,18)")).otherwise(F.try_multiply(x, y).try_cast("decimal(38,18)"))


def ratio(x: Column, y: Column) -> Column:
    """Of decimals (38,18): 18 digits after the point where the operands have 9 at most and are below 10^9."""
    a, b = x.try_cast("decimal(18,9)"), y.try_cast("decimal(18,9)")
    return F.when((a == x) & (b == y), F.try_divide(a, b).try_cast("decimal(38,18)")).otherwise(F.try_divide(x, y).try_cast("decimal(38,18)"))


class Scope:
    """The variables of a row, and what expressions need beside them."""

    def __init__(self, values: dict[str, Value], functions: dict[str, Callable] | None = None, exists: Callable | None = None, now: str = "2024-01-01 00:00:00", base: str = ""):
        self.values, self.functions, self.exists, self.now, self.base = values, functions or {}, exists, now, base

    def ebv(self, e) -> Column:
        return ebv(self.eval(e))

    def eval(self, e) -> Value:
        if isinstance(e, Var):
            return self.values.get(e.name) or Value(F.lit(None).cast("struct<k:int,v:string,dt:string,lang:string,dir:string>"), BOXED)
        if isinstance(e, (IRI, Lit)):
            return constant(e)
        if isinstance(e, In):
            it = self.eval(e.expr)
            hit = F.lit(False)
            for option in e.options:
                hit = hit | equal(it, self.eval(option))
            return Value(~hit if e.negated else hit, BOOLEAN)
        if isinstance(e, Exists):
            if not self.exists:
                raise Unsupported("EXISTS here")
            return Value(self.exists(e), BOOLEAN)
        if isinstance(e, Agg):
            raise Unsupported("an aggregate outside a group")
        return self.call(e)

    # helpers
    def _string(self, v: Value) -> Column:
        return text_of(v.col) if v.kind.name == "box" else v.col if v.kind == TEXT else F.lit(None).cast("string")

    def _like(self, source: Value, col: Column) -> Value:
        """A string with the language and direction of its source."""
        if source.kind.name != "box":
            return Value(col, TEXT)
        b = source.col
        return Value(F.when(text_of(b).isNotNull() & col.isNotNull(), struct(K_LITERAL, col, b["dt"], b["lang"], b["dir"])), BOXED)

    def _number(self, v: Value) -> Value:
        if v.kind.numeric:
            return v
        return Value(number(v.col) if v.kind.name == "box" else F.lit(None).cast("double"), DOUBLE)

    def _time(self, v: Value) -> Column:
        if v.kind.name in ("dateTime", "date"):
            return v.col.cast("timestamp")
        return instant(v.col) if v.kind.name == "box" else F.lit(None).cast("timestamp")

    def _arithmetic(self, op: str, a: Value, b: Value) -> Value:
        if a.kind.numeric and b.kind.numeric:
            names = {a.kind.name, b.kind.name}
            if "double" in names:
                x, y = a.col.cast("double"), b.col.cast("double")
                return Value({"+": x + y, "-": x - y, "*": x * y, "/": quotient(x, y)}[op], DOUBLE)
            if names == {"integer"} and op != "/":
                return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col.cast("bigint"), b.col.cast("bigint")), INTEGER)
            x, y = a.col.cast("decimal(38,18)"), b.col.cast("decimal(38,18)")
            return Value({"+": F.try_add(x, y), "-": F.try_subtract(x, y), "*": product(x, y), "/": ratio(x, y)}[op].try_cast("decimal(38,18)"), DECIMAL)
        # in a function of its own: the cases are many, and would weigh on the code of a stage
        pair = F.array(F.struct(box(a).alias("p"), box(b).alias("q")))
        return Value(F.transform(pair, lambda x: self._boxed_arithmetic(op, x["p"], x["q"]))[0], BOXED)

    @staticmethod
    def _boxed_arithmetic(op: str, p: Column, q: Column) -> Column:
        both = lambda *names: p["dt"].isin(*names) & q["dt"].isin(*names)
        x, y, u, w = number(p), number(q), exact(p), exact(q)
        approx = {"+": x + y, "-": x - y, "*": x * y, "/": quotient(x, y)}[op]
        dec = {"+": F.try_add(u, w), "-": F.try_subtract(u, w), "*": product(u, w), "/": ratio(u, w)}[op].try_cast("decimal(38,18)")
        integers = both(*INTEGERS)
        whole = integers if op != "/" else F.lit(False)
        # integers beyond 20 digits, as far as 38 go
        m, n = (F.when(integers, t["v"].try_cast("decimal(38,0)")) for t in (p, q))
        large = {"+": F.try_add(m, n), "-": F.try_subtract(m, n), "*": F.try_multiply(m, n), "/": F.lit(None).cast("decimal(38,0)")}[op].try_cast("decimal(38,0)")
        inexact = p["dt"].isin(XSD + "double", XSD + "float") | q["dt"].isin(XSD + "double", XSD + "float")
        kind = F.when(both(*EXACT, XSD + "float") & inexact, XSD + "float").otherwise(XSD + "double")
        return (
            F.when(whole & large.isNotNull(), struct(K_LITERAL, large.cast("string"), XSD + "integer"))
            .when(dec.isNotNull(), struct(K_LITERAL, lexical(Value(dec, DECIMAL)), XSD + "decimal"))
            .when(approx.isNotNull() & inexact, struct(K_LITERAL, double_text(approx), kind))
        )

    def call(self, e: Call) -> Value:
        name = e.name
        if name in ("&&", "||"):
            a, b = (self.ebv(x) for x in e.args)
            return Value(a & b if name == "&&" else a | b, BOOLEAN)
        if name == "!":
            return Value(~self.ebv(e.args[0]), BOOLEAN)
        if name == "BOUND":
            return Value(self.eval(e.args[0]).col.isNotNull(), BOOLEAN)
        if name == "IF":
            test, (a, b) = self.ebv(e.args[0]), self._same_kind([self.eval(x) for x in e.args[1:]])
            return Value(F.when(test, a.col).when(~test, b.col), a.kind)
        if name == "COALESCE":
            options = self._same_kind([self.eval(x) for x in e.args])
            return Value(F.coalesce(*[o.col for o in options]), options[0].kind) if options else self.eval(Var(""))
        if name in ("REGEX", "REPLACE"):
            return self._regex(e)
        if name.startswith("<") and name.endswith(">"):
            return self._function(name[1:-1], [self.eval(x) for x in e.args])
        args = [self.eval(x) for x in e.args]
        if name in ("+", "-", "*", "/"):
            return self._arithmetic(name, *args)
        if name == "=":
            return Value(equal(*args), BOOLEAN)
        if name == "!=":
            return Value(~equal(*args), BOOLEAN)
        if name in ("<", ">", "<=", ">="):
            a, b = args if name[0] == "<" else args[::-1]
            below = less(a, b)
            return Value(below | equal(a, b) if name.endswith("=") else below, BOOLEAN)
        if name in ("NEG", "POS"):
            zero = Value(F.lit(0).cast("bigint"), INTEGER)
            return self._arithmetic("-" if name == "NEG" else "+", zero, args[0])
        made = getattr(self, "_f_" + name.lower(), None)
        if not made:
            raise Unsupported(name)
        return made(*args)

    def _same_kind(self, values: list[Value]) -> list[Value]:
        if len({v.kind for v in values}) <= 1 and not any(v.own is not None and v.kind.name != "double" for v in values):
            return values
        return [Value(box(v), BOXED) for v in values]

    def _regex(self, e: Call) -> Value:
        """A pattern that matches the empty text is an error in REPLACE."""
        given = e.args[-1] if len(e.args) == (3 if e.name == "REGEX" else 4) else Lit("", STRING)
        source = self.eval(e.args[0])
        text = self._string(source)
        if isinstance(given, Lit) and isinstance(e.args[1], Lit):
            pattern = F.lit(java_regex(given.v, e.args[1].v))
        else:
            pattern = java_regex_column(self._string(self.eval(given)), self._string(self.eval(e.args[1])))
        if e.name == "REGEX":
            return Value(F.rlike(text, pattern), BOOLEAN)
        replaced = F.regexp_replace(text, pattern, self._string(self.eval(e.args[2])))
        return self._like(source, F.when(~F.rlike(F.lit(""), pattern), replaced))

    def _function(self, iri: str, args: list[Value]) -> Value:
        name = iri.removeprefix(XSD)
        if iri.startswith(XSD) and name in NATIVE and len(args) == 1:
            v = args[0]
            if name == "string":
                return Value(lexical(v), TEXT)
            if v.kind.name != "box" and v.kind.numeric and name == "boolean":
                return Value(v.col != 0, BOOLEAN)
            source = v.col if v.kind.name in ("integer", "decimal", "double", "boolean", "dateTime", "date") else F.trim(lexical(v))
            if name == "integer" and v.kind.name in ("box", "string"):
                # a number is cut at its point; a string has to be an integer
                whole = F.when(source.rlike(r"^[+-]?\d+$"), source.try_cast("bigint"))
                return Value(F.when(v.col["dt"].isin(*NUMERIC), source.try_cast("double").cast("bigint")).otherwise(whole) if v.kind.name == "box" else whole, INTEGER)
            if name == "decimal" and v.kind.name in ("box", "string"):
                of_double = v.col["dt"].isin(XSD + "double", XSD + "float") if v.kind.name == "box" else F.lit(False)
                return Value(F.when(source.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$") | of_double, source.try_cast(NATIVE[name])), DECIMAL)
            if name in ("dateTime", "date") and v.kind.name in ("box", "string"):
                return self._time_cast(name, v, source)
            return Value(source.try_cast(NATIVE[name]), Kind(name))
        if iri.startswith(XSD) and len(args) == 1 and (name in RANGES or name == "float" or iri in DURATIONS):
            return self._derived(name, args[0])
        if iri in self.functions:
            return self.functions[iri](*args)
        raise Unsupported(f"function <{iri}>")

    def _time_cast(self, name: str, v: Value, source: Column) -> Value:
        """A zone stays in the lexical form; a date of a dateTime is its local day."""
        zone = r"(Z|[+-]\d\d:\d\d)?$"
        day, time = r"^\d{4}-\d\d-\d\d", r"T\d\d:\d\d:\d\d(?:\.\d+)?"
        if name == "date":
            shown = F.when(source.rlike(day + f"(?:{time})?" + zone), F.concat(F.substring(source, 1, 10), F.regexp_extract(source, zone, 1)))
        else:
            shown = F.when(source.rlike(day + time + zone), source).when(source.rlike(day + zone), F.concat(F.substring(source, 1, 10), F.lit("T00:00:00"), F.regexp_extract(source, zone, 1)))
        valid = shown.isNotNull() & F.regexp_replace(shown, zone, "").try_cast("timestamp").isNotNull()
        return Value(F.when(valid, struct(K_LITERAL, shown, XSD + name)), BOXED)

    def _derived(self, name: str, v: Value) -> Value:
        """Casts to the types that have no native kind: boxed, null out of their range."""
        if XSD + name in DURATIONS:
            text = F.trim(lexical(v))
            form = text.rlike(DURATION)
            if name == "dayTimeDuration":
                form = form & ~text.rlike(r"^-?P[^T]*[YM]")
            if name == "yearMonthDuration":
                form = form & ~text.rlike("[DT]")
            return Value(F.when(form, struct(K_LITERAL, text, XSD + name)), BOXED)
        if name == "float":
            n = self._function(XSD + "double", [v]).col.cast("float")
            return Value(F.when(n.isNotNull(), struct(K_LITERAL, F.when(n == float("inf"), "INF").when(n == float("-inf"), "-INF").otherwise(n.cast("string")), XSD + name)), BOXED)
        low, high = RANGES[name]
        n = self._function(XSD + "integer", [v]).col
        if v.kind.name in ("box", "string"):
            # beyond 64 bits only text tells the value
            n = F.coalesce(n.cast("decimal(38,0)"), F.when(F.trim(lexical(v)).rlike(r"^[+-]?\d+$"), F.trim(lexical(v)).try_cast("decimal(38,0)")))
        inside = F.lit(True)
        if low is not None:
            inside = inside & (n.cast("decimal(38,0)") >= F.lit(str(low)).cast("decimal(38,0)"))
        if high is not None:
            inside = inside & (n.cast("decimal(38,0)") <= F.lit(str(high)).cast("decimal(38,0)"))
        return Value(F.when(inside & n.isNotNull(), struct(K_LITERAL, n.cast("string"), XSD + name)), BOXED)

    # tests and parts of terms
    def _is(self, v: Value, k: int) -> Value:
        if v.kind.name == "box":
            return Value(v.col["k"] == k, BOOLEAN)
        return Value(F.when(v.col.isNotNull(), (K_IRI if v.kind.name == "iri" else K_LITERAL) == k), BOOLEAN)

    def _f_isiri(self, v):
        return self._is(v, K_IRI)

    def _f_isblank(self, v):
        return self._is(v, K_BNODE)

    def _f_isliteral(self, v):
        return self._is(v, K_LITERAL)

    def _f_istriple(self, v):
        return self._is(v, K_TRIPLE)

    def _f_isnumeric(self, v):
        return Value(F.when(v.col.isNotNull(), number(v.col).isNotNull() if v.kind.name == "box" else F.lit(v.kind.numeric)), BOOLEAN)

    def _f_sameterm(self, a, b):
        plain = a.kind == b.kind != BOXED and a.own is None and b.own is None
        return Value(a.col == b.col if plain else same_term(box(a), box(b)), BOOLEAN)

    def _f_str(self, v):
        return Value(F.when(v.col["k"].isin(K_IRI, K_LITERAL), v.col["v"]) if v.kind.name == "box" else lexical(v), TEXT)

    def _part(self, v: Value, name: str) -> Value:
        literal = F.when(v.col["k"] == K_LITERAL, v.col[name]) if v.kind.name == "box" else F.when(v.col.isNotNull(), "") if v.kind.name != "iri" else F.lit(None).cast("string")
        return Value(literal, TEXT)

    def _f_lang(self, v):
        return self._part(v, "lang")

    def _f_langdir(self, v):
        return self._part(v, "dir")

    def _f_haslang(self, v):
        return Value(self._part(v, "lang").col != "", BOOLEAN)

    def _f_haslangdir(self, v):
        return Value(self._part(v, "dir").col != "", BOOLEAN)

    def _f_datatype(self, v):
        if v.kind.name == "box":
            return Value(F.when(v.col["k"] == K_LITERAL, v.col["dt"]), Kind("iri"))
        return Value(F.when(v.col.isNotNull() & F.lit(v.kind.name != "iri"), XSD + v.kind.name), Kind("iri"))

    def _f_langmatches(self, tag, wanted):
        t, w = F.lower(self._string(tag)), F.lower(self._string(wanted))
        return Value(F.when(w == "*", t != "").otherwise((t == w) | t.startswith(F.concat(w, F.lit("-")))), BOOLEAN)

    def _f_iri(self, v):
        if v.kind.name == "iri":
            return v
        text = lexical(v)
        return Value(F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(self.base), text)), Kind("iri"))

    def _f_bnode(self, label: Value | None = None):
        return Value(struct(K_BNODE, F.concat(F.lit("b"), F.md5(self._string(label))) if label else F.concat(F.lit("u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))), BOXED)

    def _f_strdt(self, v, dt):
        return Value(F.when(self._string(v).isNotNull(), struct(K_LITERAL, self._string(v), lexical(dt))), BOXED)

    def _f_strlang(self, v, lang):
        return Value(F.when(self._string(v).isNotNull(), struct(K_LITERAL, self._string(v), LANG_STRING, F.lower(self._string(lang)))), BOXED)

    def _f_strlangdir(self, v, lang, direction):
        return Value(F.when(self._string(v).isNotNull() & self._string(direction).isin("ltr", "rtl"), struct(K_LITERAL, self._string(v), DIR_STRING, F.lower(self._string(lang)), self._string(direction))), BOXED)

    def _f_triple(self, s, p, o):
        return Value(triple_text(box(s), box(p), box(o)), BOXED)

    def _f_subject(self, v):
        return Value(triple_part(box(v), 0), BOXED)

    def _f_predicate(self, v):
        return Value(triple_part(box(v), 1), BOXED)

    def _f_object(self, v):
        return Value(triple_part(box(v), 2), BOXED)

    # strings
    def _f_strlen(self, v):
        return Value(F.length(self._string(v)).cast("bigint"), INTEGER)

    def _f_ucase(self, v):
        return self._like(v, F.upper(self._string(v)))

    def _f_lcase(self, v):
        return self._like(v, F.lower(self._string(v)))

    def _f_substr(self, v, start, length=None):
        at = F.floor(self._number(start).col + 0.5).cast("int")
        text = self._string(v)
        if length is None:
            return self._like(v, F.substr(text, F.greatest(at, F.lit(1)), F.length(text)))
        end = at + F.floor(self._number(length).col + 0.5).cast("int")
        return self._like(v, F.substr(text, F.greatest(at, F.lit(1)), F.greatest(end - F.greatest(at, F.lit(1)), F.lit(0))))

    def _f_strstarts(self, a, b):
        return Value(F.startswith(self._string(a), self._string(b)), BOOLEAN)

    def _f_strends(self, a, b):
        return Value(F.endswith(self._string(a), self._string(b)), BOOLEAN)

    def _f_contains(self, a, b):
        return Value(F.contains(self._string(a), self._string(b)), BOOLEAN)

    def _cut(self, a: Value, b: Value, before: bool) -> Value:
        x, y = self._string(a), self._string(b)
        at = F.instr(x, y)
        part = F.substr(x, F.lit(1), at - 1) if before else F.substr(x, at + F.length(y), F.length(x))
        if a.kind.name != "box":
            return Value(F.when(at > 0, part).when(x.isNotNull() & y.isNotNull(), ""), TEXT)
        return Value(F.when(at > 0, self._like(a, part).col).when(x.isNotNull() & y.isNotNull(), struct(K_LITERAL, "", STRING)), BOXED)

    def _f_strbefore(self, a, b):
        return self._cut(a, b, True)

    def _f_strafter(self, a, b):
        return self._cut(a, b, False)

    def _f_encode_for_uri(self, v):
        c = F.url_encode(self._string(v))
        for raw, shown in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            c = F.replace(c, F.lit(raw), F.lit(shown))
        return Value(c, TEXT)

    def _f_concat(self, *args):
        if not args:
            return Value(F.lit(""), TEXT)
        joined = F.concat(*[self._string(a) for a in args])
        if all(a.kind == TEXT for a in args):
            return Value(joined, TEXT)
        first = box(args[0])
        common = F.lit(True)
        for a in args[1:]:
            b = box(a)
            common = common & (b["lang"] == first["lang"]) & (b["dir"] == first["dir"]) & (b["dt"] == first["dt"])
        return Value(F.when(joined.isNotNull(), F.when(common, struct(K_LITERAL, joined, first["dt"], first["lang"], first["dir"])).otherwise(struct(K_LITERAL, joined, STRING))), BOXED)

    # numbers
    def _rounded(self, v: Value, whole: Callable[[Column], Column]) -> Value:
        n = self._number(v)
        return n if n.kind == INTEGER else Value(whole(n.col).cast(NATIVE[n.kind.name]), n.kind)

    def _f_abs(self, v):
        n = self._number(v)
        return Value(F.abs(n.col), n.kind)

    def _f_ceil(self, v):
        return self._rounded(v, F.ceil)

    def _f_floor(self, v):
        return self._rounded(v, F.floor)

    def _f_round(self, v):
        return self._rounded(v, lambda c: F.floor(c + F.lit(0.5)))

    def _f_rand(self):
        return Value(F.rand(), DOUBLE)

    # times
    def _f_now(self):
        return Value(F.lit(self.now).cast("timestamp"), Kind("dateTime"))

    def _field(self, v: Value, of: Callable[[Column], Column], group: int) -> Value:
        """A part of a date or time as it is written, whatever its zone."""
        if v.own is None and v.kind.name != "box":
            return Value(of(self._time(v)).cast("bigint"), INTEGER)
        return Value(F.regexp_extract(self._written(v), CLOCK, group).try_cast("bigint"), INTEGER)

    def _written(self, v: Value) -> Column:
        b = box(v)
        return F.when((b["k"] == K_LITERAL) & b["dt"].isin(XSD + "dateTime", XSD + "date", XSD + "dateTimeStamp") & b["v"].rlike(CLOCK) & instant(b).isNotNull(), b["v"])

    def _f_year(self, v):
        return self._field(v, F.year, 1)

    def _f_month(self, v):
        return self._field(v, F.month, 2)

    def _f_day(self, v):
        return self._field(v, F.dayofmonth, 3)

    def _f_hours(self, v):
        return self._field(v, F.hour, 4)

    def _f_minutes(self, v):
        return self._field(v, F.minute, 5)

    def _f_seconds(self, v):
        if v.own is None and v.kind.name != "box":
            return Value(F.date_part(F.lit("SECOND"), self._time(v)).cast("decimal(38,18)"), DECIMAL)
        return Value(F.regexp_extract(self._written(v), CLOCK, 6).try_cast("decimal(38,18)"), DECIMAL)

    def _f_tz(self, v):
        return Value(F.when(self._time(v).isNotNull(), F.regexp_extract(lexical(v), r"(Z|[+-]\d\d:\d\d)$", 1)), TEXT)

    def _f_timezone(self, v):
        zone = self._f_tz(v).col
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        text = F.when(zone.isin("Z", "+00:00", "-00:00"), "PT0S").when(zone != "", F.concat(F.when(zone.startswith("-"), "-PT").otherwise("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")))
        return Value(F.when(text.isNotNull(), struct(K_LITERAL, text, XSD + "dayTimeDuration")), BOXED)

    # digests and identifiers
    def _hash(self, v: Value, of: Callable[[Column], Column]) -> Value:
        return Value(of(self._string(v)), TEXT)

    def _f_md5(self, v):
        return self._hash(v, F.md5)

    def _f_sha1(self, v):
        return self._hash(v, F.sha1)

    def _f_sha256(self, v):
        return self._hash(v, lambda c: F.sha2(c, 256))

    def _f_sha384(self, v):
        return self._hash(v, lambda c: F.sha2(c, 384))

    def _f_sha512(self, v):
        return self._hash(v, lambda c: F.sha2(c, 512))

    def _f_uuid(self):
        return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), Kind("iri"))

    def _f_struuid(self):
        return Value(F.uuid(), TEXT)
