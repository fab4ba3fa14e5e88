"""Terms as columns: native where the type is known when planning, boxed structs where it is not."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.sparql.ast import RDF, XSD, BNode, IRI, Lit, TripleTerm

BOX = "struct<k:int,v:string,dt:string,lang:string,dir:string>"
K_BNODE, K_IRI, K_LITERAL, K_TRIPLE = 1, 2, 3, 4
STRING, LANG_STRING, DIR_STRING = XSD + "string", RDF + "langString", RDF + "dirLangString"
INTEGERS = tuple(XSD + n for n in "integer nonPositiveInteger negativeInteger long int short byte nonNegativeInteger unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger".split())
EXACT = (*INTEGERS, XSD + "decimal")
NUMERIC = (*EXACT, XSD + "float", XSD + "double")
#: Native kinds, their Spark types and datatypes.
NATIVE = {"integer": "bigint", "decimal": "decimal(38,18)", "double": "double", "string": "string", "boolean": "boolean", "dateTime": "timestamp", "date": "date"}


@dataclass(frozen=True)
class Kind:
    """name: 'box', 'iri' (column: what follows the prefix), or one of NATIVE."""

    name: str
    prefix: str = ""

    @property
    def numeric(self) -> bool:
        return self.name in ("integer", "decimal", "double")


BOXED = Kind("box")


@dataclass(frozen=True)
class Value:
    """own: the boxed term itself, of a constant whose native value does not tell its lexical form."""

    col: Column
    kind: Kind
    own: Column | None = None


def struct(k, v, dt="", lang="", direction="") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(k).cast("int").alias("k"), as_col(v).alias("v"), as_col(dt).alias("dt"), as_col(lang).alias("lang"), as_col(direction).alias("dir"))


def lexical(value: Value) -> Column:
    """STR() of a native value."""
    c, name = value.col, value.kind.name
    if value.own is not None:
        return value.own["v"]
    if name == "iri":
        return F.concat(F.lit(value.kind.prefix), c.cast("string"))
    if name == "box":
        return c["v"]
    if name == "dateTime":
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""))
    if name == "decimal":
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if name == "double":
        return double_text(c)
    return c.cast("string")


def double_text(c: Column) -> Column:
    return F.when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").otherwise(c.cast("string"))


def box(value: Value) -> Column:
    if value.own is not None:
        return value.own
    if value.kind.name == "box":
        return value.col
    made = struct(K_IRI, lexical(value)) if value.kind.name == "iri" else struct(K_LITERAL, lexical(value), XSD + value.kind.name)
    return F.when(value.col.isNotNull(), made)


def nt_text(b: Column) -> Column:
    """Canonical N-Triples 1.2 text of a boxed term."""
    v = b["v"]
    quoted = v
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(shown))
    suffix = F.when(b["dt"] == STRING, "").when(b["lang"] != "", F.concat(F.lit("@"), b["lang"], F.when(b["dir"] != "", F.concat(F.lit("--"), b["dir"])).otherwise(""))).otherwise(F.concat(F.lit("^^<"), b["dt"], F.lit(">")))
    return F.when(b["k"] == K_IRI, F.concat(F.lit("<"), v, F.lit(">"))).when(b["k"] == K_BNODE, F.concat(F.lit("_:"), v)).when(b["k"] == K_TRIPLE, v).when(b["k"] == K_LITERAL, F.concat(F.lit('"'), quoted, F.lit('"'), suffix))


def parse_nt(text: Column) -> Column:
    """Boxed term of N-Triples text; null if it is none."""
    literal = r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+?)(?:--(ltr|rtl))?|\^\^<([^>]*)>)?$'
    raw = F.regexp_extract(text, literal, 1)
    for shown, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        raw = F.replace(raw, F.lit(shown), F.lit(plain)) if shown != "\\n" else F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\u0001")), F.lit(shown), F.lit(plain))
    raw = F.replace(raw, F.lit("\u0001"), F.lit("\\"))
    lang, direction, dt = (F.regexp_extract(text, literal, i) for i in (2, 3, 4))
    datatype = F.when(direction != "", DIR_STRING).when(lang != "", LANG_STRING).when(dt != "", dt).otherwise(STRING)
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    return (
        F.when(text.startswith("<<("), struct(K_TRIPLE, text))
        .when(text.startswith("<"), struct(K_IRI, inner))
        .when(text.startswith("_:"), struct(K_BNODE, F.substr(text, F.lit(3), F.length(text))))
        .when(text.rlike(literal), struct(K_LITERAL, raw, datatype, lang, direction))
    )


def triple_text(s: Column, p: Column, o: Column) -> Column:
    """Boxed triple term; null if a part is."""
    text = F.concat(F.lit("<<( "), nt_text(s), F.lit(" "), nt_text(p), F.lit(" "), nt_text(o), F.lit(" )>>"))
    return F.when(text.isNotNull(), struct(K_TRIPLE, text))


def triple_part(b: Column, part: int) -> Column:
    """Subject, predicate or object (0, 1, 2) of a boxed triple term; subject and predicate hold no blanks."""
    return F.when(b["k"] == K_TRIPLE, parse_nt(F.regexp_extract(b["v"], r"(?s)^<<\( (\S+) (\S+) (.*) \)>>$", part + 1)))


#: Lexical forms that the native value of a constant gives back.
CANONICAL = {"integer": r"-?(0|[1-9]\d*)", "decimal": r"-?(0|[1-9]\d*)\.(0|\d*[1-9])", "boolean": "true|false", "date": r"\d{4}-\d\d-\d\d", "dateTime": r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{0,5}[1-9])?"}


def constant(term) -> Value:
    """A ground term, native where its datatype is; its lexical form is kept beside where the native value loses it."""
    if isinstance(term, IRI):
        return Value(F.lit(term.v), Kind("iri"))
    if isinstance(term, Lit):
        name = term.dt.removeprefix(XSD)
        if term.dt == STRING:
            return Value(F.lit(term.v), Kind("string"))
        if term.dt.startswith(XSD) and name in NATIVE and fits(name, term.v):
            plain = re.fullmatch(CANONICAL.get(name, "(?!)"), term.v) and term.v != "-0"
            return Value(F.lit(term.v).try_cast(NATIVE[name]), Kind(name), None if plain else boxed_constant(term))
    return Value(boxed_constant(term), BOXED)


def fits(name: str, text: str) -> bool:
    """Whether a lexical form is one of the datatype and its native type holds the value."""
    if name == "integer":
        return bool(re.fullmatch(r"[+-]?\d+", text)) and -(1 << 63) <= int(text) < 1 << 63
    if name == "decimal":
        whole, _, part = text.lstrip("+-").partition(".")
        return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", text)) and len(whole.lstrip("0")) <= 20 and len(part.rstrip("0")) <= 18
    if name == "double":
        return bool(re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN", text))
    if name == "boolean":
        return text in ("true", "false", "1", "0")
    if name == "date":
        return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", text))
    return bool(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?", text))


def boxed_constant(term) -> Column:
    if isinstance(term, IRI):
        return struct(K_IRI, term.v)
    if isinstance(term, BNode):
        return struct(K_BNODE, term.v)
    if isinstance(term, Lit):
        return struct(K_LITERAL, term.v, term.dt, term.lang.lower(), term.dir)
    if isinstance(term, TripleTerm):
        return triple_text(*(boxed_constant(x) for x in (term.s, term.p, term.o)))
    raise TypeError(f"{term} is not a ground term")


def number(b: Column) -> Column:
    return F.when((b["k"] == K_LITERAL) & b["dt"].isin(*NUMERIC), b["v"].try_cast("double"))


def exact(b: Column) -> Column:
    return F.when((b["k"] == K_LITERAL) & b["dt"].isin(*EXACT) & ~b["v"].rlike("[eE]"), F.trim(b["v"]).try_cast("decimal(38,18)"))


def digits(b: Column) -> Column:
    """(negative, length, digits) of an integer of any size, without leading zeros; null if it is none."""
    text = F.when((b["k"] == K_LITERAL) & b["dt"].isin(*INTEGERS) & b["v"].rlike(r"^[+-]?\d+$"), F.regexp_replace(b["v"], r"^[+-]?0*(?=\d)", ""))
    return F.when(text.isNotNull(), F.struct((b["v"].startswith("-") & (text != "0")).alias("negative"), F.length(text).alias("n"), text.alias("digits")))


def _below(p: Column, q: Column) -> Column:
    """Whether one digits() is less than another."""
    smaller = lambda x, y: F.struct(x["n"], x["digits"]) < F.struct(y["n"], y["digits"])
    return F.when(p["negative"] != q["negative"], p["negative"]).when(p["negative"], smaller(q, p)).otherwise(smaller(p, q))


#: A duration as text: sign, years, months, days, hours, minutes, seconds.
DURATION = r"^(-)?P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
DURATIONS = (XSD + "duration", XSD + "dayTimeDuration", XSD + "yearMonthDuration")


def duration(b: Column) -> Column:
    """(months, seconds) of a duration; null if it is none."""
    # one match gives all parts behind a mark, which no text that is left as it is begins with; each begins with a zero,
    # as a cast of nothing to a number throws and catches, which costs more than all the rest
    told = F.when((b["k"] == K_LITERAL) & b["dt"].isin(*DURATIONS) & (b["v"].startswith("P") | b["v"].startswith("-P")), F.regexp_replace(b["v"], DURATION, "=$1,0$2,0$3,0$4,0$5,0$6,0$7,"))

    def made(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("decimal(28,9)"), F.lit(0))
        sign = F.when(F.get(parts, F.lit(0)) == "=-", -1).otherwise(1)
        months, seconds = part(1) * 12 + part(2), part(3) * 86400 + part(4) * 3600 + part(5) * 60 + part(6)
        return F.when(F.get(parts, F.lit(0)).isin("=", "=-"), F.struct((months * sign).cast("decimal(38,9)").alias("months"), (seconds * sign).cast("decimal(38,9)").alias("seconds")))

    return F.get(F.transform(F.array(F.split(told, ",")), made), F.lit(0))


def instant(b: Column) -> Column:
    return F.when((b["k"] == K_LITERAL) & b["dt"].isin(XSD + "dateTime", XSD + "date", XSD + "dateTimeStamp"), b["v"].try_cast("timestamp"))


def _truth(b: Column) -> Column:
    return F.when((b["k"] == K_LITERAL) & (b["dt"] == XSD + "boolean"), b["v"].try_cast("boolean"))


def text_of(b: Column) -> Column:
    return F.when((b["k"] == K_LITERAL) & b["dt"].isin(STRING, LANG_STRING, DIR_STRING), b["v"])


def box_order(b: Column) -> Column:
    """Total order of terms: unbound, blank nodes, IRIs, literals (numbers, times, then text), triple terms."""
    return F.struct(F.coalesce(b["k"], F.lit(0)), F.when(number(b).isNotNull(), 0).when(instant(b).isNotNull(), 1).otherwise(2), number(b), instant(b), b["v"], b["dt"], b["lang"], b["dir"])


def order_key(value: Value) -> Column:
    return box_order(value.col) if value.kind.name == "box" else value.col


def equal(a: Value, b: Value) -> Column:
    """SPARQL =, null where it is an error."""
    x, y = a.kind, b.kind
    if x.name == y.name == "iri":
        return a.col == b.col if x.prefix == y.prefix and x.prefix else lexical(a) == lexical(b)
    if x.name != "box" and (x == y or (x.numeric and y.numeric)):
        return a.col == b.col
    if {x.name, y.name} == {"date", "dateTime"}:
        return a.col.cast("timestamp") == b.col.cast("timestamp")
    if x.name != "box" and y.name != "box":
        return F.when(a.col.isNotNull() & b.col.isNotNull(), False) if "iri" in (x.name, y.name) else F.lit(None).cast("boolean")
    p, q = box(a), box(b)
    plain = (STRING, LANG_STRING, DIR_STRING)
    return (
        F.when(p.isNull() | q.isNull(), None)
        .when(exact(p).isNotNull() & exact(q).isNotNull(), exact(p) == exact(q))
        .when(_seldom(p, q), _apart(p, q, _seldom_equal))
        .when(number(p).isNotNull() & number(q).isNotNull(), number(p) == number(q))
        .when(instant(p).isNotNull() & instant(q).isNotNull(), instant(p) == instant(q))
        .when(_truth(p).isNotNull() & _truth(q).isNotNull(), _truth(p) == _truth(q))
        .when(same_term(p, q), True)
        .when((p["k"] == K_LITERAL) & (q["k"] == K_LITERAL) & ~(p["dt"].isin(*plain) & q["dt"].isin(*plain)), None)
        .otherwise(False)
    )


def same_term(p: Column, q: Column) -> Column:
    return (p["k"] == q["k"]) & (p["v"] == q["v"]) & (p["dt"] == q["dt"]) & (F.lower(p["lang"]) == F.lower(q["lang"])) & (p["dir"] == q["dir"])


def less(a: Value, b: Value) -> Column:
    """a < b, null where the two cannot be compared."""
    x, y = a.kind, b.kind
    if x.name not in ("box", "iri") and (x == y or (x.numeric and y.numeric)):
        return a.col < b.col
    if {x.name, y.name} == {"date", "dateTime"}:
        return a.col.cast("timestamp") < b.col.cast("timestamp")
    if x.name != "box" and y.name != "box":
        return F.lit(None).cast("boolean")
    p, q = box(a), box(b)
    string = lambda c: F.when((c["k"] == K_LITERAL) & (c["dt"] == STRING), c["v"])
    out = F.when(exact(p).isNotNull() & exact(q).isNotNull(), exact(p) < exact(q))
    out = out.when(_seldom(p, q), _apart(p, q, _seldom_less))
    for of in (number, instant, string, _truth):
        out = out.when(of(p).isNotNull() & of(q).isNotNull(), of(p) < of(q))
    return out


def _seldom(p: Column, q: Column) -> Column:
    """Both integers (that exact() does not hold), or both durations."""
    kinds = lambda names: p["dt"].isin(*names) & q["dt"].isin(*names)
    return (p["k"] == K_LITERAL) & (q["k"] == K_LITERAL) & (kinds(INTEGERS) | kinds(DURATIONS))


def _apart(p: Column, q: Column, compare) -> Column:
    """A comparison that is seldom reached, inside a function of its own so that it does not weigh on the code of a stage.

    ``compare`` gets the digits and durations of both, each made once a row.
    """
    made = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), lambda x: F.struct(digits(x["p"]).alias("x"), digits(x["q"]).alias("y"), duration(x["p"]).alias("u"), duration(x["q"]).alias("w")))
    return F.transform(made, lambda m: compare(m["x"], m["y"], m["u"], m["w"]))[0]


def _seldom_equal(x: Column, y: Column, u: Column, w: Column) -> Column:
    return F.coalesce(x == y, u == w)


def _seldom_less(x: Column, y: Column, u: Column, w: Column) -> Column:
    # months and seconds cannot be compared with each other
    return F.when(x.isNotNull() & y.isNotNull(), _below(x, y)).otherwise(F.when(u["months"] == w["months"], u["seconds"] < w["seconds"]).when(u["seconds"] == w["seconds"], u["months"] < w["months"]))


def ebv(value: Value) -> Column:
    """Effective boolean value; null is an error."""
    c, name = value.col, value.kind.name
    if name == "boolean":
        return c
    if name == "string":
        return F.length(c) > 0
    if name in ("integer", "decimal"):
        return c != 0
    if name == "double":
        return (c != 0) & ~F.isnan(c)
    if name == "box":
        n = number(c)
        return F.when(c["dt"] == XSD + "boolean", c["v"].try_cast("boolean")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(text_of(c).isNotNull(), F.length(c["v"]) > 0)
    return F.lit(None).cast("boolean")
