"""Terms and syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"


@dataclass(frozen=True, order=True)
class Var:
    name: str


@dataclass(frozen=True, order=True)
class IRI:
    v: str


@dataclass(frozen=True, order=True)
class BNode:
    v: str


@dataclass(frozen=True, order=True)
class Lit:
    v: str
    dt: str = XSD + "string"
    lang: str = ""
    dir: str = ""


@dataclass(frozen=True)
class TripleTerm:
    s: Any
    p: Any
    o: Any


Term = Var | IRI | BNode | Lit | TripleTerm


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Any  # a term or a path
    o: Term


# paths
@dataclass(frozen=True)
class Seq:
    a: Any
    b: Any


@dataclass(frozen=True)
class Alt:
    a: Any
    b: Any


@dataclass(frozen=True)
class Inv:
    a: Any


@dataclass(frozen=True)
class Mod:
    a: Any
    kind: str  # * + ?


@dataclass(frozen=True)
class NegSet:
    forward: tuple[str, ...]
    inverse: tuple[str, ...]
    has_forward: bool
    has_inverse: bool


# patterns
@dataclass
class Bgp:
    triples: list[Triple]


@dataclass
class Group:
    parts: list


@dataclass
class Optional_:
    pattern: Any


@dataclass
class Union_:
    branches: list


@dataclass
class Minus:
    pattern: Any


@dataclass
class Filter:
    expr: Any


@dataclass
class Bind:
    expr: Any
    var: str


@dataclass
class Values:
    vars: list[str]
    rows: list[list]


@dataclass
class Graph:
    name: Term
    pattern: Any


@dataclass
class Service:
    silent: bool
    name: Term
    pattern: Any


@dataclass
class SubSelect:
    query: Query


# expressions
@dataclass(frozen=True)
class Call:
    name: str  # built-in in upper case, an operator, or an IRI in <>
    args: tuple


@dataclass(frozen=True)
class In:
    expr: Any
    options: tuple
    negated: bool


@dataclass
class Exists:
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class Agg:
    name: str
    distinct: bool
    expr: Any  # None: *
    separator: str = " "


@dataclass
class Query:
    form: str
    pattern: Any = None
    projection: list | None = None  # (name, expression or None); None: *
    distinct: bool = False
    template: list[Triple] = field(default_factory=list)
    describe: list = field(default_factory=list)
    from_: list[str] = field(default_factory=list)
    from_named: list[str] = field(default_factory=list)
    group: list = field(default_factory=list)  # (expression, name or None)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    values: Values | None = None


@dataclass
class Update:
    op: str
    graph: Any = None
    target: Any = None
    silent: bool = False
    delete: list = field(default_factory=list)  # (graph or None, triple)
    insert: list = field(default_factory=list)
    pattern: Any = None
    using: list[str] = field(default_factory=list)
    using_named: list[str] = field(default_factory=list)
    with_: str | None = None
