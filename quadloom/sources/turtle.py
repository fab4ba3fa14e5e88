"""Turtle and TriG text of small graphs, written by the driver."""

from __future__ import annotations

import re

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quadloom.functions.terms import K_BNODE, K_IRI, K_LITERAL, STRING
from quadloom.sparql.ast import RDF, XSD

LOCAL = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


#: Formats by file name extension (fixed values).
EXTENSIONS = {".nt": "nt", ".nq": "nquads", ".ttl": "turtle", ".n3": "turtle", ".trig": "trig", ".rdf": "rdfxml", ".xml": "rdfxml", ".owl": "rdfxml", ".jsonld": "jsonld"}


def format_of(path: str) -> str:
    suffix = Path(path).suffix
    if suffix not in EXTENSIONS:
        raise ValueError(f"no format is known for {path}")
    return EXTENSIONS[suffix]


def read(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, form: str | None = None, base: str = "") -> DataFrame:
    """Quads of a file. Lines of N-Triples and N-Quads are read by all executors; any other document, one unit, by the driver."""
    from quadloom.sources import ntriples

    form = form or format_of(path)
    if form in ("nt", "nquads"):
        return ntriples.read(spark, path)
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return parsed(spark, text, form, prefixes, base)


def parsed(spark: SparkSession, text: str, form: str, prefixes: dict[str, str] | None = None, base: str = "") -> DataFrame:
    """Quads of a document's text."""
    from quadloom.sources import ntriples
    from quadloom.sources.documents import parse_jsonld, parse_rdfxml
    from quadloom.sources.graphs import quads_frame
    from quadloom.sparql.parser import parse_turtle

    if form in ("nt", "nquads"):
        return ntriples.nquads_rows(spark.createDataFrame([(line,) for line in text.splitlines()], "value string"))
    if form in ("rdfxml", "jsonld"):
        return quads_frame(spark, (parse_rdfxml if form == "rdfxml" else parse_jsonld)(text, base))
    if form not in ("turtle", "trig"):
        raise ValueError(f"no format {form}")
    return quads_frame(spark, parse_turtle(text, prefixes or {}, base))


def _shortened(iri: str, prefixes: dict[str, str]) -> str:
    if iri == RDF + "type":
        return "a"
    for name, space in prefixes.items():
        if iri.startswith(space) and LOCAL.fullmatch(iri[len(space) :]):
            return f"{name}:{iri[len(space) :]}"
    return f"<{iri}>"


def _text(term, prefixes: dict[str, str], verb: bool = False) -> str:
    if term.k == K_IRI:
        short = _shortened(term.v, prefixes)
        return f"<{term.v}>" if short == "a" and not verb else short
    if term.k == K_BNODE:
        return f"_:{term.v}"
    if term.k != K_LITERAL:
        return term.v
    if term.dt == XSD + "integer" and re.fullmatch(r"[+-]?\d+", term.v) or term.dt == XSD + "boolean" and term.v in ("true", "false") or term.dt == XSD + "decimal" and re.fullmatch(r"[+-]?\d*\.\d+", term.v):
        return term.v
    quoted = term.v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    if term.lang:
        return f'"{quoted}"@{term.lang}' + (f"--{term.dir}" if term.dir else "")
    return f'"{quoted}"' if term.dt == STRING else f'"{quoted}"^^{_shortened(term.dt, prefixes)}'


def write(quads: DataFrame, prefixes: dict[str, str], trig: bool = False) -> str:
    """Subjects in order, predicates and objects grouped; named graphs in TriG only."""
    graphs: dict[str, dict[tuple, dict[str, list]]] = {}
    for r in quads.collect():
        graphs.setdefault(r.g, {}).setdefault((r.s.k, r.s.v), {}).setdefault(r.p, []).append(r.o)
    if not trig and set(graphs) - {""}:
        raise ValueError("named graphs need TriG")
    out = [f"@prefix {name}: <{space}> ." for name, space in sorted(prefixes.items())]
    for g in sorted(graphs):
        lines = []
        for (k, v), facts in sorted(graphs[g].items()):
            subject = _shortened(v, prefixes) if k == K_IRI else f"_:{v}"
            verbs = sorted(facts, key=lambda p: (p != RDF + "type", p))
            body = " ;\n    ".join(f"{_shortened(p, prefixes)} {' , '.join(sorted(_text(o, prefixes) for o in facts[p]))}" for p in verbs)
            lines.append(f"{'<' + v + '>' if subject == 'a' else subject} {body} .")
        out += [""] + (lines if not g else [f"{_shortened(g, prefixes)} {{", *lines, "}"])
    return "\n".join(out) + "\n"


def json_term(term) -> dict:
    """One binding of the SPARQL JSON results format."""
    if term.k == K_IRI:
        return {"type": "uri", "value": term.v}
    if term.k == K_BNODE:
        return {"type": "bnode", "value": term.v}
    if term.k == K_LITERAL:
        more = {"xml:lang": term.lang} | ({"its:dir": term.dir} if term.dir else {}) if term.lang else {} if term.dt == STRING else {"datatype": term.dt}
        return {"type": "literal", "value": term.v} | more
    return {"type": "triple", "value": term.v}
