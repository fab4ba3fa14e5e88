"""RDF/XML and JSON-LD documents, read by the driver: a document is one unit."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import count
from urllib.parse import urljoin
from xml.etree import ElementTree

from quadloom.sparql.ast import RDF, XSD, BNode, IRI, Lit, Triple

XML = "{http://www.w3.org/XML/1998/namespace}"
STRING, LANG_STRING, DIR_STRING = XSD + "string", RDF + "langString", RDF + "dirLangString"
#: Attributes and element names that are syntax and no property (fixed values).
SYNTAX = {f"{{{RDF}}}{n}" for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "RDF", "li", "Description")}


class DocumentError(ValueError):
    pass


def literal(text: str, lang: str = "", datatype: str = "", direction: str = "") -> Lit:
    if lang:
        return Lit(text, DIR_STRING if direction else LANG_STRING, lang, direction)
    return Lit(text, datatype or STRING)


class _Xml:
    """Node elements and property elements take turns."""

    def __init__(self, base: str):
        self.base, self.out, self.fresh, self.ids = base, [], count(), set()

    def add(self, s, p: str, o) -> None:
        self.out.append((None, Triple(s, IRI(p), o)))

    def blank(self) -> BNode:
        return BNode(f"x{next(self.fresh)}")

    @staticmethod
    def iri(tag: str) -> str:
        if not tag.startswith("{"):
            raise DocumentError(f"{tag} has no namespace")
        return tag[1:].replace("}", "", 1)

    def own(self, e, base: str, lang: str) -> tuple[str, str]:
        """Base and language that hold in an element."""
        return urljoin(base, e.get(XML + "base", "")) if e.get(XML + "base") is not None else base, e.get(XML + "lang", lang)

    def subject(self, e, base: str, about: str = "about"):
        told = [n for n in (about, "ID", "nodeID") if e.get(f"{{{RDF}}}{n}") is not None]
        if len(told) > 1:
            raise DocumentError(f"both rdf:{told[0]} and rdf:{told[1]}")
        if not told:
            return self.blank()
        value = e.get(f"{{{RDF}}}{told[0]}")
        if told[0] == "nodeID":
            return BNode(f"n{value}")
        return self.named(value, base) if told[0] == "ID" else IRI(urljoin(base, value))

    def named(self, name: str, base: str) -> IRI:
        iri = f"{base.partition('#')[0]}#{name}"
        if iri in self.ids:
            raise DocumentError(f"rdf:ID {name} twice")
        self.ids.add(iri)
        return IRI(iri)

    def attributes(self, s, e, lang: str, base: str) -> None:
        for name, value in e.attrib.items():
            if name == f"{{{RDF}}}type":
                self.add(s, RDF + "type", IRI(urljoin(base, value)))
            elif not name.startswith(XML) and name not in SYNTAX:
                self.add(s, self.iri(name), literal(value, lang))

    def node(self, e, base: str, lang: str):
        base, lang = self.own(e, base, lang)
        s = self.subject(e, base)
        if e.tag != f"{{{RDF}}}Description":
            self.add(s, RDF + "type", IRI(self.iri(e.tag)))
        self.attributes(s, e, lang, base)
        members = count(1)
        for p in e:
            self.property(s, p, base, lang, members)
        return s

    def property(self, s, e, base: str, lang: str, members: Iterator[int]) -> None:
        base, lang = self.own(e, base, lang)
        p = RDF + f"_{next(members)}" if e.tag == f"{{{RDF}}}li" else self.iri(e.tag)
        kind, children = e.get(f"{{{RDF}}}parseType"), list(e)
        if kind == "Resource":
            o = self.blank()
            inner = count(1)
            for x in children:
                self.property(o, x, base, lang, inner)
        elif kind == "Collection":
            o = self.listed([self.node(x, base, lang) for x in children])
        elif kind is not None:
            text = (e.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in children)
            o = Lit(text, RDF + "XMLLiteral")
        elif children:
            if len(children) > 1:
                raise DocumentError(f"several nodes in {e.tag}")
            o = self.node(children[0], base, lang)
        elif e.get(f"{{{RDF}}}resource") is not None or e.get(f"{{{RDF}}}nodeID") is not None:
            o = IRI(urljoin(base, e.get(f"{{{RDF}}}resource"))) if e.get(f"{{{RDF}}}resource") is not None else BNode("n" + e.get(f"{{{RDF}}}nodeID"))
            self.attributes(o, e, lang, base)
        elif any(n not in SYNTAX and not n.startswith(XML) for n in e.attrib):
            o = self.blank()
            self.attributes(o, e, lang, base)
        else:
            datatype = e.get(f"{{{RDF}}}datatype")
            o = literal(e.text or "", "" if datatype else lang, urljoin(base, datatype) if datatype else "")
        self.add(s, p, o)
        if e.get(f"{{{RDF}}}ID") is not None:
            r = self.named(e.get(f"{{{RDF}}}ID"), base)
            for name, term in (("subject", s), ("predicate", IRI(p)), ("object", o)):
                self.add(r, RDF + name, term)
            self.add(r, RDF + "type", IRI(RDF + "Statement"))

    def listed(self, items: list):
        o = IRI(RDF + "nil")
        for x in reversed(items):
            cell = self.blank()
            self.add(cell, RDF + "first", x)
            self.add(cell, RDF + "rest", o)
            o = cell
        return o


def parse_rdfxml(text: str, base: str = "") -> list[tuple[None, Triple]]:
    """(None, triple) of an RDF/XML document; its XML literals keep the text of their elements."""
    root, reader = ElementTree.fromstring(text), _Xml(base)
    if root.tag == f"{{{RDF}}}RDF":
        own = reader.own(root, base, "")
        for e in root:
            reader.node(e, *own)
    else:
        reader.node(root, base, "")
    return reader.out


class _Json:
    """Expands terms as it goes; a context by address is given by the loader."""

    def __init__(self, base: str, loader: Callable[[str], str] | None):
        self.base, self.loader, self.out, self.fresh = base, loader, [], count()

    def blank(self) -> BNode:
        return BNode(f"j{next(self.fresh)}")

    def context(self, told, now: dict) -> dict:
        for one in told if isinstance(told, list) else [told]:
            if one is None:
                now = {}
            elif isinstance(one, str):
                if not self.loader:
                    raise DocumentError(f"no loader for the context {one}")
                now = self.context(json.loads(self.loader(urljoin(self.base, one)))["@context"], now)
            else:
                now = now | one
        return now

    def expand(self, name: str, now: dict, vocabulary: bool = True):
        """The IRI, blank node or keyword of a name; None if it means nothing here."""
        seen = set()
        while vocabulary and name in now and name not in seen and not name.startswith("@"):
            seen.add(name)
            told = now[name]
            name = told.get("@id", name) if isinstance(told, dict) else told
            if name is None:
                return None
        if name.startswith("@"):
            return name
        if name.startswith("_:"):
            return BNode("b" + name[2:])
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and prefix in now:
            space = now[prefix]["@id"] if isinstance(now[prefix], dict) else now[prefix]
            return IRI(self.expand(space, now).v + local)
        if colon:
            return IRI(name)
        if vocabulary:
            return IRI(now["@vocab"] + name) if now.get("@vocab") is not None else None
        return IRI(urljoin(now.get("@base") or self.base, name))

    def node(self, value: dict, now: dict, graph):
        if "@context" in value:
            now = self.context(value["@context"], now)
        keys = {k: self.expand(now[k]["@reverse"] if isinstance(now.get(k), dict) and "@reverse" in now[k] else k, now) for k in value if k != "@context"}
        ids = [value[k] for k, e in keys.items() if e == "@id"]
        s = self.expand(ids[0], now, False) if ids else self.blank()
        for key, p in keys.items():
            if p == "@type":
                for t in value[key] if isinstance(value[key], list) else [value[key]]:
                    self.out.append((graph, Triple(s, IRI(RDF + "type"), self.expand(t, now) or self.expand(t, now, False))))
            elif p == "@graph":
                inner = s if ids or len(value) > 2 or ("@context" not in value and len(value) > 1) else graph
                for x in value[key] if isinstance(value[key], list) else [value[key]]:
                    self.node(x, now, inner)
            elif p == "@reverse":
                for name, others in value[key].items():
                    for x in others if isinstance(others, list) else [others]:
                        self.out.append((graph, Triple(self.term(x, {}, now, graph), self.expand(name, now), s)))
            elif isinstance(p, IRI):
                told = now.get(key) if isinstance(now.get(key), dict) else {}
                self.objects(s, p, value[key], told, now, graph)
        return s

    def objects(self, s, p: IRI, value, told: dict, now: dict, graph) -> None:
        if told.get("@container") == "@list" or isinstance(value, dict) and "@list" in value:
            items = value["@list"] if isinstance(value, dict) and "@list" in value else value
            self.out.append((graph, Triple(s, p, self.listed(items if isinstance(items, list) else [items], told, now, graph))))
            return
        if told.get("@container") == "@language" and isinstance(value, dict):
            for lang, texts in value.items():
                for t in texts if isinstance(texts, list) else [texts]:
                    self.out.append((graph, Triple(s, p, literal(t, "" if lang == "@none" else lang))))
            return
        if isinstance(value, dict) and "@set" in value:
            value = value["@set"]
        for x in value if isinstance(value, list) else [value]:
            if x is None:
                continue
            if isinstance(x, dict) and "@list" in x:
                self.objects(s, p, x, told, now, graph)
                continue
            if "@reverse" in told:
                self.out.append((graph, Triple(self.term(x, told, now, graph), self.expand(told["@reverse"], now), s)))
            else:
                self.out.append((graph, Triple(s, p, self.term(x, told, now, graph))))

    def term(self, x, told: dict, now: dict, graph):
        kind = told.get("@type")
        if isinstance(x, dict):
            if "@value" not in x:
                return self.node(x, now, graph)
            if x.get("@type") and x["@type"] != "@json":
                v = x["@value"]
                return literal(self.shown(v) if not isinstance(v, str) else v, datatype=self.expand(x["@type"], now).v)
            return literal(x["@value"], x.get("@language", ""), direction=x.get("@direction", "")) if isinstance(x["@value"], str) else self.native(x["@value"], None)
        if isinstance(x, str):
            if kind in ("@id", "@vocab"):
                return (self.expand(x, now) if kind == "@vocab" else None) or self.expand(x, now, False)
            if kind and kind != "@none":
                return literal(x, datatype=self.expand(kind, now).v)
            lang = told["@language"] if "@language" in told else now.get("@language")
            return literal(x, lang or "", direction=told.get("@direction", now.get("@direction")) or "")
        return self.native(x, self.expand(kind, now).v if kind and not kind.startswith("@") else None)

    @staticmethod
    def shown(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, int) or x == int(x) and abs(x) < 1e21:
            return str(int(x))
        mantissa, _, power = f"{x:.15E}".partition("E")
        mantissa = mantissa.rstrip("0")
        return f"{mantissa}0E{int(power)}" if mantissa.endswith(".") else f"{mantissa}E{int(power)}"

    def native(self, x, datatype: str | None) -> Lit:
        own = "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) or x == int(x) and abs(x) < 1e21 else "double"
        return Lit(self.shown(x), datatype or XSD + own)

    def listed(self, items: list, told: dict, now: dict, graph):
        o = IRI(RDF + "nil")
        inner = {k: v for k, v in told.items() if k != "@container"}
        for x in reversed(items):
            item = self.listed(x["@list"], inner, now, graph) if isinstance(x, dict) and "@list" in x else self.listed(x, inner, now, graph) if isinstance(x, list) else self.term(x, inner, now, graph)
            cell = self.blank()
            self.out += [(graph, Triple(cell, IRI(RDF + "first"), item)), (graph, Triple(cell, IRI(RDF + "rest"), o))]
            o = cell
        return o


def parse_jsonld(text: str, base: str = "", loader: Callable[[str], str] | None = None) -> list[tuple]:
    """(graph or None, triple) of a JSON-LD document: contexts, terms and compact IRIs, types, languages and directions,
    lists and sets, language maps, reverse properties and named graphs. Index maps and scoped contexts are not read."""
    reader, document = _Json(base, loader), json.loads(text)
    for x in document if isinstance(document, list) else [document]:
        reader.node(x, {}, None)
    return reader.out
