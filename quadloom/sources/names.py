"""Short names of IRIs, and the modules that a graph imports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import nt_text

LOCAL = r"[A-Za-z_0-9](?:[A-Za-z_0-9.-]*[A-Za-z_0-9-])?"
IMPORTS, VERSION = "http://www.w3.org/2002/07/owl#imports", "http://www.w3.org/2002/07/owl#versionIRI"


def compute_qname(iri: str, prefixes: dict[str, str]) -> tuple[str, str, str]:
    """(prefix, namespace, local name) by the longest namespace that fits; KeyError if none does."""
    fits = [(len(space), name, space) for name, space in prefixes.items() if space and iri.startswith(space) and re.fullmatch(LOCAL, iri[len(space) :])]
    if not fits:
        raise KeyError(f"no prefix for {iri}")
    _, name, space = max(fits)
    return name, space, iri[len(space) :]


def qname(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local of a column of IRIs, by the longest namespace that fits; null where none does."""
    out = F.lit(None).cast("string")
    for name, space in sorted(prefixes.items(), key=lambda x: len(x[1])):
        local = F.substr(iri, F.lit(len(space) + 1), F.length(iri))
        out = F.when(iri.startswith(space) & local.rlike(f"^{LOCAL}$"), F.concat(F.lit(f"{name}:" if name else ""), local)).otherwise(out)
    return out


def expand_curie(curie: Column, prefixes: dict[str, str]) -> Column:
    """IRIs of a column of prefix:local names; an IRI in angle brackets, or with an unknown scheme, is taken as it is."""
    prefix = F.substring_index(curie, ":", 1)
    out = F.when(F.contains(curie, F.lit(":")), curie)
    for name, space in prefixes.items():
        out = F.when(F.contains(curie, F.lit(":")) & (prefix == name), F.concat(F.lit(space), F.substr(curie, F.lit(len(name) + 2), F.length(curie)))).otherwise(out)
    return F.when(curie.startswith("<") & curie.endswith(">"), F.substr(curie, F.lit(2), F.length(curie) - 2)).otherwise(out)


def n3(term: Column) -> Column:
    """The N-Triples text of a boxed term."""
    return nt_text(term)


def owl_imports(quads: DataFrame) -> list[str]:
    """IRIs that a graph imports, in order; a graph names few modules, whatever its size."""
    return sorted(r[0] for r in quads.where(F.col("p") == IMPORTS).select(F.col("o")["v"]).distinct().collect())


def resolve_imports(quads: DataFrame, loader: Callable[[str], DataFrame | None], mode: str = "full") -> DataFrame:
    """The graph with all that it imports, directly or not ("full"), or only what that adds ("delta").

    Each module is loaded once, under its own name or its version's; one that the loader does not know is left out.
    """
    if mode not in ("full", "delta"):
        raise ValueError(f"no mode {mode}")
    columns = ["g", "s", "p", "o"]
    base, seen, parts, open_ = quads.select(columns), set(), [], owl_imports(quads)
    while open_:
        iri = open_.pop(0)
        if iri in seen:
            continue
        seen.add(iri)
        module = loader(iri)
        if module is None:
            continue
        # a module asked for by its version is the one of the ontology's name
        own = {r[0] for r in module.where((F.col("p") == VERSION) & (F.col("o")["v"] == iri)).select(F.col("s")["v"]).distinct().collect()}
        if own & seen:
            continue
        seen |= own
        parts.append(module.select(columns))
        open_ += owl_imports(module)
    made = base.where("false")
    for p in parts:
        made = made.unionByName(p)
    made = made.distinct().join(base, columns, "left_anti").select(columns)
    return made if mode == "delta" else base.unionByName(made)
