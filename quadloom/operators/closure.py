"""Reachability over a binary relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.durable import drop, durable


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(s, o): all pairs joined by one edge or more, from the nodes of ``start`` (s) or from all.

    From all nodes the reach doubles: the pairs found last, which are those of the longest paths, are
    joined with all pairs found, so a path of n edges takes log n rounds. From a start the pairs found
    last are joined with the edges, so that nothing is walked that the start does not reach. Only new
    pairs go on, so cycles end. Each round is a table; those of the rounds before are dropped.
    """
    found = durable(edges.select("s", "o").where("s is not null and o is not null").distinct(), "edges")
    if start is not None:
        return _from(found, start)
    frontier = found
    while not frontier.isEmpty():
        # the first 2^k edges of a shortest path were found last, and the rest before or with them
        step = frontier.alias("f").join(found.alias("p"), F.col("f.o") == F.col("p.s")).select(F.col("f.s"), F.col("p.o")).distinct()
        before = [frontier, found]
        frontier = durable(step.join(found, ["s", "o"], "left_anti"), "frontier")
        found = durable(found.unionAll(frontier), "reach")
        for old in before:
            drop(old)
    if frontier is not found:
        drop(frontier)
    return found


def _from(edges: DataFrame, start: DataFrame) -> DataFrame:
    found = frontier = durable(edges.join(start.select("s").distinct(), "s", "left_semi"), "reach")
    while not frontier.isEmpty():
        step = frontier.alias("f").join(edges.alias("e"), F.col("f.o") == F.col("e.s")).select(F.col("f.s"), F.col("e.o")).distinct()
        frontier = durable(step.join(found, ["s", "o"], "left_anti"), "frontier")
        found = found.unionAll(frontier)
    return found
