"""Connected components of a link table, by repeated contraction; nothing is gathered on the driver but emptiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b); component is the smallest node that can be reached.

    In each round every node moves to the first of itself and its neighbours, and links are rewritten between the
    nodes that are left, until none is. The first round orders nodes by their number, so that stars around their
    smallest node, the usual shape of copies, are done at once. Later rounds order them by a hash of their own, which
    leaves a constant share of the nodes of any graph (randomised contraction): chains of n nodes take log n rounds.
    Self-links, repeated and reversed links are harmless; links with a null end are ignored; no links give an empty
    result.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        place = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn else F.lit(0)).alias("at"), F.col(c).alias("n"))  # noqa: B023, E731
        up = stored(both.groupBy("u").agg(F.least(place("u"), F.min(place("v"))).alias("first")).select("u", F.col("first.n").alias("p")))
        to = lambda c: up.select(F.col("u").alias(c), F.col("p").alias(f"to_{c}"))  # noqa: B023, E731
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            labels = stored(labels.join(to("component"), "component", "left").select("node", F.coalesce("to_component", "component").alias("component")))
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("to_a <> to_b")
        edges = stored(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
        if edges.isEmpty():
            break
        turn += 1
    if turn:  # the node that is left of a component need not be its smallest
        smallest = labels.groupBy("component").agg(F.min("node").alias("least"))
        labels = labels.join(smallest, "component").select("node", F.col("least").alias("component"))
    return labels
