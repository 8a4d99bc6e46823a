"""Connected components of a link table by repeated contraction, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows pointers twice, and rewrites
    the links between the nodes pointed to. At least half of the nodes that still have links
    vanish, so rounds grow with the logarithm of the input. Every step is an aggregation or a
    join on nodes; a hub with very many links costs partial aggregates only. Rounds end in
    written tables.
    """
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "parents")
        for _ in range(2):
            parent = parent.alias("p").join(parent.alias("q"), F.col("p.up") == F.col("q.node")).select("p.node", F.col("q.up").alias("up"))
        parent = cut(parent, "pointers")
        names = parent if names is None else cut(names.alias("n").join(parent.alias("p"), F.col("n.up") == F.col("p.node"), "left").select("n.node", F.coalesce("p.up", "n.up").alias("up")), "names")
        one = edges.join(parent.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges = cut(one.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if names is None:
        names = edges.select(F.col("a").alias("node"), F.col("b").alias("up"))
    return names.select("node", F.col("up").alias("label"))
