"""Connected components of an edge table by alternating stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.shared import forget, saved


def _towards(edges: DataFrame, larger: bool) -> DataFrame:
    """One star round: the neighbours of each node that are larger (or not) get the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("c"))
    if larger:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), two longs; root is the smallest node of its component.

    Large-star and small-star rounds alternate until the edges are stars around their roots;
    edges are written to the shared folder after each pair of rounds. Nodes are never gathered
    by neighbour: a node with very many edges is aggregated before it is shuffled, and the
    joins can be split by adaptive execution. An empty table gives an empty table.
    """
    now = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        new = saved(_towards(_towards(now, True), False), "stars")
        r = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(now)
        now = new
        if (r["n"], r["h"]) == state or not r["n"]:
            break
        state = (r["n"], r["h"])
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
