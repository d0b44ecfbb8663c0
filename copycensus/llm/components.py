"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copycensus import workspace


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    return tuple(row.first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; root is the smallest node it can reach.

    ``links`` has two columns of comparable ids, in any order and repeated at will. Each round hangs
    the neighbours of a node under the least of them, first the greater ones, then the smaller
    ones, so long chains shrink by a factor per round. Rounds are stored, and the graph that no longer
    changes is one star per component. A node of very many links is only ever folded to a minimum
    or joined to one row.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = workspace.snapshot(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = workspace.snapshot(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = workspace.snapshot(moved.union(least).distinct(), "small-star")
        before, state, edges = state, _state(small), small
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
