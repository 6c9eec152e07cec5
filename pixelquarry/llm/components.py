"""Connected components of a distributed graph by alternating stars (Kiveris et al., 2014); no node's neighbours are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): of each node the least of itself and the nodes it has an edge to."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges for one task.
TASK_EDGES = 50_000


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the least node of its component; only nodes that have a link to another one. The number of tasks follows that of the edges."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while state[0]:
        tasks = 1 + 2 * state[0] // TASK_EDGES
        # large star: every neighbour above u is hung on the least of u's neighbourhood
        both = edges.coalesce(tasks)
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        # small star: u and its neighbours below are hung on the least of them
        small = large.join(_least(large), "u").coalesce(tasks)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(tasks)
        old, edges = edges, materialize(small, "edges")
        discard(old)
        new = _state(edges)
        if new == state:
            break
        state = new
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops.select("node", F.col("node").alias("label")))
