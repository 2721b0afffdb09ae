"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, distinct. Ties every larger neighbour (large), or every smaller one and the node itself, to the node's least neighbour.

    The least neighbours are a table, so that both sides of the join are dealt for it alone and adaptive execution may split a hub's links."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        tied = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return tied.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two bigint columns a and b. Returns (node, label): label is the least node of the component; nodes without links are left out.

    A hub with any number of links is only ever aggregated with partial sums or read by a join that may be split.
    Rounds go on until nothing changes; a path of n nodes needs about log2(n) of them."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == mark or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = tuple(now)
        edges = written(_star(_star(edges, True), False), "stars")
