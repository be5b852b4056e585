"""Connected components by alternating large-star and small-star rounds on a table of links.

Every round is two joins and two aggregations with map-side minima; no node's neighbours are ever
collected. Joins are by merge: sides that happen to be small would be broadcast anew in each round, which
holds threads and memory of the driver. After each round the links are written to the shared folder, which cuts the lineage and
survives lost executors; rounds end when the links stop changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestore.llm._frames import collect_garbage, written


def _towards_minimum(links: DataFrame, large: bool) -> DataFrame:
    """One star round. Links are (u, v) with u > v.

    Large star: every neighbour of x that is larger than x is tied to the least of x and its neighbours.
    Small star: every neighbour of x that is smaller than x, and x itself, are tied to the least of them.
    """
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        tied = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least.hint("merge"), "u")
        tied = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u > v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b: long); component is the least id reached.

    Links to oneself, repeated links and nulls are ignored; ids without any other link are not returned.
    """
    edges = written(
        links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    digest = _digest(edges)
    for _ in range(max_rounds):
        edges = written(_towards_minimum(_towards_minimum(edges, True), False))
        collect_garbage(edges.sparkSession)
        before, digest = digest, _digest(edges)
        if before == digest:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    wide = "decimal(38,0)"
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast(wide)), F.sum(F.xxhash64("v", "u", F.lit(1)).cast(wide))).first())
