"""Connected components by alternating stars, in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.plans.scratch import materialize, release


def _larger_first(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each vertex's larger neighbours on the smallest of its neighbours and itself."""
    both = edges.select(F.col("big").alias("id"), F.col("small").alias("to")).union(edges.select(F.col("small").alias("id"), F.col("big").alias("to")))
    least = both.groupBy("id").agg(F.least("id", F.min("to")).alias("least"))
    met = edges.join(least, edges["small"] == least["id"])
    return _larger_first(met.select("big", "least"), "big", "least")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each vertex and its smaller neighbours on the smallest of them."""
    least = edges.groupBy(F.col("big").alias("id")).agg(F.min("small").alias("least"))
    met = edges.join(least, edges["big"] == least["id"])
    own = least.select(F.col("id").alias("a"), F.col("least").alias("b"))
    return _larger_first(met.select(F.col("small").alias("a"), F.col("least").alias("b")).union(own), "a", "b")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """``(id, component)`` of every vertex with an edge to another; the component is its smallest id.

    Each round is a few joins over the edges and is written to the shared folder; hubs are
    pre-aggregated before they shuffle.  The number of rounds grows with the logarithm of the size.
    """
    current, before = materialize(_larger_first(edges, src, dst), "edges"), None
    for _ in range(max_rounds):
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or row == before:
            break
        before = row
        stars = materialize(_large_star(current), "stars")
        last, current = current, materialize(_small_star(stars), "edges")
        release(stars, last)  # the next round's edges are written
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("big").alias("id"), F.col("small").alias("component"))
    return members.union(current.select("small", F.col("small").alias("component")).distinct())
