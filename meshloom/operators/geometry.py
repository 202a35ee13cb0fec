"""Partitions from coordinates alone: space-filling keys, equal slices, bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.operators.ordering import global_rank

BITS = 9


def grid(points: DataFrame, dims: int, bits: int = BITS) -> DataFrame:
    """Adds ``g0, g1, ...``: each coordinate's cell of ``2 ** bits`` equal ones over its range."""
    ends = points.agg(*(f(F.get("xyz", F.lit(d))).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))))
    met = points.join(F.broadcast(ends))  # one row
    top = (1 << bits) - 1
    cell = lambda d: F.when(
        F.col(f"hi{d}") > F.col(f"lo{d}"),
        F.least(F.lit(top), F.floor((F.get("xyz", F.lit(d)) - F.col(f"lo{d}")) / (F.col(f"hi{d}") - F.col(f"lo{d}")) * (1 << bits))),
    ).otherwise(0).cast("long")
    return met.select(*points.columns, *(cell(d).alias(f"g{d}") for d in range(dims)))


def morton(cells: list[Column], bits: int = BITS) -> Column:
    """The cells' bits interleaved, highest first."""
    n = len(cells)
    parts = [
        F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * n + (n - 1 - d)) for b in range(bits) for d, c in enumerate(cells)
    ]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def morton_order(points: DataFrame, dims: int = 3, bits: int = BITS) -> DataFrame:
    """``(id, _rank)``: gapless places from 0 along the Morton curve, ties by id."""
    keyed = grid(points, dims, bits).select("id", morton([F.col(f"g{d}") for d in range(dims)], bits).alias("key"))
    return global_rank(keyed, ["key", "id"], "_rank").select("id", "_rank")


def part_geom(points: DataFrame, k: int, dims: int = 3, bits: int = BITS) -> DataFrame:
    """``(id, pid)``: points in the order of their Morton keys, cut into ``k`` slices of equal counts."""
    n = points.count()
    return morton_order(points, dims, bits).select("id", F.floor(F.col("_rank") * k / max(n, 1)).cast("int").alias("pid"))


def equal_count_bins(points: DataFrame, dim: int, bins: int) -> DataFrame:
    """``(id, bin)``: bins of one coordinate with counts at most one apart."""
    n = points.count()
    ranked = global_rank(points.select("id", F.get("xyz", F.lit(dim)).alias("x")), ["x", "id"], "_rank")
    return ranked.select("id", F.floor(F.col("_rank") * bins / max(n, 1)).cast("int").alias("bin"))


def mean_bins(points: DataFrame, dim: int, depth: int) -> DataFrame:
    """``(id, bin)``: split at the mean, each half at its own mean, and so on; a pass over the points a level."""
    held = points.select("id", F.get("xyz", F.lit(dim)).alias("x"), F.lit(0).alias("bin"))
    for _ in range(depth):
        means = held.groupBy("bin").agg(F.avg("x").alias("_mean"))
        held = held.join(F.broadcast(means), "bin").select("id", "x", (2 * F.col("bin") + (F.col("x") > F.col("_mean")).cast("int")).alias("bin"))  # 2 ** depth rows
    return held.select("id", "bin")
