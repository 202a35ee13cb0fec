"""Ranks and running sums over whole tables, without one task that sorts them all.

Rows are dealt by ranges of the order; totals of ranges (one row a partition)
give each its offset; inside a range a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.plans.scratch import materialize


def _ranged(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows dealt by ranges; ``_range`` grows with the order.  Written once, as a second dealing could differ."""
    dealt = rows.repartitionByRange(*order) if order else rows
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def _offsets(rows: DataFrame, total: Column) -> DataFrame:
    """``(_range, _offset)``: what comes before a range; a row a partition."""
    sums = rows.groupBy("_range").agg(total.alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("_range", F.coalesce(before, F.lit(0)).alias("_offset"))


def global_rank(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds the gapless rank from 0 in a total order; ties are broken arbitrarily, so give a full order."""
    dealt = _ranged(rows, order)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    met = dealt.withColumn("_within", within).join(F.broadcast(_offsets(dealt, F.count("*"))), "_range")
    return met.withColumn(name, (F.col("_offset") + F.col("_within")).cast("long")).drop("_range", "_within", "_offset")


def running_sum(rows: DataFrame, column: str, order: list[str | Column], name: str) -> DataFrame:
    """Adds the sum of ``column`` up to and with each row in a total order."""
    dealt = _ranged(rows, order)
    within = F.sum(column).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_within", within).join(F.broadcast(_offsets(dealt, F.sum(column))), "_range")
    return met.withColumn(name, F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset")


def rank_within(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds the rank from 0 within each key, however many rows it has: rows are dealt by key and order."""
    dealt = _ranged(rows, [key, order])
    counts = dealt.groupBy("_range", key).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_range", F.col(key).alias("_same"), F.coalesce(before, F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range", key).orderBy(order)) - 1
    placed = dealt.withColumn("_within", within)
    met = placed.join(offsets.withColumnRenamed("_range", "_r"), (F.col("_range") == F.col("_r")) & (F.col(key) == F.col("_same")))
    return met.withColumn(name, F.col("_offset") + F.col("_within")).drop("_range", "_r", "_same", "_within", "_offset")


def sum_within(rows: DataFrame, keys: list[str], column: str, order: list[str | Column], name: str) -> DataFrame:
    """Adds the sum of ``column`` up to and with each row within its keys, however many rows they have; give a full order."""
    return sums_within(rows, keys, {name: F.col(column)}, order)


def sums_within(rows: DataFrame, keys: list[str], sums: dict[str, Column], order: list[str | Column], few: bool = False) -> DataFrame:
    """As :func:`sum_within` for several columns at once, by the names of their sums; ``few``: a task can take all rows of a key."""
    if few:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()})
    dealt = _ranged(rows, [*keys, *order])
    totals = dealt.groupBy("_range", *keys).agg(*(F.sum(c).alias(f"_n{i}") for i, c in enumerate(sums.values())))
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_n{i}").over(ranges), F.lit(0)).alias(f"_offset{i}") for i in range(len(sums))]
    offsets = totals.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_same_{k}") for k in keys), *before)
    upto = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k) == F.col(f"_same_{k}")
    met = dealt.withColumns({f"_within{i}": F.sum(c).over(upto) for i, c in enumerate(sums.values())}).join(offsets, same)
    found = met.withColumns({name: F.col(f"_offset{i}") + F.col(f"_within{i}") for i, name in enumerate(sums)})
    return found.drop("_range", "_r", *(f"_same_{k}" for k in keys), *(f"_{kind}{i}" for kind in ("offset", "within") for i in range(len(sums))))
