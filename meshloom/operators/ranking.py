"""Measures of ranked lists ``(score, cls, tie)`` with classes 1 and -1, best first, and statistics of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.operators.ordering import global_rank, running_sum


def _ordered(ranked: DataFrame) -> DataFrame:
    """The list with counts of positives and negatives up to each row, inclusive."""
    rows = ranked.select("score", "tie", (F.col("cls") > 0).cast("long").alias("pos"))
    order = [F.desc("score"), F.col("tie")]
    cumulative = running_sum(global_rank(rows, order, "nth"), "pos", order, "tp")
    return cumulative.withColumn("fp", F.col("nth") + 1 - F.col("tp"))


def _totals(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.sum((F.col("cls") > 0).cast("long")).alias("p"), F.sum((F.col("cls") <= 0).cast("long")).alias("n"))


def max_accuracy(ranked: DataFrame) -> DataFrame:
    """The best percentage of right answers over the cuts of the list after one row or more."""
    met = _ordered(ranked).join(F.broadcast(_totals(ranked)))  # one row
    return met.agg(F.round(100 * F.max(F.col("tp") + F.col("n") - F.col("fp")) / F.max(F.col("n") + F.col("p")), 6).alias("max_accuracy"))


def roc_n(ranked: DataFrame, most: int, compat: bool = False) -> DataFrame:
    """The area under the curve down to the ``most``-th false positive, over all positives times the false positives seen.

    The list ends with that row, inside equal scores too.  Equal scores are one step, a trapezoid.
    ``compat`` halves whole numbers, dropping remainders.  Without true or false positives: 0.
    """
    seen = _ordered(ranked).withColumns({"tp0": F.col("tp") - F.col("pos"), "fp0": F.col("fp") - (1 - F.col("pos"))}).where(F.col("fp0") < most)
    steps = seen.groupBy("score").agg(*(fold(c).alias(c) for c, fold in (("tp", F.max), ("fp", F.max), ("tp0", F.min), ("fp0", F.min))))
    twice = (F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0"))
    area = F.sum(F.floor(twice / 2) if compat else twice / 2)
    met = steps.agg(area.alias("area"), F.max("fp").alias("fp"), F.max("tp").alias("tp")).join(F.broadcast(_totals(ranked)))  # one row
    value = F.when(F.col("tp") * F.col("fp") > 0, F.col("area") / (F.col("p") * F.col("fp"))).otherwise(0.0)
    return met.select(F.round(value, 6).alias("roc_n"))


def median_rfp(ranked: DataFrame) -> DataFrame:
    """The share of negatives above the place where half of the positives have been seen."""
    met = _ordered(ranked).join(F.broadcast(_totals(ranked)))  # one row
    reached = met.where((F.col("pos") == 1) & (F.col("tp") >= F.floor((F.col("p") + 1) / 2)))
    return reached.agg(F.round(F.min("fp") / F.max("n"), 6).alias("median_rfp"))


def mean_std(rows: DataFrame, column: str) -> DataFrame:
    """Mean, population and sample deviation."""
    c = F.col(column)
    return rows.agg(F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_pop(c), 4).alias("std_pop"), F.round(F.stddev_samp(c), 4).alias("std_samp"))


def geometric_mean(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.round(F.pow(F.lit(2.0), F.avg(F.log2(column))), 4).alias("geo_mean"))


def median(rows: DataFrame, column: str) -> DataFrame:
    """The middle value, or the mean of both middle ones; nulls are left out.  No task holds all values."""
    known = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = known.agg(F.count("*").alias("_n"))
    placed = global_rank(known, ["v"], "nth").join(F.broadcast(n))  # one row
    middle = placed.where((F.col("nth") == F.floor((F.col("_n") - 1) / 2)) | (F.col("nth") == F.floor(F.col("_n") / 2)))
    return middle.agg(F.round(F.avg("v"), 4).alias("median"))


def arg_extremes(rows: DataFrame, column: str, key: str, k: int = 3) -> DataFrame:
    """``(nth, key, value)``: the ``k`` largest values, first keys first among equals."""
    top = rows.select(F.col(key).alias("key"), F.col(column).alias("value")).orderBy(F.desc("value"), "key").limit(k)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("value"), "key")))  # k rows


def exclusive_prefix(rows: DataFrame, key: str) -> DataFrame:
    """``(key, start)``: where each key's rows begin once rows are sorted by key."""
    counts = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    summed = running_sum(counts, "n", ["key"], "end")
    return summed.select("key", (F.col("end") - F.col("n")).alias("start"))
