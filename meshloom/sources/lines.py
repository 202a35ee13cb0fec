"""Text files as numbered lines, and tables as ordered text files.

A graph's or matrix's row is its line's number, so lines are numbered over all
partitions: counts of partitions (a row each) give the offsets.  Text files that
are read as one column keep their order within a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.plans.scratch import materialize

COMMENTS = "%#\"/"


def numbered(spark: SparkSession, path: str, comments: str = "%", blanks: bool = True) -> DataFrame:
    """``(nth, line)`` from 0, without comment lines; ``blanks`` keeps empty lines, which are rows without entries."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    if comments:
        lines = lines.where(~F.coalesce(F.substring(F.ltrim("line"), 1, 1).isin(list(comments)), F.lit(False)))
    if not blanks:
        lines = lines.where(F.trim("line") != "")
    lines = materialize(lines, "lines")
    blocks = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block of a file
    offsets = blocks.select("_f", "_b", before.alias("_o"))
    within = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_id")) - 1
    return lines.withColumn("_w", within).join(F.broadcast(offsets), ["_f", "_b"]).select((F.col("_o") + F.col("_w")).cast("long").alias("nth"), "line")


def head(spark: SparkSession, path: str, comments: str = "%") -> str:
    """The first line that is no comment."""
    for row in spark.read.text(path).where(~F.substring(F.ltrim("value"), 1, 1).isin(list(comments) or [""])).limit(1).collect():
        return row["value"]
    raise ValueError(f"{path} has no lines")


def numbers(line: str = "line", kind: str = "long"):
    """The numbers of a line, as an array column."""
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.cast(kind))


def write_lines(lines: DataFrame, order: list, path: str, first: str | None = None, one_file: bool = True) -> None:
    """Write the column ``line`` in order under ``path``; ``first`` goes before.

    One file needs one last task, which streams rows that are sorted already; without it there is a
    file for each range, in order of names.
    """
    rows = lines.select("line", F.struct(*order).alias("_o"))
    if first is not None:
        spark = lines.sparkSession
        top = spark.createDataFrame([(first,)], "line string").select("line", F.lit(None).cast(rows.schema["_o"].dataType).alias("_o"))
        rows = rows.union(top)  # nulls sort first
    ordered = rows.orderBy("_o").select(F.col("line").alias("value"))
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").text(path)
