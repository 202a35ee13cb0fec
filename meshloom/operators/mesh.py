"""Meshes as element-node incidences: dual and nodal graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.plans.scratch import materialize

#: Members of a key that meet in one task at most; a key with more is split.
HOT = 4096
#: Rows that a task makes when members meet, about; the number of tasks grows with the rows to be made.
MADE = 1 << 19
#: Rows of incidences, or of twos of nodes, that a task sorts, about; the number of tasks grows with the rows.
SORTED = 1 << 18
#: Rows of a file of incidences; a split takes some 30 files, and what its task makes of them waits in memory to be dealt.
FILED = 1 << 16
#: Nodes of an element that meets others under twos of its nodes, at most; larger ones meet them node by node.
WIDE = 32


def _pairs(rows: DataFrame, key: str, member: str, *carried: str, leads: Column | None = None) -> DataFrame:
    """``(lo, hi)``: members of a key, two by two, the smaller first; a row for each key that both have.

    Members of a key with many go to as many groups as it takes, and the others meet each group, so no
    task has more than ``HOT`` rows of a key to pair.  ``carried`` columns come along as the lesser of both.
    With ``leads``, one of the two leads at least.
    """
    led = rows.select(F.col(key).alias("_key"), F.col(member).alias("_m"), *carried, (F.lit(True) if leads is None else leads).alias("_leads"))
    counts = led.groupBy("_key").agg(F.count("*").alias("_n"), F.count_if("_leads").alias("_l"))
    made, most = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_l")), F.max("_n")).first()
    groups = F.lit(1)
    if (most or 0) > HOT:
        hot = counts.where(F.col("_n") > HOT).select("_key", F.ceil(F.col("_n") / HOT).cast("int").alias("_groups"))
        led, groups = led.join(hot, "_key", "left"), F.coalesce("_groups", F.lit(1))
    left = led.where("_leads").select("_key", F.pmod(F.xxhash64("_m"), groups).cast("int").alias("_salt"), F.col("_m").alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in carried))
    right = led.select("_key", F.explode(F.sequence(F.lit(0), groups - 1)).alias("_salt"), F.col("_m").alias("_b"), "_leads", *(F.col(c).alias(f"_b_{c}") for c in carried))
    tasks = int((made or 0) // MADE) + 1
    met = left.repartition(tasks, "_key", "_salt").join(right.repartition(tasks, "_key", "_salt"), ["_key", "_salt"])
    met = met.where((F.col("_a") < F.col("_b")) | (~F.col("_leads") & (F.col("_a") != F.col("_b"))))
    return met.select(F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi"), *(F.least(f"_a_{c}", f"_b_{c}").alias(c) for c in carried))


def _both_ways(pairs: DataFrame, *columns: str) -> DataFrame:
    """Edges in both directions of ``pairs (lo, hi, ...)``."""
    ends = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))
    return pairs.select(F.explode(ends).alias("_e"), *columns).select("_e.src", "_e.dst", *columns)


def _counted(pairs: DataFrame) -> DataFrame:
    """``(lo, hi, wgt, need)`` from a row for each node that both share."""
    return pairs.groupBy("lo", "hi").agg(F.count("*").alias("wgt"), F.min("need").alias("need"))


def _dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``n`` rows dealt by keys to as many tasks as it takes, so that what a task holds does not grow with the table."""
    return rows.repartition((n or 0) // SORTED + 1, *keys)


def _by_twos(rows: DataFrame) -> DataFrame:
    """``(lo, hi, wgt, need)`` of elements that share two nodes or more, from ``(elem, node, later, need)``; ``later`` has the element's larger nodes.

    Elements meet under each two of their nodes.  Those that share ``k`` meet ``k (k - 1) / 2`` times, which tells ``k``.
    Twos that one element alone has, most of them, go before; the rows of a two are fewer than the pairs that they make.
    """
    twos = rows.select("elem", "need", "node", F.explode("later").alias("other"))
    dealt = _dealt(twos, rows.agg(F.sum(F.size("later"))).first()[0], "node", "other")
    often = dealt.withColumn("n", F.count("*").over(Window.partitionBy("node", "other"))).where("n > 1")
    met = _pairs(materialize(often.select("elem", "need", F.struct("node", "other").alias("two")), "twos"), "two", "elem", "need")
    return _counted(met).withColumn("wgt", ((1 + F.round(F.sqrt(1 + 8 * F.col("wgt")))) / 2).cast("long"))


def dual_graph(incidence: DataFrame, ncommon: int = 1, relaxed: bool = True) -> DataFrame:
    """Elements are adjacent when they share enough nodes; ``wgt`` counts the shared ones.

    Strict: at least ``ncommon`` of them.  Relaxed: all but one node of either
    element will do as well, so a one-node element stays adjacent to itself.
    Where one shared node is enough, for ``ncommon`` 1 or an element of up to two nodes, elements meet node
    by node, and so do those of more than ``WIDE`` nodes.  All others meet under each two of their nodes,
    so that pairs which share only one node are never formed.  Pairs that stay are mirrored.
    Repeated rows count once, so there is no need to drop them before; ``incidence`` is counted, then read.
    """
    ncommon = max(1, ncommon)
    by, n = Window.partitionBy("elem"), F.col("n")
    rows = _dealt(incidence.select("elem", "node").where("elem is not null"), incidence.count(), "elem")
    first = F.row_number().over(Window.partitionBy("elem", "node").orderBy("node"))
    rows = rows.withColumn("_nth", first).where("_nth = 1").drop("_nth").withColumn("n", F.count("*").over(by))
    rows = rows.withColumn("need", F.least(F.lit(ncommon).cast("long"), n - 1) if relaxed else F.lit(ncommon).cast("long"))
    if ncommon > 1:
        rows = rows.withColumn("later", F.collect_list("node").over(by.orderBy("node").rowsBetween(1, WIDE)))
    rows = rows.where("node is not null")
    rows = materialize(rows if relaxed else rows.where("n >= need"), "incidence", maxRecordsPerFile=str(FILED))
    if ncommon == 1:
        shared = _counted(_pairs(rows, "node", "elem", "need"))
    else:
        single = (n > WIDE) | (F.col("need") < 2)
        shared = _by_twos(rows.where(~single))
        if not rows.where(single).isEmpty():
            shared = shared.union(_counted(_pairs(rows, "node", "elem", "need", leads=single)))
    edges = _both_ways(shared.where("wgt >= need"), "wgt")
    if not relaxed:
        return edges
    loops = rows.where("n = 1").select(F.col("elem").alias("src"), F.col("elem").alias("dst"), F.lit(0).cast("long").alias("wgt"))
    return edges.union(loops)


def nodal_graph(incidence: DataFrame) -> DataFrame:
    """Nodes are adjacent when some element holds both; ``wgt`` is 1."""
    pairs = _pairs(incidence, "elem", "node").distinct()
    return _both_ways(pairs).withColumn("wgt", F.lit(1).cast("long"))


def induce_majority(touching: DataFrame) -> DataFrame:
    """``(id, pid, unanimous)``: the part most of a row's columns are in, the smallest among equals.

    ``touching`` is ``(id, pid)``, a row for each column of a row.
    """
    counts = touching.groupBy("id", "pid").agg(F.count("*").alias("n"))
    best = F.max_by("pid", F.struct("n", -F.col("pid")))
    return counts.groupBy("id").agg(best.alias("pid"), (F.count("*") == 1).alias("unanimous"))
