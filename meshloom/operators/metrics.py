"""Exact measures of a partition of a graph.

``placed`` is an edge table with the parts of both ends, ``(src, dst, wgt, ps, pd)``;
edges are there in both directions.  All sums are partial before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crosses() -> Column:
    """Whether an edge is between two parts."""
    return F.col("ps") != F.col("pd")


def with_parts(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Edges with the parts of both ends; ``part`` is ``(id, pid)``."""
    return edges.join(part.select(F.col("id").alias("src"), F.col("pid").alias("ps")), "src").join(
        part.select(F.col("id").alias("dst"), F.col("pid").alias("pd")), "dst"
    )


def _half(total: Column) -> Column:
    return F.coalesce(F.floor(total / 2), F.lit(0)).cast("long")


def edge_cut(placed: DataFrame) -> DataFrame:
    """Total weight of the edges between parts; both directions are there, so half of the sum."""
    return placed.agg(_half(F.sum(F.when(crosses(), F.col("wgt")).otherwise(0))).alias("edge_cut"))


def part_cuts(placed: DataFrame) -> DataFrame:
    """``(pid, cut)``: the outgoing weight of each part that has any edge."""
    return placed.groupBy(F.col("ps").alias("pid")).agg(F.sum(F.when(crosses(), F.col("wgt")).otherwise(0)).alias("cut"))


def max_part_cut(placed: DataFrame) -> DataFrame:
    return part_cuts(placed).agg(F.coalesce(F.max("cut"), F.lit(0)).alias("max_part_cut"))


def comm_volume(placed: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Sum over vertices of their size (1 without ``sizes (id, vsize)``) times the other parts they touch."""
    touched = placed.where(crosses()).groupBy("src").agg(F.count_distinct("pd").alias("n"))
    if sizes is not None:
        touched = touched.join(sizes.select(F.col("id").alias("src"), "vsize"), "src").select((F.col("n") * F.col("vsize")).alias("n"))
    return touched.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("comm_volume"))


def part_volumes(placed: DataFrame) -> DataFrame:
    """``(pid, volume)``: what each part sends."""
    touched = placed.where(crosses()).groupBy("src", "ps").agg(F.count_distinct("pd").alias("n"))
    return touched.groupBy(F.col("ps").alias("pid")).agg(F.sum("n").alias("volume"))


def subdomain_graph(placed: DataFrame) -> DataFrame:
    """``(ps, pd, wgt)``: weights between parts."""
    return placed.where(crosses()).groupBy("ps", "pd").agg(F.sum("wgt").alias("wgt"))


def subdomain_laplacian(placed: DataFrame) -> DataFrame:
    """``(row, col, val)``: the number of neighbours on the diagonal, -1 for each neighbour."""
    pairs = placed.where(crosses()).select("ps", "pd").distinct()
    off = pairs.select(F.col("ps").alias("row"), F.col("pd").alias("col"), F.lit(-1.0).alias("val"))
    return off.union(pairs.groupBy("ps").agg(F.count("*").cast("double").alias("val")).select("ps", F.col("ps").alias("col"), "val"))


def subdomain_degree_stats(placed: DataFrame) -> DataFrame:
    found = placed.where(crosses()).groupBy("ps").agg(F.count_distinct("pd").alias("d"))
    return found.agg(F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 6).alias("avg_degree"))


def interface_stats(placed: DataFrame, k: int) -> DataFrame:
    """By kind (neighbour parts, outgoing weight, interface vertices): least, largest, mean, and largest over mean.

    A vertex is an interface vertex once for each foreign part that it touches.
    """
    touching = placed.where(crosses()).groupBy("ps", "src", "pd").agg(F.sum("wgt").alias("cut"))
    pairs = touching.groupBy("ps", "pd").agg(F.sum("cut").alias("cut"), F.count("*").alias("n"))
    parts = pairs.groupBy("ps").agg(F.count("*").alias("neighbours"), F.sum("cut").alias("cut"), F.sum("n").alias("interface"))
    kinds = parts.unpivot("ps", ["neighbours", "cut", "interface"], "kind", "v")
    mean = F.sum("v") / k
    least = F.when(F.count("*") < k, 0).otherwise(F.min("v")).alias("least")
    return kinds.groupBy("kind").agg(least, F.max("v").alias("largest"), F.round(mean, 6).alias("mean"), F.round(F.max("v") / mean, 6).alias("balance"))


def loads(vertices: DataFrame, con: str = "vwgt") -> DataFrame:
    """``(pid, con, load)`` of ``vertices (id, pid, vwgt)``; ``vwgt`` is a number or an array with one a constraint."""
    kind = dict(vertices.dtypes)[con]
    each = F.posexplode(con if kind.startswith("array") else F.array(con)).alias("con", "w")
    return vertices.select("pid", each).groupBy("pid", "con").agg(F.sum("w").alias("load"))


def balance(vertices: DataFrame, k: int) -> DataFrame:
    """``(con, balance)``: the heaviest part over the mean, by constraint."""
    by = loads(vertices).groupBy("con").agg(F.max("load").alias("most"), F.sum("load").alias("total"))
    return by.select("con", F.round(k * F.col("most") / F.col("total"), 6).alias("balance"))


def element_balance(part: DataFrame, k: int) -> DataFrame:
    counts = part.groupBy("pid").agg(F.count("*").alias("n"))
    return counts.agg(F.round(k * F.max("n") / F.sum("n"), 6).alias("balance"))


def imbalance(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """``(con, imbalance)``: largest load over its target share ``targets (pid, con, tpwgt)``, 1 at least."""
    held = loads(vertices)
    totals = held.groupBy("con").agg(F.sum("load").alias("total"))
    share = held.join(F.broadcast(targets), ["pid", "con"]).join(F.broadcast(totals), "con")  # a row a part and constraint
    over = F.max(F.col("load") / (F.col("tpwgt") * F.col("total")))
    return share.groupBy("con").agg(F.round(F.greatest(F.lit(1.0), over), 6).alias("imbalance"))


def guarded_balance(vertices: DataFrame, targets: DataFrame, relative: bool = False) -> DataFrame:
    """``(con, balance)``: the largest load over its target, both raised so that targets of zero count too.

    Raised by one; with ``relative``, loads are shares of the total and both are raised by the least share
    above zero of a vertex.  Targets without vertices count as parts without load.
    """
    held = loads(vertices)
    each = vertices.select(F.posexplode("vwgt" if dict(vertices.dtypes)["vwgt"].startswith("array") else F.array("vwgt")).alias("con", "w"))
    sums = each.groupBy("con").agg(F.sum("w").alias("total"), F.min(F.when(F.col("w") > 0, F.col("w"))).alias("least"))
    met = targets.join(held, ["pid", "con"], "left").join(sums, "con")
    load = F.coalesce(F.col("load"), F.lit(0))
    if relative:
        by, total = F.coalesce(F.least(F.col("least") / F.col("total"), F.lit(1.0)), F.lit(1.0)), F.col("total")
        value = (by + load / total) / (by + F.col("tpwgt"))
    else:
        value = (1 + load) / (1 + F.col("tpwgt") * F.col("total"))
    return met.groupBy("con").agg(F.round(F.max(value), 6).alias("balance"))


def load_differences(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """``(pid, con, load, difference)``: each part's load and how far it is above its target."""
    held = loads(vertices)
    totals = held.groupBy("con").agg(F.sum("load").alias("total"))
    met = targets.join(held, ["pid", "con"], "left").join(totals, "con")
    load = F.coalesce("load", F.lit(0)).cast("long")
    return met.select("pid", "con", load.alias("load"), F.round(load - F.col("tpwgt") * F.col("total"), 6).alias("difference"))


def run_statistics(runs: DataFrame, column: str) -> DataFrame:
    """The best, worst, mean, geometric mean and median of a measure over runs of a partitioner; runs are few."""
    c = F.col(column).cast("double")
    return runs.agg(
        F.min(c).alias("best"), F.max(c).alias("worst"), F.round(F.avg(c), 6).alias("mean"), F.round(F.exp(F.avg(F.log(c))), 6).alias("geo_mean"),
        F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.count(c).alias("runs"),
    )


def imbalance_excess(vertices: DataFrame, targets: DataFrame, ub: list[float]) -> DataFrame:
    """``(con, excess)``: imbalance over the allowance of each constraint."""
    allowed = F.element_at(F.array(*map(F.lit, ub)), F.col("con") + 1)
    return imbalance(vertices, targets).select("con", F.round(F.col("imbalance") - allowed, 6).alias("excess"))


def kway_degrees(placed: DataFrame) -> DataFrame:
    """``(id, pid, internal, external, parts)``: weight inside and outside a vertex's part, and parts it touches."""
    return placed.groupBy(F.col("src").alias("id"), F.col("ps").alias("pid")).agg(
        F.sum(F.when(crosses(), 0).otherwise(F.col("wgt"))).alias("internal"),
        F.sum(F.when(crosses(), F.col("wgt")).otherwise(0)).alias("external"),
        F.count_distinct(F.when(crosses(), F.col("pd"))).alias("parts"),
    )


def kway_links(placed: DataFrame) -> DataFrame:
    """``(id, pid, to, wgt)``: weight from a vertex to each other part."""
    return placed.where(crosses()).groupBy(F.col("src").alias("id"), F.col("ps").alias("pid"), F.col("pd").alias("to")).agg(F.sum("wgt").alias("wgt"))


def boundary(placed: DataFrame, mode: str = "refine") -> DataFrame:
    """``(id)``: ``refine``, vertices with at least as much weight outside; ``balance``, with any outside."""
    held = F.col("external") >= F.col("internal") if mode == "refine" else F.col("external") > 0
    return kway_degrees(placed).where(held & (F.col("parts") > 0)).select("id")


def separator_degrees(placed: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, left, right)``: weights of the neighbours of separator vertices (part 2) in parts 0 and 1."""
    near = placed.where("ps = 2").join(weights.select(F.col("id").alias("dst"), "vwgt"), "dst")
    side = lambda p: F.sum(F.when(F.col("pd") == p, F.col("vwgt")).otherwise(0))
    return near.groupBy(F.col("src").alias("id")).agg(side(0).alias("left"), side(1).alias("right"))


def separator_from_cut(placed: DataFrame) -> DataFrame:
    """``(id, pid)``: every vertex with an edge across becomes part 2."""
    crossing = F.max(crosses())
    return placed.groupBy(F.col("src").alias("id"), "ps").agg(crossing.alias("c")).select("id", F.when(F.col("c"), 2).otherwise(F.col("ps")).cast("int").alias("pid"))


def separator_violations(placed: DataFrame) -> DataFrame:
    """Directed edges straight between parts 0 and 1."""
    return placed.agg(F.sum(((F.col("ps") + F.col("pd") == 1)).cast("long")).alias("violations"))


def separator_weight(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.coalesce(F.sum(F.when(F.col("pid") == 2, F.col("vwgt"))), F.lit(0)).alias("separator_weight"))


def volume_gains(placed: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``(id, to, gain)``: by how much the volume falls when a vertex moves to a part that it touches.

    A vertex sends its size to each other part it touches.  Moving ``v`` from ``a`` to ``b``: ``v``
    no longer sends to ``b``, but to ``a`` if it has a neighbour there.  A neighbour ``u`` stops
    sending to ``a`` if ``v`` was its only neighbour there (and ``u`` is not in ``a``), and starts
    sending to ``b`` if it had none there (and is not in ``b``).
    """
    size = placed.select(F.col("src").alias("id")).distinct().withColumn("vsize", F.lit(1)) if sizes is None else sizes
    per = placed.groupBy("src", "pd").agg(F.count("*").alias("n"))  # neighbours of u by part
    moves = placed.where(crosses()).select(F.col("src").alias("id"), F.col("ps").alias("from"), F.col("pd").alias("to")).distinct()
    inside = placed.groupBy(F.col("src").alias("id")).agg(F.max((~crosses()).cast("int")).alias("home"))
    own = moves.join(inside, "id").join(size.select("id", "vsize"), "id").select("id", "from", "to", (F.col("vsize") * (1 - F.col("home"))).alias("gain"))
    met = moves.join(placed.select(F.col("src").alias("id"), F.col("dst").alias("u"), F.col("pd").alias("pu")), "id")
    met = met.join(per.select(F.col("src").alias("u"), F.col("pd").alias("from"), F.col("n").alias("n_from")), ["u", "from"])
    met = met.join(per.select(F.col("src").alias("u"), F.col("pd").alias("to"), F.col("n").alias("n_to")), ["u", "to"], "left")
    met = met.join(size.select(F.col("id").alias("u"), "vsize"), "u")
    stops = (F.col("n_from") == 1) & (F.col("pu") != F.col("from"))
    starts = F.col("n_to").isNull() & (F.col("pu") != F.col("to"))
    change = F.col("vsize") * (stops.cast("int") - starts.cast("int"))
    near = met.select("id", "from", "to", change.alias("gain"))
    return own.union(near).groupBy("id", "to").agg(F.sum("gain").cast("long").alias("gain"))


def move_stats(part: DataFrame) -> DataFrame:
    """Vertices that leave home, and the most that leave or enter one part; ``part`` is ``(id, home, pid, vsize)``."""
    moved = part.where("home <> pid")
    flow = moved.groupBy("home", "pid").agg(F.count("*").alias("n"), F.sum("vsize").alias("v"))
    out = flow.groupBy("home").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).agg(F.max("n").alias("max_out"), F.max("v").alias("max_out_size"))
    into = flow.groupBy("pid").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).agg(F.max("n").alias("max_in"), F.max("v").alias("max_in_size"))
    total = flow.agg(F.sum("n").alias("n_moved"), F.sum("v").alias("total_v"))
    row = total.join(F.broadcast(out)).join(F.broadcast(into))  # one row each
    return row.select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_moved", "max_out", "max_in", "total_v", "max_out_size", "max_in_size")))


def overlap(part: DataFrame) -> DataFrame:
    """``(home, pid, size)``: how much of each home each part holds."""
    return part.groupBy("home", "pid").agg(F.sum("vsize").alias("size"))


def graph_bytes(edges: DataFrame, vertices: int, index: int = 8, weight: int = 8) -> DataFrame:
    """Bytes of the graph as offsets, neighbours and weights."""
    return edges.agg((F.count("*") * (index + weight) + (vertices + 1) * index + vertices * weight).cast("long").alias("bytes"))


def report(placed: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """One row: cut, volume, balance of the first constraint, heaviest part, and subdomain degrees."""
    held = loads(vertices).where("con = 0")
    heavy = held.agg(F.round(k * F.max("load") / F.sum("load"), 6).alias("balance"), F.max_by("pid", F.struct("load", -F.col("pid"))).alias("heaviest"))
    rows = edge_cut(placed).join(F.broadcast(comm_volume(placed))).join(F.broadcast(heavy))  # one row each
    return rows.join(F.broadcast(subdomain_degree_stats(placed)))
