"""Graph analytics in distributed rounds: levels, distances, random walks, itemsets, orders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.operators.components import connected_components
from meshloom.operators.graphs import degrees, vertices_of
from meshloom.operators.ordering import global_rank
from meshloom.plans.scratch import materialize


# -- components -------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of vertices on edges."""
    return connected_components(edges)


def components_in_parts(placed: DataFrame) -> DataFrame:
    """``(id, pid, component)``: components once edges between parts are gone."""
    own = placed.select(F.col("src").alias("id"), F.col("ps").alias("pid")).distinct()
    found = connected_components(placed.where("ps = pd"))
    return own.join(found, "id", "left").select("id", "pid", F.coalesce("component", "id").alias("component"))


def components_without(edges: DataFrame, part: DataFrame, separator: int = 2) -> DataFrame:
    """``(id, component)`` once the separator's vertices are gone."""
    kept = part.where(F.col("pid") != separator).select("id")
    inside = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = connected_components(inside)
    return kept.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_connected(edges: DataFrame, n_vertices: int | None = None) -> bool:
    row = connected_components(edges).agg(F.count_distinct("component").alias("c"), F.count("*").alias("n")).first()
    return row["c"] <= 1 and (n_vertices is None or row["n"] == n_vertices or n_vertices == 1)


def contiguity(placed: DataFrame) -> DataFrame:
    """``(pid, pieces)``: connected pieces of each part."""
    return components_in_parts(placed).groupBy("pid").agg(F.count_distinct("component").alias("pieces"))


def eliminate_fragments(placed: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, pid)``: each part keeps its heaviest piece; the others go to the part they have most weight to."""
    inside = materialize(components_in_parts(placed), "pieces")
    heavy = inside.join(weights, "id").groupBy("pid", "component").agg(F.sum("vwgt").alias("w"))
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("w"), "component"))
    small = heavy.withColumn("_nth", nth).where("_nth > 1").select("pid", "component")
    loose = inside.join(small, ["pid", "component"])
    links = placed.where("ps <> pd").join(loose.select(F.col("id").alias("src"), "component"), "src").groupBy("component", "pd").agg(F.sum("wgt").alias("w"))
    to = links.groupBy("component").agg(F.max_by("pd", F.struct("w", -F.col("pd"))).alias("to"))
    moved = loose.join(to, "component").select("id", "to")
    return inside.join(moved, "id", "left").select("id", F.coalesce("to", "pid").alias("pid"))


# -- searches ---------------------------------------------------------------


def bfs_levels(edges: DataFrame, root: DataFrame) -> DataFrame:
    """``(id, level)`` of the vertices reachable from ``root (id)``: a frontier join a level, written each round.

    Edges go both ways, so neighbours of a level are in it or in one beside it, and two fronts tell what is new.
    """
    links = materialize(edges.select("src", "dst").distinct(), "links")
    front = materialize(root.select("id").distinct().withColumn("level", F.lit(0)), "front")
    done, before, level = front, front, 0
    while not front.isEmpty():
        level += 1
        reached = front.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        new = reached.join(front.union(before).select("id"), "id", "left_anti")
        front, before = materialize(new.withColumn("level", F.lit(level)), "front"), front
        done = done.union(front)
        if level % 16 == 0:
            done = materialize(done, "levels")
    return done


def bfs_order(edges: DataFrame, root: DataFrame) -> DataFrame:
    """``(id, pos)``: by level, then by id; vertices that the root does not reach come last, by component."""
    levels = bfs_levels(edges, root)
    rest = connected_components(edges)
    met = rest.join(levels, "id", "left").select("id", "component", F.coalesce("level", F.lit(1 << 30)).alias("level"))
    return global_rank(met, ["level", "component", "id"], "pos").select("id", "pos")


def bfs_discovery(edges: DataFrame, root: DataFrame) -> DataFrame:
    """``(id, pos, level)`` in the order of discovery from ``root (id)``: by the place of the first neighbour before, then by id.

    A level is one join and one ranking over its own vertices; edges go both ways.
    """
    links = materialize(edges.select("src", "dst").distinct(), "links")
    front = materialize(global_rank(root.select("id").distinct(), ["id"], "pos").withColumn("level", F.lit(0)), "front")
    done, before, level, n = front, front.limit(0), 0, front.count()
    while (size := front.count()) > 0:
        level += 1
        reached = front.join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("pos").alias("by"))
        new = reached.join(front.union(before).select("id"), "id", "left_anti")
        placed = global_rank(new, ["by", "id"], "nth").select("id", (F.col("nth") + n).alias("pos"), F.lit(level).alias("level"))
        before, front = front, materialize(placed, "front")
        done = done.union(front)
        n += front.count()
        if level % 16 == 0:
            done = materialize(done, "order")
    return done


def articulation(placed: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(id, articulation)``: whether each of ``vertices (id)`` alone holds pieces of its own part together.

    ``placed`` has ``ps`` and ``pd``.  Each vertex asks for the components of its part without it, so ask for few.
    """
    inside = placed.where("ps = pd").select("src", "dst", "wgt")
    asked = vertices.select(F.col("id").alias("without")).distinct()
    # One graph for each asked vertex: the edges of its part that do not touch it, under ids of pairs.
    own = placed.select(F.col("src").alias("without"), F.col("ps").alias("part")).distinct().join(asked, "without")
    parted = placed.where("ps = pd").select("src", "dst", F.col("ps").alias("part"))
    left = own.join(parted, "part").where((F.col("src") != F.col("without")) & (F.col("dst") != F.col("without")))
    pair = lambda c: F.struct(F.col("without"), F.col(c).alias("v"))
    found = connected_components(left.select(pair("src").alias("src"), pair("dst").alias("dst")))
    near = inside.join(asked, F.col("src") == F.col("without")).where("src <> dst").select(F.struct("without", F.col("dst").alias("v")).alias("id")).distinct()
    pieces = near.join(found, "id", "left").groupBy(F.col("id.without").alias("id")).agg(F.count_distinct(F.coalesce("component", F.col("id"))).alias("n"))
    return asked.withColumnRenamed("without", "id").join(pieces, "id", "left").select("id", F.coalesce(F.col("n") > 1, F.lit(False)).alias("articulation"))


def sssp(edges: DataFrame, root: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, dist)``: least total weight from ``root (id)``; -1 for the others of ``vertices``.

    Rounds relax the edges of vertices whose distance fell, until none does.
    """
    links = materialize(edges.select("src", "dst", "wgt"), "links")
    zero = F.lit(0).cast(dict(edges.dtypes)["wgt"])
    known = front = materialize(root.select("id").distinct().withColumn("dist", zero), "front")
    while not front.isEmpty():
        offers = front.join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("wgt")).alias("new"))
        met = known.join(offers, "id", "full")
        known = materialize(
            met.select("id", F.least(F.coalesce("dist", "new"), F.coalesce("new", "dist")).alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("fell")),
            "distances",
        )
        front = known.where("fell").select("id", "dist")
        known = known.select("id", "dist")
    if vertices is None:
        return known
    return vertices.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("dist", F.lit(-1)).alias("dist"))


# -- random walks -----------------------------------------------------------


def pagerank(edges: DataFrame, walk: float = 0.85, rounds: int = 5, restart: DataFrame | None = None, eps: float | None = None) -> DataFrame:
    """``(id, pr)``: ``walk`` is the probability to follow an edge by weight; sinks and the rest restart.

    ``restart (id, r)`` sums to one, uniform without it.  Stops after ``rounds``, or once no rank moves
    by ``eps``.  Transition probabilities are made once; a round is one join and one sum.
    """
    nodes = vertices_of(edges)
    if restart is None:
        n = nodes.count()
        start = nodes.withColumn("r", F.lit(1.0) / n)
    else:
        start = nodes.join(restart, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"))
    start = materialize(start, "restart")
    out = edges.groupBy("src").agg(F.sum("wgt").alias("_total"))
    steps = materialize(edges.join(out, "src").select("src", "dst", (F.col("wgt") / F.col("_total")).alias("p")), "steps")
    sources = materialize(steps.select(F.col("src").alias("id")).distinct(), "sources")
    rank = start.select("id", F.col("r").alias("pr"))
    for _ in range(rounds):
        sunk = rank.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("_sunk"))
        moved = rank.join(steps, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pr") * F.col("p")).alias("_in"))
        value = F.lit(walk) * (F.col("_sunk") * F.col("r") + F.coalesce("_in", F.lit(0.0))) + (1 - walk) * F.col("r")
        new = materialize(start.join(moved, "id", "left").join(F.broadcast(sunk)).select("id", value.alias("pr")), "ranks")  # one row
        if eps is not None:
            change = new.join(rank.withColumnRenamed("pr", "_old"), "id").agg(F.max(F.abs(F.col("pr") - F.col("_old")))).first()[0]
            if change is None or change < eps:
                return new
        rank = new
    return rank


# -- orders -----------------------------------------------------------------


def compactness(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """The mean distance of positions over edges; ``positions`` is ``(id, pos)``."""
    a = positions.select(F.col("id").alias("src"), F.col("pos").alias("_a"))
    b = positions.select(F.col("id").alias("dst"), F.col("pos").alias("_b"))
    return edges.join(a, "src").join(b, "dst").agg(F.round(F.avg(F.abs(F.col("_a") - F.col("_b"))), 6).alias("compactness"))


def centroid_order(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """``(id, pos)``: vertices by the mean position of their neighbours, then by id."""
    b = positions.select(F.col("id").alias("dst"), F.col("pos").alias("_b"))
    means = edges.join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.round(F.avg("_b"), 6).alias("mean"))
    return global_rank(means, ["mean", "id"], "pos").select("id", "pos")


def itemsets(transactions: DataFrame, least: int, most: int = -1, min_len: int = 1, max_len: int = 3) -> DataFrame:
    """``(items, support)``: frequent sets of items of ``transactions (tid, item)``, sorted within.

    Level by level: transactions that hold a frequent set extend it by later frequent items.
    ``most`` and ``max_len`` -1: no bound.
    """
    base = materialize(transactions.select("tid", "item").distinct(), "transactions")
    inside = F.col("support") >= least
    if most >= 0:
        inside &= F.col("support") <= most
    frequent = base.groupBy("item").agg(F.count("*").alias("support")).where(inside)
    base = materialize(base.join(frequent.select("item"), "item", "left_semi"), "frequent-items")
    held = base.select("tid", F.array("item").alias("items"))
    found, size = None, 1
    while True:
        counts = materialize(held.groupBy("items").agg(F.count("*").alias("support")).where(inside), "itemsets")
        if counts.isEmpty():
            break
        if size >= min_len:
            found = counts if found is None else found.union(counts)
        if size == max_len:
            break
        kept = held.join(counts.select("items"), "items", "left_semi")
        held = kept.join(base.withColumnRenamed("item", "next"), "tid").where(F.col("next") > F.element_at("items", -1))
        held = materialize(held.select("tid", F.concat("items", F.array("next")).alias("items")), "extended")
        size += 1
    return found if found is not None else counts


def each_itemset(transactions: DataFrame, emit: Callable[[list, int], None], least: int, **bounds: int) -> None:
    """Call ``emit(items, support)`` once for each frequent set, where its row is; it must be picklable."""
    itemsets(transactions, least, **bounds).foreach(lambda r: emit(list(r["items"]), r["support"]))


def replicate(m: DataFrame, copies: int) -> DataFrame:
    """Disjoint copies of a matrix ``(row, col, val)``, ids shifted by its size."""
    size = m.agg((F.max(F.greatest("row", "col")) + 1).alias("_n"))
    ids = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_k")
    met = m.join(F.broadcast(size)).select("*", ids)  # one row
    return met.select((F.col("row") + F.col("_k") * F.col("_n")).alias("row"), (F.col("col") + F.col("_k") * F.col("_n")).alias("col"), "val")


def fill_in(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """``(nnz, ops)``: entries of the factor and operations after eliminating in order; components in parallel.

    A component's elimination tree is sequential, so each component is one task's work.
    """
    parts = connected_components(edges)
    placed = edges.join(positions.select(F.col("id").alias("src"), F.col("pos").alias("a")), "src").join(
        positions.select(F.col("id").alias("dst"), F.col("pos").alias("b")), "dst"
    ).join(parts.select(F.col("id").alias("src"), "component"), "src").select("component", "a", "b")
    rows = placed.groupBy("component").applyInPandas(_factor, "component long, nnz long, ops long")
    alone = positions.join(parts.select("id"), "id", "left_anti").agg(F.count("*").alias("nnz"))
    total = rows.agg(F.coalesce(F.sum("nnz"), F.lit(0)).alias("_nnz"), F.coalesce(F.sum("ops"), F.lit(0)).alias("ops"))
    return total.join(F.broadcast(alone)).select((F.col("_nnz") + F.col("nnz")).alias("nnz"), "ops")  # one row


def _factor(pairs: pd.DataFrame) -> pd.DataFrame:
    """Sizes of the factor's columns, from the sets that children hand to their parents."""
    order = np.unique(pairs["a"].to_numpy())
    a, b = np.searchsorted(order, pairs["a"]), np.searchsorted(order, pairs["b"])
    below: list[set[int]] = [set() for _ in order]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if y > x:
            below[x].add(y)
    nnz = ops = 0
    for v in range(len(order)):
        n = len(below[v]) + 1
        nnz += n
        ops += n * n - n
        if below[v]:
            parent = min(below[v])
            below[parent] |= below[v] - {parent}
        below[v] = set()
    return pd.DataFrame({"component": [pairs["component"].iloc[0]], "nnz": [nnz], "ops": [ops]})


def degree_order(edges: DataFrame) -> DataFrame:
    """``(id, pos)``: by degree, then by id; a baseline to compare orders with."""
    return global_rank(degrees(edges), ["degree", "id"], "pos").select("id", "pos")
