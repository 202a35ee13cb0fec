"""Vertex separators refined in rounds, and dissection orders built level by level.

All subgraphs of a level lie in one table, ``(id, node, vwgt)``, keyed by the node of
the dissection tree (1 is the whole graph, ``2 m`` and ``2 m + 1`` the sides of ``m``),
and are separated together.  Subgraphs of more than ``limit`` vertices are coarsened in
distributed rounds first; only coarse ones within the limit go to a task each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.kernels import csr, separators
from meshloom.operators import graphs
from meshloom.operators.ordering import global_rank, sum_within
from meshloom.operators.partitioning import _first, _moved, with_weights
from meshloom.plans.scratch import materialize, release

#: The label of a separator's vertices.
CUT = 2


def rows_of(vertices: DataFrame) -> DataFrame:
    """``(id, node, vwgt)`` of ``vertices (id, vwgt)`` as one subgraph; ``vwgt`` is a number or an array."""
    weight = _first() if dict(vertices.dtypes)["vwgt"].startswith("array") else F.col("vwgt")
    return vertices.select("id", F.lit(1).cast("long").alias("node"), weight.cast("long").alias("vwgt"))


def loads(held: DataFrame) -> DataFrame:
    """``(node, left, right, cut)``: weights of both sides and of the separator, of ``held (node, pid, vwgt)``."""
    side = lambda p, name: F.sum(F.when(F.col("pid") == p, F.col("vwgt")).otherwise(0)).alias(name)
    return held.groupBy("node").agg(side(0, "left"), side(1, "right"), side(CUT, "cut"))


def separator_round(edges: DataFrame, vertices: DataFrame, part: DataFrame, side: int, ub: float) -> DataFrame:
    """One round: vertices of the separators move to ``side``, and pull their neighbours on the other side in.

    A move gains the vertex's weight and loses that of the neighbours it pulls.  Moves of one round go to one
    side, so they never meet: a neighbour that several pull is lost once, and the round gains the sum of the
    gains or more.  Moves without gain are made while they lead to the lighter side.  A side takes moves, by
    falling gain, up to ``ub`` times half of its subgraph.  ``edges`` stay inside nodes; the same object is
    returned when nothing moves.
    """
    held = vertices.join(part, "id")
    bounds = loads(held).select("node", F.col("left" if side == 0 else "right").alias("_to"), F.col("right" if side == 0 else "left").alias("_from"), (F.col("left") + F.col("right") + F.col("cut")).alias("_all"))
    other = held.where(F.col("pid") == 1 - side).select(F.col("id").alias("dst"), F.col("vwgt").alias("_w"))
    pulled = edges.select("src", "dst").where("src <> dst").distinct().join(other, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("_w").alias("_pulled"))
    waiting = held.where(F.col("pid") == CUT).join(pulled, "id", "left").withColumn("gain", F.col("vwgt") - F.coalesce("_pulled", F.lit(0)))
    most = ub * F.col("_all") / 2
    # Those that do not fit alone would only stand in the way of others.
    waiting = waiting.where("gain >= 0").join(bounds, "node").where(F.col("_to") + F.col("vwgt") <= most)
    upto = sum_within(waiting.select("id", "node", "vwgt", "gain", "_to", "_from", "_all"), ["node"], "vwgt", [F.desc("gain"), F.col("id")], "_upto")
    room = F.col("_to") + F.col("_upto") <= most
    lighter = F.col("_to") + F.col("_upto") <= F.col("_from") - F.col("vwgt")
    chosen = materialize(upto.where(room & ((F.col("gain") > 0) | lighter)).select("id"), "leaving")
    if chosen.isEmpty():
        return part
    near = edges.select("src", "dst").join(chosen.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
    entering = near.join(other.select(F.col("dst").alias("id")), "id", "left_semi")
    moves = chosen.select("id", F.lit(side).alias("_to")).union(entering.select("id", F.lit(CUT).alias("_to")))
    return _moved(part, moves)


def refine_separators(edges: DataFrame, vertices: DataFrame, part: DataFrame, ub: float = 1.2, niter: int = 6) -> DataFrame:
    """``(id, pid)`` after rounds to both sides in turn, until neither moves anything; no separator gets heavier."""
    start, still = part, 0
    for turn in range(2 * niter):
        new = separator_round(edges, vertices, part, turn % 2, ub)
        still = still + 1 if new is part else 0
        if new is not part and part is not start:
            release(part)
        part = new
        if still == 2:
            break
    return part


def _largest(vertices: DataFrame) -> int:
    return vertices.groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _within(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose ends are in one node."""
    a, b = (vertices.select(F.col("id").alias(side), F.col("node").alias(f"_{side}")) for side in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst", "wgt")


def _shrunk(edges: DataFrame, vertices: DataFrame, limit: int, seed: int) -> list[tuple[DataFrame, DataFrame, DataFrame | None]]:
    """Levels ``(edges, vertices, cmap)`` from fine to coarse until no subgraph has more than ``limit`` vertices, or none shrinks."""
    levels, n = [], vertices.count()
    heaviest = vertices.groupBy("node").agg(F.sum("vwgt").alias("w")).agg(F.max("w")).first()[0] or 1
    while _largest(vertices) > limit:
        homes = vertices.select("id", F.col("node").alias("pid"))
        cmap = materialize(graphs.match(edges, vertices.select("id", "vwgt"), 3.0 * heaviest / limit, seed + len(levels), home=homes), "cmap")
        packed = vertices.join(cmap, "id").groupBy(F.col("cid").alias("id")).agg(F.min("node").alias("node"), F.sum("vwgt").alias("vwgt"))
        coarse = materialize(graphs.contract(edges, cmap), "coarse-edges"), materialize(packed, "coarse-vertices")
        fewer = coarse[1].count()
        if fewer > 0.95 * n:
            break
        levels.append((edges, vertices, cmap))
        (edges, vertices), n = coarse, fewer
    return [*levels, (edges, vertices, None)]


def _in_memory(pdf: pd.DataFrame) -> tuple[np.ndarray, csr.Graph]:
    vert = pdf[pdf["dst"].isna()].sort_values("src")
    ids, e = vert["src"].to_numpy(), pdf[pdf["dst"].notna()]
    src, dst = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"].astype("int64"))
    return ids, csr.build(len(ids), src, dst, e["wgt"].to_numpy(dtype=float), vert["vwgt"].to_numpy(dtype=np.int64))


def _by_node(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows of vertices and edges, ``(node, src, dst, wgt, vwgt)``, for a task a node."""
    own = vertices.select("node", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("long").alias("wgt"), "vwgt")
    return own.union(edges.join(vertices.select(F.col("id").alias("src"), "node"), "src").select("node", "src", "dst", F.col("wgt").cast("long"), F.lit(None).cast("long")))


def _first_separators(edges: DataFrame, vertices: DataFrame, ub: float, seed: int, nseps: int, limit: int) -> DataFrame:
    """``(id, pid)`` of coarse graphs: a task for each within ``limit``; larger ones, which did not shrink, are halved by a hash of ids."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, graph = _in_memory(pdf)
        return pd.DataFrame({"id": ids, "pid": separators.separator(graph, ub, seed, nseps).astype(np.int32)})

    small = vertices.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("node")
    within = vertices.join(small, "node", "left_semi")
    found = _by_node(edges.join(within.select(F.col("id").alias("src")), "src", "left_semi"), within).groupBy("node").applyInPandas(work, "id long, pid int")
    rest = vertices.join(small, "node", "left_anti").select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)).cast("int").alias("_half"))
    across = edges.join(rest.withColumnRenamed("id", "src"), "src").join(rest.select(F.col("id").alias("dst"), F.col("_half").alias("_there")), "dst")
    touching = across.where("_half = 0 and _there = 1").select(F.col("src").alias("id")).distinct().withColumn("_cut", F.lit(CUT))
    halved = rest.join(touching, "id", "left").select("id", F.coalesce("_cut", "_half").alias("pid"))
    return materialize(found.union(halved), "separators")


def separate(edges: DataFrame, vertices: DataFrame, ub: float = 1.2, limit: int = 20_000, seed: int = 4321, nseps: int = 1, niter: int = 6) -> DataFrame:
    """``(id, pid)``: sides 0 and 1 and separator 2 of every node of ``vertices (id, node, vwgt)`` at once; ``edges`` stay inside nodes.

    Coarse separators are projected, which keeps sides apart, and refined on every level.
    """
    levels = _shrunk(edges, vertices, limit, seed)
    coarse_edges, coarse_vertices, _ = levels[-1]
    part = _first_separators(coarse_edges, coarse_vertices, ub, seed, nseps, limit)
    if len(levels) > 1:
        part = refine_separators(coarse_edges, coarse_vertices, part, ub, niter)
    for fine_edges, fine_vertices, cmap in reversed(levels[:-1]):
        part = materialize(graphs.project(cmap, part), "projected")
        part = refine_separators(fine_edges, fine_vertices, part, ub, niter)
    return part


def vertex_separator_in_rounds(edges: DataFrame, vertices: DataFrame | None = None, ub: float = 1.2, limit: int = 20_000, seed: int = 4321, nseps: int = 1) -> DataFrame:
    """``(id, pid)``: parts 0 and 1 with no edge between them, and the separator 2; no task sees more than ``limit`` vertices."""
    rows = materialize(rows_of(with_weights(edges, vertices)), "vertices")
    inner = materialize(edges.where("src <> dst").select("src", "dst", F.col("wgt").cast("long").alias("wgt")), "edges")
    return separate(inner, rows, ub, limit, seed, nseps)


# -- dissection -------------------------------------------------------------


@dataclass(frozen=True)
class Dissection:
    """``order (id, node, pos)``, and the number of vertices of each node of the tree, ``sizes (nth, node, size)``.

    ``sizes`` is in the order of the leaves from left to right, then of the separators, lowest level first and from
    left to right, the whole graph's last.
    """

    order: DataFrame
    sizes: DataFrame


def _depth(node: Column) -> Column:
    return F.floor(F.log2(node) + 1e-9).cast("int")


def dissect(edges: DataFrame, levels: int, vertices: DataFrame | None = None, ub: float = 1.2, limit: int = 20_000, leaf: int = 120, seed: int = 4321, nseps: int = 1) -> Dissection:
    """A fill-reducing order over ``2 ** levels`` subgraphs: each side's vertices come before the separator of both.

    A level separates all its subgraphs together.  Labels are places in one order of all vertices, by the last leaf
    below their node, deeper nodes first.  Leaves within ``limit`` are ordered by a task each, larger ones by degree.
    """
    if levels < 0:
        raise ValueError("levels must not be negative")
    state = materialize(rows_of(with_weights(edges, vertices)), "vertices")
    inner = materialize(edges.where("src <> dst").select("src", "dst", F.lit(1).cast("long").alias("wgt")).distinct(), "edges")
    fixed: list[DataFrame] = []
    for level in range(levels):
        part = separate(inner, state, ub, limit, seed + level, nseps)
        split = materialize(state.join(part, "id"), "split")
        fixed.append(split.where(F.col("pid") == CUT).select("id", "node", "vwgt"))
        state = materialize(split.where(F.col("pid") != CUT).select("id", (2 * F.col("node") + F.col("pid")).alias("node"), "vwgt"), "vertices")
        inner = materialize(_within(inner, state), "edges")
    local = materialize(_leaf_orders(inner, state, ub, limit, leaf, seed, nseps), "leaf-orders")
    placed = local
    for cut in fixed:
        placed = placed.union(cut.select("id", "node", F.lit(0).cast("long").alias("nth")))
    depth = _depth(F.col("node"))
    # The leaves below node m of depth d are those from m << (levels - d) on; the last of them closes its subtree.
    last = F.expr(f"shiftleft(node + 1, {levels} - _depth) - 1")
    keyed = placed.withColumn("_depth", depth).withColumn("_last", last)
    order = global_rank(keyed, [F.col("_last"), F.desc("_depth"), F.col("nth"), F.col("id")], "pos").select("id", "node", "pos")
    order = materialize(order, "dissection")
    return Dissection(order, sizes(order, levels))


def sizes(order: DataFrame, levels: int) -> DataFrame:
    """``(nth, node, size)`` for every node of a tree of so many levels, those without vertices too; the tree is a parameter's size."""
    nodes = order.sparkSession.range(1, 1 << (levels + 1)).select(F.col("id").alias("node"))
    depth = _depth(F.col("node"))
    counts = order.groupBy("node").agg(F.count("*").alias("size"))
    # Nodes of greater depth come first: 2 ** (levels + 1) - 2 ** (depth + 1) of them.
    before = F.lit(1 << (levels + 1)) - F.expr("shiftleft(1L, _depth + 1)")
    rows = nodes.withColumn("_depth", depth).withColumn("nth", before + F.col("node") - F.expr("shiftleft(1L, _depth)"))
    return rows.join(counts, "node", "left").select("nth", "node", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def _leaf_orders(edges: DataFrame, vertices: DataFrame, ub: float, limit: int, leaf: int, seed: int, nseps: int) -> DataFrame:
    """``(id, node, nth)``: places of vertices within their leaves."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, graph = _in_memory(pdf)
        found = separators.nested_dissection(graph, leaf, ub, seed, nseps, 10, False)
        return pd.DataFrame({"id": ids[found], "node": pdf["node"].iloc[0], "nth": np.arange(len(ids))})

    small = vertices.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("node")
    within = vertices.join(small, "node", "left_semi")
    found = _by_node(edges.join(within.select(F.col("id").alias("src")), "src", "left_semi"), within).groupBy("node").applyInPandas(work, "id long, node long, nth long")
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_d"))
    rest = vertices.join(small, "node", "left_anti").join(degree, "id", "left").select("id", "node", F.coalesce("_d", F.lit(0)).cast("long").alias("nth"))
    return found.union(rest)


def sibling_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(edges)``: the number of edges between nodes of which neither is above the other; 0 in a dissection."""
    a, b = (order.select(F.col("id").alias(side), F.col("node").alias(f"_{side}")) for side in ("src", "dst"))
    met = edges.where("src <> dst").join(a, "src").join(b, "dst").withColumns({"_low": F.greatest("_src", "_dst"), "_high": F.least("_src", "_dst")})
    up = met.withColumns({"_dl": _depth(F.col("_low")), "_dh": _depth(F.col("_high"))})
    return up.agg(F.coalesce(F.sum((F.expr("shiftright(_low, _dl - _dh)") != F.col("_high")).cast("long")), F.lit(0)).alias("edges"))
