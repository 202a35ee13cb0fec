"""Partitions, separators and orders of graphs given as tables.

Graphs up to ``kernel_size`` vertices and edges go whole to one task and its
kernel, as a group of ``applyInPandas``.  Larger ones are first coarsened by
distributed rounds of matching and contraction; the kernel partitions the
coarsest graph, and distributed rounds of batch moves refine it on the way back.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.kernels import csr, separators
from meshloom.kernels import partition as kernels
from meshloom.operators import analytics, clusters, graphs, metrics
from meshloom.operators.ordering import global_rank, running_sum, sums_within
from meshloom.plans.options import OrderOptions, PartitionOptions
from meshloom.plans.scratch import materialize, release


#: Groups ``(id, cid)`` from edges, weights ``(id, vwgt)`` and the most that a group may weigh.
First = Callable[[DataFrame, DataFrame, float], DataFrame]


def with_weights(edges: DataFrame, vertices: DataFrame | None) -> DataFrame:
    """``(id, vwgt)`` with ``vwgt`` an array; ones for vertices that are only on edges."""
    if vertices is None:
        return graphs.vertices_of(edges).withColumn("vwgt", F.array(F.lit(1).cast("long")))
    if "vwgt" not in vertices.columns:
        return vertices.select("id").distinct().withColumn("vwgt", F.array(F.lit(1).cast("long")))
    array = dict(vertices.dtypes)["vwgt"].startswith("array")
    w = F.col("vwgt") if array else F.array(F.col("vwgt"))
    return vertices.select("id", F.transform(w, lambda x: x.cast("long")).alias("vwgt"))


def volume_weights(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edge weights for the volume objective: one and the sizes of both ends."""
    a = sizes.select(F.col("id").alias("src"), F.col("vsize").alias("_a"))
    b = sizes.select(F.col("id").alias("dst"), F.col("vsize").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (1 + F.col("_a") + F.col("_b")).alias("wgt"))


def _in_kernel(edges: DataFrame, vertices: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(ids, graph)`` on the whole graph in one task; it returns columns by vertex or a table."""
    rows = vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("long").alias("wgt"), "vwgt").union(
        edges.select("src", "dst", F.col("wgt").cast("long"), F.lit(None).cast("array<long>"))
    )

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        vert = pdf[pdf["dst"].isna()].sort_values("src")
        ids = vert["src"].to_numpy()
        e = pdf[pdf["dst"].notna()]
        src, dst = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"].astype("int64"))
        vwgt = np.array(vert["vwgt"].tolist(), dtype=np.int64)
        return kernel(ids, csr.build(len(ids), src, dst, e["wgt"].to_numpy(dtype=float), vwgt))

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(work, schema)


def _kernel_partition(options: PartitionOptions):
    shares, ub = np.array(options.tpwgts), np.array(options.ubvec)

    def run(ids: np.ndarray, g: csr.Graph) -> pd.DataFrame:
        if options.ptype == "rb":
            where = kernels.recursive_bisection(g, shares, ub, np.random.default_rng(options.seed), options.niter, "grow" if options.iptype == "kway" else options.iptype)
        else:
            where = kernels.kway(
                g, shares, ub, options.seed, options.ncuts, options.niter, options.objtype, options.ctype != "rm", not options.no2hop, options.ctype, options.iptype, options.rtype
            )
        if options.minconn:
            where = kernels.minimise_connectivity(g, where, shares, ub)
        if options.contig:
            where = kernels.eliminate_fragments(g, where)
        return pd.DataFrame({"id": ids, "pid": where.astype(np.int32)})

    return run


def _first(column: str = "vwgt"):
    return F.get(column, F.lit(0))


def coarsen(
    edges: DataFrame, vertices: DataFrame, target: int, seed: int, most: int = 40, home: DataFrame | None = None, ctype: str = "shem", two_hop: bool = True,
    enough: int = 0, first: First | None = None, block: int = 0,
) -> list[tuple[DataFrame, DataFrame, DataFrame | None]]:
    """Levels ``(edges, vertices, cmap)`` from fine to coarse, each written; ends at ``target`` or when it hardly shrinks.

    It ends, too, once vertices and edges together are no more than ``enough``.

    ``ctype``: ``shem`` matches along heavy edges, ``rm`` along any, ``fc`` forms star clusters.  With ``two_hop``,
    vertices left alone are paired by shared neighbours once they are more than a tenth.  With ``home (id, pid)``,
    only vertices of one home come together.  With ``block``, ``shem`` and ``rm`` match within :func:`block_groups`
    first, several times on a level, and all over the graph where blocks hold too few edges.
    """
    if ctype not in ("shem", "rm", "fc"):
        raise ValueError(f"ctype {ctype!r} takes graphs within kernel_size only")
    levels = []
    n = vertices.count()
    total = vertices.agg(F.sum(_first())).first()[0] or 1
    cap = 1.5 * total / max(target, 1)
    for level in range(most):
        if n <= target or edges.isEmpty():
            break
        few = n <= graphs.SENT
        loads = vertices.select("id", _first().alias("vwgt"))
        if level == 0 and first is not None:
            cmap = first(edges, loads, cap)
        elif ctype == "fc":
            cmap = clusters.star_clusters(edges, loads, cap, seed + 16 * level, home=home)
        elif block and (found := block_groups(edges, loads, cap, n, block, seed + level, ctype == "shem", two_hop)) is not None:
            cmap = found
        else:
            cmap = materialize(graphs.match(edges, loads, cap, seed + level, home=home, heavy=ctype == "shem", few=few), "cmap")
        if two_hop and not (level == 0 and first is not None) and clusters.unmatched(cmap).count() > n / 10:
            cmap = clusters.two_hop(edges, loads, cmap, cap, home=home)
        if home is not None:
            home = materialize(lifted(cmap, home), "coarse-homes")
        weights = vertices.select("id", F.posexplode("vwgt").alias("con", "w")).join(cmap, "id").groupBy(F.col("cid").alias("id"), "con").agg(F.sum("w").alias("w"))
        packed = weights.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("con", "w"))), lambda x: x["w"]).alias("vwgt"))
        coarse = materialize(graphs.contract(edges, cmap, few, ranged=True), "coarse-edges"), materialize(packed, "coarse-vertices")
        fewer = coarse[1].count()
        if fewer > 0.95 * n:
            if level == 0 and first is not None:  # points that say little of the edges: match from the next level on
                continue
            break
        levels.append((edges, vertices, cmap))
        (edges, vertices), n = coarse, fewer
        if enough and n + edges.count() <= enough:
            break
    return [*levels, (edges, vertices, None)]


#: By how much a block's task shrinks its vertices on one level, at most.
SHRINK = 16
#: Edges within blocks that a vertex needs, on average, so that blocks shrink well.
WITHIN = 2


def block_groups(edges: DataFrame, loads: DataFrame, cap: float, n: int, size: int, seed: int = 0, heavy: bool = True, two_hop: bool = True) -> DataFrame | None:
    """``(id, cid)``: vertices that follow one another by id form blocks, and a task matches inside each, time and again; none where too few edges are inside.

    A block's vertices and all their edges are no more than ``size``, but for those of its last vertex, of which the block
    holds only the edges to its other vertices.  Groups weigh no more than ``cap``, by ``loads (id, vwgt)`` of ``n`` rows.
    """
    few = n <= graphs.SENT
    counts = edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_edges"))
    sized = loads.select("id", F.coalesce("vwgt", F.lit(0)).alias("vwgt")).join(counts, "id", "left").withColumn("_size", 1 + F.coalesce("_edges", F.lit(0)))
    upto = running_sum(sized, "_size", ["id"], "_upto")
    blocks = materialize(upto.select("id", "vwgt", F.floor((F.col("_upto") - F.col("_size")) / size).cast("long").alias("block")), "blocks")
    side = lambda c: graphs.sent(blocks.select(F.col("id").alias(c), F.col("block").alias(f"_{c}")), few)
    inside = edges.where("src <> dst").join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst")
    inside = materialize(inside.select(F.col("_src").alias("block"), "src", "dst", "wgt"), "inside")
    if inside.count() < WITHIN * n:
        release(blocks, inside)
        return None

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        vert, e = pdf[pdf["dst"].isna()].sort_values("src"), pdf[pdf["dst"].notna()]
        ids, vwgt = vert["src"].to_numpy(), vert["wgt"].to_numpy(dtype=np.int64)
        g = csr.build(len(ids), np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"].astype("int64")), e["wgt"].to_numpy(dtype=float), vwgt)
        target = max(len(ids) // SHRINK, math.ceil(1.5 * vwgt.sum() / max(cap, 1)))
        found = kernels.groups(g, cap, target, np.random.default_rng([seed, int(pdf["block"].iloc[0])]), heavy, two_hop)
        return pd.DataFrame({"id": ids, "cid": ids[found]})

    rows = blocks.select("block", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("vwgt").cast("long").alias("wgt")).union(inside)
    cmap = materialize(rows.groupBy("block").applyInPandas(work, "id long, cid long"), "cmap")
    release(blocks, inside)
    return cmap


def lifted(cmap: DataFrame, part: DataFrame) -> DataFrame:
    """``(id, pid)`` of coarse vertices whose fine ones all have one part."""
    return cmap.join(part, "id").groupBy(F.col("cid").alias("id")).agg(F.min("pid").alias("pid"))


def _counted_loads(vertices: DataFrame, part: DataFrame, options: PartitionOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Loads, shares of the total and allowed loads, a row a part and a column a constraint; the number of vertices."""
    k, ncon, n = options.nparts, len(options.ubvec), 0
    load = np.zeros((k, ncon))
    weights = [F.sum(F.coalesce(F.get("vwgt", F.lit(c)), F.lit(0))).alias(f"w{c}") for c in range(ncon)]
    for r in part.join(vertices.select("id", "vwgt"), "id").groupBy("pid").agg(F.count("*").alias("n"), *weights).collect():  # k rows
        load[r["pid"]] = [r[f"w{c}"] for c in range(ncon)]
        n += r["n"]
    fair = np.maximum(np.array(options.tpwgts) * load.sum(0), 1e-9)
    return load, fair, fair * np.array(options.ubvec), n


def _loads(vertices: DataFrame, part: DataFrame, options: PartitionOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loads, shares of the total and allowed loads, a row a part and a column a constraint."""
    return _counted_loads(vertices, part, options)[:3]


def _rooms(edges: DataFrame, load: np.ndarray, fair: np.ndarray, most: np.ndarray) -> DataFrame:
    """``(to, full, room0 ..., load0 ..., fair0 ...)``: how full each part is, and what it still takes, holds and should hold of each constraint."""
    ncon = range(load.shape[1])
    rows = [(p, float((load[p] / fair[p]).max()), *map(float, [*(most[p] - load[p]), *load[p], *fair[p]])) for p in range(len(load))]
    names = ", ".join(f"{n}{c} double" for n in ("room", "load", "fair") for c in ncon)
    return F.broadcast(edges.sparkSession.createDataFrame(rows, f"to int, full double, {names}"))  # k rows


def _weights(vertices: DataFrame, ncon: int) -> DataFrame:
    return vertices.select("id", *(F.coalesce(F.get("vwgt", F.lit(c)), F.lit(0)).alias(f"w{c}") for c in range(ncon)))


def _every(conditions: list):
    return reduce(lambda a, b: a & b, conditions)


def _admitted(moves: DataFrame, ncon: int, few: bool = False) -> DataFrame:
    """The moves ``(id, to, gain, relieves, w0 ..., room0 ...)`` that a part has room for, by falling gain.

    Running sums are dealt by ranges, so a part may have any number of candidates, but where the vertices are
    ``few``.  ``relieves``: one that may enter without room, if it is the first.
    """
    sums = {f"upto{c}": F.col(f"w{c}") for c in range(ncon)} | {"nth": F.lit(1)}
    upto = sums_within(moves, ["to"], sums, [F.desc("gain"), F.col("id")], few)
    # A constraint of which a vertex has nothing does not keep it out.
    fits = _every([(F.col(f"w{c}") == 0) | (F.col(f"upto{c}") <= F.col(f"room{c}")) for c in range(ncon)])
    return upto.where(fits | ((F.col("nth") == 1) & F.col("relieves"))).select("id", F.col("to").alias("_to"))


def _moved(part: DataFrame, chosen: DataFrame) -> DataFrame:
    """The partition after the moves; the same object where there are none."""
    new = part.join(chosen, "id", "left").select("id", F.coalesce("_to", "pid").alias("pid"), F.col("_to").isNotNull().alias("_moved"))
    new = materialize(new, "refined")
    if new.where("_moved").isEmpty():
        release(new)
        return part
    return new.select("id", "pid")


@dataclass(frozen=True)
class Stay:
    """What moving away from home costs: ``rows (id, home, vsize)``, and the prices of a unit of cut and of size."""

    rows: DataFrame
    ipc: float = 1000.0
    redist: float = 1.0


def refine_round(edges: DataFrame, vertices: DataFrame, part: DataFrame, options: PartitionOptions, turn: int, stay: Stay | None = None, seen: list[tuple[int, bool]] | None = None) -> DataFrame:
    """One round of batch moves: a vertex moves where it has more weight, within the room of the part.

    With ``stay``, what a move gains in cut, times ``ipc``, is weighed against ``redist`` times the vertex's
    size: gained by going home, lost by leaving it.

    A round admits one direction between two parts only, so that neighbours do not swap.  Vertices of
    parts above their bound, in any constraint, leave for parts below it whatever the gain, as
    many as the excess asks for.  The same object is returned when nothing moves.  ``seen`` gets the cut, in both
    directions, and whether a part is above its bound, as they are before the round.
    """
    k, ncon = options.nparts, len(options.ubvec)
    if k == 1:
        return part
    load, fair, most, n = _counted_loads(vertices, part, options)
    few = n <= graphs.SENT
    rooms, weight = _rooms(edges, load, fair, most), _weights(vertices, ncon)
    heavy = [p for p in range(k) if (load[p] > most[p]).any()]
    # Edges meet the parts of one end; those of the other meet the sums.  Written once, as the round reads it several times.
    ends = edges.join(graphs.sent(part.select(F.col("id").alias("dst"), F.col("pid").alias("pd")), few), "dst").groupBy("src", "pd").agg(F.sum("wgt").alias("w"))
    links = materialize(ends.join(graphs.sent(part.select(F.col("id").alias("src"), F.col("pid").alias("ps")), few), "src").select("src", "ps", "pd", "w"), "links")
    if seen is not None:
        seen.append((links.where("ps <> pd").agg(F.sum("w")).first()[0] or 0, bool(heavy)))
    own = links.where("ps = pd").select(F.col("src").alias("id"), F.col("w").alias("home"))
    side = lambda c: F.pmod(F.xxhash64(c, F.lit(options.seed + turn // 2)), F.lit(1 << 30))
    forward = (side("ps") < side("pd")) if turn % 2 == 0 else (side("ps") > side("pd"))
    offers = links.where((F.col("ps") != F.col("pd")) & forward & ~F.col("ps").isin(heavy)).join(own, links["src"] == own["id"], "left").select(
        links["src"].alias("vid"), "ps", "pd", (F.col("w") - F.coalesce("home", F.lit(0))).alias("gain")
    )
    if stay is not None:
        homes = stay.rows.select(F.col("id").alias("vid"), F.col("home").alias("_home"), "vsize")
        toward = (F.col("pd") == F.col("_home")).cast("int") - (F.col("ps") == F.col("_home")).cast("int")
        offers = offers.join(homes, "vid").select("vid", "pd", (stay.ipc * F.col("gain") + stay.redist * F.col("vsize") * toward).alias("gain"))
    best = offers.where("gain > 0").groupBy("vid").agg(F.max(F.struct("gain", -F.col("pd"))).alias("b"))
    best = best.select(F.col("vid").alias("id"), (-F.col("b.col2")).cast("int").alias("to"), F.col("b.gain").alias("gain"))
    asked = ["id", "to", "gain", *(f"{n}{c}" for n in ("w", "room") for c in range(ncon))]
    moves = best.join(weight, "id").join(rooms, "to").select(*asked, F.lit(False).alias("relieves"))
    if heavy:
        moves = moves.unionByName(_relief(links, own, weight, part, rooms, heavy, load, fair, most))
    new = _moved(part, _admitted(moves, ncon, few))
    release(links)
    return new


#: Parts that a vertex of an overweight part may go to beside those it touches: the least full ones.
SPARE = 8


def _relief(links: DataFrame, own: DataFrame, weight: DataFrame, part: DataFrame, rooms: DataFrame, heavy: list[int], load, fair, most) -> DataFrame:
    """Moves out of the parts ``heavy``: each vertex to its best part that can take it, until the excess is gone.

    It may go to parts that it touches, to the ``SPARE`` least full ones and to the roomiest of each constraint.
    """
    ncon = load.shape[1]
    rows = [(p, float((load[p] / fair[p]).max()), *map(float, load[p] - most[p])) for p in heavy]
    over = part.sparkSession.createDataFrame(rows, "pid int, _full double, " + ", ".join(f"over{c} double" for c in range(ncon)))
    useful = reduce(lambda a, b: a | b, [(F.col(f"over{c}") > 0) & (F.col(f"w{c}") > 0) for c in range(ncon)])
    held = part.join(F.broadcast(over), "pid").join(weight, "id").where(useful).join(own, "id", "left")  # a row a part
    full = (load / fair).max(1)
    spare = {int(p) for p in np.argsort(full, kind="stable")[:SPARE]} | {int((most - load)[:, c].argmax()) for c in range(ncon)}
    near = links.select(F.col("src").alias("id"), F.col("pd").alias("to"), "w")
    either = held.select("id", F.explode(F.array(*(F.lit(p) for p in sorted(spare)))).alias("to"), F.lit(0).cast("long").alias("w"))
    either = either.union(near.join(held.select("id"), "id", "left_semi").select("id", "to", F.col("w").cast("long")))
    pairs = either.groupBy("id", "to").agg(F.sum("w").alias("w")).join(held, "id").join(rooms, "to").where("pid <> to")
    fits = _every([(F.col(f"w{c}") == 0) | (F.col(f"w{c}") <= F.col(f"room{c}")) for c in range(ncon)])
    lighter = F.greatest(F.lit(0.0), *((F.col(f"load{c}") + F.col(f"w{c}")) / F.col(f"fair{c}") for c in range(ncon))) < F.col("_full")
    pairs = pairs.withColumns({"gain": F.col("w") - F.coalesce("home", F.lit(0)), "relieves": lighter}).where(fits | lighter)
    names = ["pid", "to", "gain", "relieves", *(f"{n}{c}" for c in range(ncon) for n in ("w", "room", "over"))]
    best = pairs.groupBy("id").agg(F.max_by(F.struct(*names), F.struct(fits, "gain", -F.col("full"), -F.col("to"))).alias("b")).select("id", "b.*")
    out = sums_within(best, ["pid"], {f"out{c}": F.col(f"w{c}") for c in range(ncon)}, [F.desc("gain"), F.col("id")])
    asked = reduce(lambda a, b: a | b, [(F.col(f"w{c}") > 0) & (F.col(f"out{c}") - F.col(f"w{c}") < F.col(f"over{c}")) for c in range(ncon)])
    return out.where(asked).select("id", "to", "gain", *(f"w{c}" for c in range(ncon)), *(f"room{c}" for c in range(ncon)), "relieves")


def volume_round(edges: DataFrame, vertices: DataFrame, part: DataFrame, options: PartitionOptions, turn: int) -> DataFrame:
    """One round of moves that lower the communication volume, within the room of the parts.

    Movers are more than two edges apart, so that their gains add up: of those that are nearer the
    one of the largest gain stays.  The same object is returned when nothing moves.
    """
    ncon = len(options.ubvec)
    load, fair, most = _loads(vertices, part, options)
    edges = edges.where("src <> dst")
    gains = metrics.volume_gains(metrics.with_parts(edges, part)).where("gain > 0").withColumn("to", F.col("to").cast("int"))
    fits = _every([(F.col(f"w{c}") == 0) | (F.col(f"w{c}") <= F.col(f"room{c}")) for c in range(ncon)])
    open_ = gains.join(_weights(vertices, ncon), "id").join(_rooms(edges, load, fair, most), "to").where(fits)
    rank = F.struct("gain", F.xxhash64("id", F.lit(options.seed + turn)).alias("h"), "id")
    names = ["to", "gain", *(f"{n}{c}" for c in range(ncon) for n in ("w", "room"))]
    best = open_.withColumn("rank", rank).groupBy("id").agg(F.max_by(F.struct(*names, "rank"), F.struct("gain", -F.col("to"))).alias("b")).select("id", "b.*")
    best = materialize(best, "volume-moves")
    reach = best.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("u")), "id").select("id", "u", "rank").union(best.select("id", F.col("id").alias("u"), "rank"))
    first = reach.groupBy("u").agg(F.max("rank").alias("top"))
    apart = reach.join(first, "u").groupBy("id").agg(F.min(F.col("rank") == F.col("top")).alias("ok")).where("ok").select("id")
    moves = best.join(apart, "id", "left_semi").withColumn("relieves", F.lit(False))
    return _moved(part, _admitted(moves, ncon))


#: Share of the cut that both directions together must save, or else refinement of a level has settled.
SAVED = 0.002


def _refined(edges: DataFrame, vertices: DataFrame, part: DataFrame, options: PartitionOptions) -> DataFrame:
    """Rounds of moves for less cut on one level, until it has settled."""
    seen: list[tuple[int, bool]] = []

    def settled() -> bool:
        """Two rounds after another, all parts are within bounds and the cut has hardly become less."""
        return len(seen) > 2 and not seen[-1][1] and not seen[-3][1] and seen[-1][0] > (1 - SAVED) * seen[-3][0]

    return _rounds(lambda e, v, p, o, turn: refine_round(e, v, p, o, turn, seen=seen), edges, vertices, part, options, settled)


def _rounds(step, edges: DataFrame, vertices: DataFrame, part: DataFrame, options: PartitionOptions, settled: Callable[[], bool] = lambda: False) -> DataFrame:
    """Twice ``niter`` rounds at most, as a round is one direction; ends when both directions move nothing, or when it has ``settled``."""
    still = 0
    for turn in range(2 * options.niter):
        new = step(edges, vertices, part, options, turn)
        still = still + 1 if new is part else 0
        part = new
        if still == 2 or settled():
            break
    return part


def less_connected(edges: DataFrame, vertices: DataFrame, part: DataFrame, options: PartitionOptions) -> DataFrame:
    """Give up weak links between parts while the largest number of neighbour parts is 1.4 times the mean."""
    k, ncon = options.nparts, len(options.ubvec)
    for _ in range(4 * k):
        placed = metrics.with_parts(edges, part)
        link = np.zeros((k, k))
        for r in metrics.subdomain_graph(placed).collect():  # k * k rows
            link[r["ps"], r["pd"]] = r["wgt"]
        degree = (link > 0).sum(1)
        if degree.max(initial=0) < 1.4 * max(degree.mean(), 1e-9):
            return part
        a = int(np.argmax(degree))
        b = min(np.flatnonzero(link[a]).tolist(), key=lambda p: (link[a, p], p))
        allowed = [p for p in np.flatnonzero(link[b]).tolist() if p not in (a, b)]
        rim = placed.where((F.col("ps") == a) & (F.col("pd") == b)).select("src").distinct()
        to = placed.join(rim, "src", "left_semi").where(F.col("pd").isin(allowed)).groupBy("src", "pd").agg(F.sum("wgt").alias("w"))
        to = to.groupBy("src").agg(F.max_by("pd", F.struct("w", -F.col("pd"))).alias("_to"))
        plan = materialize(rim.join(to, "src", "left").select(F.col("src").alias("id"), "_to"), "unlinked")
        if not plan.where("_to is null").isEmpty():
            break
        new = _moved(part, plan)
        load, _, most = _loads(vertices, new, options)
        before = _loads(vertices, part, options)[0]
        if ((load > most) & (load > before)).any():
            break
        part = new
    warnings.warn("a part still has 1.4 times the mean number of neighbour parts or more", RuntimeWarning, stacklevel=2)
    return part


def whole_parts(edges: DataFrame, vertices: DataFrame, part: DataFrame, most: int = 32) -> DataFrame:
    """Fragments of parts join their neighbours, one direction between parts a turn, until none is left that can."""
    still = 0
    for turn in range(most):
        new = analytics.eliminate_fragments(metrics.with_parts(edges, part), vertices.select("id", _first().alias("vwgt")))
        met = new.select("id", F.col("pid").alias("_to")).join(part, "id").where("_to < pid" if turn % 2 else "_to > pid").select("id", "_to")
        found = _moved(part, met)
        still = still + 1 if found is part else 0
        part = found
        if still == 2:
            return part
    warnings.warn(f"fragments still join other parts after {most} turns", RuntimeWarning, stacklevel=2)
    return part


def _redealt(edges: DataFrame) -> DataFrame:
    """The written edges once more, as rounds read them."""
    again = materialize(graphs.dealt(edges), "edges")
    release(edges)
    return again


def partition(edges: DataFrame, options: PartitionOptions, vertices: DataFrame | None = None, first: First | None = None) -> DataFrame:
    """``(id, pid)`` of every vertex; ``first``, where given, makes the groups of the first level of coarsening."""
    vertices = materialize(with_weights(edges, vertices), "vertices")
    ncon = vertices.agg(F.max(F.size("vwgt"))).first()[0] or 1
    options = options.checked(ncon)
    if options.nparts == 1:
        return vertices.select("id", F.lit(0).alias("pid"))
    edges = materialize(edges.select("src", "dst", F.col("wgt").cast("long").alias("wgt")), "edges")
    size = edges.count() + vertices.count()
    if size <= options.kernel_size:
        return materialize(_in_kernel(edges, vertices, _kernel_partition(options), "id long, pid int"), "partition")
    if options.rtype != "greedy":
        raise ValueError(f"rtype {options.rtype!r} takes graphs within kernel_size only")
    edges = _redealt(edges)
    # So many vertices have no more edges than the kernel takes; where edges are few, it takes more vertices.
    target = max(30 * options.nparts, math.isqrt(options.kernel_size))
    levels = coarsen(edges, vertices, target, options.seed, ctype=options.ctype, two_hop=not options.no2hop, enough=options.kernel_size, first=first, block=options.kernel_size)
    coarse_edges, coarse_vertices, _ = levels[-1]
    part = materialize(_in_kernel(coarse_edges, coarse_vertices, _kernel_partition(options), "id long, pid int"), "partition")
    for fine_edges, fine_vertices, cmap in reversed(levels[:-1]):
        part = materialize(graphs.project(cmap, part), "projected")
        part = _refined(fine_edges, fine_vertices, part, options)
    if options.objtype == "vol":
        part = _rounds(volume_round, edges, vertices, part, options)
    if options.minconn:
        part = less_connected(edges, vertices, part, options)
    if options.contig:
        part = whole_parts(edges, vertices, part)
    return part


def vertex_separator(edges: DataFrame, vertices: DataFrame | None = None, ub: float = 1.2, seed: int = 4321, nseps: int = 1) -> DataFrame:
    """``(id, pid)``: parts 0 and 1 with no edge between them, and the separator 2."""
    vertices = with_weights(edges, vertices)
    run = lambda ids, g: pd.DataFrame({"id": ids, "pid": separators.separator(g, ub, seed, nseps).astype(np.int32)})
    return materialize(_in_kernel(edges, vertices, run, "id long, pid int"), "separator")


def nested_dissection(edges: DataFrame, options: OrderOptions | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, pos)``: a fill-reducing order.

    Dense vertices may be put off to the last, vertices of one neighbourhood are ordered together, and
    components are dissected in parallel, one task each.
    """
    options = (options or OrderOptions()).checked()
    vertices = materialize(with_weights(edges, vertices).select("id"), "vertices")
    edges = materialize(edges.select("src", "dst", F.lit(1).cast("long").alias("wgt")), "edges")
    late = None
    if options.pfactor > 0:
        late = materialize(graphs.prune_dense(edges, options.pfactor / 10).where("dense").select("id"), "dense")
        edges = materialize(graphs.without(edges, late), "edges")
    groups = vertices.withColumn("cid", F.col("id"))
    work = edges
    if options.compress:
        mapping = materialize(graphs.compress_identical(edges), "compressed")
        if graphs.worth_compressing(mapping):
            groups = materialize(vertices.join(mapping, "id", "left").select("id", F.coalesce("cid", "id").alias("cid")), "groups")
            work = materialize(graphs.contract(edges, groups).withColumn("wgt", F.lit(1).cast("long")), "edges")
    weights = groups.groupBy(F.col("cid").alias("id")).agg(F.count("*").alias("vwgt"))
    parts = materialize(weights.join(analytics.components(work), "id", "left").select("id", "vwgt", F.coalesce("component", "id").alias("part")), "parts")
    rows = parts.select("part", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "vwgt").union(
        work.join(parts.select(F.col("id").alias("src"), "part"), "src").select("part", "src", "dst", F.lit(None).cast("long"))
    )
    ub = 1 + options.ufactor / 1000

    def dissect(pdf: pd.DataFrame) -> pd.DataFrame:
        vert = pdf[pdf["dst"].isna()].sort_values("src")
        ids, e = vert["src"].to_numpy(), pdf[pdf["dst"].notna()]
        src, dst = np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"].astype("int64"))
        g = csr.build(len(ids), src, dst, np.ones(len(e)), vert["vwgt"].to_numpy(dtype=np.int64))
        order = separators.nested_dissection(g, options.leaf, ub, options.seed, options.nseps, options.niter, options.ccorder)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "id": ids[order], "nth": np.arange(len(ids))})

    placed = materialize(rows.groupBy("part").applyInPandas(dissect, "part long, id long, nth long"), "dissected")
    full = groups.join(placed.withColumnRenamed("id", "cid"), "cid").withColumn("late", F.lit(0))
    if late is not None:
        full = full.join(late.withColumn("_l", F.lit(1)), "id", "left").withColumn("late", F.coalesce("_l", F.lit(0)))
    return global_rank(full.select("id", "late", "part", "nth"), ["late", "part", "nth", "id"], "pos").select("id", "pos")


def inverse(order: DataFrame) -> DataFrame:
    """``(pos, id)`` read the other way, as ``(id, pos)``."""
    return order.select(F.col("pos").alias("id"), F.col("id").alias("pos"))


# -- meshes -----------------------------------------------------------------


def partition_mesh(incidence: DataFrame, options: PartitionOptions, by: str = "dual", ncommon: int = 1) -> tuple[DataFrame, DataFrame]:
    """Parts of elements and of nodes, ``(id, pid)`` each.

    ``dual``: elements are partitioned and nodes induced; ``nodal``: the other way round.
    """
    from meshloom.operators import mesh

    inc = materialize(incidence.select("elem", "node").distinct(), "incidence")
    if by == "dual":
        edges = mesh.dual_graph(inc, ncommon, relaxed=True).where("src <> dst")
        own = partition(edges, options, inc.select(F.col("elem").alias("id")).distinct())
        rows = inc.select(F.col("node").alias("id"), F.col("elem").alias("via"))
    else:
        own = partition(mesh.nodal_graph(inc), options, inc.select(F.col("node").alias("id")).distinct())
        rows = inc.select(F.col("elem").alias("id"), F.col("node").alias("via"))
    other = induce(rows, own, options.nparts)
    return (own, other) if by == "dual" else (other, own)


def induce(rows: DataFrame, part: DataFrame, k: int, slack: float = 1.03) -> DataFrame:
    """``(id, pid)`` of rows ``(id, via)`` from the parts of their columns ``(id, pid)``.

    Rows whose columns agree go there.  Others go to the part most of their columns are in, by falling
    majority while it has room, up to ``slack`` times the mean; then to their touched part with most room left,
    while that has some; then anywhere with room.  What no part has room for goes to its majority.
    """
    met = rows.join(part.select(F.col("id").alias("via"), F.col("pid").cast("int").alias("pid")), "via")
    touching = materialize(met.groupBy("id", "pid").agg(F.count("*").alias("n")), "touching")
    best = touching.groupBy("id").agg(F.max_by("pid", F.struct("n", -F.col("pid"))).alias("pid"), F.max("n").alias("n"), F.count("*").alias("parts"))
    best = materialize(best, "majorities")
    share = slack * best.count() / k
    parts = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("pid"))
    placed = best.where("parts = 1").select("id", "pid")

    def room() -> DataFrame:
        load = placed.groupBy("pid").agg(F.count("*").alias("_load"))
        left = F.ceil(F.lit(share) - F.coalesce("_load", F.lit(0))).cast("long")
        return materialize(parts.join(load, "pid", "left").select("pid", left.alias("room")).where("room > 0"), "room")  # k rows

    def admit(asking: DataFrame) -> DataFrame:
        """Of ``(id, pid, n, room)``, those that the part has room for, by falling ``n``."""
        nth = sums_within(asking, ["pid"], {"nth": F.lit(1)}, [F.desc("n"), F.col("id")])
        return placed.union(materialize(nth.where("nth <= room").select("id", "pid"), "admitted"))

    torn = best.where("parts > 1")
    placed = admit(torn.select("id", "pid", "n").join(F.broadcast(room()), "pid"))  # k rows
    left = torn.join(placed, "id", "left_anti").select("id")
    roomy = touching.join(left, "id", "left_semi").join(F.broadcast(room()), "pid").groupBy("id")  # k rows
    roomy = roomy.agg(F.max_by(F.struct("pid", "n", "room"), F.struct("room", -F.col("pid"))).alias("b")).select("id", "b.*")
    placed = admit(roomy)
    left = materialize(torn.join(placed, "id", "left_anti").select("id", F.col("pid").alias("_best")), "left")
    n = left.count()
    if n == 0:
        return placed
    ends = room().withColumn("_end", F.sum("room").over(Window.orderBy(F.desc("room"), "pid")))  # k rows
    ends = ends.withColumn("_begin", F.col("_end") - F.col("room")).where(F.col("_begin") < n)
    seats = ends.select("pid", F.explode(F.sequence("_begin", F.least("_end", F.lit(n)) - 1)).alias("_seat"))
    seated = global_rank(left, ["id"], "_seat").join(seats, "_seat", "left")
    return placed.union(seated.select("id", F.coalesce("pid", "_best").alias("pid")))


# -- adaptive ---------------------------------------------------------------


def remap(part: DataFrame, k: int) -> DataFrame:
    """``(id, pid)``: parts renamed so that they keep most of what they had at home; ``part`` is ``(id, home, pid, vsize)``.

    The overlap has at most ``k * k`` rows; the driver assigns greedily, heaviest first, and keeps
    the old names where that saves nothing.
    """
    held = metrics.overlap(part).orderBy(F.desc("size"), "home", "pid").collect()
    name: dict[int, int] = {}
    used: set[int] = set()
    for r in held:
        if r["pid"] not in name and r["home"] not in used:
            name[r["pid"]] = r["home"]
            used.add(r["home"])
    free = iter(sorted(set(range(k)) - used))
    full = {p: name[p] if p in name else next(free) for p in range(k)}
    kept = sum(r["size"] for r in held if full.get(r["pid"]) == r["home"])
    before = sum(r["size"] for r in held if r["pid"] == r["home"])
    if kept <= before:
        return part.select("id", "pid")
    names = part.sparkSession.createDataFrame(list(full.items()), "pid int, _name int")
    return part.join(F.broadcast(names), "pid").select("id", F.col("_name").alias("pid"))  # k rows


def refine_partition(edges: DataFrame, part: DataFrame, options: PartitionOptions, vertices: DataFrame | None = None) -> DataFrame:
    """Local refinement alone."""
    vertices = materialize(with_weights(edges, vertices), "vertices")
    options, edges = options.checked(vertices.agg(F.max(F.size("vwgt"))).first()[0] or 1), materialize(edges, "edges")
    return _rounds(refine_round, edges, vertices, part.select("id", F.col("pid").cast("int").alias("pid")), options)


def curve_blocks(edges: DataFrame, points: DataFrame, weights: DataFrame, cap: float, block: int = 8, dims: int = 3) -> DataFrame:
    """``(id, cid)``: groups of neighbours among each ``block`` vertices that follow one another along the Morton curve.

    One order by ranges stands for several rounds of matching.  A vertex without an edge into its block stays alone, as do
    those of a block that are above ``cap (vwgt)`` together, and vertices without a point.
    """
    from meshloom.operators.geometry import morton_order

    dealt = materialize(morton_order(points, dims).select("id", F.floor(F.col("_rank") / block).cast("long").alias("_block")), "curve")
    end = lambda c: dealt.select(F.col("id").alias(c), F.col("_block").alias(f"_{c}"))
    near = edges.where("src <> dst").join(end("src"), "src").join(end("dst"), "dst").where("_src = _dst").select(F.col("src").alias("id"), F.col("_src").alias("_block")).distinct()
    light = near.join(weights.select("id", "vwgt"), "id").groupBy("_block").agg(F.sum("vwgt").alias("w"), F.min("id").alias("cid")).where(F.col("w") <= cap)
    grouped = near.join(light, "_block").select("id", "cid")
    return materialize(weights.select("id").join(grouped, "id", "left").select("id", F.coalesce("cid", "id").alias("cid")), "cmap")


def geometric_kway(edges: DataFrame, points: DataFrame, options: PartitionOptions, dims: int = 3, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, pid)``: as :func:`partition`, where the first level of coarsening groups vertices that are near on a space-filling curve.

    ``points`` are ``(id, xyz)``; a vertex without one is matched on later levels.
    """
    return partition(edges, options, vertices, first=lambda e, w, cap: curve_blocks(e, points, w, cap, dims=dims))
