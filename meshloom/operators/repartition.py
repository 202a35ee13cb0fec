"""New partitions of graphs whose vertices have homes already.

A flow over the graph of the parts says how much weight each part should hand to
each neighbour; vertices at the borders move along it.  Refinement weighs what a
move saves in cut against what it moves away from home.  All of it is rounds of
joins over tables; the driver sees a row a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators import graphs, metrics
from meshloom.operators.components import connected_components
from meshloom.operators.matrix import conjugate_gradient
from meshloom.operators.ordering import sum_within
from meshloom.operators.partitioning import Stay, _first, _loads, _moved, _rounds, coarsen, lifted, partition, refine_round, remap, with_weights
from meshloom.plans.options import PartitionOptions
from meshloom.plans.scratch import materialize, release


def flow(placed: DataFrame, excess: DataFrame) -> DataFrame:
    """``(ps, pd, quota)``: weight to hand from part to neighbour part so that all end without ``excess (pid, excess)``.

    Potentials solve the Laplacian of the graph of the parts, and weight flows down their differences: of all
    flows that balance the parts it has the least sum of squares.  Parts that no path joins exchange nothing;
    there the excess is what is above the mean of the connected parts.
    """
    laplacian = materialize(metrics.subdomain_laplacian(placed), "laplacian")
    pairs = laplacian.where("row <> col").select(F.col("row").alias("ps"), F.col("col").alias("pd"))
    joined = excess.join(connected_components(pairs, "ps", "pd"), F.col("pid") == F.col("id"))
    mean = joined.groupBy("component").agg(F.avg("excess").alias("_mean"))
    right = joined.join(mean, "component").select(F.col("pid").alias("id"), (F.col("excess") - F.col("_mean")).alias("b"))
    potential = materialize(conjugate_gradient(laplacian, right, 1e-9), "potentials")
    a, b = (potential.select(F.col("id").alias(side), F.col("x").alias(f"_{side}")) for side in ("ps", "pd"))
    found = pairs.join(a, "ps").join(b, "pd").select("ps", "pd", (F.col("_ps") - F.col("_pd")).alias("quota"))
    return found.where("quota > 0")


def flow_round(edges: DataFrame, weights: DataFrame, part: DataFrame, quota: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of moves along ``quota (ps, pd, quota)``: the new ``(id, pid)``, and what of the quotas is left.

    A vertex at a border offers itself where it saves most; a quota admits offers by falling gain, up to the
    nearest it can come.  ``part`` itself is returned when nothing moves.
    """
    links = metrics.with_parts(edges.where("src <> dst"), part).groupBy("src", "ps", "pd").agg(F.sum("wgt").alias("w"))
    own = links.where("ps = pd").select("src", F.col("w").alias("_own"))
    offers = links.join(quota, ["ps", "pd"]).join(own, "src", "left").join(weights.select(F.col("id").alias("src"), "vwgt"), "src").where("vwgt > 0")
    gain = F.col("w") - F.coalesce("_own", F.lit(0))
    best = offers.withColumn("gain", gain).groupBy("src").agg(F.max_by(F.struct("ps", "pd", "gain", "quota", "vwgt"), F.struct("gain", "quota", -F.col("pd"))).alias("b"))
    best = best.select(F.col("src").alias("id"), "b.*")
    admitted = sum_within(best, ["ps", "pd"], "vwgt", [F.desc("gain"), F.col("id")], "upto").where(F.col("upto") - F.col("vwgt") / 2 <= F.col("quota"))
    moves = materialize(admitted.select("id", "ps", "pd", "vwgt"), "flow-moves")
    new = _moved(part, moves.select("id", F.col("pd").alias("_to")))
    sent = moves.groupBy("ps", "pd").agg(F.sum("vwgt").alias("_sent"))
    left = quota.join(sent, ["ps", "pd"], "left").select("ps", "pd", (F.col("quota") - F.coalesce("_sent", F.lit(0))).alias("quota"))
    left = materialize(left.where("quota > 0"), "quotas")
    release(moves)
    return new, left


def _without_empty(edges: DataFrame, vertices: DataFrame, part: DataFrame, options: PartitionOptions) -> DataFrame:
    """The partition with a vertex in each empty part, from the heaviest one: those with least weight to it."""
    load = _loads(vertices, part, options)[0][:, 0]
    held = {r["pid"] for r in part.select("pid").distinct().collect()}  # k rows
    empty = sorted(set(range(options.nparts)) - held)
    if not empty:
        return part
    heavy = int(load.argmax())
    inner = metrics.kway_degrees(metrics.with_parts(edges, part)).where(F.col("pid") == heavy)
    chosen = inner.orderBy(F.col("internal") - F.col("external"), "id").limit(len(empty)).select("id").collect()  # fewer rows than parts
    rows = [(r["id"], p) for r, p in zip(chosen, empty, strict=False)]
    return _moved(part, part.sparkSession.createDataFrame(rows, "id long, _to int")) if rows else part


def diffuse(edges: DataFrame, vertices: DataFrame, part: DataFrame, options: PartitionOptions, factor: float = 1.0, solves: int = 8) -> DataFrame:
    """``(id, pid)``: loads levelled along flows, ``factor`` of each at a time, until no part is above its bound.

    ``vertices`` are ``(id, vwgt)`` with one constraint.  Ends, too, when a solve leaves nine tenths of what its share
    of the excess was: where few vertices of a heavy part have neighbours outside, ``refine_round`` has to empty it.
    """
    if len(options.ubvec) != 1:
        raise ValueError("weight of one constraint flows; partition anew for several")
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    part = _without_empty(edges, vertices, part, options)
    weights = vertices.select("id", _first().alias("vwgt"))
    left = None
    for _ in range(solves):
        load, fair, most = _loads(vertices, part, options)
        over = float((load - most).clip(min=0).sum())
        if over == 0 or (left is not None and over > (1 - 0.1 * factor) * left):
            break
        left = over
        rows = [(p, float(load[p, 0] - fair[p, 0])) for p in range(options.nparts)]
        excess = edges.sparkSession.createDataFrame(rows, "pid int, excess double")
        whole = flow(metrics.with_parts(edges, part), excess)
        quota, before = materialize(whole.withColumn("quota", factor * F.col("quota")), "quotas"), part
        for _ in range(options.niter):
            new, quota = flow_round(edges, weights, part, quota)
            if new is part:
                break
            part = new
        if part is before:
            break
    return part


def costs(edges: DataFrame, part: DataFrame, stay: Stay) -> DataFrame:
    """``(cut, inner, moved, stayed, cost)``: weights of edges, sizes of vertices, and ``ipc`` times the cut and ``redist`` times what moved."""
    placed = metrics.with_parts(edges, part)
    cut = F.coalesce(F.sum(F.when(metrics.crosses(), F.col("wgt"))), F.lit(0))
    links = placed.agg((cut / 2).cast("long").alias("cut"), ((F.coalesce(F.sum("wgt"), F.lit(0)) - cut) / 2).cast("long").alias("inner"))
    both = part.join(stay.rows, "id")
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("vsize"))), F.lit(0)).cast("long")
    sizes = both.agg(size(F.col("home") != F.col("pid")).alias("moved"), size(F.col("home") == F.col("pid")).alias("stayed"))
    return links.join(F.broadcast(sizes)).withColumn("cost", stay.ipc * F.col("cut") + stay.redist * F.col("moved"))  # one row each


def _cheapest(edges: DataFrame, vertices: DataFrame, parts: list[DataFrame], stay: Stay, options: PartitionOptions) -> DataFrame:
    """The partition of least cost; one within the bounds goes before one that is not."""

    def rank(part: DataFrame) -> tuple[bool, float]:
        load, _, most = _loads(vertices, part, options)
        return bool((load > most * (1 + 1e-9)).any()), costs(edges, part, stay).first()["cost"]

    return parts[0] if len(parts) == 1 else min(parts, key=rank)


def refine_from_home(edges: DataFrame, vertices: DataFrame, part: DataFrame, stay: Stay, options: PartitionOptions) -> DataFrame:
    """``(id, pid)``: rounds of moves that pay, in cut and in what they move from home; never dearer than ``part`` within its bounds."""
    step = lambda e, v, p, o, turn: refine_round(e, v, p, o, turn, stay)
    return _cheapest(edges, vertices, [_rounds(step, edges, vertices, part, options), part], stay, options)


def adaptive_repartition(
    edges: DataFrame, home: DataFrame, options: PartitionOptions, ipc: float = 1000.0, vertices: DataFrame | None = None, redist: float = 1.0,
    sizes: DataFrame | None = None, factors: tuple[float, ...] = (1.0,),
) -> DataFrame:
    """``(id, pid)``: a partition that weighs the cut, times ``ipc``, against what moves from home, times ``redist``.

    The graph is coarsened within homes.  On the coarsest, two ways are tried: flows from the homes (with each of
    ``factors``; one constraint only), and a new partition with its parts renamed; the cheaper is refined on
    the way back.  ``home`` is ``(id, pid)``; ``sizes (id, vsize)`` are what moving a vertex costs, its first weight
    without.
    """
    vertices = materialize(with_weights(edges, vertices), "vertices")
    options = options.checked(vertices.agg(F.max(F.size("vwgt"))).first()[0] or 1)
    edges = materialize(edges.select("src", "dst", F.col("wgt").cast("long").alias("wgt")), "edges")
    home = materialize(home.select("id", F.col("pid").cast("int").alias("pid")), "homes")
    size = vertices.select("id", _first().alias("vsize")) if sizes is None else sizes.select("id", "vsize")
    levels = coarsen(edges, vertices, max(30 * options.nparts, options.kernel_size // 20), options.seed, home=home, ctype=options.ctype, two_hop=not options.no2hop)
    stays, homes = [Stay(materialize(home.withColumnRenamed("pid", "home").join(size, "id"), "stay"), ipc, redist)], [home]
    for _, _, cmap in levels[:-1]:
        moved = stays[-1].rows.join(cmap, "id").groupBy(F.col("cid").alias("id")).agg(F.min("home").alias("home"), F.sum("vsize").alias("vsize"))
        stays.append(Stay(materialize(moved, "stay"), ipc, redist))
        homes.append(materialize(lifted(cmap, homes[-1]), "homes"))
    coarse_edges, coarse_vertices, _ = levels[-1]
    tried = [diffuse(coarse_edges, coarse_vertices, homes[-1], options, factor) for factor in factors] if len(options.ubvec) == 1 else []
    fresh = partition(coarse_edges, options, coarse_vertices).join(stays[-1].rows, "id")
    tried.append(materialize(remap(fresh, options.nparts), "remapped"))
    tried = [refine_from_home(coarse_edges, coarse_vertices, part, stays[-1], options) for part in tried]
    part = _cheapest(coarse_edges, coarse_vertices, tried, stays[-1], options)
    for (fine_edges, fine_vertices, cmap), stay in zip(reversed(levels[:-1]), reversed(stays[:-1]), strict=True):
        part = materialize(graphs.project(cmap, part), "projected")
        part = refine_from_home(fine_edges, fine_vertices, part, stay, options)
    return part
