"""Random walks of many restart vectors at once, and searches from the roots of all components at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.analytics import bfs_levels
from meshloom.operators.components import connected_components
from meshloom.operators.graphs import degrees
from meshloom.operators.ordering import global_rank
from meshloom.plans.scratch import materialize, release


def restart_vectors(vertices: DataFrame, walks: int, top: int = 931, seed: int = 0) -> DataFrame:
    """``(walk, id, r)``: for each of ``walks`` vectors a hashed whole number below ``top`` at every vertex ``(id)``."""
    each = vertices.select("id", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    return each.select("walk", "id", F.pmod(F.xxhash64("id", "walk", F.lit(seed)), F.lit(top)).cast("double").alias("r"))


def pagerank_batch(edges: DataFrame, restarts: DataFrame, follow: float = 0.85, rounds: int = 100, eps: float = 1e-10) -> DataFrame:
    """``(walk, id, pr, rounds)``: the ranks of each walk of ``restarts (walk, id, r)``, and the rounds it took.

    ``follow`` is the probability to follow an edge by weight; the rest, and what stands on vertices without edges out,
    restarts by ``r``, scaled to sum to one.  A walk ends on its own once no rank moves by ``eps`` or after ``rounds``; the
    others go on without it.  A round is one join with the edges and one sum for all walks; only ranks above zero
    are stored.  Several rows of a walk and id add up; null or negative ``r``, and walks without any above zero, do not count.
    """
    given = restarts.where("r > 0").groupBy("walk", "id").agg(F.sum("r").alias("r"))
    totals = given.groupBy("walk").agg(F.sum("r").alias("_sum"))
    start = materialize(given.join(totals, "walk").select("walk", "id", (F.col("r") / F.col("_sum")).alias("r")), "restarts")
    out = edges.groupBy("src").agg(F.sum("wgt").alias("_total"))
    steps = materialize(edges.join(out, "src").select("src", "dst", (F.col("wgt") / F.col("_total")).alias("p")), "steps")
    sources = materialize(steps.select(F.col("src").alias("id")).distinct(), "sources")
    ranks, done, zero = start.select("walk", "id", F.col("r").alias("pr")), None, F.lit(0.0)
    for turn in range(1, rounds + 1):
        sunk = ranks.join(sources, "id", "left_anti").groupBy("walk").agg(F.sum("pr").alias("_sunk"))
        moved = ranks.join(steps, F.col("id") == F.col("src")).select("walk", F.col("dst").alias("id"), (follow * F.col("pr") * F.col("p")).alias("new"), zero.alias("old"))
        back = start.join(ranks.select("walk").distinct(), "walk", "left_semi").join(sunk, "walk", "left")
        back = back.select("walk", "id", ((follow * F.coalesce("_sunk", zero) + 1 - follow) * F.col("r")).alias("new"), zero.alias("old"))
        were = ranks.select("walk", "id", zero.alias("new"), F.col("pr").alias("old"))
        new = materialize(moved.union(back).union(were).groupBy("walk", "id").agg(F.sum("new").alias("pr"), F.sum("old").alias("old")), "ranks")
        change = new.groupBy("walk").agg(F.max(F.abs(F.col("pr") - F.col("old"))).alias("change"))
        ends = materialize(change.where((F.col("change") < eps) | F.lit(turn == rounds)).select("walk"), "ended")
        over = new.join(ends, "walk", "left_semi").select("walk", "id", "pr", F.lit(turn).alias("rounds")).where("pr > 0")
        if not ends.isEmpty():
            over = materialize(over, "ended-ranks")
            done = over if done is None else done.union(over)
        before, ranks = ranks, materialize(new.join(ends, "walk", "left_anti").select("walk", "id", "pr").where("pr > 0"), "active")
        release(new, ends, before)
        if ranks.isEmpty():
            break
    if done is None:
        return ranks.withColumn("rounds", F.lit(0))
    return done


def largest_differences(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(id, pr, degree, difference, at)``: how far the rank of a vertex of ``ranks (id, pr)`` is from that of the neighbour farthest from it.

    Ties go to the smallest id; without edges out or with none that differs, the difference is zero, ``at`` the vertex itself.
    """
    there = ranks.select(F.col("id").alias("dst"), F.col("pr").alias("_d"))
    here = ranks.select(F.col("id").alias("src"), F.col("pr").alias("_s"))
    gaps = edges.select("src", "dst").join(here, "src").join(there, "dst").select("src", "dst", F.abs(F.col("_s") - F.col("_d")).alias("gap"))
    best = gaps.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.max(F.struct("gap", (-F.col("dst")).alias("d"))).alias("b"))
    gap = F.coalesce("b.gap", F.lit(0.0))
    return ranks.select("id", "pr").join(best, "id", "left").select(
        "id", "pr", F.coalesce("degree", F.lit(0)).alias("degree"), gap.alias("difference"), F.when(gap > 0, -F.col("b.d")).otherwise(F.col("id")).alias("at")
    )


def _labelled(edges: DataFrame, vertices: DataFrame | None) -> DataFrame:
    """``(id, component)`` of vertices on edges, and of ``vertices (id)`` without any."""
    found = connected_components(edges)
    if vertices is None:
        return materialize(found, "components")
    return materialize(vertices.select("id").distinct().join(found, "id", "full").select("id", F.coalesce("component", "id").alias("component")), "components")


def _fronts(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id, component, level, place)`` from ``roots (id, component)``; places are by level, and grow with component and discovery."""
    front = materialize(global_rank(roots, ["component", "id"], "place").select("id", "component", F.lit(0).alias("level"), "place"), "front")
    done, before, level = front, front.limit(0), 0
    while not front.isEmpty():
        level += 1
        reached = front.join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("place").alias("by"), F.min("component").alias("component"))
        new = reached.join(front.union(before).select("id"), "id", "left_anti")
        placed = global_rank(new, ["by", "id"], "place").select("id", "component", F.lit(level).alias("level"), "place")
        before, front = front, materialize(placed, "front")
        done = done.union(front)
        if level % 16 == 0:
            done = materialize(done, "fronts")
    return done


def breadth_first(edges: DataFrame, vertices: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """``(id, component, level, pos)``: breadth-first orders of all components in one go, ``pos`` gapless over the table.

    Components come by their smallest ids, which are their roots unless ``roots (id, component)`` names others, one each.
    Within one, vertices come in the order of discovery: by level, by the place of the first neighbour before, by id.
    A round takes the fronts of all components, one join and one ranking, so rounds follow the deepest of them.  Edges go both
    ways; ``vertices (id)`` adds those without edges.
    """
    links = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "links")
    if roots is None:
        roots = _labelled(edges, vertices).select(F.col("component").alias("id"), "component").distinct()
    found = _fronts(links, roots)
    return global_rank(found, ["component", "level", "place"], "pos").select("id", "component", "level", "pos")


def far_roots(edges: DataFrame, vertices: DataFrame | None = None, turns: int = 8) -> DataFrame:
    """``(id, component, depth)``: a vertex of each component from which it is deep, for orders of narrow bandwidth.

    From the smallest id, the vertex of least degree (ties: the smallest id) in the last level is the next root, as long as
    the component gets deeper, ``turns`` times at most.  A turn searches only the components that got deeper.
    """
    links = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "links")
    size = materialize(degrees(links.withColumn("wgt", F.lit(1))).select("id", "degree"), "degrees")
    labels = _labelled(edges, vertices)
    roots = labels.select(F.col("component").alias("id"), "component").distinct()
    best = None
    for _ in range(turns + 1):
        seen = bfs_levels(links, roots).join(labels, "id").join(size, "id", "left")
        seen = materialize(seen.select("id", "component", "level", F.coalesce("degree", F.lit(0)).alias("degree")), "seen")
        last = F.max(F.struct("level", (-F.col("degree")).alias("g"), (-F.col("id")).alias("i")))
        tips = seen.groupBy("component").agg(last.alias("t")).select("component", F.col("t.level").alias("depth"), (-F.col("t.i")).alias("tip"))
        found = materialize(roots.join(tips, "component").select("id", "component", "depth", "tip"), "tips")
        if best is None:
            best, deeper = found.drop("tip"), found.where("depth > 0")
        else:
            old = best.select("component", F.col("depth").alias("_depth"))
            deeper = materialize(found.join(old, "component").where("depth > _depth").select("id", "component", "depth", "tip"), "deeper")
            best = materialize(best.join(deeper.select("component"), "component", "left_anti").select("id", "component", "depth").union(deeper.drop("tip")), "roots")
        roots = deeper.select(F.col("tip").alias("id"), "component")
        release(seen)
        if roots.isEmpty():
            break
    return best
