"""Multilevel partitioning of a graph in memory: matching, growing, moving boundary vertices."""

from __future__ import annotations

import heapq
import math

import numpy as np

from meshloom.kernels import moves
from meshloom.kernels.csr import Graph, bfs_order, components, contract, cut, induced, volume


# -- coarsening -------------------------------------------------------------


def matching(g: Graph, cap: np.ndarray, rng: np.random.Generator, heavy: bool = True, two_hop: bool = True) -> tuple[np.ndarray, int]:
    """Pairs of neighbours as coarse ids: low degrees first, each with its heaviest free neighbour within ``cap``."""
    mate = np.full(g.n, -1)
    degree = np.diff(g.xadj)
    order = rng.permutation(g.n)
    order = order[np.argsort(np.minimum(degree[order], int(0.7 * degree.mean()) + 1 if g.n else 1), kind="stable")]
    vw = g.vwgt
    for v in order.tolist():
        if mate[v] >= 0:
            continue
        near, w = g.around(v)
        free = (mate[near] < 0) & (vw[near] + vw[v] <= cap).all(1)
        if free.any():
            near, w = near[free], w[free]
            u = int(near[int(np.argmax(w))] if heavy else near[int(rng.integers(len(near)))])
            mate[v], mate[u] = u, v
    alone = np.flatnonzero((mate < 0) & (degree == 0))
    for a, b in zip(alone[::2].tolist(), alone[1::2].tolist(), strict=False):
        mate[a], mate[b] = b, a
    if two_hop and (mate < 0).sum() > 0.1 * g.n:
        hub: dict[int, int] = {}
        for v in np.flatnonzero(mate < 0).tolist():
            near = g.around(v)[0]
            for h in near.tolist():
                u = hub.pop(h, None)
                if u is not None and u != v and mate[u] < 0 and (vw[u] + vw[v] <= cap).all():
                    mate[v], mate[u] = u, v
                    break
            else:
                for h in near.tolist():
                    hub[h] = v
    mate[mate < 0] = np.flatnonzero(mate < 0)
    first = np.minimum(np.arange(g.n), mate)
    ids, cmap = np.unique(first, return_inverse=True)
    return cmap, len(ids)


def coarsen(
    g: Graph, target: int, rng: np.random.Generator, heavy: bool = True, two_hop: bool = True, how: str = "", n_levels: int = 1 << 30
) -> list[tuple[Graph, np.ndarray | None]]:
    """Levels from fine to coarse, each with its map to the next; stops at ``target`` vertices, after ``n_levels``, or when it hardly shrinks.

    ``how`` is ``fc`` for first-choice clusters, ``jc`` for matching by Jaccard weights, else matching by weights.
    """
    levels: list[tuple[Graph, np.ndarray | None]] = []
    cap = np.maximum(1.5 * g.vwgt.sum(0) / max(target, 1), g.vwgt.max(0) if g.n else 1)
    equal = len(g.wgt) == 0 or g.wgt.min() == g.wgt.max()
    while g.n > target and len(g.adj) and len(levels) < n_levels:
        if how == "fc":
            cmap, nc = moves.clusters(g, cap, rng)
        elif how == "jc":
            cmap, nc = matching(moves.jaccard_weighted(g), cap, rng, True, two_hop)
        else:
            cmap, nc = matching(g, cap, rng, heavy and not (equal and not levels), two_hop)
        if nc > 0.95 * g.n:
            break
        levels.append((g, cmap))
        g = contract(g, cmap, nc)
    return [*levels, (g, None)]


def groups(g: Graph, cap: float, target: int, rng: np.random.Generator, heavy: bool = True, two_hop: bool = True) -> np.ndarray:
    """For each vertex the least one of its group, by repeated matching of a piece of a larger graph, down to ``target`` vertices with edges.

    Vertices without edges stay as they are, as they may have some outside.
    """
    label, names, most = np.arange(g.n), np.arange(g.n), np.full(g.vwgt.shape[1], cap)
    equal = len(g.wgt) == 0 or g.wgt.min() == g.wgt.max()
    while True:
        joined = np.diff(g.xadj) > 0
        if joined.sum() <= target or not joined.any():
            return label
        g, names = induced(g, joined)[0], names[joined]
        cmap, nc = matching(g, most, rng, heavy and not equal, two_hop)
        if nc > 0.95 * g.n:
            return label
        least = np.full(nc, len(label))
        np.minimum.at(least, cmap, names)
        to = np.arange(len(label))
        to[names] = least[cmap]
        label, names, g, equal = to[label], least, contract(g, cmap, nc), False


# -- bisection --------------------------------------------------------------


def _over(load: np.ndarray, share: np.ndarray, total: np.ndarray) -> float:
    """The largest load over its target."""
    return float((load / np.maximum(share * total, 1e-9)).max())


def grow(g: Graph, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Part 0 grows breadth-first from a random vertex until it has its share of the first constraints."""
    where, want = np.ones(g.n, dtype=np.int64), share[0] * g.vwgt.sum(0)
    load, seen = np.zeros(g.vwgt.shape[1]), np.zeros(g.n, dtype=bool)
    starts = [int(rng.integers(g.n)), *rng.permutation(g.n).tolist()]
    for root in starts:
        if seen[root]:
            continue
        for v in bfs_order(g, root, seen):
            if (load >= want).any():
                return where
            where[v] = 0
            load += g.vwgt[v]
    return where


def fm_bisection(g: Graph, where: np.ndarray, share: np.ndarray, ub: np.ndarray, passes: int = 10) -> np.ndarray:
    """Hill climbing with rollback: move the best vertex, remember the best prefix, for several passes."""
    total = g.vwgt.sum(0).astype(float)
    limit = min(max(int(0.01 * g.n), 15), 100)
    where = where.copy()
    src = g.src
    for _ in range(passes):
        cross = np.where(where[src] == where[g.adj], -g.wgt, g.wgt)
        gain = np.bincount(src, cross, g.n).astype(np.int64)
        load = np.stack([g.vwgt[where == p].sum(0) for p in (0, 1)]).astype(float)
        ext = np.bincount(src, where[src] != where[g.adj], g.n) > 0
        heap = [(-int(gain[v]), v) for v in np.flatnonzero(ext | (np.diff(g.xadj) == 0)).tolist()]
        heapq.heapify(heap)
        over = lambda: max((load[p] / np.maximum(share[p] * total * ub, 1e-9)).max() for p in (0, 1))
        locked = np.zeros(g.n, dtype=bool)
        moves: list[int] = []
        now, best, kept, start = 0, 0, 0, over()
        state = best_state = (max(start, 1.0), 0)
        while heap and len(moves) - kept < limit:
            score, v = heapq.heappop(heap)
            if locked[v] or -score != gain[v]:
                continue
            a = int(where[v])
            b = 1 - a
            fits = (load[b] + g.vwgt[v] <= share[b] * total * ub).all()
            relieves = ((load[a] - share[a] * total * ub).max() > 0) and _over(load[b] + g.vwgt[v], share[b], total) < _over(load[a], share[a], total)
            if not (fits or relieves):
                continue
            locked[v] = True
            where[v] = b
            load[a] -= g.vwgt[v]
            load[b] += g.vwgt[v]
            now -= int(gain[v])
            gain[v] = -gain[v]
            moves.append(v)
            near, w = g.around(v)
            for u, x in zip(near.tolist(), w.tolist(), strict=True):
                gain[u] += -2 * x if where[u] == b else 2 * x
                if not locked[u]:
                    heapq.heappush(heap, (-int(gain[u]), u))
            state = (max(over(), 1.0), now)
            if state < best_state:
                best_state, best, kept = state, now, len(moves)
        for v in moves[kept:]:
            where[v] = 1 - where[v]
        if kept == 0:
            break
    return where


def bisect(g: Graph, share: np.ndarray, ub: np.ndarray, rng: np.random.Generator, niter: int = 10, tries: int = 4, start: str = "grow") -> np.ndarray:
    """A multilevel bisection; ``share`` has a row a side and a column a constraint."""
    if g.n == 0:
        return np.zeros(0, dtype=np.int64)
    levels = coarsen(g, 20 if g.vwgt.shape[1] == 1 else 100, rng)
    coarse = levels[-1][0]
    total = g.vwgt.sum(0).astype(float)
    best, best_key = None, None
    for _ in range(tries):
        first = moves.random_bisection(coarse, share, rng) if start == "random" else grow(coarse, share, rng)
        where = fm_bisection(coarse, first, share, ub, niter)
        over = max(_over(coarse.vwgt[where == p].sum(0), share[p] * ub, total) for p in (0, 1))
        key = (max(over, 1.0), cut(coarse, where))
        if best_key is None or key < best_key:
            best, best_key = where, key
    for fine, cmap in reversed(levels[:-1]):
        best = fm_bisection(fine, best[cmap], share, ub, niter)
    return best


def recursive_bisection(g: Graph, shares: np.ndarray, ub: np.ndarray, rng: np.random.Generator, niter: int = 10, start: str = "grow") -> np.ndarray:
    """``shares`` has a row a part; halves of the parts get halves of the graph."""
    k = len(shares)
    where = np.zeros(g.n, dtype=np.int64)
    if k == 1 or g.n == 0:
        return where
    left = k // 2
    halves = np.stack([shares[:left].sum(0), shares[left:].sum(0)])
    halves = halves / halves.sum(0)
    side = bisect(g, halves, 1 + (ub - 1) / max(1, math.ceil(math.log2(k))), rng, niter, start=start)
    for p, part, base in ((0, shares[:left], 0), (1, shares[left:], left)):
        sub, ids = induced(g, side == p)
        where[ids] = base + recursive_bisection(sub, part / part.sum(0), ub, rng, niter, start)
    return where


# -- k-way ------------------------------------------------------------------


def refine_kway(g: Graph, where: np.ndarray, shares: np.ndarray, ub: np.ndarray, niter: int = 10) -> np.ndarray:
    """Greedy passes over the boundary: move where weight to another part pays or balance improves, within bounds."""
    k, where = len(shares), where.copy()
    total = g.vwgt.sum(0).astype(float)
    most = shares * total * ub
    load = np.zeros((k, g.vwgt.shape[1]))
    np.add.at(load, where, g.vwgt)
    src = g.src
    for _ in range(niter):
        moved = 0
        over = (load > most).any()
        cross = where[src] != where[g.adj]
        ext = np.bincount(src, np.where(cross, g.wgt, 0), g.n)
        own = np.bincount(src, np.where(cross, 0, g.wgt), g.n)
        rim = np.flatnonzero((ext > 0) | over & (np.diff(g.xadj) == 0))
        links = np.maximum(np.bincount(src, cross, g.n), 1)
        rank = ext[rim] / np.sqrt(links[rim]) - own[rim]
        for v in rim[np.argsort(-rank, kind="stable")].tolist():
            a = int(where[v])
            near, w = g.around(v)
            to = np.bincount(where[near], w, k)
            home, vw = to[a], g.vwgt[v]
            heavy = (load[a] > most[a]).any()
            best, key = -1, None
            options = np.flatnonzero(to) if not heavy else np.arange(k)
            for b in options.tolist():
                if b == a:
                    continue
                fits = (load[b] + vw <= most[b]).all()
                lighter = _over(load[b] + vw, shares[b], total) < _over(load[a], shares[a], total)
                gain = to[b] - home
                good = fits and (gain > 0 or (gain == 0 and lighter) or heavy) or heavy and lighter
                if good and (key is None or (gain, -_over(load[b], shares[b], total)) > key):
                    best, key = b, (gain, -_over(load[b], shares[b], total))
            if best >= 0:
                where[v] = best
                load[a] -= vw
                load[best] += vw
                moved += 1
        if not moved:
            break
    return where


def refine_volume(g: Graph, where: np.ndarray, shares: np.ndarray, ub: np.ndarray, niter: int = 10) -> np.ndarray:
    """Greedy passes that move a boundary vertex when the total volume falls."""
    k, where = len(shares), where.copy()
    most = shares * g.vwgt.sum(0) * ub
    load = np.zeros((k, g.vwgt.shape[1]))
    np.add.at(load, where, g.vwgt)
    counts = np.zeros((g.n, k), dtype=np.int64)
    np.add.at(counts, (g.src, where[g.adj]), 1)
    for _ in range(niter):
        moved = 0
        for v in np.flatnonzero((counts > 0).sum(1) > (counts[np.arange(g.n), where] > 0)).tolist():
            a, near = int(where[v]), g.around(v)[0]
            best, gain_best = -1, 0
            for b in np.flatnonzero(counts[v]).tolist():
                if b == a or not (load[b] + g.vwgt[v] <= most[b]).all():
                    continue
                gain = 1 - int(counts[v, a] > 0)
                gain += int(((counts[near, a] == 1) & (where[near] != a)).sum()) - int(((counts[near, b] == 0) & (where[near] != b)).sum())
                if gain > gain_best:
                    best, gain_best = b, gain
            if best >= 0:
                where[v] = best
                load[a] -= g.vwgt[v]
                load[best] += g.vwgt[v]
                counts[near, a] -= 1
                counts[near, best] += 1
                moved += 1
        if not moved:
            break
    return where


def kway(
    g: Graph, shares: np.ndarray, ub: np.ndarray, seed: int, ncuts: int = 1, niter: int = 10, objective: str = "cut", heavy: bool = True, two_hop: bool = True,
    how: str = "", start: str = "grow", refine: str = "greedy",
) -> np.ndarray:
    """A multilevel k-way partition: the best feasible of ``ncuts`` tries.

    ``how`` is that of :func:`coarsen`; ``start`` grows or fills halves (``grow``, ``random``) or all parts at once (``kway``);
    ``refine`` adds swaps of edges, hills or pairs of parts to each level's greedy passes (``swap``, ``hs``, ``kpm``).
    """

    def refined(level: Graph, where: np.ndarray) -> np.ndarray:
        where = refine_kway(level, where, shares, ub, niter)
        if refine == "swap":
            return moves.swap_edges(level, where, niter)
        if refine == "hs":
            return moves.scan_hills(level, where, shares, ub, niter)
        return moves.pairs_of_parts(level, where, shares, ub, niter) if refine == "kpm" else where

    k = len(shares)
    if k == 1 or g.n == 0:
        return np.zeros(g.n, dtype=np.int64)
    best, best_key = None, None
    total = g.vwgt.sum(0).astype(float)
    for turn in range(ncuts):
        rng = np.random.default_rng([seed, turn])
        levels = coarsen(g, max(g.n // (20 * max(1, int(math.log2(k)))), 30 * k), rng, heavy, two_hop, how)
        coarse = levels[-1][0]
        if start == "kway":
            where = moves.grow_kway(coarse, shares, rng)
        else:
            where = recursive_bisection(coarse, shares, np.power(ub, 1 / max(1.0, math.log(k))), rng, niter, start)
        where = refined(coarse, where)
        for fine, cmap in reversed(levels[:-1]):
            where = refined(fine, where[cmap])
        if objective == "vol":
            where = refine_volume(g, where, shares, ub, niter)
        load = np.zeros((k, g.vwgt.shape[1]))
        np.add.at(load, where, g.vwgt)
        excess = max(0.0, float((load / np.maximum(shares * total * ub, 1e-9)).max()) - 1)
        key = (excess if excess > 0.0005 else 0.0, volume(g, where, k) if objective == "vol" else cut(g, where))
        if best_key is None or key < best_key:
            best, best_key = where, key
    return best


def eliminate_fragments(g: Graph, where: np.ndarray) -> np.ndarray:
    """Each part keeps its heaviest piece; other pieces join the part they have most weight to."""
    where = where.copy()
    for _ in range(4):
        src = g.src
        same = where[src] == where[g.adj]
        pieces = components(Graph(np.concatenate([[0], np.cumsum(np.bincount(src[same], minlength=g.n))]), g.adj[same], g.wgt[same], g.vwgt))
        weight = np.bincount(pieces, g.vwgt[:, 0], g.n)
        largest: dict[int, int] = {}
        for p in np.unique(pieces).tolist():
            part = int(where[p])
            if part not in largest or weight[p] > weight[largest[part]]:
                largest[part] = p
        loose = [p for p in np.unique(pieces).tolist() if largest[int(where[p])] != p]
        changed = False
        for p in loose:
            inside = pieces == p
            out = inside[src] & ~inside[g.adj]
            if out.any():
                to = np.bincount(where[g.adj[out]], g.wgt[out])
                where[inside] = int(np.argmax(to))
                changed = True
        if not changed:
            break
    return where


def minimise_connectivity(g: Graph, where: np.ndarray, shares: np.ndarray, ub: np.ndarray) -> np.ndarray:
    """Give up weak links between parts while the largest number of neighbour parts is 1.4 times the mean."""
    where, k = where.copy(), len(shares)
    most = shares * g.vwgt.sum(0) * ub
    for _ in range(4 * k):
        src = g.src
        link = np.zeros((k, k), dtype=np.int64)
        np.add.at(link, (where[src], where[g.adj]), g.wgt)
        np.fill_diagonal(link, 0)
        degree = (link > 0).sum(1)
        if degree.max(initial=0) < 1.4 * max(degree.mean(), 1e-9):
            break
        a = int(np.argmax(degree))
        b = min(np.flatnonzero(link[a]).tolist(), key=lambda p: (link[a, p], p))
        load = np.zeros((k, g.vwgt.shape[1]))
        np.add.at(load, where, g.vwgt)
        rim = np.unique(src[(where[src] == a) & (where[g.adj] == b)])
        plan = []
        for v in rim.tolist():
            near, w = g.around(v)
            to = np.bincount(where[near], w, k)
            to[[a, b]] = 0
            target = [p for p in np.argsort(-to, kind="stable").tolist() if to[p] and link[b, p] and (load[p] + g.vwgt[v] <= most[p]).all()]
            if not target:
                plan = []
                break
            plan.append((v, target[0]))
            load[target[0]] += g.vwgt[v]
        if not plan:
            break
        for v, p in plan:
            where[v] = p
    return where
