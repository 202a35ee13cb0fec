"""Vertex separators, minimum covers, minimum-degree orders and nested dissection, in memory."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

from meshloom.kernels.csr import Graph, components, induced
from meshloom.kernels.partition import bisect


def minimum_cover(left: list[int], edges: dict[int, list[int]]) -> tuple[set[int], set[int]]:
    """A smallest vertex cover of a bipartite graph, from a largest matching and alternating paths."""
    mate_l: dict[int, int] = {}
    mate_r: dict[int, int] = {}
    while True:
        level, queue = {u: 0 for u in left if u not in mate_l}, deque(u for u in left if u not in mate_l)
        found = False
        while queue:
            u = queue.popleft()
            for v in edges[u]:
                w = mate_r.get(v)
                if w is None:
                    found = True
                elif w not in level:
                    level[w] = level[u] + 1
                    queue.append(w)
        if not found:
            break

        def augment(root: int) -> bool:
            path, stack = [], [(root, iter(edges[root]))]
            while stack:
                u, it = stack[-1]
                for v in it:
                    w = mate_r.get(v)
                    if w is None:
                        path.append((u, v))
                        for x, y in path:
                            mate_l[x], mate_r[y] = y, x
                        return True
                    if level.get(w) == level[u] + 1:
                        path.append((u, v))
                        stack.append((w, iter(edges[w])))
                        break
                else:
                    level[u] = -1
                    stack.pop()
                    if path:
                        path.pop()
            return False

        if not sum(augment(u) for u in left if u not in mate_l):
            break
    reached_l, reached_r = {u for u in left if u not in mate_l}, set()
    queue = deque(reached_l)
    while queue:
        for v in edges[queue.popleft()]:
            if v not in reached_r:
                reached_r.add(v)
                w = mate_r.get(v)
                if w is not None and w not in reached_l:
                    reached_l.add(w)
                    queue.append(w)
    return set(left) - reached_l, reached_r


def from_bisection(g: Graph, where: np.ndarray) -> np.ndarray:
    """Part 2: a smallest cover of the edges across."""
    src = g.src
    across = (where[src] == 0) & (where[g.adj] == 1)
    edges: dict[int, list[int]] = {}
    for u, v in zip(src[across].tolist(), g.adj[across].tolist(), strict=True):
        edges.setdefault(u, []).append(v)
    a, b = minimum_cover(sorted(edges), edges)
    out = where.copy()
    out[list(a | b)] = 2
    return out


def refine(g: Graph, where: np.ndarray, ub: float = 1.2, passes: int = 10) -> np.ndarray:
    """Move separator vertices to a side, pulling that vertex's neighbours across into the separator; keep the best prefix."""
    vw, where = g.vwgt[:, 0], where.copy()
    cap = 0.5 * ub * vw.sum()
    for _ in range(passes):
        load = np.bincount(where, vw, 3)
        heap: list[tuple[int, int, int]] = []

        def push(v: int) -> None:
            near = g.around(v)[0]
            for side in (0, 1):
                gain = int(vw[v] - vw[near[where[near] == 1 - side]].sum())
                heapq.heappush(heap, (-gain, v, side))

        for v in np.flatnonzero(where == 2).tolist():
            push(v)
        locked = np.zeros(g.n, dtype=bool)
        log: list[list[tuple[int, int]]] = []
        best, kept = (load[2], abs(load[0] - load[1])), 0
        while heap and len(log) - kept < 60:
            score, v, side = heapq.heappop(heap)
            if where[v] != 2 or locked[v]:
                continue
            near = g.around(v)[0]
            pulled = near[where[near] == 1 - side]
            if -score != int(vw[v] - vw[pulled].sum()):
                push(v)
                continue
            if load[side] + vw[v] > cap or locked[pulled].any():
                continue
            step = [(v, 2), *((int(u), 1 - side) for u in pulled)]
            where[v] = side
            locked[v] = True
            load[2] -= vw[v]
            load[side] += vw[v]
            for u in pulled.tolist():
                where[u] = 2
                load[1 - side] -= vw[u]
                load[2] += vw[u]
                push(u)
            log.append(step)
            state = (load[2], abs(load[0] - load[1]))
            if state < best:
                best, kept = state, len(log)
        for step in reversed(log[kept:]):
            for v, old in step:
                where[v] = old
        if kept == 0:
            break
    return where


def separator(g: Graph, ub: float, seed: int, nseps: int = 1, niter: int = 10) -> np.ndarray:
    """Parts 0 and 1 without an edge between them, and a light separator 2."""
    best, key = None, None
    share = np.full((2, 1), 0.5)
    one = Graph(g.xadj, g.adj, g.wgt, g.vwgt[:, :1])
    for turn in range(nseps):
        rng = np.random.default_rng([seed, turn])
        where = refine(one, from_bisection(one, bisect(one, share, np.array([ub]), rng, niter)), ub, niter)
        load = np.bincount(where, g.vwgt[:, 0], 3)
        now = (load[2], abs(load[0] - load[1]))
        if key is None or now < key:
            best, key = where, now
    return best


def minimum_degree(g: Graph) -> np.ndarray:
    """Vertices in the order of least degree in the eliminated graph, by quotient sets; ties to smaller ids."""
    near: list[set[int]] = [set(g.around(v)[0].tolist()) for v in range(g.n)]
    elements: list[set[int]] = [set() for _ in range(g.n)]
    members: dict[int, set[int]] = {}
    heap = [(len(near[v]), v) for v in range(g.n)]
    heapq.heapify(heap)
    done, order = np.zeros(g.n, dtype=bool), []

    def reach(v: int) -> set[int]:
        out = set(near[v])
        for e in elements[v]:
            out |= members[e]
        out.discard(v)
        return out

    while heap:
        degree, v = heapq.heappop(heap)
        if done[v]:
            continue
        around = reach(v)
        if len(around) != degree:
            heapq.heappush(heap, (len(around), v))
            continue
        done[v] = True
        order.append(v)
        absorbed = elements[v]
        members[v] = around
        for u in around:
            near[u] -= around
            near[u].discard(v)
            elements[u] -= absorbed
            elements[u].add(v)
        for e in absorbed:
            members.pop(e, None)
        for u in around:
            heapq.heappush(heap, (len(reach(u)), u))
    return np.array(order, dtype=np.int64)


def nested_dissection(g: Graph, leaf: int = 120, ub: float = 1.2, seed: int = 4321, nseps: int = 1, niter: int = 10, by_component: bool = False) -> np.ndarray:
    """``order[i]``: the vertex eliminated in place ``i``; separators come last."""
    order = np.zeros(g.n, dtype=np.int64)
    stack = [(np.arange(g.n), 0, seed)]
    while stack:
        ids, at, salt = stack.pop()
        mask = np.zeros(g.n, dtype=bool)
        mask[ids] = True
        sub, ids = induced(g, mask)
        if sub.n <= leaf or not len(sub.adj):
            order[at : at + sub.n] = ids[minimum_degree(sub)]
            continue
        if by_component:
            label = components(sub)
            if len(np.unique(label)) > 1:
                for c in np.unique(label).tolist():
                    part = ids[label == c]
                    stack.append((part, at, salt * 31 + c))
                    at += len(part)
                continue
        where = separator(sub, ub, salt, nseps, niter)
        left, right, sep = (ids[where == p] for p in (0, 1, 2))
        if not len(left) or not len(right):
            order[at : at + sub.n] = ids[minimum_degree(sub)]
            continue
        end = at + sub.n
        order[end - len(sep) : end] = sep
        stack += [(left, at, 2 * salt + 1), (right, at + len(left), 2 * salt + 2)]
    return order
