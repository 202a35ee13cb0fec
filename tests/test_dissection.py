"""Separators refined in rounds, and dissection level by level, on grids, stars and loose vertices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import dissection, graphs, metrics
from meshloom.operators.partitioning import with_weights

EDGES = "src long, dst long, wgt long"


def table(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for x, y in pairs for a, b in ((x, y), (y, x))], EDGES)


def grid_pairs(rows, columns, start=0):
    at = lambda r, c: start + r * columns + c
    down = [(at(r, c), at(r + 1, c)) for r in range(rows - 1) for c in range(columns)]
    return down + [(at(r, c), at(r, c + 1)) for r in range(rows) for c in range(columns - 1)]


@pytest.fixture(scope="module")
def grid(spark):
    return table(spark, grid_pairs(12, 10)).cache()


def label(part):
    return {r["id"]: r["pid"] for r in part.collect()}


def is_separated(edges, pids):
    return all({pids[r["src"]], pids[r["dst"]]} != {0, 1} for r in edges.collect())


def test_rounds_never_add_weight(spark, grid):
    """Each round against brute force: what leaves, what is pulled in, and the weights of sides."""
    rng = np.random.default_rng(5)
    weights = {i: int(w) for i, w in enumerate(rng.integers(1, 5, 120))}
    vertices = spark.createDataFrame([(i, 1, w) for i, w in weights.items()], "id long, node long, vwgt long")
    halves = grid.withColumns({"ps": F.pmod("src", F.lit(2)).cast("int"), "pd": F.pmod("dst", F.lit(2)).cast("int")})
    part = metrics.separator_from_cut(halves)
    near = {i: set() for i in weights}
    for r in grid.collect():
        near[r["src"]].add(r["dst"])
    at, total = label(part), sum(weights.values())
    held = lambda pids, p: sum(w for i, w in weights.items() if pids[i] == p)
    for turn in range(5):
        side = turn % 2
        new = dissection.separator_round(grid, vertices, part, side, 1.2)
        now = label(new)
        assert is_separated(grid, now) and held(now, 2) <= held(at, 2) and held(now, side) <= max(1.2 * total / 2, held(at, side))
        left = {i for i in weights if at[i] == 2 and now[i] != 2}
        assert all(now[i] == side for i in left)
        assert {i for i in weights if at[i] != 2 and now[i] == 2} == {u for i in left for u in near[i] if at[u] == 1 - side}
        gainful = {i: weights[i] - sum(weights[u] for u in near[i] if at[u] == 1 - side) for i in weights if at[i] == 2}
        assert left or not any(g > 0 and held(at, side) + weights[i] <= 0.6 * total for i, g in gainful.items())
        part, at = new, now
    assert held(at, 2) < total / 2  # all of it at the start


def test_separators_of_many_nodes_at_once(spark):
    """Three grids, coarsened where they pass the limit, each with a light separator of its own."""
    pairs = grid_pairs(12, 10) + grid_pairs(5, 5, 1000) + grid_pairs(9, 12, 2000)
    edges = table(spark, pairs)
    vertices = graphs.vertices_of(edges).select("id", F.when(F.col("id") < 1000, 4).when(F.col("id") < 2000, 5).otherwise(7).cast("long").alias("node"), F.lit(1).cast("long").alias("vwgt"))
    part = dissection.separate(edges, vertices, limit=40)
    pids = label(part)
    assert len(pids) == 120 + 25 + 108 and is_separated(edges, pids)
    for first, n in ((0, 120), (1000, 25), (2000, 108)):
        own = [p for i, p in pids.items() if first <= i < first + n]
        assert own.count(2) <= 0.25 * n and max(own.count(0), own.count(1)) <= 0.75 * n


def test_a_star_beyond_the_limit(spark):
    """It hardly shrinks by matching, so it is halved by a hash; the hub alone may stay in the separator."""
    edges = table(spark, [(0, i) for i in range(1, 60)])
    pids = label(dissection.vertex_separator_in_rounds(edges, limit=10))
    assert len(pids) == 60 and is_separated(edges, pids) and list(pids.values()).count(2) <= 30


def test_dissection(grid):
    found = dissection.dissect(grid, levels=2, limit=60)
    order = {r["id"]: (r["pos"], r["node"]) for r in found.order.collect()}
    assert sorted(p for p, _ in order.values()) == list(range(120))
    places = {node: sorted(p for p, m in order.values() if m == node) for node in range(1, 8)}
    assert all(p == list(range(p[0], p[0] + len(p))) for p in places.values() if p)
    ends = [places[node] for node in (4, 5, 2, 6, 7, 3, 1)]  # sides, then what parts them
    assert [x for run in ends for x in run] == list(range(120))
    assert [(r["nth"], r["node"], r["size"]) for r in found.sizes.orderBy("nth").collect()] == [(k, m, len(places[m])) for k, m in enumerate((4, 5, 6, 7, 2, 3, 1))]
    for r in grid.collect():
        a, b = sorted((order[r["src"]][1], order[r["dst"]][1]))
        while b > a:
            b //= 2
        assert a == b
    assert dissection.sibling_edges(grid, found.order).first()["edges"] == 0
    assert all(places[m] for m in (4, 5, 6, 7)) and len(places[1]) <= 30


def test_sibling_edges_are_found(spark, grid):
    order = graphs.vertices_of(grid).select("id", (4 + F.pmod("id", F.lit(4))).alias("node"))
    assert dissection.sibling_edges(grid, order).first()["edges"] == grid.where("src % 4 <> dst % 4").count()


def test_dissection_of_odd_graphs(spark):
    edges = spark.createDataFrame([(3, 3, 5), (1, 2, 1), (2, 1, 1)], EDGES)
    vertices = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 9)], "id long, vwgt long")
    found = dissection.dissect(edges, 1, vertices)
    assert sorted(r["pos"] for r in found.order.collect()) == [0, 1, 2, 3] and found.sizes.agg(F.sum("size")).first()[0] == 4
    none = dissection.dissect(spark.createDataFrame([], EDGES), 1)
    assert none.order.count() == 0 and [r["size"] for r in none.sizes.collect()] == [0, 0, 0]
    assert [r["node"] for r in dissection.dissect(edges, 0, vertices).sizes.collect()] == [1]
    with pytest.raises(ValueError):
        dissection.dissect(edges, -1)


def test_leaves_beyond_the_limit_go_by_degree(spark, grid):
    vertices = dissection.rows_of(with_weights(grid, None))
    rows = {r["id"]: r["nth"] for r in dissection._leaf_orders(grid, vertices, 1.2, 10, 120, 1, 1).collect()}
    assert len(rows) == 120 and rows[0] == 2 and rows[55] == 4
