"""Groups for coarsening, walks of many vectors, searches of all components, itemsets with transactions."""

import itertools
import random
from collections import deque

import pytest

from meshloom.operators import analytics, clusters, itemsets, walks
from meshloom.operators.partitioning import coarsen, partition, with_weights
from meshloom.plans import tools
from meshloom.plans.options import PartitionOptions

EDGES, WEIGHTS = "src long, dst long, wgt long", "id long, vwgt long"


def both_ways(pairs):
    return [(a, b, w) for x, y, w in pairs for a, b in ((x, y), (y, x))]


def drawn_graph(n, m, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return both_ways([(a, b, r.randint(1, 5)) for a, b in sorted(pairs)])


def star(spark, leaves):
    rows = spark.range(1, leaves + 1)
    return rows.selectExpr("0L AS src", "id AS dst", "1L AS wgt").union(rows.selectExpr("id", "0L", "1L"))


@pytest.fixture(scope="module")
def drawn(spark):
    rows = drawn_graph(60, 90, 3)
    return rows, spark.createDataFrame(rows, EDGES)


def test_star_clusters_hold_to_cap_centre_and_home(spark, drawn):
    rows, edges = drawn
    weight = {v: 1 + v % 3 for v in range(70)} | {5: 40}
    w = spark.createDataFrame(list(weight.items()), WEIGHTS)
    near = {(a, b) for a, b, _ in rows}
    home = spark.createDataFrame([(v, v % 2) for v in range(70)], "id long, pid int")
    for homes in (None, home):
        found = {r["id"]: r["cid"] for r in clusters.star_clusters(edges, w, 9, home=homes).collect()}
        assert set(found) == set(weight)
        groups = {c: [v for v in found if found[v] == c] for c in set(found.values())}
        for c, members in groups.items():
            assert c in members and all(v == c or (v, c) in near for v in members)
            assert len(members) == 1 or sum(weight[v] for v in members) <= 9
            assert homes is None or len({v % 2 for v in members}) == 1
        assert found[5] == 5 and all(found[v] == v for v in range(60, 70))  # too heavy; without edges
    assert max(map(len, groups.values())) > 2


def test_star_clusters_without_edges_or_weights(spark):
    w = spark.createDataFrame([(1, None), (2, 3)], WEIGHTS)
    loops = spark.createDataFrame([(1, 1, 1), (2, 9, 1), (9, 2, 1)], EDGES)
    for edges in (loops.limit(0), loops):
        assert sorted(clusters.star_clusters(edges, w, 5).collect()) == [(1, 1), (2, 2)]
    assert clusters.star_clusters(loops, w.limit(0), 5).isEmpty()


def test_a_star_halves_in_one_level(spark):
    edges = star(spark, 3000)
    vertices = with_weights(edges, None)
    levels = coarsen(edges, vertices, 10, 1, most=1)
    assert levels[-1][1].count() <= 1502
    assert len(coarsen(edges, vertices, 10, 1, most=1, two_hop=False)) == 1  # hardly shrinks


def test_two_hop_kinds(spark):
    # 1 and 2 have the same neighbours 8, 9; 3 and 4 share hub 9 alone; 5, 6 and 7 are islands; 8 and 9 are matched.
    edges = spark.createDataFrame(both_ways([(1, 8, 1), (1, 9, 1), (2, 8, 1), (2, 9, 1), (3, 9, 1), (4, 9, 2), (8, 9, 1)]), EDGES)
    w = spark.createDataFrame([(v, 1) for v in range(1, 10)], WEIGHTS)
    cmap = spark.createDataFrame([(v, 8 if v == 9 else v) for v in range(1, 10)], "id long, cid long")
    assert dict(clusters.two_hop(edges, w, cmap, 2).collect()) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8}
    assert dict(clusters.two_hop(edges, w, cmap, 1).collect()) == dict(cmap.collect())  # no room
    home = spark.createDataFrame([(v, int(v in (2, 5))) for v in range(1, 10)], "id long, pid int")
    assert dict(clusters.two_hop(edges, w, cmap, 2, home=home).collect()) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8}
    assert clusters.two_hop(edges.limit(0), w.limit(0), cmap.limit(0), 2).isEmpty()


@pytest.mark.parametrize("ctype", ["rm", "fc"])
def test_coarsening_types(spark, drawn, ctype):
    edges = drawn[1]
    vertices = with_weights(edges, None)
    levels = coarsen(edges, vertices, 15, 2, ctype=ctype)
    assert len(levels) > 1
    for _, v, _ in levels:
        assert v.selectExpr("sum(vwgt[0])").first()[0] == vertices.count()


def test_options_beyond_the_kernel(drawn):
    for bad in ({"ctype": "jc"}, {"rtype": "swap"}):
        with pytest.raises(ValueError, match="kernel_size"):
            partition(drawn[1], PartitionOptions(nparts=2, kernel_size=10, **bad))


def test_walks_together_as_alone(spark, drawn):
    edges = spark.createDataFrame([r for r in drawn[0] if r[0] > 2], EDGES)  # 0, 1 and 2 are sinks
    restarts = spark.createDataFrame([("a", 7, 2.0), ("a", 8, 6.0), ("b", 0, 1.0), ("b", 0, 1.0), ("c", 3, 0.0), ("d", 5, None)], "walk string, id long, r double")
    got = walks.pagerank_batch(edges, restarts, 0.5, 40, 1e-3).collect()
    assert {r["walk"] for r in got} == {"a", "b"}
    for walk, shares in {"a": [(7, 0.25), (8, 0.75)], "b": [(0, 1.0)]}.items():
        alone = analytics.pagerank(edges, 0.5, 40, spark.createDataFrame(shares, "id long, r double"), eps=1e-3)
        want = {r["id"]: r["pr"] for r in alone.collect() if r["pr"] > 0}
        assert {r["id"]: r["pr"] for r in got if r["walk"] == walk} == pytest.approx(want, abs=1e-12)
    assert all(0 < r["rounds"] < 40 for r in got) and len({(r["walk"], r["rounds"]) for r in got}) == 2
    assert walks.pagerank_batch(edges, restarts.limit(0)).isEmpty()


def test_largest_differences(spark):
    ranks = spark.createDataFrame([(1, 0.5), (2, 0.2), (3, 0.2), (4, 0.2)], "id long, pr double")
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 3, 1), (3, 2, 1)], EDGES)
    got = {r["id"]: (r["degree"], round(r["difference"], 9), r["at"]) for r in walks.largest_differences(edges, ranks).collect()}
    assert got == {1: (2, 0.3, 2), 2: (2, 0.3, 1), 3: (1, 0.0, 3), 4: (0, 0.0, 4)}


def discovered(rows, vertices):
    """Positions from a queue, restarted at the smallest vertex that is left."""
    near = {v: sorted(b for a, b, _ in rows if a == v) for v in vertices}
    order, seen = [], set()
    for root in sorted(vertices):
        if root in seen:
            continue
        queue = deque([root])
        seen.add(root)
        while queue:
            v = queue.popleft()
            order.append(v)
            new = [n for n in near[v] if n not in seen]
            seen |= set(new)
            queue += new
    return {v: i for i, v in enumerate(order)}


def test_breadth_first_of_all_components(spark):
    rows = drawn_graph(50, 45, 5)
    edges, vertices = spark.createDataFrame(rows, EDGES), spark.range(50)
    got = walks.breadth_first(edges, vertices).collect()
    assert {r["id"]: r["pos"] for r in got} == discovered(rows, range(50))
    assert sum(r["level"] == 0 for r in got) == len({r["component"] for r in got})
    assert walks.breadth_first(edges.limit(0)).isEmpty()


def test_far_roots(spark):
    chain = both_ways([(3, 1, 1), (1, 2, 1), (2, 7, 1), (7, 5, 1), (10, 11, 1)])  # 3-1-2-7-5 and a pair
    got = {r["component"]: (r["id"], r["depth"]) for r in walks.far_roots(spark.createDataFrame(chain, EDGES), spark.createDataFrame([(20,)], "id long").union(spark.createDataFrame([(v,) for v in (1, 10)], "id long"))).collect()}
    assert got[1] == (5, 4) and got[10] == (10, 1) and got[20] == (20, 0)


def brute_sets(baskets, least, max_len):
    found = {}
    for size in range(1, max_len + 1):
        for tid, items in baskets.items():
            for s in itertools.combinations(sorted(items), size):
                found.setdefault(s, []).append(tid)
    return {s: sorted(t) for s, t in found.items() if len(t) >= least}


def test_itemsets_with_transactions(spark):
    r = random.Random(1)
    baskets = {f"t{i:03}": set(r.sample(range(9), r.randint(0, 5))) | ({0} if i % 3 else set()) for i in range(200)}
    rows = [(t, i) for t, items in baskets.items() for i in items]
    df = spark.createDataFrame([*rows, *rows[:50], (None, 1), ("x", None)], "tid string, item int")
    got = itemsets.vertical_itemsets(df, 4, max_len=-1)
    want = brute_sets(baskets, 4, 5)
    assert {tuple(x["items"]): x["support"] for x in got.found.collect()} == {s: len(t) for s, t in want.items()}
    held = {}
    for x in got.tids().collect():
        held.setdefault(tuple(x["items"]), []).append(x["tid"])
    assert {s: sorted(t) for s, t in held.items()} == want
    pairs = itemsets.vertical_itemsets(df, 4, most=60, min_len=2, max_len=2).found.collect()
    assert {tuple(x["items"]): x["support"] for x in pairs} == {tuple(x["items"]): x["support"] for x in analytics.itemsets(df.dropna(), 4, 60, 2, 2).collect()}


def test_itemsets_of_nothing_and_callback(spark, tmp_path):
    empty = spark.createDataFrame([], "tid long, item long")
    got = itemsets.vertical_itemsets(empty, 1, min_len=2)
    assert got.found.isEmpty() and got.tids().isEmpty()
    with pytest.raises(ValueError):
        itemsets.vertical_itemsets(empty, 0)
    folder = str(tmp_path)

    def emit(items, support, tids):
        with open(f"{folder}/{'-'.join(map(str, items))}_{tids[0]}", "w") as f:
            f.write(f"{support} {tids}")

    many = spark.range(130).selectExpr("id AS tid", "7L AS item")
    itemsets.vertical_itemsets(many, 100).each(emit, piece=1)
    seen = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert seen == {f"7_{a}": f"130 {list(range(a, min(a + 64, 130)))}" for a in (0, 64, 128)}


def test_ranking_tool(spark, tmp_path):
    path = f"{tmp_path}/g.graph"
    with open(path, "w") as f:
        f.write("3 2\n2 3\n1\n1\n")
    tools.rank_pages(spark, path, f"{tmp_path}/all", rounds=2)
    assert len(spark.read.csv(f"{tmp_path}/all").columns) == 5
    told = tools.rank_pages(spark, path, f"{tmp_path}/many", vectors=3, rounds=2)
    assert set(told["rounds"]) == {0, 1, 2} and spark.read.csv(f"{tmp_path}/many").count() == 9
    assert set(tools.rank_pages(spark, path, f"{tmp_path}/one", source=1, rounds=2)["rounds"]) == {0}
