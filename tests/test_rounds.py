"""Moves in rounds beyond the kernel's size, induced parts, the curve's groups, and the stream's state."""

import pytest
from pyspark.sql import functions as F

from meshloom.operators import graphs, metrics, ordering, partitioning
from meshloom.plans.options import PartitionOptions
from meshloom.streaming.adaptive import AdaptivePartition

EDGES = "src long, dst long, wgt long"


def both(pairs):
    return [(a, b, 1) for a, b in pairs] + [(b, a, 1) for a, b in pairs]


def grid_pairs(n, m):
    at = lambda i, j: i * m + j
    return [(at(i, j), at(i + 1, j)) for i in range(n - 1) for j in range(m)] + [(at(i, j), at(i, j + 1)) for i in range(n) for j in range(m - 1)]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(both(grid_pairs(12, 10)), EDGES)


def cut(edges, part):
    return metrics.edge_cut(metrics.with_parts(edges, part)).first()[0]


def test_sums_within_agree_with_brute_force(spark):
    rows = [(i, i % 3, (i * 37) % 11, i % 2) for i in range(200)]
    got = ordering.sums_within(spark.createDataFrame(rows, "id long, k int, v long, z long"), ["k"], {"a": F.col("v"), "b": F.col("z")}, [F.desc("v"), F.col("id")]).collect()
    for r in got:
        before = [x for x in rows if x[1] == r["k"] and (-x[2], x[0]) <= (-r["v"], r["id"])]
        assert r["a"] == sum(x[2] for x in before) and r["b"] == sum(x[3] for x in before)
    assert len(got) == 200


def test_relief_of_one_part_that_holds_all(spark, grid):
    """All vertices in part 0 of 12, more parts than a vertex may ask for beside those it touches."""
    part = graphs.vertices_of(grid).select("id", F.lit(0).alias("pid"))
    out = partitioning.refine_partition(grid, part, PartitionOptions(nparts=12, ufactor=100, niter=12))
    n = {r["pid"]: r["count"] for r in out.groupBy("pid").count().collect()}
    assert sum(n.values()) == 120 and max(n.values()) <= 11 and out.select("id").distinct().count() == 120


def test_induced_rows_fill_parts_with_room(spark):
    """Ten rows touch parts 0 and 1 alike, of four parts: what these have no room for goes to the others."""
    part = spark.createDataFrame([(0, 0), (1, 1)], "id long, pid int")
    rows = spark.createDataFrame([(i, v) for i in range(10) for v in (0, 1)] + [(10, 0)], "id long, via long")
    out = {r["id"]: r["pid"] for r in partitioning.induce(rows, part, 4, 1.0).collect()}
    n = [sum(p == q for p in out.values()) for q in range(4)]
    assert len(out) == 11 and out[10] == 0 and max(n) <= 3 and n[0] == n[1] == 3


def test_induced_rows_without_rows(spark):
    part = spark.createDataFrame([(0, 0)], "id long, pid int")
    assert partitioning.induce(spark.createDataFrame([], "id long, via long"), part, 2).count() == 0


def test_curve_blocks_join_neighbours(spark, grid):
    points = spark.createDataFrame([(i, [float(i // 10), float(i % 10)]) for i in range(119)], "id long, xyz array<double>")
    weights = graphs.vertices_of(grid).withColumn("vwgt", F.lit(1).cast("long"))
    cmap = partitioning.curve_blocks(grid, points, weights, 8.0, dims=2)
    sizes = [r["count"] for r in cmap.groupBy("cid").count().collect()]
    assert sum(sizes) == 120 and max(sizes) <= 8 and len(sizes) < 40
    inner = metrics.with_parts(grid, cmap.withColumnRenamed("cid", "pid")).where("ps = pd").select("src").distinct().count()
    assert inner == 120 - sum(s == 1 for s in sizes)
    assert partitioning.curve_blocks(grid, points, weights, 1.0, dims=2).where("id <> cid").count() == 0


def test_geometric_partition_uses_the_points(spark, grid):
    points = spark.createDataFrame([(i, [float(i // 10), float(i % 10)]) for i in range(120)], "id long, xyz array<double>")
    part = partitioning.geometric_kway(grid, points, PartitionOptions(nparts=3, kernel_size=150, ufactor=100), dims=2)
    n = [r["count"] for r in part.groupBy("pid").count().collect()]
    assert len(n) == 3 and sum(n) == 120 and max(n) <= 45 and cut(grid, part) < 70


def test_stream_state_survives_a_restart(spark, tmp_path):
    pairs, path = grid_pairs(8, 6), f"{tmp_path}/state"
    batch = lambda k: spark.createDataFrame([(a, b, 1) for a, b in pairs[k::3]], EDGES)
    made = lambda: AdaptivePartition(PartitionOptions(nparts=2, niter=2), path=path, merge_every=2)
    first = made()
    first.apply(batch(0), 0)
    first.apply(batch(1), 1)
    parts = sorted(map(tuple, first.part.collect()))
    batch(2).select("src", "dst", "wgt").write.parquet(f"{path}/edges/batch=2")  # a batch that was lost before its commit
    again = made()
    assert again.open(spark).batch == 1
    assert sorted(map(tuple, again.part.collect())) == parts
    again.apply(batch(0), 1)  # comes again: nothing changes
    assert sorted(map(tuple, again.part.collect())) == parts and again.edges.count() == len(pairs[0::3]) * 2 + len(pairs[1::3]) * 2
    again.apply(batch(2), 2)  # the lost batch comes again, and the tables are written whole
    assert again.edges.count() == 2 * len(pairs) and again.part.count() == 48 and again.open(spark).base == 2
    assert made().open(spark).batch == 2
    again.apply(spark.createDataFrame([(0, 1, 5), (0, 47, 3)], EDGES), 3)  # one is heavier than known, one is new
    assert again.edges.count() == 2 * len(pairs) + 2 and again.edges.agg(F.max("wgt")).first()[0] == 3
    written = spark.read.parquet(f"{path}/edges/batch=3").count()
    assert written == 2


def test_links_between_parts_are_given_up_or_it_is_said(spark):
    """Part 0 holds the hub of four chains, and chain 1 has one weak link to it; without room it stays and a warning says so."""
    pairs = [(0, 10), (10, 11), (0, 20), (20, 21), (0, 30), (30, 31), (0, 40), (40, 41), (11, 21)]
    edges = spark.createDataFrame(both(pairs), EDGES)
    part = spark.createDataFrame([(v, v // 10) for v in (0, 10, 11, 20, 21, 30, 31, 40, 41)], "id long, pid int")
    vertices = partitioning.with_weights(edges, None)
    with pytest.warns(RuntimeWarning, match="neighbour parts"):
        out = partitioning.less_connected(edges, vertices, part, PartitionOptions(nparts=5).checked(1))
    assert sorted(r["id"] for r in out.collect()) == [0, 10, 11, 20, 21, 30, 31, 40, 41]


def test_a_round_writes_its_links_once(spark, monkeypatch):
    written, kept = [], partitioning.materialize
    monkeypatch.setattr(partitioning, "materialize", lambda df, name="table", **o: written.append(name) or kept(df, name, **o))
    edges = spark.createDataFrame(both([(0, 1), (1, 2), (2, 3)]), EDGES)
    part = spark.createDataFrame([(v, v % 2) for v in range(4)], "id long, pid int")
    moved = partitioning.refine_round(edges, partitioning.with_weights(edges, None), part, PartitionOptions(nparts=2).checked(1), 0)
    assert moved.count() == 4 and written.count("links") == 1


@pytest.fixture(scope="module")
def dense(spark):
    """260 vertices in a ring, each with an edge to the 20 that follow."""
    return spark.createDataFrame(both([(v, (v + d) % 260) for v in range(260) for d in range(1, 21)]), EDGES)


def test_the_coarsest_graph_is_within_the_kernel_s_size(dense, monkeypatch):
    """A graph of few vertices may have too many edges for the kernel, and none of its vertices is lost on the way."""
    sizes, run = [], partitioning._in_kernel
    monkeypatch.setattr(partitioning, "_in_kernel", lambda e, v, *a: sizes.append(e.count() + v.count()) or run(e, v, *a))
    part = partitioning.partition(dense, PartitionOptions(nparts=2, kernel_size=4000))
    n = sorted(r["count"] for r in part.groupBy("pid").count().collect())
    assert sizes[0] <= 4000 and sum(n) == 260 and len(n) == 2 and n[1] <= 1.03 * 130 + 1 and cut(dense, part) < 1000


def test_groups_of_blocks(spark, dense):
    """Groups hold neighbours of one block, within the cap; a block has 24 vertices and their 960 edges; weights count."""
    loads = graphs.vertices_of(dense).withColumn("vwgt", F.when(F.col("id") == 5, 9).otherwise(1).cast("long"))
    cmap = partitioning.block_groups(dense, loads, 10.0, 260, 24 * 41)
    rows = {r["id"]: r["cid"] for r in cmap.collect()}
    members = {c: [v for v in rows if rows[v] == c] for c in set(rows.values())}
    assert len(rows) == 260 and len(members) <= 260 // 4
    assert all(min(m) == c and len({v // 24 for v in m}) == 1 and sum(9 if v == 5 else 1 for v in m) <= 10 for c, m in members.items())
    assert partitioning.block_groups(dense, loads, 10.0, 260, 41) is None  # blocks of one vertex hold no edges


def test_groups_leave_vertices_without_edges_alone(spark):
    """Vertices 4 and 9 have edges to other blocks only; the kernel alone would pair them, though nothing joins them."""
    pairs = [(a, b) for block in (0, 5) for a in range(block, block + 4) for b in range(a + 1, block + 4)] + [(4, 9)]
    edges = spark.createDataFrame(both(pairs), EDGES)
    loads = graphs.vertices_of(edges).withColumn("vwgt", F.lit(1).cast("long"))
    rows = {r["id"]: r["cid"] for r in partitioning.block_groups(edges, loads, 4.0, 10, 17).collect()}
    assert rows[4] == 4 and rows[9] == 9 and len(rows) == 10 and len(set(rows.values())) < 8


def test_running_sums_of_few_rows_are_those_of_many(spark):
    rows = spark.createDataFrame([(i, i % 3, (i * 37) % 11) for i in range(90)], "id long, k int, v long")
    found = [sorted(map(tuple, ordering.sums_within(rows, ["k"], {"a": F.col("v")}, [F.desc("v"), F.col("id")], few).collect())) for few in (False, True)]
    assert found[0] == found[1]


def test_refinement_ends_where_the_cut_has_settled(spark, grid, monkeypatch):
    """Rounds go on while the cut falls, and while a part is above its bound."""
    cuts = iter([(100, True), (100, False), (100, False), (99, False), (80, False), (80, False), (80, False), (80, False)])
    asked = []

    def step(edges, vertices, part, options, turn, seen):
        seen.append(next(cuts))
        asked.append(turn)
        return part.select("id", "pid")

    monkeypatch.setattr(partitioning, "refine_round", step)
    part = graphs.vertices_of(grid).select("id", F.lit(0).alias("pid"))
    partitioning._refined(grid, partitioning.with_weights(grid, None), part, PartitionOptions(nparts=2))
    assert asked == [0, 1, 2, 3, 4, 5, 6]
