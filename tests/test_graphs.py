"""Graph operators and kernels on hand-made graphs, files there and back, and the stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshloom.functions import scalars
from meshloom.kernels import csr, partition, separators
from meshloom.operators import analytics, graphs, matrix, mesh, metrics, partitioning, repartition
from meshloom.operators.ordering import global_rank, rank_within, running_sum
from meshloom.plans import tools
from meshloom.plans.options import OrderOptions, PartitionOptions
from meshloom.sources import graph_files, matrix_files, proteins
from meshloom.streaming.adaptive import AdaptivePartition, maintain

EDGES = "src long, dst long, wgt long"


def both(pairs, w=1):
    return [(a, b, w) for a, b in pairs] + [(b, a, w) for a, b in pairs]


def grid_pairs(n, m):
    at = lambda i, j: i * m + j
    return [(at(i, j), at(i + 1, j)) for i in range(n - 1) for j in range(m)] + [(at(i, j), at(i, j + 1)) for i in range(n) for j in range(m - 1)]


def in_memory(n, m):
    e = np.array(both(grid_pairs(n, m)))
    return csr.build(n * m, e[:, 0], e[:, 1], e[:, 2].astype(float))


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(both(grid_pairs(12, 10)), EDGES)


def test_check_and_fix(spark):
    bad = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 5), (1, 0, 2), (1, 2, 3), (3, 4, 1), (4, 3, 7)], EDGES)
    found = {r["violation"]: r["n"] for r in graphs.check(bad).collect()}
    assert found == {"self_loop": 1, "duplicate_edge": 1, "missing_reverse": 1, "unequal_weight": 1}
    fixed = graphs.fix(bad)
    assert graphs.is_valid(fixed)
    assert {tuple(r) for r in fixed.collect()} == {(0, 1, 2), (1, 0, 2), (1, 2, 3), (2, 1, 3), (3, 4, 1), (4, 3, 1)}
    none = spark.createDataFrame([], EDGES)
    assert graphs.is_valid(none) and graphs.fix(none).count() == 0 and analytics.components(none).count() == 0


def test_searches(spark, grid):
    root = spark.createDataFrame([(0,)], "id long")
    levels = {r["id"]: r["level"] for r in analytics.bfs_levels(grid, root).collect()}
    assert levels == {i * 10 + j: i + j for i in range(12) for j in range(10)}
    far = grid.union(spark.createDataFrame(both([(500, 501)]), EDGES))
    dist = {r["id"]: r["dist"] for r in analytics.sssp(far, root, graphs.vertices_of(far)).collect()}
    assert dist[500] == -1 and dist[119] == 20
    assert sorted(r["pos"] for r in analytics.bfs_order(far, root).collect()) == list(range(122))
    assert analytics.is_connected(grid) and not analytics.is_connected(far)


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(700)
    path = spark.createDataFrame(both([(int(a), int(b)) for a, b in zip(ids[:-1], ids[1:], strict=True)]), EDGES)
    assert {r["component"] for r in analytics.components(path).collect()} == {0}


def test_pagerank_with_sinks(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0)], "src long, dst long, wgt double")
    got = {r["id"]: r["pr"] for r in analytics.pagerank(e, 0.5, 200, eps=1e-12).collect()}
    p = np.array([[0, 0.25, 0.75], [0, 0, 1], [0, 0, 0]])
    pr = np.full(3, 1 / 3)
    for _ in range(300):
        pr = 0.5 * (pr[2] / 3 + pr @ p) + 0.5 / 3
    assert np.allclose([got[i] for i in range(3)], pr, atol=1e-9) and sum(got.values()) == pytest.approx(1)


def test_meshes(spark):
    inc = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 3), (3, 9)], "elem long, node long")
    strict = {(r["src"], r["dst"]) for r in mesh.dual_graph(inc, 2, relaxed=False).collect()}
    assert strict == {(0, 1), (1, 0)}
    relaxed = {(r["src"], r["dst"]) for r in mesh.dual_graph(inc, 2).collect()}
    assert relaxed == {(0, 1), (1, 0), (1, 2), (2, 1), (2, 2), (3, 3)}
    epart, npart = partitioning.partition_mesh(inc, PartitionOptions(nparts=2))
    assert epart.count() == 4 and npart.count() == 5 and npart.where("pid not in (0, 1)").count() == 0


def test_ranks(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 3).alias("k"))
    got = {r["id"]: (r["r"], r["s"]) for r in running_sum(global_rank(rows, ["id"], "r"), "id", ["id"], "s").collect()}
    assert got == {i: (i, i * (i + 1) // 2) for i in range(1000)}
    within = rank_within(rows, "k", "id", "w").toPandas().sort_values("id")
    assert (within["w"] == within.groupby("k").cumcount()).all()


# -- partitions -------------------------------------------------------------


@pytest.mark.parametrize("options", [PartitionOptions(nparts=4), PartitionOptions(nparts=4, ptype="rb"), PartitionOptions(nparts=3, objtype="vol", contig=True, minconn=True), PartitionOptions(nparts=1)])
def test_partitions(grid, options):
    part = partitioning.partition(grid, options)
    rows = part.toPandas()
    k = options.nparts
    assert len(rows) == 120 and rows["id"].is_unique and rows["pid"].between(0, k - 1).all() and rows["pid"].nunique() == k
    assert rows["pid"].value_counts().max() * k <= 1.2 * 120
    assert metrics.edge_cut(metrics.with_parts(grid, part)).first()[0] <= 45
    again = partitioning.partition(grid, options).toPandas()
    assert rows.sort_values("id").equals(again.sort_values("id")) or (rows.sort_values("id").to_numpy() == again.sort_values("id").to_numpy()).all()


def test_distributed_levels(spark, grid):
    """A tiny kernel size takes the way of large graphs."""
    part = partitioning.partition(grid, PartitionOptions(nparts=2, kernel_size=200, niter=2))
    rows = part.toPandas()
    assert len(rows) == 120 and rows["pid"].isin([0, 1]).all()
    assert metrics.edge_cut(metrics.with_parts(grid, part)).first()[0] < 60


def test_bad_options():
    for bad in (dict(nparts=0), dict(ptype="x"), dict(ufactor=0), dict(nparts=2, tpwgts=((0.5,), (0.2,))), dict(ubvec=(1.0,)), dict(ncuts=0), dict(numbering=2)):
        with pytest.raises(ValueError):
            PartitionOptions(**bad).checked()


def test_targets_and_constraints():
    g = in_memory(16, 16)
    shares = np.array([[0.25], [0.75]])
    where = partition.kway(g, shares, np.array([1.05]), 1)
    assert abs((where == 0).mean() - 0.25) < 0.03
    two = csr.Graph(g.xadj, g.adj, g.wgt, np.column_stack([np.ones(g.n, dtype=np.int64), np.arange(g.n) % 5]))
    where = partition.kway(two, np.full((2, 2), 0.5), np.array([1.1, 1.1]), 1)
    load = np.stack([two.vwgt[where == p].sum(0) for p in (0, 1)])
    assert (load.max(0) / two.vwgt.sum(0) < 0.57).all()


def test_separator_and_orders(spark, grid):
    part = partitioning.vertex_separator(grid)
    assert metrics.separator_violations(metrics.with_parts(grid, part)).first()[0] == 0
    assert part.where("pid = 2").count() <= 20 and part.select("pid").distinct().count() == 3
    order = partitioning.nested_dissection(grid, OrderOptions(leaf=10))
    assert sorted(r["pos"] for r in order.collect()) == list(range(120))
    by_id = global_rank(graphs.vertices_of(grid), ["id"], "pos")
    assert analytics.fill_in(grid, order).first()["nnz"] < analytics.fill_in(grid, by_id).first()["nnz"]
    star = spark.createDataFrame(both([(0, i) for i in range(1, 30)]), EDGES)
    late = partitioning.nested_dissection(star, OrderOptions(pfactor=30))
    assert late.orderBy(F.desc("pos")).first()["id"] == 0


def test_kernels():
    g = in_memory(9, 7)
    for order in (separators.minimum_degree(g), csr.cuthill_mckee(g), csr.best_first(g, 0), csr.best_first(g, 5, "first"), csr.best_first(g, 5, "few")):
        assert sorted(order.tolist()) == list(range(63))
    assert (np.abs(np.argsort(csr.cuthill_mckee(g))[g.src] - np.argsort(csr.cuthill_mckee(g))[g.adj])).max() <= 9
    a, b = separators.minimum_cover([0, 1, 2], {0: [0, 1], 1: [0], 2: [0]})
    assert len(a) + len(b) == 2
    rng = np.random.default_rng(3)
    for _ in range(20):
        edges = {u: sorted(set(rng.integers(0, 8, int(rng.integers(1, 5))).tolist())) for u in range(8)}
        a, b = separators.minimum_cover(sorted(edges), edges)
        assert all(u in a or v in b for u in edges for v in edges[u])
        best = min(bin(m).count("1") + len({v for u in edges if not m >> u & 1 for v in edges[u]}) for m in range(256))
        assert len(a) + len(b) == best
    assert csr.volume(g, np.arange(63) % 2, 2) > 0


def test_adaptive_and_remap(spark, grid):
    home = graphs.vertices_of(grid).select("id", F.pmod("id", F.lit(3)).cast("int").alias("pid"))
    part = repartition.adaptive_repartition(grid, home, PartitionOptions(nparts=3, niter=2))
    cut = lambda p: metrics.edge_cut(metrics.with_parts(grid, p)).first()[0]
    assert part.count() == 120 and cut(part) < cut(home)
    better = partitioning.refine_partition(grid, home, PartitionOptions(nparts=3, niter=2))
    assert better.count() == 120 and cut(better) <= cut(home)
    renamed = home.select("id", F.col("pid").alias("home"), ((F.col("pid") + 1) % 3).cast("int").alias("pid"), F.lit(1).alias("vsize"))
    assert partitioning.remap(renamed, 3).join(home, ["id", "pid"]).count() == 120


def test_islands_return(spark):
    loads = spark.createDataFrame([(0, 5.0), (1, 1.0)], "pid int, load double")
    lone = spark.createDataFrame([(10 + i, 1) for i in range(6)], "id long, vwgt long")
    got = graphs.restore_islands(lone, loads, 12.0, 2).groupBy("pid").count().collect()
    assert {r["pid"]: r["count"] for r in got} == {0: 1, 1: 5}


# -- matrices ---------------------------------------------------------------


def test_low_filter_keeps_the_crossing_entry(spark):
    m = spark.createDataFrame([(0, 0, 4.0), (0, 1, 3.0), (0, 2, 3.0), (1, 0, 1.0)], "row long, col long, val double")
    kept = {(r["row"], r["col"]) for r in matrix.low_filter(m, "row", 1, 0.5).collect()}
    assert kept == {(0, 0), (0, 1), (1, 0)}


def test_scales_of_negative_values(spark):
    m = spark.createDataFrame([(0, 0, -4.0), (0, 1, 0.0), (1, 1, 2.0)], "row long, col long, val double")
    values = lambda kind: sorted(r["val"] for r in matrix.scale(m, kind).collect())
    assert values("sqrt") == pytest.approx([-1.9, 0.0, 0.1 + 2**0.5])
    assert values("log") == pytest.approx([-1.0, 0.0, 2.0])
    with pytest.raises(ValueError):
        matrix.scale(m, "unknown")


# -- files ------------------------------------------------------------------


def test_graph_files(spark, tmp_path):
    path = f"{tmp_path}/g.graph"
    with open(path, "w") as f:
        f.write("% a comment\n4 3 111 2\n1 5 6 2 7\n2 1 1 1 7 3 8\n% inside\n3 2 2 2 8\n1 0 0 4 9\n".replace("1 0 0 4 9", "9 1 1"))
    with pytest.raises(ValueError):
        graph_files.read_graph(spark, path)
    with open(path, "w") as f:
        f.write("% a comment\n4 2 111 2\n1 5 6 2 7\n2 1 1 1 7 3 8\n% inside\n3 2 2 2 8\n9 1 1\n")
    edges, vertices = graph_files.read_graph(spark, path)
    assert {tuple(r) for r in edges.collect()} == {(0, 1, 7), (1, 0, 7), (1, 2, 8), (2, 1, 8)}
    assert {(r["id"], r["vsize"], tuple(r["vwgt"])) for r in vertices.collect()} == {(0, 1, (5, 6)), (1, 2, (1, 1)), (2, 3, (2, 2)), (3, 9, (1, 1))}
    out = f"{tmp_path}/out.graph"
    graph_files.write_graph(edges, vertices, out)
    again, weights = graph_files.read_graph(spark, out)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, edges.collect()))
    assert sorted(map(str, weights.collect())) == sorted(map(str, vertices.collect()))
    for header in ("4", "4 2 200", "4 2 001 2", "a b"):
        with pytest.raises(ValueError):
            graph_files.graph_header(header)


def test_bad_neighbours_raise(spark, tmp_path):
    path = f"{tmp_path}/bad.graph"
    with open(path, "w") as f:
        f.write("2 1\n2\n3\n")
    with pytest.raises(Exception, match="bad end"):
        graph_files.read_graph(spark, path)[0].collect()


def test_other_files(spark, tmp_path):
    mesh_path = f"{tmp_path}/m.mesh"
    with open(mesh_path, "w") as f:
        f.write("2 1\n5 1 2 3\n6 2 3 4\n")
    inc, weights = graph_files.read_mesh(spark, mesh_path)
    assert {(r["elem"], r["node"]) for r in inc.collect()} == {(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3)} and weights.count() == 2
    part = spark.range(5).select("id", (F.col("id") % 2).cast("int").alias("pid"))
    written = graph_files.write_partition(part, f"{tmp_path}/x", 2)
    assert sorted(map(tuple, graph_files.read_partition(spark, written, 5).collect())) == sorted(map(tuple, part.collect()))
    with pytest.raises(ValueError):
        graph_files.read_partition(spark, written, 6)
    with pytest.raises(ValueError):
        graph_files.write_permutation(part.select("id", F.col("pid").alias("pos")), f"{tmp_path}/x")
    assert graph_files.parse_targets("0 = 0.5\n", 3, 1) == [[0.5], [0.25], [0.25]]
    assert graph_files.parse_targets("0-1:0=0.4\n2:0=0.4", 3, 1)[0][0] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        graph_files.parse_targets("9=0.5", 3, 1)
    with open(f"{tmp_path}/xyz", "w") as f:
        f.write("0 1 2\n3 4.5 5\n")
    assert graph_files.read_coordinates(spark, f"{tmp_path}/xyz").where("id = 1").first()["xyz"] == [3.0, 4.5, 5.0]


@pytest.mark.parametrize("kind", ["csr", "clu", "ijv", "binr", "binc"])
def test_matrix_files(spark, tmp_path, kind):
    m = spark.createDataFrame([(0, 1, 2.5), (0, 3, -1.0), (2, 0, 7.0), (2, 4, 0.5)], "row long, col long, val double")
    path = f"{tmp_path}/m.{kind}"
    matrix_files.save(m, path)
    assert sorted(map(tuple, matrix_files.load(spark, path).collect())) == sorted(map(tuple, m.collect()))
    assert matrix_files.shape(spark, path) == (3, 5, 4)
    with pytest.raises(ValueError):
        matrix_files.load(spark, f"{tmp_path}/m.unknown")


@pytest.mark.parametrize("dtype", ["int32", "int64", "float32", "float64"])
def test_arrays(spark, tmp_path, dtype):
    rows = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "id long, value double")
    matrix_files.write_array(rows, f"{tmp_path}/a.bin", dtype)
    assert [r["value"] for r in matrix_files.read_array(spark, f"{tmp_path}/a.bin", dtype).orderBy("id").collect()] == [i * i for i in range(10)]
    with open(f"{tmp_path}/t.txt", "w") as f:
        f.write("a b c\n\nd e\n")
    assert matrix_files.file_stats(spark, f"{tmp_path}/t.txt").first().asDict() == {"lines": 3, "tokens": 5, "most_tokens": 3, "bytes": 11}
    assert matrix_files.exists(spark, f"{tmp_path}/t.txt") and not matrix_files.exists(spark, f"{tmp_path}/no")
    assert matrix_files.path_parts("/a/b.c.txt") == {"folder": "/a", "filename": "b.c.txt", "basename": "b.c", "extension": "txt"}


def test_proteins(spark, tmp_path):
    with open(f"{tmp_path}/p.pdb", "w") as f:
        f.write("ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00\nATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00  0.00\nATOM      3  CA  GLY A   2      12.639   7.071  -5.147  1.00  0.00\nTER\n")
    atoms = proteins.read_pdb(spark, f"{tmp_path}/p.pdb")
    assert atoms.count() == 3 and proteins.fasta(atoms).first()["sequence"] == "AG" and proteins.backbone(atoms).count() == 3
    assert "CA" in proteins.pdb_lines(atoms).where("serial = 2").first()["line"]
    with open(f"{tmp_path}/s.fa", "w") as f:
        f.write(">one\nACD\nEFG\n>two\nHH\n")
    assert {(r["name"], r["sequence"]) for r in proteins.read_fasta(spark, f"{tmp_path}/s.fa").collect()} == {("one", "ACDEFG"), ("two", "HH")}


def test_jobs(spark, tmp_path, grid):
    path = f"{tmp_path}/grid.graph"
    graph_files.write_graph(grid, graphs.vertices_of(grid), path)
    report = tools.partition_graph(spark, path, 4)
    assert report["edge_cut"] <= 45 and graph_files.read_partition(spark, report["written"], 120).count() == 120
    ordered = tools.order_graph(spark, path, leaf=20)
    assert tools.compare_fill(spark, path, ordered["written"])["nnz"] == ordered["nnz"]
    assert sum(tools.check_graph(spark, path).values()) == 0
    assert tools.rank_pages(spark, path, f"{tmp_path}/ranks")["total"] == pytest.approx(1, abs=1e-5)
    assert tools.convert_matrix(spark, path, f"{tmp_path}/grid.csr")["entries"] == grid.count()
    assert tools.reorder_graph(spark, path, f"{tmp_path}/bfs.graph")["after"] > 0
    with open(f"{tmp_path}/m.mesh", "w") as f:
        f.write("3\n1 2 3\n2 3 4\n3 4 5\n")
    assert tools.mesh_to_graph(spark, f"{tmp_path}/m.mesh", f"{tmp_path}/dual.graph", "dual", 2)["edges"] == 2
    assert len(tools.partition_mesh(spark, f"{tmp_path}/m.mesh", 2)["written"]) == 2
    with open(f"{tmp_path}/t.csr", "w") as f:
        f.write("1 1 2 1\n1 1 2 1 3 1\n2 1\n")
    assert tools.frequent_itemsets(spark, f"{tmp_path}/t.csr", f"{tmp_path}/sets", 2)["itemsets"] == 3


# -- scalars and the stream -------------------------------------------------


def test_scalars(spark):
    row = spark.createDataFrame([("xxHello Worldyy", 10, [3.0, 1.0, 3.0])], "s string, n long, v array<double>").select(
        scalars.trim_head("s", "x").alias("h"), scalars.regex_replace("s", "(o)", "<$1>").alias("first"), scalars.regex_replace("s", "O", "0", "gi").alias("every"),
        scalars.regex_count("s", "o").alias("c"), scalars.bit_reverse("n", 8).alias("rev"), scalars.chunk_size(F.lit(0), 3, "n").alias("size"),
        scalars.chunk_start(F.lit(1), 3, "n").alias("start"), scalars.chunk_of(F.lit(4), 3, "n").alias("of"), scalars.vector_argmax("v").alias("at"),
        scalars.prefix_sums("v").alias("p"), scalars.differentiate("v").alias("d"), scalars.string_to_time(F.lit("no time")).alias("t"),
        scalars.vector_le("v", "v").alias("le"), scalars.up_pow2("n").alias("up"),
    ).first()
    assert row["h"] == "Hello Worldyy" and row["first"] == "xxHell<o> Worldyy" and row["every"] == "xxHell0 W0rldyy" and row["c"] == 3
    assert (row["rev"], row["size"], row["start"], row["of"], row["at"], row["t"], row["le"], row["up"]) == (80, 4, 4, 1, 0, -1, True, 16)
    assert row["p"] == [3.0, 4.0, 7.0] and row["d"] == [3.0, -2.0, 2.0]


def test_stream(spark, tmp_path):
    pairs = grid_pairs(8, 6)
    for k in range(3):
        pd.DataFrame(pairs[k::3], columns=["src", "dst"]).assign(wgt=1).to_parquet(f"{tmp_path}/{k}.parquet")
    state, seen = AdaptivePartition(PartitionOptions(nparts=2, niter=2)), []
    stream = spark.readStream.schema(EDGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = maintain(stream, state, lambda part, batch: seen.append(part.count())).option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 3 and seen[-1] == 48 and state.part.select("id").distinct().count() == 48
    state.apply(state.edges, 0)  # a batch that comes again
    assert state.edges.count() == 2 * len(pairs)


# -- further kernels and measures ---------------------------------------------


@pytest.mark.parametrize("how", ["", "fc", "jc"])
@pytest.mark.parametrize("start", ["grow", "random", "kway"])
@pytest.mark.parametrize("refine", ["greedy", "swap", "hs", "kpm"])
def test_kernel_variants(how, start, refine):
    g, k = in_memory(16, 16), 4
    where = partition.kway(g, np.full((k, 1), 1 / k), np.array([1.05]), 3, how=how, start=start, refine=refine)
    assert set(where.tolist()) == set(range(k)) and np.bincount(where).max() <= 1.05 * g.n / k + 1
    assert csr.cut(g, where) < 0.5 * len(g.adj) / 2


def test_swaps_hills_and_pairs_never_raise_the_cut():
    from meshloom.kernels import moves

    g, shares, ub = in_memory(12, 12), np.full((3, 1), 1 / 3), np.array([1.1])
    where = np.random.default_rng(2).permutation(np.arange(g.n) % 3)
    before = csr.cut(g, where)
    swapped = moves.swap_edges(g, where)
    assert csr.cut(g, swapped) < before and (np.bincount(swapped) == np.bincount(where)).all()
    assert csr.cut(g, moves.scan_hills(g, swapped, shares, ub)) < csr.cut(g, swapped)
    assert csr.cut(g, moves.pairs_of_parts(g, swapped, shares, ub)) < csr.cut(g, swapped)
    levels = partition.coarsen(g, 5, np.random.default_rng(1), n_levels=2)
    assert len(levels) == 3


def test_options_of_kernels(grid):
    part = partitioning.partition(grid, PartitionOptions(nparts=3, ctype="fc", iptype="kway", rtype="hs"))
    assert part.count() == 120 and part.agg(F.count_distinct("pid")).first()[0] == 3
    with pytest.raises(ValueError):
        PartitionOptions(rtype="none").checked()


def test_roc_n_by_hand(spark):
    """Rows by score: + - (tie: + -) + -; all three positives divide, and the list ends with the second false positive."""
    from meshloom.operators import ranking

    rows = [(9.0, 1, 0), (8.0, -1, 1), (7.0, 1, 2), (7.0, -1, 3), (6.0, 1, 4), (5.0, -1, 5)]
    ranked = spark.createDataFrame(rows, "score double, cls int, tie int")
    # Areas: (0,1) to (1,1): 1; the tie from (1,1) to (2,2): 1.5.  Over 3 positives times 2 false ones.
    assert ranking.roc_n(ranked, 2).first()[0] == round(2.5 / 6, 6)
    assert ranking.roc_n(ranked, 2, compat=True).first()[0] == round(2 / 6, 6)
    # One false positive ends the list inside no tie: area 1 over 3 times 1.
    assert ranking.roc_n(ranked, 1).first()[0] == round(1 / 3, 6)
    assert ranking.max_accuracy(ranked).first()[0] == round(100 * 4 / 6, 6)
    bad = spark.createDataFrame([(9.0, -1, 0), (8.0, -1, 1)], "score double, cls int, tie int")
    assert ranking.max_accuracy(bad).first()[0] == 50.0


def test_interface_counts_by_hand(spark):
    """Vertex 0 touches two foreign parts and counts twice."""
    placed = spark.createDataFrame([(a, b, w, a % 3, b % 3) for a, b, w in both([(0, 1), (0, 2), (0, 3), (1, 2)])], "src long, dst long, wgt long, ps int, pd int")
    found = {r["kind"]: (r["least"], r["largest"], r["mean"]) for r in metrics.interface_stats(placed, 3).collect()}
    assert found["interface"] == (2, 2, 2.0) and found["cut"] == (2, 2, 2.0)


def test_levels_and_distances_on_a_long_path(spark):
    n = 70
    path = spark.createDataFrame(both([(i, i + 1) for i in range(n - 1)], 3), EDGES)
    root = spark.createDataFrame([(0,)], "id long")
    assert {r["id"]: r["level"] for r in analytics.bfs_levels(path, root).collect()} == {i: i for i in range(n)}
    assert {r["id"]: r["dist"] for r in analytics.sssp(path, root).collect()} == {i: 3 * i for i in range(n)}


def test_discovery_order(spark, grid):
    from collections import deque

    near = {}
    for a, b, _ in both(grid_pairs(12, 10)):
        near.setdefault(a, set()).add(b)
    order, queue, seen = [], deque([37]), {37}
    while queue:
        v = queue.popleft()
        order.append(v)
        for u in sorted(near[v] - seen):
            seen.add(u)
            queue.append(u)
    got = analytics.bfs_discovery(grid, spark.createDataFrame([(37,)], "id long")).orderBy("pos").collect()
    assert [r["id"] for r in got] == order and [r["pos"] for r in got] == list(range(120))


def test_articulation(spark):
    """Two triangles that share vertex 2, and a leaf; vertex 2 holds its part together, others do not."""
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5)]
    placed = spark.createDataFrame(both(pairs), EDGES).withColumns({"ps": F.lit(0), "pd": F.lit(0)})
    asked = spark.createDataFrame([(i,) for i in range(6)], "id long")
    assert {r["id"]: r["articulation"] for r in analytics.articulation(placed, asked).collect()} == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False}


def test_itemset_callback(spark):
    seen = spark.sparkContext.accumulator(0)
    baskets = spark.createDataFrame([(t, i) for t in range(6) for i in range(3)], "tid long, item long")
    analytics.each_itemset(baskets, lambda items, support: seen.add(len(items) * support), 3)
    assert seen.value == 6 * (3 * 1 + 3 * 2 + 1 * 3)


def test_arrays_and_extremes(spark):
    df = spark.createDataFrame([([3, 1, 2], [2, 5], [4.0, 9.0, 7.0, 1.0])], "a array<long>, b array<long>, v array<double>")
    row = df.select(
        scalars.merged("a", "b").alias("u"), scalars.merged("a", "b", "intersection").alias("i"), scalars.merged("a", "b", "difference").alias("d"),
        scalars.second_argmax("v").alias("second"), scalars.strided_argmax("v", 2).alias("even"), scalars.strided_argmax("v", 2, 1).alias("odd"),
    ).first()
    assert (row["u"], row["i"], row["d"], row["second"], row["even"], row["odd"]) == ([1, 2, 3, 5], [2], [1, 3], 2, 1, 0)


def test_triplets_there_and_back(spark, tmp_path):
    m = spark.createDataFrame([(0, 3, 1.5), (2, 0, -2.0), (2, 1, 4.0)], "row long, col long, val double")
    matrix_files.save(m, f"{tmp_path}/m.bijv")
    assert sorted(tuple(r) for r in matrix_files.load(spark, f"{tmp_path}/m.bijv").collect()) == sorted(tuple(r) for r in m.collect())


def test_hot_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(mesh, "HOT", 4)
    inc = spark.createDataFrame([(e, n) for e in range(19) for n in (0, 1 + e % 3)], "elem long, node long")
    found = {(r["src"], r["dst"]): r["wgt"] for r in mesh.dual_graph(inc, 1, relaxed=False).collect()}
    assert found == {(a, b): 1 + (a % 3 == b % 3) for a in range(19) for b in range(19) if a != b}


def shared_nodes(inc, ncommon, relaxed):
    """The dual graph by brute force."""
    nodes = {}
    for e, n in set(inc):
        nodes.setdefault(e, set()).add(n)
    need = {e: min(ncommon, len(x) - 1) if relaxed else ncommon for e, x in nodes.items()}
    found = {(e, e): 0 for e, x in nodes.items() if relaxed and len(x) == 1}
    return found | {(a, b): len(x & y) for a, x in nodes.items() for b, y in nodes.items() if a != b and x & y and len(x & y) >= min(need[a], need[b])}


@pytest.mark.parametrize("ncommon", [1, 2, 3])
@pytest.mark.parametrize("relaxed", [False, True])
def test_dual_graph_of_small_and_wide_elements(spark, monkeypatch, ncommon, relaxed):
    """Elements of one to nine nodes, those above four by the way of wide ones; repeated rows count once."""
    monkeypatch.setattr(mesh, "WIDE", 4)
    monkeypatch.setattr(mesh, "HOT", 6)
    rng = np.random.default_rng(7)
    inc = [(e, int(n)) for e in range(30) for n in rng.choice(14, 1 + e % 9, replace=False)]
    got = mesh.dual_graph(spark.createDataFrame([*inc, *inc[:9]], "elem long, node long"), ncommon, relaxed).collect()
    assert len(got) == len({(r["src"], r["dst"]) for r in got})
    assert {(r["src"], r["dst"]): r["wgt"] for r in got} == shared_nodes(inc, ncommon, relaxed)


def test_elements_that_share_one_node_do_not_meet(spark, monkeypatch):
    """A node of 300 elements makes 44,850 pairs; where two shared nodes are asked for, none of them is formed."""
    made = []
    counted = mesh._counted
    monkeypatch.setattr(mesh, "_counted", lambda pairs: made.append(pairs.count()) or counted(pairs))
    inc = [(e, n) for e in range(300) for n in (0, e + 1)] + [(300, 0), (300, 1), (300, 999)]
    found = {(r["src"], r["dst"]): r["wgt"] for r in mesh.dual_graph(spark.createDataFrame(inc, "elem long, node long"), 2, relaxed=False).collect()}
    assert found == {(0, 300): 2, (300, 0): 2} and sum(made) == 1


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(mesh, "MADE", 50)
    inc = spark.createDataFrame([(e, e % 4) for e in range(40)], "elem long, node long")
    pairs = mesh._pairs(inc, "node", "elem")
    assert pairs.count() == 4 * 45 and f"{4 * 100 // 50 + 1}), REPARTITION_BY_NUM" in pairs._jdf.queryExecution().toString()


def test_incidences_and_twos_are_dealt_by_their_number(spark, monkeypatch):
    """No map over a whole split or a coalesced partition holds incidences or twos; files are small, so that a split makes few twos."""
    plans, tables = {}, {}
    materialize = mesh.materialize

    def recorded(df, name="table", **options):
        plans[name] = df._jdf.queryExecution().toString()
        tables[name] = materialize(df, name, **options)
        return tables[name]

    monkeypatch.setattr(mesh, "materialize", recorded)
    monkeypatch.setattr(mesh, "SORTED", 50)
    monkeypatch.setattr(mesh, "FILED", 10)
    inc = [(e, n) for e in range(60) for n in (e, e + 1, e + 2)]
    found = {(r["src"], r["dst"]): r["wgt"] for r in mesh.dual_graph(spark.createDataFrame([*inc, *inc, (None, 1), (7, None)], "elem long, node long"), 2, relaxed=False).collect()}
    assert found == {(a, b): 2 for a in range(60) for b in (a - 1, a + 1) if 0 <= b < 60}
    for name, n in (("incidence", 2 * len(inc) + 2), ("twos", len(inc))):
        assert f"{n // 50 + 1}), REPARTITION_BY_NUM" in plans[name] and "HashAggregate" not in plans[name]
    assert len(tables["incidence"].inputFiles()) >= len(inc) // 10


def test_scratch_tables_go(spark):
    from meshloom.plans import scratch

    at = scratch.mark()
    one, two = scratch.materialize(spark.range(3)), scratch.materialize(spark.range(4))
    scratch.release(one)
    assert len(scratch._written) == at + 1 and two.count() == 4
    three = scratch.materialize(spark.range(5))
    scratch.clear_since(at, three)
    assert len(scratch._written) == at + 1 and three.count() == 5
