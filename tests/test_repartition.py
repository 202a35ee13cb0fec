"""Diffusion between parts and refinement that weighs moves from home, on a grid of 12 by 10 vertices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import graphs, matrix, metrics, repartition
from meshloom.operators.ordering import sum_within
from meshloom.operators.partitioning import coarsen, with_weights
from meshloom.plans.options import PartitionOptions


@pytest.fixture(scope="module")
def grid(spark):
    pairs = [(r * 10 + c, r * 10 + c + d) for r in range(12) for c in range(10) for d in (1, 10) if (d == 10 or c < 9) and r * 10 + c + d < 120]
    return spark.createDataFrame([(a, b, 1) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long, wgt long").cache()


def rows_as_parts(grid, bounds):
    """Part ``p`` has the rows of the grid from ``bounds[p]`` on."""
    pid = F.lit(0)
    for p, first in enumerate(bounds):
        pid = F.when(F.col("id") >= first * 10, p).otherwise(pid)
    return graphs.vertices_of(grid).select("id", pid.cast("int").alias("pid"))


def test_sums_within_keys(spark):
    rng = np.random.default_rng(3)
    data = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 9, 200), strict=True))]
    got = {r["id"]: r["upto"] for r in sum_within(spark.createDataFrame(data, "k int, v long, id long"), ["k"], "v", [F.desc("v"), F.col("id")], "upto").collect()}
    for k in range(3):
        total = 0
        for _, v, i in sorted((r for r in data if r[0] == k), key=lambda r: (-r[1], r[2])):
            total += v
            assert got[i] == total


def test_flow_takes_the_excess_away(spark, grid):
    part = rows_as_parts(grid, [0, 8, 10, 11])
    excess = {0: 50.0, 1: -10.0, 2: -20.0, 3: -20.0}
    rows = spark.createDataFrame(list(excess.items()), "pid int, excess double")
    net = dict.fromkeys(excess, 0.0)
    for r in repartition.flow(metrics.with_parts(grid, part), rows).collect():
        assert abs(r["ps"] - r["pd"]) == 1 and r["quota"] > 0
        net[r["ps"]] += r["quota"]
        net[r["pd"]] -= r["quota"]
    assert all(abs(net[p] - excess[p]) < 1e-6 for p in excess)


def test_flow_between_parts_that_no_path_joins(spark):
    """Parts 0 and 1 touch, 2 and 3 too; no weight can pass from one pair to the other."""
    pairs = [(0, 1), (1, 2), (10, 11), (11, 12)]
    edges = spark.createDataFrame([(a, b, 1) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long, wgt long")
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (10, 2), (11, 3), (12, 3)], "id long, pid int")
    excess = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, -4.0), (3, -2.0)], "pid int, excess double")
    got = {(r["ps"], r["pd"]): round(r["quota"], 6) for r in repartition.flow(metrics.with_parts(edges, part), excess).collect()}
    assert got == {(0, 1): 2.0, (3, 2): 1.0}


def test_moved_weight_follows_the_flow(grid):
    part = rows_as_parts(grid, [0, 8])
    weights = graphs.vertices_of(grid).withColumn("vwgt", F.lit(1).cast("long"))
    quota = part.sparkSession.createDataFrame([(0, 1, 20.0)], "ps int, pd int, quota double")
    sent = 0
    for _ in range(9):
        new, left = repartition.flow_round(grid, weights, part, quota)
        if new is part:
            break
        away = new.withColumnRenamed("pid", "now").join(part, "id").where("now <> pid")
        assert {(r["pid"], r["now"]) for r in away.collect()} == {(0, 1)}
        sent, part, quota = sent + away.count(), new, left
    assert sent == 20 and quota.isEmpty()


@pytest.mark.parametrize(("factor", "bounds"), [(1.0, [0, 12, 12, 12]), (0.75, [0, 8, 10, 11])])  # the first leaves three parts empty
def test_diffusion_levels_loads(grid, factor, bounds):
    options = PartitionOptions(nparts=4, ufactor=50).checked()
    vertices = with_weights(grid, None)
    part = repartition.diffuse(grid, vertices, rows_as_parts(grid, bounds), options, factor, solves=16)
    counts = {r["pid"]: r["count"] for r in part.groupBy("pid").count().collect()}
    assert sum(counts.values()) == 120 and len(counts) == 4 and max(counts.values()) <= 31.5


def test_diffusion_refuses(grid):
    options = PartitionOptions(nparts=2, ubvec=(1.1, 1.1)).checked(2)
    with pytest.raises(ValueError):
        repartition.diffuse(grid, with_weights(grid, None), rows_as_parts(grid, [0, 6]), options)
    with pytest.raises(ValueError):
        repartition.diffuse(grid, with_weights(grid, None), rows_as_parts(grid, [0, 6]), PartitionOptions().checked(), factor=0)


def test_costs_add_up(grid):
    home = rows_as_parts(grid, [0, 6])
    sizes = home.select("id", F.col("pid").alias("home"), (F.col("id") % 3).alias("vsize"))
    part = rows_as_parts(grid, [0, 5])
    row = repartition.costs(grid, part, repartition.Stay(sizes, 2.0, 3.0)).first()
    moved = sum(i % 3 for i in range(50, 60))
    assert (row["cut"], row["inner"], row["moved"], row["stayed"]) == (10, 218 - 10, moved, sum(i % 3 for i in range(120)) - moved)
    assert row["cost"] == 2 * 10 + 3 * moved


def test_refinement_weighs_homes(grid):
    """Half of the vertices of a row lie in the wrong part: going back pays, unless their homes are there and moving is dear."""
    options = PartitionOptions(nparts=2, ufactor=200).checked()
    home = graphs.vertices_of(grid).select("id", F.when((F.col("id") >= 60) | (F.col("id").between(30, 34)), 1).otherwise(0).alias("pid"))
    vertices = with_weights(grid, None)
    stay = home.select("id", F.col("pid").alias("home"), F.lit(1).alias("vsize"))
    dear = repartition.refine_from_home(grid, vertices, home, repartition.Stay(stay, 1.0, 100.0), options)
    assert repartition.costs(grid, dear, repartition.Stay(stay)).first()["moved"] == 0
    free = repartition.refine_from_home(grid, vertices, home, repartition.Stay(stay, 1.0, 0.0), options)
    cut = lambda p: metrics.edge_cut(metrics.with_parts(grid, p)).first()[0]
    assert cut(free) < cut(home)


def test_coarsening_keeps_to_homes(grid):
    home = rows_as_parts(grid, [0, 3, 7])
    levels = coarsen(grid, with_weights(grid, None), 20, 5, home=home)
    part, sizes = home, []
    for _, vertices, cmap in levels:
        sizes.append(vertices.count())
        if cmap is not None:
            assert cmap.join(part, "id").groupBy("cid").agg(F.count_distinct("pid").alias("n")).agg(F.max("n")).first()[0] == 1
            part = cmap.join(part, "id").groupBy(F.col("cid").alias("id")).agg(F.min("pid").alias("pid"))
    assert len(sizes) > 2 and sizes[-1] < 60


def test_adaptive_in_levels(grid):
    """Coarsened within homes: the price of the cut decides how much moves."""
    home = graphs.vertices_of(grid).select("id", F.pmod("id", F.lit(3)).cast("int").alias("pid"))
    options = PartitionOptions(nparts=3, ufactor=100, kernel_size=100)
    stay = repartition.Stay(home.select("id", F.col("pid").alias("home"), F.lit(1).alias("vsize")))
    found = [repartition.costs(grid, repartition.adaptive_repartition(grid, home, options, ipc), stay).first() for ipc in (100.0, 0.001)]
    assert found[0]["cut"] < found[1]["cut"] and found[1]["moved"] == 0 < found[0]["moved"]
    assert all(r["moved"] + r["stayed"] == 120 and r["cut"] + r["inner"] == 218 for r in found)


def test_a_system_that_does_not_settle_is_an_error(spark):
    m = spark.createDataFrame([(i, i, 2.0 + i) for i in range(9)] + [(i, i + 1, -1.0) for i in range(8)] + [(i + 1, i, -1.0) for i in range(8)], "row long, col long, val double")
    b = spark.range(9).select("id", F.lit(1.0).alias("b"))
    with pytest.raises(ArithmeticError):
        matrix.conjugate_gradient(m, b, 1e-12, most=2)
