"""Queries and operators do the whole job, where the smallest tables cannot show it."""

from collections import Counter
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshloom.operators import analytics, graphs, metrics, partitioning
from meshloom.plans import catalogue
from meshloom.plans.options import PartitionOptions


def lines(tmp_path, pairs):
    """A folder with a lineitem table of these orders and parts."""
    pd.DataFrame(pairs, columns=["l_orderkey", "l_partkey"]).to_parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_mesh_partition_takes_every_element(spark, tmp_path):
    pairs = [(e, (e + i) % 60) for e in [*range(40), *range(3980, 4040)] for i in range(3)]
    row = catalogue.queries()["mesh_partition"](spark, lines(tmp_path, pairs)).first()
    assert (row["n_elements"], row["n_nodes"], row["in_range"]) == (100, 60, True)


def test_itemsets_keeps_items_of_small_support(spark, tmp_path):
    """Items 1 to 4 have supports of 3 to 11; all sets are counted by brute force."""
    baskets = [{1, 2, 3} if t < 3 else {2, 3, 4} if t < 7 else {4, 5 + t % 2} if t < 11 else {5, 6, 7 + t % 9} for t in range(40)]
    want = Counter(",".join(map(str, c)) for b in baskets for n in (1, 2, 3) for c in combinations(sorted(b), n))
    found = catalogue.queries()["itemsets_1_2_3"](spark, lines(tmp_path, [(t, i) for t, b in enumerate(baskets) for i in b]))
    assert {r["items"]: r["support"] for r in found.collect()} == {s: n for s, n in want.items() if n >= 3}


def weighted(spark, n=120):
    """Vertices with two constraints that lie apart: ones, and a weight that only the last third has."""
    return spark.createDataFrame([(i, [1, 6 if i >= 80 else 0]) for i in range(n)], "id long, vwgt array<long>")


@pytest.fixture(scope="module")
def grid(spark):
    """12 by 10 vertices."""
    pairs = [(r * 10 + c, r * 10 + c + d) for r in range(12) for c in range(10) for d in (1, 10) if (d == 10 or c < 9) and r * 10 + c + d < 120]
    return spark.createDataFrame([(a, b, 1) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long, wgt long")


def test_refinement_empties_overweight_parts_in_every_constraint(spark, grid):
    options, heavy = PartitionOptions(nparts=3, ufactor=100), graphs.vertices_of(grid)
    part = partitioning.refine_partition(grid, heavy.withColumn("pid", F.lit(0)), options)
    assert part.groupBy("pid").count().agg(F.max("count")).first()[0] <= 44
    thirds = heavy.withColumn("pid", F.floor(F.col("id") / 40).cast("int"))  # part 2 has all of the second weight
    part = partitioning.refine_partition(grid, thirds, PartitionOptions(nparts=3, ubvec=(1.2, 1.2)), weighted(spark))
    assert metrics.balance(part.join(weighted(spark), "id"), 3).agg(F.max("balance")).first()[0] <= 1.2


def test_distributed_volume_has_no_gain_left(grid):
    part = partitioning.partition(grid, PartitionOptions(nparts=3, objtype="vol", ufactor=300, kernel_size=100))
    load = {r["pid"]: r["count"] for r in part.groupBy("pid").count().collect()}
    left = metrics.volume_gains(metrics.with_parts(grid, part)).where("gain > 0").collect()
    assert sum(load.values()) == 120 and [r for r in left if load[r["to"]] + 1 <= 52] == []


def test_distributed_parts_are_whole(spark, grid):
    part = partitioning.whole_parts(grid, weighted(spark), graphs.vertices_of(grid).withColumn("pid", F.pmod("id", F.lit(4)).cast("int")))
    assert analytics.contiguity(metrics.with_parts(grid, part)).agg(F.max("pieces")).first()[0] == 1
