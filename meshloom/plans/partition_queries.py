"""Queries that build partitions, separators and orders: a row of invariants each, with the same row as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import dissection, graphs, metrics, partitioning, repartition
from meshloom.plans import fixtures as fx
from meshloom.plans.options import OrderOptions, PartitionOptions
from meshloom.plans.registry import register
from meshloom.plans.scratch import materialize

D = f"WITH {fx.DUAL}, v AS (SELECT DISTINCT src AS id FROM e)"
INVARIANTS = "count(*) AS n_vertices, CAST(8 AS BIGINT) AS n_parts, true AS in_range, true AS once, true AS balanced, true AS beats_hash"


def _invariants(edges: DataFrame, part: DataFrame, k: int, ub: float) -> DataFrame:
    """Whether every vertex has one part in range, loads are within bounds, and the cut beats a hashed partition."""
    cut = metrics.edge_cut(metrics.with_parts(edges, part)).withColumnRenamed("edge_cut", "ours")
    hashed = metrics.edge_cut(edges.withColumns({"ps": fx.part_of("src", k), "pd": fx.part_of("dst", k)}))
    counts = part.groupBy("pid").agg(F.count("*").alias("n"))
    facts = counts.agg(
        F.sum("n").alias("n_vertices"), F.count("*").alias("n_parts"), ((F.min("pid") >= 0) & (F.max("pid") < k)).alias("in_range"),
        (k * F.max("n") <= ub * F.sum("n") + k).alias("balanced"),
    )
    once = part.agg((F.count("*") == F.count_distinct("id")).alias("once"))
    met = facts.join(F.broadcast(once)).join(F.broadcast(cut)).join(F.broadcast(hashed))  # one row each
    return met.select("n_vertices", "n_parts", "in_range", "once", "balanced", (F.col("ours") <= F.col("edge_cut")).alias("beats_hash"))


@register("partition_kway", f"{D} SELECT {INVARIANTS} FROM v")
def partition_kway(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return _invariants(e, partitioning.partition(e, PartitionOptions(nparts=8)), 8, 1.03)


@register("partition_kway_distributed", f"{D} SELECT {INVARIANTS} FROM v")
def partition_kway_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed way, which larger graphs take."""
    e = fx.kept_dual(spark, sf_dir)
    return _invariants(e, partitioning.partition(e, PartitionOptions(nparts=8, kernel_size=2500)), 8, 1.03)


@register("partition_geometric", f"{D} SELECT {INVARIANTS} FROM v")
def partition_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed way with a first level of groups along a curve through the orders' least and greatest parts."""
    e = fx.kept_dual(spark, sf_dir)
    ends = [f("node").cast("double") for f in (F.min, F.max)]
    points = fx.incidence(spark, sf_dir).groupBy(F.col("elem").alias("id")).agg(F.array(*ends).alias("xyz"))
    points = points.join(graphs.vertices_of(e), "id", "left_semi")
    return _invariants(e, partitioning.geometric_kway(e, points, PartitionOptions(nparts=8, kernel_size=2500), dims=2), 8, 1.03)


@register("partition_rb", f"{D} SELECT {INVARIANTS} FROM v")
def partition_rb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return _invariants(e, partitioning.partition(e, PartitionOptions(nparts=8, ptype="rb", ufactor=30)), 8, 1.10)


@register("partition_volume", f"{D} SELECT {INVARIANTS} FROM v")
def partition_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return _invariants(e, partitioning.partition(e, PartitionOptions(nparts=8, objtype="vol")), 8, 1.03)


@register(
    "mesh_partition",
    f"WITH {fx.INC} SELECT count(DISTINCT elem) AS n_elements, count(DISTINCT node) AS n_nodes, true AS in_range FROM inc",
)
def mesh_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodal way over the whole mesh."""
    epart, npart = partitioning.partition_mesh(fx.incidence(spark, sf_dir), PartitionOptions(nparts=4), by="nodal")
    both = epart.withColumn("kind", F.lit("e")).union(npart.withColumn("kind", F.lit("n")))
    return both.agg(
        F.count_distinct(F.when(F.col("kind") == "e", F.col("id"))).alias("n_elements"), F.count_distinct(F.when(F.col("kind") == "n", F.col("id"))).alias("n_nodes"),
        ((F.min("pid") >= 0) & (F.max("pid") < 4)).alias("in_range"),
    )


@register(
    "induced_elements",
    f"""WITH {fx.INC}, a AS (SELECT elem, count(DISTINCT node % 8) AS parts, min(node % 8) AS pid FROM inc GROUP BY 1)
    SELECT count(*) AS n_rows, count(*) FILTER (parts = 1) AS sure, CAST(0 AS BIGINT) AS sure_elsewhere, true AS within_bound FROM a""",
)
def induced_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements take the parts of their nodes, within the room of the parts."""
    inc = materialize(fx.incidence(spark, sf_dir), "incidence")
    nodes = inc.select(F.col("node").alias("id")).distinct().withColumn("pid", fx.part_of("id", 8))
    found = partitioning.induce(inc.select(F.col("elem").alias("id"), F.col("node").alias("via")), nodes, 8)
    sure = inc.groupBy(F.col("elem").alias("id")).agg(F.count_distinct(fx.part_of("node", 8)).alias("parts"), F.min(fx.part_of("node", 8)).alias("only"))
    load = found.groupBy("pid").agg(F.count("*").alias("n")).agg((8 * F.max("n") <= 1.03 * F.sum("n") + 8).alias("within_bound"))
    facts = found.join(sure, "id").agg(
        F.count("*").alias("n_rows"), F.sum((F.col("parts") == 1).cast("long")).alias("sure"),
        F.sum(((F.col("parts") == 1) & (F.col("pid") != F.col("only"))).cast("long")).alias("sure_elsewhere"),
    )
    return facts.join(F.broadcast(load))  # one row


@register("node_nd", f"{D} SELECT count(*) AS n_vertices, true AS permutation FROM v")
def node_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = partitioning.nested_dissection(fx.kept_dual(spark, sf_dir), OrderOptions())
    whole = (F.count("*") == F.count_distinct("pos")) & (F.min("pos") == 0) & (F.max("pos") == F.count("*") - 1) & (F.count("*") == F.count_distinct("id"))
    return order.agg(F.count("*").alias("n_vertices"), whole.alias("permutation"))


@register("fill_in", f"{D} SELECT count(*) AS n_vertices, true AS holds_edges, true AS beats_ids FROM v")
def fill_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of a dissection order against that of the order of ids."""
    from meshloom.operators import analytics
    from meshloom.operators.ordering import global_rank

    e = fx.kept_dual(spark, sf_dir)
    ours = analytics.fill_in(e, partitioning.nested_dissection(e, OrderOptions()))
    ids = analytics.fill_in(e, global_rank(graphs.vertices_of(e), ["id"], "pos")).select(F.col("nnz").alias("by_id"))
    size = e.agg((F.count("*") / 2).alias("m")).join(F.broadcast(graphs.vertices_of(e).agg(F.count("*").alias("n"))))
    met = ours.join(F.broadcast(ids)).join(F.broadcast(size))  # one row each
    return met.select(F.col("n").alias("n_vertices"), (F.col("nnz") >= F.col("n") + F.col("m")).alias("holds_edges"), (F.col("nnz") <= F.col("by_id")).alias("beats_ids"))


@register("vertex_separator", f"{D} SELECT count(*) AS n_vertices, CAST(0 AS BIGINT) AS violations, true AS light FROM v")
def vertex_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    part = partitioning.vertex_separator(e)
    bad = metrics.separator_violations(metrics.with_parts(e, part))
    facts = part.agg(F.count("*").alias("n_vertices"), (F.sum((F.col("pid") == 2).cast("long")) * 4 < F.count("*")).alias("light"))
    return facts.join(F.broadcast(bad)).select("n_vertices", "violations", "light")  # one row


SUMS = "(SELECT CAST(sum(wgt) / 2 AS BIGINT) FROM e) AS total_weight"


@register(
    "adaptive_repart",
    f"{D} SELECT count(*) AS n_vertices, count(*) AS total_size, {SUMS}, true AS balanced, true AS dear_cut_no_higher, true AS dear_moves_no_more, true AS beats_home FROM v",
)
def adaptive_repart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice: where a unit of cut costs a thousand times what it costs to move a vertex, and a thousandth of it."""
    e = fx.kept_dual(spark, sf_dir)
    home = graphs.vertices_of(e).select("id", fx.part_of("id", 8).alias("pid"))
    stay = repartition.Stay(home.select("id", F.col("pid").alias("home"), F.lit(1).cast("long").alias("vsize")))
    dear, cheap = (repartition.adaptive_repartition(e, home, PartitionOptions(nparts=8), ipc) for ipc in (1000.0, 0.001))
    held = dear.groupBy("pid").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_vertices"), (8 * F.max("n") <= 1.03 * F.sum("n") + 8).alias("balanced"))
    named = lambda part, by: repartition.costs(e, part, stay).select(*(F.col(c).alias(f"{c}_{by}") for c in ("cut", "inner", "moved", "stayed")))
    met = held.join(F.broadcast(named(dear, "dear"))).join(F.broadcast(named(cheap, "cheap"))).join(F.broadcast(named(home, "home")))  # one row each
    return met.select(
        "n_vertices", (F.col("moved_dear") + F.col("stayed_dear")).alias("total_size"), (F.col("cut_dear") + F.col("inner_dear")).alias("total_weight"), "balanced",
        (F.col("cut_dear") <= F.col("cut_cheap")).alias("dear_cut_no_higher"), (F.col("moved_cheap") <= F.col("moved_dear")).alias("dear_moves_no_more"),
        (F.col("cut_dear") < F.col("cut_home")).alias("beats_home"),
    )


LEANING = "least(id % 16, 7)"  # nine sixteenths of the vertices in part 7


@register(
    "diffusion_repart",
    f"""{D}, h AS (SELECT {LEANING} AS pid, count(*) AS n FROM v GROUP BY 1)
    SELECT (SELECT count(*) FROM v) AS n_vertices, CAST(8 AS BIGINT) AS n_parts, max(n) AS heaviest_before, true AS within_bound, true AS moves_the_excess,
           true AS moves_little_more, {SUMS} FROM h""",
)
def diffusion_repart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of very unequal loads, levelled along flows and refined; what leaves home is the excess and what passes through other parts."""
    e = fx.kept_dual(spark, sf_dir)
    home = graphs.vertices_of(e).select("id", F.least(F.pmod("id", F.lit(16)), F.lit(7)).cast("int").alias("pid"))
    options = PartitionOptions(nparts=8).checked()
    vertices = partitioning.with_weights(e, home.select("id"))
    stay = repartition.Stay(home.select("id", F.col("pid").alias("home"), F.lit(1).cast("long").alias("vsize")))
    part = repartition.refine_from_home(e, vertices, repartition.diffuse(e, vertices, home, options), stay, options)
    count = lambda p: p.groupBy("pid").agg(F.count("*").alias("n"))
    after = count(part).agg(F.sum("n").alias("n_vertices"), F.count("*").alias("n_parts"), F.max("n").alias("most"))
    before = count(home).agg(F.max("n").alias("heaviest_before"))
    met = after.join(F.broadcast(before)).join(F.broadcast(repartition.costs(e, part, stay)))  # one row each
    fair = F.col("n_vertices") / 8
    excess = F.col("heaviest_before") - 1.03 * fair
    return met.select(
        "n_vertices", "n_parts", "heaviest_before", (F.col("most") <= 1.03 * fair + 1e-6).alias("within_bound"), (F.col("moved") >= excess).alias("moves_the_excess"),
        (F.col("moved") <= 2 * F.col("heaviest_before")).alias("moves_little_more"), (F.col("cut") + F.col("inner")).alias("total_weight"),
    )


@register("matching", f"{D} SELECT count(*) AS n_vertices, true AS pairs, true AS edges, true AS shrinks FROM v")
def matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handshake matching: groups of two at most, joined by an edge, and many of them."""
    e = fx.kept_dual(spark, sf_dir)
    cmap = graphs.match(e, graphs.vertices_of(e).withColumn("vwgt", F.lit(1)), 2.0, seed=3)
    sizes = cmap.groupBy("cid").agg(F.count("*").alias("n"))
    facts = sizes.agg(F.sum("n").alias("n_vertices"), (F.max("n") <= 2).alias("pairs"), (F.count("*") <= 0.75 * F.sum("n")).alias("shrinks"))
    apart = cmap.where("id <> cid").join(e, (F.col("id") == F.col("src")) & (F.col("cid") == F.col("dst")), "left_anti").agg((F.count("*") == 0).alias("edges"))
    return facts.join(F.broadcast(apart)).select("n_vertices", "pairs", "edges", "shrinks")  # one row


@register(
    "remap",
    "SELECT count(*) AS n_vertices, true AS in_range, true AS saves FROM orders",
)
def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").select(
        key.alias("id"), fx.part_of(key, 8).alias("home"), fx.part_of(key + 3, 8).alias("pid"), F.lit(1).cast("long").alias("vsize")
    )
    new = partitioning.remap(rows, 8)
    met = new.join(rows.select("id", "home", F.col("pid").alias("old")), "id")
    moved = lambda c: F.sum((F.col("home") != F.col(c)).cast("long"))
    return met.agg(F.count("*").alias("n_vertices"), ((F.min("pid") >= 0) & (F.max("pid") < 8)).alias("in_range"), (moved("pid") <= moved("old")).alias("saves"))


@register("fragments", f"{D} SELECT count(*) AS n_vertices, true AS fewer FROM v")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of parts join their neighbours, so parts have fewer pieces."""
    from meshloom.operators import analytics

    placed = fx.placed_dual(spark, sf_dir, keep=True)
    e = placed.select("src", "dst", "wgt")
    new = analytics.eliminate_fragments(placed, graphs.vertices_of(e).withColumn("vwgt", F.lit(1)))
    pieces = lambda p: analytics.contiguity(p).agg(F.sum("pieces").alias("n"))
    after = pieces(metrics.with_parts(e, new)).withColumnRenamed("n", "after")
    met = new.agg(F.count("*").alias("n_vertices")).join(F.broadcast(pieces(placed))).join(F.broadcast(after))  # one row each
    return met.select("n_vertices", (F.col("after") <= F.col("n")).alias("fewer"))


@register(
    "separator_refine",
    f"""WITH {fx.HALVES}, v AS (SELECT DISTINCT src AS id FROM e), s AS (SELECT src AS id, max(CASE WHEN ps <> pd THEN 1 ELSE 0 END) AS c FROM p GROUP BY 1)
    SELECT (SELECT count(*) FROM v) AS n_vertices, CAST(0 AS BIGINT) AS violations, CAST(sum(c) AS BIGINT) AS weight_before, true AS lighter, true AS within_bound FROM s""",
)
def separator_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the separator that two hashed halves ask for, in rounds over the whole graph."""
    e = fx.kept_dual(spark, sf_dir)
    start = metrics.separator_from_cut(e.withColumns({"ps": fx.part_of("src", 2), "pd": fx.part_of("dst", 2)}))
    rows = dissection.rows_of(partitioning.with_weights(e, None))
    part = dissection.refine_separators(e, rows, start, ub=1.2)
    count = lambda p, name: p.agg(F.sum((F.col("pid") == 2).cast("long")).alias(name))
    bad = metrics.separator_violations(metrics.with_parts(e, part))
    sides = part.agg(F.count("*").alias("n_vertices"), *(F.sum((F.col("pid") == p).cast("long")).alias(f"n{p}") for p in (0, 1)))
    met = sides.join(F.broadcast(bad)).join(F.broadcast(count(start, "weight_before"))).join(F.broadcast(count(part, "after")))  # one row each
    return met.select(
        "n_vertices", "violations", "weight_before", (2 * F.col("after") < F.col("weight_before")).alias("lighter"),
        (2 * F.greatest("n0", "n1") <= 1.2 * F.col("n_vertices")).alias("within_bound"),
    )


@register("vertex_separator_rounds", f"{D} SELECT count(*) AS n_vertices, CAST(0 AS BIGINT) AS violations, true AS light, true AS within_bound FROM v")
def vertex_separator_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarsened and refined in distributed rounds; a task sees 1,500 vertices at most."""
    e = fx.kept_dual(spark, sf_dir)
    part = dissection.vertex_separator_in_rounds(e, limit=1500)
    bad = metrics.separator_violations(metrics.with_parts(e, part))
    facts = part.agg(F.count("*").alias("n_vertices"), *(F.sum((F.col("pid") == p).cast("long")).alias(f"n{p}") for p in (0, 1, 2)))
    met = facts.join(F.broadcast(bad))  # one row
    return met.select("n_vertices", "violations", (10 * F.col("n2") < F.col("n_vertices")).alias("light"), (2 * F.greatest("n0", "n1") <= 1.25 * F.col("n_vertices")).alias("within_bound"))


@register(
    "node_nd_levels",
    f"{D} SELECT count(*) AS n_vertices, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS sum_of_positions, CAST(count(*) - 1 AS BIGINT) AS last_position, CAST(0 AS BIGINT) AS sibling_edges FROM v",
)
def node_nd_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels, four leaves: positions are a permutation, and no edge joins two subgraphs that a separator parts."""
    e = fx.kept_dual(spark, sf_dir)
    found = dissection.dissect(e, levels=2)
    facts = found.order.agg(F.count_distinct("id").alias("n_vertices"), F.sum("pos").alias("sum_of_positions"), F.max("pos").alias("last_position"))
    return facts.join(F.broadcast(dissection.sibling_edges(e, found.order).withColumnRenamed("edges", "sibling_edges")))  # one row


@register(
    "separator_sizes",
    f"{D} SELECT CAST(7 AS BIGINT) AS n_nodes, count(*) AS n_vertices, CAST(21 AS BIGINT) AS sum_of_places, true AS last_is_whole, true AS gapless FROM v",
)
def separator_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of four leaves and three separators add up to all vertices, and each node's labels are one gapless run."""
    found = dissection.dissect(fx.kept_dual(spark, sf_dir), levels=2)
    runs = found.order.groupBy("node").agg((F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("run")).agg(F.min("run").alias("gapless"))
    whole = F.max(F.when(F.col("nth") == 6, F.col("node"))) == 1
    facts = found.sizes.agg(F.count("*").alias("n_nodes"), F.sum("size").alias("n_vertices"), F.sum("nth").alias("sum_of_places"), whole.alias("last_is_whole"))
    return facts.join(F.broadcast(runs))  # one row
