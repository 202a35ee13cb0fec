"""Jobs from files to files: what a command line would call.

``python -m meshloom.plans.tools JOB ARGUMENT...`` runs one; each prints its report as JSON.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshloom.operators import analytics, graphs, mesh, metrics, partitioning, walks
from meshloom.operators.ordering import global_rank
from meshloom.plans.options import OrderOptions, PartitionOptions
from meshloom.sources import graph_files as files
from meshloom.sources import matrix_files as matrices


def _report(edges: DataFrame, part: DataFrame, vertices: DataFrame, k: int) -> dict:
    return metrics.report(metrics.with_parts(edges, part), part.join(vertices.select("id", "vwgt"), "id"), k).first().asDict()


def partition_graph(spark: SparkSession, path: str, k: int, out: str | None = None, targets: str | None = None, **options) -> dict:
    """Read a graph, partition it, write ``.part.k``, and report."""
    edges, vertices = files.read_graph(spark, path)
    ncon = vertices.agg(F.max(F.size("vwgt"))).first()[0] or 1
    if targets:
        shares = sorted(files.read_targets(spark, targets, k, ncon).collect(), key=lambda r: (r["pid"], r["con"]))
        options["tpwgts"] = tuple(tuple(r["tpwgt"] for r in shares if r["pid"] == p) for p in range(k))
    if options.get("objtype") == "vol":
        edges = partitioning.volume_weights(edges, vertices)
    part = partitioning.partition(edges, PartitionOptions(nparts=k, **options), vertices)
    return {"written": files.write_partition(part, out or path, k), **_report(edges, part, vertices, k)}


def partition_mesh(spark: SparkSession, path: str, k: int, out: str | None = None, by: str = "dual", ncommon: int = 1, **options) -> dict:
    """Read a mesh, partition elements and nodes, write both."""
    incidence, _ = files.read_mesh(spark, path)
    epart, npart = partitioning.partition_mesh(incidence, PartitionOptions(nparts=k, **options), by, ncommon)
    written = files.write_mesh_partition(epart, npart, out or path, k)
    return {"written": list(written), "balance": metrics.element_balance(epart, k).first()["balance"]}


def order_graph(spark: SparkSession, path: str, out: str | None = None, **options) -> dict:
    """Read a graph, order it by nested dissection, write ``.iperm``, and report the fill."""
    edges, vertices = files.read_graph(spark, path)
    order = partitioning.nested_dissection(edges, OrderOptions(**options), vertices)
    return {"written": files.write_permutation(order, out or path), **analytics.fill_in(edges, order).first().asDict()}


def mesh_to_graph(spark: SparkSession, path: str, out: str, kind: str = "dual", ncommon: int = 1) -> dict:
    """Read a mesh and write its dual or nodal graph."""
    incidence, _ = files.read_mesh(spark, path)
    rows = incidence.select("elem", "node").distinct()
    edges = mesh.dual_graph(rows, ncommon).where("src <> dst") if kind == "dual" else mesh.nodal_graph(rows)
    ids = rows.select(F.col("elem" if kind == "dual" else "node").alias("id"))
    n = ids.agg(F.max("id")).first()[0]
    files.write_graph(edges.withColumn("wgt", F.lit(1).cast("long")), spark.range((n if n is not None else -1) + 1), out)
    return {"written": out, "edges": edges.count() // 2}


def check_graph(spark: SparkSession, path: str, out: str | None = None) -> dict:
    """Count violations; with ``out``, write the repaired graph."""
    edges, vertices = files.read_graph(spark, path)
    found = {r["violation"]: r["n"] for r in graphs.check(edges).collect()}
    if out:
        files.write_graph(graphs.fix(edges), vertices, out)
    return found


def compare_fill(spark: SparkSession, path: str, iperm: str) -> dict:
    """The fill of an order from a file."""
    edges, _ = files.read_graph(spark, path)
    order = files.read_vector(spark, iperm).withColumnRenamed("value", "pos")
    return analytics.fill_in(edges, order).first().asDict()


def frequent_itemsets(spark: SparkSession, path: str, out: str, least: int, most: int = -1, min_len: int = 1, max_len: int = -1) -> dict:
    """Frequent itemsets of a matrix file's rows."""
    rows = matrices.load(spark, path).select(F.col("row").alias("tid"), F.col("col").alias("item"))
    found = analytics.itemsets(rows, least, most, min_len, max_len)
    found.select(F.concat_ws(" ", F.col("support").cast("string"), F.array_join("items", " ")).alias("value")).write.mode("overwrite").text(out)
    return {"written": out, "itemsets": found.count()}


def rank_pages(spark: SparkSession, path: str, out: str, walk: float = 0.85, rounds: int = 100, eps: float = 1e-10, source: int = -1, vectors: int = -1) -> dict:
    """PageRank of a graph file: ``id, pr, degree, difference, at``, the last two for the neighbour whose rank is farthest off.

    ``source``: restart at that vertex alone, ``id, pr``.  ``vectors``: so many hashed restart vectors at once, ``walk, id, pr, rounds``.
    """
    edges, vertices = files.read_graph(spark, path)
    if vectors > 0 or source >= 0:
        if vectors > 0:
            restarts = walks.restart_vectors(vertices, vectors)
        else:
            restarts = vertices.where(F.col("id") == source).select(F.lit(0).alias("walk"), "id", F.lit(1.0).alias("r"))
        ranks = walks.pagerank_batch(edges, restarts, walk, rounds, eps)
        taken = {r["walk"]: r["rounds"] for r in ranks.groupBy("walk").agg(F.max("rounds").alias("rounds")).collect()}  # a row a vector
        ranks = ranks.orderBy("walk", "id") if vectors > 0 else ranks.select("id", "pr").orderBy("id")
        ranks.write.mode("overwrite").csv(out)
        return {"written": out, "rounds": taken}
    ranks = analytics.pagerank(edges, walk, rounds, eps=eps)
    walks.largest_differences(edges, ranks).orderBy("id").write.mode("overwrite").csv(out)
    return {"written": out, "total": round(ranks.agg(F.sum("pr")).first()[0] or 0.0, 6)}


def reorder_graph(spark: SparkSession, path: str, out: str, by: str = "bfs") -> dict:
    """Renumber a graph breadth-first or by centroids, and report the compactness before and after."""
    edges, vertices = files.read_graph(spark, path)
    ids = global_rank(vertices.select("id"), ["id"], "pos")
    order = analytics.bfs_order(edges, vertices.agg(F.min("id").alias("id"))) if by == "bfs" else analytics.centroid_order(edges, ids)
    files.write_graph(graphs.reorder(edges, order), vertices.select("id"), out)
    value = lambda p: analytics.compactness(edges, p).first()["compactness"]
    return {"written": out, "before": value(ids), "after": value(order)}


def convert_matrix(spark: SparkSession, path: str, out: str) -> dict:
    """From one matrix format to another, by extensions."""
    m = matrices.load(spark, path)
    matrices.save(m, out)
    return {"written": out, "entries": m.count()}


JOBS = {
    "partition-graph": partition_graph, "partition-mesh": partition_mesh, "order-graph": order_graph, "mesh-to-graph": mesh_to_graph, "check-graph": check_graph,
    "compare-fill": compare_fill, "itemsets": frequent_itemsets, "pagerank": rank_pages, "reorder": reorder_graph, "convert": convert_matrix,
}


def main(args: list[str]) -> None:
    """``JOB ARGUMENT... NAME=VALUE...``; whole numbers and decimals are read as such."""
    if not args or args[0] not in JOBS:
        sys.exit(f"{main.__doc__}\nJobs: {', '.join(JOBS)}")

    def value(text: str):
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
        return text

    given = [value(a) for a in args[1:] if "=" not in a]
    named = {k: value(v) for k, v in (a.split("=", 1) for a in args[1:] if "=" in a)}
    print(json.dumps(JOBS[args[0]](SparkSession.builder.getOrCreate(), *given, **named)))


if __name__ == "__main__":
    main(sys.argv[1:])
