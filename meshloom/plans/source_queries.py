"""Queries that write a derived graph, matrix or vector in a file format and read it back; the SQL derives it anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import graphs
from meshloom.plans import fixtures as fx
from meshloom.plans.registry import register
from meshloom.plans.scratch import materialize, scratch_path
from meshloom.sources import graph_files, lines, matrix_files

#: Weights of the vertices of F3 in gapless ids.
NEW = f"""WITH {fx.DUAL}, v AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS id FROM (SELECT DISTINCT src FROM e)),
n AS (SELECT a.id AS src, b.id AS dst, e.wgt FROM e JOIN v a ON e.src = a.src JOIN v b ON e.dst = b.src)"""
MATRIX_SQL = f'WITH {fx.MATRIX} SELECT "row", col, val FROM m'


def _gapless(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F3 with ids from 0 in the order of ids, and its vertices with two weights and a size."""
    e = fx.kept_dual(spark, sf_dir)
    new = materialize(graphs.compact_ids(e), "ids")
    end = lambda c: new.select(F.col("id").alias(c), F.col("new").alias(f"_{c}"))
    edges = e.join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "wgt")
    id_ = F.col("new")
    return edges, new.select(id_.alias("id"), (id_ % 3 + 1).alias("vsize"), F.array(id_ % 5, F.lit(1).cast("long")).alias("vwgt"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(fx.matrix(spark, sf_dir).select("row", "col", F.col("val").cast("double").alias("val")), "matrix")


@register("source_graph_edges", f"{NEW} SELECT src, dst, CAST(wgt AS BIGINT) AS wgt FROM n")
def source_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = _gapless(spark, sf_dir)
    path = scratch_path(spark, "graph")
    graph_files.write_graph(edges, vertices, path)
    return graph_files.read_graph(spark, path)[0]


@register("source_graph_vertices", f"{NEW} SELECT id, id % 3 + 1 AS vsize, id % 5 AS w0, CAST(1 AS BIGINT) AS w1 FROM v")
def source_graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, vertices = _gapless(spark, sf_dir)
    path = scratch_path(spark, "graph")
    graph_files.write_graph(edges, vertices, path)
    return graph_files.read_graph(spark, path)[1].select("id", "vsize", F.get("vwgt", F.lit(0)).alias("w0"), F.get("vwgt", F.lit(1)).alias("w1"))


@register("source_csr", MATRIX_SQL)
def source_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csr")
    matrix_files.write_csr(_matrix(spark, sf_dir), path)
    return matrix_files.read_csr(spark, path)


@register("source_cluto", MATRIX_SQL)
def source_cluto(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cluto")
    matrix_files.write_cluto(_matrix(spark, sf_dir), path)
    return matrix_files.read_cluto(spark, path)


@register("source_ijv", MATRIX_SQL)
def source_ijv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ijv")
    matrix_files.write_ijv(_matrix(spark, sf_dir), path)
    return matrix_files.read_ijv(spark, path)


@register(
    "source_matrix_shape",
    f'WITH {fx.MATRIX} SELECT max("row") + 1 AS n_rows, max(col) + 1 AS n_columns, count(*) AS n_entries FROM m',
)
def source_matrix_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the header that the writer put before the rows."""
    path = scratch_path(spark, "shape") + ".clu"
    matrix_files.save(_matrix(spark, sf_dir), path)
    head = F.split(F.lit(lines.head(spark, path, "")), " ")
    return spark.range(1).select(*(F.get(head, F.lit(i)).cast("long").alias(n) for i, n in enumerate(("n_rows", "n_columns", "n_entries"))))


@register("source_partition", f"{NEW} SELECT id, CAST(id * 7 % 8 AS INT) AS pid FROM v")
def source_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vertices = _gapless(spark, sf_dir)
    part = vertices.select("id", (F.col("id") * 7 % 8).cast("int").alias("pid"))
    return graph_files.read_partition(spark, graph_files.write_partition(part, scratch_path(spark, "part"), 8), vertices.count())


@register("source_permutation", f"{NEW} SELECT id, (SELECT count(*) FROM v) - 1 - id AS pos FROM v")
def source_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vertices = _gapless(spark, sf_dir)
    order = vertices.select("id", (F.lit(vertices.count() - 1) - F.col("id")).alias("pos"))
    return graph_files.read_vector(spark, graph_files.write_permutation(order, scratch_path(spark, "order"))).withColumnRenamed("value", "pos")


@register(
    "source_mesh",
    f"""WITH {fx.INC}, k AS (SELECT DISTINCT elem FROM inc), d AS (SELECT elem, row_number() OVER (ORDER BY elem) - 1 AS nth FROM k)
    SELECT nth AS elem, row_number() OVER (PARTITION BY elem ORDER BY node) - 1 AS pos, node FROM inc JOIN d USING (elem)""",
)
def source_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line an order with its parts' ids, which start at 1 in the file."""
    nodes = F.array_sort(F.collect_set(F.col("node") + 1))
    rows = fx.incidence(spark, sf_dir).groupBy("elem").agg(F.array_join(nodes.cast("array<string>"), " ").alias("line"))
    path = scratch_path(spark, "mesh")
    lines.write_lines(rows, ["elem"], path, str(rows.count()))
    found = graph_files.read_mesh(spark, path)[0]
    return found.select("elem", F.col("pos").cast("long").alias("pos"), "node")
