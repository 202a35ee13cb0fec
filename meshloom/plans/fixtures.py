"""Graphs, meshes and matrices derived from the driver's relational tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.operators import mesh
from meshloom.plans.scratch import materialize

CUSTOMER_SHIFT = 0
SUPPLIER_SHIFT = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repeated_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with a row for each line, for operators that count repeated rows once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"))


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as elements, their parts as nodes."""
    return repeated_incidence(spark, sf_dir).distinct()


def nodal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts that share an order."""
    return mesh.nodal_graph(incidence(spark, sf_dir))


def strict_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders that share two parts or more, both directions."""
    return mesh.dual_graph(repeated_incidence(spark, sf_dir), ncommon=2, relaxed=False)


def kept_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 written once, for queries that read it several times."""
    return materialize(strict_dual(spark, sf_dir), "dual")


def part_of(vertex: str | Column, k: int) -> Column:
    """the deterministic part of a vertex."""
    return F.pmod(F.col(vertex) if isinstance(vertex, str) else vertex, F.lit(k)).cast("int")


def placed_dual(spark: SparkSession, sf_dir: str, k: int = 8, keep: bool = False) -> DataFrame:
    """F3 with F9: the part is a function of the id, so no join is needed.  With ``keep``, F3 is written once."""
    edges = kept_dual(spark, sf_dir) if keep else strict_dual(spark, sf_dir)
    return edges.withColumns({"ps": part_of("src", k), "pd": part_of("dst", k)})


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers and the suppliers of their orders, both directions, supplier ids shifted."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("cust"), (F.col("l_suppkey") + SUPPLIER_SHIFT).alias("supp")
    ).distinct()
    ends = F.array(F.struct(F.col("cust").alias("src"), F.col("supp").alias("dst")), F.struct(F.col("supp").alias("src"), F.col("cust").alias("dst")))
    return pairs.select(F.explode(ends).alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("wgt"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quantities by customer and part."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


def points(spark: SparkSession, sf_dir: str, dims: int = 3) -> DataFrame:
    """the first dimensions of the vectors."""
    xyz = F.transform(F.slice("embedding", 1, dims), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), xyz.alias("xyz"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: labelled documents by length, good ones positive."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cls = F.when(F.col("quality") == 1, 1).otherwise(-1)
    return docs.select("doc_id", "n_chars").join(labels, "doc_id").select(F.col("n_chars").cast("double").alias("score"), cls.alias("cls"), F.col("doc_id").alias("tie"))


def weighted_orders(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """F10 with F9: per order, the number of lines and the rounded quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("q"))
    return lines.select("id", part_of("id", k).alias("pid"), F.array("n", "q").alias("vwgt"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how often one event type follows another, user by user."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(by).alias("dst"))
    return steps.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("wgt"))


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, sparse: how often a customer's order comes right before another's on one day; one-sided, and some have no successor."""
    by = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(by).alias("dst"))
    return steps.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("wgt"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and their parts."""
    return incidence(spark, sf_dir).select(F.col("elem").alias("tid"), F.col("node").alias("item"))


# The same as common table expressions.
INC = "inc AS (SELECT DISTINCT l_orderkey AS elem, l_partkey AS node FROM lineitem)"
DUAL = f"""{INC},
e AS (SELECT a.elem AS src, b.elem AS dst, count(*) AS wgt FROM inc a JOIN inc b USING (node)
      WHERE a.elem <> b.elem GROUP BY 1, 2 HAVING count(*) >= 2)"""
PLACED = f"{DUAL}, p AS (SELECT src, dst, wgt, CAST(src % 8 AS INT) AS ps, CAST(dst % 8 AS INT) AS pd FROM e)"
HALVES = f"{DUAL}, p AS (SELECT src, dst, wgt, CAST(src % 2 AS INT) AS ps, CAST(dst % 2 AS INT) AS pd FROM e)"
BIPARTITE = f"""c AS (SELECT DISTINCT o_custkey AS cust, l_suppkey + {SUPPLIER_SHIFT} AS supp
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT cust AS src, supp AS dst, 1 AS wgt FROM c UNION ALL SELECT supp, cust, 1 FROM c)"""
MATRIX = """m AS (SELECT o_custkey AS "row", l_partkey AS col, sum(l_quantity) AS val
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
RANKED = """r AS (SELECT CAST(n_chars AS DOUBLE) AS score, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS pos, doc_id AS tie
      FROM documents JOIN labels USING (doc_id)),
t AS (SELECT sum(pos) AS p, sum(1 - pos) AS n FROM r),
o AS (SELECT *, sum(pos) OVER w AS tp, sum(1 - pos) OVER w AS fp FROM r
      WINDOW w AS (ORDER BY score DESC, tie ROWS UNBOUNDED PRECEDING))"""
TRANSITIONS = """s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT src, dst, count(*) AS wgt FROM s WHERE dst IS NOT NULL GROUP BY 1, 2)"""
SUCCESSIONS = """s AS (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS dst FROM orders),
e AS (SELECT src, dst, count(*) AS wgt FROM s WHERE dst IS NOT NULL GROUP BY 1, 2)"""
