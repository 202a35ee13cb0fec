"""Queries over graphs and meshes: validity, parts of graphs, partition measures, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import scalars
from meshloom.operators import analytics, graphs, mesh, metrics
from meshloom.operators.ordering import global_rank
from meshloom.plans import fixtures as fx
from meshloom.plans.registry import register

P, H, D = f"WITH {fx.PLACED}", f"WITH {fx.HALVES}", f"WITH {fx.DUAL}"


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.placed_dual(spark, sf_dir, 2, keep=True)


# -- partition measures -----------------------------------------------------


@register("edge_cut", f"{P} SELECT CAST(coalesce(sum(wgt), 0) // 2 AS BIGINT) AS edge_cut FROM p WHERE ps <> pd")
def edge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.edge_cut(fx.placed_dual(spark, sf_dir))


@register("max_part_cut", f"{P}, c AS (SELECT ps, sum(CASE WHEN ps <> pd THEN wgt ELSE 0 END) AS cut FROM p GROUP BY 1) SELECT CAST(max(cut) AS BIGINT) AS max_part_cut FROM c")
def max_part_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.max_part_cut(fx.placed_dual(spark, sf_dir))


@register("part_cuts", f"{P} SELECT ps AS pid, CAST(sum(CASE WHEN ps <> pd THEN wgt ELSE 0 END) AS BIGINT) AS cut FROM p GROUP BY 1")
def part_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.part_cuts(fx.placed_dual(spark, sf_dir))


@register("comm_volume", f"{P} SELECT count(*) AS comm_volume FROM (SELECT DISTINCT src, pd FROM p WHERE ps <> pd)")
def comm_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.comm_volume(fx.placed_dual(spark, sf_dir))


@register("part_volumes", f"{P} SELECT ps AS pid, count(*) AS volume FROM (SELECT DISTINCT src, ps, pd FROM p WHERE ps <> pd) GROUP BY 1")
def part_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.part_volumes(fx.placed_dual(spark, sf_dir))


@register("subdomain_graph", f"{P} SELECT ps, pd, CAST(sum(wgt) AS BIGINT) AS wgt FROM p WHERE ps <> pd GROUP BY 1, 2")
def subdomain_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subdomain_graph(fx.placed_dual(spark, sf_dir))


@register(
    "subdomain_laplacian",
    f"""{P}, q AS (SELECT DISTINCT ps, pd FROM p WHERE ps <> pd)
    SELECT ps AS "row", pd AS col, CAST(-1 AS DOUBLE) AS val FROM q UNION ALL SELECT ps, ps, CAST(count(*) AS DOUBLE) FROM q GROUP BY ps""",
)
def subdomain_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subdomain_laplacian(fx.placed_dual(spark, sf_dir))


@register(
    "subdomain_degree_stats",
    f"""{P}, d AS (SELECT ps, count(DISTINCT pd) AS d FROM p WHERE ps <> pd GROUP BY 1)
    SELECT min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 6) AS avg_degree FROM d""",
)
def subdomain_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subdomain_degree_stats(fx.placed_dual(spark, sf_dir))


@register(
    "interface_stats",
    f"""{P}, k AS (SELECT ps, count(DISTINCT pd) AS neighbours, sum(wgt) AS cut, count(DISTINCT (src, pd)) AS interface FROM p WHERE ps <> pd GROUP BY 1),
    u AS (SELECT ps, 'neighbours' AS kind, neighbours AS v FROM k UNION ALL SELECT ps, 'cut', cut FROM k UNION ALL SELECT ps, 'interface', interface FROM k)
    SELECT kind, CAST(CASE WHEN count(*) < 8 THEN 0 ELSE min(v) END AS BIGINT) AS least, CAST(max(v) AS BIGINT) AS largest,
           round(sum(v) / 8.0, 6) AS mean, round(max(v) / (sum(v) / 8.0), 6) AS balance FROM u GROUP BY 1""",
)
def interface_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interface_stats(fx.placed_dual(spark, sf_dir), 8)


WEIGHTS = """w AS (SELECT l_orderkey AS id, CAST(l_orderkey % 8 AS INT) AS pid, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1),
l AS (SELECT pid, 0 AS con, sum(n) AS load FROM w GROUP BY 1 UNION ALL SELECT pid, 1, sum(q) FROM w GROUP BY 1)"""
TARGETS = ", g AS (SELECT pid, con, (pid + 1) / 36.0 AS tpwgt FROM range(8) a(pid), range(2) b(con)), tot AS (SELECT con, sum(load) AS total FROM l GROUP BY 1)"


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c, (p + 1) / 36.0) for p in range(8) for c in range(2)], "pid int, con int, tpwgt double")


@register("partition_loads", f"WITH {WEIGHTS} SELECT pid, con, CAST(load AS BIGINT) AS load FROM l")
def partition_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.loads(fx.weighted_orders(spark, sf_dir))


@register("partition_balance", f"WITH {WEIGHTS} SELECT con, round(8 * max(load) / sum(load), 6) AS balance FROM l GROUP BY 1")
def partition_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.balance(fx.weighted_orders(spark, sf_dir), 8)


@register("element_balance", "WITH c AS (SELECT o_orderkey % 8 AS pid, count(*) AS n FROM orders GROUP BY 1) SELECT round(8 * max(n) / sum(n), 6) AS balance FROM c")
def element_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    return metrics.element_balance(orders.select(fx.part_of("o_orderkey", 8).alias("pid")), 8)


@register(
    "load_imbalance_tpwgts",
    f"WITH {WEIGHTS}{TARGETS} SELECT con, round(greatest(1.0, max(load / (tpwgt * total))), 6) AS imbalance FROM l JOIN g USING (pid, con) JOIN tot USING (con) GROUP BY 1",
)
def load_imbalance_tpwgts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.imbalance(fx.weighted_orders(spark, sf_dir), _targets(spark))


@register("serial_balance", f"WITH {WEIGHTS}{TARGETS} SELECT con, round(max((1 + load) / (1 + tpwgt * total)), 6) AS balance FROM l JOIN g USING (pid, con) JOIN tot USING (con) GROUP BY 1")
def serial_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.guarded_balance(fx.weighted_orders(spark, sf_dir), _targets(spark))


ZERO_TARGETS = ", g AS (SELECT pid, con, CASE WHEN pid = 0 THEN 0.0 ELSE pid / 28.0 END AS tpwgt FROM range(8) a(pid), range(2) b(con)), tot AS (SELECT con, sum(load) AS total FROM l GROUP BY 1)"


@register(
    "distributed_balance",
    f"""WITH {WEIGHTS}{ZERO_TARGETS}, s AS (SELECT 0 AS con, min(n) / sum(n) AS least FROM w WHERE n > 0 UNION ALL SELECT 1, min(q) / sum(q) FROM w WHERE q > 0)
    SELECT con, round(max((least + load / total) / (least + tpwgt)), 6) AS balance FROM l JOIN g USING (pid, con) JOIN tot USING (con) JOIN s USING (con) GROUP BY 1""",
)
def distributed_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a target of zero."""
    targets = spark.createDataFrame([(p, c, p / 28.0) for p in range(8) for c in range(2)], "pid int, con int, tpwgt double")
    return metrics.guarded_balance(fx.weighted_orders(spark, sf_dir), targets, relative=True)


@register(
    "load_differences",
    f"WITH {WEIGHTS}{TARGETS} SELECT pid, con, CAST(load AS BIGINT) AS load, round(load - tpwgt * total, 6) AS difference FROM l JOIN g USING (pid, con) JOIN tot USING (con)",
)
def load_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.load_differences(fx.weighted_orders(spark, sf_dir), _targets(spark))


@register(
    "run_statistics",
    f"""{D}, c AS (SELECT k, CAST(sum(CASE WHEN src % k <> dst % k THEN wgt ELSE 0 END) // 2 AS DOUBLE) AS cut FROM e, range(2, 10) r(k) GROUP BY 1)
    SELECT min(cut) AS best, max(cut) AS worst, round(avg(cut), 6) AS mean, round(exp(avg(ln(cut))), 6) AS geo_mean, round(quantile_cont(cut, 0.5), 6) AS median, count(*) AS runs FROM c""",
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of eight partitions by remainders."""
    e = fx.strict_dual(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(2), F.lit(9))).alias("k"))
    cut = F.sum(F.when(F.col("src") % F.col("k") != F.col("dst") % F.col("k"), F.col("wgt")).otherwise(0)) / 2
    return metrics.run_statistics(e.groupBy("k").agg(F.floor(cut).alias("cut")), "cut")


@register(
    "better_balance",
    """WITH w AS (SELECT l_orderkey AS id, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1),
    s AS (SELECT id, pow(greatest(n - 4, 0), 2) + pow(greatest(q - 100, 0), 2) AS a, pow(greatest(n - 3, 0), 2) + pow(greatest(q - 105, 0), 2) AS b,
          n / 64.0 - 1 / 32.0 AS x0, q / 1024.0 - 5 / 64.0 AS x1, 3 * n / 256.0 - 1 / 32.0 AS y0, 7 * q / 8192.0 - 5 / 64.0 AS y1 FROM w)
    SELECT id, b < a AS two_way, greatest(0, y0, y1) < greatest(0, x0, x1) OR (greatest(0, y0, y1) = greatest(0, x0, x1) AND y0 * y0 + y1 * y1 < x0 * x0 + x1 * x1) AS k_way FROM s""",
)
def better_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fx.weighted_orders(spark, sf_dir).select("id", F.transform("vwgt", lambda x: x.cast("double")).alias("v"))
    less = lambda n, q: F.zip_with("v", F.array(F.lit(float(n)), F.lit(float(q))), lambda x, y: x - y)
    pair = lambda x, y: F.array(F.lit(x), F.lit(y))
    zero = pair(0.0, 0.0)
    # Multipliers that binary fractions hold exactly, so that ties are ties.
    k_way = scalars.better_balance_kway("v", pair(1 / 32, 5 / 64), (1, zero, pair(1 / 64, 1 / 1024)), (1, zero, pair(3 / 256, 7 / 8192)))
    return w.select("id", scalars.better_balance(less(4, 100), less(3, 105)).alias("two_way"), k_way.alias("k_way"))


@register(
    "load_imbalance_excess",
    f"""WITH {WEIGHTS}{TARGETS} SELECT con, round(round(greatest(1.0, max(load / (tpwgt * total))), 6) - CASE con WHEN 0 THEN 1.03 ELSE 1.05 END, 6) AS excess
    FROM l JOIN g USING (pid, con) JOIN tot USING (con) GROUP BY con""",
)
def load_imbalance_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.imbalance_excess(fx.weighted_orders(spark, sf_dir), _targets(spark), [1.03, 1.05])


KWAY = """SELECT src AS id, ps AS pid, CAST(sum(CASE WHEN ps = pd THEN wgt ELSE 0 END) AS BIGINT) AS internal,
    CAST(sum(CASE WHEN ps <> pd THEN wgt ELSE 0 END) AS BIGINT) AS external, count(DISTINCT CASE WHEN ps <> pd THEN pd END) AS parts FROM p GROUP BY 1, 2"""


@register("kway_degrees", f"{P} {KWAY}")
def kway_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kway_degrees(fx.placed_dual(spark, sf_dir))


@register("kway_links", f"{P} SELECT src AS id, ps AS pid, pd AS \"to\", CAST(sum(wgt) AS BIGINT) AS wgt FROM p WHERE ps <> pd GROUP BY 1, 2, 3")
def kway_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kway_links(fx.placed_dual(spark, sf_dir))


@register("boundary_refine", f"{P}, k AS ({KWAY}) SELECT id FROM k WHERE external >= internal AND parts > 0")
def boundary_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.boundary(fx.placed_dual(spark, sf_dir), "refine")


@register("boundary_balance", f"{P}, k AS ({KWAY}) SELECT id FROM k WHERE external > 0")
def boundary_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.boundary(fx.placed_dual(spark, sf_dir), "balance")


@register(
    "volume_gains",
    f"""{P}, v AS (SELECT DISTINCT src AS id, ps AS pid FROM p),
    mv AS (SELECT DISTINCT src AS id, ps AS a, pd AS b FROM p WHERE ps <> pd),
    now AS (SELECT src AS u, ps AS pu, pd, count(*) AS n FROM p GROUP BY 1, 2, 3),
    own AS (SELECT mv.id, mv.b, 1 - CAST(EXISTS (SELECT 1 FROM now WHERE now.u = mv.id AND now.pd = mv.a) AS INT) AS gain FROM mv),
    near AS (SELECT mv.id, mv.b, CAST(f.n = 1 AND e.pd <> mv.a AS INT) - CAST(t.n IS NULL AND e.pd <> mv.b AS INT) AS gain
             FROM mv JOIN p e ON e.src = mv.id JOIN now f ON f.u = e.dst AND f.pd = mv.a LEFT JOIN now t ON t.u = e.dst AND t.pd = mv.b)
    SELECT id, b AS "to", CAST(sum(gain) AS BIGINT) AS gain FROM (SELECT * FROM own UNION ALL SELECT * FROM near) GROUP BY 1, 2""",
)
def volume_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.volume_gains(fx.placed_dual(spark, sf_dir, keep=True))


MOVES = "m AS (SELECT o_orderkey AS id, CAST(o_orderkey % 8 AS INT) AS home, CAST((o_orderkey // 8) % 8 AS INT) AS pid, 1 + o_custkey % 3 AS vsize FROM orders)"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = fx.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return orders.select(key.alias("id"), fx.part_of(key, 8).alias("home"), fx.part_of(F.floor(key / 8), 8).alias("pid"), (1 + F.col("o_custkey") % 3).alias("vsize"))


@register(
    "move_stats",
    f"""WITH {MOVES}, f AS (SELECT home, pid, count(*) AS n, sum(vsize) AS v FROM m WHERE home <> pid GROUP BY 1, 2),
    o AS (SELECT sum(n) AS n, sum(v) AS v FROM f GROUP BY home), i AS (SELECT sum(n) AS n, sum(v) AS v FROM f GROUP BY pid)
    SELECT CAST((SELECT sum(n) FROM f) AS BIGINT) AS n_moved, CAST((SELECT max(n) FROM o) AS BIGINT) AS max_out, CAST((SELECT max(n) FROM i) AS BIGINT) AS max_in,
           CAST((SELECT sum(v) FROM f) AS BIGINT) AS total_v, CAST((SELECT max(v) FROM o) AS BIGINT) AS max_out_size, CAST((SELECT max(v) FROM i) AS BIGINT) AS max_in_size""",
)
def move_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.move_stats(_moves(spark, sf_dir))


@register("total_v", f"WITH {MOVES} SELECT CAST(sum(vsize) AS BIGINT) AS total_v FROM m WHERE home <> pid")
def total_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).where("home <> pid").agg(F.sum("vsize").alias("total_v"))


@register("remap_overlap", f"WITH {MOVES} SELECT home, pid, CAST(sum(vsize) AS BIGINT) AS size FROM m GROUP BY 1, 2")
def remap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlap(_moves(spark, sf_dir))


@register(
    "partition_report",
    f"""WITH {fx.PLACED}, w AS (SELECT l_orderkey AS id, CAST(l_orderkey % 8 AS INT) AS pid, count(*) AS n FROM lineitem GROUP BY 1),
    l AS (SELECT pid, sum(n) AS load FROM w GROUP BY 1), d AS (SELECT ps, count(DISTINCT pd) AS d FROM p WHERE ps <> pd GROUP BY 1)
    SELECT (SELECT CAST(sum(wgt) // 2 AS BIGINT) FROM p WHERE ps <> pd) AS edge_cut,
           (SELECT count(*) FROM (SELECT DISTINCT src, pd FROM p WHERE ps <> pd)) AS comm_volume,
           (SELECT round(8 * max(load) / sum(load), 6) FROM l) AS balance, (SELECT pid FROM l ORDER BY load DESC, pid LIMIT 1) AS heaviest,
           (SELECT min(d) FROM d) AS min_degree, (SELECT max(d) FROM d) AS max_degree, (SELECT round(avg(d), 6) FROM d) AS avg_degree""",
)
def partition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(fx.placed_dual(spark, sf_dir, keep=True), fx.weighted_orders(spark, sf_dir), 8)


@register("graph_memory", f"{D} SELECT CAST(count(*) * 16 + ((SELECT count(*) FROM orders) + 1) * 8 + (SELECT count(*) FROM orders) * 8 AS BIGINT) AS bytes FROM e")
def graph_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.graph_bytes(fx.strict_dual(spark, sf_dir), fx.table(spark, sf_dir, "orders").count())


# -- validity ---------------------------------------------------------------

BROKEN = """x AS (SELECT src, dst, wgt FROM e WHERE (src + dst) % 7 <> 0 OR src < dst UNION ALL SELECT src, src, 1 FROM e WHERE src % 50 = 0 GROUP BY src
    UNION ALL SELECT src, dst, wgt + 1 FROM e WHERE src % 20 = 0 AND src < dst AND (src + dst) % 7 <> 0)"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 with missing reverses, self loops, and second copies of edges with another weight."""
    e = fx.kept_dual(spark, sf_dir)
    one_way = e.where("(src + dst) % 7 <> 0 or src < dst")
    loops = e.where("src % 50 = 0").select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1).cast("long").alias("wgt"))
    again = e.where("src % 20 = 0 and src < dst and (src + dst) % 7 <> 0").select("src", "dst", (F.col("wgt") + 1).alias("wgt"))
    return one_way.union(loops).union(again)


@register(
    "graph_check",
    f"""WITH {fx.DUAL}, {BROKEN}, g AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, src < dst AS fwd, src = dst AS loop, wgt FROM x),
    q AS (SELECT lo, hi, bool_or(loop) AS loop, count(*) FILTER (fwd) AS there, count(*) FILTER (NOT fwd AND NOT loop) AS back,
                 min(wgt) FILTER (fwd) AS wt, min(wgt) FILTER (NOT fwd AND NOT loop) AS wb, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT 'self_loop' AS violation, CAST(sum(CASE WHEN loop THEN n ELSE 0 END) AS BIGINT) AS n FROM q
    UNION ALL SELECT 'duplicate_edge', CAST(sum(greatest(there - 1, 0) + greatest(back - 1, 0)) AS BIGINT) FROM q WHERE NOT loop
    UNION ALL SELECT 'missing_reverse', count(*) FROM q WHERE NOT loop AND (there = 0 OR back = 0)
    UNION ALL SELECT 'unequal_weight', count(*) FROM q WHERE NOT loop AND there > 0 AND back > 0 AND wt <> wb""",
)
def graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.check(_broken(spark, sf_dir))


@register(
    "graph_fix",
    f"""WITH {fx.DUAL}, {BROKEN}, f AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, min(wgt) AS wgt FROM x WHERE src <> dst GROUP BY 1, 2)
    SELECT lo AS src, hi AS dst, wgt FROM f UNION ALL SELECT hi, lo, wgt FROM f""",
)
def graph_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.fix(_broken(spark, sf_dir))


@register("weight_check", f"{D} SELECT 'edge_weight' AS what, count(*) FILTER (wgt <= 0) AS n FROM e UNION ALL SELECT 'vertex_weight', count(*) FILTER (o_totalprice < 0) FROM orders")
def weight_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.check_weights(fx.strict_dual(spark, sf_dir), fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("vwgt")))


# -- parts of graphs --------------------------------------------------------


@register("split_bisection", f"{H} SELECT src, dst, wgt, ps AS pid FROM p WHERE ps = pd")
def split_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.split(_halves(spark, sf_dir))


SEP = f"{H}, s AS (SELECT src AS id, CASE WHEN bool_or(ps <> pd) THEN 2 ELSE any_value(ps) END AS pid FROM p GROUP BY 1)"


@register("separator_boundary", f"{SEP} SELECT id, CAST(pid AS INT) AS pid FROM s")
def separator_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.separator_from_cut(_halves(spark, sf_dir))


@register("separator_valid", f"{SEP} SELECT CAST(coalesce(sum(CASE WHEN a.pid + b.pid = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM e JOIN s a ON src = a.id JOIN s b ON dst = b.id")
def separator_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _halves(spark, sf_dir)
    return metrics.separator_violations(metrics.with_parts(placed.select("src", "dst", "wgt"), metrics.separator_from_cut(placed)))


@register("split_separator", f"{SEP} SELECT src, dst, wgt, CAST(a.pid AS INT) AS pid FROM e JOIN s a ON src = a.id JOIN s b ON dst = b.id WHERE a.pid = b.pid AND a.pid <> 2")
def split_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _halves(spark, sf_dir)
    return graphs.split_by_separator(metrics.with_parts(placed.select("src", "dst", "wgt"), metrics.separator_from_cut(placed)))


@register(
    "separator_degrees",
    f"""{SEP} SELECT src AS id, CAST(sum(CASE WHEN b.pid = 0 THEN 1 ELSE 0 END) AS BIGINT) AS "left", CAST(sum(CASE WHEN b.pid = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "right"
    FROM e JOIN s a ON src = a.id JOIN s b ON dst = b.id WHERE a.pid = 2 GROUP BY 1""",
)
def separator_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _halves(spark, sf_dir)
    part = metrics.separator_from_cut(placed)
    return metrics.separator_degrees(metrics.with_parts(placed.select("src", "dst", "wgt"), part), part.select("id", F.lit(1).alias("vwgt")))


@register("separator_weight", f"{SEP} SELECT count(*) AS separator_weight FROM s WHERE pid = 2")
def separator_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = metrics.separator_from_cut(_halves(spark, sf_dir))
    return metrics.separator_weight(part.withColumn("vwgt", F.lit(1).cast("long")))


@register("subgraph_range", f"{D} SELECT src - 100 AS src, dst - 100 AS dst, wgt FROM e WHERE src BETWEEN 100 AND 5099 AND dst BETWEEN 100 AND 5099")
def subgraph_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.subgraph(fx.strict_dual(spark, sf_dir), 100, 5000)


@register(
    "boundary_subgraph",
    f"{H}, b AS (SELECT DISTINCT src AS id FROM p WHERE ps <> pd) SELECT src, dst, wgt FROM p WHERE src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b)",
)
def boundary_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.boundary_subgraph(_halves(spark, sf_dir))


@register(
    "contract_by_cmap",
    f"{D} SELECT src // 2 AS src, dst // 2 AS dst, CAST(sum(wgt) AS BIGINT) AS wgt FROM e WHERE src // 2 <> dst // 2 GROUP BY 1, 2",
)
def contract_by_cmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    cmap = graphs.vertices_of(e).select("id", F.floor(F.col("id") / 2).alias("cid"))
    return graphs.contract(e, cmap)


@register("project_partition", f"{D} SELECT DISTINCT src AS id, CAST((src // 2) % 8 AS INT) AS pid FROM e")
def project_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmap = graphs.vertices_of(fx.kept_dual(spark, sf_dir)).select("id", F.floor(F.col("id") / 2).alias("cid"))
    coarse = cmap.select(F.col("cid").alias("id")).distinct().withColumn("pid", fx.part_of("id", 8))
    return graphs.project(cmap, coarse)


HOODS = "h AS (SELECT src AS id, list_sort(list_distinct(list(dst) || [src])) AS around, list_sort(list(DISTINCT dst)) AS hood FROM e GROUP BY 1)"
BIP = f"WITH {fx.BIPARTITE}, {HOODS}"


@register("compress_identical", f"{BIP} SELECT id, min(id) OVER (PARTITION BY around) AS cid FROM h")
def compress_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.compress_identical(fx.bipartite(spark, sf_dir))


@register("compress_identical_dual", f"WITH {fx.DUAL}, {HOODS} SELECT id, min(id) OVER (PARTITION BY around) AS cid FROM h")
def compress_identical_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.compress_identical(fx.kept_dual(spark, sf_dir))


_TWINS = """, n AS (SELECT id, row_number() OVER w - 1 AS nth, lead(id) OVER w AS mate FROM h WHERE len(hood) <= 64 WINDOW w AS (PARTITION BY hood ORDER BY id))
    SELECT id, mate FROM n WHERE nth % 2 = 0 AND mate IS NOT NULL"""


@register("twin_pairs", BIP + _TWINS)
def twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.twins(fx.bipartite(spark, sf_dir))


@register("twin_pairs_dual", f"WITH {fx.DUAL}, {HOODS}" + _TWINS)
def twin_pairs_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.twins(fx.kept_dual(spark, sf_dir))


@register(
    "leaf_pairs",
    f"""{D}, l AS (SELECT src AS id, min(dst) AS hub FROM e GROUP BY 1 HAVING count(*) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY id) - 1 AS nth FROM l)
    SELECT a.id, b.id AS mate FROM r a JOIN r b ON a.hub = b.hub AND a.nth % 2 = 0 AND b.nth = a.nth + 1""",
)
def leaf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.leaves(fx.strict_dual(spark, sf_dir))


@register("prune_dense", f"{D}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1) SELECT id, degree, degree >= 1.5 * (SELECT avg(degree) FROM d) AS dense FROM d")
def prune_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.prune_dense(fx.kept_dual(spark, sf_dir), 1.5)


@register("islands", f"{D} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT src FROM e)")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.islands(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), fx.strict_dual(spark, sf_dir))


@register("degrees", f"{D} SELECT src AS id, count(*) AS degree, CAST(sum(wgt) AS BIGINT) AS wgt FROM e GROUP BY 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(fx.strict_dual(spark, sf_dir))


@register(
    "reverse_positions",
    f"{D}, a AS (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INT) AS pos FROM e) SELECT a.src, a.dst, a.pos, b.pos AS back FROM a JOIN a b ON a.src = b.dst AND a.dst = b.src",
)
def reverse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.reverse_positions(fx.kept_dual(spark, sf_dir))


@register("interface_vertices", f"{P} SELECT src AS id, bool_or(ps <> pd) AS interface FROM p GROUP BY 1")
def interface_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.interfaces(fx.strict_dual(spark, sf_dir), fx.part_of("src", 8), fx.part_of("dst", 8))


@register("compact_ids", f"{D}, v AS (SELECT DISTINCT src AS id FROM e) SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM v")
def compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.compact_ids(fx.strict_dual(spark, sf_dir))


PERM = "v AS (SELECT DISTINCT src AS id FROM e), q AS (SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS pos FROM v)"


def _reversed(e: DataFrame) -> DataFrame:
    return global_rank(graphs.vertices_of(e), [F.desc("id")], "pos")


@register("reorder", f"WITH {fx.DUAL}, {PERM} SELECT a.pos AS src, b.pos AS dst, wgt FROM e JOIN q a ON src = a.id JOIN q b ON dst = b.id")
def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return graphs.reorder(e, _reversed(e))


@register("renumber", f"{D} SELECT src + 1 AS src, dst + 1 AS dst, wgt FROM e")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.renumber(fx.strict_dual(spark, sf_dir), 1)


for _scheme, _sql in (
    ("block", "o_orderkey // ((n + 6) // 7)"),
    ("cyclic", "o_orderkey % 7"),
    ("blockcyclic", "(o_orderkey // 64) % 7"),
):

    @register(f"distribute_{_scheme}", f"WITH s AS (SELECT max(o_orderkey) + 1 AS n FROM orders) SELECT o_orderkey AS id, CAST({_sql} AS INT) AS owner FROM orders, s")
    def _distribute(spark: SparkSession, sf_dir: str, scheme: str = _scheme) -> DataFrame:
        orders = fx.table(spark, sf_dir, "orders")
        n = orders.agg(F.max("o_orderkey")).first()[0] + 1
        return orders.select(F.col("o_orderkey").alias("id"), graphs.distribute(F.col("o_orderkey"), n, 7, scheme, 64).alias("owner"))


@register("part_to_perm", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey % 8, o_orderkey) - 1 AS pos FROM orders")
def part_to_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fx.part_of("o_orderkey", 8).alias("pid"))
    return global_rank(rows, ["pid", "id"], "pos").select("id", "pos")


# -- meshes -----------------------------------------------------------------


@register("nodal_graph", f"WITH {fx.INC} SELECT DISTINCT a.node AS src, b.node AS dst, CAST(1 AS BIGINT) AS wgt FROM inc a JOIN inc b USING (elem) WHERE a.node <> b.node")
def nodal_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.nodal(spark, sf_dir)


@register("dual_strict", f"{D} SELECT src, dst, wgt FROM e")
def dual_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.strict_dual(spark, sf_dir)


@register(
    "dual_relaxed",
    f"""WITH {fx.INC}, n AS (SELECT elem, count(*) AS n FROM inc GROUP BY 1),
    c AS (SELECT a.elem AS src, b.elem AS dst, count(*) AS s FROM inc a JOIN inc b USING (node) GROUP BY 1, 2)
    SELECT src, dst, CAST(CASE WHEN src = dst THEN 0 ELSE s END AS BIGINT) AS wgt FROM c JOIN n x ON src = x.elem JOIN n y ON dst = y.elem
    WHERE (src <> dst AND (s >= 2 OR s >= x.n - 1 OR s >= y.n - 1)) OR (src = dst AND x.n = 1)""",
)
def dual_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.dual_graph(fx.repeated_incidence(spark, sf_dir), ncommon=2, relaxed=True)


@register(
    "induce_majority",
    f"""WITH {fx.INC}, c AS (SELECT elem, node % 8 AS pid, count(*) AS n FROM inc GROUP BY 1, 2)
    SELECT elem AS id, CAST(arg_max(pid, n * 1000 - pid) AS INT) AS pid, count(*) = 1 AS unanimous FROM c GROUP BY 1""",
)
def induce_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = fx.incidence(spark, sf_dir)
    return mesh.induce_majority(inc.select(F.col("elem").alias("id"), fx.part_of("node", 8).alias("pid")))


# -- analytics --------------------------------------------------------------


@register(
    "connected_components",
    f"""WITH RECURSIVE {fx.DUAL}, r AS (SELECT DISTINCT src AS id, src AS root FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.id)
    SELECT id, min(root) AS component FROM r GROUP BY 1""",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.components(fx.strict_dual(spark, sf_dir))


@register(
    "components_in_partition",
    f"""WITH RECURSIVE {fx.PLACED}, r AS (SELECT DISTINCT src AS id, ps AS pid, src AS root FROM p UNION SELECT p.dst, r.pid, r.root FROM r JOIN p ON p.src = r.id WHERE p.ps = p.pd)
    SELECT id, pid, min(root) AS component FROM r GROUP BY 1, 2""",
)
def components_in_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.components_in_parts(fx.placed_dual(spark, sf_dir, keep=True))


@register(
    "components_without_separator",
    f"""WITH RECURSIVE {fx.HALVES}, s AS (SELECT src AS id, CASE WHEN bool_or(ps <> pd) THEN 2 ELSE any_value(ps) END AS pid FROM p GROUP BY 1), k AS (SELECT id FROM s WHERE pid <> 2),
    r AS (SELECT id, id AS root FROM k UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.id JOIN k ON k.id = e.dst)
    SELECT id, min(root) AS component FROM r GROUP BY 1""",
)
def components_without_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _halves(spark, sf_dir)
    return analytics.components_without(placed.select("src", "dst", "wgt"), metrics.separator_from_cut(placed))


ROOT = "root AS (SELECT min(src) AS id FROM e)"


def _root(e: DataFrame) -> DataFrame:
    return e.agg(F.min("src").alias("id")).where("id is not null")


@register(
    "bfs_levels",
    f"""WITH RECURSIVE {fx.DUAL}, {ROOT}, r(id, level) USING KEY (id) AS (SELECT id, 0 FROM root UNION
        SELECT n.id, n.level FROM (SELECT e.dst AS id, min(r.level) + 1 AS level FROM r JOIN e ON e.src = r.id GROUP BY 1) n
        LEFT JOIN recurring.r k ON k.id = n.id WHERE k.id IS NULL OR n.level < k.level)
    SELECT id, CAST(level AS INT) AS level FROM r""",
)
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return analytics.bfs_levels(e, _root(e))


@register(
    "sssp",
    f"""WITH RECURSIVE {fx.DUAL}, {ROOT}, r(id, dist) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM root UNION
        SELECT n.id, n.dist FROM (SELECT e.dst AS id, CAST(min(r.dist + e.wgt) AS BIGINT) AS dist FROM r JOIN e ON e.src = r.id GROUP BY 1) n
        LEFT JOIN recurring.r k ON k.id = n.id WHERE k.id IS NULL OR n.dist < k.dist),
    v AS (SELECT DISTINCT src AS id FROM e) SELECT v.id, coalesce(dist, -1) AS dist FROM v LEFT JOIN r USING (id)""",
)
def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return analytics.sssp(e, _root(e), graphs.vertices_of(e))


def _pagerank_sql(restart: str, edges: str = fx.TRANSITIONS) -> str:
    rounds = [f"k0 AS ({restart})"]
    for i in range(1, 6):
        rounds.append(
            f"""k{i} AS (SELECT v.id, 0.85 * ((SELECT coalesce(sum(pr), 0) FROM k{i - 1} WHERE id NOT IN (SELECT src FROM e)) * z.pr
            + coalesce((SELECT sum(x.pr * s.p) FROM k{i - 1} x JOIN s ON s.src = x.id WHERE s.dst = v.id), 0)) + 0.15 * z.pr AS pr FROM v JOIN k0 z ON z.id = v.id)"""
        )
    return f"""WITH {edges.replace('s AS', 'ev AS', 1).replace('FROM s ', 'FROM ev ')}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    s AS (SELECT src, dst, wgt / sum(wgt) OVER (PARTITION BY src) AS p FROM e), {', '.join(rounds)} SELECT id, round(pr, 6) AS pr FROM k5"""


@register("pagerank_5", _pagerank_sql("SELECT id, 1.0 / (SELECT count(*) FROM v) AS pr FROM v"))
def pagerank_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pagerank(fx.transitions(spark, sf_dir), 0.85, 5).select("id", F.round("pr", 6).alias("pr"))


@register("personalised_pagerank_5", _pagerank_sql("SELECT id, CASE WHEN id = (SELECT min(id) FROM v) THEN 1.0 ELSE 0.0 END AS pr FROM v"))
def personalised_pagerank_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.transitions(spark, sf_dir)
    restart = graphs.vertices_of(e).agg(F.min("id").alias("id")).withColumn("r", F.lit(1.0))
    return analytics.pagerank(e, 0.85, 5, restart).select("id", F.round("pr", 6).alias("pr"))


@register("pagerank_sparse", _pagerank_sql("SELECT id, 1.0 / (SELECT count(*) FROM v) AS pr FROM v", fx.SUCCESSIONS))
def pagerank_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks where some vertices have no edge out."""
    return analytics.pagerank(fx.successions(spark, sf_dir), 0.85, 5).select("id", F.round("pr", 6).alias("pr"))


@register(
    "articulation",
    f"""WITH RECURSIVE {fx.HALVES}, i AS (SELECT src, dst FROM p WHERE ps = pd), d AS (SELECT src AS id FROM i GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8),
    r AS (SELECT d.id AS id, i.dst AS root, i.dst AS v FROM d JOIN i ON i.src = d.id UNION SELECT r.id, r.root, i.dst FROM r JOIN i ON i.src = r.v WHERE i.dst <> r.id),
    c AS (SELECT id, root, min(v) AS c FROM r GROUP BY 1, 2) SELECT id, count(DISTINCT c) > 1 AS articulation FROM c GROUP BY 1""",
)
def articulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight vertices of most neighbours in their own half."""
    placed = _halves(spark, sf_dir)
    asked = placed.where("ps = pd").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(8)
    return analytics.articulation(placed, asked.select("id"))


@register("random_order", f"{D}, v AS (SELECT DISTINCT src AS id FROM e) SELECT count(*) AS n, min(id) AS least, max(id) AS largest, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS positions FROM v")
def random_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any permutation leaves as it is."""
    order = graphs.random_order(graphs.vertices_of(fx.kept_dual(spark, sf_dir)), seed=5)
    return order.agg(F.count_distinct("pos").alias("n"), F.min("id").alias("least"), F.max("id").alias("largest"), F.sum("pos").alias("positions"))


@register("compactness", f"WITH {fx.DUAL}, {PERM} SELECT round(avg(abs(a.pos - b.pos)), 6) AS compactness FROM e JOIN q a ON src = a.id JOIN q b ON dst = b.id")
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return analytics.compactness(e, _reversed(e))


@register(
    "centroid_reorder",
    f"""WITH {fx.DUAL}, {PERM}, c AS (SELECT src AS id, round(avg(b.pos), 6) AS mean FROM e JOIN q b ON dst = b.id GROUP BY 1)
    SELECT id, row_number() OVER (ORDER BY mean, id) - 1 AS pos FROM c""",
)
def centroid_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.kept_dual(spark, sf_dir)
    return analytics.centroid_order(e, _reversed(e))


@register(
    "itemsets_1_2_3",
    f"""WITH {fx.INC}, i1 AS (SELECT node FROM inc GROUP BY 1 HAVING count(*) >= 3), b AS (SELECT elem, node FROM inc JOIN i1 USING (node)),
    s AS (SELECT [node] AS items, count(*) AS support FROM b GROUP BY 1
          UNION ALL SELECT [a.node, b.node], count(*) FROM b a JOIN b USING (elem) WHERE a.node < b.node GROUP BY 1
          UNION ALL SELECT [a.node, b.node, c.node], count(*) FROM b a JOIN b USING (elem) JOIN b c USING (elem) WHERE a.node < b.node AND b.node < c.node GROUP BY 1)
    SELECT array_to_string(items, ',') AS items, support FROM s WHERE support >= 3""",
)
def itemsets_1_2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.itemsets(fx.transactions(spark, sf_dir), least=3, max_len=3)
    return found.select(F.array_join("items", ",").alias("items"), "support")


@register(
    "graph_replicate",
    f"""WITH {fx.MATRIX}, z AS (SELECT max(greatest("row", col)) + 1 AS n FROM m) SELECT "row" + k * n AS "row", col + k * n AS col, val FROM m, z, range(2) t(k)""",
)
def graph_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.replicate(fx.matrix(spark, sf_dir), 2)
