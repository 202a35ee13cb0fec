"""Queries over groups for coarsening, walks of many vectors and searches of all components, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import clusters, graphs, itemsets, walks
from meshloom.plans import fixtures as fx
from meshloom.plans.registry import register

CAP, ROUNDS = 8, 2


def _draw_sql(turn: int) -> str:
    return f"CAST('0x' || substr(md5(id || ':{turn}'), 1, 8) AS BIGINT)"


def _clusters_sql() -> str:
    """The rounds of ``star_clusters`` one after the other."""
    steps = ["w AS (SELECT DISTINCT src AS id, 1 + src % 3 AS vwgt FROM e)", "f0 AS (SELECT * FROM w)"]
    steps.append(f"l AS MATERIALIZED (SELECT src, dst, wgt FROM e JOIN w a ON a.id = src JOIN w b ON b.id = dst WHERE a.vwgt + b.vwgt <= {CAP})")
    for t in range(ROUNDS):
        old = f"SELECT id, load, tie FROM z{t - 1} UNION ALL " if t else ""
        steps += [
            f"d{t} AS MATERIALIZED (SELECT id, vwgt, {_draw_sql(t)} < 1073741824 AS centre FROM f{t})",
            f"n{t} AS MATERIALIZED ({old}SELECT id, vwgt AS load, {_draw_sql(-1)} AS tie FROM d{t} WHERE centre)",
            f"""o{t} AS (SELECT d.id, n.id AS cid, wgt, vwgt, load, row_number() OVER (PARTITION BY d.id ORDER BY wgt DESC, tie, n.id) AS k
                FROM l JOIN d{t} d ON src = d.id JOIN n{t} n ON dst = n.id WHERE NOT centre AND vwgt + load <= {CAP})""",
            f"u{t} AS (SELECT *, sum(vwgt) OVER (PARTITION BY cid ORDER BY wgt DESC, id) AS upto FROM o{t} WHERE k = 1)",
            f"m{t} AS MATERIALIZED (SELECT id, cid, vwgt FROM u{t} WHERE upto + load <= {CAP})",
            f"z{t} AS MATERIALIZED (SELECT n.id, load + coalesce(more, 0) AS load, tie FROM n{t} n LEFT JOIN (SELECT cid, sum(vwgt) AS more FROM m{t} GROUP BY 1) ON cid = n.id)",
            f"f{t + 1} AS (SELECT id, vwgt FROM d{t} WHERE NOT centre AND id NOT IN (SELECT id FROM m{t}))",
        ]
    members = " UNION ALL ".join(f"SELECT id, cid FROM m{t}" for t in range(ROUNDS))
    return f"WITH {fx.DUAL}, {', '.join(steps)}, m AS ({members}), g AS (SELECT w.id, vwgt, coalesce(cid, w.id) AS cid FROM w LEFT JOIN m USING (id))"


def _weights(e: DataFrame) -> DataFrame:
    return graphs.vertices_of(e).withColumn("vwgt", 1 + F.col("id") % 3)


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = fx.kept_dual(spark, sf_dir)
    return e, _weights(e), clusters.star_clusters(e, _weights(e), CAP, seed=0, rounds=ROUNDS)


@register("cluster_members", f"{_clusters_sql()} SELECT id, cid FROM g")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex and the centre of its star cluster."""
    return _clusters(spark, sf_dir)[2]


@register(
    "cluster_aggregate",
    f"""{_clusters_sql()}, s AS (SELECT cid, count(*) AS members, CAST(sum(vwgt) AS BIGINT) AS weight, CAST(sum(CASE WHEN id <> cid AND NOT EXISTS
        (FROM e WHERE e.src = g.id AND e.dst = g.cid) THEN 1 ELSE 0 END) AS BIGINT) AS apart FROM g GROUP BY 1) SELECT cid, members, weight, apart FROM s""",
)
def cluster_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and weight of each cluster, and how many members are no neighbours of its centre: none."""
    e, w, found = _clusters(spark, sf_dir)
    near = e.select(F.col("src").alias("id"), F.col("dst").alias("cid"), F.lit(True).alias("near"))
    apart = F.when((F.col("id") != F.col("cid")) & F.col("near").isNull(), 1).otherwise(0)
    met = found.join(w, "id").join(near, ["id", "cid"], "left")
    return met.groupBy("cid").agg(F.count("*").alias("members"), F.sum("vwgt").alias("weight"), F.sum(apart).alias("apart"))


@register(
    "cluster_contract",
    f"""{_clusters_sql()} SELECT a.cid AS src, b.cid AS dst, CAST(sum(wgt) AS BIGINT) AS wgt
    FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst WHERE a.cid <> b.cid GROUP BY 1, 2""",
)
def cluster_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse graph of the clusters."""
    e, _, found = _clusters(spark, sf_dir)
    return graphs.contract(e, found)


def _pairs_sql(rows: str, *key: str) -> str:
    keys = ", ".join(key)
    return f"""SELECT min(id) AS id, max(id) AS mate FROM (SELECT id, vwgt, {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY id) - 1) // 2 AS half FROM {rows})
        GROUP BY {keys}, half HAVING count(*) = 2 AND sum(vwgt) <= 5"""


@register(
    "two_hop_matching",
    f"""WITH {fx.DUAL}, v AS (SELECT o_orderkey AS id, 1 + o_orderkey % 3 AS vwgt, 0 AS one FROM orders),
    h AS MATERIALIZED (SELECT src AS id, list(dst ORDER BY dst) AS around, count(*) AS degree, first(dst ORDER BY wgt DESC, dst) AS hub FROM e GROUP BY 1),
    r1 AS (SELECT * FROM v JOIN h USING (id) WHERE degree <= 64), p1 AS MATERIALIZED ({_pairs_sql('r1', 'around')}),
    r2 AS (SELECT * FROM v JOIN h USING (id) WHERE id NOT IN (SELECT id FROM p1 UNION ALL SELECT mate FROM p1)), p2 AS MATERIALIZED ({_pairs_sql('r2', 'hub')}),
    r3 AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM h)), p3 AS ({_pairs_sql('r3', 'one')}), p AS (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)
    SELECT v.id, coalesce(p.id, v.id) AS cid FROM v LEFT JOIN p ON p.mate = v.id""",
)
def two_hop_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, none of them matched before, paired by equal neighbours, shared hubs, and without neighbours."""
    e = fx.kept_dual(spark, sf_dir)
    v = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 3).alias("vwgt"))
    return clusters.two_hop(e, v, v.select("id", F.col("id").alias("cid")), 5)


# -- walks ------------------------------------------------------------------


def _batch_sql() -> str:
    """Five rounds for restarts at the customers of each remainder by 4."""
    rounds = ["k0 AS (SELECT id % 4 AS walk, id, 1.0 / count(*) OVER (PARTITION BY id % 4) AS pr FROM v)"]
    for i in range(1, 6):
        rounds.append(
            f"""k{i} AS (SELECT walk, id, sum(x) AS pr FROM (SELECT walk, dst AS id, 0.85 * pr * p AS x FROM k{i - 1} JOIN t ON src = id
            UNION ALL SELECT walk, z.id, (0.85 * coalesce(sunk, 0) + 0.15) * z.pr FROM k0 z
            LEFT JOIN (SELECT walk, sum(pr) AS sunk FROM k{i - 1} WHERE id NOT IN (SELECT src FROM e) GROUP BY 1) USING (walk)) GROUP BY 1, 2)"""
        )
    return f"""WITH {fx.SUCCESSIONS}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    t AS (SELECT src, dst, wgt / sum(wgt) OVER (PARTITION BY src) AS p FROM e), {', '.join(rounds)}"""


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from meshloom.plans.scratch import materialize

    e = materialize(fx.successions(spark, sf_dir), "successions")
    restarts = graphs.vertices_of(e).select((F.col("id") % 4).alias("walk"), "id", F.lit(1.0).alias("r"))
    return e, walks.pagerank_batch(e, restarts, 0.85, 5, eps=0.0)


@register("pagerank_batch", f"{_batch_sql()} SELECT walk, id, round(pr, 6) AS pr, 5 AS rounds FROM k5 WHERE pr > 0")
def pagerank_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir)[1].select("walk", "id", F.round("pr", 6).alias("pr"), "rounds")


@register(
    "pagerank_differences",
    f"""{_batch_sql()}, q AS (SELECT id, round(pr, 9) AS pr FROM k5 WHERE walk = 1 AND pr > 0), d AS (SELECT e.src AS id, count(*) AS degree, max(abs(a.pr - b.pr)) AS gap
    FROM e JOIN q a ON a.id = e.src JOIN q b ON b.id = e.dst GROUP BY 1)
    SELECT id, round(pr, 6) AS pr, coalesce(degree, 0) AS degree, round(coalesce(gap, 0), 6) AS difference FROM q LEFT JOIN d USING (id)""",
)
def pagerank_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of one walk against those of its neighbours."""
    e, found = _batch(spark, sf_dir)
    ranks = found.where("walk = 1").select("id", F.round("pr", 9).alias("pr"))
    return walks.largest_differences(e, ranks).select("id", F.round("pr", 6).alias("pr"), "degree", F.round("difference", 6).alias("difference"))


# -- searches of all components ---------------------------------------------

_REACH = """g AS (SELECT DISTINCT src AS id, src AS root FROM e UNION SELECT e.dst, g.root FROM g JOIN e ON e.src = g.id),
    c AS MATERIALIZED (SELECT id, min(root) AS component FROM g GROUP BY 1)"""


def _levels_sql(name: str, roots: str) -> str:
    return f"""{name}(id, level) USING KEY (id) AS ({roots} UNION
        SELECT n.id, n.level FROM (SELECT e.dst AS id, min({name}.level) + 1 AS level FROM {name} JOIN e ON e.src = {name}.id GROUP BY 1) n
        LEFT JOIN recurring.{name} k ON k.id = n.id WHERE k.id IS NULL OR n.level < k.level)"""


@register(
    "bfs_all_components",
    f"""WITH RECURSIVE {fx.DUAL}, {_REACH}, {_levels_sql('r', 'SELECT DISTINCT component, 0 FROM c')}, lev AS MATERIALIZED (SELECT id, level FROM r),
    o(id, level, path) AS (SELECT id, level, [id] FROM lev WHERE level = 0 UNION ALL SELECT e.dst, lev.level, min(list_append(o.path, e.dst))
        FROM o JOIN e ON e.src = o.id JOIN lev ON lev.id = e.dst AND lev.level = o.level + 1 GROUP BY 1, 2)
    SELECT id, component, CAST(level AS INT) AS level, row_number() OVER (ORDER BY component, level, path) - 1 AS pos FROM o JOIN c USING (id)""",
)
def bfs_all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first positions in the order of discovery; in SQL the least path of ids tells the order."""
    return walks.breadth_first(fx.kept_dual(spark, sf_dir))


def _tips_sql(levels: str) -> str:
    return f"SELECT component, first(id ORDER BY level DESC, degree, id) AS tip, max(level) AS depth FROM {levels} JOIN c USING (id) JOIN n USING (id) GROUP BY 1"


@register(
    "component_far_roots",
    f"""WITH RECURSIVE {fx.DUAL}, n AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1), {_REACH}, {_levels_sql('r', 'SELECT DISTINCT component, 0 FROM c')},
    t AS MATERIALIZED ({_tips_sql('r')}), {_levels_sql('q', 'SELECT tip, 0 FROM t')}, u AS ({_tips_sql('q')})
    SELECT CASE WHEN u.depth > t.depth THEN t.tip ELSE component END AS id, component, CAST(greatest(u.depth, t.depth) AS INT) AS depth FROM t JOIN u USING (component)""",
)
def component_far_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deeper of two roots of each component: its smallest id, or the far end seen from there."""
    return walks.far_roots(fx.kept_dual(spark, sf_dir), turns=1)


# -- itemsets with their transactions ---------------------------------------

_SETS = f"""WITH {fx.INC}, i1 AS (SELECT node FROM inc GROUP BY 1 HAVING count(*) >= 3), b AS (SELECT elem, node FROM inc JOIN i1 USING (node)),
    h AS MATERIALIZED (SELECT [node] AS items, elem AS tid FROM b UNION ALL SELECT [a.node, b.node], elem FROM b a JOIN b USING (elem) WHERE a.node < b.node
         UNION ALL SELECT [a.node, b.node, c.node], elem FROM b a JOIN b USING (elem) JOIN b c USING (elem) WHERE a.node < b.node AND b.node < c.node),
    s AS (SELECT items, count(*) AS support FROM h GROUP BY 1 HAVING count(*) >= 3)"""


@register("itemsets_vertical", f"{_SETS} SELECT array_to_string(items, ',') AS items, support FROM s")
def itemsets_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports from words of 64 transactions."""
    found = itemsets.vertical_itemsets(fx.transactions(spark, sf_dir), least=3, max_len=3).found
    return found.select(F.array_join("items", ",").alias("items"), "support")


@register("itemset_transactions", f"{_SETS} SELECT array_to_string(items, ',') AS items, tid FROM h JOIN s USING (items) WHERE len(items) >= 2")
def itemset_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that hold each frequent set of two or three parts."""
    held = itemsets.vertical_itemsets(fx.transactions(spark, sf_dir), least=3, min_len=2, max_len=3).tids()
    return held.select(F.array_join("items", ",").alias("items"), "tid")
