"""Queries over ranked lists, columns, points and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import scalars
from meshloom.operators import geometry, ranking
from meshloom.plans import fixtures as fx
from meshloom.plans.registry import register

R = f"WITH {fx.RANKED}"


@register("max_accuracy", f"{R} SELECT round(100.0 * max(tp + n - fp) / max(n + p), 6) AS max_accuracy FROM o, t")
def max_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.max_accuracy(fx.ranked(spark, sf_dir))


# The list ends with the row of the last false positive, and all positives divide the area.
_ROC = """, g AS (SELECT score, max(tp) AS tp, max(fp) AS fp, min(tp - pos) AS tp0, min(fp - (1 - pos)) AS fp0 FROM o WHERE fp - (1 - pos) < 20 GROUP BY 1),
a AS (SELECT sum({area}) AS area, max(tp) AS tp, max(fp) AS fp FROM g)
SELECT round(CASE WHEN tp * fp > 0 THEN CAST(area AS DOUBLE) / (p * fp) ELSE 0 END, 6) AS roc_n FROM a, t"""


@register("roc_n", R + _ROC.format(area="(fp - fp0) * (tp + tp0) / 2.0"))
def roc_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.roc_n(fx.ranked(spark, sf_dir), 20)


@register("roc_n_compat", R + _ROC.format(area="(fp - fp0) * (tp + tp0) // 2"))
def roc_n_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.roc_n(fx.ranked(spark, sf_dir), 20, compat=True)


@register("median_rfp", f"{R} SELECT round(CAST(min(fp) AS DOUBLE) / max(n), 6) AS median_rfp FROM o, t WHERE pos = 1 AND tp >= (p + 1) // 2")
def median_rfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.median_rfp(fx.ranked(spark, sf_dir))


@register("mean_std", "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std_pop, round(stddev_samp(o_totalprice), 4) AS std_samp FROM orders")
def mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.mean_std(fx.table(spark, sf_dir, "orders"), "o_totalprice")


@register("geo_mean", "SELECT round(pow(2, avg(log2(o_totalprice))), 4) AS geo_mean FROM orders")
def geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.geometric_mean(fx.table(spark, sf_dir, "orders"), "o_totalprice")


@register("median", "SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.median(fx.table(spark, sf_dir, "orders"), "o_totalprice")


@register("three_largest", 'SELECT o_orderkey AS "key", o_totalprice AS "value", CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS nth FROM orders ORDER BY 2 DESC, 1 LIMIT 3')
def three_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.arg_extremes(fx.table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 3)


@register(
    "csr_offsets",
    'WITH c AS (SELECT o_custkey AS "key", count(*) AS n FROM orders GROUP BY 1) SELECT "key", CAST(sum(n) OVER (ORDER BY "key") - n AS BIGINT) AS start FROM c',
)
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.exclusive_prefix(fx.table(spark, sf_dir, "orders"), "o_custkey")


# -- geometry ---------------------------------------------------------------

_MORTON = " | ".join(f"((((g{d} >> {b}) & 1)) << {b * 3 + 2 - d})" for b in range(geometry.BITS) for d in range(3))
_CELLS = ", ".join(
    f"CASE WHEN max(x{d}) OVER () > min(x{d}) OVER () THEN CAST(least(511, floor((x{d} - min(x{d}) OVER ()) / (max(x{d}) OVER () - min(x{d}) OVER ()) * 512)) AS BIGINT) ELSE 0 END AS g{d}"
    for d in range(3)
)
POINTS = "x AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, CAST(embedding[3] AS DOUBLE) AS x2 FROM embeddings)"


@register(
    "part_geom_zorder",
    f"""WITH {POINTS}, g AS (SELECT id, {_CELLS} FROM x), k AS (SELECT id, {_MORTON} AS "key" FROM g)
    SELECT id, CAST((row_number() OVER (ORDER BY "key", id) - 1) * 8 // (SELECT count(*) FROM k) AS INT) AS pid FROM k""",
)
def part_geom_zorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.part_geom(fx.points(spark, sf_dir), 8)


@register("equal_count_bins", f"WITH {POINTS} SELECT id, CAST((row_number() OVER (ORDER BY x1, id) - 1) * 16 // (SELECT count(*) FROM x) AS INT) AS bin FROM x")
def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.equal_count_bins(fx.points(spark, sf_dir), 1, 16)


@register(
    "mean_bins",
    f"""WITH {POINTS}, a AS (SELECT id, x0, CAST(x0 > avg(x0) OVER () AS INT) AS b FROM x)
    SELECT id, 2 * b + CAST(x0 > avg(x0) OVER (PARTITION BY b) AS INT) AS bin FROM a""",
)
def mean_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.mean_bins(fx.points(spark, sf_dir), 0, 2)


# -- strings and numbers ----------------------------------------------------


@register("tokenize", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ .,\\n]+'), lambda x: x <> '')) AS INT) AS n, list_filter(regexp_split_to_array(text, '[ .,\\n]+'), lambda x: x <> '')[1] AS first FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = fx.table(spark, sf_dir, "documents").select("doc_id", scalars.tokenize("text", " .,\n").alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first"))


@register("regex_replace", "SELECT doc_id, md5(regexp_replace(text, '(th)(e)', '\\2\\1', 'g')) AS every, md5(regexp_replace(text, '(th)(e)', '\\2\\1')) AS first FROM documents")
def regex_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, first = scalars.regex_replace("text", "(th)(e)", "$2$1", "g"), scalars.regex_replace("text", "(th)(e)", "$2$1")
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(every).alias("every"), F.md5(first).alias("first"))


@register("regex_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'the')) + 1 AS INT) AS n FROM documents")
def regex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", scalars.regex_count("text", "the").alias("n"))


@register("translate", "SELECT event_id, translate(event_type, 'aeiou-', '12345') AS t FROM events")
def translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", scalars.strchr_replace("event_type", "aeiou-", "12345").alias("t"))


@register("trim", "SELECT c_custkey, rtrim(c_name, '0123456789') AS tail, ltrim(c_name, 'Custom') AS head FROM customer")
def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select("c_custkey", scalars.trim_tail("c_name", "0123456789").alias("tail"), scalars.trim_head("c_name", "Custom").alias("head"))


@register(
    "case",
    """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, lower(c_mktsegment) = lower('Building') AS same,
    CASE WHEN reverse(c_name) < reverse(c_mktsegment) THEN -1 WHEN reverse(c_name) > reverse(c_mktsegment) THEN 1 ELSE 0 END AS "order", ends_with(c_mktsegment, 'G') AS ends,
    CAST(len(regexp_extract_all(c_name, '[0r]')) AS INT) AS marks FROM customer""",
)
def case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.upper("c_mktsegment").alias("up"), scalars.lower("c_mktsegment").alias("low"),
        scalars.equal_ignoring_case("c_mktsegment", F.lit("Building")).alias("same"), scalars.compare_from_end("c_name", "c_mktsegment").alias("order"),
        scalars.ends_with("c_mktsegment", "G").alias("ends"), scalars.split_count("c_name", "0r").alias("marks"),
    )


@register("base64", "SELECT p_partkey, base64(encode(p_name)) AS coded, p_name AS plain FROM part")
def base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = fx.table(spark, sf_dir, "part").select("p_partkey", scalars.base64_encode("p_name").alias("coded"))
    return coded.withColumn("plain", scalars.base64_decode("coded").cast("string"))


@register("time_format", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS text, CAST(greatest(epoch(date_trunc('second', o_orderdate)), 0) AS BIGINT) AS seconds FROM orders")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.table(spark, sf_dir, "orders").select("o_orderkey", scalars.time_to_string("o_orderdate").alias("text"))
    return texts.withColumn("seconds", scalars.string_to_time("text"))


@register("string_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 7 ELSE -1 END AS id FROM orders")
def string_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", scalars.string_id("o_orderstatus", {"F": 0, "O": 7}).alias("id"))


@register(
    "integer_math",
    """SELECT p_partkey, CAST(floor(log2(p_partkey + 1)) AS INT) AS low, bit_count(p_partkey + 1) = 1 AS power, CAST(ceil((p_partkey + 1) / 7.0) AS BIGINT) AS up_div,
    CAST(pow(2, ceil(log2(p_partkey + 1))) AS BIGINT) AS up_pow, CAST(pow(2, floor(log2(p_partkey + 1))) AS BIGINT) AS down_pow, abs(p_partkey - p_size) AS diff FROM part""",
)
def integer_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") + 1
    return fx.table(spark, sf_dir, "part").select(
        "p_partkey", scalars.ilog2(n).alias("low"), scalars.is_power_of_two(n).alias("power"), scalars.ceil_div(n, F.lit(7)).alias("up_div"),
        scalars.up_pow2(n).alias("up_pow"), scalars.down_pow2(n).alias("down_pow"), scalars.abs_diff("p_partkey", "p_size").alias("diff"),
    )


@register(
    "vector_math",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT vec_id, round(list_sum(v), 6) AS total, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_max(v), 6) AS most, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS at FROM v""",
)
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.select(
        "vec_id", F.round(scalars.vector_sum("v"), 6).alias("total"), F.round(scalars.vector_norm2("v"), 6).alias("norm"),
        F.round(F.array_max("v"), 6).alias("most"), scalars.vector_argmax("v").alias("at"),
    )
