"""Queries over sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import graphs, matrix
from meshloom.plans import fixtures as fx
from meshloom.plans.registry import register

M = f"WITH {fx.MATRIX}"


def _rounded(m: DataFrame) -> DataFrame:
    return m.select("row", "col", F.round(F.col("val") + 1e-9, 6).alias("val"))  # off the ties of decimal halves


_SCALED = {
    "maxtf": ('0.5 + 0.5 * val / max(abs(val)) OVER (PARTITION BY "row")', ""),
    "maxtf2": ('0.1 + 0.9 * val / max(abs(val)) OVER (PARTITION BY "row")', ""),
    "sqrt": ("CASE WHEN val = 0 THEN val ELSE 0.1 + sign(val) * sqrt(abs(val)) END", ""),
    "pow25": ("CASE WHEN val = 0 THEN val ELSE 0.1 + sign(val) * pow(abs(val), 0.25) END", ""),
    "pow65": ("CASE WHEN val = 0 THEN val ELSE 0.1 + sign(val) * pow(abs(val), 0.65) END", ""),
    "pow75": ("CASE WHEN val = 0 THEN val ELSE 0.1 + sign(val) * pow(abs(val), 0.75) END", ""),
    "pow85": ("CASE WHEN val = 0 THEN val ELSE 0.1 + sign(val) * pow(abs(val), 0.85) END", ""),
    "log": ("CASE WHEN val = 0 THEN val ELSE 1 + sign(val) * log2(abs(val)) END", ""),
    "idf": ("val * ln(CAST((SELECT count(DISTINCT \"row\") FROM m) AS DOUBLE) / count(*) OVER (PARTITION BY col))", ""),
    "idf2": (
        "val * ln(CAST((SELECT count(DISTINCT \"row\") FROM m) + 2 * bg AS DOUBLE) / (bg + count(*) OVER (PARTITION BY col)))",
        ", g AS (SELECT greatest(10, CAST(floor(0.5 * count(*) / count(DISTINCT col)) AS BIGINT)) AS bg FROM m)",
    ),
}

for _kind, (_sql, _more) in _SCALED.items():

    @register(f"scale_{_kind}", f'{M}{_more} SELECT "row", col, round({_sql} + 1e-9, 6) AS val FROM m{", g" if _more else ""}')
    def _scale(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return _rounded(matrix.scale(fx.matrix(spark, sf_dir), kind))


for _what in ("row", "col"):
    _by = f'OVER (PARTITION BY "{_what}")'

    @register(f"normalize_l1_{_what}", f'{M} SELECT "row", col, round(val / sum(val) {_by} + 1e-9, 6) AS val FROM m')
    def _l1(spark: SparkSession, sf_dir: str, what: str = _what) -> DataFrame:
        return _rounded(matrix.normalise(fx.matrix(spark, sf_dir), what, 1))

    @register(f"normalize_l2_{_what}", f'{M} SELECT "row", col, round(val / sqrt(sum(val * val) {_by}) + 1e-9, 6) AS val FROM m')
    def _l2(spark: SparkSession, sf_dir: str, what: str = _what) -> DataFrame:
        return _rounded(matrix.normalise(fx.matrix(spark, sf_dir), what, 2))

    @register(f"{_what}_sums", f'{M} SELECT "{_what}", sum(val) AS sum FROM m GROUP BY 1')
    def _sums(spark: SparkSession, sf_dir: str, what: str = _what) -> DataFrame:
        return matrix.sums(fx.matrix(spark, sf_dir), what)

    @register(f"{_what}_sqnorms", f'{M} SELECT "{_what}", sum(val * val) AS sqnorm FROM m GROUP BY 1')
    def _norms(spark: SparkSession, sf_dir: str, what: str = _what) -> DataFrame:
        return matrix.squared_norms(fx.matrix(spark, sf_dir), what)

    @register(f"prune_{_what}s", f'{M}, c AS (SELECT *, count(*) {_by} AS n FROM m) SELECT "row", col, val FROM c WHERE n BETWEEN 20 AND 40')
    def _prune(spark: SparkSession, sf_dir: str, what: str = _what) -> DataFrame:
        return matrix.prune(fx.matrix(spark, sf_dir), what, 20, 40)

    _other = "col" if _what == "row" else "row"
    for _norm, _size in ((1, "abs(val)"), (2, "val * val")):

        @register(
            f"low_filter_{_what}" + ("" if _norm == 2 else "_l1"),
            f"""{M}, c AS (SELECT *, {_size} AS s FROM m), d AS (SELECT *, sum(s) {_by} AS total,
            coalesce(sum(s) OVER (PARTITION BY "{_what}" ORDER BY s DESC, "{_other}" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
            SELECT "row", col, val FROM d WHERE before <= 0.5 * total""",
        )
        def _low(spark: SparkSession, sf_dir: str, what: str = _what, norm: int = _norm) -> DataFrame:
            return matrix.low_filter(fx.matrix(spark, sf_dir), what, norm, 0.5)

    @register(
        f"topk_plus_{_what}",
        f'{M}, c AS (SELECT *, row_number() OVER (PARTITION BY "{_what}" ORDER BY val DESC, "{_other}") AS n FROM m) SELECT "row", col, val FROM c WHERE n <= 5 OR val >= 60',
    )
    def _topk(spark: SparkSession, sf_dir: str, what: str = _what) -> DataFrame:
        return matrix.topk_plus(fx.matrix(spark, sf_dir), what, 5, 60.0)


@register(
    "zscore_filter",
    f"""{M}, n AS (SELECT "row", col, val / sum(val) OVER (PARTITION BY "row") AS val, count(*) OVER (PARTITION BY "row") AS k FROM m)
    SELECT "row", col, round(val + 1e-9, 6) AS val FROM n WHERE val > 1.3 / k""",
)
def zscore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.zscore_filter(matrix.normalise(fx.matrix(spark, sf_dir), "row", 1), 1.3))


@register(
    "compact_columns",
    f'{M}, c AS (SELECT col, row_number() OVER (ORDER BY count(*) DESC, col) - 1 AS new FROM m GROUP BY 1) SELECT "row", new AS col, val FROM m JOIN c USING (col)',
)
def compact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.compact_columns(fx.matrix(spark, sf_dir))


@register("transpose", f'{M} SELECT col AS "row", "row" AS col, val FROM m')
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transpose(fx.matrix(spark, sf_dir))


_PAIRS = """j AS (SELECT DISTINCT "row" AS i, "row" + 1 AS j FROM m WHERE "row" + 1 IN (SELECT "row" FROM m)),
q AS (SELECT "row", sum(val) AS s, sum(val * val) AS q FROM m GROUP BY 1),
d AS (SELECT j.i, j.j, coalesce(sum(a.val * b.val), 0) AS dot, coalesce(sum(CASE WHEN b.val IS NOT NULL THEN least(a.val, b.val) END), 0) AS low
      FROM j JOIN m a ON a."row" = j.i LEFT JOIN m b ON b."row" = j.j AND b.col = a.col GROUP BY 1, 2)"""
_SIMS = {
    "cos": "dot / sqrt(x.q * y.q)",
    "jac": "dot / (x.q + y.q - dot)",
    "min": "low / (x.s + y.s - low)",
    "amin": "low / x.s",
}

for _kind, _sql in _SIMS.items():

    @register(f"similarity_{_kind}", f'{M}, {_PAIRS} SELECT i, j, round({_sql}, 6) AS sim FROM d JOIN q x ON x."row" = i JOIN q y ON y."row" = j')
    def _similarity(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        m = fx.matrix(spark, sf_dir)
        rows = m.select("row").distinct()
        pairs = rows.join(rows.select((F.col("row") - 1).alias("row")), "row").select(F.col("row").alias("i"), (F.col("row") + 1).alias("j"))
        found = matrix.similarity(m, pairs, kind)
        return found.select("i", "j", F.round("sim", 6).alias("sim"))

    @register(
        "similar_rows_topk" if _kind == "cos" else f"similar_rows_{_kind}",
        f"""{M}, q AS (SELECT "row", sum(val) AS s, sum(val * val) AS q FROM m GROUP BY 1),
        d AS (SELECT a."row" AS qid, b."row" AS "row", sum(a.val * b.val) AS dot, sum(least(a.val, b.val)) AS low FROM m a JOIN m b USING (col) WHERE a."row" % 20 = 0 GROUP BY 1, 2),
        z AS (SELECT qid, d."row" AS "row", round({_sql}, 6) AS sim FROM d JOIN q x ON x."row" = qid JOIN q y ON y."row" = d."row"),
        n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, "row") AS nth FROM z WHERE sim >= 0.01)
        SELECT qid, "row", sim FROM n WHERE nth <= 10""",
    )
    def _similar(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        """Every row whose id is divisible by 20 against all rows."""
        m = fx.matrix(spark, sf_dir)
        query = m.where("row % 20 = 0").select(F.col("row").alias("qid"), "col", "val")
        return matrix.similar_rows(m, query, kind, top=10, least=0.01)


for _op, _value, _having in (("sum", "sum(val)", ""), ("max", "max(val)", ""), ("min", "min(val)", " HAVING count(*) = 2"), ("avg", "sum(val) / 2", "")):

    @register(
        f"symmetrize_{_op}",
        f"""WITH {fx.TRANSITIONS}, b AS (SELECT src AS "row", dst AS col, CAST(wgt AS DOUBLE) AS val FROM e UNION ALL SELECT dst, src, CAST(wgt AS DOUBLE) FROM e)
        SELECT "row", col, {_value} AS val FROM b GROUP BY 1, 2{_having}""",
    )
    def _symmetrise(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        e = fx.transitions(spark, sf_dir)
        return graphs.symmetrise(e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("wgt").cast("double").alias("val")), op)


    @register(
        f"symmetrize_sparse_{_op}",
        f"""WITH {fx.SUCCESSIONS}, b AS (SELECT src AS "row", dst AS col, CAST(wgt AS DOUBLE) AS val FROM e UNION ALL SELECT dst, src, CAST(wgt AS DOUBLE) FROM e)
        SELECT "row", col, {_value} AS val FROM b GROUP BY 1, 2{_having}""",
    )
    def _symmetrise_sparse(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        """Most entries are on one side only."""
        e = fx.successions(spark, sf_dir)
        return graphs.symmetrise(e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("wgt").cast("double").alias("val")), op)


@register(
    "conjugate_gradient",
    f"WITH {fx.SUCCESSIONS}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT id, CAST(id % 10 + 1 AS DOUBLE) AS x FROM v",
)
def conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Laplacian plus the unit matrix with a right side whose solution is known."""
    e = graphs.fix(fx.successions(spark, sf_dir))
    n = graphs.vertices_of(e).unionByName(graphs.vertices_of(fx.successions(spark, sf_dir))).distinct()
    degree = n.join(e.groupBy(F.col("src").alias("id")).agg(F.sum("wgt").alias("d")), "id", "left")
    m = e.select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("wgt")).cast("double").alias("val")).union(
        degree.select(F.col("id").alias("row"), F.col("id").alias("col"), (1.0 + F.coalesce("d", F.lit(0))).alias("val"))
    )
    b = m.groupBy(F.col("row").alias("id")).agg(F.sum(F.col("val") * (F.col("col") % 10 + 1)).alias("b"))
    return matrix.conjugate_gradient(m, b, tol=1e-9).select("id", F.round("x", 4).alias("x"))


@register("extract_rows", f'{M}, l AS (SELECT DISTINCT "row", "row" // 10 AS pos FROM m WHERE "row" % 10 = 0) SELECT pos AS "row", col, val FROM m JOIN l USING ("row")')
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.matrix(spark, sf_dir)
    return matrix.extract_rows(m, m.where("row % 10 = 0").select("row", F.floor(F.col("row") / 10).alias("pos")).distinct())


@register("extract_submatrix", f'{M} SELECT "row" - 50 AS "row", col, val FROM m WHERE "row" BETWEEN 50 AND 249')
def extract_submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.extract_submatrix(fx.matrix(spark, sf_dir), 50, 200)


@register("extract_partition", f'{M} SELECT "row", col, val FROM m WHERE "row" % 8 = 3')
def extract_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.matrix(spark, sf_dir)
    return matrix.extract_partition(m, m.select(F.col("row").alias("id")).distinct().withColumn("pid", fx.part_of("id", 8)), 3)


@register("split_colour", f'{M} SELECT CAST(("row" + col) % 3 AS INT) AS colour, "row", col, val FROM m')
def split_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.split_colours(fx.matrix(spark, sf_dir), (F.col("row") + F.col("col")) % 3)


@register("matrix_shuffle", f"{M} SELECT count(*) AS n, sum(val) AS total, count(DISTINCT \"row\") AS n_rows, count(DISTINCT col) AS n_cols FROM m")
def matrix_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any permutation leaves as it is."""
    m = matrix.shuffle(fx.matrix(spark, sf_dir), "both", seed=7)
    return m.agg(F.count("*").alias("n"), F.sum("val").alias("total"), F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_cols"))


@register(
    "doc_term_idf",
    """WITH w AS (SELECT doc_id AS "row", unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS col FROM documents), m AS (SELECT "row", col, count(*) AS val FROM w WHERE col <> '' GROUP BY 1, 2)
    SELECT "row", col, round(val * ln(CAST((SELECT count(DISTINCT "row") FROM m) AS DOUBLE) / count(*) OVER (PARTITION BY col)) + 1e-9, 6) AS val FROM m""",
)
def doc_term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inverse document frequencies of the words of documents."""
    docs = fx.table(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("row"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("col")).where("col <> ''")
    return _rounded(matrix.scale(words.groupBy("row", "col").agg(F.count("*").alias("val")), "idf"))
