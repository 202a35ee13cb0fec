"""Sparse matrices as ``(row, col, val)`` tables without zeros stored twice.

Statistics of rows and columns come from aggregates joined back, or from
windows where an operator needs an order within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OTHER = {"row": "col", "col": "row"}


def _val() -> Column:
    return F.col("val")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def sums(m: DataFrame, what: str = "row") -> DataFrame:
    return m.groupBy(what).agg(F.sum("val").alias("sum"))


def squared_norms(m: DataFrame, what: str = "row") -> DataFrame:
    return m.groupBy(what).agg(F.sum(_val() * _val()).alias("sqnorm"))


def _with(m: DataFrame, what: str, **stats: Column) -> DataFrame:
    """Entries with statistics of their row or column, from one aggregate joined back."""
    return m.join(m.groupBy(what).agg(*(c.alias(k) for k, c in stats.items())), what)


def normalise(m: DataFrame, what: str = "row", norm: int = 2) -> DataFrame:
    """Divide by the 1- or 2-norm of the row or column; those with a sum of zero or less stay."""
    met = _with(m, what, _s=F.sum(_val() * _val()) if norm == 2 else F.sum("val"))
    size = F.sqrt("_s") if norm == 2 else F.col("_s")
    return met.select("row", "col", F.when(F.col("_s") > 0, _val() / size).otherwise(_val()).alias("val"))


def _power(p: float) -> Column:
    return F.when(_val() != 0, F.lit(0.1) + F.signum("val") * F.pow(F.abs("val"), F.lit(p))).otherwise(_val())


def _entry_scale(kind: str) -> Column | None:
    """Scalings of single entries."""
    powers = {"sqrt": 0.5, "pow25": 0.25, "pow65": 0.65, "pow75": 0.75, "pow85": 0.85}
    if kind in powers:
        return _power(powers[kind])
    if kind == "log":
        return F.when(_val() != 0, F.lit(1.0) + F.signum("val") * F.log2(F.abs("val"))).otherwise(_val())
    return None


def scale(m: DataFrame, kind: str, n_rows: int | None = None) -> DataFrame:
    """Scale entries: ``maxtf``, ``maxtf2``, ``sqrt``, ``pow25``, ``pow65``, ``pow75``, ``pow85``, ``log``, ``idf``, ``idf2``.

    The inverse document frequencies count ``n_rows`` rows, or those that occur.
    """
    if (entry := _entry_scale(kind)) is not None:
        return m.select("row", "col", entry.alias("val"))
    if kind in ("maxtf", "maxtf2"):
        floor, share = (0.5, 0.5) if kind == "maxtf" else (0.1, 0.9)
        met = _with(m, "row", _m=F.max(F.abs("val")))
        return met.select("row", "col", (F.lit(floor) + share * _val() / F.col("_m")).alias("val"))
    counts = m.groupBy("col").agg(F.count("*").alias("_df"))
    rows = F.lit(n_rows).cast("long") if n_rows is not None else None
    facts = m.agg(F.count_distinct("row").alias("_rows")) if n_rows is None else m.limit(1).select(rows.alias("_rows"))
    if kind == "idf":
        met = m.join(counts, "col").join(F.broadcast(facts))  # one row
        return met.select("row", "col", (_val() * F.ln(F.col("_rows") / F.col("_df"))).alias("val"))
    if kind == "idf2":
        base = counts.agg(F.greatest(F.lit(10), F.floor(0.5 * F.sum("_df") / F.count("*"))).cast("long").alias("_bg"))
        met = m.join(counts, "col").join(F.broadcast(facts)).join(F.broadcast(base))  # one row each
        return met.select("row", "col", (_val() * F.ln((F.col("_rows") + 2 * F.col("_bg")) / (F.col("_bg") + F.col("_df")))).alias("val"))
    raise ValueError(f"unknown scaling {kind!r}")


def prune(m: DataFrame, what: str, least: int, most: int) -> DataFrame:
    """Keep rows or columns with so many entries; ids stay."""
    return _with(m, what, _n=F.count("*")).where(F.col("_n").between(least, most)).select("row", "col", "val")


def low_filter(m: DataFrame, what: str, norm: int, fraction: float) -> DataFrame:
    """Keep each row's (or column's) largest entries until their norm sum passes a fraction; the crossing one stays.

    Equal values are taken in order of their ids.
    """
    size = _val() * _val() if norm == 2 else F.abs("val")
    by = Window.partitionBy(what).orderBy(F.desc("_size"), _OTHER[what])
    sized = m.withColumn("_size", size)
    before = F.coalesce(F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("_size").over(Window.partitionBy(what))
    return sized.withColumns({"_before": before, "_total": total}).where(F.col("_before") <= fraction * F.col("_total")).select("row", "col", "val")


def topk_plus(m: DataFrame, what: str, k: int, keep: float) -> DataFrame:
    """Keep each row's (or column's) ``k`` largest entries and any other of at least ``keep``."""
    nth = F.row_number().over(Window.partitionBy(what).orderBy(F.desc("val"), _OTHER[what]))
    return m.withColumn("_nth", nth).where((F.col("_nth") <= k) | (_val() >= keep)).select("row", "col", "val")


def zscore_filter(m: DataFrame, z: float) -> DataFrame:
    """Keep entries above ``z`` over the number of entries in their row."""
    return _with(m, "row", _n=F.count("*")).where(_val() > z / F.col("_n")).select("row", "col", "val")


def compact_columns(m: DataFrame) -> DataFrame:
    """Renumber columns from 0 by falling frequency, then by id."""
    from meshloom.operators.ordering import global_rank

    counts = global_rank(m.groupBy("col").agg(F.count("*").alias("n")), [F.desc("n"), F.col("col")], "new")
    return m.join(counts.select("col", "new"), "col").select("row", F.col("new").alias("col"), "val")


def extract_rows(m: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a list ``(row, pos)``, renumbered by their place in it."""
    return m.join(rows.withColumnRenamed("pos", "_pos"), "row").select(F.col("_pos").alias("row"), "col", "val")


def extract_submatrix(m: DataFrame, start: int, n: int) -> DataFrame:
    """Consecutive rows, renumbered from 0; columns stay."""
    return m.where(F.col("row").between(start, start + n - 1)).select((F.col("row") - start).alias("row"), "col", "val")


def extract_partition(m: DataFrame, part: DataFrame, pid: int) -> DataFrame:
    """Rows of one part, ids as they are."""
    return m.join(part.where(F.col("pid") == pid).select(F.col("id").alias("row")), "row", "left_semi")


def split_colours(m: DataFrame, colour: Column) -> DataFrame:
    """Entries with the matrix that they go to, as ``colour``."""
    return m.select(colour.cast("int").alias("colour"), "row", "col", "val")


def shuffle(m: DataFrame, what: str = "both", seed: int = 0, symmetric: bool = False) -> DataFrame:
    """Permute row ids, column ids or both, by hashed order; ``symmetric`` uses one permutation for both."""
    from meshloom.operators.ordering import global_rank

    def permuted(ids: DataFrame, salt: int) -> DataFrame:
        ranked = global_rank(ids.distinct(), [F.xxhash64("id", F.lit(seed + salt)), F.col("id")], "_rank")
        places = global_rank(ids.distinct(), ["id"], "_place").select(F.col("id").alias("_to"), "_place")
        return ranked.join(places, F.col("_rank") == F.col("_place")).select("id", "_to")

    both = m.select(F.col("row").alias("id")).union(m.select("col"))
    out = m
    for k, side in enumerate(("row", "col")):
        if what in (side, "both"):
            ids = both if symmetric else m.select(F.col(side).alias("id"))
            p = permuted(ids, 0 if symmetric else k).withColumnsRenamed({"id": side, "_to": f"_{side}"})
            out = out.join(p, side).drop(side).withColumnRenamed(f"_{side}", side)
    return out.select("row", "col", "val")


def similarity(m: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """``(i, j, sim)`` of ``pairs (i, j)`` of rows: ``cos``, ``jac``, ``min`` or ``amin``, over whole rows."""
    stats = m.groupBy("row").agg(F.sum("val").alias("s"), F.sum(_val() * _val()).alias("q"))
    side = lambda x: stats.select(F.col("row").alias(x), F.col("s").alias(f"s{x}"), F.col("q").alias(f"q{x}"))
    left = pairs.join(m.select(F.col("row").alias("i"), "col", F.col("val").alias("vi")), "i")
    met = left.join(m.select(F.col("row").alias("j"), "col", F.col("val").alias("vj")), ["j", "col"])
    shared = met.groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("dot"), F.sum(F.least("vi", "vj")).alias("least"))
    all_ = pairs.join(shared, ["i", "j"], "left").join(side("i"), "i").join(side("j"), "j")
    dot, least = F.coalesce("dot", F.lit(0.0)), F.coalesce("least", F.lit(0.0))
    value = {
        "cos": F.when((F.col("qi") * F.col("qj")) > 0, dot / F.sqrt(F.col("qi") * F.col("qj"))).otherwise(0.0),
        "jac": dot / (F.col("qi") + F.col("qj") - dot),
        "min": least / (F.col("si") + F.col("sj") - least),
        "amin": least / F.col("si"),
    }[kind]
    return all_.select("i", "j", value.alias("sim"))


def similar_rows(m: DataFrame, query: DataFrame, kind: str = "cos", top: int = 10, least: float = 0.0) -> DataFrame:
    """``(qid, row, sim)``: the ``top`` rows most similar to each query ``(qid, col, val)``, ties by row id.

    Queries meet rows through the columns they share; partial sums come before the shuffle.
    """
    q = query.select("qid", "col", F.col("val").alias("qv"))
    shared = q.join(m, "col").groupBy("qid", "row").agg(F.sum(F.col("qv") * _val()).alias("dot"), F.sum(F.least("qv", "val")).alias("low"))
    qs = query.groupBy("qid").agg(F.sum("val").alias("qs"), F.sum(_val() * _val()).alias("qq"))
    rs = m.groupBy("row").agg(F.sum("val").alias("rs"), F.sum(_val() * _val()).alias("rq"))
    met = shared.join(qs, "qid").join(rs, "row")
    value = {
        "cos": F.col("dot") / F.sqrt(F.col("qq") * F.col("rq")),
        "jac": F.col("dot") / (F.col("qq") + F.col("rq") - F.col("dot")),
        "min": F.col("low") / (F.col("qs") + F.col("rs") - F.col("low")),
        "amin": F.col("low") / F.col("qs"),
    }[kind]
    scored = met.select("qid", "row", F.round(value, 6).alias("sim")).where(F.col("sim") >= least)
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "row"))
    return scored.withColumn("_nth", nth).where(F.col("_nth") <= top).drop("_nth")


def conjugate_gradient(m: DataFrame, b: DataFrame, tol: float = 1e-8, most: int = 200) -> DataFrame:
    """``(id, x)`` with ``m x = b`` for a symmetric positive definite matrix, by diagonally preconditioned steps.

    ``b`` is ``(id, b)``.  A step is one join over the entries and sums of three numbers; it is written, so
    that lineage stays short.  It ends once the residual is ``tol`` times ``b``; ``ArithmeticError`` if it is
    not after ``most`` steps.
    """
    from meshloom.plans.scratch import materialize, release

    m = materialize(m.select("row", "col", "val"), "system")
    diagonal = m.where("row = col").groupBy(F.col("row").alias("id")).agg(F.sum("val").alias("d"))
    by = F.when(F.col("d") != 0, 1 / F.col("d")).otherwise(0.0)
    rows = b.join(diagonal, "id", "left").select("id", F.lit(0.0).alias("x"), F.col("b").cast("double").alias("r"), F.coalesce(by, F.lit(0.0)).alias("by"))
    state = materialize(rows.withColumn("p", F.col("by") * F.col("r")), "state")
    dots = lambda s: s.agg(F.sum(F.col("r") * F.col("by") * F.col("r")).alias("rho"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
    at = dots(state)
    rho, goal = at["rho"] or 0.0, (at["rr"] or 0.0) * tol * tol
    for step_ in range(most + 1):
        if (at["rr"] or 0.0) <= goal:
            break
        if step_ == most or not rho:
            raise ArithmeticError(f"the residual is {(at['rr'] or 0.0) ** 0.5:g} after {step_} steps")
        q = m.join(state.select(F.col("id").alias("col"), "p"), "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("val") * F.col("p")).alias("q"))
        met = materialize(state.join(q, "id", "left").withColumn("q", F.coalesce("q", F.lit(0.0))), "products")
        slope = met.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        step = rho / slope if slope else 0.0
        new = met.select("id", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "by", "p")
        new = materialize(new, "state")
        at = dots(new)
        turn, rho = (at["rho"] / rho if rho else 0.0), at["rho"]
        release(met, state)
        state = new.withColumn("p", F.col("by") * F.col("r") + turn * F.col("p"))
    return state.select("id", "x")
