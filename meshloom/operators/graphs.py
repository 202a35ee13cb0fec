"""Graphs as edge tables ``(src, dst, wgt)`` with both directions, and vertex tables ``(id, ...)``.

A vertex appears in the vertex table even where it has no edge; an edge table
alone stands for the vertices on its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def swapped(edges: DataFrame) -> DataFrame:
    """The reverse of every edge."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "wgt")


def vertices_of(edges: DataFrame) -> DataFrame:
    """``(id)`` of the vertices on edges."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree, wgt)``: neighbours and their total weight."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("wgt").alias("wgt"))


# -- validity ---------------------------------------------------------------


def check(edges: DataFrame) -> DataFrame:
    """``(violation, n)``: counts of self loops, duplicate edges, edges without a reverse, and unequal weights.

    A duplicate counts once for each copy after the first; a missing reverse once for each directed
    pair; unequal weights once for each undirected pair.  One shuffle by vertex pair serves all.
    """
    lo, hi = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    forward = F.col("src") < F.col("dst")
    pairs = edges.groupBy(lo, hi).agg(
        F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"),
        F.sum(forward.cast("long")).alias("there"),
        F.sum((F.col("src") > F.col("dst")).cast("long")).alias("back"),
        F.min(F.when(forward, F.col("wgt"))).alias("w_there"),
        F.min(F.when(F.col("src") > F.col("dst"), F.col("wgt"))).alias("w_back"),
    )
    over = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    kinds = {
        "duplicate_edge": F.when(F.col("loops") == 0, over("there") + over("back")).otherwise(0),
        "missing_reverse": ((F.col("loops") == 0) & ((F.col("there") == 0) | (F.col("back") == 0))).cast("long"),
        "self_loop": F.col("loops"),
        "unequal_weight": ((F.col("there") > 0) & (F.col("back") > 0) & (F.col("w_there") != F.col("w_back"))).cast("long"),
    }
    sums = pairs.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in kinds.items()))
    return sums.unpivot([], list(kinds), "violation", "n")


def is_valid(edges: DataFrame) -> bool:
    return check(edges).agg(F.sum("n")).first()[0] == 0


def check_weights(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(what, n)``: edge weights below 1, and entries of vertex weights and sizes below 0."""
    found = edges.select(F.lit("edge_weight").alias("what"), (F.col("wgt") <= 0).alias("bad"))
    if vertices is not None:
        for column, what in (("vwgt", "vertex_weight"), ("vsize", "vertex_size")):
            if column in vertices.columns:
                kind = dict(vertices.dtypes)[column]
                bad = F.exists(column, lambda x: x < 0) if kind.startswith("array") else F.col(column) < 0
                found = found.union(vertices.select(F.lit(what), bad))
    return found.groupBy("what").agg(F.sum(F.col("bad").cast("long")).alias("n"))


def fix(edges: DataFrame) -> DataFrame:
    """Drop self loops, add missing reverses, and keep one edge a pair: the least weight of both directions."""
    once = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.min("wgt").alias("wgt"))
    ends = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))
    return once.select(F.explode(ends).alias("e"), "wgt").select("e.src", "e.dst", "wgt")


def symmetrise(matrix: DataFrame, op: str = "sum") -> DataFrame:
    """``A op A'`` of ``(row, col, val)``: sum, max, min or avg.

    Entries on one side only stay as they are under sum and max, vanish under min, and halve under avg.
    The diagonal meets itself.
    """
    both = matrix.select("row", "col", "val").union(matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    n, total = F.count("*").alias("n"), F.sum("val")
    value = {"sum": total, "max": F.max("val"), "min": F.min("val"), "avg": total / 2}[op]
    made = both.groupBy("row", "col").agg(value.alias("val"), n)
    return (made.where("n = 2") if op == "min" else made).select("row", "col", "val")


# -- renumbering ------------------------------------------------------------


def renumber(edges: DataFrame, by: int) -> DataFrame:
    """Shift vertex ids: ``-1`` from files to tables, ``1`` back."""
    return edges.withColumns({"src": F.col("src") + by, "dst": F.col("dst") + by})


def compact_ids(edges: DataFrame) -> DataFrame:
    """``(id, new)``: gapless ids from 0 in the order of ids, numbered range by range."""
    from meshloom.operators.ordering import global_rank

    return global_rank(vertices_of(edges), ["id"], "new")


def reorder(edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """Replace ids by their positions; ``permutation`` is ``(id, pos)``."""
    p = permutation
    return edges.join(p.select(F.col("id").alias("src"), F.col("pos").alias("_s")), "src").join(
        p.select(F.col("id").alias("dst"), F.col("pos").alias("_d")), "dst"
    ).select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "wgt")


def random_order(rows: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """``(id, pos)``: a permutation of the rows that depends on their keys and the seed alone."""
    from meshloom.operators.ordering import global_rank

    return global_rank(rows.select(F.col(key).alias("id")), [F.xxhash64("id", F.lit(seed)), F.col("id")], "pos")


def random_integers(rows: DataFrame, below: int, key: str = "id", seed: int = 0) -> DataFrame:
    """``(id, value)``: integers in ``[0, below)`` that depend on keys and the seed alone."""
    return rows.select(F.col(key).alias("id"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(below)).alias("value"))


# -- parts of graphs --------------------------------------------------------


def subgraph(edges: DataFrame, start: int, n: int) -> DataFrame:
    """Edges inside the ids ``[start, start + n)``, renumbered from 0; the filters reach the scan."""
    inside = F.col("src").between(start, start + n - 1) & F.col("dst").between(start, start + n - 1)
    return renumber(edges.where(inside), -start)


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among ``chosen (id)``."""
    ids = chosen.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges with neither end among ``removed (id)``, as after taking out a separator."""
    ids = removed.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")


def split(placed: DataFrame) -> DataFrame:
    """Edges inside one part, with the part as ``pid``; ``placed`` has ``ps`` and ``pd``."""
    return placed.where("ps = pd").select("src", "dst", "wgt", F.col("ps").alias("pid"))


def split_by_separator(placed: DataFrame, separator: int = 2) -> DataFrame:
    """Edges inside one half once the separator's vertices are gone."""
    return split(placed).where(F.col("pid") != separator)


def boundary_subgraph(placed: DataFrame) -> DataFrame:
    """Edges whose both ends have a neighbour in another part."""
    rim = placed.where("ps <> pd").select(F.col("src").alias("id")).distinct()
    return induced(placed.select("src", "dst", "wgt"), rim)


def prune_dense(edges: DataFrame, factor: float) -> DataFrame:
    """``(id, degree, dense)``: vertices of at least ``factor`` times the average degree are put off to the last."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    mean = found.agg(F.avg("degree").alias("_mean"))
    return found.join(F.broadcast(mean)).select("id", "degree", (F.col("degree") >= factor * F.col("_mean")).alias("dense"))  # one row


def closed_neighbourhoods(edges: DataFrame) -> DataFrame:
    """``(id, around)``: each vertex's neighbours and itself, sorted."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("_d"))
    return found.select("id", F.array_sort(F.array_union("_d", F.array("id"))).alias("around"))


def _hoods(edges: DataFrame) -> DataFrame:
    """``(id, degree, f, g)``: the number of a vertex's neighbours and 128 bits of their set, whatever its size.

    ``edges`` have no duplicates.  Partial sums come before the shuffle, so a hub is no task's work.
    """
    one, two = (F.bit_xor(F.xxhash64("dst", F.lit(seed))) for seed in (1, 2))
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), one.alias("f"), two.alias("g"))


def compress_identical(edges: DataFrame) -> DataFrame:
    """``(id, cid)``: vertices with equal closed neighbourhoods share the smallest id of them.

    Neighbourhoods are compared by their size and a 128-bit fingerprint.
    """
    from meshloom.plans.scratch import materialize

    with_own = {c: F.col(c).bitwiseXOR(F.xxhash64("id", F.lit(seed))) for c, seed in (("f", 1), ("g", 2))}
    around = materialize(_hoods(edges).withColumns(with_own), "hoods")
    same = around.groupBy("degree", "f", "g").agg(F.min("id").alias("cid"))
    return around.join(same, ["degree", "f", "g"]).select("id", "cid")


def worth_compressing(mapping: DataFrame, fraction: float = 0.85) -> bool:
    """Whether the compressed graph is small enough to bother."""
    row = mapping.agg(F.count("*").alias("n"), F.count_distinct("cid").alias("m")).first()
    return row["n"] > 0 and row["m"] < fraction * row["n"]


def twins(edges: DataFrame, most: int = 64) -> DataFrame:
    """``(id, mate)``: vertices of the same open neighbourhood, at most ``most`` neighbours, paired in order of ids."""
    return _pairs(_hoods(edges).where(F.col("degree") <= most), "degree", "f", "g")


def leaves(edges: DataFrame) -> DataFrame:
    """``(id, mate)``: vertices of degree 1 on the same neighbour, paired in order of ids."""
    single = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("hub")).where("n = 1")
    return _pairs(single, "hub")


def _pairs(rows: DataFrame, *key: str) -> DataFrame:
    """Pair the first with the second of each key, the third with the fourth, and so on."""
    from meshloom.operators.ordering import rank_within

    ranked = rank_within(rows.select("id", F.xxhash64(*key).alias("_k"), *key), "_k", "id", "_rank")
    half = (F.col("_rank") / 2).cast("long")
    both = ranked.groupBy("_k", *key, half.alias("_half")).agg(F.min("id").alias("id"), F.max("id").alias("mate"), F.count("*").alias("n"))
    return both.where("n = 2").select("id", "mate")


def islands(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id)`` of vertices without edges."""
    return vertices.select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def restore_islands(islands_: DataFrame, loads: DataFrame, total: float, k: int) -> DataFrame:
    """``(id, pid)``: islands, heaviest first, fill parts up to the average load; ``loads`` is ``(pid, load)`` of all ``k`` parts.

    The running sum of island weights meets the running sum of the room of parts.
    """
    from meshloom.operators.ordering import running_sum

    room = loads.select("pid", F.greatest(F.lit(total / k) - F.col("load"), F.lit(0.0)).alias("room"))
    ends = room.select("pid", F.sum("room").over(Window.orderBy(F.desc("room"), "pid")).alias("end"), "room")  # k rows
    ends = ends.withColumn("begin", F.col("end") - F.col("room"))
    placed = running_sum(islands_.select("id", F.col("vwgt").cast("double").alias("vwgt")), "vwgt", [F.desc("vwgt"), F.col("id")], "upto")
    found = placed.join(F.broadcast(ends), (F.col("upto") - F.col("vwgt") >= F.col("begin")) & (F.col("upto") - F.col("vwgt") < F.col("end")), "left")
    return found.select("id", F.coalesce("pid", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")).alias("pid"))


def reverse_positions(edges: DataFrame) -> DataFrame:
    """``(src, dst, pos, back)``: an edge's place in its source's list, and that of its reverse in the other's."""
    pos = edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("pos"))
    back = pos.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("pos").alias("back"))
    return pos.join(back, ["src", "dst"])


def interfaces(edges: DataFrame, owner_src: Column, owner_dst: Column) -> DataFrame:
    """``(id, interface)``: whether a vertex has a neighbour of another owner."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.max(owner_src != owner_dst).alias("interface"))


def distribute(ids: Column, n: int, workers: int, scheme: str = "block", block: int = 4096) -> Column:
    """The worker of an id in ``[0, n)``: ``block``, ``cyclic`` or ``blockcyclic``."""
    if scheme == "block":
        return F.floor(ids / -(-n // workers)).cast("int")
    if scheme == "cyclic":
        return F.pmod(ids, F.lit(workers)).cast("int")
    if scheme == "blockcyclic":
        return F.pmod(F.floor(ids / block), F.lit(workers)).cast("int")
    raise ValueError(f"unknown scheme {scheme!r}")


# -- multilevel steps -------------------------------------------------------


#: Vertices of a table that goes to all tasks, at most; larger ones are joined as Spark chooses.
SENT = 1 << 19


def sent(vertices: DataFrame, few: bool) -> DataFrame:
    """A table with a row a vertex, as it is joined to edges; ``few`` says that it has ``SENT`` rows at most."""
    return F.broadcast(vertices) if few else vertices


def dealt(edges: DataFrame) -> DataFrame:
    """Edges dealt by ranges of their ends: once they are written so, sums by ``src`` shrink in the tasks that read them.  A hub may take many ranges."""
    return edges.repartitionByRange("src", "dst")


def contract(edges: DataFrame, cmap: DataFrame, few: bool = False, ranged: bool = False) -> DataFrame:
    """Coarse edges: both ends through ``cmap (id, cid)``, weights summed, inner edges dropped.

    ``few`` as for :func:`sent`; ``ranged``: the edges come as :func:`dealt`.
    """
    a = sent(cmap.select(F.col("id").alias("src"), F.col("cid").alias("_s")), few)
    b = sent(cmap.select(F.col("id").alias("dst"), F.col("cid").alias("_d")), few)
    met = edges.join(a, "src").join(b, "dst").where("_s <> _d").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "wgt")
    return (dealt(met) if ranged else met).groupBy("src", "dst").agg(F.sum("wgt").alias("wgt"))


def contract_weights(vertices: DataFrame, cmap: DataFrame, column: str = "vwgt") -> DataFrame:
    """``(id, vwgt)`` of coarse vertices."""
    return vertices.join(cmap, "id").groupBy(F.col("cid").alias("id")).agg(F.sum(column).alias(column))


def project(cmap: DataFrame, coarse: DataFrame) -> DataFrame:
    """``(id, pid)`` of fine vertices from ``coarse (id, pid)``."""
    return cmap.join(coarse.withColumnRenamed("id", "cid"), "cid").select("id", "pid")


def match(edges: DataFrame, weights: DataFrame, cap: float, seed: int = 0, rounds: int = 4, home: DataFrame | None = None, heavy: bool = True, few: bool = False) -> DataFrame:
    """``(id, cid)``: heavy-edge matching by handshakes; the coarse id is the smaller of a pair.

    In a round each free vertex proposes to its heaviest free neighbour (ties by a hash of the pair,
    the same from both sides); mutual proposals match.  Pairs above ``cap`` never form, nor, with
    ``home (id, pid)``, pairs of different homes.  Without ``heavy``, weights of edges do not count.
    ``few`` as for :func:`sent`.
    """
    from meshloom.plans.scratch import materialize, release

    w = weights.select("id", "vwgt")
    if home is not None:
        w = w.join(home.withColumnRenamed("pid", "home"), "id")
    else:
        w = w.withColumn("home", F.lit(0))
    side = lambda p: sent(w.select(F.col("id").alias(p), F.col("vwgt").alias(f"_w{p}"), F.col("home").alias(f"_h{p}")), few)
    open_ = edges.join(side("src"), "src").join(side("dst"), "dst").where((F.col("_wsrc") + F.col("_wdst") <= cap) & (F.col("_hsrc") == F.col("_hdst")))
    open_ = open_.select("src", "dst", "wgt")
    if not few:  # else it is read twice for less than it takes to write
        open_ = materialize(open_, "open-edges")
    pairs = None
    for turn in range(rounds):
        tie = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed * 1009 + turn))
        best = open_.groupBy("src").agg(F.max(F.struct(*(["wgt"] if heavy else []), tie.alias("t"), "dst")).getField("dst").alias("to"))
        both = best.groupBy(F.least("src", "to").alias("cid"), F.greatest("src", "to").alias("mate")).agg(F.count("*").alias("n"))
        new = materialize(both.where("n = 2").select("cid", "mate"), "matched")
        pairs = new if pairs is None else pairs.union(new)
        if turn == rounds - 1:
            break
        gone = new.select(F.col("cid").alias("id")).union(new.select("mate"))
        before, open_ = open_, materialize(without(open_, sent(gone, few)), "open-edges")
        release(before)
        if open_.isEmpty():
            break
    release(open_)
    mates = pairs.select(F.col("mate").alias("id"), "cid")
    return w.select("id").join(mates, "id", "left").select("id", F.coalesce("cid", "id").alias("cid"))
