"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, by code point and null last, weigh 5, 2, 1, repeating, and share all
words; a target stops at ``cap`` times its source and the excess is shared anew
by weight.  A source gives whole passes over its documents and a remainder.

Documents hash to cells of their source: blocks of a permuted order.  A pass
takes each block once; the remainder takes blocks in order up to a boundary
block, whose documents are taken one by one as they fit.  So a source's words
miss its target by less than the smallest document that was left there.

The blocks then go to output shards.  At each node of a binary tree over the
shards, one multivariate-hypergeometric draw splits every source's block quota
between both halves, exactly; a shard draws its quota as a run of its source's
permuted blocks, disjoint from all others, and orders its documents by a hash.

The driver sees sources and blocks, not documents: ``MAX_CELLS`` blocks in all
and one more a source.  Sources are few (there is a weight for each).

Defined cases: null texts and texts without words have size 0 and go with their
block; a null source is a source; repeated rows are taken each for itself;
sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.plans.scratch import materialize

#: Blocks of all sources together, about.
MAX_CELLS = 1 << 15
#: Documents of a block at least, where there are as many.
MIN_BLOCK = 2048
CYCLE = (5, 2, 1)


def n_words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Share the sum of ``sizes`` by weight; none above ``cap`` times its size, the excess reshared."""
    total, open_ = float(sum(sizes)), set(range(len(sizes)))
    given = [0.0] * len(sizes)
    while open_:
        left = total - sum(given[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        above = {i for i in open_ if share[i] > cap * sizes[i]}
        if not above:
            for i in open_:
                given[i] = share[i]
            break
        for i in above:
            given[i] = cap * sizes[i]
        open_ -= above
    return given


@dataclass
class Source:
    """What the driver knows of a source: ``cells`` maps a block to its words and rows."""

    rank: int
    size: int
    target: float
    cells: dict[int, int]


def splitting_tree(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Split block quotas, one a source, among shards of equal block counts: ``[shard, source]``."""
    if n_shards == 1:
        return quotas[None, :]
    left = n_shards // 2
    n = int(quotas.sum()) * left // n_shards
    drawn = rng.multivariate_hypergeometric(quotas, n, method="marginals") if quotas.sum() else quotas * 0
    return np.vstack([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, n_shards - left, rng)])


def _fit(block: pd.DataFrame) -> pd.DataFrame:
    """Take the documents of a boundary block, in permuted order, as long as they fit."""
    block = block.sort_values(["_place", "size"], ignore_index=True)
    left = int(block["_edge_words"].iloc[0])
    shards = []
    for size, whole, edge in zip(block["size"], block["_shards"], block["_edge_shard"], strict=True):
        fits = size <= left
        left -= size if fits else 0
        shards.append([*whole, int(edge)] if fits else list(whole))
    return block.assign(_shards=shards)


def _placed(rows: DataFrame, known: DataFrame, blocks: DataFrame | None, seed: int) -> DataFrame:
    """Adds each row's place in the permuted order, its block, and what the plan says of that."""
    rows = rows.withColumn("_place", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source")))  # a row a source
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("_place", "_rank"), F.col("_n_cells")).cast("int"))
    return rows if blocks is None else rows.join(F.broadcast(blocks), ["_rank", "_cell"])  # a row a block


def _prepare(docs: DataFrame, n_shards: int, cap: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes of all rows, the sources, and the plan of the blocks."""
    spark = docs.sparkSession
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    found = (
        sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
        .orderBy(F.col("source").isNull(), "source").collect()
    )
    wanted = targets([r["size"] for r in found], [CYCLE[i % len(CYCLE)] for i in range(len(found))], cap)
    per_cell = max(MIN_BLOCK, -(-sum(r["rows"] for r in found) // MAX_CELLS))
    known = spark.createDataFrame(
        [(r["source"], i, max(1, r["rows"] // per_cell), r["size"], wanted[i]) for i, r in enumerate(found)],
        "_source string, _rank int, _n_cells long, _source_size long, _target double",
    )
    cells: list[dict[int, int]] = [{} for _ in found]
    for r in _placed(sized, known, None, seed).groupBy("_rank", "_cell").agg(F.sum("size").alias("words")).collect():
        cells[r["_rank"]][r["_cell"]] = r["words"]
    sources = [Source(i, r["size"], wanted[i], cells[i]) for i, r in enumerate(found)]
    blocks = spark.createDataFrame(
        _plan(sources, n_shards, seed), "_rank int, _cell int, _shards array<int>, _edge_shard int, _edge_words long"
    )
    return sized, known, blocks


def _edge(placed: DataFrame) -> DataFrame:
    """Documents of boundary blocks, one block a source, with ``_shards`` as decided for each."""
    rows = placed.where("_edge_words is not null").drop("_source")
    return rows.groupBy("_rank").applyInPandas(_fit, rows.schema)


def mix(docs: DataFrame, n_shards: int = 16, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken, shards, place)``, a row for each row of ``docs``.

    ``docs`` has ``doc_id, text, source``; ``shards`` has the output shard of each copy that the mix takes, as the
    tree deals them, and ``taken`` is their words; ``place`` orders the documents of a shard.
    """
    sized, known, blocks = _prepare(docs, n_shards, cap, seed)
    placed = _placed(sized, known, blocks, seed)
    both = placed.where("_edge_words is null").drop("_source").unionByName(_edge(placed))
    return both.select(
        "doc_id", "size", "source", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("size") * F.size("_shards")).cast("long").alias("taken"), F.col("_shards").alias("shards"), _local(seed).alias("place"),
    )


def _local(seed: int) -> Column:
    """The place of a document within any shard."""
    return F.xxhash64("doc_id", F.lit(seed + 2))


def mixed(docs: DataFrame, n_shards: int = 16, cap: float = 3.0, seed: int = 17, shard: str | None = None) -> DataFrame:
    """The rows of the mix: all columns of ``docs``, each row as often as the mix takes it.

    With ``shard``, a column of that name has the output shard.  Blocks are decided whole, so rows look
    their copies up without a shuffle; only the rows of boundary blocks meet their decisions in a join.
    """
    sized, known, blocks = _prepare(docs, n_shards, cap, seed)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    placed = _placed(docs.select("doc_id", "source", whole), known, blocks, seed)
    same = Window.partitionBy("_rank", "doc_id")
    size = n_words(F.col("_row.text"))
    ours = placed.where("_edge_words is not null").withColumn("_nth", F.row_number().over(same.orderBy(size)))
    decided = _edge(_placed(sized, known, blocks, seed)).withColumn("_nth", F.row_number().over(same.orderBy("size")))
    decided = decided.select(F.col("_rank").alias("_r"), F.col("doc_id").alias("_id"), F.col("_nth").alias("_n"), F.col("_shards").alias("_own"))
    met = ours.join(decided, (F.col("_rank") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_nth") == F.col("_n")))
    copies = placed.where("_edge_words is null").select("_row", F.explode("_shards").alias("_shard")).union(
        met.select("_row", F.explode("_own").alias("_shard"))
    )
    return copies.select("_row.*", *([F.col("_shard").alias(shard)] if shard else []))


def write_mix(docs: DataFrame, path: str, n_shards: int = 16, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Write the mix under ``path/shard=K``, each shard's rows in hashed order; returns the table written.

    ``docs`` must not have a column ``shard``.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard, which the written table needs for itself")
    rows = mixed(docs, n_shards, cap, seed, "shard")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(64)))
    dealt = dealt.repartition(F.col("shard"), F.col("_salt")).sortWithinPartitions("shard", _local(seed))
    dealt.drop("_salt").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _plan(sources: list[Source], n_shards: int, seed: int) -> list[tuple]:
    """A row a block: the shards of the copies it gives whole, and the shard and words of a boundary block."""
    rng = np.random.default_rng(seed)
    blocks: list[list[tuple[int, bool]]] = []
    rest: dict[int, int] = {}
    for s in sources:
        want = round(s.target)
        passes = want // s.size if s.size else 0
        left = want - passes * s.size
        order = rng.permutation(sorted(s.cells)) if s.cells else []
        drawn = [(int(c), False) for _ in range(passes) for c in order]
        for cell in order:
            if left <= 0:
                break
            if s.cells[int(cell)] > left:
                drawn.append((int(cell), True))
                rest[s.rank] = left
                break
            drawn.append((int(cell), False))
            left -= s.cells[int(cell)]
        blocks.append([drawn[i] for i in rng.permutation(len(drawn))])
    split = splitting_tree(np.array([len(b) for b in blocks], dtype=np.int64), n_shards, rng)
    rows = []
    for s, drawn in zip(sources, blocks, strict=True):
        shards: dict[int, list[int]] = {}
        edge: dict[int, int] = {}
        for (cell, partly), shard in zip(drawn, np.repeat(np.arange(n_shards), split[:, s.rank]), strict=True):
            if partly:
                edge[cell] = int(shard)
            else:
                shards.setdefault(cell, []).append(int(shard))
        rows += [(s.rank, c, sorted(shards.get(c, [])), edge.get(c), rest[s.rank] if c in edge else None) for c in s.cells]
    return rows
