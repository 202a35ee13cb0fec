"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to cells of a ring; every shard owns ``virtual_nodes`` arcs of cells.
A key belongs to the shard of its arc while that shard has room; keys past a
full shard continue clockwise to the next shard with room.  Room is exact: the
capacities add up to the number of rows and differ by one at most, so all
shards fill up and counts differ by one at most (law ``rows``), while most keys
stay where an unbounded ring would put them.

The driver plans over the row counts of cells (``2 ** cell_bits`` numbers at
most, whatever the input) and hands back pieces of cells: ranks ``[from, to)``
go to a shard, at slots from a base.  The rows shuffle once, as narrow
``(id, size, checksum)`` rows dealt by ranges of cell and place.

Defined cases: a null text has size 1 and the checksum of no bytes; a null id
hashes like any other value; repeated ids share a cell and take separate slots;
an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.operators.ordering import rank_within
from meshloom.plans.scratch import materialize

CELL_BITS = 16
VIRTUAL_NODES = 128
PIECE = T.StructType(
    [T.StructField("cell", T.IntegerType())]
    + [T.StructField("pieces", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("from", "to", "shard", "base")])))]
)


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """``(cell, shard)`` of the virtual nodes, by cell; adding a shard moves no node of the others."""
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for node in range(virtual_nodes):
            turn = 0
            while (cell := xxhash.xxh64_intdigest(f"{shard}/{node}/{turn}") >> (64 - cell_bits)) in taken:
                turn += 1
            taken[cell] = shard
    return sorted(taken.items())


def plan(counts: dict[int, int], n_shards: int, nodes: list[tuple[int, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Pieces ``(from, to, shard, base slot)`` of every cell that has rows."""
    total = sum(counts.values())
    room = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    given = [0] * n_shards
    places = [cell for cell, _ in nodes]
    pieces: dict[int, list[tuple[int, int, int, int]]] = {}
    over: list[tuple[int, int, int]] = []

    def put(cell: int, start: int, n: int, shard: int) -> int:
        part = min(n, room[shard])
        if part:
            pieces.setdefault(cell, []).append((start, start + part, shard, given[shard]))
            room[shard] -= part
            given[shard] += part
        return part

    for cell in sorted(counts):
        node = bisect.bisect_left(places, cell) % len(nodes)
        done = put(cell, 0, counts[cell], nodes[node][1])
        if done < counts[cell]:
            over.append((cell, done, node))
    for cell, start, node in over:
        step = 1
        while start < counts[cell]:
            start += put(cell, start, counts[cell] - start, nodes[(node + step) % len(nodes)][1])
            step += 1
    return pieces


def assign(
    docs: DataFrame, n_shards: int = 8, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, a row for each row of ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = F.xxhash64("doc_id")
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).cast("long").alias("text_crc32"),
            F.shiftrightunsigned(place, 64 - cell_bits).cast("int").alias("cell"),
            place.alias("place"),
            F.monotonically_increasing_id().alias("nth"),  # tells rows of one id apart
        ),
        "ring-rows",
    )
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    pieces = plan(counts, n_shards, ring(n_shards, virtual_nodes, cell_bits))
    # At most 2 ** cell_bits cells; a cell is cut only where a shard fills up.
    table = spark.createDataFrame([(c, [tuple(map(int, p)) for p in v]) for c, v in pieces.items()], PIECE)
    # Rows are dealt by ranges of cell and order, so a cell with a hot id is many tasks' work.
    ranked = rank_within(rows.withColumn("_order", F.struct("place", "text_crc32", "size", "nth")), "cell", "_order", "_rank")
    own = F.filter("pieces", lambda p: (p["from"] <= F.col("_rank")) & (F.col("_rank") < p["to"]))[0]
    placed = ranked.join(F.broadcast(table), "cell").withColumn("_own", own)
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("_own.shard").cast("int").alias("shard"),
        (F.col("_own.base") + F.col("_rank") - F.col("_own.from")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> DataFrame:
    """Write whole rows under ``path/shard=K``, sorted by slot in each file; returns the table written.

    The placements meet their rows by id, so ids must not repeat here; ``docs`` must not have columns ``shard`` or ``slot``.
    """
    if clash := {"shard", "slot"}.intersection(docs.columns):
        raise ValueError(f"docs has columns that the written table needs for itself: {sorted(clash)}")
    placed = assign(docs.select("doc_id", "text"), n_shards).select(F.col("doc_id").alias("_id"), "shard", "slot")
    whole = docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    whole.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
