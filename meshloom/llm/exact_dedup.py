"""Exact deduplication by two passes over a counting Bloom filter, in native functions only.

Pass 1 hashes the normalised text of every row into ``HASHES`` tables of slots
and counts the rows of each slot; slots with two rows or more become bits of
4 KB bitmaps.  To count them, slot numbers shuffle, ``HASHES`` of 8 bytes a row
and summed before; no text, id or digest does.  Pass 2 looks each row up: a row
with a clear bit in some table is certainly unlike all others and passes
straight through.  Only the rest shuffle, as narrow rows, to be grouped by a
SHA-256 of their normalised text, so the filter never decides that rows are
equal and its false positives cost time only.  :func:`drop_copies` then looks up
whole rows in a second filter, of the rows that go and of those that repeat:
whole rows shuffle only where that filter lets them.

The bitmaps are broadcast.  Their size is bounded by ``max_filter_bits``
whatever the input.  With the default, false suspects are one row in 270 at
30 million rows; beyond, as the tables fill up, more narrow rows shuffle (one in
eight at 200 million, nearly all from 3 thousand million on), and the result
stays the same.

Defined cases: a null text counts as empty; all empty texts are equal.  A null
``doc_id`` ranks after all others.  Rows that repeat both text and id count as
members of their group, and :func:`drop_copies` keeps one of them.  An empty
table gives an empty result.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.plans.scratch import materialize

HASHES = 2
#: Bits of all tables together at most: 128 MB of bitmaps.
MAX_FILTER_BITS = 1 << 30
_BITMAP_BITS = 1 << 15  # of a bitmap that bitmap_construct_agg makes


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09-0x0D."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def _slot(digest: Column, table: int, bits: int) -> Column:
    """The position in a table, 1-based as the bitmap functions count."""
    return F.pmod(F.xxhash64(digest, F.lit(table)), F.lit(bits)) + F.lit(1) + F.lit(table) * F.lit(bits)


def table_bits(rows: int, max_filter_bits: int = MAX_FILTER_BITS) -> int:
    """Bits of one table for so many rows: a power of two, 16 bits a row or more up to the bound."""
    wanted = max(_BITMAP_BITS, 1 << (16 * max(rows, 1) - 1).bit_length())
    return max(_BITMAP_BITS, min(wanted, max_filter_bits // HASHES))


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: ``(bucket, bitmap)`` of the slots that two rows or more fall into."""
    slots = digests.select(F.explode(F.array(*(_slot(F.col("digest"), k, bits) for k in range(HASHES)))).alias("slot"))
    often = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return often.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def member_filter(keys: DataFrame, key: str, max_filter_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, int]:
    """Bitmaps and table bits of a filter that lets all of the keys pass, written once."""
    bits = table_bits(keys.count(), max_filter_bits)
    slots = keys.select(F.explode(F.array(*(_slot(F.col(key), k, bits) for k in range(HASHES)))).alias("slot"))
    bitmaps = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    return materialize(bitmaps, "filter"), bits


def passing(rows: DataFrame, key: str, held: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose key may be among the filter's, before they shuffle to a join that decides."""
    return flag_suspects(rows, held[0], held[1], "_passes", key).where("_passes").drop("_passes")


def flag_suspects(rows: DataFrame, bitmaps: DataFrame, bits: int, flag: str, key: str = "digest") -> DataFrame:
    """Pass 2: adds the column ``flag``, true where every table has the bit of the row's key set."""
    suspect = F.lit(True)
    held = rows
    for k in range(HASHES):
        slot = _slot(F.col(key), k, bits)
        held = held.withColumns({f"_bucket{k}": F.bitmap_bucket_number(slot), f"_bit{k}": F.bitmap_bit_position(slot)})
        side = bitmaps.select(F.col("bucket").alias(f"_bucket{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        held = held.join(F.broadcast(side), f"_bucket{k}", "left")  # at most max_filter_bits / 8 bytes
        byte = F.expr(f"cast(conv(hex(substring(_bitmap{k}, cast(_bit{k} div 8 + 1 as int), 1)), 16, 10) as int)")
        bit = F.getbit(byte, (F.col(f"_bit{k}") % 8).cast("int"))
        suspect = suspect & F.coalesce(bit == 1, F.lit(False))
    drop = [f"{name}{k}" for k in range(HASHES) for name in ("_bucket", "_bit", "_bitmap")]
    return held.withColumn(flag, suspect).drop(*drop)


def _keeper() -> Column:
    """Of a group: the id of the row with most code points, then the smallest id, nulls last."""
    return F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"))).getField("doc_id")


def decide(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs (doc_id, text)``."""
    plain = normalised(F.col("text"))
    hashed = materialize(
        docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), F.unhex(F.sha2(plain, 256)).alias("digest")),
        "digests",
    )
    bits = table_bits(hashed.count(), max_filter_bits)
    flagged = flag_suspects(hashed, repeated_slots(hashed, bits), bits, "suspect")
    suspects = flagged.where("suspect")
    groups = suspects.groupBy("digest").agg(_keeper().alias("keep_id"), F.count("*").alias("group_size"))
    # Written first, so that both sides of the join are plain shuffles and a large group can be split.
    groups = materialize(groups.withColumnRenamed("digest", "_of"), "groups")
    met = suspects.join(groups, F.col("digest") == F.col("_of")).select("doc_id", "keep_id", "group_size", "digest")
    alone = flagged.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return met.union(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` without copies, all columns; rows that stay do not shuffle, but for those that repeat text and id."""
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    own = F.xxhash64("doc_id", "text")  # finds a row again; digests decide
    hashed = materialize(docs.select("doc_id", own.alias("own"), F.length(F.coalesce("text", F.lit(""))).alias("points"), digest.alias("digest")), "digests")
    bits = table_bits(hashed.count(), max_filter_bits)
    suspects = flag_suspects(hashed, materialize(repeated_slots(hashed, bits), "bitmaps"), bits, "suspect").where("suspect")
    members = suspects.groupBy("digest", "doc_id", "own").agg(F.count("*").alias("n"), F.max("points").alias("points"))
    members = materialize(members.withColumnRenamed("doc_id", "_id"), "members")
    first = F.min(F.struct(-F.col("points"), F.col("_id").isNull(), "_id", "own"))
    # Written first, as in decide, so that a digest with many members can be split when the two are joined.
    keepers = materialize(members.groupBy(F.col("digest").alias("_of")).agg(first.alias("_first")), "keepers")
    kept = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("own") == F.col("_first.own"))
    decided = members.join(keepers, F.col("digest") == F.col("_of")).where(~kept | (F.col("n") > 1))
    decided = materialize(decided.select("_of", "_id", F.col("own").alias("_own"), kept.alias("_once")), "decided")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), own.alias("own"))
    flagged = flag_suspects(rows, *member_filter(decided, "_own", max_filter_bits), "_suspect", "own")
    found = flagged.where("_suspect").withColumns({"digest": F.unhex(F.sha2(normalised(F.col("_row.text")), 256)), "id": F.col("_row.doc_id")})
    met = found.join(decided, (F.col("own") == F.col("_own")) & (F.col("digest") == F.col("_of")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    once = met.where("_once").groupBy("digest", "id", "own").agg(F.first("_row").alias("_row"))
    return flagged.where("not _suspect").select("_row.*").union(met.where("_of is null").select("_row.*")).union(once.select("_row.*"))
