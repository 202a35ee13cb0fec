"""Frequent sets of items with the transactions that hold them, kept as words of 64 transactions.

A row ``(items, block, bits)`` says which of the 64 transactions of a block hold all of a set.  Sets of three and more come
from two sets that differ in their last item: their words are joined by block and ANDed, so that baskets are read
again for pairs only, and only sets whose parts are frequent are tried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.ordering import global_rank
from meshloom.plans.scratch import materialize, release

#: Transactions in a word.
WORD = 64


@dataclass(frozen=True)
class Itemsets:
    """``found (items, support)``, ``words (items, block, bits)`` of the same sets, ``numbers (tid, block, bit)`` of transactions."""

    found: DataFrame
    words: DataFrame
    numbers: DataFrame

    def tids(self) -> DataFrame:
        """``(items, tid)``: a row for each set and transaction that holds it."""
        bits = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), i -> getbit(bits, i) = 1)"))
        return self.words.select("items", "block", bits.alias("bit")).join(self.numbers, ["block", "bit"]).select("items", "tid")

    def each(self, emit: Callable[[list, int, list], None], piece: int = 1024) -> None:
        """Call ``emit(items, support, tids)`` where a set's row is; it must be picklable.

        The transactions come sorted, in pieces of ``piece`` words: a set in more of them is emitted once a piece, with its whole support.
        """
        bits = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), i -> getbit(bits, i) = 1)"))
        each = self.words.select("items", "block", bits.alias("bit")).join(self.numbers, ["block", "bit"])
        parts = each.groupBy("items", F.floor(F.col("block") / piece).alias("piece")).agg(F.array_sort(F.collect_list("tid")).alias("tids"))
        parts.join(self.found, "items").foreach(lambda r: emit(list(r["items"]), r["support"], list(r["tids"])))


def vertical_itemsets(transactions: DataFrame, least: int, most: int = -1, min_len: int = 1, max_len: int = 3) -> Itemsets:
    """Frequent sets of items of ``transactions (tid, item)``, sorted within, held by ``least`` to ``most`` transactions.

    ``most`` and ``max_len`` -1: no bound.  ``most`` bounds what is extended, too, as for ``analytics.itemsets``.  Repeated rows count
    once; rows with a null are left out; no rows give no sets.
    """
    if least < 1 or min_len < 1:
        raise ValueError("least and min_len must be at least 1")
    pairs = materialize(transactions.where("tid is not null and item is not null").select("tid", "item").distinct(), "transactions")
    inside = F.col("support") >= least
    if most >= 0:
        inside &= F.col("support") <= most
    frequent = pairs.groupBy("item").agg(F.count("*").alias("support")).where(inside).select("item")
    kept = materialize(pairs.join(frequent, "item", "left_semi"), "frequent-items")
    ranked = global_rank(kept.select("tid").distinct(), ["tid"], "n")
    numbers = materialize(ranked.select("tid", F.floor(F.col("n") / WORD).alias("block"), (F.col("n") % WORD).cast("int").alias("bit")), "numbers")
    base = materialize(kept.join(numbers, "tid").select("tid", "item", "block", "bit"), "numbered-items")
    word = F.expr("bit_or(shiftleft(1L, bit))").alias("bits")

    def counted(words: DataFrame) -> tuple[DataFrame, DataFrame]:
        words = materialize(words, "words")
        counts = materialize(words.groupBy("items").agg(F.sum(F.bit_count("bits").cast("long")).alias("support")).where(inside), "itemsets")
        good = materialize(words.join(counts.select("items"), "items", "left_semi"), "frequent-words")
        release(words)
        return counts, good

    levels, size = [counted(base.groupBy(F.array("item").alias("items"), "block").agg(word))], 1
    while not levels[-1][0].isEmpty() and size != max_len:
        size += 1
        if size == 2:
            other = base.select("tid", F.col("item").alias("next"))
            words = base.join(other, "tid").where("item < next").groupBy(F.array("item", "next").alias("items"), "block").agg(word)
        else:
            split = levels[-1][1].select(F.slice("items", 1, size - 2).alias("head"), F.element_at("items", -1).alias("last"), "block", "bits")
            other = split.select("head", "block", F.col("last").alias("next"), F.col("bits").alias("_bits"))
            met = split.join(other, ["head", "block"]).where("last < next")
            words = met.select(F.concat("head", F.array("last", "next")).alias("items"), "block", F.col("bits").bitwiseAND(F.col("_bits")).alias("bits")).where("bits <> 0")
        levels.append(counted(words))
    told = levels[min_len - 1 :] or [tuple(t.limit(0) for t in levels[0])]
    found, words = told[0]
    for more, its in told[1:]:
        found, words = found.union(more), words.union(its)
    return Itemsets(found, words, numbers)
