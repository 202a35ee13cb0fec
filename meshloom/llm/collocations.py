"""Collocations: phrases whose words come together more often than their parts suggest.

A task turns its texts into arrays of word ids, ``SHARD_WORDS`` words or a little
more to a shard, with a mark between pieces and between texts.  Prefix doubling
sorts the suffixes of a shard by their first words: ranks of runs of ``h`` words
make those of ``2 h`` words, until phrases are covered.  Neighbours in that order
share so many first words (their LCP); an interval of neighbours that share ``m``
words is one phrase of ``m`` words, and its length the count.  Intervals leave a
shard as rows ``(lang, phrase, n)``, one a phrase, and are summed by key.  So a
phrase, however frequent, is one row a shard when it shuffles.

Words and pairs are counted in one pass, each greater length in one of its own:
there a phrase leaves the shard only if both its parts of one word less may be
frequent, by a filter of ``MAX_FILTER_BITS`` at most.  What the filter lets pass
in error costs a row and is counted like all others, so counts are exact; with
thousands of millions of frequent phrases it lets all pass.

Scores are made from the frequent phrases alone: no part of a phrase is rarer
than the phrase.  A cut of a candidate meets the counts of its two parts in two
joins; a part with many phrases is split by adaptive execution, as both sides
are plain shuffles of written tables.  Products are decimals of 38 digits, which
counts below ``10 ** 15`` cannot overflow; beyond, arithmetic raises.

Defined cases: a null text has no words; a null language is ``und``, and so is
one of that name; repeated rows count each; a text of any length is taken whole
(a text longer than a shard is a shard); ties are broken by count and by phrase;
an empty table gives no rows.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.bpe import texts_in
from meshloom.llm.words import mixed, word_hashes
from meshloom.llm.workers import tidy
from meshloom.operators.ordering import global_rank
from meshloom.plans.scratch import materialize, release

#: Words and marks of a shard, about; it ends with a whole text.  Pairs of ranks of so many and a place fit 63 bits.
SHARD_WORDS = 1_900_000
#: Bits of a filter of frequent phrases at most: 16 MB.
MAX_FILTER_BITS = 1 << 27
#: Rows that go back to Spark at once.
BATCH_ROWS = 1 << 15
COUNTS = "lang string, phrase string, n long"
_MARK = b"\xff"  # no byte of UTF-8
_breaks = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _MARK * 10)


def tokens(text: str) -> list[bytes]:
    """Lower-case words of a text, with a mark between pieces."""
    return text.encode().lower().translate(_breaks).replace(_MARK, b" \xff ").split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in an order of their first ``depth`` ids at least, by prefix doubling."""
    rank, h = ids.astype(np.int64), 1
    if depth < 2:
        return np.argsort(rank)
    while h < depth:
        ahead = np.zeros(len(ids), dtype=np.int64)
        ahead[:-h] = rank[h:] + 1  # past the end: 0
        order, keys = _by_pairs(rank, ahead)
        dense = np.zeros(len(ids), dtype=np.int64)
        np.cumsum(keys[1:] != keys[:-1], out=dense[1:])
        rank[order] = dense
        h *= 2
    return order


def _by_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers, and the pairs in it as single numbers.

    Where a pair and its place fit 63 bits together, numbers are sorted, which is faster than sorting places by them.
    """
    bits = int(second.max(initial=0)).bit_length()
    keys = first << bits | second
    place = max(len(keys) - 1, 0).bit_length()
    if int(keys.max(initial=0)).bit_length() + place <= 63:
        keys <<= place
        keys |= np.arange(len(keys))
        keys.sort()
        return keys & ((1 << place) - 1), keys >> place
    order = np.argsort(keys)
    return order, keys[order]


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix in order, how many first ids it shares with the one before, ``depth`` at most."""
    shared = np.zeros(len(order), dtype=np.int8)
    padded = np.concatenate([ids, np.full(depth, -1, dtype=ids.dtype)])
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for j in range(depth):
        at = padded[order + j]
        same &= (at[1:] == at[:-1]) & (at[1:] >= 0)
        shared[1:] += same
    return shared


def phrase_counts(ids: np.ndarray, shortest: int, longest: int, frequent: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: phrases as rows of ids, and their counts; id 0 is the mark.

    With ``frequent``, which says of phrases of ``shortest - 1`` words whether they may be, only those whose
    parts of so many words all may.
    """
    order = suffix_array(ids, longest)
    shared = common_prefixes(ids, order, longest)
    padded = np.concatenate([ids, np.zeros(longest, dtype=ids.dtype)])

    def intervals(m: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(shared < m)  # an interval of suffixes that share m ids begins here
        length = np.diff(first, append=len(order))
        starts = order[first]
        whole = np.ones(len(first), dtype=bool)
        for j in range(m):
            whole &= padded[starts + j] != 0
        if allowed is not None:
            for j in range(m - shortest + 2):
                whole &= allowed[starts + j]
        return starts, length, whole

    allowed = None
    if frequent is not None:
        starts, length, whole = intervals(shortest - 1)
        whole[whole] = frequent(padded[starts[whole][:, None] + np.arange(shortest - 1)])
        allowed = np.zeros(len(padded), dtype=bool)
        allowed[order] = np.repeat(whole, length)
    for m in range(shortest, longest + 1):
        starts, length, whole = intervals(m, allowed)
        yield padded[starts[whole][:, None] + np.arange(m)], length[whole]


def phrase_hashes(lang: np.ndarray, words: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their language and words, column by column."""
    found = lang
    with np.errstate(over="ignore"):
        for column in words:
            found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + column)
    return found


class _Ids(dict):
    """The ids of a language's words; a new word takes the next id of the shard."""

    def __init__(self, shard: _Shard, lang: str) -> None:
        super().__init__({_MARK: 0})
        self.shard, self.lang = shard, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = new = len(self.shard.words)
        self.shard.words.append(word)
        self.shard.langs.append(self.lang)
        return new


class _Shard:
    """Texts as ids.  Each language has its own, so that phrases of two languages never meet."""

    def __init__(self) -> None:
        self.words, self.langs = [b""], [""]
        self.ids: dict[str, _Ids] = {}
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        if lang not in self.ids:
            self.ids[lang] = _Ids(self, lang)
        known, found = self.ids[lang], tokens(text)
        self.texts.append(np.fromiter(map(known.__getitem__, found), dtype=np.int32, count=len(found)))
        self.texts.append(np.zeros(1, dtype=np.int32))
        self.size += len(found) + 1

    def rows(self, shortest: int, longest: int, bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``COUNTS`` of this shard; with words, the empty phrase counts all words of a language."""
        if not self.texts:
            return
        ids, self.texts, self.ids = np.concatenate(self.texts), [], {}
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string()).dictionary_encode()
        frequent = None
        if bits is not None:
            word, lang = word_hashes(self.words), word_hashes([x.encode() for x in langs.dictionary.to_pylist()])[langs.indices.to_numpy()]
            frequent = lambda phrases: _is_set(bits, phrase_hashes(lang[phrases[:, 0]], (word[c] for c in phrases.T)))
        for phrases, counts in phrase_counts(ids, shortest, longest, frequent):
            for at in range(0, len(phrases), BATCH_ROWS):
                part = phrases[at : at + BATCH_ROWS]
                spelled = pc.binary_join_element_wise(*(words.take(pa.array(column)) for column in part.T), b" ") if part.shape[1] > 1 else words.take(pa.array(part[:, 0]))
                yield _batch(langs.take(pa.array(part[:, 0])).dictionary_decode(), spelled.cast(pa.string()), counts[at : at + BATCH_ROWS])
            if phrases.shape[1] == 1:
                of = langs.indices.to_numpy()[phrases[:, 0]]
                sums = np.bincount(of, weights=counts, minlength=len(langs.dictionary)).astype(np.int64)
                held = np.flatnonzero(sums)
                yield _batch(langs.dictionary.take(pa.array(held)), pa.array([""] * len(held), pa.string()), sums[held])


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _batch(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def counts(docs: DataFrame, shortest: int = 1, longest: int = 3, shard_words: int = SHARD_WORDS, filter_: Broadcast | None = None) -> DataFrame:
    """``(lang, phrase, n)``: occurrences of all phrases of ``docs (text, lang)`` of so many words, spelled with single spaces.

    With single words, the empty phrase counts all words of its language.  ``filter_``, of ``frequent_filter``:
    at least of the phrases whose parts of ``shortest - 1`` words it holds.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_ is None else np.frombuffer(filter_.value, dtype=np.uint8)
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_in(batch, "text"), strict=True):
                shard.add(lang, text)
                if shard.size >= shard_words:
                    yield from shard.rows(shortest, longest, bits)
                    shard = _Shard()
        yield from shard.rows(shortest, longest, bits)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(tidy(work), COUNTS)
    # A shard has summed already, so rows shuffle as they are and are summed once, where they arrive.
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_filter(frequent: DataFrame, size: int, max_bits: int = MAX_FILTER_BITS) -> Broadcast:
    """A bit for the hash of each phrase of ``size`` words among ``frequent (lang, phrase, n)``: 16 bits a phrase, ``max_bits`` at most.

    Spark sets the bits in bitmaps of 4 KB, which are all that reaches the driver.
    """
    chosen = frequent.where((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) == size)).select("lang", "phrase")
    n_bits = max(1 << 15, min(1 << (16 * chosen.count()).bit_length(), max_bits))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            lang = word_hashes([x.encode() for x in batch.column("lang").to_pylist()])
            hashes = phrase_hashes(lang, (word_hashes(list(c)) for c in zip(*words, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array((hashes % np.uint64(n_bits)).astype(np.int64))], ["at"])

    bit = F.col("at") + 1  # the bitmap functions count from 1
    held = chosen.mapInArrow(tidy(work), "at long").groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    bits = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in held.toLocalIterator():  # n_bits / 8 bytes in all
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits.tobytes())


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(15,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """``(lang, phrase, size, a, l, r, score)`` of the phrases of two words or more among ``frequent (lang, phrase, n)``.

    ``l`` and ``r`` belong to the cut of the lowest score, the first of them; ``frequent`` holds every part of its phrases.
    """
    words = F.split("phrase", " ")
    phrases = frequent.where("phrase <> ''").withColumn("words", words).withColumn("size", F.size("words"))
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda part, count: frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    top = F.lit(1_000_000).cast("decimal(7,0)") * (_exact("a") * _exact("a"))
    score = met.select("*", top.alias("_top"), (_exact("l") * _exact("r")).alias("_under")).withColumn("score", F.expr("_top div _under"))
    least = score.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def without_fragments(found: DataFrame, percent: int = 50) -> DataFrame:
    """The phrases that no longer phrase of ``found (lang, phrase, size, a)`` holds in ``percent`` of their occurrences or more."""
    words = F.split("phrase", " ")
    longer = found.where("size > 2").select("lang", "a", "size", words.alias("words"))
    length = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length")
    start = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start")
    inside = longer.select("*", length).select("*", start).select("lang", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("phrase"), "a")
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_within"))
    kept = F.col("_within").isNull() | (100 * F.col("_within") < percent * F.col("a"))
    return found.join(most, ["lang", "phrase"], "left").where(kept).drop("_within")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, with ``rank``: places in one order of all, less the first place of the language."""
    placed = global_rank(found, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], "place")
    placed = materialize(placed, "places")
    first = placed.groupBy("lang").agg(F.min("place").alias("_first"))
    return placed.join(first, "lang").withColumn("rank", F.col("place") - F.col("_first") + 1).where(F.col("rank") <= top).drop("place", "_first")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, percent: int = 50, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the best phrases of ``docs (text, lang)``.

    Candidates have 2 to ``longest`` words and ``least`` occurrences; those that live inside a longer one go.
    """
    if longest < 2 or least < 1 or top < 1:
        raise ValueError("longest must be 2 at least, least and top 1 at least")
    wanted = (F.col("n") >= least) | (F.col("phrase") == "")
    frequent = materialize(counts(docs, 1, 2, shard_words).where(wanted), "phrases")
    for size in range(3, longest + 1):
        held = frequent_filter(frequent, size - 1)
        more = materialize(counts(docs, size, size, shard_words, held).where(wanted), "phrases")
        held.unpersist()
        frequent = frequent.union(more)
    found = materialize(scored(frequent.where(F.col("n") >= least)), "scored")
    ranked = materialize(best(without_fragments(found, percent), top), "collocations")
    totals = frequent.where("phrase = ''").select("lang", "n")
    release(found)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
