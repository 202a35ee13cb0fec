"""N-gram Jaccard join: size bands, hashed bitmaps, and exact set intersection.

A document's set holds the distinct n-word shingles of its whole text, as
64-bit hashes.  Two sets link when their Jaccard similarity reaches the
threshold.  The join finds the connected components of all links exactly:

1. Equal sets are one node.  Shingles are put in one order, those of rare words
   first and frequent shingles last; sets that link share one of the first few
   shingles of each (the prefix).
2. A first round pairs each node with the smallest node under a few of its
   least hashes.  This is linear in the nodes, and its components swallow groups
   of near copies of any size.
3. Under each prefix shingle of two nodes or more, nodes of different components
   meet in tiles of two neighbouring size bands.  There the bit counts of short
   folded bitmaps, of ``SHORT`` bytes at most, bound the overlap from above.

The pairs of both rounds, each once, are bounded again by the bands of their
sizes and the bit counts of their whole bitmaps.  Sorted shingle arrays, made
once for each node that is left in some pair, are then intersected exactly.
Links between components join them; pairs within a component are never formed.

Rows leave their place only where they must: Bloom filters of bounded size let
nodes without copies, nodes outside the first components and prefix shingles of
one node pass by the joins that could not concern them.  Broadcast are these
filters; the frequent shingles, those with more documents than a
``FREQUENT_SHARE``-th of all shingles, so at most ``FREQUENT_SHARE`` of them
whatever the input; and ``FREQUENT_WORDS`` words with their counts.

Defined cases: a null text or one without words has an empty set, which links
with nothing; a text of fewer words than ``n`` has one shingle, the whole.  Rows
with equal sets are linked, repeated rows too.  Rows of one id are one document:
its texts are in one component, with the links of each.  A null id links its
copies with nothing and is its own component.  An empty table gives an empty
result.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.exact_dedup import flag_suspects, member_filter, passing
from meshloom.llm.words import Runs, mixed, word_hashes
from meshloom.llm.workers import tidy
from meshloom.operators.components import connected_components
from meshloom.plans.scratch import materialize

N, NUMERATOR, DENOMINATOR = 5, 80, 100
FREQUENT_SHARE = 1 << 20
LEAST_FREQUENT = 64
#: Words whose counts tell how rare a shingle is.
FREQUENT_WORDS = 1 << 16
LEAST_WORD = 16
#: Least hashes under which a first round links nodes.
ROUNDS = 3
LEAST_BITS = 1024
#: Bytes of the folded bitmaps that rows of tiles carry, at most.
SHORT = 128
#: Hashes of each kind that a task counts at once for the common order.
HELD = 1 << 20
FREQUENT_RANK = 1 << 32
#: Nodes of a chunk under one shingle; a tile has two chunks.
CHUNK = 8192
#: Rows of a side of a tile that meet at once.
TILE = 512


def shingles(data: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; A-Z count as a-z."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = Runs(word_hashes(words))
    return np.unique(runs.every(min(n, len(words))))


@dataclass
class Order:
    """The common order of shingles: ``words`` with ``levels``, rising with counts; ``keys`` with ``places`` come last."""

    words: np.ndarray
    levels: np.ndarray
    keys: np.ndarray
    places: np.ndarray

    def ranked(self, data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of a text, and their ranks; equal ranks go by hash."""
        words = data.lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        hashes = word_hashes(words)
        width = min(n, len(words))
        s, first = np.unique(Runs(hashes).every(width), return_index=True)
        level = np.concatenate([[0], np.cumsum(_found(self.words, self.levels, hashes, 0))])
        rank = (level[width:] - level[:-width])[first]
        late = _found(self.keys, self.places, s, -1)
        return s, np.where(late >= 0, late + FREQUENT_RANK, rank)

    def prefix(self, s: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return s[np.lexsort((s, rank))[: prefix_length(len(s))]]


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), missing, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], missing)


def similar(a: int, b: int, both: int) -> bool:
    return DENOMINATOR * both >= NUMERATOR * (a + b - both)


def prefix_length(size: int) -> int:
    """First shingles, in the common order, of which linked sets share one at least."""
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


def band(size: np.ndarray) -> np.ndarray:
    """Sets that link are in the same or neighbouring bands: a band's ends are less than 5 / 4 apart."""
    return np.floor(np.log(size) / np.log(DENOMINATOR / NUMERATOR) + 1e-9).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Bits that some shingle hashes to, twice as many as shingles at least, a power of two.

    Sets differ in at least as many shingles as their bitmaps in bits, and longer bitmaps fold to shorter ones.
    """
    n = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    bits = np.zeros(n, dtype=np.uint8)
    bits[(mixed(s) >> np.uint64(20)).astype(np.int64) % n] = 1
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap of so many bytes: position ``i`` of the longer one counts as ``i`` modulo its bits."""
    return np.bitwise_or.reduce(np.frombuffer(bits, dtype=np.uint8).reshape(-1, size), axis=0)


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def common_order(docs: DataFrame, n: int) -> Order:
    """Count frequent shingles and words over all documents.

    Tasks count ``HELD`` hashes at a time and report shingles that two documents of those have, and words
    that they have often; any order makes the join exact, so rarer ones may be missed.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, n_held, n_words, total = [], [], 0, 0, 0
        for batch in batches:
            for data in batch.column("data"):
                split = data.as_py().lower().split()
                if not split:
                    continue
                hashes = word_hashes(split)
                s = np.unique(Runs(hashes).every(min(n, len(split))))
                total += len(s)
                if n_held + len(s) > HELD and n_held:
                    yield _reported(held, 2, 0)
                    held, n_held = [], 0
                if n_words + len(hashes) > HELD and n_words:
                    yield _reported(words, LEAST_WORD, 1)
                    words, n_words = [], 0
                held.append(s)
                words.append(hashes)
                n_held, n_words = n_held + len(s), n_words + len(hashes)
        if held:
            yield from (_reported(held, 2, 0), _reported(words, LEAST_WORD, 1))
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["kind", "hash", "n"])

    counts = _texts(docs).mapInArrow(tidy(work), "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "frequent")
    row = counts.where("kind = 2").first()
    least = max(LEAST_FREQUENT, (row["n"] if row else 0) // FREQUENT_SHARE)
    late = counts.where((F.col("kind") == 0) & (F.col("n") > least)).orderBy("n", "hash").toPandas()  # FREQUENT_SHARE rows at most
    words = counts.where("kind = 1").orderBy(F.desc("n"), "hash").limit(FREQUENT_WORDS).toPandas()
    keys = late["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    word = words["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(word)
    return Order(word[by], np.log2(words["n"].to_numpy(dtype=float)[by]).astype(np.int64), keys[order], order.astype(np.int64))


def _reported(held: list[np.ndarray], least: int, kind: int) -> pa.RecordBatch:
    every = np.concatenate(held)
    held.clear()
    every.sort()
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    keys, counts = every[starts], np.diff(np.append(starts, len(every)))
    some = counts >= least
    kinds = pa.array(np.full(int(some.sum()), kind, dtype=np.int32))
    return pa.RecordBatch.from_arrays([kinds, pa.array(keys[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], ["kind", "hash", "n"])


SIGNED = "doc_id long, size long, digest binary, least array<long>, prefix array<long>, bits binary, short binary"


def _signatures(n: int, order: Broadcast):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            sizes, digests, heads, firsts, bits, short = [], [], [], [], [], []
            for data in batch.column("data"):
                s, rank = order.value.ranked(data.as_py(), n)
                sizes.append(len(s))
                digests.append(_digest(s))
                firsts.append(_least(s))
                heads.append(order.value.prefix(s, rank).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
                bits.append(bitmap(s))
                short.append(folded(bits[-1], min(SHORT, len(bits[-1]))).tobytes())
            longs = pa.list_(pa.int64())
            columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, longs), pa.array(heads, longs)]
            columns += [pa.array(bits, pa.binary()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "size", "digest", "least", "prefix", "bits", "short"])

    return work


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    if not len(s):
        return b""
    with np.errstate(over="ignore"):
        return mixed(s).sum(dtype=np.uint64).tobytes() + mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes()


def _least(s: np.ndarray) -> list[int]:
    """The least of the set's hashes under each of ``ROUNDS`` functions."""
    return [int(mixed(s ^ np.uint64(0xA0761D6478BD642F * (k + 1) % (1 << 64))).min().view(np.int64)) for k in range(ROUNDS)] if len(s) else []


def _screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of the pairs whose sizes and whole bitmaps leave room for a link."""
    for batch in batches:
        x, y = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
        room = (DENOMINATOR - NUMERATOR) * (x + y) // (DENOMINATOR + NUMERATOR)
        near = (np.abs(x - y) <= room) & (np.abs(band(x) - band(y)) <= 1)
        left, right = batch.column("bits_a"), batch.column("bits_b")
        for i in np.flatnonzero(near):
            p, q = left[i].as_py(), right[i].as_py()
            width = min(len(p), len(q))
            near[i] = np.bitwise_count(folded(p, width) ^ folded(q, width)).sum() <= room[i]
        keep = pa.array(near)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _arrays(n: int):
    """The sorted shingle array of each text."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [shingles(data.as_py(), n).tobytes() for data in part.column("data")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], ["id", "s"])

    return work


def _intersect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of the pairs whose sorted shingle arrays link."""
    for batch in batches:
        linked = []
        for left, right in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
            x, y = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (left, right))
            linked.append(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _with_both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs (a, b)`` with ``columns`` of both nodes of ``rows (id, ...)``; those of ``a`` come last and stay in place."""
    right = rows.select(F.col("id").alias("_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    left = rows.select(F.col("id").alias("_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    met = pairs.join(right, F.col("b") == F.col("_b")).drop("_b")
    return met.join(left, F.col("a") == F.col("_a")).drop("_a")


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs ``(a, b)`` that link.  Nodes that are in no pair stay out of the shuffles, by a Bloom filter of the ids."""

    def ids(of: DataFrame) -> tuple[DataFrame, int]:
        return member_filter(materialize(of.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"), "id")

    signs = passing(nodes.select("id", "size", "bits"), "id", ids(pairs))
    left = materialize(_with_both(pairs, signs, "size", "bits").mapInArrow(tidy(_screen), "a long, b long").distinct(), "screened")
    wanted = passing(texts.select(F.col("doc_id").alias("id"), "data"), "id", ids(left))
    arrays = wanted.select(F.col("id").alias("doc_id"), "data").mapInArrow(tidy(_arrays(n)), "id long, s binary")
    arrays = arrays.groupBy("id").agg(F.collect_set("s").alias("each")).select("id", F.explode("each").alias("s"))  # repeated rows once
    return materialize(_with_both(left, materialize(arrays, "arrays"), "s").mapInArrow(tidy(_intersect), "a long, b long").distinct(), "links")


def _tiles():
    """Pairs of different components within a tile whose sizes and bitmaps leave room for a link."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            if not len(tile):
                continue
            cut = int(np.searchsorted(tile, tile[-1]))
            if cut or (held and held[-1].column("tile")[-1].as_py() != tile[0]):
                first = batch.slice(0, cut)
                if not cut:
                    yield from _meet(held)
                    held = [batch]
                    continue
                yield from _meet([*held, first])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from _meet(held)

    return work


def _meet(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    if not rows.num_rows:
        return
    tile, ids, sizes, parts = (rows.column(c).to_numpy().astype(np.int64) for c in ("tile", "id", "size", "part"))
    order = np.lexsort((ids, sizes, tile))
    tile, ids, sizes, parts = tile[order], ids[order], sizes[order], parts[order]
    bits = rows.column("short").take(pa.array(order))
    bands = band(sizes)
    group = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (bands[1:] != bands[:-1])]))
    ends = [*group[1:].tolist(), len(ids)]
    for k, (start, end) in enumerate(zip(group.tolist(), ends, strict=True)):
        near = k + 1 < len(group) and tile[end] == tile[start] and bands[end] == bands[start] + 1
        reach = ends[k + 1] if near else end
        if reach - start < 2:
            continue
        signs = bits[start:reach].to_pylist()
        width = min(map(len, signs))
        signs = np.stack([folded(x, width) for x in signs]).view(np.uint64)
        found = []
        for at in range(start, end, TILE):
            stop = min(at + TILE, end)
            for other in range(at, reach, TILE):
                to = min(other + TILE, reach)
                a, b = sizes[at:stop, None], sizes[None, other:to]
                # Sets whose sizes or bitmaps differ by more than this cannot link.
                room = (DENOMINATOR - NUMERATOR) * (a + b) // (DENOMINATOR + NUMERATOR)
                good = (parts[at:stop, None] != parts[None, other:to]) & (np.abs(a - b) <= room)
                if other == at:
                    good &= np.arange(at, stop)[:, None] < np.arange(other, to)[None, :]
                i, j = np.nonzero(good)
                step = max(1, 8_000_000 // width)
                for c in range(0, len(i), step):
                    x, y = i[c : c + step], j[c : c + step]
                    differ = np.bitwise_count(signs[at - start + x] ^ signs[other - start + y]).sum(1)
                    fits = differ <= room[x, y]
                    found.append(np.column_stack([ids[at + x[fits]], ids[other + y[fits]]]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])


def _stars(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: each node with the smallest node under each of its least hashes."""
    each = nodes.select("id", F.posexplode("least").alias("k", "h")).select("id", F.xxhash64("k", "h").alias("key"))
    centre = each.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), "a")
    centre = materialize(centre, "centres")
    met = passing(each, "key", member_filter(centre, "_key")).join(centre, F.col("key") == F.col("_key"))
    return met.where("a <> id").select("a", F.col("id").alias("b")).distinct()


def _same_set() -> Column:
    """In a join of rows with sets."""
    return (F.col("size") == F.col("_size")) & (F.col("digest") == F.col("_digest"))


def _nodes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node for each set, under its smallest id; and the sets that several rows have, with that id."""
    sound = signed.where(F.col("doc_id").isNotNull() & (F.col("size") > 0))
    same = sound.groupBy("size", "digest").agg(F.min("doc_id").alias("_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = materialize(same, "sets").withColumnsRenamed({"size": "_size", "digest": "_digest"})
    flagged = flag_suspects(sound, *member_filter(same, "_digest"), "_copied")
    copied = flagged.where("_copied").select("doc_id", "size", "digest").join(same, _same_set(), "left")
    # The first row of each such set stays, and rows that only the filter took for one of its copies.
    stay = materialize(copied.where("_id is null or doc_id = _id").select("size", "digest", F.col("doc_id").alias("_stays")).distinct(), "stay")
    stay = stay.withColumnsRenamed({"size": "_size", "digest": "_digest"})
    firsts = passing(flagged.where("_copied"), "doc_id", member_filter(stay, "_stays"))
    firsts = firsts.join(stay, _same_set() & (F.col("doc_id") == F.col("_stays"))).dropDuplicates(["doc_id", "size", "digest"])
    columns = [F.col("doc_id").alias("id"), "size", "least", "prefix", "bits", "short"]
    return flagged.where("not _copied").select(*columns).union(materialize(firsts.select(*columns), "firsts")), same


def _rows_of_nodes(signed: DataFrame, same: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, node)`` of all rows; no node where a row links with nothing."""
    sound = F.coalesce(F.col("doc_id").isNotNull() & (F.col("size") > 0), F.lit(False))
    flagged = flag_suspects(signed.select("doc_id", "size", "digest"), *member_filter(same, "_digest"), "_copied")
    met = flagged.where(F.col("_copied") & sound).join(same, _same_set(), "left").select("doc_id", "size", F.coalesce("_id", "doc_id").alias("node"))
    rest = flagged.where(~(F.col("_copied") & sound)).select("doc_id", "size", F.when(sound, F.col("doc_id")).alias("node"))
    return met.union(rest).withColumnRenamed("size", "n_shingles")


def _placed(nodes: DataFrame, part: DataFrame) -> DataFrame:
    """Nodes with ``part``, their component so far; nodes outside ``part (id, component)`` do not shuffle."""
    flagged = flag_suspects(nodes, *member_filter(part, "id"), "_linked", "id")
    part = part.withColumnsRenamed({"id": "_pid", "component": "part"})
    met = flagged.where("_linked").join(part, F.col("id") == F.col("_pid"), "left").select("id", "size", F.coalesce("part", "id").alias("part"), "prefix", "short")
    return flagged.where("not _linked").select("id", "size", F.col("id").alias("part"), "prefix", "short").union(met)


def _tiled(placed: DataFrame, often: DataFrame) -> DataFrame:
    """A row for each node and tile; ``often`` has the prefix shingles of several nodes, with how many.

    A shingle with many nodes, if they are of different components, is cut into chunks, and each two
    chunks meet in a tile.  Tiles whose hashes agree merge, which adds pairs to verify and loses none.
    """
    heads = placed.select("id", F.col("size").cast("int").alias("size"), "part", "short", F.explode("prefix").alias("shingle"))
    heads = passing(heads, "shingle", member_filter(often, "shingle"))
    hot = materialize(often.where(F.col("n") > CHUNK), "hot-shingles")
    flagged = flag_suspects(heads, *member_filter(hot, "shingle"), "_hot", "shingle")
    columns = ["tile", "id", "size", "part", "short"]
    cool = (heads if hot.isEmpty() else flagged.where("not _hot")).withColumn("tile", F.col("shingle")).select(*columns)
    if hot.isEmpty():
        return cool.repartition("tile").sortWithinPartitions("tile", "size")
    warm = flagged.where("_hot")
    spread = warm.groupBy(F.col("shingle").alias("_shingle")).agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    spread = materialize(spread.select("_shingle", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "spread-shingles")
    own, other = F.pmod(F.xxhash64("id"), F.col("chunks")), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    warm = warm.join(spread, F.col("shingle") == F.col("_shingle")).select("*", own.alias("own"), other.alias("other"))
    tile = F.when(F.col("chunks") == 1, F.col("shingle")).otherwise(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")))
    return cool.union(warm.withColumn("tile", tile).select(*columns)).repartition("tile").sortWithinPartitions("tile", "size")


def components(docs: DataFrame, n: int = N) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``docs (doc_id, text)``; ids are integers."""
    spark: SparkSession = docs.sparkSession
    texts = _texts(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    order = spark.sparkContext.broadcast(common_order(docs, n))
    signed = materialize(texts.mapInArrow(tidy(_signatures(n, order)), SIGNED), "signatures")
    nodes, same = _nodes(signed)
    often = nodes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    often = materialize(often, "shared-shingles")
    first = _linked(materialize(_stars(nodes), "stars"), nodes, texts, n)
    part = materialize(connected_components(first, "a", "b"), "parts")
    pairs = materialize(_tiled(_placed(nodes, part), often).mapInArrow(tidy(_tiles()), "a long, b long").distinct(), "pairs")
    links = first.union(_linked(pairs, nodes, texts, n))
    rows = _rows_of_nodes(signed, same)
    several = signed.where(F.col("doc_id").isNotNull() & (F.col("size") > 0)).groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    several = materialize(several.where("lo <> hi").select(F.col("doc_id").alias("_id")), "several-texts")
    one = passing(rows, "doc_id", member_filter(several, "_id")).join(several, F.col("doc_id") == F.col("_id")).where("node is not null")
    links = links.union(one.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    final = materialize(connected_components(links, "a", "b"), "components").withColumnRenamed("id", "_of")
    flagged = flag_suspects(rows, *member_filter(final, "_of"), "_linked", "node")
    met = flagged.where("_linked").join(final, F.col("node") == F.col("_of"), "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id"))
    return met.union(flagged.where("not _linked").select("doc_id", "n_shingles", F.coalesce("node", "doc_id"))).toDF("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, all columns; one row of each component.

    Of rows that repeat an id one stays; rows without an id stay.  Only rows whose ids may be dropped or
    repeated shuffle.
    """
    found = components(docs.select("doc_id", "text"), n)
    away = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("_away"))
    away = materialize(away.where("n > 1 or _away").select(F.col("doc_id").alias("_of"), "_away"), "decided")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_id"))
    flagged = flag_suspects(rows, *member_filter(away, "_of"), "_suspect", "_id")
    met = flagged.where("_suspect").join(away, F.col("_id") == F.col("_of"), "left").where("not coalesce(_away, false)")
    once = met.groupBy("_id").agg(F.first("_row").alias("_row"))
    return flagged.where("not _suspect").select("_row.*").union(once.select("_row.*"))
