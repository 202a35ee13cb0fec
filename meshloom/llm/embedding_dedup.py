"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are scaled to length one and projected on ``DIRECTIONS`` fixed random
directions.  Two vectors collide in a direction when one lies in the window of
half-width ``w`` centred on the other; ``w`` is ``WIDTH`` standard deviations of
the projected difference of a pair just at the threshold.  Pairs with enough
collisions are verified by their cosine in double precision.

Which pairs are counted: there is a cell for each of other fixed random directions,
the more the more vectors there are, so that cells stay of one size.  A vector is a
row in each of the few cells in whose directions it projects farthest, and a pair is
judged in the first cell that it shares.  Large cells are cut into blocks, and each
pair of blocks is a tile.

The directions are random and do not depend on the data, so whether a pair meets
and how often it collides has one distribution for all pairs of the same cosine,
whatever the vectors.  The count and the cells of a vector are set from it, by drawing
pairs at exactly the threshold; no row of the input is sampled.

Rows hold 16-bit codes of the vectors.  What a code is off by is bounded, so the
codes decide all pairs but those within that bound of the threshold.  For these,
tiles return the pair, and a second pass fetches the vectors, each once a tile.
Of the others, tiles return link counts by vector and a spanning forest of their
links, never pairs.

Equal vectors are compared once, with their number.  They are found by 128 bits
of hashes in narrow rows; a filter lets only vectors that may repeat shuffle.

Defined cases: null vectors, zero vectors and those with null or non-finite
components link with nothing and are components of their own.  Vectors of
different lengths never link.  Repeated rows count as copies of each other.  A
null id keeps its row out of links.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.exact_dedup import flag_suspects, member_filter, passing
from meshloom.llm.workers import tidy
from meshloom.operators.components import connected_components
from meshloom.plans.scratch import materialize

DIRECTIONS, WIDTH, SEED = 24, 2.0, 11
#: Directions counted for all pairs of a tile; the others are for pairs that can still have enough.
FIRST = 16
#: Of pairs at the threshold, the share that the count lets through, and the share that also meets in some cell.
COUNTED, RECALL = 0.995, 0.97
#: Pairs drawn to set them.
DRAWN = 4096
#: Vectors for each cell, about; cells, and cells of a vector, at most.
CELL, CELLS, PROBES = 1024, 32_768, 8
#: Blocks that a large cell is cut into, unless they exceed so many vectors or bytes of codes.
BLOCKS, BLOCK, BLOCK_BYTES = 8, 65_536, 1 << 24
#: Bits of a filter at most: 8 MB.
FILTER_BITS = 1 << 26
ROWS = "cell long, tile long, side int, row binary"
TILE = "a long, b long, n long, m long, cell long, tile long"


class Layout(NamedTuple):
    """How vectors of one length are compared: cells, cells of a vector, and collisions of a pair that is verified."""

    cells: int
    probes: int
    count: int


def directions(dim: int, cells: int = 0) -> np.ndarray:
    """Unit vectors as columns, the same in every run: those that count, or those of the cells."""
    u = np.random.default_rng([SEED, dim, cells]).standard_normal((dim, cells or DIRECTIONS))
    return (u / np.linalg.norm(u, axis=0)).astype(np.float32)


def farthest(x: np.ndarray, u: np.ndarray, probes: int) -> np.ndarray:
    """The columns of ``u`` on which each row of ``x`` projects farthest, farthest first."""
    found = np.zeros((len(x), probes), dtype=np.int64)
    step = max(1, (1 << 20) // u.shape[1])
    for at in range(0, len(x), step):
        p = x[at : at + step].astype(np.float32) @ u
        for k in range(probes):
            found[at : at + step, k] = best = p.argmax(1)
            p[np.arange(len(p)), best] = -np.inf
    return found


def half_width(dim: int, threshold: float) -> float:
    return WIDTH * math.sqrt(max(2 - 2 * threshold, 1e-12) / dim)


def drawn_pairs(dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors with exactly this cosine, in random positions."""
    rng = np.random.default_rng([SEED, dim])
    x, noise = rng.standard_normal((2, DRAWN, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * noise / np.where(size == 0, 1, size)
    return x.astype(np.float32), y.astype(np.float32)


@functools.lru_cache(maxsize=256)
def layout(dim: int, rows: int, threshold: float) -> Layout:
    """The most cells wanted for so many rows of which ``PROBES`` a vector let ``RECALL`` of the pairs at the threshold meet."""
    x, y = drawn_pairs(dim, threshold)
    hits = (np.abs((x - y) @ directions(dim)) <= half_width(dim, threshold)).sum(1)
    count = int(np.quantile(hits, 1 - COUNTED, method="lower"))
    cells = min(CELLS, 1 << max(0, math.ceil(math.log2(max(1, rows) / CELL))))
    while cells > 1:
        u, most = directions(dim, cells), min(PROBES, cells)
        p, q = farthest(x, u, most), farthest(y, u, most)
        same = p[:, :, None] == q[:, None, :]
        for probes in range(1, most + 1):
            if same[:, :probes, :probes].any((1, 2)).mean() * COUNTED >= RECALL:
                return Layout(cells, probes, count)
        cells //= 2
    return Layout(1, 1, count)


def _record(dim: int, probes: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("n", "<i8"), ("scale", "<f4"), ("home", "<i2", (probes,)), ("code", "<i2", (dim,))])


def _unit(flat: pa.Array, rows: int) -> np.ndarray:
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _homes(batches, layouts: dict[int, Layout]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Vectors of one length, scaled, with their cells."""
    made = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in map(int, np.unique(dims)):
            own = batch.filter(pa.array(dims == dim))
            x = _unit(own.column("v"), own.num_rows)
            cells, probes, _ = layouts[dim]
            if dim not in made:
                made[dim] = directions(dim, cells)
            yield dim, own, x, farthest(x, made[dim], probes)


def _count(layouts: dict[int, Layout]) -> Callable:
    """Vectors by cell, summed in each batch."""

    def work(batches):
        for dim, _, _, home in _homes(batches, layouts):
            cells, n = np.unique((dim << 16) + home, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], ["cell", "rows"])

    return work


def _deal(layouts: dict[int, Layout], large: dict[int, int]) -> Callable:
    """A row of each vector for each of its cells; in a large cell, for each tile of its block."""
    cut = np.array(sorted(large), dtype=np.int64)
    blocks = np.array([large[c] for c in cut.tolist()], dtype=np.int64)

    def work(batches):
        for dim, own, x, home in _homes(batches, layouts):
            rows = np.zeros(len(x), dtype=_record(dim, home.shape[1]))
            rows["id"], rows["n"], rows["home"] = own.column("id").to_numpy(), own.column("n").to_numpy(), home
            rows["scale"] = np.abs(x).max(1) / 32_766
            rows["code"] = np.rint(x / rows["scale"][:, None].astype(np.float64))
            mixed = (rows["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for cell in (dim << 16) + home.T:
                parts = np.ones(len(x), dtype=np.int64)
                if len(cut):
                    at = np.minimum(np.searchsorted(cut, cell), len(cut) - 1)
                    parts = np.where(cut[at] == cell, blocks[at], 1)
                mine = (mixed % parts.astype(np.uint64)).astype(np.int64)
                for other in range(int(parts.max())):
                    to = np.flatnonzero(parts > other)
                    tile = (np.minimum(mine[to], other) << 20) + np.maximum(mine[to], other)
                    yield _dealt(cell[to], tile, (mine[to] > other).astype(np.int32), rows[to])

    return work


def _dealt(cell: np.ndarray, tile: np.ndarray, side: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(tile), pa.array(side), packed], ["cell", "tile", "side", "row"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(vertex, smallest vertex of its component)`` over the links ``a, b``."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(ids))
    return ids[off], ids[label[off]]


class _Found:
    """What a tile returns: ``(a, null, n)``, the links of ``a``; ``(a, b, 0)``, a forest; with ``m``, pairs that are open, ``n`` of ``a`` and ``m`` of ``b``."""

    def __init__(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        self.ids, self.n = (a, b), (na, nb)
        self.lines = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        self.trees: list[tuple[np.ndarray, np.ndarray]] = []
        self.open: list[tuple[np.ndarray, ...]] = []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.lines[0], i, self.n[1][j])
        np.add.at(self.lines[1], j, self.n[0][i])
        if len(i):
            self.trees.append(forest(self.ids[0][i], self.ids[1][j]))

    def leave(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.open.append((self.ids[0][i], self.ids[1][j], self.n[0][i], self.n[1][j]))

    def table(self, cell: int, tile: int) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        lines, ids = np.concatenate(self.lines), np.concatenate(self.ids)
        ids, lines = ids[lines > 0], lines[lines > 0]
        low, root = forest(*map(np.concatenate, zip(*self.trees))) if self.trees else (none, none)
        a, b, n, m = map(np.concatenate, zip(*self.open)) if self.open else [none] * 4
        kind = np.repeat([0, 1, 2], [len(ids), len(low), len(a)])
        columns = {
            "a": pa.array(np.concatenate([ids, low, a]), pa.int64()),
            "b": pa.array(np.concatenate([ids, root, b]), pa.int64(), mask=kind == 0),
            "n": pa.array(np.concatenate([lines, low * 0, n]), pa.int64()),
            "m": pa.array(np.concatenate([lines, low, m]), pa.int64(), mask=kind < 2),
        }
        return pa.table(columns | {k: pa.array(np.full(len(kind), v), pa.int64()) for k, v in (("cell", cell), ("tile", tile))})


def _tile(threshold: float, layouts: dict[int, Layout]) -> Callable:
    """Compare the vectors of a block with each other, or with those of another block."""

    def work(group: pa.Table) -> pa.Table:
        cell, tile = group.column("cell")[0].as_py(), group.column("tile")[0].as_py()
        dim, here, across = cell >> 16, cell & 0xFFFF, tile >> 20 != tile & 0xFFFFF
        _, probes, least = layouts[dim]
        side = group.column("side").to_numpy()
        rows = np.frombuffer(b"".join(group.column("row").to_pylist()), dtype=_record(dim, probes))
        x, y = (rows[side == 0], rows[side == 1]) if across else (rows, rows)
        found = _Found(x["id"], y["id"], x["n"], y["n"])
        if not len(x) or not len(y):
            return found.table(cell, tile)
        u, w = directions(dim), min(math.ceil(half_width(dim, threshold) * 16_383) + 2, 32_767)
        px, py = (np.rint((r["code"] * r["scale"][:, None]) @ u * 16_383).astype(np.int16).T.copy() for r in (x, y))
        low = py - np.int16(w)
        step, some = max(1, 500_000 // len(y)), max(1, (1 << 21) // dim)
        for at in range(0, len(x), step):
            first = 0 if across else at
            shape = (len(x[at : at + step]), len(y) - first)
            apart, near, hits = np.empty(shape, np.int16), np.empty(shape, bool), np.zeros(shape, np.uint8)
            for k in range(FIRST):  # x - y + w, as a number without sign, is at most 2 w where the two collide
                np.subtract(px[k, at : at + step, None], low[k, None, first:], out=apart)
                np.less_equal(apart.view(np.uint16), np.uint16(2 * w), out=near)
                np.add(hits, near.view(np.uint8), out=hits)
            i, j = np.nonzero(hits >= least - (DIRECTIONS - FIRST))
            hits, i, j = hits[i, j], i + at, j + first
            for k in range(FIRST, DIRECTIONS):
                hits += np.abs(px[k, i].astype(np.int32) - py[k, j]) <= w
            i, j = i[hits >= least], j[hits >= least]
            good = x["id"][i] != y["id"][j]
            if not across:
                good &= i < j
            i, j = i[good], j[good]
            good = np.ones(len(i), dtype=bool)
            for p, q in itertools.product(range(probes), repeat=2):
                shared = x["home"][i, p]
                good &= (shared != y["home"][j, q]) | (shared >= here)
            i, j = i[good], j[good]
            for k in range(0, len(i), some):
                _judge(x, y, i[k : k + some], j[k : k + some], threshold, found)
        return found.table(cell, tile)

    return work


def _judge(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, found: _Found) -> None:
    """Pairs are links, or open where the cosine of the codes is no farther from the threshold than it may be off."""
    p, q = x["scale"][i].astype(np.float64), y["scale"][j].astype(np.float64)
    cosine = np.einsum("ij,ij->i", x["code"][i].astype(np.float64), y["code"][j].astype(np.float64)) * p * q
    half = math.sqrt(x["code"].shape[1]) / 2
    off = half * (p + q) + half * half * p * q + 1e-9
    sure, doubt = cosine > threshold + off, np.abs(cosine - threshold) <= off
    found.link(i[sure], j[sure])
    found.leave(i[doubt], j[doubt])


def _settle(threshold: float) -> Callable:
    """Decide a tile's open pairs by the vectors."""

    def work(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return _Found(*[np.zeros(0, dtype=np.int64)] * 4).table(0, 0)
        a, b, n, m = (pairs.column(c).to_numpy() for c in ("a", "b", "n", "m"))
        ids, at = np.unique(vectors.column("id").to_numpy(), return_index=True)
        x = _unit(vectors.column("v").combine_chunks(), vectors.num_rows)[at]
        found = _Found(a, b, n, m)
        some = max(1, (1 << 21) // x.shape[1])
        for k in range(0, len(a), some):
            i, j = (np.searchsorted(ids, c[k : k + some]) for c in (a, b))
            yes = k + np.flatnonzero(np.einsum("ij,ij->i", x[i], x[j]) >= threshold)
            found.link(yes, yes)
        return found.table(pairs.column("cell")[0].as_py(), pairs.column("tile")[0].as_py())

    return work


def links(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(a, b, n)`` of distinct ``vectors (id, n, dim, v)``: link counts ``(a, null, n)`` and forest edges ``(a, b, 0)``."""
    sizes = {int(r["dim"]): r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    # The next power of two, so that a few rows more or less change nothing.
    layouts = {dim: layout(dim, 1 << (n - 1).bit_length(), threshold) for dim, n in sizes.items()}
    usual = {dim: max(CELL, math.ceil(2 * n * layouts[dim].probes / layouts[dim].cells)) for dim, n in sizes.items()}
    held = vectors.mapInArrow(tidy(_count(layouts)), "cell long, rows long").groupBy("cell").agg(F.sum("rows").alias("rows"))
    large = {}
    for r in held.where(F.col("rows") > min(usual.values(), default=0)).collect():  # half the cells at most
        dim = r["cell"] >> 16
        size = min(max(usual[dim], math.ceil(r["rows"] / BLOCKS)), BLOCK, max(CELL, BLOCK_BYTES // (2 * dim)))
        large[r["cell"]] = math.ceil(r["rows"] / size)
    dealt = vectors.mapInArrow(tidy(_deal(layouts, large)), ROWS)
    found = materialize(dealt.groupBy("cell", "tile").applyInArrow(_tile(threshold, layouts), TILE), "links")
    pairs = found.where("m is not null")
    if pairs.isEmpty():
        return found.select("a", "b", "n")
    needed = materialize(pairs.select("cell", "tile", F.explode(F.array("a", "b")).alias("_id")).distinct(), "needed")
    asked = passing(vectors.select("id", "v"), "id", member_filter(needed.select("_id").distinct(), "_id", FILTER_BITS))
    asked = asked.join(needed, F.col("id") == F.col("_id")).select("cell", "tile", "id", "v")
    settled = pairs.groupBy("cell", "tile").cogroup(asked.groupBy("cell", "tile")).applyInArrow(_settle(threshold), TILE)
    return found.where("m is null").select("a", "b", "n").union(settled.select("a", "b", "n"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``embeddings (vec_id, embedding)``."""
    v = F.col("embedding").cast("array<float>")
    low, high = F.array_min(v), F.array_max(v)  # without nulls; a NaN is above all numbers
    sound = (low > float("-inf")) & (high < float("inf")) & ((low != 0) | (high != 0)) & ~F.exists(v, F.isnull)
    rows = embeddings.select("vec_id", v.alias("v"), (F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).alias("sound"))
    held = rows.where("sound").select(F.col("vec_id").alias("id"), "v")
    # Zeros of either sign hash alike.
    held = held.withColumns({"h": F.xxhash64(F.lit(1), "v"), "g": F.xxhash64(F.lit(2), "v")})
    keys = materialize(held.select("id", "h", "g"), "keys")
    repeated = keys.groupBy("h", "g").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated, "repeated")
    distinct = held.select("id", F.lit(1).cast("long").alias("n"), "v")
    if not repeated.isEmpty():
        flagged = flag_suspects(held, *member_filter(repeated, "h", FILTER_BITS), "_again", "h")
        once = flagged.where("_again").groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
        once = materialize(once.select("id", "n", "v"), "vectors")
        distinct = flagged.where("not _again").select("id", F.lit(1).cast("long").alias("n"), "v").union(once)
    found = materialize(links(distinct.withColumn("dim", F.size("v")), threshold), "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("_links"))
    parts = connected_components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    linked = counts.join(parts, F.col("a") == F.col("id"), "left").select("a", "_links", "component")
    named = keys.join(repeated.withColumnsRenamed({"h": "_h", "g": "_g"}), (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    named = named.select(F.col("id").alias("vec_id"), F.coalesce("first", "id").alias("id"), F.coalesce("n", F.lit(1)).alias("n"))
    met = named.join(linked, F.col("id") == F.col("a"), "left").select(
        "vec_id", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
