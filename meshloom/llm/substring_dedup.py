"""Substring dedup: repeated runs of words, by compaction of a sampled De Bruijn graph.

A window is ``window`` consecutive words.  Of the word k-mers in each window the
one with the smallest hash is sampled, so equal windows sample the same k-mer
at the same place.  Sampled k-mers are the edges of the graph; the run from one
sampled k-mer through the next in a text is a step to its successor.

1. Edges are counted, with their distinct successors and predecessors.  Windows
   whose sampled edge occurs once repeat nowhere.
2. A join brings counts back to source coordinates.  Where an edge has one
   successor and that has one predecessor everywhere, the step is nonbranching;
   consecutive ones compact into a path.  All occurrences of any edge of a path
   lie on whole copies of the path, so windows inside it are repeated, and no
   window outside can equal them: they need no more work.
3. The other windows with repeated edges - at ends and branches - are verified:
   96 bits of their whole word sequences, of two hashes, are counted and joined
   back by source coordinates.

Groups of copies of any size meet only in counts (partial sums come before the
shuffle) and in joins whose other side has one row a hash.

Words are ``[^\\x20\\x09-\\x0D]+``.  Hashes have 64 bits; no text is compared.
Defined cases: a null text has no words.  Texts shorter than a window, and
empty tables, lose nothing.  Repeated rows are copies of each other.  Null ids
are ids like others.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.words import Runs, mixed, sliding, word_hashes
from meshloom.llm.workers import tidy
from meshloom.plans.scratch import materialize

WINDOW, KMER = 35, 8


def sampled(runs: Runs, n_words: int, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-mers, the smallest in each window, and the places of sampled k-mers."""
    if n_words < window:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, np.zeros(0, dtype=np.int64)
    edges = runs.every(kmer)
    width = window - kmer + 1
    least = sliding(edges, width, True)
    pad = np.zeros(width - 1, dtype=np.uint64)
    reached = sliding(np.concatenate([pad, least, pad]), width, False)
    return edges, least, np.flatnonzero(reached == edges)


def _text_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, data)``; ``row`` tells rows with equal ids but different texts apart."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _edges(window: int, kmer: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, places, hashes, steps = [], [], [], [], []
            for data in batch.column("data"):
                words = data.as_py().split()
                runs = Runs(word_hashes(words)) if len(words) >= window else Runs(np.zeros(0, dtype=np.uint64))
                edges, _, at = sampled(runs, len(words), window, kmer)
                step = np.zeros(len(at), dtype=np.uint64)
                if len(at):
                    step[:-1] = runs.between(at[:-1], at[1:] + kmer) | np.uint64(1)
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                places.append(at.astype(np.int32))
                hashes.append(edges[at].view(np.int64))
                steps.append(step.view(np.int64))
            columns = [pa.array(counts, pa.int64()), pa.array(shas, pa.string())]
            columns += [pa.array(v, pa.list_(t)) for v, t in ((places, pa.int32()), (hashes, pa.int64()), (steps, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "n_words", "sha", "at", "edge", "step"])

    return work


def _paths(window: int, kmer: int):
    """Settled paths and windows to verify of texts with repeated edges."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled, places, hashes, checks = [], [], [], []
            for data, found in zip(batch.column("data"), batch.column("found").to_pylist(), strict=True):
                words = data.as_py().split()
                each = word_hashes(words)
                runs = Runs(each)
                edges, least, at = sampled(runs, len(words), window, kmer)
                forward, backward, seen = (np.zeros(len(words) + 1, dtype=bool) for _ in range(3))
                for f in found:
                    seen[f["at"]], forward[f["at"]], backward[f["at"]] = True, f["one_next"], f["one_before"]
                whole = seen[at[:-1]] & seen[at[1:]] & forward[at[:-1]] & backward[at[1:]]
                inside, paths = np.zeros(len(words) - window + 1, dtype=bool), []
                turns = np.flatnonzero(np.diff(np.concatenate([[False], whole, [False]]).astype(np.int8)))
                for a, b in zip(turns[::2], turns[1::2], strict=True):
                    start, end = int(at[a]), int(at[b]) + kmer
                    if end - start >= window:
                        inside[start : end - window + 1] = True
                        paths += [start, end]
                open_ = np.flatnonzero(np.isin(least, edges[at[seen[at]]]) & ~inside)
                settled.append(paths)
                places.append(open_.astype(np.int32))
                hashes.append(runs.every(window)[open_].view(np.int64))
                more = Runs(mixed(each)).every(window)[open_] if len(open_) else open_.astype(np.uint64)
                checks.append((more >> np.uint64(32)).astype(np.uint32).view(np.int32))
            kinds = ((settled, pa.int32()), (places, pa.int32()), (hashes, pa.int64()), (checks, pa.int32()))
            columns = [pa.array(v, pa.list_(t)) for v, t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "paths", "at", "window", "check"])

    return work


def _kept(window: int, text: bool):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, out = [], []
            for data, paths, at in zip(batch.column("data"), batch.column("paths").to_pylist(), batch.column("at").to_pylist(), strict=True):
                words = data.as_py().split()
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.array(at or [], dtype=np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + window, -1)
                for start, end in zip((paths or [])[::2], (paths or [])[1::2], strict=True):
                    depth[start] += 1
                    depth[end] -= 1
                covered = np.cumsum(depth[:-1]) > 0
                kept = b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c)
                removed.append(int(covered.sum()))
                out.append(kept if text else hashlib.sha256(kept).hexdigest().encode())
            columns = [pa.array(removed, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "n_removed", "kept"])

    return work


def _schema(rows: DataFrame, **more: str):
    return rows.select("doc_id", "row", *(F.lit(None).cast(kind).alias(name) for name, kind in more.items())).schema


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, row, n_words, sha)`` of all rows, and ``(doc_id, row, paths, at)`` of those with repeated windows.

    ``paths`` has starts and ends of compacted paths in turn, ``at`` the starts of verified windows.
    """
    rows = _text_rows(docs)
    kinds = {"n_words": "long", "sha": "string", "at": "array<int>", "edge": "array<long>", "step": "array<long>"}
    edges = materialize(rows.mapInArrow(tidy(_edges(window, kmer)), _schema(rows, **kinds)), "edges")
    has = edges.where("size(edge) > 0").withColumn("before", F.expr("array_insert(slice(step, 1, size(step) - 1), 1, 0L)"))
    each = has.select("doc_id", "row", F.explode(F.arrays_zip("at", "edge", "step", "before")).alias("e")).select("doc_id", "row", "e.at", "e.edge", "e.step", "e.before")
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
    repeated = each.groupBy("edge").agg(F.count("*").alias("n"), one("step").alias("one_next"), one("before").alias("one_before"))
    repeated = materialize(repeated.where("n > 1").drop("n"), "repeated-edges").withColumnRenamed("edge", "_edge")
    met = each.select("doc_id", "row", "at", "edge").join(repeated, F.col("edge") == F.col("_edge"))
    found = met.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "one_next", "one_before")).alias("found"))
    texts = _match(rows, found, "found")
    open_ = texts.mapInArrow(tidy(_paths(window, kmer)), _schema(rows, paths="array<int>", at="array<int>", window="array<long>", check="array<int>"))
    open_ = materialize(open_, "open-windows")
    starts = open_.where("size(window) > 0").select("doc_id", "row", F.explode(F.arrays_zip("at", "window", "check")).alias("w"))
    starts = starts.select("doc_id", "row", "w.at", "w.window", "w.check")
    again = starts.groupBy("window", "check").agg(F.count("*").alias("n")).where("n > 1").select(F.col("window").alias("_window"), F.col("check").alias("_check"))
    again = materialize(again, "repeated-windows")
    same = (F.col("window") == F.col("_window")) & (F.col("check") == F.col("_check"))
    verified = starts.join(again, same).groupBy("doc_id", "row").agg(F.collect_set("at").alias("at"))
    paths = open_.where("size(paths) > 0").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "paths").dropDuplicates(["_id", "_row"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    both = verified.join(paths, same, "full").select(F.coalesce("doc_id", "_id").alias("doc_id"), F.coalesce("row", "_row").alias("row"), "paths", "at")
    return edges.select("doc_id", "row", "n_words", "sha"), both


def _match(rows: DataFrame, side: DataFrame, *columns: str) -> DataFrame:
    side = side.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), *columns)
    return rows.join(side, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_row")


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, a row for each row of ``docs (doc_id, text)``."""
    known, spans = repeated_spans(docs, window, kmer)
    texts = _match(_text_rows(docs), spans, "paths", "at")
    changed = texts.mapInArrow(tidy(_kept(window, False)), _schema(texts, n_removed="long", kept="binary")).dropDuplicates(["doc_id", "row"])
    changed = changed.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "n_removed", F.col("kept").cast("string").alias("kept"))
    same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return known.join(changed, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256")
    )


def kept_texts(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``(doc_id, text)``: the kept words joined by spaces, of the rows that lose words."""
    _, spans = repeated_spans(docs, window, kmer)
    texts = _match(_text_rows(docs), spans, "paths", "at")
    kept = texts.mapInArrow(tidy(_kept(window, True)), _schema(texts, n_removed="long", kept="binary"))
    return kept.where("n_removed > 0").select("doc_id", F.col("kept").cast("string").alias("text"))
