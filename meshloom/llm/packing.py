"""Packing documents into sequences of one length by the sum-of-squares rule.

A task takes its rows as a stream: no text and no id shuffles.  A document's
whole windows of ``length`` ids are sequences of their own; the rest, or a
shorter document, is placed in one piece.  An array counts the open windows of
each fill level.  A document goes to the level (an empty window is level 0) at
which the sum of the squared counts becomes least, ties to the fullest; so no
level is left with many windows that wait for a size that does not come.

Windows that are open when the task ends, or when ``MOST_OPEN`` are open, are
closed by cutting: the emptiest are poured into the gaps of the fullest.  What is
left at the end of a task is less than one window, and is cut into sequences of
powers of two, which need no padding.

A sequence's number is the task's, then a count.  Tasks read the same rows in the
same order when they run again, so a lost executor changes nothing.

Defined cases: a null text is empty, and a document of the end id alone; repeated
rows and rows without ``doc_id`` are documents each; a text of any length is read
whole; an empty table gives no pieces.  Other columns, whatever their names, play
no part.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.bpe import texts_in
from meshloom.llm.records import encoder
from meshloom.llm.workers import tidy

LENGTH = 2048
#: Open windows that a task holds at most, so that their ids stay in memory.
MOST_OPEN = 1024
#: Ids of a document are little-endian unsigned 32-bit integers.
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass
class Piece:
    """A run of a document's ids."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]), Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:])


def best_level(counts: np.ndarray, size: int) -> int:
    """The level at which a piece of ``size`` ids raises the sum of squared counts least; ties go to the fullest.

    ``counts`` has the open windows of each level from 0 to the whole length, with none at both ends.
    """
    whole = len(counts) - 1
    from_, to = counts[: whole - size + 1], counts[size:]
    change = 2 * (to - from_)  # the squares of two neighbours change by twice the counts and 1 each
    change += 2
    change[0] = 2 * to[0] + 1
    change[-1] = 1 - 2 * from_[-1]  # a full window is counted at no level
    if size == whole:
        return 0
    usable = from_ > 0
    usable[0] = True
    change[~usable] = np.iinfo(change.dtype).max
    return whole - size - int(np.argmin(change[::-1]))


class Packer:
    """Open windows by fill level; ``take`` and ``end`` return sequences, lists of pieces, that are done."""

    def __init__(self, length: int = LENGTH, most_open: int = MOST_OPEN) -> None:
        self.length, self.most_open = length, most_open
        self._clear()

    def _clear(self) -> None:
        self.counts = np.zeros(self.length + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(self.length + 1)]
        self.n_open = 0

    def take(self, piece: Piece) -> list[list[Piece]]:
        done = []
        while len(piece.ids) >= self.length:
            whole, piece = piece.cut(self.length)
            done.append([whole])
        if len(piece.ids):
            piece.ids = piece.ids.copy()  # a view would keep a long document's ids
            done += self._place(piece)
        if self.n_open > self.most_open:
            done += self._pour(self.most_open // 2)
        return done

    def _place(self, piece: Piece) -> list[list[Piece]]:
        level = best_level(self.counts, len(piece.ids))
        window = [piece]
        if level:
            window = self.open[level].pop() + window
            self.counts[level] -= 1
            self.n_open -= 1
        level += len(piece.ids)
        if level == self.length:
            return [window]
        self._keep(level, window)
        return []

    def _keep(self, level: int, window: list[Piece]) -> None:
        self.open[level].append(window)
        self.counts[level] += 1
        self.n_open += 1

    def _pour(self, left: int) -> list[list[Piece]]:
        """Close windows until ``left`` are open, about: the emptiest window fills the gaps of the fullest, cut where one is full."""
        windows = [(level, w) for level, held in enumerate(self.open) for w in held]  # emptiest first
        self._clear()
        done, at = [], 0
        spare: list[Piece] = []  # of the window that is being poured, first piece last
        while len(windows) - at > left:
            level, window = windows.pop()
            while level < self.length and (spare or at < len(windows)):
                if not spare:
                    spare = windows[at][1][::-1]
                    at += 1
                piece, gap = spare.pop(), self.length - level
                if len(piece.ids) > gap:
                    piece, rest = piece.cut(gap)
                    spare.append(rest)
                window = [*window, piece]
                level += len(piece.ids)
            if level < self.length:  # the last window
                self._keep(level, window)
            else:
                done.append(window)
        if spare:
            self._keep(sum(len(p.ids) for p in spare), spare[::-1])
        for level, window in windows[at:]:
            self._keep(level, window)
        return done

    def end(self) -> list[list[Piece]]:
        done = self._pour(0)
        for window in (w for held in self.open for w in held):
            done += powers_of_two(window)
        self._clear()
        return done


def powers_of_two(window: list[Piece]) -> list[list[Piece]]:
    """The window cut into sequences whose lengths are the powers of two that add up to its own, largest first."""
    rest, found = window[::-1], []
    total = sum(len(p.ids) for p in window)
    for size in (1 << bit for bit in reversed(range(total.bit_length())) if total >> bit & 1):
        sequence = []
        while size:
            piece = rest.pop()
            if len(piece.ids) > size:
                piece, after = piece.cut(size)
                rest.append(after)
            sequence.append(piece)
            size -= len(piece.ids)
        found.append(sequence)
    return found


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1, most_open: int = MOST_OPEN) -> DataFrame:
    """``PIECES`` of ``docs (doc_id, text)``: each document's ids and ``end_id``, every id in one piece of one sequence."""
    if length < 1 or most_open < 1:
        raise ValueError("length and most_open must be at least 1")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, packer = encoder(tokenizer), Packer(length, most_open)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                done = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_in(part, "text"), strict=True):
                    ids = np.frombuffer(own.encode(text), dtype=f"<u{own.width}")
                    ids = np.append(ids, end_id).astype(f"<u{own.width}")
                    done += packer.take(Piece(doc_id, 0, len(ids), ids))
                yield _rows(done, number)
                number += len(done)
        yield _rows(packer.end(), number)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(work, keeps=True), PIECES)


def _rows(sequences: list[list[Piece]], number: int) -> pa.RecordBatch:
    rows = []
    for nth, sequence in enumerate(sequences, number):
        offset = 0
        for p in sequence:
            rows.append((p.doc_id, p.start, len(p.ids), p.doc_tokens, nth, offset, p.ids.astype("<u4").tobytes()))
            offset += len(p.ids)
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    names = [column.split()[0] for column in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], names)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: whole sequences as little-endian unsigned 32-bit integers, padded to ``length`` except at a power of two.

    A sequence has ``length`` pieces at most, so no group grows with the input.
    """
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("held", F.lit(b""), lambda all_, one: F.concat(all_, one["ids"]))
    missing = F.when(F.bit_count("n_tokens") == 1, F.lit(0)).otherwise(length - F.col("n_tokens")).cast("int")
    padding = F.unhex(F.repeat(F.lit(struct.pack("<I", pad_id).hex()), missing))
    return held.select("sequence_id", "n_tokens", F.concat(ids, padding).alias("ids"))
