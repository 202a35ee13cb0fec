"""Byte-level BPE by a sentencepiece model made directly from a rank file.

Every byte of a piece maps to one printable character, so a rank file's entries
become pieces of a BPE model: score minus the rank, identity normalisation, no
added prefix, no white-space escapes.  Merging by best score is then merging by
lowest rank, and piece ids are ranks.  Texts are cut by the pattern first, and
each match is encoded by itself: a match that is an entry becomes that entry,
others go through the model.  Distinct matches are encoded once a worker and
kept, about ``KEPT_BYTES`` of them and those of one text.  Decoding maps ids to bytes.

Defined cases: a null text counts as empty and has no ids.  Texts are taken
whole.  Rows stay as they are, repeated ones too; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.workers import resident, tidy

#: Bytes of distinct pre-tokens and their ids that a worker keeps, about.
KEPT_BYTES = 56 << 20
#: Bytes that one takes besides its characters and ids, about: two objects and a place in a table.
OVERHEAD = 170


def byte_characters() -> list[str]:
    """A character for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {b: chr(b) for b in prints}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(prints)))
    return [shown[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, varint or float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by rank; ranks must be gapless."""
    with open(path, "rb") as f:
        entries = dict((int(rank), base64.b64decode(entry)) for entry, rank in map(bytes.split, f))
    return [entries[k] for k in range(len(entries))]


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the entries; the unknown piece, which never occurs, comes last."""
    shown = byte_characters()
    pieces = b"".join(
        _field(1, _field(1, "".join(shown[b] for b in entry).encode()) + _field(2, -float(rank))) for rank, entry in enumerate(entries)
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(4, len(entries) + 1) + _field(40, len(entries)))
    normaliser = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return pieces + unknown + trainer + normaliser


class Codec:
    """Encodes and decodes whole texts by a rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.entries = read_ranks(path)
        self.ranks = {entry: np.uint32(rank).tobytes() for rank, entry in enumerate(self.entries)}
        self.cut = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.entries))
        shown = byte_characters()
        self.table = {b: shown[b] for b in range(256)}
        self.kept: dict[str, bytes] = {}
        self.held = 0

    def _encode_new(self, tokens: list[str]) -> None:
        """Fill ``kept`` for tokens that it lacks."""
        through = []
        for token in tokens:
            data = token.encode()
            if data in self.ranks:
                self.kept[token] = self.ranks[data]
            else:
                through.append((token, data.decode("latin-1").translate(self.table)))
        for (token, _), ids in zip(through, self.model.encode([x for _, x in through], num_threads=1), strict=True):
            self.kept[token] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        tokens = self.cut(text)
        if self.held > KEPT_BYTES:
            self.kept, self.held = {}, 0
        if new := set(tokens).difference(self.kept):
            self._encode_new(list(new))
            self.held += sum(OVERHEAD + len(t) + len(self.kept[t]) for t in new)
        return b"".join(map(self.kept.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The codec of a rank file that this worker process keeps."""
    return resident((path, pattern), lambda: Codec(path, pattern))


def texts_in(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch one by one; null: empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text, as little-endian unsigned 32-bit integers in a binary."""
    schema = docs.select("doc_id", F.lit(b"").alias("ids")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in texts_in(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(work, keeps=True), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, data)``: the bytes that the ids of ``encoded (doc_id, ids)`` stand for."""
    schema = encoded.select("doc_id", F.lit(b"").alias("data")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data = pa.array([own.decode(x.as_py() or b"") for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(work, keeps=True), schema)


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: both directions in one pass, without keeping the ids."""
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, data_sha = [], [], []
            for text in texts_in(batch, "text"):
                ids = own.encode(text)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                data_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(data_sha)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(work, keeps=True), schema)
