"""Token ids as length-delimited binary records, with an offset index beside them.

A record is, little-endian: the payload's length (8 bytes), the masked CRC-32
of those 8 bytes (4), the payload, its masked CRC-32 (4), and a line feed.  A
payload is: whether it has a document id (1 byte), the id (8), the width of a
token id (1: 2 or 4 bytes), the number of token ids (4), and the token ids.

Documents are dealt by ranges of ids, ``RANGE_BYTES`` of text to a range about, and
sorted in each.  A range starts another file, in the folder of the next chunk,
after ``CHUNK_BYTES``, so that no file grows with the input; files in order of
range and chunk hold ascending ids.  Spark's own writer commits the files, in
any store it can write to; a task that is lost runs again.  The text writer is
that writer: it puts a record's bytes down as they are and a line feed after
them.  The index has, for each record, its file, offset and length, the
document id, the number of token ids and how many come before it in its file; a
shuffled read seeks by it.

Texts are encoded as the tokenizers library does by default: the content of an
added token in a text becomes that token.  With ``special_as_text`` it is text
like any other.

Defined cases: a null text counts as empty, and its record holds the end id
only.  A null document id sorts first.  Repeated rows get a record each.  An
empty table makes no records.  A damaged record raises ``ValueError``.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshloom.llm.bpe import byte_characters
from meshloom.llm.pretokens import PieceEncoder
from meshloom.llm.workers import resident, tidy

HEAD = struct.Struct("<QI")
PAYLOAD = struct.Struct("<BqBI")
INDEX = "part long, chunk long, file string, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"
#: Text of a range of documents, about, and records of a file at most, but for the last one.
RANGE_BYTES, CHUNK_BYTES = 32 << 20, 64 << 20


def masked_crc(data: bytes) -> int:
    """A CRC-32, rotated and shifted so that checksums of checksums are safe."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload)) + b"\n"


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The offset and payload of each record of a file, all checksums verified."""
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise ValueError(f"a record's head is cut short at {at}")
        n, crc = HEAD.unpack_from(data, at)
        end = at + HEAD.size + n
        if masked_crc(data[at : at + 8]) != crc or len(data) < end + 5 or data[end + 4] != 10:
            raise ValueError(f"a record's length is damaged at {at}")
        payload = data[at + HEAD.size : end]
        if masked_crc(payload) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError(f"a record's payload is damaged at {at}")
        yield at, payload
        at = end + 5


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return PAYLOAD.pack(doc_id is not None, doc_id or 0, width, len(ids)) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width, n = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=PAYLOAD.size)
    if len(ids) != n:
        raise ValueError("a payload has another number of token ids than it says")
    return (doc_id if known else None), ids.astype("<u4")


class _Encoder(PieceEncoder):
    """A piece of letters alone is one pre-token and goes to the library's merges directly, which costs half as much."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = () if special_as_text else tuple(added)
        self.merge = self.library.model.tokenize
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.shown = dict(enumerate(byte_characters()))  # the characters that the vocabulary shows bytes by
        self.space = self.shown[ord(" ")]
        self.one = [k.to_bytes(self.width, "little") for k in range(self.library.get_vocab_size())]
        super().__init__(self._many)

    def encode(self, text: str) -> bytes:
        """The ids of a text; the library itself looks for added tokens in texts that hold the content of one."""
        if any(content in text for content in self.added):
            return self._little(self.library.encode(text, add_special_tokens=False).ids)
        return super().encode(text)

    def _little(self, ids: list[int]) -> bytes:
        made = array(self.kind, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def encode_words(self, words: list[str], space: str | None = None) -> list[bytes]:
        merge, one, join, shown = self.merge, self.one, b"".join, self.shown
        space = self.space if space is None else space
        found = []
        for word in words:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(shown)
            found.append(join([one[x.id] for x in merge(space + word)]))
        return found

    def _many(self, texts: list[str]) -> list[bytes]:
        if len(texts) == 1 and texts[0].isalpha():
            return self.encode_words(texts, "")
        return [self._little(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str, special_as_text: bool = False) -> _Encoder:
    """The encoder that this worker process keeps."""
    return resident((path, special_as_text), lambda: _Encoder(path, special_as_text))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, special_as_text: bool = False) -> None:
    """Encode ``docs (doc_id, text)`` and write the records under ``path/data/chunk=K``."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer, special_as_text)
        nth = total = 0
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                made, chunks, first = [], [], nth
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = np.frombuffer(own.encode(text.as_py() or ""), dtype=f"<u{own.width}")
                    record = frame(pack(doc_id, np.append(ids, end_id), own.width))
                    made.append(record[:-1])  # the writer adds the line feed
                    chunks.append(total // CHUNK_BYTES)
                    total += len(record)
                    nth += 1
                columns = [pa.array(chunks, pa.int64()), pa.array(range(first, nth), pa.int64()), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "nth", "record"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Repeated ids are one key, so the row's number deals them to several ranges.
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(max(1, -(-size // RANGE_BYTES)), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    records = rows.select("doc_id", "text").mapInArrow(tidy(work, keeps=True), "chunk long, nth long, record binary")
    records = records.sortWithinPartitions("chunk", "nth").select("chunk", F.col("record").cast("string").alias("value"))
    records.write.partitionBy("chunk").option("lineSep", "\n").text(f"{path}/data")


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 6
    for batch in batches:
        for part, chunk, file, content in zip(*(batch.column(c).to_pylist() for c in names[:3]), batch.column("content"), strict=True):
            rows, before = [], 0
            for at, payload in frames(content.as_py()):
                doc_id, ids = unpack(payload)
                rows.append((part, chunk, file, at, len(payload) + HEAD.size + 5, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                before += len(ids)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(part, chunk, file, content)``: the range's number, the chunk's, and the path under ``data``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/data")
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    return files.select(
        number("/part-(\\d+)[^/]*$").alias("part"), number("/chunk=(\\d+)/[^/]*$").alias("chunk"), F.regexp_extract("path", "(chunk=\\d+/[^/]*)$", 1).alias("file"), "content"
    )


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Verify every record under ``path/data`` and write the index under ``path/index``; returns it."""
    _files(spark, path).mapInArrow(tidy(_scan), INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the token ids of all documents before, in ascending order of ids."""
    spark = index.sparkSession
    counts = index.groupBy("part", "chunk", "file").agg(F.sum("n_tokens").alias("n")).orderBy("part", "chunk").collect()  # a row a file
    base, rows = 0, []
    for r in counts:
        rows.append((r["file"], base))
        base += r["n"]
    bases = spark.createDataFrame(rows, "file string, base long")
    return index.join(F.broadcast(bases), "file").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, ids)`` of all records, the ids as an array."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = [unpack(p) for _, p in frames(content.as_py())]
                columns = [pa.array([d for d, _ in found], pa.int64()), pa.array([i.astype("i8") for _, i in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])

    return _files(spark, path).mapInArrow(tidy(work), "doc_id long, ids array<long>")
