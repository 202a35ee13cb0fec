"""How quality filters act together: what each removes in every order of application.

Rows are dealt by ranges of (fingerprint of the text, ``doc_id``, row) and sorted
inside a range by fingerprint, full text and ``doc_id``.  A task then compares
each text with its predecessor; the first row of a run of equal texts is the one
of the smallest id.  A run may begin in an earlier range: each task also emits
its first and last runs as narrow rows (fingerprint, SHA-256 of the text, least
id), and the first runs meet the last runs of earlier ranges in a small join, a
row or so a range.  As ids are part of the range, a text that a third of all rows
share is many tasks' work.

The other filters look at one text, in the same pass.  What fails is a mask of
bits; masks are counted by part, mask and labels, and everything asked about an
order of the filters is a sum over these counts, so no order is applied to rows.

Defined cases: a null text is empty, and equal to other empty ones; a null
source is part of the part with the empty name; a row without ``doc_id`` neither
is nor makes a duplicate, and has no labels; rows that repeat an id and text are
no duplicates of each other; of several labels of an id the largest counts; a
text of any length is read whole; an empty table gives no rows.  Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.workers import tidy
from meshloom.plans.scratch import materialize

LETTERS = "ABCDE"
#: The bit of the filter that looks for duplicates.
SAME = 1 << LETTERS.index("E")
_SCHEMA = "kind int, range int, doc_id long, part string, mask int, finger long, digest binary, least long"
_NAMES = [column.split()[0] for column in _SCHEMA.split(", ")]
_ROW, _HEAD, _TAIL = 0, 1, 2
_capitals, _marks = bytes(range(65, 91)), b"#$%&*|"


def failures(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    data = text.encode()
    words = data.split()  # at 0x20 and 0x09-0x0D
    capitals = len(data) - len(data.translate(None, _capitals))
    marked = len(data.translate(None, _marks)) < len(data)
    fails = len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), marked
    return sum(1 << bit for bit, failed in enumerate(fails) if failed)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: masks, with duplicates of a predecessor settled but in the first runs.

    Kind ``_HEAD``: the first rows of a run under the range's first fingerprint, which an earlier range may settle.
    Kind ``_TAIL``: a run under its last fingerprint, for later ranges.
    """
    where = TaskContext.get().partitionId()
    first = finger = text = digest = least = mask = None
    tails: list[tuple] = []
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("finger", "doc_id", "part"))
        for f, doc_id, part, value in zip(*columns, batch.column("text"), strict=True):
            now = value.as_py()
            if f != finger or now != text:
                if f != finger:
                    tails = []
                    first = f if finger is None else first
                finger, text, mask = f, now, failures(now)
                digest = hashlib.sha256(now.encode()).digest()
                least = doc_id  # null only if the run has no id, as nulls come last
                if least is not None:
                    tails.append((_TAIL, where, None, None, None, f, digest, least))
            if doc_id is None:
                rows.append((_ROW, where, None, part, mask, None, None, None))
            elif doc_id > least:
                rows.append((_ROW, where, doc_id, part, mask | SAME, None, None, None))
            elif f == first:
                rows.append((_HEAD, where, doc_id, part, mask, f, digest, least))
            else:
                rows.append((_ROW, where, doc_id, part, mask, None, None, None))
        if rows:
            yield _batch(rows)
    if tails:
        yield _batch(tails)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def masks(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask)`` of every row of ``docs (doc_id, text, source)``; bit ``i`` is set where it fails filter ``LETTERS[i]``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("finger"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        text.alias("text"), F.coalesce("source", F.lit("")).alias("part"),
    )
    dealt = rows.repartitionByRange("finger", F.asc_nulls_last("doc_id"), "row").sortWithinPartitions("finger", "text", F.asc_nulls_last("doc_id"))
    # Written once, as a second dealing could end ranges elsewhere.
    compared = materialize(dealt.mapInArrow(tidy(_compare), _SCHEMA), "compared")
    heads = compared.where(F.col("kind") == _HEAD)
    runs = heads.select("range", "finger", "digest", "least").distinct()
    tails = compared.where(F.col("kind") == _TAIL).select(F.col("range").alias("_range"), "finger", "digest", F.col("least").alias("_least"))
    earlier = runs.join(tails, ["finger", "digest"]).where("_range < range and _least < least")
    again = earlier.select("range", "finger", "digest").distinct().withColumn("_again", F.lit(SAME))
    settled = heads.join(again, ["range", "finger", "digest"], "left").withColumn("mask", F.col("mask") + F.coalesce("_again", F.lit(0)))
    names = ["doc_id", "part", "mask"]
    return compared.where(F.col("kind") == _ROW).select(*names).union(settled.select(*names))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows, and those whose ``labels (doc_id, quality, toxic)`` say 1.

    Counters of parts of a table add up to those of the table.
    """
    rows = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))  # a hot id, or rows without one, are few rows now
    own = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = rows.join(own, F.col("doc_id") == F.col("_id"), "left")
    marked = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def roles(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """What a mask means at each step of each order: a fixed table, whatever the data.

    ``weight``: in how many orders the step's filter is the one that removes rows of this mask.
    """
    rows = []
    for order in permutations(letters):
        for step, letter in enumerate(order, 1):
            bit, before = 1 << letters.index(letter), sum(1 << letters.index(x) for x in order[: step - 1])
            for mask in range(1 << len(letters)):
                fails, gone = bool(mask & bit), bool(mask & before)
                weight = factorial(len(letters)) // mask.bit_count() if fails else 0
                rows.append(("".join(order), step, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == bit), weight))
    kinds = "filter_order string, step int, mask int, kept long, removed long, redundant long, unique_fails long, weight long"
    return spark.createDataFrame(rows, kinds)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    A row for each part (``source``), order of the filters and step.
    """
    counted = materialize(counters(masks(docs), labels), "counters")
    met = counted.join(F.broadcast(roles(docs.sparkSession)), "mask")  # 120 orders, 5 steps, 32 masks
    times = lambda role, count="n": F.sum(F.col(role) * F.col(count))
    return met.groupBy("part", "filter_order", "step").agg(
        *(times(role).alias(role) for role in ("kept", "removed", "redundant", "unique_fails")),
        times("removed", "good").alias("good_lost"), times("removed", "toxic").alias("toxic_lost"), times("weight").alias("shapley"),
    )
