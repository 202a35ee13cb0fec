"""A pipeline over documents: each stage's table is written and read again by the next.

Defined cases: null and empty texts pass the stages as each operator states; rows without an id stay, but for copies of
each other; repeated rows leave one row; other columns, whatever their names, go along up to the last stage; an empty
table gives an empty one.  The scratch tables of a stage go once its table is written.

A stage lowers the session's bound on the bytes of a batch for Python workers to ``BATCH_BYTES``, and it stays so, as a
stage's last plan is made when its table is written.  A batch is in an executor several times: in the JVM outside its
heap, where freed memory is kept, and in the worker.  No result depends on where batches end.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshloom.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from meshloom.llm.queries import MULTILINGUAL_RANKS
from meshloom.plans.scratch import clear_since, mark, materialize

ORACLE_SQL = None
#: Bytes of rows that go to a Python worker at once, about; a longer row goes alone.
BATCH_BYTES = 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, for a session whose batches have ``BATCH_BYTES`` at most; a lower bound of its own stays."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        most = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
        if not 0 < most <= BATCH_BYTES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that it rejects go; it learns from the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each component of similar texts stays."""
    return ngram_join.drop_near_copies(docs)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix takes it."""
    return mixing.mixed(docs)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token counts, and digests of the ids and of the bytes that they decode to."""
    return bpe.round_trip(docs, MULTILINGUAL_RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = mark()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
