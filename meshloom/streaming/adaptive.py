"""Keeping a partition good while edges arrive in micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from meshloom.operators import graphs, metrics, partitioning, repartition
from meshloom.plans.options import PartitionOptions
from meshloom.plans.scratch import delete, materialize, release, scratch_path
from meshloom.sources.matrix_files import exists


@dataclass(frozen=True)
class Commit:
    """What a batch leaves behind: ``base`` is the batch that wrote whole tables last, ``cut`` that of the last repartitioning."""

    batch: int = -1
    base: int = -1
    cut: int = 0


class AdaptivePartition:
    """Edges and parts that survive the driver: a folder a batch under ``path``, and a commit once both are written.

    A batch appends the edges that are new or lighter, and the vertices whose part changed; every ``merge_every``
    batches the tables are written whole.  What a batch without its commit left is not read and is written over when
    that batch comes again; a committed batch that comes again changes nothing.  Without ``path`` the tables are
    in the shared scratch folder and end with the process.

    New vertices take the part that most of their edges lead to, else a hashed one.  When the cut has
    grown by ``tolerance`` since the last repartitioning, the graph is repartitioned adaptively.
    """

    def __init__(self, options: PartitionOptions, ipc: float = 1000.0, tolerance: float = 0.2, path: str | None = None, merge_every: int = 32) -> None:
        self.options, self.ipc, self.tolerance, self.merge_every = options.checked(1), ipc, tolerance, merge_every
        self.path = path.rstrip("/") if path else None
        self._at: Commit | None = None
        self._spark: SparkSession | None = None

    def open(self, spark: SparkSession) -> Commit:
        """The last commit under the path."""
        self._spark = spark
        if self.path is None:
            self.path = scratch_path(spark, "stream")
        if self._at is None:
            self._at = Commit()
            if exists(spark, f"{self.path}/commits"):
                rows = spark.read.schema("batch long, base long, cut long").json(f"{self.path}/commits/*")
                last = rows.agg(F.max(F.struct("batch", "base", "cut")).alias("c")).first()["c"]  # a row a batch
                self._at = Commit(*last) if last is not None else Commit()
        return self._at

    def _rows(self, table: str, schema: str, at: Commit) -> DataFrame | None:
        if at.batch < 0:
            return None
        rows = self._spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{table}")
        return rows.where(F.col("batch").between(at.base, at.batch))

    def _edges(self, at: Commit) -> DataFrame | None:
        rows = self._rows("edges", "src long, dst long, wgt long", at)
        return None if rows is None else rows.groupBy("src", "dst").agg(F.min("wgt").alias("wgt"))

    def _part(self, at: Commit) -> DataFrame | None:
        rows = self._rows("part", "id long, pid int", at)
        return None if rows is None else rows.groupBy("id").agg(F.max_by("pid", "batch").alias("pid"))

    @property
    def edges(self) -> DataFrame | None:
        """``(src, dst, wgt)`` as committed; None before the first batch."""
        return self._edges(self._at) if self._at else None

    @property
    def part(self) -> DataFrame | None:
        """``(id, pid)`` as committed; None before the first batch."""
        return self._part(self._at) if self._at else None

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch of edges ``(src, dst, wgt)``, either direction."""
        at = self.open(batch.sparkSession)
        if batch_id <= at.batch:
            return
        new = graphs.fix(batch).select("src", "dst", F.col("wgt").cast("long").alias("wgt"))
        known, old = self._edges(at), self._part(at)
        whole = known is None or batch_id - at.base >= self.merge_every
        next_ = Commit(batch_id, batch_id if whole else at.base, at.cut)
        if known is None:
            more = new
        elif whole:
            more = known.union(new).groupBy("src", "dst").agg(F.min("wgt").alias("wgt"))
        else:
            held = known.withColumnRenamed("wgt", "_held")
            more = new.join(held, ["src", "dst"], "left").where("_held is null or wgt < _held").select("src", "dst", "wgt")
        self._write(more, "edges", batch_id)
        edges = materialize(self._edges(next_), "stream-edges")
        if old is None:
            part = partitioning.partition(edges, self.options)
        else:
            part = materialize(old.union(self._placed(edges, old)), "stream-part")
        now = metrics.edge_cut(metrics.with_parts(edges, part)).first()[0] or 0
        if old is not None and now > (1 + self.tolerance) * at.cut:
            part = repartition.adaptive_repartition(edges, part, self.options, self.ipc)
            now = metrics.edge_cut(metrics.with_parts(edges, part)).first()[0] or 0
            next_ = Commit(next_.batch, next_.base, now)
        elif old is None:
            next_ = Commit(next_.batch, next_.base, now)
        changed = part
        if not whole:
            changed = part.join(old.withColumnRenamed("pid", "_old"), "id", "left").where("_old is null or _old <> pid").select("id", "pid")
        self._write(changed, "part", batch_id)
        self._commit(next_)
        release(edges)

    def _placed(self, edges: DataFrame, part: DataFrame) -> DataFrame:
        """``(id, pid)`` of the vertices without a part."""
        ids = graphs.vertices_of(edges).join(part.select("id"), "id", "left_anti")
        near = edges.join(ids.withColumnRenamed("id", "src"), "src").join(part.withColumnRenamed("id", "dst"), "dst")
        votes = near.groupBy("src", "pid").agg(F.sum("wgt").alias("w")).groupBy(F.col("src").alias("id")).agg(F.max_by("pid", F.struct("w", -F.col("pid"))).alias("p"))
        hashed = F.pmod(F.xxhash64("id"), F.lit(self.options.nparts)).cast("int")
        return ids.join(votes, "id", "left").select("id", F.coalesce("p", hashed).alias("pid"))

    def _commit(self, new: Commit) -> None:
        """One row in one file, which its task puts in place whole; then folders that no commit reads go."""
        old = self._at
        row = self._spark.createDataFrame([tuple(asdict(new).values())], "batch long, base long, cut long")
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/batch={new.batch}")
        self._at = new
        if new.base > old.base >= 0:
            for batch in range(old.base, old.batch + 1):
                for table in ("edges", "part"):
                    delete(self._spark, f"{self.path}/{table}/batch={batch}")


def maintain(stream: DataFrame, state: AdaptivePartition, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that applies each micro-batch of an edge stream to ``state`` and passes its parts to ``then``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        state.apply(batch, batch_id)
        if then is not None:
            then(state.part, batch_id)

    return stream.writeStream.foreachBatch(each)
