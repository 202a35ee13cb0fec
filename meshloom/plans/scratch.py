"""Cutting lineage through tables in the folder that all executors share.

Iterative operators write what they keep between rounds as Parquet and read it
back.  A lost executor then costs only the tasks it ran, not the rounds before.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; in local mode a temporary one where the setting is absent (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="meshloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; it is deleted when the process ends, or by ``release`` and ``clear_since``."""
    path = f"{checkpoint_root(spark)}/meshloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that reads it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more."""
    for table in tables:
        if table is not None and (path := _tables.pop(table, None)):
            _forget(lambda p, path=path: p == path)


def mark() -> int:
    """For ``clear_since``: what has been written so far."""
    return len(_written)


def clear_since(at: int, kept: DataFrame) -> None:
    """Delete all scratch tables written since ``at`` but ``kept``, once that is written and holds all that is needed."""
    later = {path for _, path in _written[at:]} - {_tables.get(kept)}
    _forget(lambda path: path in later)


def _forget(which: Callable[[str], bool]) -> None:
    for spark, path in [w for w in _written if which(w[1])]:
        _written.remove((spark, path))
        with contextlib.suppress(Exception):  # it goes at the end of the process at the latest
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def clear() -> None:
    """Delete every scratch table that this process wrote."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)
