"""Sparse matrices in text and binary files, flat arrays, and a registry by file extension."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.sources.graph_files import read_graph, read_vector, write_graph, write_vector
from meshloom.sources.lines import head, numbered, numbers, write_lines

#: Bytes of a binary file that one task takes at once.
CHUNK = 1 << 22


def _entries(rows: DataFrame, values: bool, base: int) -> DataFrame:
    """``(row, col, val)`` from ``(row, v)`` with alternating columns and values, or columns alone."""
    step = 2 if values else 1
    at = F.explode(F.when(F.size("v") > 0, F.sequence(F.lit(0), F.size("v") - 1, F.lit(step))).otherwise(F.array().cast("array<int>")))
    each = rows.select("row", "v", at.alias("i"))
    val = F.get("v", F.col("i") + 1) if values else F.lit(1.0)
    return each.select("row", (F.get("v", F.col("i")).cast("long") - base).alias("col"), val.cast("double").alias("val"))


def read_csr(spark: SparkSession, path: str, values: bool = True, base: int = 1) -> DataFrame:
    """Lines of columns and values, no header."""
    rows = numbered(spark, path, comments="").select(F.col("nth").alias("row"), numbers(kind="double").alias("v"))
    return _entries(rows, values, base)


def read_cluto(spark: SparkSession, path: str, values: bool = True, base: int = 1) -> DataFrame:
    """As :func:`read_csr`, after a line with the numbers of rows, columns and entries."""
    n, m, nnz = (int(x) for x in head(spark, path, "").split()[:3])
    rows = numbered(spark, path, comments="").where("nth > 0").select((F.col("nth") - 1).alias("row"), numbers(kind="double").alias("v")).where(F.col("row") < n)
    found = _entries(rows, values, base)
    row = found.agg(F.count("*").alias("n"), F.max("col").alias("c")).first()
    if row["n"] != nnz or (row["c"] is not None and row["c"] >= m):
        raise ValueError(f"{path}: entries differ from the header")
    return found


def read_ijv(spark: SparkSession, path: str, values: bool = True, base: int = 1) -> DataFrame:
    """A line an entry."""
    v = numbers(kind="double")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line")).select(v.alias("v"))
    val = F.get("v", F.lit(2)) if values else F.lit(1.0)
    return rows.select((F.get("v", F.lit(0)).cast("long") - base).alias("row"), (F.get("v", F.lit(1)).cast("long") - base).alias("col"), val.alias("val"))


def _matrix_lines(m: DataFrame, values: bool, base: int) -> DataFrame:
    item = F.struct((F.col("col") + base).alias("c"), F.col("val").alias("v"))
    rows = m.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("l"))
    text = lambda x: F.concat_ws(" ", x["c"].cast("string"), x["v"].cast("string")) if values else x["c"].cast("string")
    last = (m.agg(F.max("row")).first()[0] or 0) + 1
    every = m.sparkSession.range(last).withColumnRenamed("id", "row")
    line = F.array_join(F.transform(F.coalesce("l", F.array().cast(rows.schema["l"].dataType)), text), " ")
    return every.join(rows, "row", "left").select("row", line.alias("line"))


def write_csr(m: DataFrame, path: str, values: bool = True, base: int = 1) -> None:
    write_lines(_matrix_lines(m, values, base), ["row"], path)


def write_cluto(m: DataFrame, path: str, values: bool = True, base: int = 1) -> None:
    s = m.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count("*").alias("n")).first()
    write_lines(_matrix_lines(m, values, base), ["row"], path, f"{(s['r'] or 0) + 1} {(s['c'] or 0) + 1} {s['n']}")


def write_ijv(m: DataFrame, path: str, values: bool = True, base: int = 1) -> None:
    columns = [F.col("row") + base, F.col("col") + base, *([F.col("val")] if values else [])]
    m.select(F.concat_ws(" ", *(c.cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


# -- binary -----------------------------------------------------------------


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _decode_rows(data: bytes, values: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a file by rows: sizes, offsets (8 bytes each), columns (4), values (4)."""
    n, _ = struct.unpack_from("<ii", data)
    offsets = np.frombuffer(data, "<i8", n + 1, 8)
    at = 8 + 8 * (n + 1)
    nnz = int(offsets[-1])
    col = np.frombuffer(data, "<i4", nnz, at)
    val = np.frombuffer(data, "<f4", nnz, at + 4 * nnz) if values else np.ones(nnz)
    return np.repeat(np.arange(n), np.diff(offsets)), col, val


def read_binary(spark: SparkSession, path: str, by: str = "row", values: bool = True) -> DataFrame:
    """A matrix by rows or by columns, one file a task; ids from 0."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                a, b, val = _decode_rows(data, values)
                for at in range(0, len(a), CHUNK):
                    part = slice(at, at + CHUNK)
                    row, col = (a, b) if by == "row" else (b, a)
                    yield pd.DataFrame({"row": row[part].astype("i8"), "col": col[part].astype("i8"), "val": val[part].astype("f8")})

    return _whole_files(spark, path).mapInPandas(work, "row long, col long, val double")


def read_binary_ijv(spark: SparkSession, path: str, values: bool = True) -> DataFrame:
    """Triplets of two 4-byte ids and a 4-byte value, after the numbers of rows, columns (4 bytes) and entries (8)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype([("i", "<i4"), ("j", "<i4")] + ([("v", "<f4")] if values else []))
        for batch in batches:
            for data in batch["content"]:
                n = struct.unpack_from("<q", data, 8)[0]
                rows = np.frombuffer(data, kind, n, 16)
                for at in range(0, n, CHUNK):
                    part = rows[at : at + CHUNK]
                    val = part["v"].astype("f8") if values else np.ones(len(part))
                    yield pd.DataFrame({"row": part["i"].astype("i8"), "col": part["j"].astype("i8"), "val": val})

    return _whole_files(spark, path).mapInPandas(work, "row long, col long, val double")


def write_binary_ijv(m: DataFrame, path: str, values: bool = True) -> None:
    """One binary file of triplets by row and column, as ``read_binary_ijv`` reads it; the driver streams them partition by partition."""
    size = m.agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"), F.count("*").alias("n")).first()
    kind = np.dtype([("i", "<i4"), ("j", "<i4")] + ([("v", "<f4")] if values else []))
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(struct.pack("<iiq", size["r"] or 0, size["c"] or 0, size["n"]))
        for r in m.select("row", "col", "val").orderBy("row", "col").toLocalIterator():
            f.write(np.array([(r["row"], r["col"], r["val"]) if values else (r["row"], r["col"])], dtype=kind).tobytes())


def write_binary(m: DataFrame, path: str, by: str = "row", values: bool = True) -> None:
    """One binary file, streamed by the driver in order; for matrices by rows or by columns that fit the format's 4-byte ids."""
    a, b = ("row", "col") if by == "row" else ("col", "row")
    size = m.agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"), F.count("*").alias("n")).first()
    n, other = (size["r"], size["c"]) if by == "row" else (size["c"], size["r"])
    counts = m.groupBy(a).agg(F.count("*").alias("n")).orderBy(a)
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(struct.pack("<ii", n or 0, other or 0))
        at, nth = 0, 0
        for r in counts.toLocalIterator():
            f.write(struct.pack("<q", at) * (r[a] - nth + 1))
            nth, at = r[a] + 1, at + r["n"]
        f.write(struct.pack("<q", at) * ((n or 0) - nth + 1))
        for column, kind in ((b, "<i"), ("val", "<f")) if values else ((b, "<i"),):
            for r in m.select(a, b, "val").orderBy(a, b).toLocalIterator():
                f.write(struct.pack(kind, r[column]))


def read_array(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    """``(id, value)`` of a flat little-endian file: ``int32``, ``int64``, ``float32`` or ``float64``."""
    kind = "long" if dtype.startswith("int") else "double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                x = np.frombuffer(data, np.dtype(dtype).newbyteorder("<"))
                for at in range(0, len(x), CHUNK):
                    part = x[at : at + CHUNK]
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "value": part.astype("i8" if kind == "long" else "f8")})

    return _whole_files(spark, path).mapInPandas(work, f"id long, value {kind}")


def write_array(rows: DataFrame, path: str, dtype: str) -> None:
    """Write ``(id, value)`` in the order of ids as a flat little-endian file, streamed by the driver."""
    with open(path.removeprefix("file://"), "wb") as f:
        for r in rows.select("id", "value").orderBy("id").toLocalIterator():
            f.write(np.array([r["value"]], np.dtype(dtype).newbyteorder("<")).tobytes())


# -- registry ---------------------------------------------------------------


def _graph_as_matrix(spark: SparkSession, path: str) -> DataFrame:
    edges, _ = read_graph(spark, path)
    return edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("wgt").cast("double").alias("val"))


def _matrix_as_graph(m: DataFrame, path: str) -> None:
    n = m.agg(F.max(F.greatest("row", "col"))).first()[0]
    vertices = m.sparkSession.range((n if n is not None else -1) + 1)
    write_graph(m.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("val").cast("long").alias("wgt")), vertices, path)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "graph": _graph_as_matrix, "chaco": _graph_as_matrix, "csr": read_csr, "clu": read_cluto, "mat": read_cluto, "ijv": read_ijv,
    "binr": read_binary, "binc": lambda s, p: read_binary(s, p, "col"), "bijv": read_binary_ijv,
    **{x: lambda s, p: read_vector(s, p, "double") for x in ("txt", "vec", "perm", "part", "cluster")},
}
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "graph": _matrix_as_graph, "chaco": _matrix_as_graph, "csr": write_csr, "clu": write_cluto, "mat": write_cluto, "ijv": write_ijv,
    "binr": write_binary, "binc": lambda m, p: write_binary(m, p, "col"), "bijv": write_binary_ijv, **{x: write_vector for x in ("txt", "vec", "perm", "part", "cluster")},
}


def extension(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read by the path's extension."""
    if (kind := extension(path)) not in READERS:
        raise ValueError(f"no reader for {kind!r}")
    return READERS[kind](spark, path)


def save(table: DataFrame, path: str) -> None:
    """Write by the path's extension."""
    if (kind := extension(path)) not in WRITERS:
        raise ValueError(f"no writer for {kind!r}")
    WRITERS[kind](table, path)


def shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Rows, columns and entries; from the header where the format has one."""
    kind = extension(path)
    if kind in ("graph", "chaco"):
        n, m = (int(x) for x in head(spark, path).split()[:2])
        return n, n, 2 * m
    if kind in ("clu", "mat"):
        return tuple(int(x) for x in head(spark, path, "").split()[:3])
    row = load(spark, path).agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"), F.count("*").alias("n")).first()
    return row["r"] or 0, row["c"] or 0, row["n"]


# -- files ------------------------------------------------------------------


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Lines, tokens, most tokens of a line, and bytes with line ends."""
    tokens = F.size(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""))
    return spark.read.text(path).agg(
        F.count("*").alias("lines"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.max(tokens), F.lit(0)).alias("most_tokens"),
        F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).cast("long").alias("bytes"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def path_parts(path: str) -> dict[str, str]:
    """Folder, file name, base name and extension."""
    folder, _, name = path.rpartition("/")
    base, dot, ext = name.rpartition(".")
    return {"folder": folder, "filename": name, "basename": base if dot else name, "extension": ext if dot else ""}
