"""Graphs, meshes, partitions, orders, target weights and coordinates as text files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.sources.lines import head, numbered, numbers, write_lines

#: Nodes of an element by the type in a distributed mesh's header: triangle, tetrahedron, hexahedron, quadrilateral.
ELEMENT_SIZES = {1: 3, 2: 4, 3: 8, 4: 4}


def _need(good, message: str):
    """Raises ``message`` where ``good`` fails."""
    return F.when(~F.coalesce(good, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)


def graph_header(line: str) -> tuple[int, int, bool, bool, bool, int]:
    """Vertices, edges, whether sizes, vertex weights and edge weights are there, and constraints."""
    found = line.split()
    if not 2 <= len(found) <= 4 or not all(x.isdigit() for x in found):
        raise ValueError(f"bad header {line!r}")
    fmt = found[2].zfill(3) if len(found) > 2 else "000"
    if len(fmt) > 3 or set(fmt) - {"0", "1"}:
        raise ValueError(f"bad format {fmt!r}")
    ncon = int(found[3]) if len(found) > 3 else 0
    if ncon > 0 and fmt[1] == "0":
        raise ValueError("constraints without vertex weights")
    return int(found[0]), int(found[1]), fmt[0] == "1", fmt[1] == "1", fmt[2] == "1", max(1, ncon)


def read_graph(spark: SparkSession, path: str, weights: str = "long") -> tuple[DataFrame, DataFrame]:
    """``(src, dst, wgt)`` and ``(id, vsize, vwgt)``, ids from 0.

    Ranges and counts are checked: rows that break them raise when read, and another number of rows or
    edges than the header has raises at once.
    """
    n, m, has_size, has_vwgt, has_wgt, ncon = graph_header(head(spark, path))
    rows = numbered(spark, path).where("nth > 0").select((F.col("nth") - 1).alias("id"), numbers(kind=weights).alias("v"))
    rows = rows.where((F.col("id") < n) | (F.size("v") > 0))
    skip = int(has_size) + (ncon if has_vwgt else 0)
    one = F.lit(1).cast(weights)
    size = F.coalesce(F.get("v", F.lit(0)), one) if has_size else one
    vwgt = F.slice("v", 1 + int(has_size), ncon) if has_vwgt else F.array(*[one] * ncon)
    bad = F.exists(vwgt, lambda x: x < 0) | (size < 0) | (F.size(vwgt) != ncon)
    vertices = rows.select("id", size.alias("vsize"), vwgt.alias("vwgt"), _need(~bad, "a vertex has bad weights").alias("_ok")).where("_ok").drop("_ok")
    step = 2 if has_wgt else 1
    rest = F.slice("v", skip + 1, F.greatest(F.size("v") - skip, F.lit(0)))
    at = F.explode(F.when(F.size(rest) > 0, F.sequence(F.lit(0), F.size(rest) - 1, F.lit(step))).otherwise(F.array().cast("array<int>")))
    each = rows.select("id", rest.alias("r"), at.alias("i"))
    wgt = F.get("r", F.col("i") + 1) if has_wgt else one
    edges = each.select(F.col("id").alias("src"), (F.get("r", F.col("i")).cast("long") - 1).alias("dst"), wgt.alias("wgt"))
    good = F.col("dst").between(0, n - 1) & (F.col("wgt") > 0)
    edges = edges.withColumn("_ok", _need(good, "an edge has a bad end or weight")).where("_ok").drop("_ok")
    rows_found, edges_found = vertices.count(), edges.count()
    if rows_found != n or edges_found != 2 * m:
        raise ValueError(f"{path}: {rows_found} rows for {n} vertices, {edges_found} entries for {m} edges")
    return edges, vertices


def write_graph(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """Weights are written only where some value differs from 1; ids are shifted to start at 1."""
    kind = dict(vertices.dtypes)
    vwgt = F.col("vwgt") if kind.get("vwgt", "").startswith("array") else F.array(F.col("vwgt") if "vwgt" in kind else F.lit(1))
    vsize = F.col("vsize") if "vsize" in kind else F.lit(1)
    v = vertices.select("id", vsize.alias("vsize"), vwgt.alias("vwgt"))
    facts = v.agg(F.count("*").alias("n"), F.max(F.size("vwgt")).alias("ncon"), F.max(F.col("vsize") != 1).alias("s"), F.max(F.exists("vwgt", lambda x: x != 1)).alias("v")).first()
    e = edges.agg(F.count("*").alias("m"), F.max(F.col("wgt") != 1).alias("w")).first()
    has = [bool(facts["s"]), bool(facts["v"]) or (facts["ncon"] or 1) > 1, bool(e["w"])]
    header = f"{facts['n']} {e['m'] // 2}"
    if any(has):
        header += " " + "".join("01"[x] for x in has) + (f" {facts['ncon']}" if has[1] and facts["ncon"] > 1 else "")
    item = F.struct((F.col("dst") + 1).alias("d"), F.col("wgt").alias("w"))
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    text = lambda x: F.concat_ws(" ", x["d"].cast("string"), x["w"].cast("string")) if has[2] else x["d"].cast("string")
    parts = ([F.col("vsize").cast("string")] if has[0] else []) + ([F.array_join(F.col("vwgt").cast("array<string>"), " ")] if has[1] else [])
    line = F.concat_ws(" ", *parts, F.array_join(F.transform(F.coalesce("l", F.array().cast(lists.schema["l"].dataType)), text), " "))
    write_lines(v.join(lists, "id", "left").select("id", F.trim(line).alias("line")), ["id"], path, header)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(elem, pos, node)`` and ``(id, vwgt)`` of elements, ids from 0; header: elements, constraints."""
    found = [int(x) for x in head(spark, path).split()]
    n, ncon = found[0], found[1] if len(found) > 1 else 0
    rows = numbered(spark, path).where("nth > 0").select((F.col("nth") - 1).alias("elem"), numbers().alias("v")).where((F.col("elem") < n) | (F.size("v") > 0))
    weights = F.slice("v", 1, ncon) if ncon else F.array(F.lit(1).cast("long"))
    nodes = rows.select("elem", F.posexplode(F.slice("v", ncon + 1, F.greatest(F.size("v") - ncon, F.lit(0)))).alias("pos", "node"))
    nodes = nodes.withColumn("_ok", _need(F.col("node") > 0, "a node id is below 1")).where("_ok")
    if (have := rows.count()) != n:
        raise ValueError(f"{path}: {have} rows for {n} elements")
    return nodes.select("elem", "pos", (F.col("node") - 1).alias("node")), rows.select(F.col("elem").alias("id"), weights.alias("vwgt"))


def read_typed_mesh(spark: SparkSession, path: str) -> DataFrame:
    """``(elem, pos, node)`` of a mesh whose header has the element type, so that every line has as many nodes."""
    n, kind = (int(x) for x in head(spark, path).split()[:2])
    size = ELEMENT_SIZES[kind]
    rows = numbered(spark, path).where("nth > 0").select((F.col("nth") - 1).alias("elem"), numbers().alias("v")).where(F.col("elem") < n)
    rows = rows.withColumn("_ok", _need(F.size("v") == size, f"an element has not {size} nodes")).where("_ok")
    return rows.select("elem", F.posexplode("v").alias("pos", "node")).withColumn("node", F.col("node") - 1)


def read_vector(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``(id, value)``: a value a line."""
    rows = numbered(spark, path, comments="", blanks=False)
    return rows.select(F.col("nth").alias("id"), F.trim("line").cast(kind).alias("value"))


def read_partition(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    part = read_vector(spark, path, "int").withColumnRenamed("value", "pid")
    if n is not None and (have := part.count()) != n:
        raise ValueError(f"{path}: {have} parts for {n} vertices")
    return part


def write_vector(rows: DataFrame, path: str, column: str = "value") -> None:
    write_lines(rows.select("id", F.col(column).cast("string").alias("line")), ["id"], path)


def write_partition(part: DataFrame, path: str, k: int) -> str:
    """One part a line in the order of ids, under ``path.part.k``; returns that path."""
    write_vector(part, f"{path}.part.{k}", "pid")
    return f"{path}.part.{k}"


def write_mesh_partition(epart: DataFrame, npart: DataFrame, path: str, k: int) -> tuple[str, str]:
    write_vector(epart, f"{path}.epart.{k}", "pid")
    write_vector(npart, f"{path}.npart.{k}", "pid")
    return f"{path}.epart.{k}", f"{path}.npart.{k}"


def write_permutation(order: DataFrame, path: str) -> str:
    """Positions in the order of ids, under ``path.iperm``; raises unless they are a permutation."""
    row = order.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    if row["n"] and (row["d"] != row["n"] or row["lo"] != 0 or row["hi"] != row["n"] - 1):
        raise ValueError("positions are no permutation")
    write_vector(order, f"{path}.iperm", "pos")
    return f"{path}.iperm"


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``(id, xyz)``; every line has as many numbers as the first."""
    dims = len(head(spark, path, "").split())
    rows = numbered(spark, path, comments="", blanks=False).select(F.col("nth").alias("id"), numbers(kind="double").alias("xyz"))
    return rows.withColumn("_ok", _need(F.size("xyz") == dims, f"a point has not {dims} coordinates")).where("_ok").drop("_ok")


_TARGET = re.compile(r"\s*(\d+)\s*(?:-\s*(\d+))?\s*(?::\s*(\d+)\s*(?:-\s*(\d+))?)?\s*=\s*([0-9.eE+-]+)\s*\Z")


def parse_targets(text: str, k: int, ncon: int) -> list[list[float]]:
    """Target shares by part and constraint from lines ``from[-to][:con[-con]]=share``.

    Parts that are not named share what is left evenly; when all are named, shares are rescaled to 1.
    """
    shares = [[-1.0] * ncon for _ in range(k)]
    for line in filter(str.strip, text.splitlines()):
        m = _TARGET.match(line)
        if not m:
            raise ValueError(f"bad target weight {line!r}")
        a, c = int(m[1]), int(m[3]) if m[3] else 0
        b, d = int(m[2]) if m[2] else a, (int(m[4]) if m[4] else c) if m[3] else ncon - 1
        w = float(m[5])
        if not (0 <= a <= b < k and 0 <= c <= d < ncon and 0 < w < 1):
            raise ValueError(f"target weight out of range: {line!r}")
        for p in range(a, b + 1):
            for con in range(c, d + 1):
                shares[p][con] = w
    for con in range(ncon):
        named = sum(s[con] for s in shares if s[con] > 0)
        open_ = [s for s in shares if s[con] < 0]
        if open_ and named >= 1:
            raise ValueError("target weights leave nothing for the other parts")
        for s in open_:
            s[con] = (1 - named) / len(open_)
        if not open_:
            for s in shares:
                s[con] /= named
    return shares


def read_targets(spark: SparkSession, path: str, k: int, ncon: int = 1) -> DataFrame:
    """``(pid, con, tpwgt)``; the file has a line a range of parts."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    shares = parse_targets(text, k, ncon)
    return spark.createDataFrame([(p, c, shares[p][c]) for p in range(k) for c in range(ncon)], "pid int, con int, tpwgt double")
