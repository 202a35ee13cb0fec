"""Protein structures and sequences in fixed-width and line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.sources.lines import numbered, numbers

# The residues' three-letter and one-letter names.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def one_letter(name: Column) -> Column:
    """``X`` for unknown residues."""
    pairs = [F.lit(x) for item in RESIDUES.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(F.trim(name))), F.lit("X"))


def _field(start: int, end: int) -> Column:
    return F.trim(F.substring("value", start, end - start + 1))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms: ``(file, serial, name, alt, residue, letter, chain, rserial, icode, x, y, z, occupancy, temperature)``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.col("value").rlike("^(ATOM|HETATM)"))
    return lines.select(
        "file", _field(7, 11).cast("int").alias("serial"), _field(13, 16).alias("name"), _field(17, 17).alias("alt"), _field(18, 20).alias("residue"),
        one_letter(F.substring("value", 18, 3)).alias("letter"), _field(22, 22).alias("chain"), _field(23, 26).cast("int").alias("rserial"), _field(27, 27).alias("icode"),
        _field(31, 38).cast("double").alias("x"), _field(39, 46).cast("double").alias("y"), _field(47, 54).cast("double").alias("z"),
        _field(55, 60).try_cast("double").alias("occupancy"), _field(61, 66).try_cast("double").alias("temperature"),
    )


def backbone(atoms: DataFrame) -> DataFrame:
    """The atoms N, CA, C and O."""
    return atoms.where(F.col("name").isin("N", "CA", "C", "O"))


def fasta(atoms: DataFrame) -> DataFrame:
    """``(file, chain, sequence)``: the residues of each chain in order of serials."""
    one = atoms.where("name = 'CA'").groupBy("file", "chain", "rserial", "icode").agg(F.min("letter").alias("l"))
    items = F.array_sort(F.collect_list(F.struct("rserial", "icode", "l")))
    return one.groupBy("file", "chain").agg(F.array_join(F.transform(items, lambda x: x["l"]), "").alias("sequence"))


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """``(file, serial, line)``: atoms in the fixed-width format."""
    line = F.format_string(
        "ATOM  %5d %-4s%1s%-3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f", "serial", "name", F.rpad("alt", 1, " "), "residue", F.rpad("chain", 1, " "), "rserial",
        F.rpad("icode", 1, " "), "x", "y", "z", F.coalesce("occupancy", F.lit(1.0)), F.coalesce("temperature", F.lit(0.0)),
    )
    return atoms.select("file", "serial", line.alias("line"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(name, sequence)``; sequences may take several lines."""
    lines = numbered(spark, path, comments="", blanks=False)
    named = lines.withColumn("name", F.when(F.startswith("line", F.lit(">")), F.substring("line", 2, 1 << 20)))
    by = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)  # one file of sequences
    filled = named.withColumns({"start": F.max(F.when(F.col("name").isNotNull(), F.col("nth"))).over(by)})
    rows = filled.where("name is null").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("l"))
    heads = named.where("name is not null").select(F.col("nth").alias("start"), "name")
    return heads.join(rows, "start").select("name", F.array_join(F.transform("l", lambda x: F.trim(x["line"])), "").alias("sequence"))


def read_pssm(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, residue, scores)``: profile rows are a number, a letter and twenty scores or more."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line").rlike(r"^\d+\s+[A-Z]\s+(-?\d+\s+){19}"))
    tail = F.regexp_replace("line", r"^\d+\s+[A-Z]\s+", "")
    return rows.select(
        F.regexp_extract("line", r"^(\d+)", 1).cast("int").alias("pos"), F.regexp_extract("line", r"^\d+\s+([A-Z])", 1).alias("residue"), tail.alias("line")
    ).select("pos", "residue", F.slice(numbers(kind="int"), 1, 20).alias("scores"))
