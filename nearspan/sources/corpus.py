"""Corpora, dictionaries and matrices as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.functions import matrices


def verses(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """(reference, verse) of tab-separated files without quoting; the first ``skip`` lines of each file and empty verses are left out."""
    whole = spark.read.text(path, wholetext=True) if skip else None
    if whole is None:
        lines = spark.read.text(path)
    else:
        # A file is one row, so that its first lines are known; large corpora are many files.
        lines = whole.select(F.explode(F.slice(F.split("value", "\r?\n"), skip + 1, 1 << 30)).alias("value"))
    parts = F.split("value", "\t", 2)
    rows = lines.select(F.trim(F.get(parts, F.lit(0))).alias("reference"), F.trim(F.get(parts, F.lit(1))).alias("verse"))
    return rows.where("verse is not null and verse <> ''")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word): the distinct words of files of one word a line, in lower case. An empty dictionary is an error."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").dropDuplicates()
    if words.isEmpty():
        raise ValueError(f"no words in {path}")
    return words


def ncbi_matrix(spark: SparkSession, path: str, name: str | None = None, **how) -> matrices.Matrix:
    """A substitution matrix from a text file anywhere Spark reads."""
    return matrices.from_ncbi_text(spark.read.text(path, wholetext=True).first()[0], name or path.rsplit("/", 1)[-1], **how)


def npy_matrix(spark: SparkSession, path: str, **how) -> matrices.Matrix:
    """A substitution matrix from a .npy file anywhere Spark reads."""
    return matrices.from_npy(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), **how)


def matrix_frame(spark: SparkSession, *found: matrices.Matrix) -> DataFrame:
    """Matrices as rows, as the SQL functions take them."""
    return spark.createDataFrame([m.row() for m in found], matrices.MATRIX_SCHEMA[len("struct<") : -1].replace(": ", " "))


def write_scores(scores: DataFrame, path: str, format: str = "csv") -> None:
    """Scores as files; csv has a header."""
    scores.write.mode("errorifexists").options(**({"header": True} if format == "csv" else {})).format(format).save(path)
