"""Scans of file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings.
FRONT_END = ("js", "jsx", "ts", "tsx", "vue")
DOCUMENTS = ("adoc", "markdown", "md", "rst", "txt")
#: Folders that are skipped.
SKIPPED_CODE = ("node_modules", "dist", "build", ".git", ".vite", "coverage")
SKIPPED_DOCUMENTS = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "build", "dist")


def scan_corpus(spark: SparkSession, root: str, extensions: tuple[str, ...], skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of all files below ``root`` with one of the extensions, but for those below a skipped folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    wanted = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)
    folders = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    hidden = F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip])) if skip else F.lit(False)
    return files.filter(wanted & ~hidden).select("path", F.expr("cast(content as string)").alias("content"))


def scan_mappers(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of XML files that hold a mapper."""
    return scan_corpus(spark, root, ("xml",)).filter(F.contains("content", F.lit("<mapper")))
