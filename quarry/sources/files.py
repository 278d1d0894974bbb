"""File sources: a whitelist scan over any store that Spark reads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dotted_extension

# Default extensions and skipped system directories.
EXTENSIONS = (".txt", ".pdf", ".docx", ".jpg", ".jpeg", ".png")
SYSTEM_DIRECTORIES = ("$recycle.bin", "system volume information")


SPREAD_BYTES, SPREAD_MOST, FEW_FILES = 4 << 20, 256 << 20, 4


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, read as it lies. Only one of SPREAD_BYTES to SPREAD_MOST in at most FEW_FILES files, which may be of one row group each, is dealt out to all cores first."""
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = SPREAD_BYTES < size <= SPREAD_MOST and len(df.inputFiles()) <= FEW_FILES
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def scan_files(spark: SparkSession, root: str, extensions: Iterable[str] = EXTENSIONS, max_depth: int = 32, with_content: bool = True) -> DataFrame:
    """Files below root (path, relative_path, size_bytes, modified_at, content): allowed extensions, no hidden or temporary names, at most max_depth directories down."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return admitted(files, root, extensions, max_depth, with_content)


def admitted(files: DataFrame, root: str, extensions: Iterable[str] = EXTENSIONS, max_depth: int = 32, with_content: bool = True) -> DataFrame:
    """The scan's rules on a binaryFile DataFrame, batch or streaming."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    at = F.instr("path", bare + "/")
    relative = F.url_decode(F.replace(F.expr(f"substr(path, {len(bare) + 1} + instr(path, '{bare}/'))"), F.lit("+"), F.lit("%2B")))
    rows = files.where(at > 0).withColumn("relative_path", relative).withColumn("_parts", F.split("relative_path", "/"))
    hidden = F.exists("_parts", lambda p: p.startswith(".") | p.startswith("~$") | F.lower(p).isin(*SYSTEM_DIRECTORIES))
    kept = rows.where(~hidden & (F.size("_parts") - 1 <= max_depth) & dotted_extension("relative_path").isin(*[e.lower() for e in extensions]))
    columns = ["path", "relative_path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    return kept.select(*columns, "content") if with_content else kept.select(*columns)
