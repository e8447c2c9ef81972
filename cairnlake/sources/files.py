"""Files to ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``file_id`` (path), ``bytes``, ``extension`` of all files below a folder.

    Spark's reader does not list files without bytes; they are not ingested.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("file_id"), F.col("content").alias("bytes"), extension("path").alias("extension"))


def text_files(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``file_id, bytes`` of a text column as UTF-8; null text is null bytes."""
    return rows.select(F.col(key).alias("file_id"), F.encode(F.col(text), "UTF-8").alias("bytes"))


def extension(path: str | Column) -> Column:
    """What follows the last dot of the last part of a path; null where there is none."""
    found = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(found != "", found)
