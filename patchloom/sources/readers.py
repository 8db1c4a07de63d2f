"""Reading the inputs of the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators.diff import scan_diffs


def read_diffs(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """(change_id, diff_text) of diffs with any text.

    A table format is read as it is. With "text", each file is one diff and its
    name, without suffix, is the change id."""
    if file_format != "text":
        return scan_diffs(spark.read.format(file_format).load(path).select(
            "change_id", "diff_text"))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1)
    return scan_diffs(spark.read.text(path, wholetext=True).select(
        name.cast("bigint").alias("change_id"), F.col("value").alias("diff_text")))


def read_heads(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """(change_id, path, content) of files at the head of their change. A file
    that could not be read is simply absent."""
    return spark.read.format(file_format).load(path).select("change_id", "path", "content").filter(
        F.col("content").isNotNull())
