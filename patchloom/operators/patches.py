"""Line-range replacements in files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T


def apply_patches(patches: DataFrame, heads: DataFrame) -> DataFrame:
    """Replaces lines start..end (1-based, inclusive, end clamped) and gives
    ``status`` and the new ``content``, null on an error.

    patches: change_id, seq, path, start_line, end_line, replacement_code."""
    rows = patches.join(
        heads.select("change_id", "path", T.lines_with_breaks(F.col("content")).alias("lines")),
        ["change_id", "path"], "left")
    start, end, code = F.col("start_line"), F.col("end_line"), F.col("replacement_code")
    n = F.size("lines")
    status = (F.when(F.coalesce(code, F.lit("")) == "", "no_replacement")
              .when(F.col("lines").isNull(), "missing_file")
              .when((start < 1) | (end < start), "invalid_range")
              .when(start > n, "past_end").otherwise("applied"))
    ended = F.when(F.endswith(code, F.lit("\n")), code).otherwise(F.concat(code, F.lit("\n")))
    content = F.concat(
        F.array_join(T.py_slice(F.col("lines"), F.lit(0), start - 1), ""), ended,
        F.array_join(T.py_slice(F.col("lines"), F.least(end, n), n), ""))
    return rows.withColumn("status", status).select(
        "change_id", "seq", "path", "status",
        F.when(F.col("status") == "applied", content).alias("content"))


def original_lines(patches: DataFrame, heads: DataFrame) -> DataFrame:
    """Text of each patch's line range; '' if the file is missing."""
    rows = patches.join(
        heads.select("change_id", "path", T.lines_of(F.col("content")).alias("lines")),
        ["change_id", "path"], "left")
    part = T.join_lines(T.py_slice(F.col("lines"), F.col("start_line") - 1, F.col("end_line")))
    return rows.select("change_id", "seq", "path",
                       F.when(F.col("lines").isNull(), "").otherwise(part).alias("original"))
