"""Which model tier a file goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import paths as P


def assess_complexity(files: DataFrame) -> DataFrame:
    """Adds the two path flags and ``tier``.

    files: path, changed_line_count, function_count."""
    lines, fns = F.col("changed_line_count"), F.col("function_count")
    return files.withColumns({
        "is_security": P.security_sensitive(F.col("path")),
        "is_test": P.is_test_file(F.col("path")),
    }).withColumn("tier", (
        F.when(F.col("is_test"), "fast")
        .when(F.col("is_security") & (lines <= 200), "standard")
        .when(F.col("is_security") | (lines > 200) | (fns > 5), "deep")
        .when((lines > 50) | (fns > 2), "standard").otherwise("fast")))


def tier_for_file(files: DataFrame, tiers=C.TIERS) -> DataFrame:
    """Adds the settings of the file's tier; an unknown name gets the first one.
    The tier list is a parameter of a few rows, so it is a literal."""
    def row(t):
        name, provider, model, max_tokens, temperature, max_lines = t
        return F.struct(F.lit(name).alias("tier_name"), F.lit(provider).alias("provider"),
                        F.lit(model).alias("model"),
                        F.lit(max_tokens).cast("bigint").alias("max_tokens"),
                        F.lit(float(temperature)).alias("temperature"),
                        F.lit(max_lines).cast("bigint").alias("max_context_lines"))
    by_name = F.create_map(*[x for t in tiers for x in (F.lit(t[0]), row(t))])
    chosen = F.coalesce(F.try_element_at(by_name, F.col("tier")), row(tiers[0]))
    return files.withColumn("_t", chosen).select(*files.columns, "_t.*")


def tier_groups(files: DataFrame) -> DataFrame:
    """Each file with its tier group's file count and total changed lines. Group
    totals are partial sums joined back, never a list of a group's files.

    files: output of ``tier_for_file``."""
    totals = files.groupBy("change_id", "tier_name").agg(
        F.count("*").alias("file_count"),
        F.sum("changed_line_count").alias("total_changed_lines"))
    return files.join(totals, ["change_id", "tier_name"])
