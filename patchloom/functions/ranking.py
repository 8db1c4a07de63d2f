"""Row numbers and running sums that do not put one key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 10_000


def bucketed_row_number(df: DataFrame, keys: list[str], seq: str, out: str,
                        width: int = BUCKET_WIDTH) -> DataFrame:
    """1-based rank of ``seq`` (a bigint, unique per key) within ``keys``.

    Rows are ranked inside buckets of ``seq`` values, and each bucket's offset is
    the running sum of the counts before it. Only the counts, one row per bucket,
    are ordered per key; a key with a third of all rows is spread over its
    buckets. Exact for any distribution of ``seq``."""
    rows = df.withColumn("_bucket", F.floor(F.col(seq) / width).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(seq))
    return rows.withColumn("_local", local).join(offsets, [*keys, "_bucket"]).withColumn(
        out, (F.col("_local") + F.col("_offset")).cast("bigint")
    ).drop("_bucket", "_local", "_offset")


def bucketed_running_sum(df: DataFrame, keys: list[str], seq: str, value: str, out: str, total: str,
                         width: int = BUCKET_WIDTH) -> DataFrame:
    """The sum of ``value`` before each row in the order of ``seq`` (a whole number, unique per key)
    within ``keys``, and the sum over all. Rows are summed inside buckets of ``width`` values of
    ``seq``; only one sum per bucket is ordered per key."""
    rows = df.withColumn("_bucket", F.floor(F.col(seq) / width).cast("bigint"))
    key = Window.partitionBy(*keys)
    before = Window.unboundedPreceding, -1
    offsets = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_n")).select(
        *keys, "_bucket", F.sum("_n").over(key).cast("bigint").alias(total),
        F.coalesce(F.sum("_n").over(key.orderBy("_bucket").rowsBetween(*before)), F.lit(0))
        .alias("_offset"))
    local = F.sum(value).over(Window.partitionBy(*keys, "_bucket").orderBy(seq).rowsBetween(*before))
    return rows.withColumn("_local", F.coalesce(local, F.lit(0))).join(
        offsets, [*keys, "_bucket"]).withColumn(
        out, (F.col("_local") + F.col("_offset")).cast("bigint")).drop("_bucket", "_local", "_offset")


def bucketed_lead(df: DataFrame, keys: list[str], seq: str, out: str,
                  width: int = BUCKET_WIDTH) -> DataFrame:
    """The next larger ``seq`` within ``keys``, null for the last; ``seq`` is
    unique per key. Neighbours are found inside buckets, and the last row of a
    bucket takes the first value of the next filled one."""
    rows = df.withColumn("_bucket", F.floor(F.col(seq) / width).cast("bigint"))
    following = Window.partitionBy(*keys).orderBy("_bucket")
    nexts = rows.groupBy(*keys, "_bucket").agg(F.min(seq).alias("_first")).select(
        *keys, "_bucket", F.lead("_first").over(following).alias("_next"))
    local = F.lead(seq).over(Window.partitionBy(*keys, "_bucket").orderBy(seq))
    return rows.withColumn("_local", local).join(nexts, [*keys, "_bucket"]).withColumn(
        out, F.coalesce("_local", "_next")).drop("_bucket", "_local", "_next")


def grouped_median(df: DataFrame, keys: list[str], value: str, out: str,
                   width: float = 1.0) -> DataFrame:
    """Exact median per group, for groups of any size.

    Values are counted first, so equal ones meet map-side; then positions are
    found inside buckets of ``width``, whose offsets are running sums over bucket
    counts. No task sees a whole group."""
    bucket = F.floor(F.col(value) / width).cast("bigint")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n")).withColumn("_bucket", bucket)
    per_bucket = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    key_window = Window.partitionBy(*keys)
    up_to = key_window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(up_to), F.lit(0)).alias("_offset"),
        F.sum("_size").over(key_window).alias("_total"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = counts.join(offsets, [*keys, "_bucket"]).withColumn(
        "_last", F.col("_offset") + F.sum("_n").over(local))
    first = F.col("_last") - F.col("_n") + 1
    low, high = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)
    holds = lambda p: F.when(p.between(first, F.col("_last")), F.col(value))
    return ranked.groupBy(*keys).agg(
        ((F.max(holds(low)) + F.max(holds(high))) / 2).alias(out))
