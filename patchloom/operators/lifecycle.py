"""Comments across review runs: what is new, known or resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import ids


def extract_marker(comments: DataFrame, bot: str = C.BOT_NAME) -> DataFrame:
    """Adds ``marker_id`` from the hidden marker; comments without one go."""
    found = F.regexp_extract(F.coalesce("body", F.lit("")), ids.marker_pattern(bot), 1)
    return comments.withColumn("marker_id", found).filter(F.col("marker_id") != "")


def existing_comments(comments: DataFrame, bot: str = C.BOT_NAME) -> DataFrame:
    """One comment per (change, id); the last seen (highest seq) counts."""
    return extract_marker(comments, bot).groupBy(
        "change_id", F.col("marker_id").alias("comment_id")).agg(
        F.max("seq").alias("seq"), F.max_by("body", "seq").alias("body"))


def new_comments(current: DataFrame, existing: DataFrame) -> DataFrame:
    """Current comments not yet posted; repeats inside the run stay."""
    return current.join(existing.select("change_id", "comment_id"),
                        ["change_id", "comment_id"], "left_anti")


def resolved_comments(current: DataFrame, existing: DataFrame, runs: DataFrame) -> DataFrame:
    """Posted comments absent from the current run of their change.

    runs: change_id of every change that has a run now, also one that found nothing. Comments of
    changes without a run stay as they are."""
    return existing.join(runs.select("change_id").distinct(), "change_id", "left_semi").join(
        current.select("change_id", "comment_id"), ["change_id", "comment_id"], "left_anti")


def mark_resolved(resolved: DataFrame) -> DataFrame:
    """Adds ``updated`` and puts the badge in front unless both its words are
    there already."""
    marked = F.contains("body", F.lit("Resolved")) & F.contains("body", F.lit("white_check_mark"))
    return resolved.withColumn("updated", ~marked).withColumn(
        "body", F.when(F.col("updated"), F.concat(F.lit(C.RESOLVED_BADGE), F.col("body")))
        .otherwise(F.col("body")))


def summary_upsert(issue_comments: DataFrame, summaries: DataFrame,
                   bot: str = C.BOT_NAME) -> DataFrame:
    """Per change with a new summary: update its first summary comment or insert.

    issue_comments: change_id, seq, body; summaries: change_id, body."""
    first = issue_comments.filter(
        F.contains(F.coalesce("body", F.lit("")), F.lit(ids.summary_marker(bot)))
    ).groupBy("change_id").agg(F.min("seq").alias("seq"))
    return summaries.join(first, "change_id", "left").select(
        "change_id", F.when(F.col("seq").isNull(), "insert").otherwise("update").alias("action"),
        "seq", "body")


def lifecycle_stats(current: DataFrame, posted: DataFrame, runs: DataFrame,
                    bot: str = C.BOT_NAME) -> DataFrame:
    """Existing, new, skipped and resolved counts per change that has a run now.

    runs: change_id of every such change; one that found nothing resolves all it had. Everything
    known of a (change, id) meets in one row first; the counts per change then combine map-side, so
    a change with very many comments is not gathered anywhere."""
    now = current.groupBy("change_id", "comment_id").agg(F.count("*").alias("now_n"))
    old = existing_comments(posted, bot).select("change_id", "comment_id", "body")
    both = old.withColumn("old", F.lit(True)).join(now, ["change_id", "comment_id"], "full")
    unmarked = ~(F.contains("body", F.lit("Resolved"))
                 & F.contains("body", F.lit("white_check_mark")))
    is_old, has_now = F.col("old").isNotNull(), F.col("now_n").isNotNull()
    stats = both.groupBy("change_id").agg(
        F.count_if(is_old).alias("existing_comments"),
        F.coalesce(F.sum(F.when(~is_old, F.col("now_n"))), F.lit(0)).alias("new_comments"),
        F.coalesce(F.sum(F.when(is_old, F.col("now_n"))), F.lit(0)).alias("duplicates_skipped"),
        F.count_if(is_old & ~has_now & unmarked).alias("resolved_marked"))
    counts = [c for c in stats.columns if c != "change_id"]
    return runs.select("change_id").distinct().join(stats, "change_id", "left").na.fill(0, counts)
