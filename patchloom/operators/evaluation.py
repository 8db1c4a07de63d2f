"""Scoring retrieval and grounded findings against labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions.ranking import grouped_median

RUN = ["case_id", "enabled"]


def eval_arms(cases: DataFrame) -> DataFrame:
    """Each case with retrieval off and on."""
    return cases.withColumn("enabled", F.explode(F.array(F.lit(False), F.lit(True))))


def retrieval_hits(arms: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Adds ``has_reference`` and ``hit``: the expected locator was retrieved.

    retrieved: case_id, enabled, locator."""
    found = retrieved.select(*RUN, F.col("locator").alias("expected_locator"),
                             F.lit(True).alias("_found")).distinct()
    return arms.join(found, [*RUN, "expected_locator"], "left").withColumns({
        "has_reference": F.col("expected_locator").isNotNull(),
        "hit": F.coalesce("_found", F.lit(False))}).drop("_found")


def grounded_findings(arms: DataFrame, comments: DataFrame, citations: DataFrame,
                      terms: DataFrame) -> DataFrame:
    """Per run: comments, correct ones, ``grounded`` and ``false_positives``.

    A comment is correct if the case is a violation, an expected citation is one
    of its lines and its prose holds an expected word. comments: case_id,
    enabled, comment_no, body; citations: case_id, enabled, citation; terms: case_id, term.
    Lines and words are looked up by joins on equal keys."""
    key = [*RUN, "comment_no"]
    cited = comments.select(*key, F.explode(F.split("body", "\n")).alias("citation")).join(
        citations.select(*RUN, "citation").distinct(), [*RUN, "citation"]).select(key).distinct()
    prose = F.replace(F.lower(F.substring_index("body", "\nRepository guidance:", 1)),
                      F.lit("\\"), F.lit(""))
    worded = comments.join(terms, "case_id").filter(
        F.contains(prose, F.col("term"))).select(key).distinct()
    correct = cited.join(worded, key).groupBy(*RUN).agg(F.count("*").alias("_correct"))
    totals = comments.groupBy(*RUN).agg(F.count("*").alias("comments"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    scored = arms.join(totals, RUN, "left").join(correct, RUN, "left").withColumns({
        "comments": zero("comments"),
        "correct": F.when(F.col("violation"), zero("_correct")).otherwise(0).cast("bigint")})
    return scored.withColumns({
        "grounded": F.col("correct") > 0,
        "false_positives": F.col("comments") - F.least(F.lit(1), F.col("correct"))}
    ).drop("_correct")


def arm_summary(runs: DataFrame) -> DataFrame:
    """Per arm: cases, hits, grounded findings and median latencies.

    runs: enabled, hit, has_reference, grounded, violation, false_positives,
    review_ms, retrieval_ms."""
    counts = runs.groupBy("enabled").agg(
        F.count("*").alias("cases"), F.count_if("hit").alias("hits"),
        F.count_if("has_reference").alias("applicable"),
        F.count_if("grounded").alias("grounded"), F.count_if("violation").alias("violations"),
        F.sum("false_positives").alias("false_positives"))
    review = grouped_median(runs, ["enabled"], "review_ms", "review_ms")
    retrieval = grouped_median(runs, ["enabled"], "retrieval_ms", "retrieval_ms")
    return counts.join(review, "enabled", "left").join(retrieval, "enabled", "left").withColumns(
        {c: F.round(c, 2) for c in ("review_ms", "retrieval_ms")})


def eval_gate(runs: DataFrame) -> DataFrame:
    """One row: does every case of the retrieval arm pass?"""
    passes = ((~F.col("has_reference") | F.col("hit")) & (~F.col("violation") | F.col("grounded"))
              & (F.col("false_positives") == 0))
    return runs.filter("enabled").agg(F.coalesce(F.bool_and(passes), F.lit(True)).alias("passed"),
                                      F.count_if(~passes).alias("failing_cases"))
