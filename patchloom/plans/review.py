"""Whole review jobs over all changes of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.operators import comments as M
from patchloom.operators import diff as D
from patchloom.operators import filters as L
from patchloom.operators import findings as N
from patchloom.operators import rules as R


def check_run(diffs: DataFrame, heads: DataFrame, min_severity: str = "nitpick",
              rules=R.DEFAULT_RULES, extra_ignore=()) -> DataFrame:
    """Rule findings only; text from the head file, else from the diff."""
    files = L.reviewable_files(D.diff_files(diffs, with_hunks=True), extra_ignore)
    return R.rule_scan(L.changed_line_text_or_diff(files, heads), rules, min_severity)


def review_run(diffs: DataFrame, heads: DataFrame, responses: DataFrame, attempts: DataFrame,
               matches: DataFrame | None = None, min_severity: str = "nitpick",
               max_comments: int = C.MAX_COMMENTS, bot: str = C.BOT_NAME,
               rules=R.DEFAULT_RULES, extra_ignore=()) -> dict[str, DataFrame]:
    """Diffs, head files, model answers and patch attempts to findings, comments,
    summaries and totals. ``attempts`` is keyed by (change_id, src, k1, k2, k3)."""
    files = L.reviewable_files(D.diff_files(diffs, with_hunks=True), extra_ignore)
    changes = D.changes_of_hunks(D.hunk_rows(files))
    lines = L.changed_line_text(files, heads)
    # A change without a reviewable file ends here: no answer, comment or summary.
    reviewed = files.select("change_id").distinct()
    parsed = N.parse_responses(responses.join(reviewed, "change_id", "left_semi"))
    model = N.response_findings(parsed)
    if matches is not None:
        # Only an answer given with guidance at hand is held to it, and only its
        # prose is escaped; elsewhere the guidance fields mean nothing.
        has_guidance = matches.select("change_id").distinct()
        guided = N.guidance_on_changed_lines(
            N.validate_guidance(model.join(has_guidance, "change_id", "left_semi"), matches),
            D.changed_lines(changes)).withColumn("is_guidance", F.lit(True))
        plain = model.join(has_guidance, "change_id", "left_anti").withColumn(
            "is_guidance", F.lit(False))
        model = plain.unionByName(guided, allowMissingColumns=True)
    found = N.merge_findings(R.rule_scan(lines, rules, min_severity), model)
    tried = attempts.select("change_id", *N.ORDER, "sandbox_on", "first_ok", "first_stdout",
                            "first_stderr", "repair_code", "repair_ok")
    verified = N.verification_status(
        found.join(tried, ["change_id", *N.ORDER], "left").withColumn(
            "sandbox_on", F.coalesce("sandbox_on", F.lit(False))))
    if "is_guidance" in verified.columns:
        verified = verified.fillna(False, ["is_guidance"])
    capped = N.cap_comments(verified, max_comments)
    comments = M.review_comments(capped, D.commentable_lines(changes), bot=bot)
    counts = N.severity_counts(capped, reviewed).join(
        N.verification_counts(capped), "change_id", "left").join(
        parsed.select("change_id", "summary", "risk_level"), "change_id", "left").select(
        "change_id", *C.SEVERITIES_SHOWN,
        F.coalesce("verified", F.lit(0)).alias("verified"),
        F.coalesce("advisory", F.lit(0)).alias("advisory"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("risk_level", F.lit("low")).alias("risk_level"))
    return {"findings": verified, "comments": comments,
            "summaries": M.summary_body(counts, bot),
            "results": N.run_result(diffs, verified, comments)}
