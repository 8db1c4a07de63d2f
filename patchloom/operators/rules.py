"""The rule scan: each changed line against each rule that fits its file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import paths as P


@dataclass(frozen=True)
class Rule:
    """One row of the rule table; callers may add their own."""

    name: str
    pattern: str
    severity: str
    category: str
    explanation: str
    extensions: tuple[str, ...] | None = None
    negative_pattern: str | None = None


DEFAULT_RULES = tuple(Rule(*row) for row in C.RULE_ROWS)


def rule_scan(lines: DataFrame, rules=DEFAULT_RULES, min_severity: str = "nitpick") -> DataFrame:
    """(change_id, file_no, path, line, text) to findings; one per (rule, line).

    Patterns are literals, so each is compiled once per task, and the extension
    guard comes first, so most rules cost a string comparison. Rules below the
    minimum severity never enter the plan. Order: file, rule, line."""
    floor = C.SEVERITIES.index(min_severity)
    hits = []
    for number, rule in enumerate(rules):
        if C.SEVERITIES.index(rule.severity) < floor:
            continue
        fires = F.col("text").rlike(rule.pattern)
        if rule.extensions is not None:
            fires = F.col("ext").isin(*rule.extensions) & fires
        if rule.negative_pattern:
            fires = fires & ~F.col("text").rlike(rule.negative_pattern)
        hits.append(F.when(fires, F.lit(number)))
    if not hits:
        hits = [F.lit(None).cast("int")]
    table = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("rule_no"), F.lit(r.name).alias("rule"),
                 F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
                 F.lit(r.explanation).alias("explanation"))
        for i, r in enumerate(rules)])
    matched = lines.withColumn("ext", P.extension(F.col("path"))).select(
        "change_id", "file_no", "path", "line",
        F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    found = matched.select("change_id", "file_no", "path", "line",
                           F.get(table, F.col("hit")).alias("r"))
    return found.select(
        "change_id", "file_no", "path", F.col("line").alias("start_line"),
        F.col("line").alias("end_line"), "r.rule_no", "r.rule", "r.severity", "r.category",
        F.concat(F.lit("Deterministic check '"), F.col("r.rule"), F.lit("' matched on line "),
                 F.col("line").cast("string"), F.lit(".")).alias("reasoning"),
        F.col("r.explanation").alias("explanation"),
        F.lit(False).alias("can_generate_patch"),
        F.lit(None).cast("string").alias("replacement_code"))


def rule_named(name: str) -> Rule:
    return next(r for r in DEFAULT_RULES if r.name == name)


def fail_flag(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Per change: 1 if any finding is critical or major, else 0."""
    failing = findings.groupBy("change_id").agg(
        F.bool_or(F.col("severity").isin(*C.FAILING_SEVERITIES)).alias("failing"))
    return changes.select("change_id").distinct().join(failing, "change_id", "left").select(
        "change_id", F.when(F.col("failing"), 1).otherwise(0).cast("bigint").alias("exit_code"))
