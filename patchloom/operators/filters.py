"""Which files and lines are reviewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import paths as P
from patchloom.functions import text as T
from patchloom.operators import diff as D


def pattern_usage(paths: DataFrame, patterns=C.IGNORE_PATTERNS) -> DataFrame:
    """How many paths each pattern covers, unused patterns included.

    One pass with one counter per pattern: map-side partial counts, one small
    result row turned into rows."""
    counts = paths.agg(*[
        F.count_if(P.glob_matches(F.col("path"), p)).alias(f"p{i}")
        for i, p in enumerate(patterns)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("pattern_no"), F.lit(p).alias("pattern"),
                 F.col(f"p{i}").alias("paths_ignored"))
        for i, p in enumerate(patterns)])))


def ignored_paths(paths: DataFrame, extra=()) -> DataFrame:
    """Adds ``ignored``."""
    return paths.withColumn("ignored", P.ignored(F.col("path"), (*C.IGNORE_PATTERNS, *extra)))


def reviewable_files(files: DataFrame, extra=()) -> DataFrame:
    """Drops binary, deleted, hunk-less and ignored files. Needs the
    ``hunk_texts`` of ``diff_files(..., with_hunks=True)``: a file's hunks lie in
    its own row, so no join is needed to see whether it has any."""
    return files.filter(
        ~F.col("is_binary") & ~F.col("is_deleted_file") & (F.size("hunk_texts") > 0)
        & ~((F.col("path") != "") & P.ignored(F.col("path"), (*C.IGNORE_PATTERNS, *extra))))


def severity_rank(severity):
    ranks = F.array(*[F.lit(s) for s in C.SEVERITIES])
    return F.array_position(ranks, severity)


def severity_at_least(findings: DataFrame, minimum: str) -> DataFrame:
    """Rule findings at or above a severity. Not meant for model findings."""
    return findings.filter(severity_rank(F.col("severity")) >= C.SEVERITIES.index(minimum) + 1)


def head_files(files: DataFrame, heads: DataFrame) -> DataFrame:
    """Files with their text at the change's head; absent or empty ones go."""
    return files.join(
        heads.filter(F.col("content") != "").select("change_id", "path", "content"),
        ["change_id", "path"])


def _line_texts(files: DataFrame, heads: DataFrame, how: str) -> DataFrame:
    """Added lines of each file with their text.

    Both sides are one row per file here, so files are joined, not lines: the
    shuffle carries each text once, and the lines are taken from arrays in the
    joined row. Several additions with one number count once, the last one."""
    added = D.with_parsed_hunks(files).select(
        "change_id", "file_no", "path",
        F.array_sort(F.transform(
            D.added_lines_of_file(),
            lambda e, i: F.struct(e.line.alias("line"), i.alias("i"), e.text.alias("text")))
        ).alias("added"))
    last_only = added.withColumn("added", F.filter("added", lambda e, i: F.coalesce(
        F.get(F.col("added"), i + 1).line != e.line, F.lit(True))))
    joined = last_only.join(
        heads.select("change_id", "path", T.lines_of(F.col("content")).alias("head_lines")),
        ["change_id", "path"], how)
    texts = F.transform("added", lambda e: F.struct(
        e.line.alias("line"),
        F.when(F.col("head_lines").isNull(), e.text).otherwise(
            F.get(F.col("head_lines"), (e.line - 1).cast("int"))).alias("text")))
    return joined.select(
        "change_id", "file_no", "path",
        F.inline(F.filter(texts, lambda e: e.text.isNotNull())))


def changed_line_text(files: DataFrame, heads: DataFrame) -> DataFrame:
    """Added line numbers with the text of the head file; numbers outside the
    file are dropped. files: ``diff_files(..., with_hunks=True)``."""
    return _line_texts(files, heads.filter(F.col("content") != ""), "inner")


def changed_line_text_or_diff(files: DataFrame, heads: DataFrame) -> DataFrame:
    """Head text where the file exists, else the text in the diff. The choice is
    made per file, so numbers outside an existing file are dropped."""
    return _line_texts(files, heads, "left")


def added_line_rows(changes: DataFrame) -> DataFrame:
    """(change_id, file_no, path, line, text) from the diff itself. Of several
    additions with one number, the last one counts."""
    return changes.filter(F.col("op") == "add").groupBy(
        "change_id", "file_no", "path", F.col("line_number").alias("line")
    ).agg(F.max_by("content", F.struct("hunk_no", "seq")).alias("text"))


def valid_paths(paths: DataFrame) -> DataFrame:
    return paths.withColumn("valid", P.is_valid_path(F.col("path")))


def source_bounds() -> tuple[tuple[str, Column], ...]:
    """The bounds of a guidance source row: (name, whether the row breaks it). A null breaks a bound.

    Columns in: repo_id, revision, path, content, applies_to."""
    scopes = F.col("applies_to")
    bounds = (
        ("repo_id", ~F.col("repo_id").rlike(C.REPO_ID) | (F.length("repo_id") > 200)),
        ("revision", ~F.col("revision").rlike(C.COMMIT)),
        ("path", ~P.is_valid_path(F.col("path"))
         | ~F.length("path").between(1, 300)),
        ("path_extension", ~(F.endswith("path", F.lit(".md")) | F.endswith("path", F.lit(".json")))),
        ("content_length", F.length("content") > C.SOURCE_CHARS),
        ("scope_count", F.size(scopes) > 16),
        ("scope_path", F.exists(scopes, lambda s: ~P.is_valid_path(s)
                                | ~F.length(s).between(1, 300))),
    )
    return tuple((name, F.coalesce(broken, F.lit(True))) for name, broken in bounds)


def broken_bounds(bounds) -> Column:
    """The names of the bounds a row breaks, as an array."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in bounds]))


def contract_checks(sources: DataFrame) -> DataFrame:
    """Names of the bounds each guidance source row breaks, comma-joined; a null breaks its bound.

    Columns in: repo_id, revision, path, content, applies_to, k."""
    asked = F.coalesce(~F.col("k").between(1, C.MAX_K), F.lit(True))
    failed = broken_bounds((*source_bounds(), ("k", asked)))
    return sources.select("repo_id", "path", F.array_join(failed, ",").alias("failed"))
