"""Findings to comment rows and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import ids
from patchloom.functions import text as T
from patchloom.functions.ranking import bucketed_row_number
from patchloom.operators.findings import ORDER

LINE_BUCKET = 64  # lines of a file whose commentable ones are one list


def _label(table: dict[str, str], key: Column) -> Column:
    """Label by key, the key itself if unknown. The tables have fixed sizes."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def with_comment_id(findings: DataFrame) -> DataFrame:
    """Severity and rule are not part of the identity."""
    return findings.withColumn("comment_id", ids.comment_id(
        F.col("path"), F.col("start_line"), F.col("end_line"), F.col("category")))


def snap_line(findings: DataFrame, commentable: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``comment_line``: the end line if it can carry a comment, else the
    nearest such line within five (the later one on a tie); else the finding
    goes. ``key`` names the columns that identify a finding.

    Lines that can carry a comment are gathered into one short list per bucket of LINE_BUCKET lines
    of a file. A finding meets the bucket of its line, or two at a border, and the nearest line is
    found in the list; keys are equal, and a file with very many lines or findings is spread."""
    end, reach = F.col("end_line"), C.SNAP_DISTANCE
    bucket = lambda line: F.floor(line / LINE_BUCKET).cast("bigint")
    lists = commentable.groupBy("change_id", "path", bucket(F.col("line")).alias("_bucket")).agg(
        F.collect_set("line").alias("_lines"))
    asked = findings.select(*dict.fromkeys([*key, "change_id", "path"]), "end_line", F.explode(
        F.array_distinct(F.array(bucket(end - reach), bucket(end + reach)))).alias("_bucket"))
    near = F.array_min(F.transform(
        F.filter("_lines", lambda x: F.abs(x - F.col("end_line")) <= reach),
        lambda x: F.struct(F.abs(x - F.col("end_line")).alias("far"),
                           (x < F.col("end_line")).alias("above"), x.alias("line"))))
    best = asked.join(lists, ["change_id", "path", "_bucket"]).withColumn("_near", near).filter(
        "_near IS NOT NULL").groupBy(*key).agg(F.min("_near").getField("line").alias("comment_line"))
    return findings.join(best, key)


def comment_span(comments: DataFrame, commentable: DataFrame) -> DataFrame:
    """Adds ``span_start``: the start line if above the comment line and able to
    carry a comment."""
    lines = commentable.select("change_id", "path", F.col("line").alias("start_line"),
                               F.lit(True).alias("_ok")).distinct()
    return comments.join(lines, ["change_id", "path", "start_line"], "left").withColumn(
        "span_start", F.when(F.col("_ok") & (F.col("start_line") < F.col("comment_line")),
                             F.col("start_line"))).drop("_ok")


def escape_prose(text: Column) -> Column:
    """Model prose as plain text: links out, HTML and Markdown escaped."""
    out = F.regexp_replace(text, r"(?:https?://|www\.)[^\s\]\)>]+", "link omitted")
    out = F.replace(T.html_escape(out), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(out, r"[\\`*_{}\[\]()#!|~]", r"\\$0")


def comment_body(bot: str = C.BOT_NAME) -> Column:
    """Markdown of one comment, from the finding's columns: comment_id, severity,
    category, explanation, is_guidance, citation_label, citation_url,
    repaired_code, replacement_code, status."""
    prose = F.when(F.col("is_guidance"), escape_prose(F.col("explanation"))).otherwise(
        F.col("explanation"))
    safe_label = T.html_escape(F.col("citation_label"))
    safe_label = F.replace(F.replace(safe_label, F.lit("["), F.lit("\\[")),
                           F.lit("]"), F.lit("\\]"))
    code = F.coalesce(F.nullif("repaired_code", F.lit("")),
                      F.nullif("replacement_code", F.lit("")))
    notes = F.create_map(*[F.lit(x) for kv in C.STATUS_NOTES.items() for x in kv])
    return F.concat_ws(
        "\n",
        ids.marker(F.col("comment_id"), bot),
        F.concat(F.lit("**"), _label(C.SEVERITY_LABELS, F.col("severity")), F.lit("** | "),
                 _label(C.CATEGORY_LABELS, F.col("category"))),
        F.lit(""), prose,
        F.when(F.col("is_guidance") & F.col("citation_url").isNotNull(), F.concat(
            F.lit("\nRepository guidance: ["), safe_label, F.lit("]("), F.col("citation_url"),
            F.lit(")"))),
        F.concat(F.lit("\n```suggestion\n"), code, F.lit("\n```")),
        F.concat(F.lit("\n> "), F.try_element_at(notes, F.col("status"))))


def with_body_columns(findings: DataFrame) -> DataFrame:
    """Adds the columns ``comment_body`` reads where they are missing."""
    defaults = {
        "is_guidance": F.lit(False), "citation_label": F.lit(None).cast("string"),
        "citation_url": F.lit(None).cast("string"),
        "repaired_code": F.lit(None).cast("string"), "status": F.lit("skipped")}
    return findings.withColumns(
        {c: v for c, v in defaults.items() if c not in findings.columns})


def review_comments(findings: DataFrame, commentable: DataFrame,
                    key: list[str] | None = None, bot: str = C.BOT_NAME) -> DataFrame:
    """Comment rows: key, path, line, side, start_line, start_side, body."""
    key = key or ["change_id", *ORDER]
    ready = comment_span(snap_line(findings, commentable, key), commentable)
    ready = with_body_columns(with_comment_id(ready))
    return ready.select(
        *key, "path", F.col("comment_line").alias("line"), F.lit("RIGHT").alias("side"),
        F.col("span_start").alias("start_line"),
        F.when(F.col("span_start").isNotNull(), "RIGHT").alias("start_side"),
        "comment_id", comment_body(bot).alias("body"))


def comment_batches(comments: DataFrame, body: str, seq: str = "seq",
                    size: int = C.COMMENT_BATCH) -> DataFrame:
    """Adds ``batch_no`` (from 0) and ``review_body``, set in the first batch."""
    ranked = bucketed_row_number(comments, ["change_id"], seq, "_rank")
    return ranked.withColumn(
        "batch_no", F.floor((F.col("_rank") - 1) / size).cast("bigint")
    ).withColumn("review_body", F.when(F.col("batch_no") == 0, F.col(body)).otherwise("")
                 ).drop("_rank")


def summary_body(counts: DataFrame, bot: str = C.BOT_NAME, title: str = C.BOT_TITLE,
                 footer: str = C.SUMMARY_FOOTER) -> DataFrame:
    """Markdown summary per change.

    counts: change_id, summary, risk_level, critical, major, minor, nitpick,
    verified, advisory."""
    total = sum((F.col(s) for s in C.SEVERITIES_SHOWN), F.lit(0))
    risk = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in C.RISK_LABELS.items() for x in kv]),
        F.col("risk_level")), F.lit(C.RISK_UNKNOWN))
    top = F.concat_ws(
        "\n",
        F.lit(ids.summary_marker(bot)), F.lit(C.SUMMARY_HEADING.format(title=title)), F.lit(""),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat("summary", F.lit("\n"))),
        F.concat(F.lit(C.SUMMARY_RISK), risk, F.lit(" "), T.capitalize(F.col("risk_level"))),
        F.lit(""))
    count = lambda text, n: F.concat(F.lit(text[0]), F.col(n).cast("string"), F.lit(text[1]))
    table = F.concat_ws(
        "\n",
        *[F.lit(line) for line in C.SUMMARY_TABLE],
        *[F.when(F.col(s) > 0, F.concat(F.lit(f"| {s.capitalize()} | "),
                                        F.col(s).cast("string"), F.lit(" |")))
          for s in C.SEVERITIES_SHOWN],
        F.lit(""),
        F.when((F.col("verified") > 0) | (F.col("advisory") > 0), F.concat_ws(
            "\n", F.lit(C.SUMMARY_VERIFICATION), count(C.SUMMARY_VERIFIED, "verified"),
            F.when(F.col("advisory") > 0, count(C.SUMMARY_ADVISORY, "advisory")),
            F.lit(""))),
        F.lit("---"), F.lit(footer))
    return counts.select("change_id", F.concat_ws(
        "\n", top, F.when(total == 0, F.lit(C.SUMMARY_CLEAN)).otherwise(table)).alias("body"))
