"""Findings: model answers to rows, merging, guidance checks, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import text as T

ISSUE = """struct<file_path string, start_line bigint, end_line bigint, severity string,
 category string, reasoning string, explanation string, can_generate_patch boolean,
 replacement_code string, repository_convention boolean, guidance_id string>"""
ISSUE_REQUIRED = ("file_path", "start_line", "end_line", "severity", "category", "reasoning",
                  "explanation", "can_generate_patch")

# A finding's place in its change: rule findings (src 0) by file, rule and line,
# then model findings (src 1) by their order. Carried as columns, so no operator
# has to number all findings of a change.
ORDER = ["src", "k1", "k2", "k3"]
FINDING_COLUMNS = ["path", "start_line", "end_line", "severity", "category", "reasoning",
                   "explanation", "can_generate_patch", "replacement_code"]


# How a field's JSON value is taken. Texts must be strings; whole numbers may also come as strings,
# as decimals without a fraction or as truth values, and truth values as these words or as 0 and 1.
INT_TEXT = r"^[+-]?[0-9]+(?:_[0-9]+)*(?:\.0*)?$"
TRUE_WORDS, FALSE_WORDS = ("1", "t", "true", "on", "y", "yes"), ("0", "f", "false", "off", "n", "no")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    """A JSON number with its fraction, null for anything else."""
    return F.when(_kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, "$", "double"))


def _whole(value: Column) -> Column:
    text, number = T.strip(_text(value)), _number(value)
    return (F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
            .when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
            .when(number == F.floor(number), number.try_cast("bigint"))
            .when(text.rlike(INT_TEXT), F.regexp_replace(text, r"_|\..*$", "").try_cast("bigint")))


def _truth(value: Column) -> Column:
    word, number = F.lower(_text(value)), _number(value)
    return (F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(word.isin(*TRUE_WORDS) | (number == 1), True)
            .when(word.isin(*FALSE_WORDS) | (number == 0), False))


_TAKE = {"string": _text, "bigint": _whole, "boolean": _truth}
_FIELDS = [f.strip().rsplit(" ", 1) for f in ISSUE[len("struct<"):-1].replace("\n", "").split(",")]


def _issue(value: Column) -> Column:
    """An issue's fields as far as they can be taken, and whether it keeps the schema. A field that
    may be missing may be null or of its type, not of another."""
    fields, fine = [], []
    for name, kind in _FIELDS:
        raw = F.try_variant_get(value, f"$.{name}", "variant")
        taken = _TAKE[kind](raw)
        fields.append(taken.alias(name))
        if name in ISSUE_REQUIRED:
            fine.append(taken.isNotNull())
        elif kind == "boolean":  # has a default and may be missing, but not null
            fine.append(taken.isNotNull() | raw.isNull())
        else:
            fine.append(taken.isNotNull() | raw.isNull() | F.is_variant_null(raw))
    values = {"severity": C.SEVERITIES, "category": C.CATEGORIES}
    fine += [F.coalesce(fields[[n for n, _ in _FIELDS].index(f)].isin(*v), F.lit(False))
             for f, v in values.items()]
    ok = fine[0]
    for test in fine[1:]:
        ok = ok & test
    return F.struct(F.struct(*fields).alias("issue"), ok.alias("ok"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(change_id, json) to (change_id, valid, summary, risk_level, issues).

    An answer that breaks the schema gives an empty review with a fixed summary and risk. Fields are
    taken one by one from the JSON value: a quoted whole number is a number, but a number is no text.
    Unknown fields are ignored."""
    none = F.array().cast(f"array<{ISSUE}>")
    answer = F.col("answer")
    field = lambda name: F.try_variant_get(answer, f"$.{name}", "variant")
    parsed = responses.select("change_id", F.try_parse_json("json").alias("answer")).select(
        "change_id", _text(field("summary")).alias("summary"), _text(field("risk_level")).alias("risk"),
        field("issues").isNull().alias("no_list"), F.transform(
            F.try_variant_get(answer, "$.issues", "array<variant>"), _issue).alias("taken"))
    # Leaving a generator, the parsed columns are not pulled apart and parsed again.
    parsed = parsed.select("change_id", F.inline(F.array(F.struct("summary", "risk", "no_list", "taken"))))
    valid = F.coalesce(
        F.col("summary").isNotNull() & F.col("risk").isNotNull()
        & (F.col("no_list") | F.forall("taken", lambda t: t.ok)), F.lit(False))
    return parsed.withColumn("valid", valid).select(
        "change_id", "valid",
        F.when(F.col("valid"), F.col("summary")).otherwise(C.FALLBACK_SUMMARY).alias("summary"),
        F.when(F.col("valid"), F.col("risk")).otherwise(C.FALLBACK_RISK).alias("risk_level"),
        F.when(F.col("valid") & ~F.col("no_list"), F.transform("taken", lambda t: t.issue)).otherwise(none)
        .alias("issues"))


def response_findings(parsed: DataFrame) -> DataFrame:
    """One row per issue of ``parse_responses``, in answer order (``seq``)."""
    rows = parsed.select("change_id", F.posexplode("issues").alias("seq", "i"))
    return rows.select(
        "change_id", F.col("seq").cast("bigint").alias("seq"),
        F.col("i.file_path").alias("path"),
        *[f"i.{c}" for c in FINDING_COLUMNS[1:]],
        F.coalesce("i.repository_convention", F.lit(False)).alias("repository_convention"),
        "i.guidance_id")


def merge_findings(rule_findings: DataFrame, model_findings: DataFrame) -> DataFrame:
    """Rule findings in file order, then model findings."""
    zero = F.lit(0).cast("bigint")
    extra = [c for c in model_findings.columns
             if c not in ("change_id", "seq", *FINDING_COLUMNS)]
    rules = rule_findings.select(
        "change_id", zero.alias("src"), F.col("file_no").alias("k1"),
        F.col("rule_no").alias("k2"), F.col("start_line").alias("k3"), *FINDING_COLUMNS)
    model = model_findings.select(
        "change_id", F.lit(1).cast("bigint").alias("src"), F.col("seq").alias("k1"),
        zero.alias("k2"), zero.alias("k3"), *FINDING_COLUMNS, *extra)
    return rules.unionByName(model, allowMissingColumns=True)


def cap_comments(findings: DataFrame, limit: int = C.MAX_COMMENTS,
                 order: tuple[str, ...] = tuple(ORDER)) -> DataFrame:
    """The first findings of each change, in finding order. Filtering a row
    number right away lets each task keep ``limit`` rows per change before the
    shuffle, so a change with very many findings is no hot spot."""
    rank = F.row_number().over(Window.partitionBy("change_id").orderBy(*order))
    return findings.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def citation_link(base: str = C.CITATION_BASE) -> tuple[Column, Column]:
    """Label and commit-pinned link from repo_id, ref_path, ref_kind, ref_locator
    and ref_revision."""
    label = F.concat(F.col("ref_path"), F.lit(" ("), F.col("ref_locator"), F.lit(")"))
    anchor = F.when(F.col("ref_kind") == "markdown",
                    F.concat(F.lit("#"), F.col("ref_locator"))).otherwise("")
    url = F.concat(F.lit(base + "/"), F.col("repo_id"), F.lit("/blob/"), F.col("ref_revision"),
                   F.lit("/"), T.percent_encode_path(F.col("ref_path")), anchor)
    return label, url


def validate_guidance(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Keeps convention findings only if flagged and their (path, guidance id)
    was retrieved for the change; those lose their replacement and gain a
    citation. A guidance id without the flag is dropped; others pass.

    matches: change_id, changed_path, source_id, repo_id and the ref_* columns."""
    refs = matches.select(
        "change_id", F.col("changed_path").alias("path"), F.col("source_id").alias("guidance_id"),
        "repo_id", "ref_path", "ref_kind", "ref_locator", "ref_revision",
    ).dropDuplicates(["change_id", "path", "guidance_id"])
    guided = F.col("repository_convention") | F.col("guidance_id").isNotNull()
    # Only guided findings take part in the join.
    label, url = citation_link()
    kept = findings.filter(guided & F.col("repository_convention")).join(
        refs, ["change_id", "path", "guidance_id"]
    ).withColumns({
        "citation_label": label, "citation_url": url, "can_generate_patch": F.lit(False),
        "replacement_code": F.lit(None).cast("string")})
    plain = findings.filter(~guided).withColumns({
        "citation_label": F.lit(None).cast("string"), "citation_url": F.lit(None).cast("string")})
    columns = [*findings.columns, "citation_label", "citation_url"]
    return plain.select(columns).unionByName(kept.select(columns))


def guidance_on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Cited findings stay only if both their ends are added lines."""
    cited = F.col("citation_url").isNotNull()
    lines = changed.select("change_id", "path", "line").distinct()
    ends = lambda name: lines.withColumnRenamed("line", name)
    on_lines = findings.filter(
        cited & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))
    ).join(ends("start_line"), ["change_id", "path", "start_line"], "left_semi").join(
        ends("end_line"), ["change_id", "path", "end_line"], "left_semi")
    return findings.filter(~cited).unionByName(on_lines.select(findings.columns))


def clip_output(stdout: Column, stderr: Column) -> Column:
    """Both streams joined, empty ones skipped, to the output's defined length."""
    joined = F.concat_ws("\n", F.nullif(stdout, F.lit("")), F.nullif(stderr, F.lit("")))
    return F.substring(joined, 1, C.OUTPUT_CHARS)


def verification_status(attempts: DataFrame, repair_enabled: bool = True) -> DataFrame:
    """Adds status, output and repaired_code from the results of a first attempt
    and one repair. A failed attempt without output is not repaired; an error
    ends as failed.

    attempts: can_generate_patch, replacement_code, sandbox_on, first_ok,
    first_stdout, first_stderr, repair_code, repair_ok (+ optional first_error)."""
    no_patch = ~F.coalesce("can_generate_patch", F.lit(False)) | (
        F.coalesce("replacement_code", F.lit("")) == "")
    first_output = clip_output(F.col("first_stdout"), F.col("first_stderr"))
    if "first_error" in attempts.columns:
        first_output = F.coalesce("first_error", first_output)
    repaired = (F.lit(repair_enabled) & (first_output != "")
                & (F.coalesce("repair_code", F.lit("")) != "")
                & F.coalesce("repair_ok", F.lit(False)))
    first_ok = F.coalesce("first_ok", F.lit(False))
    status = (F.when(no_patch | ~F.col("sandbox_on"), "skipped").when(first_ok, "verified")
              .when(repaired, "repaired").otherwise("failed"))
    output = (F.when(no_patch, F.lit(None).cast("string"))
              .when(~F.col("sandbox_on"), C.SANDBOX_OFF_OUTPUT)
              .when(first_ok | repaired, C.PASSED_OUTPUT).otherwise(first_output))
    return attempts.withColumns({
        "status": status, "output": output,
        "repaired_code": F.when(status == "repaired", F.col("repair_code"))})


def severity_counts(findings: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Findings per change and severity, one column each."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES_SHOWN]
    grouped = findings.groupBy("change_id").agg(*counts)
    if changes is None:
        return grouped
    return changes.select("change_id").distinct().join(grouped, "change_id", "left").select(
        "change_id", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s)
                       for s in C.SEVERITIES_SHOWN])


def verification_counts(findings: DataFrame) -> DataFrame:
    """Verified (passed, repaired), advisory (failed, error), skipped (the rest)."""
    good, bad = F.col("status").isin("verified", "repaired"), F.col("status").isin("failed", "error")
    return findings.groupBy("change_id").agg(
        F.count_if(good).alias("verified"), F.count_if(bad).alias("advisory"),
        F.count_if(~good & ~bad).alias("skipped"))


def run_result(changes: DataFrame, findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Totals per change before the cap; all zero without findings."""
    totals = findings.groupBy("change_id").agg(
        F.count("*").alias("total_issues"),
        F.count_if(F.col("status").isin("verified", "repaired")).alias("verified_count"),
        F.count_if(F.col("status").isin("failed", "error")).alias("advisory_count"))
    posted = comments.select("change_id", F.lit(True).alias("posted")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return changes.select("change_id").distinct().join(totals, "change_id", "left").join(
        posted, "change_id", "left").select(
        "change_id", zero("total_issues"), zero("verified_count"), zero("advisory_count"),
        F.coalesce("posted", F.lit(False)).alias("posted"))
