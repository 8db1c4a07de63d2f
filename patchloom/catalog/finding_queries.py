"""Findings, comments and their lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.catalog import fixtures as X
from patchloom.catalog.registry import query
from patchloom.functions import ids
from patchloom.operators import comments as M
from patchloom.operators import diff as D
from patchloom.operators import filters as L
from patchloom.operators import findings as N
from patchloom.operators import lifecycle as Y
from patchloom.operators import rules as R
from patchloom.session import shared_folder
from patchloom.streaming import lifecycle_stream as S


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# --- inputs in SQL -----------------------------------------------------------

SEV = "['nitpick', 'minor', 'major', 'critical']"
CAT = "['security', 'bug', 'performance', 'error-handling', 'style', 'maintainability']"
MODEL = ("x_model", f"""
SELECT change_id, file_id AS seq, path,
  CAST(greatest(max(new_line) + file_id % 9 - file_id % 3, 1) AS BIGINT) AS start_line,
  CAST(max(new_line) + file_id % 9 AS BIGINT) AS end_line,
  ({SEV})[file_id % 4 + 1] AS severity, ({CAT})[file_id % 6 + 1] AS category,
  'Because.' AS reasoning,
  'See [docs] & <b>' || path || '</b>: https://x.test/a_b) *now*' AS explanation,
  file_id % 5 <> 0 AS can_generate_patch,
  CASE WHEN file_id % 5 <> 0 THEN 'fixed_' || file_id END AS replacement_code
FROM fx_changes GROUP BY change_id, file_id, path""")
ALL = ("x_findings", """
SELECT change_id, CAST(0 AS BIGINT) AS src, file_no AS k1, rule_no AS k2, line AS k3, path, line AS start_line,
  line AS end_line, severity, category,
  'Deterministic check ''' || rule || ''' matched on line ' || line || '.' AS reasoning,
  explanation, false AS can_generate_patch, CAST(NULL AS VARCHAR) AS replacement_code
FROM fx_rule_hits
UNION ALL
SELECT change_id, 1, seq, 0, 0, path, start_line, end_line, severity, category, reasoning,
  explanation, can_generate_patch, replacement_code FROM x_model""")
CID = """substr(sha256({p} || ':' || {s} || ':' || {e} || ':' || {c}), 1, 12)"""
COMMENTABLE = ("x_lines", "SELECT DISTINCT change_id, path, new_line AS line FROM fx_changes "
               "WHERE op <> 'delete'")
SNAPPED = ("x_snapped", """
SELECT f.*, (SELECT arg_min(l.line, abs(l.line - f.end_line) * 2
    + CASE WHEN l.line < f.end_line THEN 1 ELSE 0 END) FROM x_lines l
  WHERE l.change_id = f.change_id AND l.path = f.path AND abs(l.line - f.end_line) <= 5)
  AS comment_line FROM x_findings f""")


def all_findings(spark, sf):
    rules = R.rule_scan(L.added_line_rows(X.change_rows(spark, sf)))
    return N.merge_findings(rules, X.model_findings(spark, sf))


def commentable(spark, sf):
    return D.commentable_lines(X.change_rows(spark, sf))


KEY = ["change_id", *N.ORDER]


def longs(df):
    """Order columns as bigint, whatever literals they came from."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in N.ORDER if c in df.columns})


# --- model answers -----------------------------------------------------------


@query("parse_responses", f"""
SELECT r.change_id, r.valid, CASE WHEN valid THEN substr(md5(text), 1, 8) ELSE
  {sql_text(C.FALLBACK_SUMMARY)} END AS summary,
  CASE WHEN valid THEN 'medium' ELSE 'low' END AS risk_level,
  CAST(i AS BIGINT) AS seq,
  CASE WHEN i IS NOT NULL THEN 'src/f' || (change_id % 20) || '.py' END AS path,
  CASE WHEN i IS NOT NULL THEN change_id % 50 + 1 END AS start_line,
  CASE WHEN i IS NOT NULL THEN change_id % 50 + 3 END AS end_line,
  CASE WHEN i IS NOT NULL THEN change_id % 2 = 0 END AS can_generate_patch,
  CASE WHEN i IS NOT NULL AND change_id % 3 = 0 THEN 'c' || change_id END AS replacement_code
FROM (SELECT doc_id AS change_id, text, doc_id % 11 NOT IN (0, 2)
        AND doc_id % 13 <> 3 AND (doc_id % 11 <> 1 OR doc_id % 4 = 0) AS valid FROM documents) r
LEFT JOIN LATERAL (SELECT unnest(range(0, CASE WHEN valid THEN change_id % 4 ELSE 0 END)) AS i)
  ON true""")
def parse_responses(spark, sf):
    parsed = N.parse_responses(X.responses(spark, sf))
    issues = N.response_findings(parsed).select(
        "change_id", "seq", "path", "start_line", "end_line", "can_generate_patch",
        "replacement_code")
    return parsed.drop("issues").join(issues, "change_id", "left")


@query("merge_findings", "SELECT * FROM x_findings", views=(MODEL, ALL))
def merge_findings(spark, sf):
    return all_findings(spark, sf)


@query("comment_id", f"""
SELECT change_id, src, k1, k2, k3,
  {CID.format(p="path", s="start_line", e="end_line", c="category")} AS comment_id
FROM x_findings""", views=(MODEL, ALL))
def comment_id(spark, sf):
    return M.with_comment_id(all_findings(spark, sf)).select(*KEY, "comment_id")


# --- guidance in findings ----------------------------------------------------

_GUIDED = ("x_guided", """
SELECT *, k1 % 3 = 0 AND src = 1 AS repository_convention,
  CASE WHEN src = 1 AND k1 % 2 = 0 THEN 'g' || (k1 % 4) END AS guidance_id FROM x_findings""")
_MATCHES = ("x_matches", """
SELECT DISTINCT change_id, path AS changed_path, 'g' || (file_id % 4) AS source_id,
  'org/r' || change_id AS repo_id, 'docs/a b~' || file_id || '.md' AS ref_path,
  CASE WHEN file_id % 12 = 0 THEN 'markdown' ELSE 'decision' END AS ref_kind,
  'L' || (file_id % 9) AS ref_locator, md5(path) AS ref_revision
FROM fx_files WHERE file_id % 4 = 0""")
_VALID = ("x_valid", """
SELECT f.*, m.ref_path || ' (' || m.ref_locator || ')' AS citation_label,
  'https://github.com/' || m.repo_id || '/blob/' || m.ref_revision || '/'
    || replace(url_encode(m.ref_path), '%2F', '/')
    || CASE WHEN m.ref_kind = 'markdown' THEN '#' || m.ref_locator ELSE '' END AS citation_url
FROM x_guided f LEFT JOIN x_matches m
  ON m.change_id = f.change_id AND m.changed_path = f.path AND m.source_id = f.guidance_id
  AND f.repository_convention
WHERE (f.guidance_id IS NULL AND NOT f.repository_convention)
  OR (f.repository_convention AND m.source_id IS NOT NULL)""")
_GUIDED_VIEWS = (MODEL, ALL, _GUIDED, _MATCHES, _VALID)


def guided(spark, sf):
    f = all_findings(spark, sf)
    model = F.col("src") == 1
    return f.withColumns({
        "repository_convention": model & (F.col("k1") % 3 == 0),
        "guidance_id": F.when(model & (F.col("k1") % 2 == 0),
                              F.concat(F.lit("g"), (F.col("k1") % 4).cast("string")))})


def guidance_matches(spark, sf):
    f = F.col("file_id")
    return X.files(spark, sf).filter(f % 4 == 0).select(
        "change_id", F.col("path").alias("changed_path"),
        F.concat(F.lit("g"), (f % 4).cast("string")).alias("source_id"),
        F.concat(F.lit("org/r"), F.col("change_id").cast("string")).alias("repo_id"),
        F.concat(F.lit("docs/a b~"), f.cast("string"), F.lit(".md")).alias("ref_path"),
        F.when(f % 12 == 0, "markdown").otherwise("decision").alias("ref_kind"),
        F.concat(F.lit("L"), (f % 9).cast("string")).alias("ref_locator"),
        F.md5("path").alias("ref_revision"))


@query("validate_guidance", """
SELECT change_id, src, k1, k2, k3, path, citation_label, citation_url,
  can_generate_patch AND citation_url IS NULL AS can_generate_patch,
  CASE WHEN citation_url IS NULL THEN replacement_code END AS replacement_code
FROM x_valid""", views=_GUIDED_VIEWS)
def validate_guidance(spark, sf):
    return N.validate_guidance(guided(spark, sf), guidance_matches(spark, sf)).select(
        *KEY, "path", "citation_label", "citation_url", "can_generate_patch", "replacement_code")


@query("guidance_on_changed_lines", """
SELECT change_id, src, k1, k2, k3, citation_url FROM x_valid v
WHERE citation_url IS NULL OR (start_line > 0 AND end_line >= start_line
  AND EXISTS (SELECT 1 FROM fx_changes c WHERE c.op = 'add' AND c.change_id = v.change_id
    AND c.path = v.path AND c.new_line = v.start_line)
  AND EXISTS (SELECT 1 FROM fx_changes c WHERE c.op = 'add' AND c.change_id = v.change_id
    AND c.path = v.path AND c.new_line = v.end_line))""", views=_GUIDED_VIEWS)
def guidance_on_changed_lines(spark, sf):
    kept = N.validate_guidance(guided(spark, sf), guidance_matches(spark, sf))
    lines = D.changed_lines(X.change_rows(spark, sf))
    return N.guidance_on_changed_lines(kept, lines).select(*KEY, "citation_url")


@query("citation_link", """
SELECT change_id, changed_path, ref_path || ' (' || ref_locator || ')' AS citation_label,
  'https://github.com/' || repo_id || '/blob/' || ref_revision || '/'
    || replace(url_encode(ref_path), '%2F', '/')
    || CASE WHEN ref_kind = 'markdown' THEN '#' || ref_locator ELSE '' END AS citation_url
FROM x_matches""", views=(_MATCHES,))
def citation_link(spark, sf):
    label, url = N.citation_link()
    return guidance_matches(spark, sf).select(
        "change_id", "changed_path", label.alias("citation_label"), url.alias("citation_url"))


# --- comments ----------------------------------------------------------------


@query("snap_line", """
SELECT change_id, src, k1, k2, k3, end_line, comment_line FROM x_snapped
WHERE comment_line IS NOT NULL""", views=(MODEL, ALL, COMMENTABLE, SNAPPED))
def snap_line(spark, sf):
    return M.snap_line(all_findings(spark, sf), commentable(spark, sf), KEY).select(
        *KEY, "end_line", "comment_line")


@query("comment_span", """
SELECT change_id, src, k1, k2, k3, comment_line, CASE WHEN start_line < comment_line AND EXISTS (
  SELECT 1 FROM x_lines l WHERE l.change_id = s.change_id AND l.path = s.path
    AND l.line = s.start_line) THEN start_line END AS span_start
FROM x_snapped s WHERE comment_line IS NOT NULL""", views=(MODEL, ALL, COMMENTABLE, SNAPPED))
def comment_span(spark, sf):
    lines = commentable(spark, sf)
    return M.comment_span(M.snap_line(all_findings(spark, sf), lines, KEY), lines).select(
        *KEY, "comment_line", "span_start")


_BADGES = ("CASE severity " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in C.SEVERITY_LABELS.items()) + " END")
_CATS = ("CASE category " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in C.CATEGORY_LABELS.items()) + " END")
_NOTES = ("CASE status " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in C.STATUS_NOTES.items()) + " END")
_PLAIN_BODY = f"""'<!-- {C.BOT_NAME}:id=' || {CID.format(
    p="path", s="start_line", e="end_line", c="category")} || ' -->' || chr(10)
  || '**' || {_BADGES} || '** | ' || {_CATS} || chr(10) || chr(10)"""


@query("review_comments", f"""
SELECT change_id, src, k1, k2, k3, path, comment_line AS line, 'RIGHT' AS side,
  span AS start_line, CASE WHEN span IS NOT NULL THEN 'RIGHT' END AS start_side,
  {CID.format(p="path", s="start_line", e="end_line", c="category")} AS comment_id,
  {_PLAIN_BODY} || explanation || CASE WHEN replacement_code <> '' THEN
    chr(10) || chr(10) || '```suggestion' || chr(10) || replacement_code || chr(10) || '```'
    ELSE '' END AS body
FROM (SELECT s.*, CASE WHEN start_line < comment_line AND EXISTS (
  SELECT 1 FROM x_lines l WHERE l.change_id = s.change_id AND l.path = s.path
    AND l.line = s.start_line) THEN start_line END AS span FROM x_snapped s
  WHERE comment_line IS NOT NULL) t""", views=(MODEL, ALL, COMMENTABLE, SNAPPED))
def review_comments(spark, sf):
    return M.review_comments(all_findings(spark, sf), commentable(spark, sf))


@query("cap_comments", """
SELECT change_id, src, k1, k2, k3, path FROM (SELECT *, row_number() OVER (PARTITION BY change_id
  ORDER BY src, k1, k2, k3) AS rn FROM x_findings) t WHERE rn <= 15""", views=(MODEL, ALL))
def cap_comments(spark, sf):
    return N.cap_comments(all_findings(spark, sf)).select(*KEY, "path")


_STYLED = ("x_styled", """
SELECT *, k1 % 2 = 1 AS is_guidance,
  CASE WHEN k1 % 4 = 1 THEN path || ' <[L1]>' END AS citation_label,
  CASE WHEN k1 % 4 = 1 THEN 'https://x.test/' || k1 END AS citation_url,
  CASE WHEN k1 % 6 = 2 THEN 'again_' || k1 WHEN k1 % 6 = 3 THEN '' END AS repaired_code,
  (['verified', 'repaired', 'failed', 'skipped', 'error'])[k1 % 5 + 1] AS status
FROM x_findings WHERE src = 1""")
_ESCAPED = r"""regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(explanation, '(?:https?://|www\.)[^\s\]\)>]+', 'link omitted', 'g'),
  '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
  '([\\`*_{}\[\]()#!|~])', '\\\1', 'g')"""


def styled(spark, sf):
    k = F.col("k1")
    return M.with_comment_id(all_findings(spark, sf).filter(F.col("src") == 1)).withColumns({
        "is_guidance": k % 2 == 1,
        "citation_label": F.when(k % 4 == 1, F.concat("path", F.lit(" <[L1]>"))),
        "citation_url": F.when(k % 4 == 1, F.concat(F.lit("https://x.test/"), k.cast("string"))),
        "repaired_code": F.when(k % 6 == 2, F.concat(F.lit("again_"), k.cast("string")))
        .when(k % 6 == 3, ""),
        "status": F.element_at(F.array(*map(F.lit, (
            "verified", "repaired", "failed", "skipped", "error"))), (k % 5 + 1).cast("int"))})


@query("comment_body", f"""
SELECT change_id, k1, {_PLAIN_BODY} || CASE WHEN is_guidance THEN {_ESCAPED} ELSE explanation END
  || CASE WHEN is_guidance AND citation_url IS NOT NULL THEN chr(10) || chr(10)
    || 'Repository guidance: [' || replace(replace(replace(replace(citation_label,
      '<', '&lt;'), '>', '&gt;'), '[', '\\['), ']', '\\]') || '](' || citation_url || ')'
    ELSE '' END
  || CASE WHEN coalesce(nullif(repaired_code, ''), replacement_code) IS NOT NULL THEN
    chr(10) || chr(10) || '```suggestion' || chr(10)
    || coalesce(nullif(repaired_code, ''), replacement_code) || chr(10) || '```' ELSE '' END
  || coalesce(chr(10) || chr(10) || '> ' || {_NOTES}, '') AS body
FROM x_styled""", views=(MODEL, ALL, _STYLED))
def comment_body(spark, sf):
    return styled(spark, sf).select("change_id", "k1", M.comment_body().alias("body"))


@query("escape_prose", f"""
SELECT doc_id, {_ESCAPED} AS escaped FROM (SELECT doc_id, replace('#1 "it''s" www.a.b/c] '
  || text, chr(10), ' ') AS explanation FROM documents) t""")
def escape_prose(spark, sf):
    return X.documents(spark, sf).select(
        "doc_id", M.escape_prose(F.concat(F.lit("#1 \"it's\" www.a.b/c] "), F.col("text")))
        .alias("escaped"))


@query("severity_counts", """
SELECT c.change_id, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor,
  count(*) FILTER (severity = 'nitpick') AS nitpick
FROM (SELECT DISTINCT change_id FROM fx_files) c LEFT JOIN (
  SELECT * FROM fx_rule_hits WHERE path NOT IN (SELECT path FROM fx_ignored)) h
  ON h.change_id = c.change_id GROUP BY c.change_id""")
def severity_counts(spark, sf):
    """The minimum slice: raw diffs to counts per change and severity."""
    from patchloom.plans.review import check_run
    diffs = X.diffs(spark, sf)
    return N.severity_counts(check_run(diffs, X.head_texts(spark, sf)), diffs)


@query("verification_counts", """
SELECT change_id, count(*) FILTER (status IN ('verified', 'repaired')) AS verified,
  count(*) FILTER (status IN ('failed', 'error')) AS advisory,
  count(*) FILTER (status = 'skipped') AS skipped FROM x_styled GROUP BY change_id""",
       views=(MODEL, ALL, _STYLED))
def verification_counts(spark, sf):
    return N.verification_counts(styled(spark, sf))


@query("summary_body", f"""
SELECT change_id, '<!-- {C.BOT_NAME}:summary -->' || chr(10) || '## 🔍 {C.BOT_TITLE} Summary'
  || chr(10) || chr(10) || CASE WHEN change_id % 3 = 0 THEN '' ELSE 'Change ' || change_id
  || chr(10) || chr(10) END || '**Risk Level:** ' || CASE change_id % 4 WHEN 0 THEN '🟢 Low'
  WHEN 1 THEN '🟡 Medium' WHEN 2 THEN '🔴 High' ELSE '⚪ Odd' END || chr(10) || chr(10)
  || CASE WHEN n = 0 THEN {sql_text(C.SUMMARY_CLEAN)} ELSE '### Findings' || chr(10) || chr(10)
  || '| Severity | Count |' || chr(10) || '|:---------|------:|' || chr(10)
  || CASE WHEN critical > 0 THEN '| Critical | ' || critical || ' |' || chr(10) ELSE '' END
  || CASE WHEN major > 0 THEN '| Major | ' || major || ' |' || chr(10) ELSE '' END
  || CASE WHEN minor > 0 THEN '| Minor | ' || minor || ' |' || chr(10) ELSE '' END
  || CASE WHEN nitpick > 0 THEN '| Nitpick | ' || nitpick || ' |' || chr(10) ELSE '' END
  || chr(10) || CASE WHEN verified > 0 OR advisory > 0 THEN '### Verification' || chr(10)
  || '- ✅ **' || verified || '** suggestions sandbox-verified (tests pass)' || chr(10)
  || CASE WHEN advisory > 0 THEN '- ⚠️ **' || advisory
    || '** advisory comments (could not verify)' || chr(10) ELSE '' END || chr(10) ELSE '' END
  || '---' || chr(10) || {sql_text(C.SUMMARY_FOOTER)} END AS body
FROM (SELECT c.change_id, count(k1) AS n, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor,
  count(*) FILTER (severity = 'nitpick') AS nitpick,
  count(*) FILTER (status IN ('verified', 'repaired')) AS verified,
  count(*) FILTER (status IN ('failed', 'error')) AS advisory
  FROM (SELECT DISTINCT change_id FROM fx_files) c LEFT JOIN x_styled s ON s.change_id = c.change_id GROUP BY c.change_id) t""",
       views=(MODEL, ALL, _STYLED))
def summary_body(spark, sf):
    c = F.col("change_id")
    found = styled(spark, sf)
    counts = N.severity_counts(found, X.files(spark, sf)).join(
        N.verification_counts(found), "change_id", "left").select(
        "change_id", *C.SEVERITIES_SHOWN,
        F.coalesce("verified", F.lit(0)).alias("verified"),
        F.coalesce("advisory", F.lit(0)).alias("advisory"),
        F.when(c % 3 != 0, F.concat(F.lit("Change "), c.cast("string"))).otherwise("")
        .alias("summary"),
        F.when(c % 4 == 0, "low").when(c % 4 == 1, "medium").when(c % 4 == 2, "high")
        .otherwise("oDD").alias("risk_level"))
    return M.summary_body(counts)


@query("run_result", """
SELECT c.change_id, count(s.k1) AS total_issues,
  count(*) FILTER (status IN ('verified', 'repaired')) AS verified_count,
  count(*) FILTER (status IN ('failed', 'error')) AS advisory_count,
  c.change_id IN (SELECT change_id FROM x_snapped WHERE src = 1 AND comment_line IS NOT NULL)
    AS posted
FROM (SELECT DISTINCT change_id FROM fx_files) c LEFT JOIN x_styled s ON s.change_id = c.change_id
GROUP BY c.change_id""", views=(MODEL, ALL, COMMENTABLE, SNAPPED, _STYLED))
def run_result(spark, sf):
    found = styled(spark, sf)
    posted = M.snap_line(found, commentable(spark, sf), KEY)
    return N.run_result(X.files(spark, sf), found, posted)


@query("findings_json", """
SELECT change_id, CAST(to_json({change_id: change_id, src: src, k1: k1, k2: k2, k3: k3, path: path,
  start_line: start_line, end_line: end_line, severity: severity, category: category,
  reasoning: reasoning, explanation: explanation, can_generate_patch: can_generate_patch,
  replacement_code: replacement_code}) AS VARCHAR) AS json FROM x_findings""", views=(MODEL, ALL))
def findings_json(spark, sf):
    from patchloom.sources.sinks import findings_json as to_json
    return to_json(all_findings(spark, sf))


_COMMENTS = ("x_comments", f"""
SELECT *, CASE WHEN seq % 13 = 0 THEN 'A remark by a person.'
  WHEN seq % 7 = 0 THEN {sql_text(C.RESOLVED_BADGE)} || '<!-- {C.BOT_NAME}:id=' || comment_id
    || ' -->' || chr(10) || 'Text'
  ELSE '<!-- {C.BOT_NAME}:id=' || comment_id || ' -->' || chr(10) || 'Text' END AS body
FROM (SELECT event_id AS seq, user_id AS change_id, CAST(day(ts) AS BIGINT) AS revision,
  'f' || (event_id % 20) || '.py' AS path, CAST(floor(value) AS BIGINT) AS line,
  event_type AS category, {CID.format(p="'f' || (event_id % 20) || '.py'",
  s="CAST(floor(value) AS BIGINT)", e="CAST(floor(value) AS BIGINT)", c="event_type")}
  AS comment_id FROM events) t""")


@query("comment_batches", """
SELECT change_id, seq, batch_no, CASE WHEN batch_no = 0 THEN 'Run on ' || change_id ELSE '' END
  AS review_body FROM (SELECT change_id, seq, CAST(floor((row_number() OVER (
    PARTITION BY change_id ORDER BY seq) - 1) / 25) AS BIGINT) AS batch_no FROM x_comments) t""",
       views=(_COMMENTS,))
def comment_batches(spark, sf):
    rows = X.comments(spark, sf).select(
        "change_id", "seq",
        F.concat(F.lit("Run on "), F.col("change_id").cast("string")).alias("review"))
    return M.comment_batches(rows, "review").drop("review")


# --- lifecycle ---------------------------------------------------------------

_LAST = ("x_last", "SELECT change_id, max(revision) AS revision FROM x_comments GROUP BY 1")
# Some changes have no run now, some have one that found nothing.
_NOW = ("x_now", "SELECT change_id FROM x_last WHERE change_id % 11 <> 3")
_CURRENT = ("x_current", "SELECT c.* FROM x_comments c JOIN x_last USING (change_id, revision) "
            "JOIN x_now USING (change_id) WHERE change_id % 7 <> 2")
_POSTED = ("x_posted", "SELECT c.* FROM x_comments c JOIN x_last l ON l.change_id = c.change_id "
           "AND c.revision < l.revision")
_EXISTING = ("x_existing", """
SELECT change_id, comment_id, max(seq) AS seq, arg_max(body, seq) AS body FROM x_posted
WHERE seq % 13 <> 0 GROUP BY ALL""")
_LIFE = (_COMMENTS, _LAST, _NOW, _CURRENT, _POSTED, _EXISTING)


def runs_split(spark, sf):
    """(comments of each change's last run, comments of the runs before, changes with a run)."""
    c = X.comments(spark, sf)
    last = c.groupBy("change_id").agg(F.max("revision").alias("last"))
    tagged = c.join(last, "change_id")
    runs = last.select("change_id").filter(F.col("change_id") % 11 != 3)
    current = tagged.filter((F.col("revision") == F.col("last")) & (F.col("change_id") % 11 != 3)
                            & (F.col("change_id") % 7 != 2)).drop("last")
    return current, tagged.filter(F.col("revision") < F.col("last")).drop("last"), runs


@query("extract_marker", """
SELECT change_id, seq, comment_id AS marker_id FROM x_comments WHERE seq % 13 <> 0""",
       views=(_COMMENTS,))
def extract_marker(spark, sf):
    return Y.extract_marker(X.comments(spark, sf)).select("change_id", "seq", "marker_id")


@query("existing_comments", "SELECT * FROM x_existing", views=_LIFE)
def existing_comments(spark, sf):
    return Y.existing_comments(runs_split(spark, sf)[1])


@query("new_comments", """
SELECT change_id, comment_id, seq FROM x_current c WHERE NOT EXISTS (SELECT 1 FROM x_existing e
  WHERE e.change_id = c.change_id AND e.comment_id = c.comment_id)""", views=_LIFE)
def new_comments(spark, sf):
    current, posted, _ = runs_split(spark, sf)
    return Y.new_comments(current, Y.existing_comments(posted)).select(
        "change_id", "comment_id", "seq")


_RESOLVED = ("x_resolved", """
SELECT * FROM x_existing e WHERE change_id IN (SELECT change_id FROM x_now)
  AND NOT EXISTS (SELECT 1 FROM x_current c
    WHERE e.change_id = c.change_id AND e.comment_id = c.comment_id)""")


@query("resolved_comments", "SELECT * FROM x_resolved", views=(*_LIFE, _RESOLVED))
def resolved_comments(spark, sf):
    current, posted, runs = runs_split(spark, sf)
    return Y.resolved_comments(current, Y.existing_comments(posted), runs)


@query("mark_resolved", f"""
SELECT change_id, comment_id, seq, seq % 7 <> 0 AS updated,
  CASE WHEN seq % 7 <> 0 THEN {sql_text(C.RESOLVED_BADGE)} ELSE '' END || body AS body
FROM x_resolved""", views=(*_LIFE, _RESOLVED))
def mark_resolved(spark, sf):
    current, posted, runs = runs_split(spark, sf)
    return Y.mark_resolved(Y.resolved_comments(current, Y.existing_comments(posted), runs))


@query("summary_upsert", f"""
SELECT s.change_id, CASE WHEN o.seq IS NULL THEN 'insert' ELSE 'update' END AS action, o.seq,
  '<!-- {C.BOT_NAME}:summary -->' || s.change_id AS body
FROM (SELECT DISTINCT change_id FROM x_comments) s LEFT JOIN (
  SELECT change_id, min(seq) AS seq FROM x_comments WHERE seq % 29 = 0 GROUP BY 1) o
  ON o.change_id = s.change_id""", views=(_COMMENTS,))
def summary_upsert(spark, sf):
    marker = F.lit(ids.summary_marker(C.BOT_NAME))
    c = X.comments(spark, sf)
    talk = c.select("change_id", "seq", F.when(
        F.col("seq") % 29 == 0, F.concat(F.lit("x"), marker)).otherwise(F.col("body")).alias("body"))
    new = c.select("change_id").distinct().select(
        "change_id", F.concat(marker, F.col("change_id").cast("string")).alias("body"))
    return Y.summary_upsert(talk, new)


@query("lifecycle_stats", """
SELECT change_id, CAST(coalesce(sum(CAST(is_old AS INT)), 0) AS BIGINT) AS existing_comments,
  CAST(coalesce(sum(CASE WHEN NOT is_old THEN n ELSE 0 END), 0) AS BIGINT) AS new_comments,
  CAST(coalesce(sum(CASE WHEN is_old THEN n ELSE 0 END), 0) AS BIGINT) AS duplicates_skipped,
  CAST(coalesce(sum(CASE WHEN is_old AND n = 0 AND seq % 7 <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT)
    AS resolved_marked
FROM x_now LEFT JOIN (SELECT change_id, comment_id, e.seq IS NOT NULL AS is_old, e.seq, coalesce(c.n, 0) AS n
  FROM x_existing e FULL JOIN (SELECT change_id, comment_id, count(*) AS n FROM x_current
    GROUP BY ALL) c USING (change_id, comment_id)) t USING (change_id) GROUP BY change_id""",
       views=_LIFE)
def lifecycle_stats(spark, sf):
    current, posted, runs = runs_split(spark, sf)
    return Y.lifecycle_stats(current, posted, runs)


def review_runs(spark, sf):
    """Runs of every change, flat: a row per comment and one for the run; some runs found
    nothing."""
    empty = (F.col("change_id") + F.col("revision")) % 17 == 0
    c = X.comments(spark, sf).select("change_id", "revision", F.when(
        ~empty, F.col("comment_id")).alias("comment_id"))
    return c.unionByName(c.select("change_id", "revision", F.lit(None).cast("string").alias(
        "comment_id"))).distinct()


@query("lifecycle_stream", """
SELECT p.change_id, p.comment_id, p.posted_revision, (
  SELECT min(r.revision) FROM x_runs r WHERE r.change_id = p.change_id
    AND r.revision > p.posted_revision AND NOT EXISTS (SELECT 1 FROM x_held c
      WHERE c.change_id = p.change_id AND c.comment_id = p.comment_id AND c.revision = r.revision))
  AS resolved_revision
FROM (SELECT change_id, comment_id, min(revision) AS posted_revision FROM x_held GROUP BY ALL) p
""", views=(_COMMENTS,
            ("x_held", "SELECT * FROM x_comments WHERE (change_id + revision) % 17 <> 0"),
            ("x_runs", "SELECT DISTINCT change_id, revision FROM x_comments")))
def lifecycle_stream(spark, sf):
    """Runs arrive as files of a few days each, in order; all are streamed."""
    import uuid
    folder = f"{shared_folder(spark)}/lifecycle-{uuid.uuid4().hex}"
    review_runs(spark, sf).write.parquet(f"{folder}/all")
    runs = spark.read.schema(S.RUN_SCHEMA).parquet(f"{folder}/all")
    for part in range(3):  # 31 days at most
        runs.filter(F.floor((F.col("revision") - 1) / 11) == part).repartition(
            "change_id").write.mode("append").parquet(f"{folder}/runs")
    table = S.StateTable(spark, f"{folder}/state", compact_every=2, buckets=8)
    stream = spark.readStream.schema(S.RUN_SCHEMA).option("maxFilesPerTrigger", 8).parquet(
        f"{folder}/runs")
    S.start(stream, table, f"{folder}/checkpoint").awaitTermination()
    return table.ids()
