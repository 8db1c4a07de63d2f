"""Sources, diff decomposition, filters and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.catalog import fixtures as X
from patchloom.catalog.registry import query
from patchloom.functions import paths as P
from patchloom.operators import diff as D
from patchloom.operators import filters as L
from patchloom.operators import rules as R

# --- scans -------------------------------------------------------------------


@query("scan_diffs", """
SELECT change_id, CAST(count(*) AS BIGINT) AS files FROM fx_files GROUP BY change_id""")
def scan_diffs(spark, sf):
    blank = X.diffs(spark, sf).select(
        (-1 - F.col("change_id")).alias("change_id"), F.lit(" \t\n").alias("diff_text"))
    return D.scan_diffs(X.diffs(spark, sf).unionByName(blank)).select(
        "change_id",
        (F.size(F.split("diff_text", r"(?m)^diff --git")) - 1).cast("bigint").alias("files"))


@query("head_files", """
SELECT f.change_id, f.file_no, f.path, CAST(length(h.content) AS BIGINT) AS chars,
  md5(h.content) AS digest
FROM fx_diff_files f JOIN fx_head h ON h.change_id = f.change_id AND h.path = f.path
WHERE h.content <> ''""")
def head_files(spark, sf):
    files = D.diff_files(X.diffs(spark, sf)).select("change_id", "file_no", "path")
    return L.head_files(files, X.head_texts(spark, sf)).select(
        "change_id", "file_no", "path", F.length("content").cast("bigint").alias("chars"),
        F.md5("content").alias("digest"))


# --- diff decomposition ------------------------------------------------------

_RENDERED = ("x_blocks", """
SELECT f.change_id, f.file_no, f.gen_path AS p, f.kind, h.hunk_no, h.body,
  '@@ -' || h.old_start || ',' || h.old_count || ' +' || h.new_start || ',' || h.new_count || ' @@'
    AS header
FROM fx_diff_files f LEFT JOIN fx_hunks h ON h.file_id = f.file_id""")


@query("diff_lines", """
SELECT change_id, CAST(row_number() OVER (PARTITION BY change_id ORDER BY file_no, hunk_no, k, i)
  AS BIGINT) AS pos, raw FROM x_all""", views=(_RENDERED, ("x_all", """
  SELECT change_id, file_no, -1 AS hunk_no, 0 AS k, unnest(
    ['diff --git a/' || p || ' b/' || p] || CASE kind
      WHEN 'new' THEN ['new file mode 100644', '--- /dev/null', '+++ b/' || p]
      WHEN 'deleted' THEN ['deleted file mode 100644', '--- a/' || p, '+++ /dev/null']
      WHEN 'rename' THEN ['rename from ' || p, 'rename to ' || p || '.moved']
      WHEN 'binary' THEN ['Binary files a/' || p || ' and b/' || p || ' differ']
      ELSE ['--- a/' || p, '+++ b/' || p] END) AS raw,
    unnest(CASE kind WHEN 'new' THEN [1, 2, 3, 4] WHEN 'deleted' THEN [1, 2, 3, 4]
      WHEN 'binary' THEN [1, 2] ELSE [1, 2, 3] END) AS i
  FROM (SELECT DISTINCT change_id, file_no, p, kind FROM x_blocks)
  UNION ALL
  SELECT change_id, file_no, hunk_no, 1, header, 0 FROM x_blocks WHERE hunk_no IS NOT NULL
  UNION ALL
  SELECT change_id, file_id % 20, hunk_no, 2,
    CASE op WHEN 'add' THEN '+' WHEN 'delete' THEN '-' ELSE ' ' END || line, n FROM fx_changes""")))
def diff_lines(spark, sf):
    return D.diff_lines(X.diffs(spark, sf))


@query("diff_files", """
SELECT change_id, file_no, old_path, new_path, path, kind = 'new' AS is_new_file,
  kind = 'deleted' AS is_deleted_file, kind = 'rename' AS is_renamed, kind = 'binary' AS is_binary
FROM fx_diff_files""")
def diff_files(spark, sf):
    return D.diff_files(X.diffs(spark, sf))


@query("diff_hunks", """
SELECT change_id, file_no, path, hunk_no, old_start, old_count, new_start, new_count,
  '@@ -' || old_start || ',' || old_count || ' +' || new_start || ',' || new_count || ' @@' AS header
FROM fx_hunks""")
def diff_hunks(spark, sf):
    return D.diff_hunks(X.diffs(spark, sf))


@query("diff_changes", """
SELECT change_id, file_id % 20 AS file_no, path, hunk_no,
  CAST(row_number() OVER (PARTITION BY file_id, hunk_no ORDER BY n) - 1 AS BIGINT) AS seq,
  op, line AS content, new_line AS line_number, old_line AS old_line_number
FROM fx_changes""")
def diff_changes(spark, sf):
    return D.diff_changes(X.diffs(spark, sf))


@query("file_path", "SELECT change_id, file_no, path FROM fx_diff_files")
def file_path(spark, sf):
    return D.diff_files(X.diffs(spark, sf)).select("change_id", "file_no", "path")


@query("changed_lines", """
SELECT DISTINCT change_id, file_id % 20 AS file_no, path, new_line AS line
FROM fx_changes WHERE op = 'add'""")
def changed_lines(spark, sf):
    return D.changed_lines(D.diff_changes(X.diffs(spark, sf)))


@query("commentable_lines", """
SELECT DISTINCT change_id, file_id % 20 AS file_no, path, new_line AS line
FROM fx_changes WHERE op <> 'delete'""")
def commentable_lines(spark, sf):
    return D.commentable_lines(D.diff_changes(X.diffs(spark, sf)))


@query("hunk_line_range", """
SELECT change_id, file_no, path, hunk_no, coalesce(lo, new_start) AS first_line,
  coalesce(hi, new_start) AS last_line FROM fx_hunks""")
def hunk_line_range(spark, sf):
    return D.hunk_line_range(X.diffs(spark, sf))


@query("changed_file_paths", "SELECT change_id, file_no, path FROM fx_diff_files WHERE path <> ''")
def changed_file_paths(spark, sf):
    return D.changed_file_paths(D.diff_files(X.diffs(spark, sf)))


@query("rendered_hunks", """
SELECT change_id, file_no, path, hunk_no, body AS hunk_body FROM fx_hunks""")
def rendered_hunks(spark, sf):
    return D.rendered_hunks(X.diffs(spark, sf))


@query("added_text", """
SELECT change_id, file_no, path, substr(added, 1, 3000) AS added_text FROM (
  SELECT change_id, file_id % 20 AS file_no, path, string_agg(line, chr(10) ORDER BY n) AS added
  FROM fx_changes WHERE op = 'add' GROUP BY ALL) t
WHERE trim(added, ' ' || chr(9) || chr(10)) <> ''""")
def added_text(spark, sf):
    return D.added_text(D.diff_files(X.diffs(spark, sf), with_hunks=True))


@query("diff_report", """
SELECT f.change_id, f.file_no, f.path,
  CASE f.kind WHEN 'new' THEN 'NEW' WHEN 'deleted' THEN 'DELETED' WHEN 'binary' THEN 'BINARY'
    ELSE '' END AS status,
  (SELECT CAST(count(DISTINCT hunk_no) AS BIGINT) FROM fx_changes c WHERE c.file_id = f.file_id)
    AS hunks,
  '[' || coalesce(array_to_string(a.lines[1:20], ', '), '') || ']'
    || CASE WHEN len(a.lines) > 20 THEN '...' ELSE '' END AS first_changed
FROM fx_diff_files f LEFT JOIN (
  SELECT file_id, list(DISTINCT new_line ORDER BY new_line) AS lines FROM fx_changes
  WHERE op = 'add' GROUP BY 1) a ON a.file_id = f.file_id""")
def diff_report(spark, sf):
    return D.diff_report(X.diffs(spark, sf))


# --- filters -----------------------------------------------------------------

_PATTERNS = ("x_patterns", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{p}')" for i, p in enumerate(C.IGNORE_PATTERNS)) + ") AS t(pattern_no, pattern)")
_COVERS = """(p.pattern = f.path OR f.path GLOB p.pattern
  OR regexp_extract(f.path, '[^/]*$') GLOB p.pattern
  OR (contains(p.pattern, '**') AND starts_with(f.path, replace(p.pattern, '**', ''))))"""


@query("ignore_patterns", f"""
SELECT CAST(p.pattern_no AS BIGINT) AS pattern_no, p.pattern,
  CAST(count(f.path) AS BIGINT) AS paths_ignored
FROM x_patterns p LEFT JOIN fx_files f ON {_COVERS} GROUP BY ALL""", views=(_PATTERNS,))
def ignore_patterns(spark, sf):
    return L.pattern_usage(X.files(spark, sf).select("path"))


@query("ignored_paths", f"""
SELECT f.change_id, f.path, EXISTS (SELECT 1 FROM x_patterns p WHERE {_COVERS})
  OR f.path LIKE '%.md' AS ignored FROM fx_files f""", views=(_PATTERNS,))
def ignored_paths(spark, sf):
    return L.ignored_paths(X.files(spark, sf).select("change_id", "path"), extra=("*.md",))


@query("reviewable_files", """
SELECT change_id, file_no, path FROM fx_diff_files
WHERE kind IN ('edit', 'new') AND path NOT IN (SELECT path FROM fx_ignored)""")
def reviewable_files(spark, sf):
    return L.reviewable_files(D.diff_files(X.diffs(spark, sf), with_hunks=True)).select(
        "change_id", "file_no", "path")


@query("file_extension", r"""
SELECT change_id, path, lower(regexp_extract(path, '\.[^.]*$')) AS ext FROM fx_files""")
def file_extension(spark, sf):
    return X.files(spark, sf).select("change_id", "path", P.extension(F.col("path")).alias("ext"))


@query("language_of_path", r"""
SELECT change_id, path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN
  'javascript' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' END
  AS language FROM fx_files""")
def language_of_path(spark, sf):
    return X.files(spark, sf).select("change_id", "path", P.language(F.col("path")).alias("language"))


def _generated_lines(spark, sf):
    """Added lines straight from the generator, in the shape of changed_line_text."""
    return L.added_line_rows(X.change_rows(spark, sf))


@query("severity_at_least", """
SELECT change_id, path, line AS start_line, rule, severity FROM fx_rule_hits
WHERE severity IN ('major', 'critical')""")
def severity_at_least(spark, sf):
    return L.severity_at_least(R.rule_scan(_generated_lines(spark, sf)), "major").select(
        "change_id", "path", "start_line", "rule", "severity")


@query("changed_line_text", """
SELECT c.change_id, c.file_no, c.path, c.line, h.text
FROM (SELECT DISTINCT change_id, file_id % 20 AS file_no, path, new_line AS line FROM fx_changes
      WHERE op = 'add') c
JOIN fx_head_lines h ON h.change_id = c.change_id AND h.path = c.path AND h.line = c.line""")
def changed_line_text(spark, sf):
    files = D.diff_files(X.diffs(spark, sf), with_hunks=True)
    return L.changed_line_text(files, X.head_texts(spark, sf))


@query("changed_line_text_or_diff", """
SELECT change_id, file_id % 20 AS file_no, path, new_line AS line,
  CASE WHEN file_id % 3 <> 0 THEN line ELSE 'head ' || line END AS text
FROM fx_changes WHERE op = 'add'""")
def changed_line_text_or_diff(spark, sf):
    heads = X.head_texts(spark, sf).filter(F.col("file_id") % 3 == 0).select(
        "change_id", "path",
        F.concat(F.lit("head "), F.replace(F.col("content"), F.lit("\n"), F.lit("\nhead ")))
        .alias("content"))
    files = D.diff_files(X.diffs(spark, sf), with_hunks=True)
    return L.changed_line_text_or_diff(files, heads)


@query("valid_paths", r"""
SELECT url, regexp_matches(url, '^([^/]+/)*[^/]+$') AND NOT regexp_matches(url, '(^|/)\.\.?(/|$)')
  AND NOT regexp_matches(url, '[\x00-\x1f\x7f\\]') AS valid
FROM (SELECT url FROM pages UNION ALL SELECT substr(url, 8) FROM pages
      UNION ALL SELECT substr(url, 8) || '/../x' FROM pages
      UNION ALL SELECT substr(url, 8) || chr(9) FROM pages) t""")
def valid_paths(spark, sf):
    pages = X.table(spark, sf, "pages")
    short = F.substr("url", F.lit(8))
    urls = pages.select(F.explode(F.array(
        F.col("url"), short, F.concat(short, F.lit("/../x")), F.concat(short, F.lit("\t"))
    )).alias("url"))
    return L.valid_paths(urls.withColumnRenamed("url", "path")).withColumnRenamed("path", "url")


@query("contract_checks", """
SELECT s.repo_id, s.path, concat_ws(',',
  CASE WHEN NOT regexp_matches(s.repo_id, '^[a-z0-9_.-]+/[a-z0-9_.-]+$') OR length(s.repo_id) > 200
    THEN 'repo_id' END,
  CASE WHEN NOT regexp_matches(s.revision, '^[0-9a-f]{40}$') THEN 'revision' END,
  CASE WHEN s.path LIKE '%..%' THEN 'path' END,
  CASE WHEN s.path NOT LIKE '%.md' THEN 'path_extension' END,
  CASE WHEN length(s.content) > 40000 THEN 'content_length' END,
  CASE WHEN len(s.applies_to) > 16 THEN 'scope_count' END,
  CASE WHEN list_contains(s.applies_to, '/abs') THEN 'scope_path' END,
  CASE WHEN s.k < 1 OR s.k > 3 THEN 'k' END) AS failed
FROM x_sources s""", views=(("x_sources", """
SELECT CASE WHEN doc_id % 9 = 0 THEN 'Org/R' || doc_id ELSE 'org/r' || doc_id END AS repo_id,
  CASE WHEN doc_id % 8 = 0 THEN 'main' ELSE sha1(CAST(doc_id AS VARCHAR)) END AS revision,
  CASE WHEN doc_id % 7 = 0 THEN 'docs/../g' ELSE 'docs/g' END
    || CASE WHEN doc_id % 6 = 0 THEN '.txt' ELSE '.md' END AS path,
  text AS content, CASE WHEN doc_id % 5 = 0 THEN ['src', '/abs'] ELSE ['src'] END AS applies_to,
  doc_id % 5 AS k FROM documents"""),))
def contract_checks(spark, sf):
    d = F.col("doc_id")
    sources = X.documents(spark, sf).select(
        F.concat(F.when(d % 9 == 0, "Org/R").otherwise("org/r"), d.cast("string")).alias("repo_id"),
        F.when(d % 8 == 0, "main").otherwise(F.sha1(d.cast("string"))).alias("revision"),
        F.concat(F.when(d % 7 == 0, "docs/../g").otherwise("docs/g"),
                 F.when(d % 6 == 0, ".txt").otherwise(".md")).alias("path"),
        F.col("text").alias("content"),
        F.when(d % 5 == 0, F.array(F.lit("src"), F.lit("/abs"))).otherwise(F.array(F.lit("src")))
        .alias("applies_to"), (d % 5).alias("k"))
    return L.contract_checks(sources)


# --- rules -------------------------------------------------------------------


@query("rule_scan", """
SELECT change_id, file_no, path, line AS start_line, line AS end_line, rule_no, rule, severity,
  category, explanation,
  'Deterministic check ''' || rule || ''' matched on line ' || line || '.' AS reasoning,
  false AS can_generate_patch, CAST(NULL AS VARCHAR) AS replacement_code
FROM fx_rule_hits""")
def rule_scan(spark, sf):
    return R.rule_scan(L.added_line_rows(D.diff_changes(X.diffs(spark, sf))))


_RULE_KEYS = {
    "rule_api_key": "hardcoded-api-key", "rule_password": "hardcoded-password",
    "rule_eval": "eval-usage", "rule_exec": "exec-usage", "rule_sql_py": "sql-injection-python",
    "rule_sql_js": "sql-injection-js", "rule_bare_except": "bare-except",
    "rule_empty_catch": "empty-catch-js", "rule_console_log": "console-log",
    "rule_todo": "todo-fixme",
}


def _one_rule(rule_name):
    def run(spark, sf):
        return R.rule_scan(_generated_lines(spark, sf), rules=(R.rule_named(rule_name),)).select(
            "change_id", "path", "start_line", "rule", "severity", "category")
    return run


for _key, _name in _RULE_KEYS.items():
    query(_key, f"""
SELECT change_id, path, line AS start_line, rule, severity, category FROM fx_rule_hits
WHERE rule = '{_name}'""")(_one_rule(_name))


@query("fail_flag", """
SELECT change_id, CAST(coalesce(max(CASE WHEN severity IN ('critical', 'major') THEN 1 ELSE 0 END),
  0) AS BIGINT) AS exit_code
FROM (SELECT DISTINCT change_id FROM fx_files) LEFT JOIN fx_rule_hits USING (change_id)
GROUP BY change_id""")
def fail_flag(spark, sf):
    return R.fail_flag(R.rule_scan(_generated_lines(spark, sf)), X.files(spark, sf))
