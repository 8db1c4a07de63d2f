"""DuckDB SQL for the fixture tables. ``with_fixtures`` puts the needed ones in
front of a query."""

from __future__ import annotations

import re

from patchloom import constants as C

VIEWS: dict[str, str] = {}

VIEWS["fx_files"] = """
SELECT doc_id AS file_id, CAST(FLOOR(doc_id / 20) AS BIGINT) AS change_id,
  concat(CASE doc_id % 10 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'tests/test_' WHEN 2 THEN 'src/auth/'
           WHEN 3 THEN 'deploy/' ELSE 'src/' END,
         source, '_', CAST(doc_id AS STRING),
         CASE doc_id % 7 WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.go' WHEN 4 THEN '.min.js'
           WHEN 5 THEN '.md' ELSE '.py' END) AS path,
  CASE doc_id % 40 WHEN 7 THEN 'binary' WHEN 9 THEN 'deleted' WHEN 11 THEN 'rename' WHEN 13 THEN 'new'
    ELSE 'edit' END AS kind,
  text AS content
FROM documents"""

VIEWS["fx_raw"] = """
SELECT file_id, change_id, path, kind, CAST(i AS BIGINT) AS n, raw
FROM fx_files, unnest(string_split(content, chr(10))) WITH ORDINALITY AS t(raw, i)"""

VIEWS["fx_lines"] = """
SELECT file_id, change_id, path, kind, n,
  CASE (file_id + n) % 23
    WHEN 0 THEN concat('API_KEY = "', md5(raw), '"') WHEN 1 THEN 'password = "hunter2hunter2"'
    WHEN 2 THEN '    result = eval(x)' WHEN 3 THEN 'exec(code)'
    WHEN 4 THEN 'cursor.execute(f"SELECT {x}")' WHEN 5 THEN concat('db.query(`SELECT $', '{x}`)')
    WHEN 6 THEN 'except:' WHEN 7 THEN '} catch (e) { }' WHEN 8 THEN 'console.log(x)'
    WHEN 9 THEN '    # TODO: later' WHEN 10 THEN 'API_KEY = "test_placeholder_key_12345678"'
    WHEN 11 THEN 'def f(a, b):' WHEN 12 THEN 'import os' ELSE raw END AS line,
  CASE WHEN kind = 'new' THEN 'add' WHEN kind = 'deleted' THEN 'delete'
    WHEN n % 5 = 0 THEN 'delete' WHEN n % 3 = 0 THEN 'context' ELSE 'add' END AS op,
  CAST(CASE WHEN kind IN ('new', 'deleted') THEN 0 ELSE FLOOR((n - 1) / 12) END AS BIGINT) AS hunk_no
FROM fx_raw WHERE kind NOT IN ('binary', 'rename')"""

VIEWS["fx_changes"] = """
SELECT file_id, change_id, path, kind, hunk_no, n, op, line,
  CAST(1 + 3 * hunk_no
    + sum(CASE WHEN op <> 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - CASE WHEN op <> 'delete' THEN 1 ELSE 0 END AS BIGINT) AS new_line,
  CAST(CASE WHEN op = 'add' THEN NULL ELSE 3 * hunk_no
    + sum(CASE WHEN op <> 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS BIGINT) AS old_line
FROM fx_lines"""

# Paths as the diff shows them: a rename ends in '.moved'.
VIEWS["fx_diff_files"] = """
SELECT file_id, change_id, file_id % 20 AS file_no, kind, path AS gen_path,
  CASE WHEN kind = 'new' THEN NULL ELSE path END AS old_path,
  CASE WHEN kind = 'deleted' THEN NULL WHEN kind = 'rename' THEN path || '.moved' ELSE path END
    AS new_path,
  CASE WHEN kind = 'rename' THEN path || '.moved' ELSE path END AS path
FROM fx_files"""

VIEWS["fx_hunks"] = """
SELECT file_id, change_id, file_id % 20 AS file_no, path, kind, hunk_no,
  CAST(count(*) FILTER (op <> 'add') AS BIGINT) AS old_count,
  CAST(count(*) FILTER (op <> 'delete') AS BIGINT) AS new_count,
  arg_min(new_line, n) AS new_start,
  CAST(1 + 3 * hunk_no + coalesce(sum(count(*) FILTER (op <> 'add')) OVER (PARTITION BY file_id
    ORDER BY hunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS old_start,
  min(new_line) FILTER (op <> 'delete') AS lo, max(new_line) FILTER (op <> 'delete') AS hi,
  string_agg(CASE op WHEN 'add' THEN '+' WHEN 'delete' THEN '-' ELSE ' ' END || line, chr(10)
    ORDER BY n) AS body
FROM fx_changes GROUP BY file_id, change_id, path, kind, hunk_no"""

VIEWS["fx_ignored"] = """
SELECT DISTINCT path FROM fx_files
WHERE regexp_matches(path, '(\\.min\\.js$|^node_modules/)')"""

VIEWS["fx_head_lines"] = """
SELECT c.file_id, c.change_id, c.path, s.line, coalesce(l.line, '') AS text
FROM (SELECT file_id, change_id, path, max(new_line) AS top FROM fx_changes
      WHERE op <> 'delete' GROUP BY ALL) c
CROSS JOIN LATERAL (SELECT unnest(range(1, c.top + 1)) AS line) s
LEFT JOIN (SELECT file_id, new_line, line FROM fx_changes WHERE op <> 'delete') l
  ON l.file_id = c.file_id AND l.new_line = s.line"""

VIEWS["fx_head"] = """
SELECT file_id, change_id, path, string_agg(text, chr(10) ORDER BY line) AS content
FROM fx_head_lines GROUP BY ALL"""

VIEWS["fx_functions"] = """
SELECT change_id, path, i AS fn_no, 'f' || i AS name, 10 * i + 1 AS start_line,
  10 * i + 6 AS end_line, '(a, b)' AS parameters,
  CASE WHEN i % 3 = 0 THEN 'int' END AS return_type,
  CASE WHEN i % 4 = 0 THEN 'Doc ' || i END AS docstring, i % 2 = 1 AS is_method,
  i % 5 = 0 AS is_async, CASE WHEN i % 2 = 1 THEN 'K' END AS class_name,
  CASE WHEN i % 6 = 0 THEN '@cached' || chr(10) || '@retry(2)' || chr(10) ELSE '' END
    || CASE WHEN i % 5 = 0 THEN 'async ' ELSE '' END || 'def '
    || CASE WHEN i % 2 = 1 THEN 'K.' ELSE '' END || 'f' || i || '(a, b)'
    || CASE WHEN i % 3 = 0 THEN ' -> int' ELSE '' END AS signature
FROM (SELECT change_id, path, unnest(range(0,
  CAST(ceil(len(string_split(content, chr(10))) / 10.0) AS BIGINT))) AS i FROM fx_files) t"""

# Skeletons, and the changed lines of each function that has any.
VIEWS["fx_fn"] = """
SELECT f.*, signature || CASE WHEN docstring IS NOT NULL THEN ':' || chr(10) || '    \"\"\"'
  || docstring || '\"\"\"' ELSE ': ...' END AS skeleton,
  (SELECT list(DISTINCT new_line ORDER BY new_line) FROM fx_changes c WHERE c.op = 'add'
    AND c.change_id = f.change_id AND c.path = f.path
    AND c.new_line BETWEEN f.start_line AND f.end_line) AS touched
FROM fx_functions f"""

VIEWS["fx_fn_source"] = """
SELECT change_id, path, fn_no, coalesce(string_agg(printf('%4d | %s', line, text), chr(10)
  ORDER BY line) FILTER (line < last OR text <> ''), '') AS src
FROM (SELECT f.change_id, f.path, f.fn_no, h.line, h.text,
    max(h.line) OVER (PARTITION BY f.change_id, f.path, f.fn_no) AS last
  FROM fx_functions f JOIN fx_head_lines h ON h.change_id = f.change_id AND h.path = f.path
    AND h.line BETWEEN f.start_line AND f.end_line) t
GROUP BY change_id, path, fn_no"""

VIEWS["fx_fn_block"] = """
SELECT f.change_id, f.path, f.fn_no, f.signature, chr(10) || '#### `' || f.name || '` (lines '
  || f.start_line || '-' || f.end_line || ', changed: [' || array_to_string(f.touched, ', ')
  || '])' || chr(10) || '```' || chr(10) || coalesce(s.src, '') || chr(10) || '```' AS block
FROM fx_fn f LEFT JOIN fx_fn_source s
  ON s.change_id = f.change_id AND s.path = f.path AND s.fn_no = f.fn_no
WHERE f.touched IS NOT NULL
  AND EXISTS (SELECT 1 FROM fx_head h WHERE h.change_id = f.change_id AND h.path = f.path)"""


def _q(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


VIEWS["fx_rules"] = "SELECT * FROM (VALUES " + ", ".join(
    "({}, {}, {}, {}, {}, {}, {}, {})".format(
        i, _q(name), _q(pattern), _q(sev), _q(cat), _q(expl),
        "NULL" if ext is None else "[" + ", ".join(map(_q, ext)) + "]", _q(neg))
    for i, (name, pattern, sev, cat, expl, ext, neg) in enumerate(C.RULE_ROWS)
) + ") AS t(rule_no, rule, pattern, severity, category, explanation, exts, neg)"

VIEWS["fx_rule_hits"] = r"""
SELECT c.file_id, c.change_id, c.file_id % 20 AS file_no, c.path, c.new_line AS line,
  CAST(r.rule_no AS BIGINT) AS rule_no, r.rule, r.severity, r.category, r.explanation
FROM fx_changes c JOIN fx_rules r
  ON (r.exts IS NULL OR list_contains(r.exts, lower(regexp_extract(c.path, '\.[^.]*$'))))
  AND regexp_matches(c.line, r.pattern)
  AND (r.neg IS NULL OR NOT regexp_matches(c.line, r.neg))
WHERE c.op = 'add'"""


def with_fixtures(sql: str, *extra: tuple[str, str]) -> str:
    """The query behind a WITH of every fixture it needs, directly or not."""
    local = dict(extra)
    known = {**VIEWS, **local}
    order: list[str] = []

    opened: set[str] = set()

    def visit(text):
        for name in re.findall(r"\bfx_\w+|\bx_\w+", text):
            if name in known and name not in opened:
                opened.add(name)
                visit(known[name])
                order.append(name)
    visit(sql)
    recursive = "RECURSIVE " if any("UNION ALL" in known[n] for n in order) else ""
    if not order:
        return sql
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({known[n]})" for n in order) + "\n" + sql
