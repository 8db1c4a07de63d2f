"""Symbols, contexts, budgets, routing and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.catalog import fixtures as X
from patchloom.catalog.finding_queries import sql_text
from patchloom.catalog.registry import query
from patchloom.functions import paths as P
from patchloom.functions import text as T
from patchloom.operators import budget as B
from patchloom.operators import context as K
from patchloom.operators import diff as D
from patchloom.operators import findings as N
from patchloom.operators import patches as H
from patchloom.operators import routing as G
from patchloom.operators import symbols as S

# --- symbols -----------------------------------------------------------------

_CODE = ("x_code", """
SELECT CAST(floor(doc_id / 20) AS BIGINT) AS change_id, doc_id,
  'src/c' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' WHEN doc_id % 4 = 1 THEN '.js'
    ELSE '.ts' END AS path,
  unnest(range(0, CAST(ceil(len(string_split(text, chr(10))) / 10.0) AS BIGINT))) AS i
FROM documents""")
_PY_FN = ("x_py_fn", """
SELECT change_id, path, u.name, u.s + 33 * i AS start_line, u.e + 33 * i AS end_line,
  u.parameters, u.return_type, u.docstring, u.is_method, u.is_async, u.class_name, u.decorators
FROM (SELECT *, unnest([
  {name: 'f' || i, s: 3, e: 17, parameters: '(a, b=(1, 2))', return_type: 'int',
   docstring: 'Doc ' || i || '.', is_method: false, is_async: true, class_name: NULL,
   decorators: 'cached|retry(2)'},
  {name: 'm' || i, s: 21, e: 22, parameters: '(self)', return_type: NULL, docstring: NULL,
   is_method: true, is_async: false, class_name: 'C' || i, decorators: ''},
  {name: 'deep', s: 24, e: 24, parameters: '(self)', return_type: NULL, docstring: NULL,
   is_method: true, is_async: false, class_name: 'Inner' || i, decorators: ''},
  {name: 'w' || i, s: 25, e: 32, parameters: '(' || chr(10) || '    a=((((((1)))))),' || chr(10)
     || ')', return_type: 'int', docstring: NULL, is_method: false, is_async: false,
   class_name: NULL, decorators: ''}]) AS u
  FROM x_code WHERE doc_id % 2 = 0) t""")
_PY_CLASS = ("x_py_class", """
SELECT change_id, path, u.name, u.s + 33 * i AS start_line, 24 + 33 * i AS end_line,
  u.base_classes, u.docstring
FROM (SELECT *, unnest([
  {name: 'C' || i, s: 19, base_classes: 'Base|pkg.Mixin', docstring: 'Class ' || i},
  {name: 'Inner' || i, s: 23, base_classes: '', docstring: NULL}]) AS u
  FROM x_code WHERE doc_id % 2 = 0) t""")
_JS_FN = ("x_js_fn", """
SELECT change_id, path, u.name, u.s + 33 * i AS start_line, u.e + 33 * i AS end_line,
  u.parameters, CAST(NULL AS VARCHAR) AS return_type, u.docstring, u.is_method, u.is_async,
  u.class_name, '' AS decorators
FROM (SELECT *, unnest([
  {name: 'g' || i, s: 5, e: 8, parameters: '(a, b)', docstring: 'Adds ' || i || '.',
   is_method: false, is_async: false, class_name: NULL},
  {name: 'h' || i, s: 9, e: 9, parameters: '(x)', docstring: NULL, is_method: false,
   is_async: true, class_name: NULL},
  {name: 'run', s: 12, e: 14, parameters: '(x)', docstring: 'Runs.', is_method: true,
   is_async: false, class_name: 'K' || i},
  {name: 't' || i, s: 26, e: 30, parameters: '(' || chr(10) || '  a = ((((((1)))))),' || chr(10)
     || ')', docstring: NULL, is_method: false, is_async: false, class_name: NULL},
  {name: 'go', s: 33, e: 33, parameters: '()', docstring: NULL, is_method: true, is_async: false,
   class_name: 'Z' || i}]) AS u
  FROM x_code WHERE doc_id % 2 = 1) t""")
_JS_CLASS = ("x_js_class", """
SELECT change_id, path, u.name, u.s + 33 * i AS start_line, u.e + 33 * i AS end_line,
  u.base_classes, CAST(NULL AS VARCHAR) AS docstring
FROM (SELECT *, unnest([
  {name: 'K' || i, s: 10, e: 15, base_classes: CASE WHEN path LIKE '%.js' THEN 'Base' ELSE '' END},
  {name: 'Z' || i, s: 31, e: 33, base_classes: ''}]) AS u
  FROM x_code WHERE doc_id % 2 = 1) t""")
_SYMBOLS = (_CODE, _PY_FN, _PY_CLASS, _JS_FN, _JS_CLASS)


def flat(df, column):
    return df.withColumn(column, F.array_join(column, "|"))


@query("py_functions", "SELECT * FROM x_py_fn", views=_SYMBOLS)
def py_functions(spark, sf):
    return flat(S.functions_of(S.py_outline(S.py_statements(X.code(spark, sf)))).drop("fn_no"), "decorators")


@query("py_classes", "SELECT * FROM x_py_class", views=_SYMBOLS)
def py_classes(spark, sf):
    return flat(S.classes_of(S.py_outline(S.py_statements(X.code(spark, sf)))), "base_classes")


@query("class_methods", """
SELECT f.change_id, f.path, f.class_name, f.name, f.start_line, min(c.start_line) AS class_line
FROM (SELECT * FROM x_py_fn UNION ALL SELECT * FROM x_js_fn) f
JOIN (SELECT * FROM x_py_class UNION ALL SELECT * FROM x_js_class) c
  ON c.change_id = f.change_id AND c.path = f.path AND c.name = f.class_name
GROUP BY ALL""", views=_SYMBOLS)
def class_methods(spark, sf):
    return S.class_methods(S.outline(X.code(spark, sf))).select(
        "change_id", "path", "class_name", "name", "start_line", "class_line")


@query("py_imports", """
SELECT change_id, path, 33 * i + 1 AS seq, 'import mod' || i AS import_text FROM x_code
WHERE doc_id % 2 = 0""", views=_SYMBOLS)
def py_imports(spark, sf):
    return S.imports_of(S.py_outline(S.py_statements(X.code(spark, sf))))


@query("js_functions", "SELECT * FROM x_js_fn", views=_SYMBOLS)
def js_functions(spark, sf):
    return flat(S.functions_of(S.js_outline(S.js_statements(X.code(spark, sf)))).drop("fn_no"), "decorators")


@query("js_classes", "SELECT * FROM x_js_class", views=_SYMBOLS)
def js_classes(spark, sf):
    return flat(S.classes_of(S.js_outline(S.js_statements(X.code(spark, sf)))), "base_classes")


@query("js_imports", """
SELECT change_id, path, i AS seq, 'import { a' || i || ' } from ''m' || i || ''';' AS import_text
FROM x_code WHERE doc_id % 2 = 1""", views=_SYMBOLS)
def js_imports(spark, sf):
    return S.imports_of(S.js_outline(S.js_statements(X.code(spark, sf))))


@query("symbols", """
SELECT change_id, path, 'function' AS kind, name, start_line, end_line FROM x_py_fn
UNION ALL SELECT change_id, path, 'function', name, start_line, end_line FROM x_js_fn
UNION ALL SELECT change_id, path, 'class', name, start_line, end_line FROM x_py_class
UNION ALL SELECT change_id, path, 'class', name, start_line, end_line FROM x_js_class
UNION ALL SELECT change_id, path, 'import', CASE WHEN doc_id % 2 = 0 THEN 'import mod' || i
  ELSE 'import { a' || i || ' } from ''m' || i || ''';' END, NULL, NULL FROM x_code""",
       views=_SYMBOLS)
def symbols(spark, sf):
    return S.symbols(S.outline(X.code(spark, sf)))


@query("symbol_report", """
SELECT change_id, path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN
  'javascript' ELSE 'typescript' END AS language,
  CASE WHEN path LIKE '%.py' THEN 4 ELSE 5 END * count(*) AS functions,
  2 * count(*) AS methods, count(*) AS async_functions, 2 * count(*) AS classes,
  count(*) AS imports FROM x_code GROUP BY change_id, path""", views=_SYMBOLS)
def symbol_report(spark, sf):
    code = X.code(spark, sf)
    return S.symbol_report(code, S.outline(code))


@query("function_signature", "SELECT change_id, path, fn_no, signature FROM fx_functions")
def function_signature(spark, sf):
    return X.functions(spark, sf).select(
        "change_id", "path", "fn_no", K.function_signature().alias("signature"))


@query("function_skeleton", "SELECT change_id, path, fn_no, skeleton FROM fx_fn")
def function_skeleton(spark, sf):
    return X.functions(spark, sf).select(
        "change_id", "path", "fn_no", K.function_skeleton().alias("skeleton"))


@query("functions_in_range", """
SELECT f.change_id, f.path, f.fn_no, h.hunk_no FROM fx_functions f JOIN fx_hunks h
  ON h.change_id = f.change_id AND h.path = f.path
  AND NOT (f.end_line < coalesce(h.lo, h.new_start) OR f.start_line > coalesce(h.hi, h.new_start))
""")
def functions_in_range(spark, sf):
    ranges = D.hunk_line_range(X.diffs(spark, sf))
    return K.functions_in_range(X.functions(spark, sf), ranges).select(
        "change_id", "path", "fn_no", "hunk_no")


def added(spark, sf):
    return D.changed_lines(X.change_rows(spark, sf))


@query("modified_functions", """
SELECT change_id, path, fn_no, name, array_to_string(touched, ',') AS changed_lines
FROM fx_fn WHERE touched IS NOT NULL""")
def modified_functions(spark, sf):
    found = K.modified_functions(X.functions(spark, sf), added(spark, sf))
    return found.select("change_id", "path", "fn_no", "name", F.array_join(
        F.col("changed_lines").cast("array<string>"), ",").alias("changed_lines"))


@query("unmodified_functions", "SELECT change_id, path, fn_no FROM fx_fn WHERE touched IS NULL")
def unmodified_functions(spark, sf):
    return K.unmodified_functions(X.functions(spark, sf), added(spark, sf)).select(
        "change_id", "path", "fn_no")


# --- contexts and prompts ----------------------------------------------------


@query("numbered_lines", """
SELECT doc_id, string_agg(printf('%4d | %s', doc_id * 7 + n - 1, line), chr(10) ORDER BY n)
  AS numbered
FROM (SELECT doc_id, line, CAST(i AS BIGINT) AS n FROM documents,
  unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, i)) t GROUP BY doc_id""")
def numbered_lines(spark, sf):
    return X.documents(spark, sf).select("doc_id", K.numbered_lines(
        F.col("text"), F.col("doc_id") * 7).alias("numbered"))


@query("function_context", "SELECT change_id, path, fn_no, signature, block FROM fx_fn_block")
def function_context(spark, sf):
    return K.function_context(X.functions(spark, sf), added(spark, sf), X.head_texts(spark, sf))


@query("skeleton_context", """
SELECT change_id, path, fn_no, skeleton FROM fx_fn WHERE touched IS NULL""")
def skeleton_context(spark, sf):
    return K.skeleton_context(X.functions(spark, sf), added(spark, sf))


def planted_imports(spark, sf):
    lines = X.head_texts(spark, sf).select(
        "change_id", "path", F.posexplode(F.split("content", "\n")).alias("p", "x"))
    return lines.filter(F.col("x") == "import os").select(
        "change_id", "path", (F.col("p") + 1).cast("bigint").alias("seq"),
        F.col("x").alias("import_text"))


_CONTEXT = """
SELECT f.change_id, f.file_no, f.path, concat_ws(chr(10),
  '## File: ' || f.path || ' (' || CASE WHEN f.path LIKE '%.py' THEN 'python' WHEN f.path LIKE
    '%.js' THEN 'javascript' ELSE 'typescript' END || ')',
  (SELECT chr(10) || '### Imports' || chr(10) || string_agg(text, chr(10)) FROM fx_head_lines h
    WHERE h.change_id = f.change_id AND h.path = f.path AND h.text = 'import os'),
  (SELECT chr(10) || '### Modified Functions (REVIEW THESE)' || chr(10)
    || string_agg(block, chr(10) ORDER BY fn_no) FROM fx_fn_block b
    WHERE b.change_id = f.change_id AND b.path = f.path),
  (SELECT chr(10) || '### Dependency Context (signatures only, DO NOT review)' || chr(10)
    || string_agg(skeleton, chr(10) ORDER BY fn_no) FROM fx_fn b
    WHERE b.change_id = f.change_id AND b.path = f.path AND b.touched IS NULL),
  (SELECT chr(10) || '### Diff Hunks' || chr(10) || string_agg('```diff' || chr(10) || body
    || chr(10) || '```', chr(10) ORDER BY hunk_no) FROM fx_hunks u
    WHERE u.change_id = f.change_id AND u.path = f.path)) AS context_text
FROM fx_diff_files f JOIN fx_head h ON h.change_id = f.change_id AND h.path = f.path
WHERE regexp_matches(f.path, '\\.(py|js|ts)$')"""


@query("file_context", _CONTEXT)
def file_context(spark, sf):
    return K.file_context(
        D.diff_files(X.diffs(spark, sf), with_hunks=True), X.head_texts(spark, sf),
        X.functions(spark, sf), planted_imports(spark, sf), added(spark, sf))


_CHANGES = ("x_changes", """
SELECT change_id, CASE WHEN change_id % 3 = 0 THEN '' ELSE 'Change ' || change_id END AS title,
  repeat('wörd ', CAST(change_id % 200 + change_id % 2 * 90 AS BIGINT)) AS body
FROM (SELECT DISTINCT change_id FROM fx_files) t""")


def change_texts(spark, sf):
    c = F.col("change_id")
    return X.files(spark, sf).select(c).distinct().select(
        c, F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("Change "), c.cast("string")))
        .alias("title"),
        F.repeat(F.lit("wörd "), (c % 200 + c % 2 * 90).cast("int")).alias("body"))


@query("review_prompt", f"""
SELECT change_id, CAST(k AS BIGINT) AS part_no, CAST(ceil(length(prompt) / {K.PROMPT_PART_CHARS}.0)
    AS BIGINT) AS parts,
  substr(prompt, CAST(k * {K.PROMPT_PART_CHARS} + 1 AS BIGINT), {K.PROMPT_PART_CHARS}) AS prompt
FROM (SELECT *, unnest(range(CAST(ceil(length(prompt) / {K.PROMPT_PART_CHARS}.0) AS BIGINT))) AS k FROM (
SELECT c.change_id, CASE WHEN title <> '' THEN '## Pull Request: ' || title || chr(10) ELSE '' END
  || CASE WHEN body <> '' THEN chr(10) || CASE WHEN length(body) > 500 THEN substr(body, 1, 500)
    || '...' ELSE body END || chr(10) || chr(10) ELSE '' END
  || '## Code Changes to Review' || chr(10) || chr(10)
  || (SELECT string_agg(content, chr(10) || '---' || chr(10) ORDER BY file_id) FROM fx_files f
    WHERE f.change_id = c.change_id) || chr(10) || {sql_text(C.REVIEW_INSTRUCTIONS)} AS prompt
FROM x_changes c))""", views=(_CHANGES,))
def review_prompt(spark, sf):
    contexts = X.contexts(spark, sf).withColumnRenamed("seq", "file_no")
    return K.review_prompt(contexts, change_texts(spark, sf))


_ASCII = """list_aggregate(list_transform(string_split(CAST(to_json({0}) AS VARCHAR), ''),
  lambda c: CASE WHEN unicode(c) > 127 THEN printf('\\u%04x', unicode(c)) ELSE c END),
  'string_agg', '')"""


@query("chat_messages", f"""
SELECT p.change_id, CAST(k AS BIGINT) AS seq, CASE k WHEN 0 THEN 'system' ELSE 'user' END AS role,
  CASE WHEN k = 0 THEN {sql_text(C.SYSTEM_PROMPT + chr(10) * 2 + C.REVIEW_EXAMPLE)}
    || CASE WHEN data IS NOT NULL THEN {sql_text(C.GUIDANCE_INSTRUCTIONS)} ELSE '' END
  ELSE 'P' || p.change_id || coalesce({sql_text(C.GUIDANCE_DATA_HEADING)} || data, '') END
  AS content
FROM (SELECT DISTINCT change_id FROM fx_files) p LEFT JOIN (
  SELECT change_id, '[' || string_agg('{{"changed_path": ' || {_ASCII.format('path')}
    || ', "id": "g' || file_id || '", "excerpt": ' || {_ASCII.format("'😀' || content")
      .replace("printf('", "CASE WHEN c = '😀' THEN '\\ud83d\\ude00' ELSE printf('")
      .replace("unicode(c)) ELSE", "unicode(c)) END ELSE")}
    || '}}', ', ' ORDER BY file_id) || ']' AS data
  FROM fx_files WHERE change_id % 3 <> 0 GROUP BY 1) d
  ON d.change_id = p.change_id, (SELECT unnest([0, 1]) AS k) k""")
def chat_messages(spark, sf):
    f = X.files(spark, sf)
    prompts = f.select("change_id").distinct().withColumn(
        "prompt", F.concat(F.lit("P"), F.col("change_id").cast("string")))
    matches = f.filter(F.col("change_id") % 3 != 0).select(
        "change_id", F.col("file_id").alias("seq"), F.col("path").alias("changed_path"),
        F.concat(F.lit("g"), F.col("file_id").cast("string")).alias("source_id"),
        F.concat(F.lit("😀"), F.col("content")).alias("excerpt"))
    return K.chat_messages(prompts, matches)


@query("repair_prompt", f"""
SELECT conv_id, turn, {sql_text(C.REPAIR_PIECES[0])} || role || '.py' || {sql_text(C.REPAIR_PIECES[1])}
  || md5(text) || {sql_text(C.REPAIR_PIECES[2])} || role || {sql_text(C.REPAIR_PIECES[3])}
  || substr(repeat(text, 9), 1, 2000) || {sql_text(C.REPAIR_PIECES[4])} AS prompt
FROM conversations""")
def repair_prompt(spark, sf):
    return X.table(spark, sf, "conversations").select("conv_id", "turn", K.repair_prompt(
        F.md5("text"), F.col("role"), F.repeat("text", F.lit(9)),
        F.concat("role", F.lit(".py"))).alias("prompt"))


@query("strip_code_fence", """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text
  WHEN 2 THEN '```' || chr(10) || 'x' END AS stripped
FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9)) AS text FROM conversations) t""")
def strip_code_fence(spark, sf):
    t = T.strip(F.col("text"))
    answer = (F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" \n```py\n"), t, F.lit("\n```\n ")))
              .when(F.col("turn") % 4 == 1, F.concat(t, F.lit("  ")))
              .when(F.col("turn") % 4 == 2, F.lit(" ```\nx")).otherwise(""))
    return X.table(spark, sf, "conversations").select(
        "conv_id", "turn", K.strip_code_fence(answer).alias("stripped"))


@query("model_string", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'm' || event_type ELSE
  (['', 'anthropic/', 'gemini/'])[event_id % 3 + 1] || 'm' || event_type END AS model
FROM events""")
def model_string(spark, sf):
    e = F.col("event_id")
    provider = F.element_at(F.array(F.lit("OpenAI"), F.lit("Anthropic"), F.lit("gemini")),
                            (e % 3 + 1).cast("int"))
    return X.table(spark, sf, "events").select(
        "event_id", K.model_string(provider, F.concat(F.lit("m"), "event_type")).alias("model"))


# --- token budget ------------------------------------------------------------


@query("estimate_tokens", """
SELECT doc_id, CAST(floor(length(text) / 3.5) AS BIGINT) + 10 AS tokens FROM documents""")
def estimate_tokens(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("context_tokens", """
SELECT doc_id, CAST(floor(length(text) / 3.5) AS BIGINT) AS tokens FROM documents""")
def context_tokens(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.context_tokens(F.col("text")).alias("tokens"))


_PRIORITY = ("x_sized", """
SELECT change_id, file_id AS seq, path, content,
  CAST(floor(length(content) / 3.5) AS BIGINT) AS tokens,
  CAST(CASE WHEN regexp_matches(lower(path), 'auth|login|crypto|jwt|token|secret|sql') THEN 10
    ELSE 0 END
  + CASE WHEN regexp_matches(lower(path), 'test_|_test\\.|\\.test\\.|spec\\.|/tests/|/__tests__/')
    THEN 0 ELSE 5 END
  - CASE WHEN regexp_matches(lower(path), 'docker|ci|deploy|helm|terraform|\\.yml|\\.yaml') THEN 3
    ELSE 0 END AS BIGINT) AS priority FROM fx_files""")
_RANKED = ("x_ranked", """
SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY priority DESC, seq) AS rn
FROM x_sized""")
_PACK = ("x_pack", """
SELECT change_id, rn, tokens AS used, CAST(0 AS BIGINT) AS chunk_no FROM x_ranked WHERE rn = 1
UNION ALL
SELECT r.change_id, r.rn, CASE WHEN p.used + r.tokens <= 10500 THEN p.used + r.tokens
  ELSE r.tokens END, p.chunk_no + CASE WHEN p.used + r.tokens <= 10500 THEN 0 ELSE 1 END
FROM x_pack p JOIN x_ranked r ON r.change_id = p.change_id AND r.rn = p.rn + 1""")
_PACKED = ("x_packed", """
SELECT r.*, p.chunk_no FROM x_ranked r JOIN x_pack p ON p.change_id = r.change_id AND p.rn = r.rn""")


@query("file_priority", "SELECT change_id, seq, path, priority, rn AS position FROM x_ranked",
       views=(_PRIORITY, _RANKED))
def file_priority(spark, sf):
    from patchloom.functions.ranking import bucketed_row_number
    sized = B.file_priority(X.contexts(spark, sf)).select("change_id", "seq", "path", "priority")
    # Position: files of higher priority, plus the rank inside the own priority.
    from pyspark.sql import Window
    above = Window.partitionBy("change_id").orderBy(F.desc("priority")).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sized.groupBy("change_id", "priority").agg(F.count("*").alias("n")).select(
        "change_id", "priority", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("offset"))
    ranked = bucketed_row_number(sized, ["change_id", "priority"], "seq", "rank")
    return ranked.join(offsets, ["change_id", "priority"]).select(
        "change_id", "seq", "path", "priority", (F.col("rank") + F.col("offset")).alias("position"))


@query("pack_chunks", "SELECT change_id, seq, path, tokens, priority, chunk_no FROM x_packed",
       views=(_PRIORITY, _RANKED, _PACK, _PACKED))
def pack_chunks(spark, sf):
    return B.pack_chunks(X.contexts(spark, sf))


def _cut(text, limit):
    """Truncation in SQL: ``text`` to ``limit`` characters."""
    def last(s, m):
        n = len(m)
        lit = sql_text(m)
        return (f"(CASE WHEN contains({s}, {lit}) THEN length({s}) - strpos(reverse({s}), "
                f"reverse({lit})) - {n} + 1 ELSE -1 END)")
    marks = " ".join(f"WHEN {last('b', m)} > lim * 0.6 THEN substr(b, 1, {last('b', m)} + {len(m)})"
                     for m in C.TRUNCATION_MARKERS)
    nl = last("a", "\n")
    return f"""(SELECT CASE WHEN length(t) <= lim THEN t ELSE CASE {marks} ELSE b END
      || {sql_text(C.TRUNCATION_NOTICE)} END
    FROM (SELECT t, lim, CASE WHEN {nl} > lim * 0.8 THEN substr(a, 1, {nl}) ELSE a END AS b
      FROM (SELECT {text} AS t, {limit} AS lim, substr({text}, 1, {limit}) AS a)))"""


@query("truncate_context", f"""
SELECT doc_id, {_cut("x", "lim0")} AS cut FROM (SELECT doc_id,
  replace(text, '. ', '.' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '## ' WHEN 1 THEN '### '
    ELSE '' END) AS x, doc_id % 2000 + 100 AS lim0 FROM documents) d""")
def truncate_context(spark, sf):
    d = F.col("doc_id")
    mark = F.when(d % 3 == 0, ".\n## ").when(d % 3 == 1, ".\n### ").otherwise(".\n")
    return X.documents(spark, sf).select("doc_id", B.truncate_context(
        F.replace(F.col("text"), F.lit(". "), mark), d % 2000 + 100).alias("cut"))


@query("prompt_chunks", f"""
SELECT change_id, seq, path, chunk_no, {_cut("content", "lim0")} AS context_text
FROM (SELECT *, 36750 // count(*) OVER (PARTITION BY change_id, chunk_no) AS lim0 FROM x_packed) p
""", views=(_PRIORITY, _RANKED, _PACK, _PACKED))
def prompt_chunks(spark, sf):
    return B.prompt_chunks(X.contexts(spark, sf))


# --- routing -----------------------------------------------------------------

_SECURITY = "regexp_matches(lower(path), '" + "|".join(C.ROUTING_SECURITY_WORDS) + "')"
_TEST = "regexp_matches(lower(path), '" + "|".join(
    w.replace(".", "\\.") for w in C.ROUTING_TEST_MARKERS) + "')"


@query("security_sensitive", f"SELECT file_id, {_SECURITY} AS is_security FROM fx_files")
def security_sensitive(spark, sf):
    return X.files(spark, sf).select(
        "file_id", P.security_sensitive(F.col("path")).alias("is_security"))


@query("test_file", f"SELECT file_id, {_TEST} AS is_test FROM fx_files")
def test_file(spark, sf):
    return X.files(spark, sf).select("file_id", P.is_test_file(F.col("path")).alias("is_test"))


_ROUTED = ("x_routed", f"""
SELECT *, CASE WHEN is_test THEN 'fast' WHEN is_security THEN CASE WHEN changed_line_count <= 200
    THEN 'standard' ELSE 'deep' END
  WHEN changed_line_count > 200 OR function_count > 5 THEN 'deep'
  WHEN changed_line_count > 50 OR function_count > 2 THEN 'standard' ELSE 'fast' END AS tier
FROM (SELECT change_id, path, {_SECURITY} AS is_security, {_TEST} AS is_test,
  (SELECT count(DISTINCT new_line) FROM fx_changes c WHERE c.op = 'add' AND c.file_id = f.file_id)
    AS changed_line_count,
  (SELECT count(*) FROM fx_fn n WHERE n.change_id = f.change_id AND n.path = f.path
    AND n.touched IS NOT NULL) AS function_count FROM fx_files f) t""")


def routed(spark, sf):
    lines = added(spark, sf)
    counts = lines.groupBy("change_id", "path").agg(F.count("*").alias("changed_line_count"))
    fns = K.changed_in_functions(X.functions(spark, sf), lines).select(
        *K.FUNCTION_KEY).distinct().groupBy("change_id", "path").agg(
        F.count("*").alias("function_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return G.assess_complexity(
        X.files(spark, sf).select("change_id", "path").join(
            counts, ["change_id", "path"], "left").join(fns, ["change_id", "path"], "left").select(
            "change_id", "path", zero("changed_line_count"), zero("function_count")))


@query("assess_complexity", "SELECT * FROM x_routed", views=(_ROUTED,))
def assess_complexity(spark, sf):
    return routed(spark, sf)


_TIERED = ("x_tiered", """
SELECT *, CASE WHEN tier = 'deep' THEN 'mini' ELSE tier END AS tier_name,
  CASE WHEN tier = 'standard' THEN 4096 ELSE 2048 END AS max_tokens FROM (
  SELECT change_id, path, tier, changed_line_count FROM x_routed) t""")


@query("tier_for_file", """
SELECT change_id, path, tier, tier AS tier_name, 'openai' AS provider,
  CASE tier WHEN 'fast' THEN 'gpt-4o-mini' ELSE 'gpt-4o' END AS model,
  CAST(CASE tier WHEN 'fast' THEN 2048 WHEN 'standard' THEN 4096 ELSE 8192 END AS BIGINT)
    AS max_tokens,
  CAST(CASE tier WHEN 'deep' THEN 0.05 ELSE 0.1 END AS DOUBLE) AS temperature,
  CAST(CASE tier WHEN 'fast' THEN 50 WHEN 'standard' THEN 200 ELSE 999999 END AS BIGINT)
    AS max_context_lines FROM x_routed""", views=(_ROUTED,))
def tier_for_file(spark, sf):
    return G.tier_for_file(routed(spark, sf).select("change_id", "path", "tier"))


@query("tier_groups", """
SELECT change_id, tier_name, path, count(*) OVER w AS file_count,
  CAST(sum(changed_line_count) OVER w AS BIGINT) AS total_changed_lines
FROM (SELECT *, CASE tier WHEN 'deep' THEN 'fast' ELSE tier END AS tier_name FROM x_routed) t
WINDOW w AS (PARTITION BY change_id, tier_name)""", views=(_ROUTED,))
def tier_groups(spark, sf):
    """Without a deep tier its files fall back to the first one."""
    tiered = G.tier_for_file(routed(spark, sf), tiers=C.TIERS[:2])
    return G.tier_groups(tiered).select(
        "change_id", "tier_name", "path", "file_count", "total_changed_lines")


# --- patches and verification ------------------------------------------------

_PATCHES = ("x_patches", """
SELECT p.*, h.content, CASE WHEN h.content IS NOT NULL THEN string_split(h.content, chr(10)) END AS ls,
  CASE WHEN h.content = '' THEN 0 ELSE len(string_split(h.content, chr(10)))
    - CASE WHEN suffix(h.content, chr(10)) THEN 1 ELSE 0 END END AS n
FROM (SELECT change_id, file_id AS seq, path || CASE WHEN file_id % 19 = 0 THEN '.gone' ELSE '' END
    AS path, file_id % 12 AS start_line, file_id % 12 + file_id % 4 - 1 AS end_line,
    CASE WHEN file_id % 5 <> 0 THEN 'new_' || file_id || CASE WHEN file_id % 2 = 0
      THEN chr(10) || 'more' ELSE chr(10) END END AS replacement_code FROM fx_files) p
LEFT JOIN fx_head h ON h.change_id = p.change_id AND h.path = p.path""")


@query("apply_patches", """
SELECT change_id, seq, path, status, CASE WHEN status = 'applied' THEN
  array_to_string(ls[1:start_line - 1], chr(10)) || CASE WHEN start_line > 1 THEN chr(10) ELSE ''
  END || replacement_code || CASE WHEN suffix(replacement_code, chr(10)) THEN '' ELSE chr(10) END
  || array_to_string(ls[end_line + 1:], chr(10)) END AS content
FROM (SELECT *, CASE WHEN replacement_code IS NULL THEN 'no_replacement'
  WHEN content IS NULL THEN 'missing_file'
  WHEN start_line < 1 OR end_line < start_line THEN 'invalid_range'
  WHEN start_line > n THEN 'past_end' ELSE 'applied' END AS status FROM x_patches) t""",
       views=(_PATCHES,))
def apply_patches(spark, sf):
    return H.apply_patches(X.patches(spark, sf), X.head_texts(spark, sf))


@query("original_lines", """
SELECT change_id, seq, path, CASE WHEN content IS NULL THEN '' WHEN start_line = 0
    THEN CASE WHEN end_line >= n THEN ls[n] WHEN end_line < 0 AND n + end_line > n - 1
      THEN ls[n] ELSE '' END
  ELSE coalesce(array_to_string(ls[start_line:least(end_line, n)], chr(10)), '') END AS original
FROM x_patches""", views=(_PATCHES,))
def original_lines(spark, sf):
    return H.original_lines(X.patches(spark, sf), X.head_texts(spark, sf))


@query("verification_status", """
SELECT change_id, seq, status, CASE WHEN no_patch THEN NULL WHEN seq % 17 = 0 THEN
    'Sandbox verification disabled.' WHEN status IN ('verified', 'repaired') THEN 'Tests passed.'
    ELSE out END AS output,
  CASE WHEN status = 'repaired' THEN 'again_' || seq END AS repaired_code
FROM (SELECT *, CASE WHEN no_patch OR seq % 17 = 0 THEN 'skipped' WHEN seq % 3 = 0 THEN 'verified'
    WHEN seq % 3 = 1 AND seq % 10 <> 9 AND out <> '' THEN 'repaired' ELSE 'failed' END AS status
  FROM (SELECT change_id, seq, seq % 7 = 0 OR seq % 5 = 0 AS no_patch, concat_ws(chr(10),
      CASE WHEN seq % 8 <> 0 THEN 'out ' || seq END,
      CASE WHEN seq % 4 <> 0 THEN 'err ' || path END) AS out FROM x_patches) a) b""",
       views=(_PATCHES,))
def verification_status(spark, sf):
    return N.verification_status(X.attempts(spark, sf)).select(
        "change_id", "seq", "status", "output", "repaired_code")


@query("clip_output", """
SELECT conv_id, turn, substr(CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN role
  ELSE text || chr(10) || repeat(role, 700) END, 1, 3000) AS output FROM conversations""")
def clip_output(spark, sf):
    k = F.col("turn") % 3
    return X.table(spark, sf, "conversations").select("conv_id", "turn", N.clip_output(
        F.when(k == 1, "").otherwise(F.col("text")),
        F.when(k == 0, "").when(k == 1, F.col("role")).otherwise(F.repeat("role", F.lit(700))))
        .alias("output"))
