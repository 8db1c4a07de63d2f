"""Guidance indexing, retrieval and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.catalog import fixtures as X
from patchloom.catalog.registry import query
from patchloom.functions import ids
from patchloom.operators import diff as D
from patchloom.operators import evaluation as E
from patchloom.operators import guidance as U
from patchloom.session import cut_lineage, shared_folder
from patchloom.sources.guidance_store import GuidanceStore

# --- sources in SQL ----------------------------------------------------------

_REPO = "'org/r' || CAST(floor(doc_id / 5) AS BIGINT)"
_SOURCE = ("x_source", f"""
SELECT doc_id, {_REPO} AS repo_id,
  CASE WHEN floor(doc_id / 5) % 16 = 9 THEN 'main' ELSE sha1({_REPO}) END AS revision,
  CASE WHEN doc_id % 80 = 41 THEN '../g' ELSE 'docs/g' END || CASE WHEN doc_id % 50 = 3 THEN doc_id - 1 ELSE doc_id END || '.md' AS path,
  text, CASE doc_id % 4 WHEN 1 THEN ['src'] WHEN 2 THEN ['src/auth'] WHEN 3 THEN
    ['deploy', 'tests'] ELSE [] END AS scopes FROM documents""")
_MD_LINES = ("x_md_lines", r"""
SELECT *, regexp_matches(line, '^ {0,3}#{1,6}\s+') AS is_heading,
  substr(regexp_extract(line, '^ {0,3}#{1,6}\s+(.*)', 1), 1, 160) AS heading,
  regexp_extract(line, '^ {0,3}(`{3,}|~{3,})', 1) AS fence,
  trim(regexp_replace(line, '^ {0,3}(`{3,}|~{3,})', '')) = '' AS bare
FROM (SELECT doc_id, n, count(*) OVER (PARTITION BY doc_id) AS total,
    CASE WHEN n % 31 IN (5, 9) THEN '```' WHEN n % 31 = 7 THEN '# not a heading'
      WHEN n % 9 = 1 THEN '## ' || raw ELSE raw END AS line
  FROM (SELECT doc_id, CAST(i AS BIGINT) AS n, raw FROM documents,
    unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(raw, i)) a) b
WHERE NOT (n = total AND line = '') AND doc_id NOT IN (SELECT doc_id FROM x_long)""")
_LONG = ("x_long", """
SELECT DISTINCT doc_id FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(raw, n)
WHERE n % 31 NOT IN (5, 7, 9) AND length(raw) + CASE WHEN n % 9 = 1 THEN 3 ELSE 0 END > 1500""")
_FOLD = ("x_fold", """
SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS cnt,
  CAST(0 AS BIGINT) AS length, '' AS heading, '' AS fence, false AS flush,
  CAST(0 AS BIGINT) AS old_first, '' AS old_heading FROM documents
UNION ALL
SELECT doc_id, n, CASE WHEN flush OR cnt = 0 THEN n ELSE first END,
  CASE WHEN flush THEN 1 ELSE cnt + 1 END,
  CASE WHEN flush THEN 0 ELSE length END + len + 1,
  CASE WHEN heads THEN new_heading ELSE heading END,
  CASE WHEN mark = '' THEN fence WHEN fence = '' THEN mark
    WHEN starts_with(mark, fence) AND bare THEN '' ELSE fence END,
  flush, first, heading
FROM (SELECT s.doc_id, l.n, s.first, s.cnt, s.length, s.heading, s.fence, l.fence AS mark, l.bare,
    l.heading AS new_heading, length(l.line) AS len, l.is_heading AND s.fence = '' AS heads,
    s.cnt > 0 AND ((l.is_heading AND s.fence = '') OR s.length + length(l.line) > 1500) AS flush
  FROM x_fold s JOIN x_md_lines l ON l.doc_id = s.doc_id AND l.n = s.n + 1) t""")
_SPANS = ("x_spans", """
SELECT doc_id, old_first AS first, n - 1 AS last, old_heading AS heading FROM x_fold WHERE flush
UNION ALL
SELECT f.doc_id, f.first, f.n, f.heading FROM x_fold f JOIN (
  SELECT doc_id, max(n) AS n FROM x_fold GROUP BY 1) m ON m.doc_id = f.doc_id AND m.n = f.n
WHERE f.cnt > 0""")
_CHUNKS = ("x_chunks", """
SELECT s.doc_id, p.repo_id, p.revision, p.path, p.scopes,
  row_number() OVER (PARTITION BY s.doc_id ORDER BY s.first) - 1 AS chunk_no,
  'L' || s.first || '-L' || s.last AS locator,
  s.heading || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY n) FROM x_md_lines l
    WHERE l.doc_id = s.doc_id AND l.n BETWEEN s.first AND s.last) AS text
FROM x_spans s JOIN x_source p ON p.doc_id = s.doc_id""")
_SRC_ID = "substr(sha256(repo_id || chr(10) || path || chr(10) || kind || chr(10) || locator), 1, 20)"
_MD_ITEMS = ("x_md_items", f"""
SELECT *, {_SRC_ID} AS source_id FROM (
  SELECT repo_id, 'markdown' AS kind, path, revision, locator,
    trim(text, ' ' || chr(10) || chr(9)) AS excerpt, scopes FROM x_chunks) t
WHERE excerpt <> ''""")
_DEC_SOURCE = ("x_dec", """
SELECT g, i AS item_id, 'org/r' || g AS repo_id, sha1('org/r' || g) AS revision,
  'docs/decisions' || g || '.json' AS path,
  'd' || CASE WHEN g % 8 = 3 AND i % 5 = 4 THEN i - 1 ELSE i END AS id, substr(text, 1, 40) AS title,
  text AS decision, CASE WHEN i % 2 = 0 THEN ['api', 'src'] ELSE ['lib', 'src'] END AS scopes
FROM (SELECT *, item_id AS i, CAST(floor(item_id / 5) AS BIGINT) AS g FROM benchmark) t""")
_DEC_ITEMS = ("x_dec_items", f"""
SELECT *, {_SRC_ID} AS source_id FROM (
  SELECT repo_id, 'decision' AS kind, path, revision, id AS locator,
    substr(title || chr(10) || decision, 1, 1800) AS excerpt, scopes FROM x_dec) t""")
_ITEMS = ("x_items", """
SELECT * FROM (SELECT * FROM x_md_items UNION ALL SELECT * FROM x_dec_items) a
WHERE repo_id NOT IN (SELECT repo_id FROM (SELECT repo_id FROM x_md_items UNION ALL
    SELECT repo_id FROM x_dec_items) b GROUP BY 1 HAVING count(*) > 100)
  AND repo_id NOT IN (SELECT repo_id FROM x_source GROUP BY repo_id, path HAVING count(*) > 1)
  AND repo_id NOT IN (SELECT repo_id FROM x_dec GROUP BY repo_id, path, id HAVING count(*) > 1)
  AND repo_id NOT IN (SELECT repo_id FROM x_dec WHERE length(decision) > 1800)
  AND repo_id NOT IN (SELECT repo_id FROM x_source WHERE revision = 'main' OR path LIKE '../%')
  AND repo_id NOT IN (SELECT repo_id FROM x_source JOIN (
    SELECT doc_id FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(raw, n)
    GROUP BY doc_id HAVING count(*) - 1 + sum(CASE WHEN n % 31 IN (5, 9) THEN 3 WHEN n % 31 = 7 THEN 15
      WHEN n % 9 = 1 THEN length(raw) + 3 ELSE length(raw) END) > 40000) USING (doc_id))
  AND repo_id NOT IN (SELECT repo_id FROM x_source JOIN x_long USING (doc_id))""")
_MD = (_SOURCE, _LONG, _MD_LINES, _FOLD, _SPANS, _CHUNKS, _MD_ITEMS)
_ALL = (*_MD, _DEC_SOURCE, _DEC_ITEMS, _ITEMS)
_ITEM_ROW = """repo_id, source_id, kind, path, revision, locator, excerpt,
  array_to_string(scopes, ',') AS scopes"""


def flat(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in (columns or ("scopes",))})


# --- sources -----------------------------------------------------------------


@query("manifest_sources", """
SELECT lower('Org/R' || g) AS repo_id, sha1('' || g) AS revision, path,
  CASE WHEN item_id % 2 = 0 THEN 'api,src' ELSE '' END AS applies_to, md5(text) AS digest
FROM (SELECT *, CAST(floor(item_id / 10) AS BIGINT) AS g, 'docs/' || item_id || '.md' AS path
  FROM benchmark) t WHERE g % 4 <> 1 AND g % 5 <> 2""")
def manifest_sources(spark, sf):
    """Every fourth manifest misses a file, every fifth names one by a bad path."""
    i = F.col("item_id")
    number = F.floor(i / 10)
    g = number.cast("string")
    path = F.concat(F.lit("docs/"), i.cast("string"), F.lit(".md"))
    named = F.when((number % 5 == 2) & (i % 10 == 0), F.concat(F.lit("docs/../"), path)).otherwise(path)
    items = X.table(spark, sf, "benchmark")
    entry = F.struct(named.alias("path"), F.when(
        i % 2 == 0, F.array(F.lit("src"), F.lit("api"), F.lit("src"))).alias("applies_to"))
    manifests = items.groupBy(g.alias("g")).agg(F.collect_list(entry).alias("sources")).select(
        F.concat(F.lit("Org/R"), "g").alias("repo_id"), F.sha1("g").alias("revision"),
        F.to_json(F.struct("sources")).alias("manifest"))
    blobs = items.filter((number % 4 != 1) | (i % 10 != 0)).select(
        F.sha1(g).alias("revision"), path.alias("path"), F.col("text").alias("content"))
    return flat(U.manifest_sources(manifests, blobs), "applies_to").withColumn(
        "digest", F.md5("content")).drop("content")


@query("decision_rows", """
SELECT repo_id, path, item_id % 5 AS seq, id, title, decision,
  CASE WHEN item_id % 2 = 0 THEN 'src,api,src' ELSE '' END AS own_scopes,
  g % 8 = 3 AND item_id % 5 = 4 AS duplicate FROM x_dec""", views=(_DEC_SOURCE,))
def decision_rows(spark, sf):
    return flat(U.decision_rows(X.decisions(spark, sf)), "own_scopes").select(
        "repo_id", "path", "seq", "id", "title", "decision", "own_scopes", "duplicate")


_VECTORS = ("x_vec", f"""
SELECT vec_id, 'org/r' || CAST(floor(vec_id / 50) AS BIGINT) AS repo_id,
  's' || lpad('' || vec_id, 9, '0') AS source_id,
  CASE WHEN vec_id % 5 = 4 THEN 'other-embedder' ELSE '{C.EMBEDDER_NAME}' END AS embedder,
  CASE label % 3 WHEN 1 THEN ['src'] WHEN 2 THEN ['src/auth', 'tests'] ELSE [] END AS scopes,
  CAST(embedding AS DOUBLE[]) AS v FROM embeddings""")


@query("guidance_table", """
SELECT repo_id, source_id, embedder, array_to_string(scopes, ',') AS scopes,
  CAST(len(v) AS BIGINT) AS dims, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version
FROM x_vec WHERE floor(vec_id / 50) % 2 = 0 OR vec_id % 2 = 0""".replace(
    "CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT",
    "CAST(CASE WHEN floor(vec_id / 50) % 2 = 0 THEN 1 ELSE 2 END AS BIGINT)"), views=(_VECTORS,))
def guidance_table(spark, sf):
    """All rows stored, then every other repository replaced by half of them; compacted, vacuumed."""
    return flat(stored(spark, sf).read()).select(
        "repo_id", "source_id", "embedder", "scopes", F.size("embedding").cast("bigint").alias("dims"),
        F.col("revision").cast("bigint").alias("version"))


def stored(spark, sf):
    rows = X.guidance(spark, sf).select(
        "repo_id", "source_id", F.lit("markdown").alias("kind"), F.lit("docs/g.md").alias("path"),
        F.lit("1").alias("revision"), F.col("source_id").alias("locator"),
        F.lit("text").alias("excerpt"), "scopes", "embedder", "embedding")
    store = GuidanceStore(spark, f"{shared_folder(spark)}/guidance-{uuid.uuid4().hex}", dimensions=64,
                          buckets=8)
    store.write(rows, rows, 1)
    number = F.substr("source_id", F.lit(2)).cast("bigint")
    odd = F.floor(number / 50) % 2 == 1
    store.write(rows.filter(odd & (number % 2 == 0)).withColumn("revision", F.lit("2")),
                rows.filter(odd), 2)
    store.compact(3, attempts=1)
    store.vacuum(keep=1)
    return store


# --- excerpts ----------------------------------------------------------------


@query("markdown_chunks", """
SELECT repo_id, path, doc_id, chunk_no, locator, text FROM x_chunks""", views=_MD)
def markdown_chunks(spark, sf):
    # Two documents may share a path; their number keeps the rows apart.
    tagged = X.sources(spark, sf).withColumn("path", F.concat(F.col("doc_id").cast("string"),
                                                              F.lit("|"), F.col("path")))
    return U.markdown_chunks(tagged).select(
        "repo_id", F.substring_index("path", "|", -1).alias("path"),
        F.substring_index("path", "|", 1).cast("bigint").alias("doc_id"),
        "chunk_no", "locator", "text")


@query("markdown_items", f"SELECT {_ITEM_ROW} FROM x_md_items", views=_MD)
def markdown_items(spark, sf):
    return flat(U.markdown_items(X.sources(spark, sf)))


@query("decision_items", f"SELECT {_ITEM_ROW} FROM x_dec_items", views=(_DEC_SOURCE, _DEC_ITEMS))
def decision_items(spark, sf):
    return flat(U.decision_items(X.decisions(spark, sf)))


@query("reference_id", """
SELECT doc_id, substr(sha256(source || chr(10) || lang || chr(10) || 'markdown' || chr(10)
  || doc_id), 1, 20) AS source_id FROM documents""")
def reference_id(spark, sf):
    return X.documents(spark, sf).select("doc_id", ids.reference_id(
        F.col("source"), F.col("lang"), F.lit("markdown"), F.col("doc_id").cast("string"))
        .alias("source_id"))


def all_sources(spark, sf):
    return X.sources(spark, sf).drop("doc_id").unionByName(X.decisions(spark, sf))


@query("index_items", f"SELECT {_ITEM_ROW} FROM x_items", views=_ALL)
def index_items(spark, sf):
    return flat(U.index_items(all_sources(spark, sf)))


# --- vectors -----------------------------------------------------------------

_SLOTS = """SELECT {key}, slot, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 768 AS BIGINT) AS slot FROM (
    SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {table}) a) b
  GROUP BY ALL
  UNION ALL SELECT {key}, 0, 1.0 FROM {table} WHERE NOT regexp_matches(lower({text}), '[a-z0-9]')"""


@query("embed_terms", _SLOTS.format(key="doc_id", text="text", table="x_texts"),
       views=(("x_texts", """SELECT doc_id, text FROM documents
         UNION ALL SELECT -1 - doc_id, '?!' FROM documents"""),))
def embed_terms(spark, sf):
    docs = X.documents(spark, sf).select("doc_id", "text")
    texts = docs.unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"),
                                         F.lit("?!").alias("text")))
    dense = texts.select("doc_id", F.posexplode(U.embed_terms(F.col("text"))).alias("slot", "w"))
    return dense.filter("w <> 0").select(
        "doc_id", F.col("slot").cast("bigint").alias("slot"), F.col("w").cast("double").alias("weight"))


@query("check_vectors", """
SELECT vec_id, vec_id % 9 NOT IN (1, 2, 3, 4) AS valid FROM embeddings""")
def check_vectors(spark, sf):
    e, k = F.col("embedding"), F.col("vec_id") % 9
    broken = (
        F.when(k == 1, F.slice(e, 1, 63))
        .when(k == 2, F.transform(e, lambda x: F.lit(0.0).cast("float")))
        .when(k == 3, F.transform(e, lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x)
                                  .cast("float")))
        .when(k == 4, F.transform(e, lambda x, i: F.when(i == 7, F.lit(float("-inf"))).otherwise(x)
                                  .cast("float")))
        .otherwise(e))
    rows = X.table(spark, sf, "embeddings").select("vec_id", broken.alias("embedding"))
    return U.check_vectors(rows, dimensions=64).select("vec_id", "valid")


# --- replacement -------------------------------------------------------------

_STORE = ("x_store", f"""
SELECT repo_id, source_id, kind, path, CASE h WHEN '4' THEN 'old' ELSE revision END AS revision,
  locator, CASE h WHEN '5' THEN 'old ' || excerpt ELSE excerpt END AS excerpt,
  CASE h WHEN '6' THEN ['old'] ELSE scopes END AS scopes,
  CASE h WHEN '7' THEN 'old-embedder' ELSE '{C.EMBEDDER_NAME}' END AS embedder
FROM (SELECT *, substr(source_id, 1, 1) AS h FROM x_items) t WHERE h > '3'
UNION ALL
SELECT CASE WHEN substr(source_id, 1, 1) = 'a' THEN 'zz/' || source_id ELSE repo_id END,
  'gone' || source_id, kind, path, revision, locator, excerpt, scopes, '{C.EMBEDDER_NAME}'
FROM x_items WHERE substr(source_id, 1, 1) IN ('8', 'a')""")
_DIFF = ("x_diff", f"""
SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.source_id, o.source_id) AS source_id,
  CASE WHEN n.source_id IS NULL THEN 'delete' WHEN o.source_id IS NULL THEN 'embed'
    WHEN o.embedder <> '{C.EMBEDDER_NAME}' THEN 'embed'
    WHEN n.revision = o.revision AND n.excerpt = o.excerpt AND n.scopes = o.scopes THEN 'unchanged'
    WHEN n.excerpt = o.excerpt THEN 'reuse' ELSE 'embed' END AS action
FROM x_items n FULL JOIN (SELECT * FROM x_store WHERE repo_id IN (SELECT repo_id FROM x_source))
  o ON o.repo_id = n.repo_id AND o.source_id = n.source_id""")


def old_store(spark, sf, items):
    h = F.substring("source_id", 1, 1)
    vector = F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))
    changed = items.filter(h > "3").withColumns({
        "revision": F.when(h == "4", "old").otherwise(F.col("revision")),
        "excerpt": F.when(h == "5", F.concat(F.lit("old "), "excerpt")).otherwise(F.col("excerpt")),
        "scopes": F.when(h == "6", F.array(F.lit("old"))).otherwise(F.col("scopes")),
        "embedder": F.when(h == "7", "old-embedder").otherwise(C.EMBEDDER_NAME)})
    gone = items.filter(h.isin("8", "a")).withColumns({
        "repo_id": F.when(h == "a", F.concat(F.lit("zz/"), "source_id")).otherwise(F.col("repo_id")),
        "source_id": F.concat(F.lit("gone"), "source_id"), "embedder": F.lit(C.EMBEDDER_NAME)})
    return changed.unionByName(gone).withColumn("embedding", vector)


@query("snapshot_diff", "SELECT * FROM x_diff", views=(*_ALL, _STORE, _DIFF))
def snapshot_diff(spark, sf):
    items = cut_lineage(U.index_items(all_sources(spark, sf)))  # read three times below
    return U.snapshot_diff(items, old_store(spark, sf, items), X.sources(spark, sf)).select(
        "repo_id", "source_id", "action")


@query("replace_snapshot", """
SELECT i.repo_id, i.source_id, i.revision, array_to_string(i.scopes, ',') AS scopes,
  CAST(CASE d.action WHEN 'embed' THEN 768 ELSE 2 END AS BIGINT) AS dims
FROM x_items i JOIN x_diff d ON d.repo_id = i.repo_id AND d.source_id = i.source_id""",
       views=(*_ALL, _STORE, _DIFF))
def replace_snapshot(spark, sf):
    """Old vectors have two places, so reuse shows in the result."""
    items = cut_lineage(U.index_items(all_sources(spark, sf)))  # read three times below
    rows = U.replace_snapshot(items, old_store(spark, sf, items), X.sources(spark, sf))
    return flat(rows).select("repo_id", "source_id", "revision", "scopes",
                             F.size("embedding").cast("bigint").alias("dims"))


# --- retrieval ---------------------------------------------------------------

_ASK = ("x_ask", f"""
SELECT vec_id AS query_id, 'org/r' || CAST(floor(vec_id / 50 + 1) AS BIGINT) AS repo_id,
  CASE vec_id % 3 WHEN 0 THEN 'src/auth/q' WHEN 1 THEN 'src/q' ELSE 'srcx/q' END || vec_id AS path,
  CAST(embedding AS DOUBLE[]) AS v FROM embeddings""")
_PAIRS = ("x_pairs", f"""
SELECT q.query_id, q.path, q.v AS qv, s.source_id, s.v AS sv FROM x_ask q JOIN x_vec s
  ON s.repo_id = q.repo_id AND s.embedder = '{C.EMBEDDER_NAME}'
  AND (len(s.scopes) = 0 OR len(list_filter(s.scopes, lambda x: q.path = x
    OR starts_with(q.path, x || '/'))) > 0)""")


@query("scope_match", "SELECT query_id, source_id FROM x_pairs", views=(_VECTORS, _ASK, _PAIRS))
def scope_match(spark, sf):
    asks = X.guidance_vector_queries(spark, sf).withColumnRenamed("path", "query_path")
    return U.scope_match(asks.drop("embedding"), X.guidance(spark, sf).drop("embedding")).select(
        "query_id", "source_id")


@query("cosine_topk", """
SELECT query_id, source_id, similarity, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, source_id) AS rank FROM (
    SELECT query_id, source_id, round(list_cosine_similarity(qv, sv), 6) AS similarity
    FROM x_pairs) a WHERE similarity >= 0.05) b WHERE rank <= 3""",
       views=(_VECTORS, _ASK, _PAIRS))
def cosine_topk(spark, sf):
    asks = X.guidance_vector_queries(spark, sf).withColumnRenamed("path", "query_path")
    return U.cosine_topk(asks, X.guidance(spark, sf), k=3, min_similarity=0.05).select(
        "query_id", "source_id", "similarity", F.col("rank").cast("bigint").alias("rank"))


_REQUESTS = ("x_requests", """
SELECT change_id, file_no, path, path || chr(10) || substr(added, 1, 3000) AS query_text FROM (
  SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY file_no) AS rn FROM (
    SELECT change_id, file_id % 20 AS file_no, path, string_agg(line, chr(10) ORDER BY n) AS added
    FROM fx_changes WHERE op = 'add' GROUP BY ALL) a
  WHERE trim(added, ' ' || chr(9) || chr(10)) <> '') b WHERE rn <= 8""")


def requests(spark, sf):
    return U.guidance_queries(D.added_text(D.diff_files(X.diffs(spark, sf), with_hunks=True)))


@query("guidance_queries", "SELECT * FROM x_requests", views=(_REQUESTS,))
def guidance_queries(spark, sf):
    return requests(spark, sf)


@query("retrieve_guidance", """
SELECT change_id, file_no, changed_path, source_id, similarity, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY change_id, file_no ORDER BY similarity DESC, source_id) AS rank
  FROM (SELECT q.change_id, q.file_no, q.path AS changed_path, d.source_id,
      round(d.dot / sqrt(qn.n * sn.n), 6) AS similarity
    FROM (SELECT a.change_id, a.file_no, b.source_id, sum(a.weight * b.weight) AS dot
      FROM x_q_slots a JOIN x_s_slots b ON b.slot = a.slot
        AND b.repo_id = 'org/r' || (a.change_id * 4) GROUP BY ALL) d
    JOIN x_requests q ON q.change_id = d.change_id AND q.file_no = d.file_no
    JOIN (SELECT change_id, file_no, sum(weight * weight) AS n FROM x_q_slots GROUP BY ALL) qn
      ON qn.change_id = d.change_id AND qn.file_no = d.file_no
    JOIN (SELECT repo_id, source_id, sum(weight * weight) AS n FROM x_s_slots GROUP BY ALL) sn
      ON sn.repo_id = 'org/r' || (d.change_id * 4) AND sn.source_id = d.source_id
    JOIN x_items i ON i.repo_id = sn.repo_id AND i.source_id = sn.source_id
    WHERE len(i.scopes) = 0 OR len(list_filter(i.scopes, lambda x: q.path = x
      OR starts_with(q.path, x || '/'))) > 0) a WHERE similarity >= 0.09) b WHERE rank <= 2""",
       views=(*_ALL, _REQUESTS, ("x_store_texts", """
SELECT repo_id, source_id, path || chr(10) || excerpt AS body FROM x_items"""),
              ("x_q_slots", _SLOTS.format(key="change_id, file_no", text="query_text",
                                          table="x_requests")),
              ("x_s_slots", _SLOTS.format(key="repo_id, source_id", text="body",
                                          table="x_store_texts"))))
def retrieve_guidance(spark, sf):
    items = U.index_items(all_sources(spark, sf))
    store = U.fixture_embedder(items.withColumn(
        "text", F.concat("path", F.lit("\n"), "excerpt"))).withColumn(
        "embedder", F.lit(C.EMBEDDER_NAME))
    repos = X.files(spark, sf).select("change_id").distinct().withColumn(
        "repo_id", F.concat(F.lit("Org/R"), (F.col("change_id") * 4).cast("string")))
    return U.retrieve_guidance(requests(spark, sf), store, repos, k=2, min_similarity=0.09)


# --- evaluation --------------------------------------------------------------

_CASES = ("x_cases", """
SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'L' || (doc_id % 7) END AS expected_locator,
  toxic = 1 AS violation FROM labels""")
_ARMS = ("x_arms", "SELECT *, unnest([false, true]) AS enabled FROM x_cases")
_GOT = ("x_got", """
SELECT case_id, 'L' || CASE WHEN case_id % 3 = 0 THEN 9 ELSE case_id % 7 END AS locator
FROM x_cases""")
_HITS = ("x_hits", """
SELECT a.case_id, a.enabled, a.violation, a.expected_locator IS NOT NULL AS has_reference,
  a.enabled AND a.expected_locator IN (SELECT locator FROM x_got g WHERE g.case_id = a.case_id)
    IS TRUE AS hit FROM x_arms a""")
_BODIES = ("x_bodies", r"""
SELECT case_id, true AS enabled, 1 AS comment_no, case_id % 3 <> 0 AS cites,
  case_id % 4 <> 0 AS says FROM x_cases WHERE case_id % 5 <> 4
UNION ALL SELECT case_id, true, 2, true, true FROM x_cases WHERE case_id % 6 = 1
UNION ALL SELECT case_id, false, 1, false, true FROM x_cases WHERE case_id % 7 = 2""")
_SCORED = ("x_scored", """
SELECT *, correct > 0 AS grounded, comments - least(1, correct) AS false_positives FROM (
  SELECT a.case_id, a.enabled, (SELECT count(*) FROM x_bodies b WHERE b.case_id = a.case_id
      AND b.enabled = a.enabled) AS comments,
    CASE WHEN a.violation THEN (SELECT count(*) FROM x_bodies b WHERE b.case_id = a.case_id
      AND b.enabled = a.enabled AND b.cites AND b.says) ELSE 0 END AS correct FROM x_arms a) t""")
_EVAL = (_CASES, _ARMS, _GOT, _HITS, _BODIES, _SCORED)


def arms(spark, sf):
    return E.eval_arms(X.eval_cases(spark, sf))


def hits(spark, sf):
    c = F.col("case_id")
    got = X.eval_cases(spark, sf).select(
        c, F.lit(True).alias("enabled"), F.concat(F.lit("L"), F.when(c % 3 == 0, 9).otherwise(c % 7)
                                                  .cast("string")).alias("locator"))
    return E.retrieval_hits(arms(spark, sf), got)


def grounded(spark, sf):
    c = F.col("case_id")
    cases = X.eval_cases(spark, sf).select("case_id")
    cite = F.concat(F.lit("Repository guidance: [g]("), c.cast("string"), F.lit(")"))

    def bodies(rows, enabled, number, cites, says):
        prose = F.when(says, F.when(c % 2 == 0, "Use ERROR\\_code").otherwise("Wants UTC time")
                       ).otherwise("Something else")
        return rows.select(c, F.lit(enabled).alias("enabled"), F.lit(number).alias("comment_no"),
                           F.concat(prose, F.lit("\n\n"), F.when(cites, cite).otherwise(
                               "Repository guidance: [g](0x)"), F.lit("\nerror_code utc"))
                           .alias("body"))
    comments = bodies(cases.filter(c % 5 != 4), True, 1, c % 3 != 0, c % 4 != 0).unionByName(
        bodies(cases.filter(c % 6 == 1), True, 2, F.lit(True), F.lit(True))).unionByName(
        bodies(cases.filter(c % 7 == 2), False, 1, F.lit(False), F.lit(True)))
    citations = E.eval_arms(cases).select("case_id", "enabled", cite.alias("citation"))
    terms = cases.select(c, F.explode(F.when(c % 2 == 0, F.array(F.lit("error_code"))).otherwise(
        F.array(F.lit("timezone"), F.lit("utc")))).alias("term"))
    return E.grounded_findings(arms(spark, sf), comments, citations, terms)


@query("eval_arms", "SELECT case_id, enabled FROM x_arms", views=_EVAL)
def eval_arms(spark, sf):
    return arms(spark, sf).select("case_id", "enabled")


@query("retrieval_hits", "SELECT case_id, enabled, has_reference, hit FROM x_hits", views=_EVAL)
def retrieval_hits(spark, sf):
    return hits(spark, sf).select("case_id", "enabled", "has_reference", "hit")


@query("grounded_findings", "SELECT * FROM x_scored", views=_EVAL)
def grounded_findings(spark, sf):
    return grounded(spark, sf).select(
        "case_id", "enabled", "comments", "correct", "grounded", "false_positives")


_MS = """CAST(round((case_id * 7919 % 10007) / 100.0, 2) AS DOUBLE) AS review_ms,
  CASE WHEN enabled THEN CAST(round((case_id * 104729 % 5003) / 100.0, 2) AS DOUBLE) END
    AS retrieval_ms"""


def scored_runs(spark, sf):
    c = F.col("case_id")
    scores = grounded(spark, sf).select(*E.RUN, "grounded", "false_positives")
    return hits(spark, sf).join(scores, E.RUN).withColumns({
        "review_ms": F.round((c * 7919 % 10007) / 100.0, 2),
        "retrieval_ms": F.when(F.col("enabled"), F.round((c * 104729 % 5003) / 100.0, 2))})


@query("arm_summary", f"""
SELECT enabled, count(*) AS cases, count(*) FILTER (hit) AS hits,
  count(*) FILTER (has_reference) AS applicable, count(*) FILTER (grounded) AS grounded,
  count(*) FILTER (violation) AS violations, CAST(sum(false_positives) AS BIGINT) AS false_positives,
  round(median(review_ms), 2) AS review_ms, round(median(retrieval_ms), 2) AS retrieval_ms
FROM (SELECT h.*, s.grounded, s.false_positives, {_MS.replace('case_id', 'h.case_id').replace(
    'WHEN enabled', 'WHEN h.enabled')}
  FROM x_hits h JOIN x_scored s ON s.case_id = h.case_id AND s.enabled = h.enabled) t
GROUP BY enabled""", views=_EVAL)
def arm_summary(spark, sf):
    return E.arm_summary(scored_runs(spark, sf))


@query("eval_gate", """
SELECT bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS failing_cases FROM (
  SELECT (NOT has_reference OR hit) AND (NOT violation OR grounded) AND false_positives = 0 AS ok
  FROM x_hits h JOIN x_scored s ON s.case_id = h.case_id AND s.enabled = h.enabled
  WHERE h.enabled) t""", views=_EVAL)
def eval_gate(spark, sf):
    return E.eval_gate(scored_runs(spark, sf))
