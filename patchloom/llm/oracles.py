"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 0) = 0),
t AS (SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

# Words, symbols, lines and repeated windows per document; then histograms, quartiles and fences.
QUALITY = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM d),
win AS (SELECT doc_id, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win)
        WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM rep, range(0, 3) r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS f1,
        CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS f2,
        CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS f3,
        CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS f4 FROM m),
f AS (
  SELECT lang, source, 1 AS f, f1 AS v FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 2, f2 FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 3, f3 FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 4, f4 FROM b WHERE NOT base_failed),
h AS (SELECT lang, source, f, CASE WHEN v < 64 THEN v
        ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS k, count(*) AS n
      FROM f WHERE v IS NOT NULL GROUP BY ALL),
g AS (SELECT 1 AS level, lang, source, f, k, n FROM h
      UNION ALL SELECT 2, lang, NULL, f, k, sum(n) FROM h GROUP BY lang, f, k
      UNION ALL SELECT 3, NULL, NULL, f, k, sum(n) FROM h GROUP BY f, k),
r AS (SELECT *, sum(n) OVER p AS total, sum(n) OVER (PARTITION BY level, lang, source, f ORDER BY k
          ROWS UNBOUNDED PRECEDING) AS upto,
        CASE WHEN k < 64 THEN k ELSE ((k - (k // 32 - 1) * 32 + 1) << (k // 32 - 1)) - 1 END AS top
      FROM g WINDOW p AS (PARTITION BY level, lang, source, f)),
q AS (SELECT level, lang, source, f, total, min(CASE WHEN 4 * upto >= total THEN top END) AS q1,
        min(CASE WHEN 4 * upto >= 3 * total THEN top END) AS q3 FROM r GROUP BY ALL),
e AS (SELECT *, q3 + greatest(3 * (q3 - q1), [150, 400, 400, 500][f]) AS fence FROM q),
x AS (SELECT a.lang, a.source, a.f, CASE WHEN a.total >= 200 THEN a.fence WHEN l.total >= 200
          THEN l.fence ELSE o.fence END AS fence
      FROM e a JOIN e l ON l.level = 2 AND l.f = a.f AND l.lang IS NOT DISTINCT FROM a.lang
      JOIN e o ON o.level = 3 AND o.f = a.f WHERE a.level = 1),
y AS (SELECT lang, source, max(fence) FILTER (f = 1) AS t1, max(fence) FILTER (f = 2) AS t2,
        max(fence) FILTER (f = 3) AS t3, max(fence) FILTER (f = 4) AS t4 FROM x GROUP BY ALL)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(f1 <= t1, true) AND coalesce(f2 <= t2, true)
    AND coalesce(f3 <= t3, true) AND coalesce(f4 <= t4, true) AS kept
FROM b LEFT JOIN y ON y.lang IS NOT DISTINCT FROM b.lang AND y.source IS NOT DISTINCT FROM b.source
"""

URLS = r"""
WITH p AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN concat(regexp_replace(host, '^(www|m)\.', ''),
      regexp_replace(path, '(\.html|/)$', ''),
      CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END) END AS canon,
    CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/')
        THEN 'example.net/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/')
        THEN 'example.com/de/'
      WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM q),
l AS (SELECT canon, CASE WHEN count(*) FILTER (rule IS NULL OR rule IN ('example.net/en/', 'org/fr/')) > 0
      THEN coalesce(min(page_id) FILTER (rule IN ('example.net/en/', 'org/fr/')),
        min(page_id) FILTER (rule IS NULL)) ELSE min(page_id) END AS first_page
      FROM c WHERE canon IS NOT NULL GROUP BY canon HAVING count(*) > 1)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page THEN 'block'
    ELSE 'allow' END AS verdict, first_page IS NOT NULL AS listed
FROM c LEFT JOIN l USING (canon)
"""

MIX = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''),
    '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    coalesce(CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END, 1.0)::DOUBLE AS weight
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
  USING (doc_id)),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM s
      GROUP BY source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
        3 * source_size AS cap FROM z),
k AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () - coalesce(sum(cap) OVER (o
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
        sum(w) OVER () - coalesce(sum(w) OVER (o
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
m AS (SELECT min(k) AS k0 FROM k WHERE left_words * w <= cap * left_w),
t AS (SELECT k.source, k.source_size, k.n_docs, CASE WHEN k0 IS NULL OR k.k < k0
          THEN CAST(k.cap AS DOUBLE)
          ELSE CAST(f.left_words * k.w AS DOUBLE) / CAST(f.left_w AS DOUBLE) END AS target
      FROM k, m LEFT JOIN k f ON f.k = m.k0),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size))
          AS BIGINT) ELSE 0 END AS epochs FROM t),
j AS (SELECT s.*, source_size, target, epochs, target - epochs * source_size AS rest,
        -ln((CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))),
          1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS key
      FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CAST(epochs < 3 AND rest > 0
    AND before + size / 2 <= rest AS BIGINT)) AS BIGINT) AS taken
FROM r
"""



def _clusters(rounds: int = 3) -> str:
    """Exhaustive assignment and exact means, written out round by round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT r, c, CAST(list_sum(list_transform(list_zip(v.e, m.e),
    lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, m{k} m),
a{k} AS (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""
u{k} AS (SELECT c, i, CAST(sum(w) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT a.c, unnest(v.e) AS w, generate_subscripts(v.e, 1) AS i FROM a{k} a JOIN v USING (r))
    GROUP BY c, i),
m{k + 1} AS (SELECT m.c, coalesce(f.e, m.e) AS e FROM m{k} m LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM u{k} GROUP BY c) f USING (c))""")
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(
      greatest(-134217728, least(134217728, floor(64 * CAST(x AS DOUBLE)))) AS BIGINT)) AS e
    FROM embeddings WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS (SELECT row_number() OVER o - 1 AS c, e FROM v
    WINDOW o AS (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e)
    QUALIFY row_number() OVER o <= 16),{",".join(steps)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN m{rounds} m USING (c)
"""


# Conversation repair by dynamic programming forwards. A state is cost (as digits) + edits and the
# repaired text, so that the least one is the cheapest and, among those, the first in the alphabet.
_WORD = r"[^\x20\x09-\x0D]"


def _repair() -> str:
    shift = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    crc = "SELECT i, i AS v FROM range(256) r(i)"
    for _ in range(8):
        crc = f"SELECT i, {shift} AS v FROM ({crc})"
    line = lambda role, text: (f"(CASE WHEN @.r = '' THEN '' ELSE @.r || chr(10) END) || {role} "
                               f"|| ':' || {text}")

    def onward(state: str, cost: str, letter: str, text: str = "@.r") -> str:
        new = ("{'k': lpad(CAST(CAST(substr(@.k, 1, 7) AS INTEGER) + " + cost + " AS VARCHAR), 7, '0')"
               " || substr(@.k, 8) || '" + letter + "', 'r': " + text + "}")
        return f"CASE WHEN @ IS NOT NULL THEN {new} END".replace("@", state)

    least = lambda *states: ("list_sort(list_filter([" + ", ".join(states)
                             + "], lambda x: x IS NOT NULL))[1]")
    insert = lambda state, role: onward(state, "3", "I", line(f"'{role}'", "''"))
    with_user = lambda p: least(f"{p}2", *[insert(f"{p}{q}", "user") for q in (0, 1, 3)])
    reroled = lambda q, role: ("CASE WHEN kind <> 'x' THEN " + onward(
        f"t{q}", "3 + cut", "R", line(f"'{role}'", "text")) + " END")
    kept = lambda q, kind: (f"CASE WHEN kind = '{kind}' THEN " + onward(
        f"t{q}", "cut", "K", line("role", "text")) + " END")
    deleted = lambda q: onward(f"t{q}", "4", "D")
    return rf"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM ({crc})),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295,
    list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ')
      || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
      AS before FROM d),
f AS (SELECT *, NOT regexp_matches(text, '{_WORD}') AS is_blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') AS is_cut FROM o),
rows_ AS (SELECT conv_id, turn, i, role, text, is_blank, seen AND NOT is_blank AS is_dup,
    is_cut AND NOT is_blank AND NOT seen AS is_trunc,
    before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS is_bad,
    CASE WHEN is_blank OR seen THEN 'x' ELSE substr(role, 1, 1) END AS kind,
    CASE WHEN is_cut AND NOT is_blank AND NOT seen THEN 3 ELSE 0 END AS cut FROM f),
walk AS (
  SELECT conv_id, 0 AS i, {{'k': '0000000', 'r': ''}} AS s0, CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR))
    AS s1, CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)) AS s2,
    CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {deleted(0)} AS s0, {least(deleted(1), kept(0, 's'))} AS s1,
    {least(deleted(2), *[kept(q, 'u') for q in (0, 1, 3)], *[reroled(q, 'user') for q in (0, 1, 3)])}
      AS s2, {least(deleted(3), kept(2, 'a'), reroled(2, 'assistant'))} AS s3
  FROM (SELECT *, {least('s3', insert('t2', 'assistant'))} AS t3 FROM (
    SELECT w.conv_id, r.i, role, text, kind, cut, s3, s0 AS t0, s1 AS t1, {with_user('s')} AS t2
    FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
last_ AS (SELECT conv_id, {least('s0', 's3', insert('t2', 'assistant'))} AS best FROM (
    SELECT *, {with_user('s')} AS t2 FROM walk
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count_if(is_blank) AS blank, count_if(is_dup) AS duplicate, count_if(is_trunc) AS truncated,
    count_if(is_bad) AS illegal FROM rows_ GROUP BY conv_id)
SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT)
  AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(substr(best.k, 1, 7) AS BIGINT) AS cost, substr(best.k, 8) AS audit,
  sha256(best.r) AS repaired_sha256
FROM last_ l LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""


ORACLES: dict[str, str] = {
    "op4_exact_topk": TOP_K,
    "op5_quality_rules": QUALITY,
    "op6_url_filters": URLS,
    "op8_source_mix": MIX,
    "op12_conversation_repair": _repair(),
    "op13_centroid_clusters": _clusters(),
}
