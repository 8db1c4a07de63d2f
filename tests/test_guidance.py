"""Guidance: chunking against a plain loop, and the four labelled cases."""

import json
import math
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from patchloom.operators import evaluation as E
from patchloom.operators import guidance as U
from patchloom.operators.filters import contract_checks
from patchloom.sources.guidance_store import GuidanceStore

SOURCE = "repo_id string, revision string, path string, content string, applies_to array<string>"
GUIDE = """# Storage handbook

## Closing of cursors
Every storage cursor is opened in a with block, so that the cursor closes on failure.
Plain open_cursor calls without a with block leak the cursor.
"""
DECISIONS = """[{"id": "money-decimal", "title": "Money amounts", "decision": "Billing code keeps money
 amounts as Decimal, never as float, since a float amount loses cents.", "applies_to": ["billing"]},
 {"id": "queue-names", "title": "Queue names",
 "decision": "Queue names start with the team's short name.", "applies_to": ["queues"]}]
""".replace("\n ", " ")


def chunks(content):
    """Excerpts in three passes: headings, cut points, texts."""
    lines = content.splitlines()
    titles, opened_by = {}, None
    for i, line in enumerate(lines):
        if opened_by is None and (m := re.match(r" {0,3}#{1,6}\s+(.*)", line)):
            titles[i] = m[1][:160]
        if m := re.match(r" {0,3}(`{3,}|~{3,})", line):
            if opened_by is None:
                opened_by = m[1]
            elif m[1].startswith(opened_by) and line[m.end():].isspace() | (line[m.end():] == ""):
                opened_by = None
    cuts = [0] if lines else []
    for i in range(1, len(lines)):
        taken = sum(len(x) + 1 for x in lines[cuts[-1]:i])
        if i in titles or taken + len(lines[i]) > 1500:
            cuts.append(i)
    spans = zip(cuts, [*cuts[1:], len(lines)])
    return [(f"L{a + 1}-L{b}", "\n".join([titles[max(t)] if (t := [i for i in titles if i < b])
                                          else "", *lines[a:b]])) for a, b in spans]


def test_markdown_chunks(spark):
    rnd = random.Random(7)
    pieces = ["# Top", "## Two words ", "##", "#no", "   ### in", "    # code", "```", "````", "``` py",
              "~~~", "text " * 60, "x" * 1499, "", "word"]
    texts = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(80)]
    df = spark.createDataFrame([("o/r", "1", f"{i}.md", t, []) for i, t in enumerate(texts)], SOURCE)
    got = {}
    for r in U.markdown_chunks(df).orderBy("chunk_no").collect():
        got.setdefault(int(r.path[:-3]), []).append((r.locator, r.text))
    assert got == {i: c for i, t in enumerate(texts) if (c := chunks(t))}
    long = spark.createDataFrame([("o/r", "1" * 40, "a.md", "y" * 1501, [])], SOURCE)
    assert U.markdown_chunks(long).count() == 0 and U.snapshot_errors(long).count() == 1


ONE, TWO = "1" * 40, "2" * 40


def test_refused_snapshots(spark):
    rows = [("ok/a", ONE, "a.md", "# A\ntext", []), ("dup/a", ONE, "a.md", "# A", []),
            ("dup/a", ONE, "a.md", "# B", []), ("many/a", ONE, "a.md", "# h\n" * 101, []),
            ("full/a", ONE, "a.md", "# h\n" * 100, []), ("ids/a", ONE, "d.json", DECISIONS.replace(
                "queue-names", "money-decimal"), []), ("bad/a", ONE, "d.json", "{", []),
            ("ok/b", ONE, "d.json", DECISIONS, ["src"])]
    rows += [("Org/R", ONE, "a.md", "# A", []), ("rev/a", "main", "a.md", "# A", []),
             ("path/a", ONE, "../x.md", "# A", []), ("ext/a", ONE, "a.txt", "# A", []),
             ("big/a", ONE, "a.md", ("x" * 999 + "\n") * 60, []), ("scope/a", ONE, "a.md", "# A", ["/a"]),
             ("null/a", ONE, "a.md", None, []), ("two/a", ONE, "a.md", "# A", []), ("two/a", ONE, "../b.md", "", []),
             ("wide/a", ONE, "a.md", "# A", [f"s{i}" for i in range(17)])]
    rows += [("lots/a", ONE, f"{i}.md", "# A", []) for i in range(33)]
    df = spark.createDataFrame(rows, SOURCE)
    items = U.index_items(df).groupBy("repo_id").count().collect()
    assert {r.repo_id: r["count"] for r in items} == {"ok/a": 1, "full/a": 100, "ok/b": 2}
    assert {(r.repo_id, r.path, r.error) for r in U.snapshot_errors(df).collect()} == {
        ("dup/a", "a.md", "duplicate_path"), ("many/a", None, "item_count"), ("ids/a", "d.json", "content"),
        ("bad/a", "d.json", "content"), ("Org/R", "a.md", "repo_id"), ("rev/a", "a.md", "revision"),
        ("path/a", "../x.md", "path"), ("ext/a", "a.txt", "path_extension"), ("ext/a", "a.txt", "content"),
        ("big/a", "a.md", "content_length"), ("scope/a", "a.md", "scope_path"),
        ("null/a", "a.md", "content_length"), ("two/a", "../b.md", "path"), ("wide/a", "a.md", "scope_count"),
        ("lots/a", None, "source_count")}
    assert {r.repo_id for r in U.refused_snapshots(df).collect()} == {r[0] for r in rows} - {
        "ok/a", "ok/b", "full/a"}


def test_embedders_agree(spark):
    texts = ["", "?!", "One two two", "a" * 50, "é1 É2 x_y-z 9"] + [f"w{i} w{i * 7}" for i in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    a = {r.i: list(r.e) for r in df.select("i", U.embed_terms(F.col("text")).alias("e")).collect()}
    b = {r.i: list(r.embedding) for r in U.fixture_embedder(df).collect()}
    assert a == b and a[0][0] == 1.0 and sum(a[2]) == 3.0 and len(a[4]) == 768


def test_vectors_leave_in_small_batches(spark):
    texts = pa.array([None if i % 7 == 3 else f"w{i} w{i * 7}" for i in range(1201)])
    whole = pa.record_batch([pa.array(range(1201)), texts], ["i", "text"])
    sizes = [b.num_rows for b in U._embedded([whole], lambda t: pa.array([1] * len(t)))]
    assert sum(sizes) == 1201 and max(sizes) <= U.EMBED_ROWS
    df = spark.createDataFrame(whole.to_pylist(), "i int, text string").coalesce(1)
    want = {r.i: r.e for r in df.select("i", U.embed_terms(F.col("text")).alias("e")).collect()}
    got = {r.i: r.embedding for r in U.fixture_embedder(df.withColumn("embedding", F.lit(0))).collect()}
    assert len(got) == 1201 and all(got[i] is None if i % 7 == 3 else got[i] == want[i] for i in got)


def test_topk_ties_scopes_and_threshold(spark):
    v = lambda *x: [float(y) for y in x]
    store = spark.createDataFrame(
        [("r", "b", "m", [], v(1, 0)), ("r", "a", "m", [], v(2, 0)), ("r", "c", "m", ["src"], v(1, .1)),
         ("r", "d", "n", [], v(1, 0)), ("s", "e", "m", [], v(1, 0)), ("r", "f", "m", [], v(-1, 1))],
        "repo_id string, source_id string, embedder string, scopes array<string>, embedding array<float>")
    ask = spark.createDataFrame([(1, "r", "srcx/a", "m", v(3, 0)), (2, "r", "src/a", "m", v(3, .3))],
                                "query_id bigint, repo_id string, query_path string, embedder string, "
                                "embedding array<float>")
    got = U.cosine_topk(ask, store, k=3, min_similarity=0.2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.source_id) for r in got] == [(1, "a"), (1, "b"), (2, "c"), (2, "a"), (2, "b")]
    assert math.isclose(got[2].similarity, 1.0)


def test_topk_leaves_out_broken_vectors(spark):
    nan, inf = float("nan"), float("inf")
    store = spark.createDataFrame(
        [("r", "a", "m", [], [1.0, 0.0]), ("r", "z", "m", [], [0.0, 0.0]), ("r", "n", "m", [], [nan, 1.0]),
         ("r", "i", "m", [], [inf, 1.0]), ("r", "s", "m", [], [1.0]), ("r", "x", "m", [], None),
         ("r", "e", "m", [], []), ("r", "h", "m", [], [None, 1.0])],
        "repo_id string, source_id string, embedder string, scopes array<string>, embedding array<float>")
    asks = [[2.0, 0.0], [0.0, 0.0], None, [nan, 1.0], []]
    ask = spark.createDataFrame([(i, "r", "a", "m", v) for i, v in enumerate(asks)],
                                "query_id bigint, repo_id string, query_path string, embedder string, "
                                "embedding array<float>")
    got = U.cosine_topk(ask, store, k=3, min_similarity=-1.0).collect()
    assert [(r.query_id, r.source_id, r.similarity) for r in got] == [(0, "a", 1.0)]


def test_a_manifest_with_an_error_is_refused_whole(spark):
    entry = lambda *paths: json.dumps({"sources": [{"path": p} for p in paths]})
    manifests = spark.createDataFrame(
        [("Ok/A", "1", entry("a.md", "b.md")), ("miss/a", "1", entry("a.md", "c.md")),
         ("path/a", "1", entry("a.md", "../a.md")), ("many/a", "1", entry(*["a.md"] * 33)),
         ("json/a", "1", "{"), ("none/a", "1", entry())], "repo_id string, revision string, manifest string")
    blobs = spark.createDataFrame([("1", "a.md", "A"), ("1", "b.md", "B")],
                                  "revision string, path string, content string")
    good = U.manifest_sources(manifests, blobs).collect()
    assert {(r.repo_id, r.path, r.content) for r in good} == {("ok/a", "a.md", "A"), ("ok/a", "b.md", "B")}
    why = {r.repo_id: r.error for r in U.manifest_errors(manifests, blobs).collect()}
    assert why == {"miss/a": "file", "path/a": "path", "many/a": "manifest_size", "json/a": "manifest",
                   "none/a": "manifest"}


def test_contract_bounds_take_whole_values_and_no_nulls(spark):
    rows = spark.createDataFrame(
        [("o/r\n", "a" * 40 + "\n", "a.md", "", [], 1), (None,) * 6, ("o/r", "a" * 40, "a.md", "", [], 1)],
        "repo_id string, revision string, path string, content string, applies_to array<string>, k int")
    got = [r.failed for r in contract_checks(rows).collect()]
    assert got[0] == "repo_id,revision" and got[2] == "" and len(got[1].split(",")) == 8


def test_store_versions(spark, tmp_path):
    store = GuidanceStore(spark, str(tmp_path), dimensions=2)
    schema = ("repo_id string, source_id string, kind string, path string, revision string, locator "
              "string, excerpt string, scopes array<string>, embedder string, embedding array<float>")
    row = lambda repo, sid, rev: (repo, sid, "markdown", "p.md", rev, "L1", "x", [], "m", [1.0, 0.0])
    repos = lambda *names: spark.createDataFrame([(n,) for n in names], "repo_id string")
    assert store.read().count() == 0
    store.write(spark.createDataFrame([row("a", "1", "1"), row("b", "1", "1")], schema), repos("a", "b"), 1)
    store.write(spark.createDataFrame([row("a", "2", "2")], schema), repos("a"), 2)
    store.write(spark.createDataFrame([], schema), repos("b"), 3)  # an empty snapshot
    assert [(r.repo_id, r.source_id) for r in store.read().collect()] == [("a", "2")]
    try:
        store.write(spark.createDataFrame([row("a", "3", "1")] * 2, schema), repos("a"), 4)
        raise AssertionError("duplicate key accepted")
    except ValueError:
        pass
    assert [r.source_id for r in store.read().collect()] == ["2"]


def _store(spark, folder, buckets=3):
    schema = ("repo_id string, source_id string, kind string, path string, revision string, locator "
              "string, excerpt string, scopes array<string>, embedder string, embedding array<float>")
    store = GuidanceStore(spark, str(folder), dimensions=2, buckets=buckets)
    rows = lambda rev, *keys: spark.createDataFrame(
        [(r, s, "markdown", "p.md", rev, "L1", "x", [], "m", [1.0, 0.0]) for r, s in keys], schema)
    repos = lambda *names: spark.createDataFrame([(n,) for n in names], "repo_id string")
    shown = lambda df: sorted((r.repo_id, r.source_id, r.revision) for r in df.collect())
    return store, rows, repos, shown


def test_store_opens_live_files_of_wanted_repositories(spark, tmp_path):
    store, rows, repos, shown = _store(spark, tmp_path)
    names = [f"r{i}" for i in range(12)]
    for version in range(1, 6):
        mine = names[version % 2::2] if version > 1 else names
        store.write(rows(str(version), *[(n, "s") for n in mine]), repos(*mine), version)
    want = sorted((n, "s", str(5 if i % 2 else 4)) for i, n in enumerate(names))
    assert shown(store.read()) == want
    attempts = lambda df: {f.split("attempt=")[1].split("-")[0] for f in df.inputFiles() if "/rows/" in f}
    assert attempts(store.read()) == {"4", "5"}
    one = store.read(repos("r3", "not there"))
    assert shown(one) == [("r3", "s", "5")] and attempts(one) == {"5"}
    assert len({f.split("bucket=")[1].split("/")[0] for f in one.inputFiles() if "/rows/" in f}) == 1
    store.compact(6, attempts=1)
    assert shown(store.read()) == want and attempts(store.read()) == {"6"}
    assert sorted(a.split("-")[0] for a in store.vacuum(keep=1)) == ["1", "2", "3", "4", "5"]
    assert store.versions() == [6] and shown(store.read()) == want
    store.write(rows("7"), repos("r0", "r1"), 7)  # emptied
    assert shown(store.read()) == [w for w in want if w[0] not in ("r0", "r1")]
    store.compact(8, attempts=1)
    store.vacuum(keep=1)
    assert shown(store.read()) == [w for w in want if w[0] not in ("r0", "r1")]


def test_store_survives_a_crash_between_steps(spark, tmp_path, monkeypatch):
    store, rows, repos, shown = _store(spark, tmp_path)
    store.write(rows("1", ("a", "1"), ("b", "1")), repos("a", "b"), 1)
    want = [("a", "1", "1"), ("b", "1", "1")]

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(GuidanceStore, "_commit", crash)
        for step in (lambda: store.write(rows("2", ("a", "9"), ("a", "8")), repos("a", "b"), 2),
                     lambda: store.compact(3, attempts=0)):
            try:
                step()
                raise AssertionError("no crash")
            except RuntimeError:
                pass
            assert shown(store.read()) == want and store.versions() == [1]
    (tmp_path / "log" / "version=2").mkdir()  # a commit that was cut off counts for nothing
    assert shown(store.read()) == want
    store.write(rows("2", ("a", "2")), repos("a", "b"), 2)  # b is emptied now, the failed try held it
    assert shown(store.read()) == [("a", "2", "2")]
    assert len(store.vacuum(keep=2)) == 1  # the failed second attempt; the third is still ahead
    assert shown(store.read()) == [("a", "2", "2")]
    with monkeypatch.context() as m:
        m.setattr(GuidanceStore, "_remove", crash)
        try:
            store.vacuum(keep=1)
        except RuntimeError:
            pass
    assert shown(store.read()) == [("a", "2", "2")]
    store.compact(4, attempts=0)
    with monkeypatch.context() as m:  # whole log there, old logs not yet removed
        m.setattr(GuidanceStore, "_remove", lambda *_: None)
        store.vacuum(keep=1)
    assert shown(store.read()) == [("a", "2", "2")]
    store.vacuum(keep=1)
    assert store.versions() == [4] and shown(store.read()) == [("a", "2", "2")]


def test_index_run_keeps_refused_repositories(spark, tmp_path):
    from patchloom.plans.guidance import index_run
    store = GuidanceStore(spark, str(tmp_path))
    first = [("a/a", ONE, "a.md", "# A\none", []), ("b/b", ONE, "a.md", "# B\none", []),
             ("c/c", ONE, "a.md", "# C\none", [])]
    index_run(spark.createDataFrame(first, SOURCE), store, 1)
    second = [("a/a", TWO, "a.md", "# A\none", ["src"]), ("b/b", TWO, "a.md", "# h\n" * 101, []),
              ("c/c", TWO, "a.md", "", [])]
    index_run(spark.createDataFrame(second, SOURCE), store, 2)
    rows = {r.repo_id: (r.revision, r.scopes) for r in store.read().collect()}
    assert rows == {"a/a": (TWO, ["src"]), "b/b": (ONE, [])}


def test_labelled_cases(spark):
    """Expected: 3 of 3 hits, 2 of 2 grounded, no false positive."""
    snapshot = spark.createDataFrame(
        [("team/shop", "b" * 40, "handbook/storage.md", GUIDE, ["storage"]),
         ("team/shop", "b" * 40, "handbook/choices.json", DECISIONS, [])], SOURCE)
    embed = U.term_embedder("blake2b")
    store = embed(U.index_items(snapshot).withColumn(
        "text", F.concat("path", F.lit("\n"), "excerpt"))).withColumn("embedder", F.lit("fixture-hash-v1"))
    cases = [("open_cursor", "storage/reader.py",
              "    cursor = open_cursor(name)  # storage cursor without a with block", "L3-L5", True),
             ("float_amount", "billing/invoice.py",
              "    amount = float(row.money)  # money amount in billing", "money-decimal", True),
             ("closed_cursor", "storage/writer.py",
              "    with open_cursor(name) as cursor:  # storage cursor closes", "L3-L5", False),
             ("other", "web/colors.py", "    return palette[3]", None, False)]
    asks = spark.createDataFrame([(i, 0, c[1], c[1] + "\n" + c[2]) for i, c in enumerate(cases)],
                                 "change_id bigint, file_no bigint, path string, query_text string")
    repos = spark.createDataFrame([(i, "Team/Shop") for i in range(4)], "change_id bigint, repo_id string")
    found = U.retrieve_guidance(asks, store, repos, k=2, min_similarity=0.09, embed=embed)
    located = found.join(store.select("source_id", "locator"), "source_id").select(
        F.col("change_id").alias("case_id"), F.lit(True).alias("enabled"), "locator")
    labelled = spark.createDataFrame([(i, c[3], c[4]) for i, c in enumerate(cases)],
                                     "case_id bigint, expected_locator string, violation boolean")
    arms = E.eval_arms(labelled)
    hits = E.retrieval_hits(arms, located)
    bodies = spark.createDataFrame(
        [(0, True, 1, "Open the cursor in a with block.\n\nRepository guidance: [g](u)"),
         (1, True, 1, "Use Decimal.\n\nRepository guidance: [g](u)")],
        "case_id bigint, enabled boolean, comment_no int, body string")
    cites = spark.createDataFrame([(0, True, "Repository guidance: [g](u)"),
                                   (1, True, "Repository guidance: [g](u)")],
                                  "case_id bigint, enabled boolean, citation string")
    terms = spark.createDataFrame([(0, "with block"), (1, "decimal"), (1, "cents")],
                                  "case_id bigint, term string")
    scores = E.grounded_findings(arms, bodies, cites, terms)
    runs = hits.join(scores.select(*E.RUN, "grounded", "false_positives"), E.RUN).withColumns({
        "review_ms": F.lit(1.5), "retrieval_ms": F.when(F.col("enabled"), F.lit(0.5))})
    rows = {r.enabled: r for r in E.arm_summary(runs).collect()}
    on, off = rows[True], rows[False]
    assert (on.hits, on.applicable, on.grounded, on.violations, on.false_positives) == (3, 3, 2, 2, 0)
    assert (off.hits, off.grounded, off.false_positives, off.retrieval_ms) == (0, 0, 0, None)
    assert E.eval_gate(runs).collect()[0].passed


def test_scope_keys_equal_a_test_of_each_scope(spark):
    scopes = [[], ["src"], ["src", "src/auth"], ["src/auth", "tests", "src/auth"], [""], ["/a"], ["src/"],
              ["a/b/c", "a"], [None], [None, "src"], None, ["srcx"]]
    paths = ["src/auth/a", "src", "srcx/q", "tests", "/a/b", "", "src//x", "a/b", "a/b/c/d", "b"]
    store = spark.createDataFrame([("r", f"s{i}", "m", s) for i, s in enumerate(scopes)],
                                  "repo_id string, source_id string, embedder string, scopes array<string>")
    asks = spark.createDataFrame([(i, "r", p, "m") for i, p in enumerate(paths)],
                                 "query_id bigint, repo_id string, query_path string, embedder string")
    got = sorted((r.query_id, r.source_id) for r in U.scope_match(asks, store).collect())
    fits = lambda p, s: s is not None and (not s or any(
        x is not None and (p == x or p.startswith(x + "/")) for x in s))
    assert got == sorted((i, f"s{j}") for i, p in enumerate(paths) for j, s in enumerate(scopes)
                         if fits(p, s))


def test_topk_does_not_depend_on_blocks(spark):
    import random
    rng = random.Random(6)
    vector = lambda: [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3)]
    store = spark.createDataFrame([(f"r{i % 2}", f"s{i:03}", "m", [["src"], [], ["a"]][i % 3], vector())
                                   for i in range(60)], "repo_id string, source_id string, embedder string, "
                                  "scopes array<string>, embedding array<float>")
    asks = spark.createDataFrame([(i, f"r{i % 3}", "src/x" if i % 2 else "a/y", "m", vector())
                                  for i in range(120)], "query_id bigint, repo_id string, query_path string, "
                                 "embedder string, embedding array<float>")
    a, b = (sorted(tuple(r) for r in U.cosine_topk(asks, store, 4, 0.1, block=n).collect()) for n in (7, 1000))
    assert a == b and len(a) > 100
    assert U.cosine_topk(asks.limit(0), store).count() == 0 and U.cosine_topk(asks, store.limit(0)).count() == 0
