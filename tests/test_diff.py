"""Diff parsing on literal cases, one per rule of the format."""

from pyspark.sql import functions as F

from patchloom.operators import diff as D
from patchloom.operators import filters as L


def parse(spark, text):
    diffs = spark.createDataFrame([(1, text)], "change_id bigint, diff_text string")
    order = ["file_no", "hunk_no", "seq"]
    files = [r.asDict() for r in D.diff_files(diffs).orderBy("file_no").collect()]
    hunks = [r.asDict() for r in D.diff_hunks(diffs).orderBy(*order[:2]).collect()]
    rows = [(r.file_no, r.hunk_no, r.op, r.content, r.line_number, r.old_line_number)
            for r in D.diff_changes(diffs).orderBy(*order).collect()]
    return files, hunks, rows


def test_counters_and_prefixes(spark):
    files, hunks, rows = parse(spark, "\n".join([
        "noise before", "diff --git a/x.py b/x.py", "index 1..2", "--- a/x.py", "+++ b/x.py",
        "@@ -10 +20,3 @@ def f():", " keep", "-gone", "+new", "+new2", "plain", "\\ No newline",
        "", "@@ -50,2 +70 @@", "-a", "-b"]))
    assert (files[0]["old_path"], files[0]["new_path"]) == ("x.py", "x.py")
    assert [(h["old_start"], h["old_count"], h["new_start"], h["new_count"]) for h in hunks] == [
        (10, 1, 20, 3), (50, 2, 70, 1)]
    assert hunks[0]["header"] == "@@ -10 +20,3 @@ def f():"
    assert rows == [
        (0, 0, "context", "keep", 20, 10), (0, 0, "delete", "gone", 21, 11),
        (0, 0, "add", "new", 21, None), (0, 0, "add", "new2", 22, None),
        (0, 0, "context", "plain", 23, 12), (0, 0, "context", "", 24, 13),
        (0, 1, "delete", "a", 70, 50), (0, 1, "delete", "b", 70, 51)]


def test_flags_and_paths(spark):
    files, hunks, rows = parse(spark, "\n".join([
        "diff --git a/new.py b/new.py", "new file mode 100644", "--- /dev/null", "+++ b/new.py",
        "@@ -0,0 +1 @@", "+x",
        "diff --git a/old.py b/old.py", "deleted file mode 100644", "--- a/old.py",
        "+++ /dev/null", "@@ -1 +0,0 @@", "-x",
        "diff --git a/a b/b", "rename from first", "rename from a b", "rename to c d",
        "diff --git a/i.png b/i.png", "Binary files a/i.png and b/i.png differ", "@@ -1 +1 @@", "+z",
        "diff --git broken header", "+lost",
        "diff --git a/e b/e", "+++ b/wrong", "@@ -1 +1 @@", "+y",
        "diff --git a/q b/q", '--- "a/odd"', "rename to late", "@@ -3 +3 @@", "+w"]))
    got = [(f["path"], f["is_new_file"], f["is_deleted_file"], f["is_renamed"], f["is_binary"])
           for f in files]
    assert got == [
        ("new.py", True, False, False, False), ("old.py", False, True, False, False),
        ("c d", False, False, True, False), ("i.png", False, False, False, True),
        ("e", False, False, False, False), ("q", False, False, False, False)]
    assert files[0]["old_path"] is None and files[1]["new_path"] is None
    assert files[2]["old_path"] == "a b"
    assert [f["file_no"] for f in files] == list(range(6))
    assert [(r[0], r[3]) for r in rows] == [(0, "x"), (1, "x"), (4, "y"), (5, "w")]


def test_line_breaks_and_blank_texts(spark):
    _, _, rows = parse(spark, "diff --git a/x b/x\r\n@@ -1 +1 @@\r\n+a\x0c+b +c\n\n")
    assert [(r[2], r[3]) for r in rows] == [
        ("add", "a"), ("add", "b"), ("add", "c"), ("context", "")]
    blank = spark.createDataFrame([(1, " \n\t　"), (2, ""), (3, None), (4, "x")],
                                  "change_id bigint, diff_text string")
    assert [r.change_id for r in D.scan_diffs(blank).collect()] == [4]
    assert [r.raw for r in D.diff_lines(spark.createDataFrame(
        [(1, "a\r\nb\n\n")], "change_id bigint, diff_text string")).collect()] == ["a", "b", ""]


def test_ranges_reports_and_texts(spark):
    text = "\n".join(["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -5,2 +5,0 @@", "-a", "-b",
                      "@@ -9 +9,30 @@"] + [f"+l{i}" for i in range(30)])
    diffs = spark.createDataFrame([(1, text)], "change_id bigint, diff_text string")
    assert [(r.first_line, r.last_line) for r in D.hunk_line_range(diffs).orderBy(
        "hunk_no").collect()] == [(5, 5), (9, 38)]
    report = D.diff_report(diffs).collect()[0]
    assert report.hunks == 2 and report.first_changed == (
        "[" + ", ".join(str(n) for n in range(9, 29)) + "]...")
    files = D.diff_files(diffs, with_hunks=True)
    assert D.added_text(files, 7).collect()[0].added_text == "l0\nl1\nl"


def test_head_text_or_diff(spark):
    text = "\n".join(["diff --git a/x b/x", "@@ -1 +1,2 @@", "+one", "+two", "@@ -9 +2 @@", "+again"])
    files = D.diff_files(spark.createDataFrame([(1, text)], "change_id bigint, diff_text string"),
                         with_hunks=True)
    head = lambda t: spark.createDataFrame([(1, "x", t)], "change_id bigint, path string, content string")
    texts = lambda df: sorted((r.line, r.text) for r in df.collect())
    assert texts(L.changed_line_text(files, head("H"))) == [(1, "H")]
    assert texts(L.changed_line_text_or_diff(files, head("H\nI\n"))) == [(1, "H"), (2, "I")]
    assert texts(L.changed_line_text_or_diff(files, head("").filter("false"))) == [
        (1, "one"), (2, "again")]
    assert texts(L.changed_line_text_or_diff(files, head(""))) == []


def test_ignored_paths(spark):
    cases = {
        "package-lock.json": True, "a/b/yarn.lock": True, "x.min.js": True, "a/x.bundle.js": True,
        "node_modules/a.js": True, "a/node_modules/b.js": False, "node_modules": True,
        "dist\\x.js": True, ".env": True, "cfg/.env.local": True, "env": False,
        "src/main.py": False, "a.png": True, "x.generated.ts": True, "a/b.tar.gz": True,
        "distx/a.py": False, "src/app.PNG": False}
    rows = L.ignored_paths(spark.createDataFrame([(p,) for p in cases], "path string")).collect()
    assert {r.path: r.ignored for r in rows} == cases
    own = L.ignored_paths(spark.createDataFrame([("docs/a.txt",)], "path string"),
                          extra=("docs/**",)).collect()
    assert own[0].ignored


def test_paths(spark):
    from patchloom.functions import paths as P
    df = spark.createDataFrame([(p,) for p in (
        "a/b.PY", "a.b/c", ".py", "x.", "a/../b", "a//b", "ok/x.tsx", "a\\b", "a\tb")], "p string")
    rows = {r.p: r for r in df.select(
        "p", P.extension(F.col("p")).alias("e"), P.language(F.col("p")).alias("l"),
        P.is_valid_path(F.col("p")).alias("v")).collect()}
    assert rows["a/b.PY"].e == ".py" and rows["a/b.PY"].l == "python"
    assert rows["a.b/c"].e == ".b/c" and rows["a.b/c"].l is None
    assert rows[".py"].e == ".py" and rows[".py"].l is None
    assert rows["ok/x.tsx"].l == "typescript"
    assert [p for p in rows if not rows[p].v] == ["a/../b", "a//b", "a\\b", "a\tb"]
