import json

from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import text as T
from patchloom.operators import context as K
from patchloom.operators import patches as H
from patchloom.operators import routing as G
from patchloom.plans.review import check_run


def test_json_text_and_fence(spark):
    values = ["plain", 'q"\\ \n\t', "é ü", "😀", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.j for r in df.select("v", K.json_text(F.col("v")).alias("j")).collect()}
    assert got == {v: json.dumps(v) for v in values}
    answers = {"  ```py\na\nb\n```\n": "a\nb", "x": "x", "```\nonly": "```\nonly", "": None}
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert {r.a: r.o for r in df.select("a", K.strip_code_fence(F.col("a")).alias("o")).collect()} == answers


def test_numbered_and_tokens(spark):
    df = spark.createDataFrame([("a\nb\n", 9), ("x", 99999)], "t string, n bigint")
    rows = df.select(K.numbered_lines(F.col("t"), F.col("n")).alias("o"),
                     T.estimate_tokens(F.col("t")).alias("e")).collect()
    assert [r.o for r in rows] == ["   9 | a\n  10 | b", "99999 | x"]
    assert [r.e for r in rows] == [11, 10]


def test_patches_keep_breaks(spark):
    heads = spark.createDataFrame([(1, "a", "1\r\n2\n3")], "change_id bigint, path string, content string")
    cases = [(1, 1, 2, 2, "x", "applied", "1\r\nx\n3"), (2, 2, 3, 9, "y\n", "applied", "1\r\n2\ny\n"),
             (3, 3, 0, 2, "x", "invalid_range", None), (4, 4, 3, 2, "x", "invalid_range", None),
             (5, 5, 4, 4, "x", "past_end", None), (6, 6, 1, 1, "", "no_replacement", None)]
    p = spark.createDataFrame([(1, c[1], "a", c[2], c[3], c[4]) for c in cases] + [(1, 7, "b", 1, 1, "x")],
                              "change_id bigint, seq bigint, path string, start_line bigint, "
                              "end_line bigint, replacement_code string")
    got = H.apply_patches(p, heads).orderBy("seq").collect()
    assert [(r.status, r.content) for r in got] == [c[5:] for c in cases] + [("missing_file", None)]
    lines = H.original_lines(p, heads).orderBy("seq").collect()
    assert [r.original for r in lines] == ["2", "3", "", "", "", "1", ""]


def test_routing(spark):
    rows = [("src/auth/a.py", 201, 0, "deep"), ("src/auth/a.py", 200, 9, "standard"),
            ("tests/test_a.py", 900, 9, "fast"), ("src/a.py", 51, 0, "standard"),
            ("src/a.py", 50, 6, "deep"), ("src/a.py", 50, 3, "standard"), ("src/a.py", 50, 2, "fast"),
            ("src/monkey.py", 1, 0, "standard")]
    df = spark.createDataFrame([r[:3] for r in rows],
                               "path string, changed_line_count bigint, function_count bigint")
    assert [r.tier for r in G.assess_complexity(df).collect()] == [r[3] for r in rows]


def test_check_run_end_to_end(spark):
    text = "\n".join([
        "diff --git a/src/a.py b/src/a.py", "--- a/src/a.py", "+++ b/src/a.py", "@@ -1 +1,3 @@",
        " import os", "+x = eval(y)", "+password = 'hunter22'",
        "diff --git a/yarn.lock b/yarn.lock", "--- a/yarn.lock", "+++ b/yarn.lock", "@@ -1 +1 @@",
        "+password = 'hunter22'"])
    diffs = spark.createDataFrame([(1, text)], "change_id bigint, diff_text string")
    heads = spark.createDataFrame([], "change_id bigint, path string, content string")
    found = check_run(diffs, heads).orderBy("start_line").collect()
    assert [(r.path, r.start_line, r.rule) for r in found] == [
        ("src/a.py", 2, "eval-usage"), ("src/a.py", 3, "hardcoded-password")]
    assert C.SEVERITIES[-1] == found[0].severity


def test_prompts_are_parts_of_one_text(spark):
    texts = {1: [(4, "b" * 90), (2, "a😀" * 9), (70, ""), (200, "z")], 2: [(0, "c")], 3: []}
    contexts = spark.createDataFrame([(c, n, t) for c, rows in texts.items() for n, t in rows],
                                     "change_id bigint, file_no bigint, context_text string")
    changes = spark.createDataFrame([(1, "T", "B"), (2, "", None), (3, "x", "y")],
                                    "change_id bigint, title string, body string")
    want = {c: ("## Pull Request: T\n\nB\n\n" if c == 1 else "") + "## Code Changes to Review\n\n"
            + "\n---\n".join(t for _, t in sorted(texts[c])) + "\n" + C.REVIEW_INSTRUCTIONS for c in (1, 2)}
    for chars in (1, 7, 64, 100_000):
        got = {}
        for r in K.review_prompt(contexts, changes, chars).orderBy("change_id", "part_no").collect():
            got.setdefault(r.change_id, []).append(r)
        assert {c: "".join(r.prompt for r in rows) for c, rows in got.items()} == want
        for rows in got.values():
            assert [(r.part_no, r.parts) for r in rows] == [(k, len(rows)) for k in range(len(rows))]
            assert {len(r.prompt) for r in rows[:-1]} <= {chars}


def test_prompt_in_parts_has_one_system_row_and_ordered_user_rows(spark):
    changes = spark.createDataFrame([(1, "T", ""), (2, "", "")],
                                    "change_id bigint, title string, body string")
    contexts = spark.createDataFrame([(1, 2, "a" * 9), (1, 5, "b" * 9), (2, 1, "c")],
                                     "change_id bigint, file_no int, context_text string")
    matches = spark.createDataFrame([(1, 0, "p", "s", "e")], "change_id bigint, seq int, "
                                    "changed_path string, source_id string, excerpt string")
    for m in (None, matches):
        def chat(chars):
            out = {}
            for r in K.chat_messages(K.review_prompt(contexts, changes, chars), m).orderBy(
                    "change_id", "seq").collect():
                out.setdefault(r.change_id, []).append((r.seq, r.role, r.content))
            return out
        whole, parts = chat(100_000), chat(100)
        assert [x[:2] for x in parts[1]] == [(0, "system")] + [
            (k, "user") for k in range(1, len(parts[1]))] and len(parts[1]) > 3
        assert parts[1][0] == whole[1][0] and len(whole[2]) == 2
        assert "".join(x[2] for x in parts[1][1:]) == whole[1][1][2]
