"""The whole review job on a few changes."""

import json

from patchloom.plans.review import review_run

DIFF = "\n".join(["diff --git a/src/a.py b/src/a.py", "--- a/src/a.py", "+++ b/src/a.py",
                  "@@ -1 +1,3 @@", " import os", "+x = eval(y)", "+z = 1"])


def issue(start, end, **more):
    return {"file_path": "src/a.py", "start_line": start, "end_line": end, "severity": "minor",
            "category": "bug", "reasoning": "r", "explanation": "See *this*.",
            "can_generate_patch": True, "replacement_code": "z = 2", **more}


def test_review_run(spark):
    cited = dict(repository_convention=True, guidance_id="g1")
    answers = {
        1: [issue(3, 3, **cited), issue(1, 3, **cited), issue(3, 3, guidance_id="g1"),
            issue(3, 3, repository_convention=True, guidance_id="forged"), issue(3, 3)],
        2: [issue(3, 3, **cited)], 3: [issue(1, 1)]}
    diffs = spark.createDataFrame(
        [(1, DIFF), (2, DIFF), (3, DIFF.replace("a.py", "a.png"))], "change_id bigint, diff_text string")
    heads = spark.createDataFrame([(c, "src/a.py", "import os\nx = eval(y)\nz = 1") for c in (1, 2)],
                                  "change_id bigint, path string, content string")
    responses = spark.createDataFrame(
        [(c, json.dumps({"summary": f"S{c}", "risk_level": "high", "issues": i}))
         for c, i in answers.items()], "change_id bigint, json string")
    attempts = spark.createDataFrame(
        [(1, 1, 4, 0, 0, True, True, "", "", None, False)],
        "change_id bigint, src bigint, k1 bigint, k2 bigint, k3 bigint, sandbox_on boolean, "
        "first_ok boolean, first_stdout string, first_stderr string, repair_code string, "
        "repair_ok boolean")
    matches = spark.createDataFrame(
        [(1, "src/a.py", "g1", "o/r", "docs/a b.md", "markdown", "L1-L2", "f" * 40)],
        "change_id bigint, changed_path string, source_id string, repo_id string, ref_path string, "
        "ref_kind string, ref_locator string, ref_revision string")
    out = review_run(diffs, heads, responses, attempts, matches, bot="bot")
    found = {(r.change_id, r.src, r.k1): r for r in out["findings"].collect()}
    assert set(found) == {(1, 0, 0), (1, 1, 0), (1, 1, 4), (2, 0, 0), (2, 1, 0)}
    first = found[1, 1, 0]
    assert first.citation_label == "docs/a b.md (L1-L2)" and first.replacement_code is None
    assert first.citation_url == f"https://github.com/o/r/blob/{'f' * 40}/docs/a%20b.md#L1-L2"
    assert found[2, 1, 0].replacement_code == "z = 2" and found[2, 1, 0].citation_url is None
    assert found[1, 1, 4].status == "verified" and found[1, 0, 0].status == "skipped"
    bodies = {(r.change_id, r.src, r.k1): r.body for r in out["comments"].collect()}
    assert set(bodies) == set(found)
    assert "See \\*this\\*." in bodies[1, 1, 4] and "See *this*." in bodies[2, 1, 0]
    assert "Repository guidance: [docs/a b.md (L1-L2)](https://" in bodies[1, 1, 0]
    results = {r.change_id: tuple(r)[1:] for r in out["results"].collect()}
    assert results == {1: (3, 1, 0, True), 2: (2, 0, 0, True), 3: (0, 0, 0, False)}
    summaries = {r.change_id: r.body for r in out["summaries"].collect()}
    assert "S1\n" in summaries[1] and "| Critical | 1 |" in summaries[1]
    assert set(summaries) == {1, 2}  # nothing to review in the third change


def test_prompt_run_on_real_outlines(spark):
    from patchloom import constants as C
    from patchloom.plans.prompts import prompt_run
    head = ("import os\n\n\ndef untouched(a,\n              b=(1, 2)):\n    return a\n\n\n"
            "class K:\n    def touched(self):\n        x = 1\n        return x\n")
    diff = "\n".join([
        "diff --git a/src/a.py b/src/a.py", "--- a/src/a.py", "+++ b/src/a.py", "@@ -9,3 +9,4 @@", " class K:",
        "     def touched(self):", "+        x = 1", "         return x",
        "diff --git a/yarn.lock b/yarn.lock", "--- a/yarn.lock", "+++ b/yarn.lock", "@@ -1 +1 @@", "+x"])
    diffs = spark.createDataFrame([(1, diff), (2, "")], "change_id bigint, diff_text string")
    heads = spark.createDataFrame([(1, "src/a.py", head), (1, "yarn.lock", "x")],
                                  "change_id bigint, path string, content string")
    changes = spark.createDataFrame([(1, "T", "B"), (2, "U", "")], "change_id bigint, title string, body string")
    whole = prompt_run(diffs, heads, changes).orderBy("seq").collect()
    assert [(r.change_id, r.seq, r.role) for r in whole] == [(1, 0, "system"), (1, 1, "user")]
    text = whole[1].content
    shown = text.split(C.CONTEXT_MODIFIED.strip())[1].split(C.CONTEXT_SKELETONS.strip())
    assert "  11 |         x = 1" in shown[0] and "untouched" not in shown[0]
    assert "untouched(a,\n              b=(1, 2))" in shown[1] and "import os" in text.split("###")[1]
    assert "+        x = 1" in text and "yarn.lock" not in text
    parts = prompt_run(diffs, heads, changes, part_chars=50).filter("role = 'user'").orderBy("seq").collect()
    assert len(parts) > 5 and "".join(r.content for r in parts) == text
