import json

from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.operators import comments as M
from patchloom.operators import findings as N
from patchloom.operators import lifecycle as Y

ISSUE = {"file_path": "a.py", "start_line": 1, "end_line": 2, "severity": "major", "category": "bug",
         "reasoning": "r", "explanation": "e", "can_generate_patch": False}


def test_parse_responses(spark):
    def answer(**more):
        return json.dumps({"summary": "s", "risk_level": "odd", **more})
    cases = [
        (answer(issues=[ISSUE]), True, 1), (answer(), True, 0), (answer(issues=None), False, 0),
        (answer(issues=[{**ISSUE, "severity": "urgent"}]), False, 0),
        (answer(issues=[{**ISSUE, "start_line": "1"}]), True, 1),
        (answer(issues=[{k: v for k, v in ISSUE.items() if k != "reasoning"}]), False, 0),
        ('{"summary": "s"}', False, 0), ("not json", False, 0), ("", False, 0),
        (answer(issues=[ISSUE, {**ISSUE, "replacement_code": None, "extra": 1}]), True, 2)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "change_id bigint, json string")
    rows = {r.change_id: r for r in N.parse_responses(df).collect()}
    assert [(rows[i].valid, len(rows[i].issues)) for i in range(len(cases))] == [
        (c[1], c[2]) for c in cases]
    assert rows[6].summary == C.FALLBACK_SUMMARY and rows[6].risk_level == "low"
    assert rows[0].risk_level == "odd"


def test_answers_are_taken_field_by_field(spark):
    one = lambda **more: json.dumps({"summary": "s", "risk_level": "low", "issues": [{**ISSUE, **more}]})
    whole = {" 12 ": 12, "+3": 3, "-4": -4, "1_000": 1000, "5.0": 5, 6.0: 6, True: 1, 7: 7, "7.5": None,
             7.5: None, "x": None, "": None, None: None, "1e3": None, "0x1": None}
    cases = [(one(start_line=v), w) for v, w in whole.items()] + [
        (one(start_line=[1]), None), (one(start_line={}), None)]
    truth = {"Yes": True, "off": False, 1: True, 0.0: False, "TRUE": True, "maybe": None, 2: None}
    cases_b = [(one(can_generate_patch=v), w) for v, w in truth.items()]
    bad = [one(reasoning=5), one(file_path=None), one(severity="Major"), one(replacement_code=3),
           one(guidance_id=1), one(repository_convention=None), one(category=1),
           json.dumps({"summary": 5, "risk_level": "low"}), json.dumps({"summary": "s", "risk_level": None}),
           json.dumps({"summary": "s", "risk_level": "x", "issues": {}}), "[]", "5", "null", '{"summary": "s"',
           json.dumps({"summary": "s", "risk_level": "x", "issues": [None]})]
    rows = [c for c, _ in cases + cases_b] + bad + [None]
    got = {r.change_id: r for r in N.parse_responses(spark.createDataFrame(
        list(enumerate(rows)), "change_id bigint, json string")).collect()}
    for i, (_, want) in enumerate(cases):
        assert [x.start_line for x in got[i].issues] == ([] if want is None else [want]), rows[i]
    for i, (_, want) in enumerate(cases_b, len(cases)):
        assert [x.can_generate_patch for x in got[i].issues] == ([] if want is None else [want]), rows[i]
    assert not any(got[i].valid for i in range(len(cases) + len(cases_b), len(rows)))
    fine = [one(repository_convention="true", guidance_id="g"), one(replacement_code=None, guidance_id=None)]
    got = {r.change_id: r for r in N.parse_responses(spark.createDataFrame(
        list(enumerate(fine)), "change_id bigint, json string")).collect()}
    assert got[0].issues[0].repository_convention is True and got[0].issues[0].guidance_id == "g"
    assert got[1].valid and got[1].issues[0].replacement_code is None


def test_snap_and_span(spark):
    lines = spark.createDataFrame([(1, "a", n) for n in (10, 12, 20, 21)],
                                  "change_id bigint, path string, line bigint")
    found = spark.createDataFrame(
        [(1, 1, "a", 10, 12), (1, 2, "a", 11, 11), (1, 3, "a", 5, 26), (1, 4, "a", 1, 27),
         (1, 5, "b", 1, 10), (1, 6, "a", 20, 21)],
        "change_id bigint, seq bigint, path string, start_line bigint, end_line bigint")
    out = M.comment_span(M.snap_line(found, lines, ["change_id", "seq"]), lines).orderBy("seq")
    assert [(r.seq, r.comment_line, r.span_start) for r in out.collect()] == [
        (1, 12, 10), (2, 12, None), (3, 21, None), (6, 21, 20)]


def test_escape_and_body(spark):
    df = spark.createDataFrame([("See https://x.y/z) and [a](b) <i>\n it's #1!",)], "t string")
    assert df.select(M.escape_prose(F.col("t")).alias("o")).collect()[0].o == (
        "See link omitted\\) and \\[a\\]\\(b\\) &lt;i&gt;  it&\\#x27;s \\#1\\!")
    f = spark.createDataFrame(
        [("a.py", 1, 2, "critical", "security", "Bad.", "", "fix()", "repaired")],
        "path string, start_line bigint, end_line bigint, severity string, category string, "
        "explanation string, repaired_code string, replacement_code string, status string")
    row = M.with_body_columns(M.with_comment_id(f)).select(
        "comment_id", M.comment_body("bot").alias("b")).collect()[0]
    assert row.b == (f"<!-- bot:id={row.comment_id} -->\n**🔴 Critical** | 🔒 Security\n\nBad.\n\n"
                     "```suggestion\nfix()\n```\n\n> ✅ **Verified (Auto-Repaired)** — fixed and tested")
    assert len(row.comment_id) == 12


def test_cap_is_by_finding_order(spark):
    rows = [(1, 1, i, 0, 0) for i in range(30)] + [(1, 0, 3, 2, i) for i in range(5)]
    df = spark.createDataFrame(rows, "change_id bigint, src bigint, k1 bigint, k2 bigint, k3 bigint")
    kept = N.cap_comments(df).orderBy(*N.ORDER).collect()
    assert [tuple(r)[1:] for r in kept] == [(0, 3, 2, i) for i in range(5)] + [
        (1, i, 0, 0) for i in range(10)]


def test_verification_status(spark):
    base = dict(can_generate_patch=True, replacement_code="x", sandbox_on=True, first_ok=False,
                first_stdout="o", first_stderr="", repair_code="y", repair_ok=True)
    cases = [({}, "repaired", C.PASSED_OUTPUT), ({"first_ok": True}, "verified", C.PASSED_OUTPUT),
             ({"replacement_code": ""}, "skipped", None),
             ({"sandbox_on": False}, "skipped", C.SANDBOX_OFF_OUTPUT),
             ({"first_stdout": ""}, "failed", ""), ({"repair_code": None}, "failed", "o"),
             ({"repair_ok": False, "first_stderr": "e"}, "failed", "o\ne")]
    df = spark.createDataFrame(
        [tuple({**base, **c[0]}.values()) + (i,) for i, c in enumerate(cases)],
        "can_generate_patch boolean, replacement_code string, sandbox_on boolean, first_ok boolean, "
        "first_stdout string, first_stderr string, repair_code string, repair_ok boolean, n int")
    out = N.verification_status(df).orderBy("n").collect()
    assert [(r.status, r.output) for r in out] == [c[1:] for c in cases]


def test_lifecycle_keeps_repeats_and_marks_once(spark):
    mark = lambda i: f"<!-- {C.BOT_NAME}:id={i} -->"
    posted = spark.createDataFrame(
        [(1, 1, mark("a")), (1, 2, C.RESOLVED_BADGE + mark("b")), (1, 3, mark("a") + " later"),
         (1, 4, "talk"), (2, 5, mark("z"))], "change_id bigint, seq bigint, body string")
    current = spark.createDataFrame([(1, "n"), (1, "n"), (1, "a")],
                                    "change_id bigint, comment_id string")
    old = Y.existing_comments(posted)
    assert {(r.comment_id, r.seq) for r in old.collect()} == {("a", 3), ("b", 2), ("z", 5)}
    assert Y.new_comments(current, old).count() == 2
    runs = spark.createDataFrame([(1,), (3,)], "change_id bigint")
    stats = Y.lifecycle_stats(current, posted, runs).orderBy("change_id").collect()
    assert [tuple(r) for r in stats] == [(1, 2, 2, 1, 0), (3, 0, 0, 0, 0)]


def test_only_changes_with_a_run_resolve_and_an_empty_run_resolves_all(spark):
    mark = lambda i: f"<!-- {C.BOT_NAME}:id={i} -->"
    posted = spark.createDataFrame([(1, 1, mark("a")), (2, 2, mark("b")), (3, 3, mark("c"))],
                                   "change_id bigint, seq bigint, body string")
    current = spark.createDataFrame([(1, "a")], "change_id bigint, comment_id string")
    runs = spark.createDataFrame([(1,), (2,)], "change_id bigint")
    resolved = Y.resolved_comments(current, Y.existing_comments(posted), runs)
    assert [r.comment_id for r in resolved.collect()] == ["b"]
    stats = Y.lifecycle_stats(current, posted, runs).orderBy("change_id").collect()
    assert [tuple(r) for r in stats] == [(1, 1, 0, 1, 0), (2, 1, 0, 0, 1)]
