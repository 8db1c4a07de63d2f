import re

from patchloom.operators import rules as R

LINES = [
    ('api_key = "abcdefghijklmnop1234"', "x.py", {"hardcoded-api-key"}),
    ('api_key = "example_key_abcdefgh"', "x.py", set()),
    ("PASSWORD: 'hunter22'", "x.yml", {"hardcoded-password"}),
    ("password = 'hashed1234'", "x.py", set()),
    ("x = eval (y)", "x.py", {"eval-usage"}), ("x = eval(y)", "x.js", set()),
    ("medieval(y)", "x.py", set()), ("exec(code)", "x.py", {"exec-usage"}),
    ('cur.execute(f"SELECT {x}")', "x.py", {"sql-injection-python"}),
    ("db.query(`SELECT ${x}`)", "x.ts", {"sql-injection-js"}),
    ("db.execute('a' + b)", "x.jsx", {"sql-injection-js"}),
    ("  except :  ", "x.py", {"bare-except"}), ("except ValueError:", "x.py", set()),
    ("try {} catch (e) {  }", "x.tsx", {"empty-catch-js"}),
    ("console.log(a)", "x.js", {"console-log"}), ("console.log(test)", "x.js", set()),
    ("# todo fix", "x.md", {"todo-fixme"}), ("# todos", "x.md", set()),
    ('exec(eval("1"))  # FIXME', "X.PY", {"eval-usage", "exec-usage", "todo-fixme"}),
]


def test_each_rule(spark):
    df = spark.createDataFrame([(1, 0, p, i, t) for i, (t, p, _) in enumerate(LINES)],
                               "change_id bigint, file_no bigint, path string, line bigint, text string")
    found = {}
    for r in R.rule_scan(df).collect():
        found.setdefault(r.start_line, set()).add(r.rule)
    assert found == {i: want for i, (_, _, want) in enumerate(LINES) if want}
    majors = R.rule_scan(df, min_severity="major").collect()
    assert {r.severity for r in majors} == {"critical", "major"}
    assert R.rule_scan(df, rules=R.DEFAULT_RULES[-1:], min_severity="critical").count() == 0


def test_own_rule_and_python_agreement(spark):
    df = spark.createDataFrame([(1, 0, "a.go", 7, "panic(err)")],
                               "change_id bigint, file_no bigint, path string, line bigint, text string")
    own = R.Rule("panic", r"\bpanic\(", "minor", "bug", "No panics.", (".go",))
    row = R.rule_scan(df, rules=(own,)).collect()[0]
    assert row.reasoning == "Deterministic check 'panic' matched on line 7."
    for rule in R.DEFAULT_RULES:  # the patterns mean the same to Python
        for text, path, want in LINES:
            hit = bool(re.search(rule.pattern, text)) and not (
                rule.negative_pattern and re.search(rule.negative_pattern, text))
            fits = rule.extensions is None or path[path.rfind("."):].lower() in rule.extensions
            assert (rule.name in want) == (hit and fits)
